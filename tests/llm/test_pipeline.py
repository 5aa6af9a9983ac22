"""The pipeline's stages at sf0.001: each decision takes effect on its own input."""

import corpus_pipeline as cp
from tests.llm import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"start": docs}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == seen["start"].columns
        seen[name] = docs
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in seen.items()}
    letters = {r["doc_id"] for r in seen["start"].collect() if any(c.isalpha() for c in r["text"] or "")}
    assert set(ids["language_id"]) == letters
    texts = {}
    for r in seen["language_id"].collect():
        texts[fx.lower(r["text"])] = max(r["doc_id"], texts.get(fx.lower(r["text"]), -1))
    assert sorted(ids["exact_dedup"]) == sorted(texts.values())
    sets = {r["doc_id"]: fx.shingle_set(r["text"], 5) for r in seen["exact_dedup"].collect()}
    items = sorted(sets.items())
    pairs = [(a, b) for i, (a, x) in enumerate(items) for b, y in items[i + 1:] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    assert sorted(ids["minhash"]) == sorted(set(fx.components(sets, pairs).values()))
    assert set(ids["mixing"]) <= set(ids["minhash"])
    size = {r["doc_id"]: len(fx.WORD.findall(r["text"])) for r in seen["minhash"].collect()}
    got, all_words = sum(size[i] for i in ids["mixing"]), sum(size.values())
    assert 0.8 * all_words <= got <= 1.01 * all_words
    pieces = cp.packed(spark, docs, SF).collect()
    assert sum(p["start"] == 0 for p in pieces) == len(ids["mixing"])


def test_awkward_rows_pass_all_stages(spark):
    docs = fx.docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
