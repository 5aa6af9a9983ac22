"""Registered queries over whole tables against brute force: nothing found wrongly, nothing lost."""

import itertools

import numpy as np

from souk.llm import registry
from tests.llm import fixtures as fx

SF = "/root/testdata/sf0.01"


def test_near_duplicates_of_all_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    number = {}
    sets = {}
    for r in rows:
        s = fx.shingle_set(r["text"], 2)
        sets[r["doc_id"]] = np.unique(np.array([number.setdefault(x, len(number)) for x in s], np.int64))
    by_size = sorted((len(s), i) for i, s in sets.items() if len(s))
    pairs = []
    for at, (n, i) in enumerate(by_size):
        for size, j in itertools.takewhile(lambda x: 100 * n >= 80 * x[0], by_size[at + 1:]):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= 80 * (n + size - common):
                pairs.append((i, j))
    want = fx.components(sets, pairs)
    got = registry.op5_minhash(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_near_duplicates_of_all_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in rows if r["embedding"] is not None and None not in r["embedding"]]
    good = [(i, v / np.linalg.norm(v)) for i, v in good if np.isfinite(v).all() and v.any()]
    ids, mat = [i for i, _ in good], np.stack([v for _, v in good])
    near = mat @ mat.T >= 0.9
    links = {i: int(near[k].sum()) - 1 for k, i in enumerate(ids)}
    want = fx.components([r["vec_id"] for r in rows], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    got = registry.op8_embedding_dedup(spark, SF).collect()
    found = sum(r["n_links"] for r in got)
    assert found <= sum(links.values()) and found >= 0.99 * sum(links.values())
    assert all(r["n_links"] <= links.get(r["vec_id"], 0) for r in got)
    assert sum(r["component_id"] != want[r["vec_id"]] for r in got) <= 0.01 * len(got)
