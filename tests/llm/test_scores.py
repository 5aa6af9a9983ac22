"""Language, quality, toxicity and secrets: units, edge cases, held-out accuracy at sf0.01."""

import collections
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as ent
from souk.llm import ftrl, langid, quality, registry, samples, secrets, toxicity
from tests.llm import fixtures as fx

SF = "/root/testdata/sf0.01"


def _grams(text):
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    out = collections.Counter()
    for w in words:
        p = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                if p[i:i + n].strip() and " " not in p[i:i + n][1:-1]:
                    out[p[i:i + n]] += 1
    return out


@pytest.mark.parametrize("text", ["Hello, big world", "a", "x1y ÉÉ é", "one\n\ntwo  three "])
def test_grams_match_brute_force(text):
    got = list(langid.chunk_grams(["", text, None]))
    assert not len(got[0]) and not len(got[2])
    decode = lambda c: "".join(" " if x == 1 else chr(x - 2) for x in (c >> 42, (c >> 21) & 0x1FFFFF, c & 0x1FFFFF) if x)
    assert collections.Counter(decode(int(c)) for c in got[1]) == _grams(text)


def test_distance_matches_brute_force():
    profiles = langid.Profiles(["aa", "bb"], np.array([10, 20, 30]), np.array([[0, 2], [1, 5], [5, 0]]), 5)
    doc = np.array([30, 10, 99])
    # aa: 30 is not ranked (5), 10 at 0 against place 1 (1), 99 unknown (5); bb: 0, |2 - 1|, 5
    assert profiles.distances(doc).tolist() == [11 / 15, 6 / 15]


def test_language_edge_cases(spark):
    d = fx.docs(spark)
    out = langid.predict(d, langid.learn(d, F.lit(True)))
    rows = out.collect()
    assert len(rows) == d.count() and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
    assert langid.predict(d.limit(0), langid.learn(d, F.lit(True))).count() == 0
    none = langid.learn(d, F.lit(False))
    assert {r["lang_pred"] for r in langid.predict(d, none).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    r = registry.op3_language_id(spark, SF).join(truth, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r >= 0.98


@pytest.mark.parametrize(("query", "label", "least"), [("op6_quality", "quality", 0.93), ("op1_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    truth = spark.read.parquet(f"{SF}/labels.parquet")
    out = registry.QUERIES[query](spark, SF)
    r = out.join(truth, "doc_id").filter("held_out").agg(F.avg((F.col(label) == F.col("predicted")).cast("int"))).first()[0]
    assert r >= least


def test_ftrl_learns_a_rule():
    rng = np.random.default_rng(1)
    index = [rng.choice(50, 5, replace=False) for _ in range(800)]
    y = np.array([float(7 in i) for i in index])
    w = ftrl.fit_rows(index, [np.full(5, 0.45)] * 800, y, 64)
    assert w.argmax() == 7


def test_quality_edge_cases(spark):
    d = fx.docs(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        rows = samples.labelled(d, labels, label, F.lit(True), 100, 100)
        out = module.predict(d, module.learn(rows)).collect()
        assert len(out) == d.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
        assert module.predict(d.limit(0), module.learn(rows)).count() == 0
        one = module.learn(rows.filter("y = 1"))
        assert len({r["score"] for r in module.predict(d, one).collect()}) == 1
        assert len({r["score"] for r in module.predict(d, module.learn(rows.limit(0))).collect()}) == 1


def test_folding():
    assert toxicity.folded("Stup1d IDIОT, tr­ash!") == " stupid idiot trash "  # a digit, a Cyrillic letter, an invisible hyphen
    assert toxicity.folded("ｍｏｒｏｎ 2020 l0$er") == " moron loser "
    assert toxicity.folded(None) == toxicity.folded(" 12 ") == " "


def test_matches_against_brute_force():
    model = toxicity.Model({" bad ": 2.0, " lous": 1.0, " lousy ": 3.0}, ("bad luck",))
    a = model.automaton()
    text = toxicity.folded("Bad luck, bad lousy lousier badly")
    found = toxicity.matches(text, a)
    assert [text[s:].split()[0] for s in sorted(found)] == ["bad", "lousy", "lousier"]
    assert [found[s] for s in sorted(found)] == [2.0, 3.0, 1.0]


def test_secret_candidates_and_verdicts(spark):
    secret = lambda i: f"{(i * 2654435761) % 2**32:08x}{(i * 40503 + 77) % 2**32:08x}"
    texts = [(i, f"some words before password={secret(i)} and after", "src/a.py") for i in range(60)]
    texts += [(100 + i, f"pay with card {4000000000000000 + i * 7919} or call", "docs/readme") for i in range(60)]
    texts += [(300, None, None), (301, "", "x"), (None, "token = \"0641917ea4e9feb9cda83477b57ac265\" x", None)]
    d = spark.createDataFrame([(*t, 1.0) for t in texts], "doc_id long, text string, source string, length double")
    found = secrets.candidates(d)
    rows = found.collect()
    assert len(rows) == 121 and {r["value"] for r in rows if r["id"] == 5} == {secret(5)}
    labels = found.filter("id < 30 or (id >= 100 and id < 130)").withColumn("label", (F.col("id") < 100).cast("int"))
    out = {r["id"]: r for r in secrets.find_secrets(spark, d, labels, min_docs=2).collect()}
    assert all(out[i]["is_secret"] for i in range(30, 60)) and not any(out[100 + i]["is_secret"] for i in range(30, 60))
    assert out[None]["coverage"] < 0.5 and out[40]["credential_near"] == 1 and out[140]["path_test"] == 1
    assert secrets.find_secrets(spark, d.limit(0), labels.limit(0)).count() == 0


def test_letter_pairs_of_all_documents(spark):
    """Every one of more documents than a sample held counts, the last script too."""
    texts = [None, "", "x", "İß 漢\t\n  😀z", *(f"Ab{i % 7}_q word{i}" for i in range(5000)), "zz zz"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = [re.sub("[^a-z0-9 ]", "#", re.sub(secrets.SPACE, " ", (t or "").lower())) for t in texts]
    n = collections.Counter(t[i:i + 2] for t in plain for i in range(len(t) - 1))
    total = collections.Counter(t[i] for t in plain for i in range(len(t) - 1))
    want = [math.log((n[a + b] + 0.5) / (total[a] + 20)) for a in secrets.ALPHABET for b in secrets.ALPHABET]
    assert np.allclose(secrets.transitions(d, "text"), want, rtol=0, atol=1e-12)


def test_registered_queries_are_complete():
    names = [n for n in ent.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([f"op{i}" for i in range(1, 14)] + ["pipeline"])
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert pd.Series(names).is_unique


def test_a_rare_language_keeps_its_rows(spark):
    """The bound is per language: a language of a few rows is learned beside one of very many."""
    from souk.llm.samples import at_most_each

    rows = spark.range(6000).select("id", F.when(F.col("id") < 7, "rare").otherwise("common").alias("lang"))
    got = {r["lang"]: r["count"] for r in at_most_each(rows, "lang", "id", 300).groupBy("lang").count().collect()}
    assert got["rare"] == 7 and 220 <= got["common"] <= 380
    texts = spark.createDataFrame([(i, "der die das und nicht mit " * 3, "de") for i in range(400)] + [(1000, "il gatto nero dorme sempre " * 4, "it")],
                                  "doc_id long, text string, lang string")
    assert langid.learn(texts, F.lit(True), max_rows=50).languages == ["de", "it"]
