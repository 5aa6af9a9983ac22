"""Winnowing decontamination against brute force."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from souk.llm import decontaminate as dc
from tests.llm import fixtures as fx

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(fx.lower(text))


def brute(docs, items, length=10):
    """(n_words, n_hit, sorted ids of items) of each text of ``docs``."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), length)
        for s in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(str(item))
    out = []
    for text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if got := windows.get(tuple(w[s:s + n])):
                    found |= got
                    hit |= set(range(s, s + n))
        out.append((len(w), len(hit), sorted(found)))
    return out


def check(spark, rows, items, length=10):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k1": F.lit(1), "words": F.lit("x"), "id": F.lit(0)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(3))
    got = dc.decontaminate(spark, d, b, length).collect()
    want = [(i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], items, length), strict=True)]
    assert sorted(map(str, ((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in got))) == sorted(map(str, want))
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)
    return got


def _corpus(seed, short):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "g4mma", "délta", "漢字", "e", "of", "the"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.randint(10, 30))) for k in range(12)]
    items += [(20, items[0][1].upper()), (21, items[1][1] + " " + say(5)), (21, say(14)), (22, None), (23, "... !"), (None, say(12))]
    if short:
        items += [(30 + n, say(n)) for n in range(1, 10)]
    rows = [(i, say(rng.randint(0, 40))) for i in range(40)]
    for i in range(30):
        _, t = rng.choice(items)
        w = (t or "").split()
        a = rng.randrange(len(w) + 1)
        rows.append((100 + i, say(rng.randint(0, 12)) + ", " + "-".join(w[a:a + rng.randint(5, 30)]) + "\n" + say(3)))
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(8000))
    rows += [(200, None), (201, ""), (202, "#!"), (203, long + " " + items[2][1] + " " + long), (203, items[2][1]), (203, items[2][1]),
             (None, items[3][1]), (None, items[4][1]), (None, None), (204, (items[5][1] + " ") * 40), (205, "the " * 500)]
    return rows, items


@pytest.mark.parametrize("short", [False, True])
def test_matches_brute_force(spark, short):
    rows, items = _corpus(4, short)
    got = check(spark, rows, items)
    assert any(r["contaminated"] for r in got) and not all(r["contaminated"] for r in got)


def test_joined_by_shuffle(spark, monkeypatch):
    """The same rows without any broadcast of counted sides."""
    monkeypatch.setattr(dc, "few", lambda df, limit=0: df)
    monkeypatch.setattr(dc, "FEW_ROWS", -1)
    check(spark, *_corpus(9, True))


def test_other_window_lengths(spark):
    rows, items = _corpus(2, True)
    for length in (1, 3, 13):
        check(spark, rows, items, length)


def test_empty_tables(spark):
    rows = [(1, "a b c"), (2, None)]
    check(spark, rows, [(1, None)])
    d = spark.createDataFrame([], "doc_id long, text string")
    assert dc.decontaminate(spark, d, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def _marks(w, k, n):
    """Fingerprints of a list of words by the plain definition of winnowing."""
    grams = [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
    return [grams[i:i + n] for i in range(len(grams) - n + 1)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=8), st.sampled_from([(5, 6), (2, 1), (1, 3), (3, 2)]))
def test_runs_cover_each_window_once(spark, texts, kw):
    k, w = kw
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, words array<string>")
    rows = dc.winnowed(d, k, w, "id").collect()
    for i, t in enumerate(texts):
        own = sorted(((r["s"], r["e"], r["fp"]) for r in rows if r["id"] == i))
        assert [s for a, b, _ in own for s in range(a, b)] == list(range(len(_marks(t, k, w))))
        assert all(x[2] != y[2] for x, y in zip(own, own[1:], strict=False))
    shared = {}
    for r in rows:
        for s in range(r["s"], r["e"]):
            shared.setdefault(tuple(texts[r["id"]][s:s + k + w - 1]), set()).add(r["fp"])
    assert all(len(v) == 1 for v in shared.values())  # a shared span has one fingerprint, wherever it is
