"""Filter interaction audit against brute force over documents and orders."""

import itertools
import random

import pytest

from souk.llm import filter_audit as fa
from tests.llm import fixtures as fx


def _fails(rows):
    """(part, set of failed filters) of each row, by the plain definition."""
    out = []
    for r in rows:
        t = r["text"] or ""
        w = fx.WORD.findall(t)
        bad = {"A"} if len(w) < 200 else set()
        bad |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        bad |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        bad |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        bad |= {"E"} if r["doc_id"] is not None and any(
            x["doc_id"] is not None and x["doc_id"] < r["doc_id"] and (x["text"] or "") == t for x in rows) else set()
        out.append((r["source"] or "", bad))
    return out


def _brute(found, flags, filters):
    """found: (part, failed); flags: (good, toxic) of the same rows."""
    want = {}
    shap = {}
    for part in {p for p, _ in found}:
        for order in itertools.permutations(filters):
            left = [(b, g) for (p, b), g in zip(found, flags, strict=True) if p == part]
            everyone = list(left)
            for step, f in enumerate(order, 1):
                gone = [(b, g) for b, g in left if f in b]
                left = [(b, g) for b, g in left if f not in b]
                fails = sum(f in b for b, _ in everyone)
                want[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(b == {f} for b, _ in everyone),
                                                    sum(g[0] for _, g in gone), sum(g[1] for _, g in gone)]
                shap[part, f] = shap.get((part, f), 0) + len(gone)
    return {k: (*v, shap[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def _got(df):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"],
                                                       r["toxic_lost"], r["shapley"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_matches_brute_force(spark):
    base = fx.docs(spark)
    more = [(500, "A B C " * 90, "s0"), (501, "x" * 30 + " #", "s1"), (502, "A B C " * 90, None), (503, "a b " * 150, "s1"),
            (503, "a b " * 150, "s1"), (504, "a b " * 150, "s2"), (505, "É" * 300, "s2"), (None, "a b " * 150, "s2"), (506, None, None)]
    d = base.select("doc_id", "text", "source", "id", "score").unionByName(
        spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    rng = random.Random(5)
    known = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90)] + [(503, 0, 0), (503, 1, 0), (None, 1, 1), (505, 1, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = _got(fa.audit(spark, fa.mask_counts(fa.failures(d), labels)))
    rows = d.collect()
    flag = lambda i, k: int(i is not None and any(x[0] == i and x[k] == 1 for x in known))
    want = _brute(_fails(rows), [(flag(r["doc_id"], 1), flag(r["doc_id"], 2)) for r in rows], "ABCDE")
    assert got == want


@pytest.mark.parametrize("filters", ["A", "ABC", "ABCD"])
def test_any_number_of_filters(spark, filters):
    rng = random.Random(len(filters))
    found = [(rng.choice(["p", "q", ""]), {f for f in filters if rng.random() < 0.4}) for _ in range(80)]
    flags = [(rng.random() < 0.5, rng.random() < 0.3) for _ in found]
    rows = [(p, sum(1 << filters.index(f) for f in b), 1, int(g), int(t)) for (p, b), (g, t) in zip(found, flags, strict=True)]
    counts = spark.createDataFrame(rows, "part string, mask int, n long, good long, toxic long").groupBy("part", "mask").sum("n", "good", "toxic")
    assert _got(fa.audit(spark, counts.toDF("part", "mask", "n", "good", "toxic"), filters)) == _brute(found, flags, filters)


def test_intervals_cover_each_order_once():
    seen = {}
    for mask, step, a, b in fa.removal_intervals("ABCDE"):
        for rank in range(a, b):
            assert (mask, rank) not in seen
            seen[mask, rank] = step
    for rank, order in enumerate(fa.orders("ABCDE")):
        for mask in range(1, 32):
            assert seen[mask, rank] == next(i for i, f in enumerate(order, 1) if mask >> "ABCDE".index(f) & 1)


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(spark, fa.mask_counts(fa.failures(d), labels)).count() == 0
