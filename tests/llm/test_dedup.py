"""Exact, MinHash and embedding deduplication against brute force."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from souk.llm import components, embedding_dedup, exact_dedup, minhash
from souk.llm.common import Scratch
from tests.llm import fixtures as fx


def _exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(fx.lower(r["text"]), []).append(r["doc_id"])
    return groups


def test_exact_matches_brute_force(spark):
    d = fx.docs(spark)
    rows = d.collect()
    groups = _exact(rows)
    got = exact_dedup.dedup(spark, d).collect()
    assert len(got) == len(rows)
    want = sorted((str(r["doc_id"]), str(max((i for i in groups[fx.lower(r["text"])] if i is not None), default=None)),
                   len(groups[fx.lower(r["text"])]), hashlib.sha256(fx.lower(r["text"]).encode()).hexdigest()) for r in rows)
    assert sorted((str(r["id"]), str(r["keep_id"]), r["group_size"], r["digest"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)  # one row of each group, also among repeated rows


def test_exact_keep_rows(spark):
    d = fx.docs(spark)
    kept = exact_dedup.keep_rows(spark, d).collect()
    assert kept[0].__fields__ == d.columns
    assert len(kept) == len({fx.lower(r["text"]) for r in kept}) == len(_exact(d.collect()))


def test_exact_checks_full_bytes(spark):
    """Different texts under one weak digest stay apart."""
    d = fx.docs(spark).dropDuplicates(["doc_id"]).filter("doc_id is not null")
    weak = lambda c: F.lpad((F.length(F.coalesce(c, F.lit(""))) % 7).cast("string"), 4, "0")
    got = {r["id"]: r for r in exact_dedup.dedup(spark, d, digest=weak).collect()}
    groups = _exact(d.collect())
    for ids in groups.values():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))


def test_exact_repeated_ids_with_different_texts(spark):
    rows = [(5, "a"), (5, "b"), (6, "A"), (None, "a"), (None, "c"), (None, "d"), (7, "d"), (8, None), (8, "e"), (None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {}
    for i, t in rows:
        groups.setdefault(fx.lower(t), []).append(i)
    got = exact_dedup.dedup(spark, d).collect()
    want = [(i, hashlib.sha256(fx.lower(t).encode()).hexdigest(), max((x for x in groups[fx.lower(t)] if x is not None), default=None),
             len(groups[fx.lower(t)])) for i, t in rows]
    assert sorted(map(str, want)) == sorted(str((r["id"], r["digest"], r["keep_id"], r["group_size"])) for r in got)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.keep_rows(spark, d).collect()
    assert sorted(str(tuple(r)) for r in kept) == sorted(map(str, [(5, "b"), (6, "A"), (None, "c"), (7, "d"), (8, None), (8, "e")]))


def test_exact_stream_goes_on_from_its_state(spark, tmp_path):
    schema = "id long, digest string, n_bytes int"
    path, state = str(tmp_path / "fp"), str(tmp_path / "state")
    scratch = Scratch(spark, "test")
    for part in ([(1, "a", 1), (2, "b", 1)], [(3, "a", 1), (0, "a", 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        out = exact_dedup.group_stream(spark, path, spark.read.parquet(path).schema, scratch, 1, state)
    assert sorted((r["digest"], r["n"], r["top"]["id"]) for r in out.collect()) == [("a", 3, 3), ("b", 1, 2)]


@pytest.mark.parametrize("make", ["exact", "minhash"])
def test_empty_tables(spark, make):
    d = fx.docs(spark).limit(0)
    out = exact_dedup.dedup(spark, d) if make == "exact" else minhash.near_duplicates(spark, d)
    assert out.count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_matches_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(minhash, "SETS", 3)
    monkeypatch.setattr(minhash, "MEMBERS", 3)
    d = fx.docs(spark)
    rows = [r for r in d.collect() if r["doc_id"] is not None]
    sets = {(r["doc_id"], r["text"]): fx.shingle_set(r["text"], k) for r in rows}
    pairs = [(a[0], b[0]) for (a, x), (b, y) in itertools.combinations(sets.items(), 2)
             if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    want = fx.components({r["doc_id"] for r in rows}, pairs)
    assert len(set(want.values())) < len(want) - 5
    got = minhash.near_duplicates(spark, d, k=k).collect()
    assert len(got) == d.count()
    for r in got:
        if r["id"] is None:
            assert r["kept"] and r["component"] is None
        else:
            assert (r["component"], r["kept"]) == (want[r["id"]], want[r["id"]] == r["id"])
    by = {r["doc_id"]: len(sets[(r["doc_id"], r["text"])]) for r in rows}
    assert all(r["n_shingles"] == by[r["id"]] for r in got if r["id"] is not None)


def test_signature_floor_loses_less_than_the_bands():
    lost = sum(math.comb(160, i) * 0.8 ** i * 0.2 ** (160 - i) for i in range(160) if i / 160 < minhash.signature_floor(80, 160))
    assert lost < (1 - 0.8 ** 5) ** 32


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(201, 202), (202, 203), (203, 201), (300, 300)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "cc")).collect()}
    want = fx.components({x for e in edges for x in e}, edges)
    want.pop(300)  # an edge to itself links nothing
    assert got == want


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((12, 16))
    vecs = [c + rng.standard_normal(16) * s for c in centers for s in (0.0, 0.0, 0.1, 0.2, 0.3, 0.35, 0.4)]
    rows = [(i, [float(np.float32(v)) for v in x], "label") for i, x in enumerate(vecs)]
    n = len(rows)
    rows += [(n, None, "a"), (n + 1, [0.0] * 16, "a"), (n + 2, [1.0] * 15 + [None], "a"), (n + 3, [math.inf] * 16, "a"),
             (n + 4, [math.nan] * 16, "a"), (n + 5, [], "a"), (n + 6, [2.0, 1.0], "a"), (n + 7, [4.0, 2.0], "a"), (None, rows[0][1], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string")
    good = {i: np.array(x, np.float64) for i, x, _ in rows[:n] + rows[n + 6:n + 8]}
    pairs = [(a, b) for a, b in itertools.combinations(good, 2) if len(good[a]) == len(good[b])
             and good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b])) >= 0.9]
    want = fx.components({i for i, *_ in rows if i is not None}, pairs)
    got = {r["id"]: r for r in embedding_dedup.near_duplicates(spark, df, bucket=8, recall=0.99999).collect()}
    assert len(got) == len(rows) and len(pairs) > 50
    for i, r in got.items():
        assert r["n_links"] == sum(i in p for p in pairs)
        if i is not None:
            assert (r["component"], r["kept"]) == (want[i], want[i] == i)
    assert embedding_dedup.near_duplicates(spark, df.limit(0)).count() == 0


def test_plan_keeps_its_recall():
    for n in (100, 10_000, 10_000_000):
        bits, tables = embedding_dedup.plan(n, 0.9, 0.99, 512)
        assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables >= 0.99


def test_requests_grow_with_the_group(spark, monkeypatch):
    """One large group of near copies: what is asked and emitted follows its size, not its square."""
    made = {}

    def keep(self, df, name, plain=Scratch.keep):
        out = plain(self, df, name)
        made[name] = made.get(name, 0) + (out.count() if name in ("requests", "more-links") else 0)
        return out

    monkeypatch.setattr(Scratch, "keep", keep)
    rng = random.Random(11)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    seen = {}
    for n in (250, 500):
        made.clear()
        got = minhash.near_duplicates(spark, spark.createDataFrame(rows[:n], "doc_id long, text string"), k=5).collect()
        sets = {i: fx.shingle_set(t, 5) for i, t in rows[:n]}
        pairs = [(a, b) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if 100 * len(x & y) >= 80 * len(x | y)]
        assert {r["id"]: r["component"] for r in got} == fx.components(sets, pairs)
        seen[n] = dict(made)
    assert seen[250]["requests"] > 0
    assert all(seen[n][x] <= 2 * n for n in seen for x in ("requests", "more-links"))
    assert seen[500]["requests"] <= 3 * seen[250]["requests"] + 20
