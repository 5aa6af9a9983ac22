"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from souk.llm import spelling as sp
from souk.llm.common import Scratch
from tests.llm import fixtures as fx

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def edits_one(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def counts(rows, mod=199, min_length=6, min_count=5):
    n = {}
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = fx.lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % mod == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def brute(n, factor=5):
    near = {w: [x for x in n if edits_one(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def _got(df):
    rows = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def _texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    words += [w + rng.choice("abé") for w in words] + [w[:2] + rng.choice("xyz") + w[3:] for w in words] + ["aaaaaaa", "aaaaaa", "aaaaaaaa", "ababab", "bababa"]
    words += ["z" * 30_000, "z" * 30_001, "Ü" + "z" * 29_999, "straße", "×÷×÷×÷", "漢字abcdefg"]
    return [(None if i == 3 else i // 2, " ".join(w.capitalize() if rng.random() < 0.3 else w for w in rng.choices(words, k=60) + words[-6:]))
            for i in range(24)] + [(90, None), (91, ""), (92, "12 34 ..."), (93, "Abcdefgh " * 40), (94, "abcdefg, abcdefgi1abcdefgi;" * 3), (94, "x")]


def test_matches_brute_force(spark):
    rows = _texts(1)
    d = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], "doc_id long, text string, word string, n long, run long")
    n = counts(rows, mod=7)
    got = _got(sp.groups(spark, sp.word_counts(d, slip=sp.every_nth_run_slips(7))))
    assert got == brute(n)
    assert any(v[0] for v in got.values()) and any(len(w) > 29_000 for w in got)


def test_few_symbols_and_no_broadcast(spark, monkeypatch):
    """Whatever the alphabet, no pair is lost; a crowd under one reduced word is compared whole."""
    monkeypatch.setattr(sp, "few", lambda df: df)
    rng = random.Random(8)
    n = {"".join(rng.choice("abcd") for _ in range(rng.randint(6, 8))): rng.choice([5, 30, 200, 1100]) for _ in range(400)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    for symbols in (1, 2, 16):
        assert _got(sp.groups(spark, words, symbols=symbols)) == brute(n)


def test_long_chain_of_forms(spark):
    n = {"a" * 6 + "b" * i: 5 ** (i + 1) for i in range(12)}
    got = _got(sp.groups(spark, spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n) and {v[1] for v in got.values()} == {"a" * 6 + "b" * 11}


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert sp.groups(spark, sp.word_counts(d)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=9))
def test_neighbourhood_is_whole(a):
    """All strings one edit away, and no others, by their hashes."""
    a = tuple(a)
    want = {a} | {a[:i] + a[i + 1:] for i in range(len(a))}
    want |= {a[:i] + (c,) + a[i + 1:] for i in range(len(a)) for c in (1, 2, 3)} | {a[:i] + (c,) + a[i:] for i in range(len(a) + 1) for c in (1, 2, 3)}
    got = set(np.concatenate(list(sp.neighbours(np.array(a, np.uint64), 3))).tolist())
    assert got == {sp.reduced_hash(np.array(x, np.uint64)) for x in want}


def test_pairs_come_in_both_directions_once(spark):
    n = {"abcdef": 5, "abcdeg": 6, "abcdefg": 7, "zzzzzz": 9}
    rows = [tuple(r) for r in sp.near_pairs(spark.createDataFrame(list(n.items()), "word string, n long"), 4, Scratch(spark, "t")).collect()]
    assert sorted(rows) == sorted((a, n[a], b, n[b]) for a in n for b in n if edits_one(a, b))
