"""Small documents with the awkward cases, and brute-force versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs(spark, n=60, seed=3):
    """Documents with null and empty texts, null sources, copies, near copies, a
    very long text, repeated rows and columns whose names operators use."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60)))
        rows.append((i, text, "en", f"s{i % 4}"))
    base = " ".join(rng.choice(vocab) for _ in range(80))
    for i in range(12):  # a family of near copies, some of which are only like each other
        words = base.split()
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((n + i, " ".join(words), "en", "s0"))
    rows += [(n + 20, rows[3][1].upper(), "en", "s1"), (n + 21, rows[3][1], "en", None), (n + 22, None, "en", "s1"),
             (n + 23, "", "en", "s2"), (n + 24, "  \t\n ", None, None), (n + 25, "Word", "en", "s2"), (n + 26, "word", "en", "s2"),
             (n + 27, " ".join(rng.choice(vocab) for _ in range(9000)), "en", "s3"), (n + 28, "é ñ 漢字 ß ÉÉ", "fr", "s3"),
             (n + 29, "12345 67 !!!", None, "s3"), (None, "no id here", "en", "s3"), (5, rows[5][1], "en", "s1")]
    rows = [(*r, len(r[1] or ""), r[0], 0.5, True, "x", 7) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "id long, score double, kept boolean, digest string, size long")


def shingle_set(text, k):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(ids, linked):
    """Smallest reachable id by brute force over a list of pairs."""
    near = {i: i for i in ids}

    def root(x):
        while near[x] != x:
            x = near[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        near[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
