"""Near-duplicate documents by MinHash.

1. ``signatures``: the distinct k-word shingles of a text (64-bit hashes), the
   minima of ``bands * rows`` universal hash functions over them, a digest of
   the set.
2. Documents with equal sets are one class, represented by the smallest id;
   only representatives go on.
3. Banding: representatives with an equal band share a bucket.  Each member of
   a bucket is paired with the bucket's smallest id (a star, not all pairs).
4. Verification: pairs whose signatures agree too rarely are dropped (five
   standard errors below the threshold: 1.4 of 10^6 at similarity 0.8, by the
   exact binomial tail of 160 minima); the rest are confirmed on the full
   shingle sets, read again from the texts.
5. Components of the confirmed links by alternating large-star / small-star.
6. A star misses a link between two members when one of them is not like the
   smallest id.  So each bucket whose other members are in several components
   has a heaviest one, and its members outside that ask it: is this document
   like any member of that component, on full sets?  First every document asks
   the heaviest of its components only, which joins most of a large group;
   then, with the components as they are, all those of its buckets.  What is
   left of a bucket outside its heaviest component is compared with itself, on
   signatures and then on full sets, in blocks inside tasks; a task emits no
   more links than it has members.  After that every two members of a bucket
   are in one component or have been compared.  A link is lost only if its two
   documents share no band, with 32 bands of 5 rows in 3 of 10^6 cases at
   similarity 0.8, or by the signatures; both get rarer above.

Defined cases: null and empty texts and texts without words have no shingle
and are linked with nothing; a text with fewer words than k has one shingle,
its whole sequence; repeated rows of an id are one document with the union of
what they link to, but each gives a row; rows with a null id are linked with
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import Scratch, few, hash_words, lowered, mix, not_space, shingles, slices, text_buffer, trimmed
from souk.llm.components import components

#: Members of a bucket or family whose sets one task holds with as many others.
SETS = 256
#: Members of a component, and documents to compare with it, that one task holds.
MEMBERS = 512
SIGNED = "id long, n_shingles long, d1 long, d2 long, signature binary, bands array<long>"


def _universal(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift functions h(x) = (a x + b mod 2^64) >> 32 with odd a."""
    i = np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    r = mix(i + np.uint64(20240607))
    return r[:count] | np.uint64(1), r[count:]


def minima(x: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The (rows, count) minima of each non-empty row's shingles (uint32)."""
    a, b = _universal(count)
    full = np.flatnonzero(off[1:] > off[:-1])
    out = np.empty((len(full), count), np.uint32)
    at = off[full]
    y = np.empty_like(x)
    for j in range(count):
        np.multiply(x, a[j], out=y)
        y += b[j]
        out[:, j] = np.minimum.reduceat(y, at) >> np.uint64(32)
    return out


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, off = text_buffer(texts)
    h, rows, _ = hash_words(lowered(data), off, not_space(data))
    return shingles(h, rows, len(texts), k)


def signatures(docs: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    salt = (np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1)):
                part = b.slice(i, j - i)
                x, off = shingle_sets(part.column(1), k)
                n = np.diff(off)
                full = np.flatnonzero(n)
                d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                sig: list[bytes | None] = [None] * len(n)
                keys: list[np.ndarray | None] = [None] * len(n)
                if len(full):
                    d1[full] = np.add.reduceat(x, off[full])
                    d2[full] = np.add.reduceat(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)), off[full])
                    m = minima(x, off, bands * rows)
                    key = np.zeros((len(full), bands), np.uint64) + salt
                    for r in range(rows):
                        key = mix((key ^ m[:, r::rows].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1))
                    short = (m & np.uint32(0xFFFF)).astype("<u2")
                    for at, row in enumerate(full):
                        sig[row], keys[row] = short[at].tobytes(), key[at].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                     pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "n_shingles", "d1", "d2", "signature", "bands"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(trimmed(run), SIGNED)


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1)):
                part = b.slice(i, j - i)
                x, off = shingle_sets(part.column(1), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x.view(np.int64)))],
                    names=["id", "shingles"])

    return docs.mapInArrow(trimmed(run), "id long, shingles array<long>")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<u2") for x in col.to_pylist()])


def signature_floor(percent: int, count: int) -> float:
    """The share of ``count`` minima in which a pair must agree to be looked at:
    five standard errors below the threshold, so that less is lost than by the bands."""
    share = percent / 100
    return share - 5 * (share * (1 - share) / count) ** 0.5


def signature_filter(pairs: DataFrame, reps: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in a share of at least ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = (_matrix(b.column("sa")) == _matrix(b.column("sb"))).mean(axis=1) >= floor
                yield b.select(["a", "b"]).filter(pa.array(same))

    s = reps.select("id", "signature")
    both = (pairs.join(s.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
            .join(s.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a"))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def like(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y| of two sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links that connect what the pairs with 100 * |A and B| >= percent * |A or B|
    (on the full shingle sets) connect.  pairs: kept; docs: (id, text).

    pairs (a, b) lead from a center a.  They are dealt by their family (the
    component of the pairs' graph) and blocks of its b's, so a set is sent to one
    block, and a center's to those that look at it.
    """
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    sets = scratch.keep(sets_of(docs.join(few(ids), "id", "left_semi").select("id", "text"), k), "sets")
    family = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    blocks = family.groupBy("root").agg(F.ceil(F.count("*") / SETS).cast("int").alias("blocks"))
    place = family.join(blocks, "root").select(F.col("id").alias("b"), "root", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("i"))
    p = scratch.keep(pairs.join(place, "b").select("root", "i", "a", "b"), "dealt-pairs")
    need = p.select(F.col("root").alias("r"), F.col("i").alias("bi"), F.explode(F.array("a", "b")).alias("id")).distinct().join(sets, "id")

    def run(left, right):
        ids, off = right.column("id").to_numpy(), np.concatenate(([0], np.cumsum(np.diff(right.column("shingles").combine_chunks().offsets))))
        values = right.column("shingles").combine_chunks().flatten().to_numpy()
        at = {int(d): n for n, d in enumerate(ids)}
        near = list(range(len(ids)))

        def root(v):
            while near[v] != v:
                near[v] = near[near[v]]
                v = near[v]
            return v

        found = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
            if a not in at or b not in at:
                continue
            u, v = at[a], at[b]
            if root(u) == root(v):
                continue
            if like(values[off[u]:off[u + 1]], values[off[v]:off[v + 1]], percent):
                near[root(u)] = root(v)
                found.append((a, b))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return p.groupBy("root", "i").cogroup(need.groupBy("r", "bi")).applyInArrow(run, "a long, b long")


def among(members: DataFrame, reps: DataFrame, sets: DataFrame, floor: float, percent: int, parts: int) -> DataFrame:
    """members: kept (key, id, root).  Links (a, b) that connect what like members
    of one key and different roots connect; at most as many from a task as it has members."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / SETS).cast("int").alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    m = members.join(sizes.filter("lo != hi").select("key", "blocks"), "key")
    m = m.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a member goes to each pair of its block with another: to one group if the key is one block
    turn = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = m.select("key", "id", "root", "block", turn).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "root")
    dealt = dealt.join(reps.select("id", "signature").join(sets, "id"), "id")

    def run(keys, table):
        i, j = keys[1].as_py(), keys[2].as_py()
        block, ids, root = (table.column(c).to_numpy() for c in ("block", "id", "root"))
        sig = _matrix(table.column("signature").combine_chunks())
        held = table.column("shingles").combine_chunks()
        off, values = held.offsets.to_numpy() - held.offsets[0].as_py(), held.flatten().to_numpy()
        near = {int(r): int(r) for r in root}

        def top(v):
            while near[v] != v:
                near[v] = near[near[v]]
                v = near[v]
            return v

        left, right, found = np.flatnonzero(block == i), np.flatnonzero(block == j), []
        for u in left:
            v = right[(right > u) & (root[right] != root[u])] if i == j else right[root[right] != root[u]]
            for w in v[(sig[v] == sig[u]).mean(axis=1) >= floor]:
                a, b = top(int(root[u])), top(int(root[w]))
                if a != b and like(values[off[u]:off[u + 1]], values[off[w]:off[w + 1]], percent):
                    near[a] = b
                    found.append((int(ids[u]), int(ids[w])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    # the work of a group grows with its square, not with its bytes: keep the tasks apart
    return dealt.repartition(parts, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def members_of(asked: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of all members of the components that are asked, kept."""
    wanted = asked.select("root").distinct()
    linked = roots.join(wanted, "root", "left_semi").select("id", "root")
    return scratch.keep(linked.unionByName(wanted.select(F.col("root").alias("id"), "root")).distinct(), "asked-members")


def answer(asked: DataFrame, members: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """asked: kept (id, root).  The requests whose document is like some member
    of that component, on full sets, as links (a, b) = (id, root).

    Members and requests of a component are dealt to blocks of at most about
    MEMBERS of each, one task group per pair of blocks.
    """
    size = (members.groupBy("root").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("mb"))
            .join(asked.groupBy("root").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("qb")), "root"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    m = members.join(size, "root").select("root", place("mb").alias("i"), every("qb").alias("j"), "id").join(sets, "id")
    q = asked.join(size, "root").select(F.col("root").alias("r"), place("qb").alias("qj"), every("mb").alias("qi"), "id").join(sets, "id")
    q = q.select("r", "qi", "qj", F.col("id").alias("doc"), F.col("shingles").alias("asked"))

    def run(left, right):
        xs, ids = left.column("asked").combine_chunks(), left.column("doc").to_pylist()
        sets = right.column("shingles").combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        values, owner = sets.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        at, off = xs.flatten().to_numpy(), xs.offsets.to_numpy() - xs.offsets[0].as_py()
        found = []
        for d, s, e in zip(ids, off[:-1], off[1:], strict=True):
            x = at[s:e]
            lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
            n = hi - lo
            hits = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            common = np.bincount(owner[hits], minlength=len(size))
            if (100 * common >= percent * (len(x) + size - common)).any():
                found.append(d)
        root = left.column("r")[0] if left.num_rows else None
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([root.as_py()] * len(found) if root else [], pa.int64())})

    groups = q.repartition(parts, "r", "qi", "qj").groupBy("r", "qi", "qj").cogroup(m.repartition(parts, "root", "i", "j").groupBy("root", "i", "j"))
    return groups.applyInArrow(run, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component (smallest id
    reachable by links), kept (the row is its component's)."""
    scratch = Scratch(spark, "minhash")
    signed = scratch.keep(signatures(docs, k, bands, rows, id_col, text_col), "signatures")
    some = signed.filter("n_shingles > 0 and id is not null")  # the others are linked with nothing
    classes = scratch.keep(some.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep")), "classes")
    reps = some.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    reps = scratch.keep(reps.select("id", "signature", "bands"), "representatives")

    floor = signature_floor(percent, bands * rows)
    in_bucket = reps.select("id", F.posexplode("bands").alias("band", "key"))
    least = in_bucket.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("n")).filter("n > 1")
    centers = scratch.keep(least.select("key", "center"), "centers")
    buckets = scratch.keep(in_bucket.join(few(centers), "key"), "buckets")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    inner = buckets.filter("id != center")
    stars = inner.select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    close = scratch.keep(signature_filter(stars, reps, floor), "star-pairs")
    links = scratch.keep(confirm(close, texts, k, percent, scratch), "star-links")

    open_ = inner.select("key", "id")  # a bucket's pairs with its center are decided
    for last in (False, True):
        roots = scratch.keep(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch), "components")
        sized = roots.join(roots.groupBy("root").agg(F.count("*").alias("weight")), "root")
        placed = open_.join(sized, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"), F.coalesce("weight", F.lit(1)).alias("weight"))
        heavy = F.min(F.struct((-F.col("weight")).alias("w"), F.col("root").alias("root"))).alias("heavy")
        mixed = placed.groupBy("key").agg(heavy, F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key", "heavy")
        placed = scratch.keep(placed.join(mixed, "key"), "mixed")
        open_ = placed.select("key", "id")
        others = placed.filter("root != heavy.root")
        if last:
            asked = others.select("id", "heavy.root").distinct()
        else:
            asked = others.groupBy("id").agg(F.min("heavy").alias("heavy")).select("id", "heavy.root")
        asked = scratch.keep(asked, "requests")
        members = members_of(asked, roots, scratch)
        ids = scratch.keep(members.select("id").unionByName(asked.select("id")).distinct(), "asked-ids")
        sets = scratch.keep(sets_of(texts.join(few(ids), "id", "left_semi").select("id", "text"), k), "asked-sets")
        more = answer(asked, members, sets, percent, parts)
        if last:
            more = more.unionByName(among(others.select("key", "id", "root"), reps, sets, floor, percent, parts))
        links = links.unionByName(scratch.keep(more, "more-links"))
    # rows of one id with different texts are in several classes: they are one document
    same_id = some.join(classes, ["d1", "d2", "n_shingles"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).filter("a != b")
    all_links = links.unionByName(same_id)
    roots = scratch.keep(components(all_links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch), "roots")
    return signed.select("id", "n_shingles").join(roots, "id", "left").select(
        "id", "n_shingles", F.coalesce("root", "id").alias("component"),
        F.coalesce(F.col("id") == F.coalesce("root", "id"), F.lit(True)).alias("kept"))
