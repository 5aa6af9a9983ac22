"""Near-duplicate embeddings by random-hyperplane sign hashing.

1. Equal vectors are one class, represented by the smallest id.
2. Each of several tables gives a class the signs of its products with ``bits``
   random hyperplanes as a bucket.  ``bits`` grows with the logarithm of the
   number of classes, so that a bucket of unrelated vectors holds about
   ``bucket`` of them; the number of tables is what the wanted recall at the
   threshold then takes: a pair at angle t shares a bucket of one table with
   probability (1 - t / pi)^bits.
3. Inside a bucket all cosines are computed in double precision, in blocks of
   at most ``BLOCK`` members a side: a larger bucket is dealt to one task per
   pair of blocks.  A pair that shares buckets of several tables counts in the
   first one.  Tasks emit one row per linked member (its number of links and
   one neighbour of its group), never the pairs.
4. Links are summed per class; components by alternating large-star / small-star.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component are linked with nothing, as are rows with a null id; vectors of
different length are never compared; repeated rows count as vectors of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import Scratch
from souk.llm.components import components

BLOCK = 2048


def plan(n: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = min(48, max(4, math.ceil(math.log2(max(n, 1) / bucket))) if n > bucket else 4)
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def _vectors(vecs: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): vec as the bytes of its doubles, null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = []
            for row in b.column(1):
                values = row.values if row.is_valid else None
                if values is None or not len(values) or values.null_count:
                    out.append(None)
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    return vecs.select(F.col(id_col).cast("long"), F.col(vec_col)).mapInArrow(run, "id long, vec binary")


def _codes(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(id, vec, m, dim, codes): the bucket in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.int64(1) << np.arange(bits, dtype=np.int64)
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            raw = b.column("vec").to_pylist()
            dims = np.array([len(x) // 8 for x in raw], np.int64)
            codes = np.zeros((len(raw), tables), np.int64)
            for dim in np.unique(dims):
                if int(dim) not in planes:
                    planes[int(dim)] = _planes(int(dim), bits, tables, seed)
                at = np.flatnonzero(dims == dim)
                x = np.stack([np.frombuffer(raw[i], np.float64) for i in at])
                signs = (x / np.abs(x).max(axis=1, keepdims=True)) @ planes[int(dim)] > 0
                codes[at] = signs.reshape(len(at), tables, bits) @ weight
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("vec"), b.column("m"), pa.array(dims), pa.array(list(codes), pa.list_(pa.int64()))],
                names=["id", "vec", "m", "dim", "codes"])

    return classes.select("id", "vec", "m").mapInArrow(run, "id long, vec binary, m long, dim long, codes array<long>")


def _compare(table: int, x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows of x and y that no earlier table has brought together."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    a, b = np.nonzero((x @ y.T) / (nx[:, None] * ny[None, :]) >= threshold)
    if table and len(a):
        new = np.ones(len(a), bool)
        for s in range(0, len(a), 1 << 18):  # pairs at a time
            part = slice(s, s + (1 << 18))
            new[part] = ~(cx[a[part], :table] == cy[b[part], :table]).any(axis=1)
        a, b = a[new], b[new]
    return a, b


def links(coded: DataFrame, threshold: float) -> DataFrame:
    """(id, near, n): a class linked inside one bucket (or pair of blocks), one
    class of its group there, and how many vectors it is linked with there."""
    placed = coded.select("id", "vec", "m", "dim", "codes", F.posexplode("codes").alias("table", "code"))
    size = placed.groupBy("dim", "table", "code").agg(F.count("*").alias("size")).filter("size > 1")
    p = placed.join(size, ["dim", "table", "code"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    p = p.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "table"), F.col("blocks")).cast("int"))
    turn = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = p.select("dim", "table", "code", "id", "vec", "m", "codes", "block", turn).select(
        "dim", "table", "code", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "id", "vec", "m", "codes")

    def run(key, rows):
        table, i, j = key[1].as_py(), key[3].as_py(), key[4].as_py()
        dim = key[0].as_py()
        ids, m, block = (rows.column(c).to_numpy() for c in ("id", "m", "block"))
        x = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float64).reshape(-1, dim)
        codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        n, near = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def root(v):
            while near[v] != v:
                near[v] = near[near[v]]
                v = near[v]
            return v

        for s in range(0, len(left), 512):
            rows_l = left[s: s + 512]
            a, b = _compare(table, x[rows_l], x[right], codes[rows_l], codes[right], threshold)
            a, b = rows_l[a], right[b]
            if i == j:
                once = a < b
                a, b = a[once], b[once]
            np.add.at(n, a, m[b])
            np.add.at(n, b, m[a])
            # a spanning forest: for each row only its first partner and partners not reached yet
            for u, v in zip(a.tolist(), b.tolist(), strict=True):
                if near[u] != near[v] or near[u] == u:
                    ru, rv = root(u), root(v)
                    if ru != rv:
                        lo, hi = (ru, rv) if ids[ru] < ids[rv] else (rv, ru)
                        near[hi] = lo
        at = np.flatnonzero(n)
        return pa.table({"id": ids[at], "near": ids[[root(v) for v in at]] if len(at) else ids[:0], "n": n[at]})

    return dealt.groupBy("dim", "table", "code", "i", "j").applyInArrow(run, "id long, near long, n long")


def near_duplicates(spark: SparkSession, vecs: DataFrame, threshold: float = 0.9, recall: float = 0.999, bucket: int = 512,
                    seed: int = 23, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vecs``: id, n_links, component, kept."""
    scratch = Scratch(spark, "embedding")
    rows = scratch.keep(_vectors(vecs, id_col, vec_col), "vectors")
    good = rows.filter("vec is not null and id is not null")
    classes = scratch.keep(good.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("m")), "classes")
    bits, tables = plan(classes.count(), threshold, recall, bucket)
    coded = scratch.keep(_codes(classes, bits, tables, seed), "codes")
    found = scratch.keep(links(coded, threshold), "links")
    member = good.join(classes.select("vec", F.col("id").alias("rep"), "m"), "vec").select("id", "rep", "m")
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    edges = found.select(F.col("id").alias("u"), F.col("near").alias("v")).unionByName(
        member.select(F.col("id").alias("u"), F.col("rep").alias("v")))
    roots = scratch.keep(components(edges, scratch), "roots")
    linked = (member.join(counts, "rep", "left").join(roots, "id", "left")
              .select("id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "id").alias("component")))
    alone = rows.filter("vec is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), "id")
    out = linked.unionByName(alone.toDF("id", "n_links", "component"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
