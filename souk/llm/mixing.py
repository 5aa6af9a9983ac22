"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame operations only.

1. ``targets``: sources in code point order (null last) weigh 1, 2, 3, 1, 2, ...
   (``weights``, repeated) and share the words of all documents; no source gets
   more than ``cap`` times its words, the excess is shared again by weight.
   In closed form: the water level is the largest of the levels found when the
   sources are capped one after the other, smallest cap per weight first.
2. ``passes``: a source's target is so many whole passes over its documents and
   a part of one more.  Each pass puts the documents in an order of its own, by
   a hash; in the last one each document is taken that still fits the target.
   The documents up to the first that does not fit are found by descending twice
   through 4,096 hash ranges and then through the rows of one range, with sums
   taken before each shuffle; then the same again among those behind it that
   fit what is missing, until no document of the source does.
3. Blocks are hash ranges of a pass, of about ``block_words`` words.  A source's
   quota is its number of blocks; block numbers are permuted by multiplication
   with a prime modulo the quota.
4. ``split_tree``: all quotas start at the root; a node over shards [lo, hi)
   gives its left half a multivariate-hypergeometric draw of exactly the blocks
   that half must hold, source by source, from the inverse distribution and a
   hash of the node as the random number; until each shard has its quotas.
5. Shards take disjoint runs of each source's permuted blocks, and order their
   documents by a hash.

Defined cases: null and blank texts have no words and are never taken, nor is
anything of a source without words; a null source is a source; rows that repeat
an id and a size share their place in every order and are taken together; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.llm.common import Scratch, few

WORD = r"[^\x20\x09-\x0D]+"
#: Larger than any quota, so it has no common factor with one.
PRIME = 2_147_483_647
#: Sources whose table is broadcast; with more of them it is joined by shuffle.
FEW = 50_000
#: The largest order key.
LAST = (1 << 63) - 1
_TOP = float(1 << 63)


def words(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sizes: (source, size).  Returns (sid, source, source_size, target)."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")
    s = total.withColumn("sid", place).withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    everything = Window.partitionBy()
    earlier = Window.orderBy(F.col("most") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    free = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    s = s.withColumn("level", free / weight).withColumn("level", F.max("level").over(everything))
    return s.select("sid", "source", "source_size", F.least("most", F.col("level") * F.col("w")).alias("target"))


def order_key(copy: Column, seed: int) -> Column:
    """Place of a row in the order of a pass: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string"), F.col("size"), copy, F.lit(seed)), 1)


def _boundary(sums: DataFrame) -> DataFrame:
    """sums: (sid, at, base, rest, n): the first ``at`` where base + running n reaches rest, and the words before it."""
    run = Window.partitionBy("sid").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    r = sums.withColumn("until", F.col("base") + F.sum("n").over(run)).filter("until >= rest")
    return (r.groupBy("sid").agg(F.min(F.struct("at", (F.col("until") - F.col("n")).alias("base"), "rest")).alias("b"))
            .select("sid", "b.at", "b.base", "b.rest"))


def _cut(r: DataFrame, near) -> DataFrame:
    """r: (sid, key, size, rest).  For each sid, by key: the rows up to ``cut`` fit
    ``rest`` together and leave ``gap`` of it; the row at ``stop`` does not fit any more."""
    ranges = r.groupBy("sid", F.shiftright("key", 51).alias("at"), "rest").agg(F.sum("size").alias("n"), F.max("key").alias("end"))
    first = _boundary(ranges.withColumn("base", F.lit(0).cast("long")))
    one = r.join(near(first.select("sid", F.col("at").alias("at1"), "base")), "sid").filter(F.shiftright("key", 51) == F.col("at1"))
    second = _boundary(one.groupBy("sid", F.shiftright("key", 39).alias("at"), "rest", "base").agg(F.sum("size").alias("n")))
    two = r.drop("rest").join(near(second), "sid").filter(F.shiftright("key", 39) == F.col("at"))
    run = Window.partitionBy("sid").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ends = (two.groupBy("sid", "key", "at", "base", "rest").agg(F.sum("size").alias("n"))
            .withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(run), F.lit(0)))
            .withColumn("take", F.col("before") + F.col("n") <= F.col("rest")))
    cuts = ends.groupBy("sid").agg(F.coalesce(F.max(F.when(F.col("take"), F.col("key"))), F.shiftleft(F.max("at"), 39) - 1).alias("cut"),
                                   F.coalesce(F.min(F.when(~F.col("take"), F.col("key"))), F.lit(LAST)).alias("stop"),
                                   F.max(F.when(F.col("take"), F.col("before") + F.col("n")).otherwise(F.col("base"))).alias("used"))
    # where all rows together do not reach the rest, there is no boundary: all are taken
    whole = ranges.groupBy("sid", "rest").agg(F.sum("n").alias("all"), F.max("end").alias("end"))
    return whole.join(near(cuts), "sid", "left").select(
        "sid", F.coalesce("cut", "end").alias("cut"), F.coalesce("stop", F.lit(LAST)).alias("stop"),
        (F.col("rest") - F.coalesce("used", "all")).alias("gap"))


def passes(rows: DataFrame, sources: DataFrame, seed: int, near, scratch: Scratch) -> DataFrame:
    """sources with ``full`` (whole passes) and ``steps`` of the last pass: it takes
    the rows with an order key beyond ``lo`` up to ``hi`` that have a ``unit`` (the
    words of the rows at one place) of at most ``fit``, for each step."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    s = sources.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    open_ = s.filter("rest > 0 and source_size > 0").select("sid", "full", "rest")
    r = rows.join(near(open_), "sid").withColumn("key", order_key(F.col("full"), seed)).select("sid", "key", "size", "unit", "rest")
    step = lambda lo, hi, fit: F.array(F.struct(lo.alias("lo"), hi.alias("hi"), fit.cast("double").alias("fit")))
    state = scratch.keep(_cut(r, near).select("sid", "stop", "gap", step(F.lit(-1).cast("long"), F.col("cut"), F.lit(math.inf)).alias("steps")), "cuts")
    # a row that does not fit never will, so each round has fewer rows, and each takes or drops some
    fits = (F.col("size") > 0) & (F.col("key") > F.col("stop")) & (F.col("unit") <= F.col("gap"))
    beyond = r.drop("rest")
    while True:
        beyond = scratch.keep(beyond.join(near(state.select("sid", "stop", "gap")), "sid").filter(fits).select(
            "sid", "key", "size", "unit", F.col("gap").alias("rest")), "beyond")
        if beyond.isEmpty():
            break
        found = _cut(beyond, near).select("sid", "cut", F.col("stop").alias("next_stop"), F.col("gap").alias("next_gap"))
        more = F.when(F.col("cut").isNull(), F.col("steps")).otherwise(F.concat("steps", step(F.col("stop"), F.col("cut"), F.col("gap"))))
        state = scratch.keep(state.join(near(found), "sid", "left").select(
            "sid", F.coalesce("next_stop", "stop").alias("stop"), F.coalesce("next_gap", "gap").alias("gap"), more.alias("steps")), "cuts")
        beyond = beyond.drop("rest")
    return s.drop("rest").join(state.select("sid", "steps"), "sid", "left")


def _units(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with ``unit``: the words of the rows of the source that repeat the id and the size, which are taken together."""
    again = scratch.keep(rows.filter("size > 0").groupBy("sid", "id", "size").agg(F.count("*").alias("n")).filter("n > 1"), "repeats")
    if again.isEmpty():
        return rows.withColumn("unit", F.col("size"))
    a = few(again.select(F.col("sid").alias("rs"), F.col("id").alias("ri"), F.col("size").alias("rz"), "n"))
    same = (F.col("sid") == F.col("rs")) & (F.col("size") == F.col("rz")) & F.col("id").eqNullSafe(F.col("ri"))
    return rows.join(a, same, "left").withColumn("unit", F.col("size") * F.coalesce("n", F.lit(1))).drop("rs", "ri", "rz", "n")


def _draw(k: Column, total: Column, n: Column, u: Column) -> Column:
    """How many of n blocks, drawn without replacement from ``total``, are of a
    kind that has k: the inverse of the hypergeometric distribution at u, over
    all counts within ten standard deviations (beyond: under 1e-20)."""
    kd, td, nd = k.cast("double"), total.cast("double"), n.cast("double")
    p = kd / td
    mean = nd * p
    sd = F.sqrt(F.greatest(nd * p * (1 - p) * (td - nd) / F.greatest(td - 1, F.lit(1.0)), F.lit(0.0)))
    lo = F.greatest(F.lit(0).cast("long"), n + k - total, (F.floor(mean - 10 * sd) - 1).cast("long"))
    hi = F.least(k, n, (F.ceil(mean + 10 * sd) + 1).cast("long"))

    def ratio(x: Column) -> Column:
        xd = x.cast("double")
        return (kd - xd) * (nd - xd) / ((xd + 1) * (td - kd - nd + xd + 1))

    counts = F.sequence(lo, hi)
    mass = F.aggregate(counts, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t")),
                       lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["t"] + a["w"]).alias("t")),
                       lambda a: a["t"])
    found = F.aggregate(counts, F.struct(F.lit(1.0).alias("w"), (u * mass).alias("left"), lo.alias("x")),
                        lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["left"] - a["w"]).alias("left"),
                                              F.when(a["left"] > 0, x).otherwise(a["x"]).alias("x")),
                        lambda a: a["x"])
    return F.when((total <= 0) | (k <= 0) | (n <= 0), F.lit(0).cast("long")).when(n >= total, k).otherwise(found)


def _halved(seed: int) -> Column:
    """Blocks of each source for the left half of a node."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
    share = lambda i: F.floor(i * F.col("blocks") / F.col("shards")).cast("long")
    n, total = share(mid) - share(F.col("lo")), share(F.col("hi")) - share(F.col("lo"))
    kinds = F.transform("quota", lambda q, i: F.struct(q.alias("q"), i.alias("i")))
    start = F.struct(n.alias("n"), total.alias("total"), F.array().cast("array<bigint>").alias("left"))

    def step(a: Column, e: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.col("lo"), F.col("hi"), e["i"], F.lit(seed)), 11) + 0.5) / float(1 << 53)
        x = _draw(e["q"], a["total"], a["n"], u)
        # the draw is computed once, as the only element of an array
        return F.element_at(F.transform(F.array(x), lambda d: F.struct(
            (a["n"] - d).alias("n"), (a["total"] - e["q"]).alias("total"), F.concat(a["left"], F.array(d)).alias("left"))), 1)

    return F.aggregate(kinds, start, step, lambda a: a["left"])


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas: (sid, blocks).  Returns (shard, sid, quota): shard k holds
    floor((k + 1) b / shards) - floor(k b / shards) of all b blocks."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("sid", "blocks"))), lambda s: s["blocks"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("sid", "blocks"))), lambda s: s["sid"])
    node = quotas.agg(listed.alias("quota"), ids.alias("sids"), F.sum("blocks").cast("long").alias("blocks")).filter("blocks > 0")
    node = node.withColumn("shards", F.lit(shards).cast("long")).withColumn("lo", F.lit(0).cast("long")).withColumn("hi", F.lit(shards).cast("long"))
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
    for level in range((shards - 1).bit_length()):
        halves = node.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, _halved(seed)))
        rest = F.zip_with("quota", "left", lambda q, x: q - x)
        child = lambda a, b, q: F.struct(a.alias("lo"), b.alias("hi"), q.alias("quota"))
        kids = F.when(F.col("left").isNull(), F.array(child(F.col("lo"), F.col("hi"), F.col("quota")))).otherwise(
            F.array(child(F.col("lo"), mid, F.col("left")), child(mid, F.col("hi"), rest)))
        node = halves.select("sids", "blocks", "shards", F.explode(kids).alias("c")).select("sids", "blocks", "shards", "c.lo", "c.hi", "c.quota")
        if level == 10:  # wide enough by now to be worth many tasks
            node = node.repartition("lo")
    leaf = F.explode(F.arrays_zip(F.col("sids").alias("sid"), F.col("quota").alias("quota"))).alias("x")
    return node.select(F.col("lo").alias("shard"), leaf).select("shard", "x.sid", "x.quota")


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block_words: int = 1 << 16, shard_words: int = 1 << 22,
        seed: int = 17) -> DataFrame:
    """One row for each time a document is taken: id, source, size, source_size,
    target, copy, shard, block, position (in the shard); a document that is not
    taken has one row without copy, shard, block and position."""
    scratch = Scratch(spark, "mixing")
    sized = scratch.keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                     words(F.col(text_col)).alias("size")), "sizes")
    sources = scratch.keep(targets(sized, weights, cap), "sources")
    count = sources.agg(F.count("*").alias("n"), F.sum("source_size").alias("words")).first()
    near = F.broadcast if count["n"] <= FEW else (lambda df: df)
    rows = sized.join(near(sources.select("sid", F.col("source").alias("s"))), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    rows = _units(rows, scratch)
    per_pass = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")
    end = F.coalesce(F.array_max(F.transform("steps", lambda t: t["hi"])), F.lit(-1))
    part = F.when(end < 0, 0).otherwise(_block(end, F.col("b")) + 1)
    plan = scratch.keep(passes(rows, sources, seed, near, scratch).withColumn("b", per_pass).withColumn(
        "blocks", F.when(F.col("source_size") > 0, F.col("full") * F.col("b") + part).otherwise(0).cast("long")), "plan")
    shards = max(1, -(-int(count["words"] or 0) // shard_words))

    parts = split_tree(plan.select("sid", "blocks"), shards, seed)
    run = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("quota").over(run), F.lit(0)).cast("long")
    runs = parts.withColumn("start", start).filter("quota > 0")
    owner = runs.select("sid", "shard", F.explode(F.sequence("start", F.col("start") + F.col("quota") - 1)).alias("place"))

    r = rows.join(near(plan.withColumnRenamed("blocks", "q")), "sid")
    r = r.withColumn("key", order_key(F.col("full"), seed))
    taken = F.exists("steps", lambda t: (F.col("key") > t["lo"]) & (F.col("key") <= t["hi"]) & (F.col("unit") <= t["fit"]))
    last = F.coalesce(taken, F.lit(False)).cast("long")
    r = r.withColumn("copies", F.when((F.col("size") > 0), F.col("full") + last).otherwise(0))
    copies = F.explode_outer(F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    r = r.select("id", "sid", "source", "size", "source_size", "target", "b", "q", copies.alias("copy"))
    block = F.col("copy") * F.col("b") + _block(order_key(F.col("copy"), seed), F.col("b"))
    r = r.withColumn("block", block).withColumn("place", F.pmod(F.col("block") * PRIME + F.xxhash64("sid", F.lit(seed)) % PRIME, F.col("q")))
    taken = r.filter("copy is not null").join(owner, ["sid", "place"])
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.col("id").cast("string"), "copy", F.lit(seed + 1)), "id", "copy")) - 1
    cols = ["id", "source", "size", "source_size", "target", "copy", "shard", "block", "position"]
    none = [F.lit(None).cast("long").alias(c) for c in ("shard", "block", "position")]
    return taken.withColumn("position", place.cast("long")).select(*cols).unionByName(
        r.filter("copy is null").select(*cols[:6], *none))


def taken_rows(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix
    takes it; those of a shard lie together, in its order."""
    out = mix(spark, docs, id_col=id_col, **settings).filter("shard is not null")
    # repeated rows of an id are taken one by one: their number is that of the id's rows
    took = out.groupBy("id", "copy").agg(F.min("shard").alias("shard"), F.min("position").alias("position"))
    took = Scratch(spark, "mixing-rows").keep(took.select(F.col("id").alias("__id"), F.col("shard").alias("__shard"),
                                                          F.col("position").alias("__position")), "taken")
    cols = docs.columns
    rows = docs.join(few(took), F.col(id_col).eqNullSafe(F.col("__id")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "__shard").sortWithinPartitions("__shard", "__position").select(cols)


def _block(key: Column, b: Column) -> Column:
    """The hash range, of b equal ones, that an order key lies in."""
    return F.least(F.floor(key / _TOP * b), b - 1).cast("long")
