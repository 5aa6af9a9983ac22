"""Filter interaction audit: what every order of a set of filters removes.

1. ``failures``: one row per document with a bit mask of the filters it fails.
   The last filter of ``FILTERS`` (a copy of a smaller id's text) is decided on
   a digest and an id, so texts are not shuffled.
2. ``mask_counts``: documents counted by part, mask and flags (combined before
   the shuffle); from here on the work no longer depends on the documents.
3. ``removal_intervals``: number the orders of the filters by their Lehmer rank.
   A document with a given mask is removed at step s exactly in the orders that
   begin with s - 1 filters it passes and then one it fails.  All orders with
   one beginning have consecutive ranks, so a mask's removals at a step are a
   few intervals of ranks.
4. ``audit``: each count is added at the start of its intervals and taken off
   at their ends; a prefix sum over the ranks gives the removals of every
   (order, step), and sums over steps and orders the other columns.

Defined cases: a null text is an empty one; a null or missing part is the empty
string; repeated rows are documents of their own, and rows of one id with equal
texts are no copies of each other; a row with a null id is a copy of none and
makes none; an id with several label rows has a flag if any has it; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The filters in the order of their bits.
FILTERS = "ABCDE"
#: Characters of the symbol filter D.
SYMBOLS = "#$%&*|"
COUNTS = ("removed", "good_lost", "toxic_lost")


def _bits(conditions: dict[str, Column]) -> Column:
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions.values())), F.lit(0))


def text_failures(text: Column, min_words: int = 200, min_distinct: int = 50, max_upper: int = 2) -> dict[str, Column]:
    """The failure conditions of the filters that look at one text only."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": F.size(words) < min_words,
            "B": 100 * F.size(F.array_distinct(words)) < min_distinct * F.size(words),
            "C": 100 * upper > max_upper * F.length(text),
            "D": text.rlike("[" + SYMBOLS.replace("$", r"\$").replace("&", r"\&") + "]")}


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) of every row: bit i of the mask is set if filter i of FILTERS fails it."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "part", _bits(text_failures(F.col("text"))).alias("mask"),
                       F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).filter("id is not null").withColumn("first", F.lit(True))
    # joined on digest AND id, so that a large group of copies is spread over the tasks
    out = rows.join(first, ["digest", "id"], "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return out.select("id", "part", (F.col("mask") + F.when(copy, F.lit(1 << 4)).otherwise(F.lit(0))).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled quality 1 and toxic 1."""
    flag = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(flag("quality"), flag("toxic"))
    known = known.filter("quality = 1 or toxic = 1")
    both = failed.join(known, "id", "left")
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"),
                                            F.count_if(F.col("toxic") == 1).alias("toxic"))


def orders(filters: str) -> list[str]:
    """All orders of the filters by Lehmer rank: the lexicographic order of their positions."""
    return ["".join(filters[i] for i in p) for p in permutations(range(len(filters)))]


def removal_intervals(filters: str) -> list[tuple[int, int, int, int]]:
    """(mask, step, begin, end): a document with that mask is removed at that step in
    the orders of rank begin to end - 1.  Adjoining intervals are one."""
    k = len(filters)

    def rank(prefix: tuple[int, ...]) -> int:
        """The smallest rank of the orders that begin so: its Lehmer code as a number."""
        return sum(sum(q < p and q not in prefix[:i] for q in range(k)) * factorial(k - 1 - i) for i, p in enumerate(prefix))

    found = []
    for mask in range(1, 1 << k):
        fails, passes = ([i for i in range(k) if mask >> i & 1 == bit] for bit in (1, 0))
        for step in range(1, len(passes) + 2):
            runs: list[list[int]] = []
            for begin in sorted(rank((*p, f)) for p in permutations(passes, step - 1) for f in fails):
                if runs and runs[-1][1] == begin:
                    runs[-1][1] += factorial(k - step)
                else:
                    runs.append([begin, begin + factorial(k - step)])
            found += [(mask, step, a, b) for a, b in runs]
    return found


def audit(spark: SparkSession, counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """counts: (part, mask, n, good, toxic).  One row per part, order and step."""
    k = len(filters)
    intervals = spark.createDataFrame(removal_intervals(filters), "mask int, step int, begin int, end int")
    hit = counts.join(F.broadcast(intervals), "mask")
    ends = F.explode(F.array(F.struct(F.col("begin").alias("rank"), F.lit(1).alias("sign")),
                             F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign")))).alias("at")
    steps = hit.select("part", "step", ends, "n", "good", "toxic").groupBy("part", "step", "at.rank").agg(
        *[F.sum(F.col("at.sign") * F.col(c)).alias(d) for c, d in zip(("n", "good", "toxic"), COUNTS, strict=True)])

    # every (part, step, rank), zeros included; the rank after the last only ends intervals
    bit = lambda f: F.col("mask").bitwiseAND(F.lit(1 << filters.index(f))) != 0
    only = lambda f: F.col("mask") == F.lit(1 << filters.index(f))
    parts = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(bit(f), F.col("n")).otherwise(0)) for f in filters]).alias("fails"),
        F.array(*[F.sum(F.when(only(f), F.col("n")).otherwise(0)) for f in filters]).alias("alone"))
    ranked = F.array(*map(F.lit, orders(filters)))
    grid = (parts.select("*", F.posexplode(ranked).alias("rank", "filter_order"))
            .select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")))
    grid = grid.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    own = lambda c: F.element_at(c, F.instr(F.lit(filters), F.col("filter")))
    grid = grid.select("part", "rank", "filter_order", "step", "filter", "total", own("fails").alias("fails"), own("alone").alias("alone"))

    w = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(steps, ["part", "step", "rank"], "left")
    out = out.select("part", "rank", "filter_order", "step", "filter", "total", "fails", "alone",
                     *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in COUNTS])
    so_far = F.sum("removed").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return out.select("part", "filter_order", "step", "filter", (F.col("total") - so_far).alias("kept"), "removed",
                      (F.col("fails") - F.col("removed")).alias("redundant"), F.col("alone").alias("unique_fails"),
                      "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"))
