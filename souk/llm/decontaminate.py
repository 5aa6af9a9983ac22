"""Benchmark decontamination by winnowing, in DataFrame functions only.

1. Words: runs of digits, letters a-z (A-Z lower-cased) and characters beyond
   ASCII.  A benchmark item's windows are its runs of ``length`` words; a
   shorter item is one window.
2. ``winnowed``: the hashes of all k-grams of words, and the minimum of each
   window of w of them.  Neighbouring windows mostly share their minimum, so a
   fingerprint is kept once for each run of windows (s .. e - 1) that have it.
   With k + w - 1 = t, every shared span of t words shares a fingerprint.
3. The documents' fingerprints are joined with those of the items' windows.
4. A hit is extended: each window of words that starts in its run is compared,
   as text, with the items' windows of that length.  So nothing but true
   occurrences is left, and by the guarantee none is missed.
5. Per document the windows' spans are united; documents that hold windows of
   the same items share one list of items.

Items shorter than ``length`` go by shorter k-grams (``plan``): t is the least
length of the items of one k, so there are at most log2(length) passes, and
one if no item is shorter than half of ``length``.

Defined cases: null and empty texts and texts without words have no words and
are not contaminated; items without words or with a null id are left out;
repeated rows of an item id are one item with the windows of all its texts;
repeated rows of a document each give a row, and rows of one id with different
texts are told apart; an empty benchmark contaminates nothing, an empty table
gives no rows; other columns are ignored.  Ties of the minimum do not matter:
only its value is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import FEW_ROWS, Scratch, ascii_lower, few

#: Windows of an item whose texts may be broadcast, by their counted rows.
FEW_TEXTS = 200_000
KEY = ("k1", "k2")


def words_of(text: Column) -> Column:
    """The words of a text, in order; none of a null text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def plan(lengths: list[int], length: int) -> list[tuple[int, int, list[int]]]:
    """(k, w, window lengths) of each pass for the lengths of windows that occur."""
    out, k, top = [], max(1, length // 2), length
    while top:
        own = sorted(n for n in lengths if k <= n <= top)
        if own:
            out.append((k, own[0] - k + 1, own))
        k, top = max(1, k // 2), k - 1
    return out


def winnowed(df: DataFrame, k: int, w: int, *keep: str) -> DataFrame:
    """df: with ``words``.  One row per fingerprint: the kept columns, ``fp``, and the
    starts ``s`` to ``e`` - 1 of the windows of k + w - 1 words that have it."""
    at = lambda arr, i: F.get(F.col(arr), i)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # an outer explode: of a plain one, Spark would infer a filter and work all this out a second time below the projections
    grams = F.transform(upto(F.size("words") - k + 1), lambda i: F.xxhash64(*[at("words", i + j) for j in range(k)]))
    d = df.select(*keep, F.when(F.size("words") >= k + w - 1, grams).alias("h"))
    if w > 1:
        d = d.select(*keep, F.transform(upto(F.size("h") - w + 1), lambda i: F.array_min(F.slice("h", i + 1, w))).alias("h"))
    d = d.select(*keep, "h", F.filter(upto(F.size("h")), lambda i: (i == 0) | (at("h", i) != at("h", i - 1))).alias("runs"))
    d = d.select(*keep, "h", "runs", F.posexplode_outer("runs").alias("j", "s")).filter("s is not null")
    return d.select(*keep, at("h", F.col("s")).alias("fp"), "s", F.coalesce(at("runs", F.col("j") + 1), F.size("h")).alias("e"))


def item_windows(bench: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(item, len, words): every window of every item, distinct."""
    items = bench.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("all"))
    items = items.filter(F.size("all") > 0).withColumn("len", F.least(F.size("all"), F.lit(length)))
    starts = F.explode(F.sequence(F.lit(1), F.size("all") - F.col("len") + 1)).alias("s")
    return items.select("item", "len", "all", starts).select("item", "len", F.slice("all", F.col("s"), F.col("len")).alias("words")).distinct()


def _covered(spans: Column) -> Column:
    """The words in the union of spans (s, len)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        end = F.greatest(acc["end"], x["s"] + x["len"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], x["s"])).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def decontaminate(spark: SparkSession, docs: DataFrame, bench: DataFrame, length: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, spans (array of (s, len) of the item windows in it), n_hit,
    items (sorted ids of the items with such windows), n_items, contaminated."""
    scratch = Scratch(spark, "decontaminate")
    windows = scratch.keep(item_windows(bench, length, item_col, item_text), "item-windows")
    lengths = [r[0] for r in windows.select("len").distinct().collect()]  # at most ``length`` numbers

    # a row is known by its id and text: 128 bits, also where ids are null or repeated
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("k1"),
                       F.xxhash64(F.lit(1), text, F.col(id_col)).alias("k2"))
    worded = rows.select("id", *KEY, words_of(F.col("text")).alias("words"))

    hits = spark.createDataFrame([], "k1 long, k2 long, s int, e int, lens array<int>")
    for k, w, own in plan(lengths, length):
        t = k + w - 1
        first = windows.filter(F.col("len").isin(own)).select(F.slice("words", 1, t).alias("words")).distinct()
        prints = scratch.keep(winnowed(first, k, w).select("fp").distinct(), "item-fingerprints")
        found = winnowed(worded, k, w, *KEY).join(few(prints), "fp", "left_semi")
        hits = hits.unionByName(found.select(*KEY, "s", "e", F.array(*map(F.lit, own)).alias("lens")))
    hits = scratch.keep(hits, "hits")

    runs = hits.groupBy(*KEY).agg(F.collect_list(F.struct("s", "e", "lens")).alias("runs"))
    runs = F.broadcast(runs) if hits.count() <= FEW_ROWS else runs
    each = F.flatten(F.transform("runs", lambda r: F.flatten(F.transform(
        F.sequence(r["s"], r["e"] - 1), lambda s: F.transform(r["lens"], lambda n: F.struct(s.alias("s"), n.alias("len")))))))
    tried = rows.join(runs, list(KEY), "left").select("id", *KEY, words_of(F.col("text")).alias("words"), each.alias("each"))
    inside = F.filter("each", lambda x: x["s"] + x["len"] <= F.size("words"))
    tried = tried.select("id", *KEY, F.size("words").cast("long").alias("n_words"), F.when(F.col("each").isNotNull(), F.transform(
        inside, lambda x: F.struct(x["s"].alias("s"), x["len"].alias("len"), F.array_join(F.slice("words", x["s"] + 1, x["len"]), " ").alias("window"))
    )).alias("windows"))
    tried = scratch.keep(tried, "tried")

    # windows of the same items are one group of windows
    known = windows.groupBy(F.array_join("words", " ").alias("window"), "len").agg(F.array_sort(F.collect_set("item")).alias("items"))
    known = scratch.keep(known.withColumn("group", F.sha2(F.array_join("items", ","), 256)), "known-windows")
    at = tried.filter(F.size("windows") > 0).select(*KEY, F.explode("windows").alias("w")).select(*KEY, "w.s", "w.len", "w.window")
    true = at.join(few(known.select("window", "len", "group"), FEW_TEXTS), ["window", "len"])
    per = true.groupBy(*KEY).agg(F.collect_set(F.struct("s", "len")).alias("spans"), F.array_sort(F.collect_set("group")).alias("groups"))
    per = scratch.keep(per.withColumn("set", F.sha2(F.array_join("groups", ","), 256)), "occurrences")

    sets = per.select("set", "groups").dropDuplicates(["set"]).select("set", F.explode("groups").alias("group"))
    lists = sets.join(known.select("group", "items").dropDuplicates(["group"]), "group").select("set", F.explode("items").alias("item"))
    lists = scratch.keep(lists.groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items")), "item-lists")
    per = per.select(*KEY, "set", "spans", _covered(F.col("spans")).alias("n_hit"))
    out = tried.select("id", *KEY, "n_words").join(per, list(KEY), "left").join(lists, "set", "left")
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("id", "n_words", "spans", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "items",
                      F.size("items").cast("long").alias("n_items"), F.col("n_hit").isNotNull().alias("contaminated"))
