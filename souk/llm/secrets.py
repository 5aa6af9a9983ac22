"""Secret scans with false-positive removal by a random forest.

DataFrame operations and Spark ML only.

1. ``candidates``: every run of at least 12 letters, digits or ``_ + / = -``
   inside a word that holds a digit or a change from lower to upper case, with
   the value's place, its own word's part before it and its neighbouring words.
2. ``describe``: features of a candidate: its length and kinds of characters;
   changes between kinds, and the mean log probability of its letter pairs
   under the transitions of the corpus' own words; the share of it that is
   covered by dictionary words; what its path says (test, example, docs,
   configuration, depth); what the words beside it say (an assignment, a
   quote, a word for a credential or for an ordinary number).
3. ``train``: a random forest on labelled findings (value, path, words, label),
   a sample of at most about ``max_rows``; ``scan`` scores all candidates.

The dictionary holds the words that at least ``min_docs`` documents use; it is
a table, and is joined only with the distinct parts of the candidates.  Words
and letter pairs are counted over all documents.

Defined cases: null and empty texts have no candidate; null ids and paths are
kept, a null path counts as the empty one; repeated rows give their candidates
again; labels of one kind only give that label's probability to all; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.llm.common import Scratch
from souk.llm.samples import at_most

SPACE = r"[\x20\x09-\x0D]+"
VALUE = r"[A-Za-z0-9_+/=-]{12,}"
CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|pwd|token|secret|credential|api|key|auth|bearer|private|login)"
NUMBER_WORD = r"(?i)(card|phone|tel|order|invoice|isbn|account|iban|page|id|ref|version|build|http)"
FEATURES = ("length", "digit_share", "upper_share", "other_share", "changes", "transition", "coverage", "distinct_share",
            "path_test", "path_config", "path_depth", "assigned", "quoted", "credential_near", "number_near")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, path, position, part, value, before, left1, left2, right1): one row per candidate."""
    words = F.split(F.col("text"), SPACE)
    likely = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("i"))),
                      lambda s: (F.length(s["word"]) >= 12) & s["word"].rlike(VALUE) & s["word"].rlike(r"\d|[a-z][A-Z]"))

    def at(i: Column) -> Column:
        return F.when(i >= 0, F.get("words", i))

    rows = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
            .filter("text is not null").withColumn("words", words))
    found = rows.select("id", "path", F.explode(F.transform(likely, lambda s: F.struct(
        s["i"].alias("position"), s["word"].alias("word"), at(s["i"] - 1).alias("left1"),
        at(s["i"] - 2).alias("left2"), F.get("words", s["i"] + 1).alias("right1")))).alias("c")).select("id", "path", "c.*")
    # an assignment inside the word: what follows the first = or : is the value
    inner = F.regexp_extract("word", r"^([A-Za-z_.-]{2,}[=:]+['\"]?)(.*)$", 1)
    rest = F.expr("substring(word, length(before) + 1)")
    values = F.filter(F.regexp_extract_all("rest", F.lit(f"({VALUE})"), 1), lambda v: v.rlike(r"\d|[a-z][A-Z]"))
    return (found.withColumn("before", inner).withColumn("rest", rest)
            .select("id", "path", "position", "before", "left1", "left2", "right1", "word", F.posexplode(values).alias("part", "value")))


#: Classes of characters for letter pairs; anything else is the first.
ALPHABET = "# abcdefghijklmnopqrstuvwxyz0123456789"


def _class(c: Column) -> Column:
    """0-based place in ALPHABET of a character of plain text."""
    return F.greatest(F.position(c, F.lit(ALPHABET)), F.lit(1)) - 1


def transitions(docs: DataFrame, text_col: str) -> list[float]:
    """Log probabilities of the letter pairs in the words of all documents, by
    ALPHABET: 38 x 38 numbers."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.col(text_col)), SPACE, " "), r"[^a-z0-9 ]", "#")
    pairs = F.regexp_extract_all(plain, F.lit("(?=(..))"), 1)  # a match at every character but the last
    seen = docs.select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
    n = {r["p"]: r["n"] for r in seen}  # bounded by the alphabet
    total = {a: sum(n.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
    return [math.log((n.get(a + b, 0) + 0.5) / (total[a] + 20)) for a in ALPHABET for b in ALPHABET]


def dictionary(docs: DataFrame, text_col: str = "text", min_docs: int = 20) -> DataFrame:
    """(word): lower-case words of at least three letters that at least ``min_docs`` documents use."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.col(text_col)), r"[^a-z]+")), lambda w: F.length(w).between(3, 20))
    return (docs.filter(F.col(text_col).isNotNull()).select(F.explode(words).alias("word"))
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("word"))


def describe(found: DataFrame, known: DataFrame, pairs: list[float]) -> DataFrame:
    """The candidates with ``FEATURES``."""
    v = F.col("value")
    parts = F.filter(F.split(F.lower(F.regexp_replace(v, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+"), lambda p: F.length(p) >= 3)
    rows = found.withColumn("uid", F.monotonically_increasing_id()).withColumn("parts", F.array_distinct(parts))
    pieces = rows.select("uid", F.explode("parts").alias("word"))
    hit = pieces.select("word").distinct().join(known, "word", "left_semi")
    covered = pieces.join(hit, "word").groupBy("uid").agg(F.sum(F.length("word")).alias("letters"))
    n = F.length(v)
    chars = F.transform(F.split(F.lower(v), ""), _class)
    logs = F.zip_with(F.slice("__chars", 1, n - 1), F.slice("__chars", 2, n - 1),
                      lambda a, b: F.get(F.array(*map(F.lit, pairs)), a * len(ALPHABET) + b))
    beside = F.concat_ws(" ", "before", "left1", "left2")
    kind_changes = F.regexp_count(v, F.lit(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"))
    r = rows.join(covered, "uid", "left").withColumn("__chars", chars)
    cols = {
        "length": n, "digit_share": F.regexp_count(v, F.lit("[0-9]")) / n, "upper_share": F.regexp_count(v, F.lit("[A-Z]")) / n,
        "other_share": F.regexp_count(v, F.lit("[^A-Za-z0-9]")) / n, "changes": kind_changes / n,
        "transition": F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / (n - 1),
        "coverage": F.coalesce("letters", F.lit(0)) / n, "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / n,
        "path_test": F.col("path").rlike(r"(?i)(test|example|sample|mock|fixture|spec|doc|demo)").cast("int"),
        "path_config": F.col("path").rlike(r"(?i)\.(env|ya?ml|json|ini|cfg|conf|properties|tf|toml)$").cast("int"),
        "path_depth": F.regexp_count("path", F.lit("/")),
        "assigned": (F.col("before").rlike("[=:]") | F.coalesce(F.col("left1").rlike("[=:]$"), F.lit(False))).cast("int"),
        "quoted": F.col("word").rlike("^[^\"']*[\"'].*[\"']").cast("int"),
        "credential_near": beside.rlike(CREDENTIAL).cast("int"), "number_near": beside.rlike(NUMBER_WORD).cast("int"),
    }
    for name in FEATURES:
        r = r.withColumn(name, cols[name].cast("double"))
    return r.drop("__chars", "uid", "letters", "parts")


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def train(described: DataFrame, label_col: str = "label", trees: int = 24, depth: int = 8, max_rows: int = 20_000,
          seed: int = 5) -> RandomForestClassificationModel | float:
    """A forest; or, if there is only one kind of label, its probability."""
    rows = described.filter(F.col(label_col).isNotNull()).withColumn(label_col, F.col(label_col).cast("double"))
    key = rows.withColumn("__key", F.concat_ws("|", F.col("id").cast("string"), "position", "part"))
    some = at_most(key, "__key", max_rows)
    kinds = [r[0] for r in some.select(label_col).distinct().collect()]
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.5
    forest = RandomForestClassifier(labelCol=label_col, numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed)
    return forest.fit(_assembled(some).select("features", label_col))


def scan(described: DataFrame, model: RandomForestClassificationModel | float, threshold: float = 0.5) -> DataFrame:
    """The candidates with ``probability`` and ``is_secret``; what is not a secret stays as a removed finding."""
    if isinstance(model, float):
        out = described.withColumn("probability", F.lit(model))
    else:
        out = model.transform(_assembled(described)).withColumn("probability", F.element_at(vector_to_array("probability"), 2))
        out = out.drop("features", "rawPrediction", "prediction")
    return out.withColumn("is_secret", F.col("probability") >= threshold)


def find_secrets(spark: SparkSession, docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 path_col: str = "source", min_docs: int = 20) -> DataFrame:
    """Scan ``docs`` with a forest fitted on ``findings``: the columns of ``candidates`` and a label."""
    scratch = Scratch(spark, "secrets")
    known = scratch.keep(dictionary(docs, text_col, min_docs), "dictionary")
    pairs = transitions(docs, text_col)
    labelled = scratch.keep(describe(findings, known, pairs), "findings")
    model = train(labelled)
    found = scratch.keep(candidates(docs, id_col, text_col, path_col), "candidates")
    return scan(describe(found, known, pairs), model)
