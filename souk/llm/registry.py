"""The driver's queries of the training-data operators and their DuckDB SQL.

Each query applies one operator of this package, with production parameters,
to its whole table and derives the contract's columns from the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from souk.llm import (decontaminate, embedding_dedup, exact_dedup, filter_audit, langid, minhash, mixing, packing, quality, samples, secrets,
                      spelling, standins, toolcalls, toxicity)
from souk.llm.common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document; rows with remainder 2 are held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = toxicity.learn(samples.labelled(docs, labels, "toxic", ~held_out, 4000, 8000))
    return toxicity.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, tokenised and packed into full windows of several sizes."""
    return packing.pack(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; rows with remainder 2 are held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    profiles = langid.learn(docs, ~held_out)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).drop("text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret candidate of every document, with the forest's verdict;
    documents with remainder 2 gave no labelled finding."""
    out = secrets.find_secrets(spark, _table(spark, sf_dir, "documents"), standins.labelled_findings(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), 4) == 2).alias("held_out"), "position", "part",
                      F.sha2("value", 256).alias("value_sha256"), *secrets.FEATURES, "probability", "is_secret")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: two-word shingles, similarity 0.8 or more."""
    out = minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"), k=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; rows with remainder 0 are held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = quality.learn(samples.labelled(docs, labels, "quality", ~held_out, 6000, 6000))
    return quality.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' target weights."""
    out = mixing.mix(spark, _table(spark, sf_dir, "documents"))
    return out.groupBy(F.col("id").alias("doc_id")).agg(
        F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"),
        F.sum(F.when(F.col("shard").isNotNull(), F.col("size")).otherwise(0)).alias("taken"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a cosine of 0.9 or more, and their components."""
    out = embedding_dedup.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful streaming deduplication of every document."""
    docs = _table(spark, sf_dir, "documents")
    # as a pattern, so that a table of one single file is a stream as well as a folder is
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/[d]ocuments.parquet")
    out = exact_dedup.dedup(spark, docs, stream)
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"),
                      "kept", F.col("digest").alias("text_sha256"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its tool calls and results linked, ordered,
    checked and written as canonical JSON."""
    calls, results = standins.tool_calls(spark, sf_dir)
    rows = toolcalls.messages(spark, _table(spark, sf_dir, "conversations"), calls, results, standins.TOOL_SCHEMAS)
    return toolcalls.conversations(rows)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all documents, its near words, form and root."""
    words = spelling.word_counts(_table(spark, sf_dir, "documents"), slip=spelling.every_nth_run_slips(199))
    return spelling.groups(spark, words)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over every document, in every order, for each source."""
    failed = filter_audit.failures(_table(spark, sf_dir, "documents"))
    return filter_audit.audit(spark, filter_audit.mask_counts(failed, _table(spark, sf_dir, "labels"))).drop("filter")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item: shared windows of ten words."""
    out = decontaminate.decontaminate(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op5_minhash": op5_minhash,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_tool_calls": op10_tool_calls,
    "op11_spelling": op11_spelling,
    "op12_filter_audit": op12_filter_audit,
    "op13_decontamination": op13_decontamination,
}

def _crc_table() -> list[int]:
    """The byte table of CRC-32 (reflected polynomial), for an engine without the function."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    return table


ORACLES = {
    "op9_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY body)
""",
    "op11_spelling": r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::varchar, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS raw FROM documents),
low AS (
  SELECT id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs),
bytes AS (SELECT run, hex(encode(id || ':' || run)) AS x FROM low),
hashed AS (
  SELECT run, xor(4294967295::ubigint, list_reduce(
           list_prepend(4294967295::ubigint, list_transform(range(0, length(x), 2), lambda i: ('0x' || x[i + 1:i + 2])::ubigint)),
           lambda c, b: xor(c >> 8, (CRC_TABLE::ubigint[])[((xor(c, b) & 255) + 1)::bigint]))) AS h
  FROM bytes),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[1:(h % length(run))::bigint] || run[(h % length(run))::bigint + 2:] ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
cut AS (
  SELECT word, pos, word[1:pos - 1] || word[pos + 1:] AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM words)),
pairs AS (
  SELECT a.word, b.word AS other FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.less = b.less AND a.pos = b.pos AND a.word <> b.word),
near AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.other, (-w.n, encode(p.other))) AS best, max(w.n) AS m
  FROM pairs p JOIN words w ON w.word = p.other GROUP BY p.word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN best END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words LEFT JOIN near USING (word)),
up AS (
  SELECT word, word AS root, 0 AS d FROM forms
  UNION ALL SELECT up.word, f.form, d + 1 FROM up JOIN forms f ON f.word = up.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, d) AS root FROM up GROUP BY word)
SELECT word, form, root, n, n_near, form_n::double AS form_n FROM forms JOIN last USING (word)
""".replace("CRC_TABLE", str(_crc_table())),
    "op12_filter_audit": r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
f AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM w),
known AS (
  SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed,
         count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM f LEFT JOIN known USING (doc_id) GROUP BY 1, 2),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, filter_order[1:step - 1] AS earlier
  FROM (SELECT DISTINCT part FROM m), orders, range(1, 6) g(step)),
marked AS (
  SELECT steps.*, n, good, toxic, contains(failed, filter) AS fails, failed = filter AS alone,
         len(list_filter(string_split(earlier, ''), lambda x: x <> '' AND contains(failed, x))) > 0 AS gone
  FROM steps JOIN m USING (part)),
counted AS (
  SELECT part, filter_order, step::int AS step, filter,
         sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::bigint AS kept,
         sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::bigint AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::bigint AS redundant,
         sum(CASE WHEN alone THEN n ELSE 0 END)::bigint AS unique_fails,
         sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::bigint AS good_lost,
         sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::bigint AS toxic_lost
  FROM marked GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::bigint AS shapley
FROM counted
""",
    "op13_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL),
il AS (SELECT item_id, words, least(len(words), 10) AS n FROM i WHERE len(words) > 0),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(words[s:s + n - 1], ' ') AS w
  FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM il)),
dw AS (
  SELECT r, n, s, array_to_string(words[s:s + n - 1], ' ') AS w
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(words) >= n)),
found AS (SELECT r, s, n, item_id FROM dw JOIN iw USING (n, w)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM found)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT r, item_id::varchar AS item FROM found) GROUP BY r)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
""",
}
