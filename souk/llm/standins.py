"""Stand-in inputs for jobs whose input the driver's tables lack.  They only
give rows in the schema the job expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import secrets
from souk.llm.common import crc_mod


def labelled_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with a reviewer's label, from the rows that are not held out:
    candidates of the documents and of the pages' links.  A reviewer would call
    a provider's key format and an assigned password or token a secret, and
    plain numbers and link parts none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(crc_mod(F.col("doc_id"), 4) != 2)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").filter(crc_mod(F.col("page_id"), 4) != 2)
    links = pages.select((-1 - F.col("page_id")).alias("doc_id"), F.col("url").alias("source"), F.concat_ws(" ", F.lit("link"), "url").alias("text"))
    rows = secrets.candidates(docs).unionByName(secrets.candidates(links))
    key = F.col("value").rlike("^AKIA[0-9A-Z]{16}$")
    given = F.concat_ws(" ", "left2", "left1", "before").rlike("(password|token) ?=[ '\"]*$")
    return rows.withColumn("label", (key | given).cast("int"))


#: Schemas of the tools that the stand-in calls name.
TOOL_SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False,
               "properties": {"query": {"type": "string", "maxLength": 80}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "lookup": {"type": "object", "required": ["key"], "properties": {"key": {"type": "string", "pattern": "^[a-z]"},
                                                                     "exact": {"type": "boolean"}}},
}


def tool_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls and results beside the conversations' turns: each assistant turn
    calls a tool about its first word; odd turns from the fifth on need the
    call two turns earlier, and some need a later one; the next user turn, if
    any, gives the result.  Some identifiers, arguments and results are faulty,
    as logs have them."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    word = F.regexp_extract("text", r"([^\x20\x09-\x0D]+)", 1)
    h = F.xxhash64("conv_id", "turn")
    part = lambda n: F.pmod(h, F.lit(n))
    cid = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    made = turns.filter("role = 'assistant'")
    calls = made.select(
        "conv_id", F.when(part(31) == 0, F.lit("call_1")).otherwise(cid(F.col("turn"))).alias("call_id"), "turn", F.lit(0).cast("long").alias("place"),
        F.when(part(2) == 0, "search").otherwise("lookup").alias("tool"),
        F.when(part(23) == 0, F.concat(F.lit("{query:"), word)).otherwise(F.to_json(F.struct(
            F.when(part(2) == 0, word).alias("query"), F.when(part(2) == 0, part(60).cast("int")).alias("limit"),
            F.when(part(2) == 1, F.lower(word)).alias("key"), F.when(part(2) == 1, part(3) == 0).alias("exact")))).alias("arguments"),
        F.when(part(29) == 0, F.array(cid(F.col("turn") + 2))).when(F.col("turn") >= 5, F.array(cid(F.col("turn") - 2)))
        .otherwise(F.array().cast("array<string>")).alias("needs"))
    results = turns.filter("role = 'user' and turn > 0").select(
        "conv_id", F.when(part(37) == 0, F.lit("call_x")).otherwise(cid(F.col("turn") - 1)).alias("call_id"), "turn",
        F.lit(0).cast("long").alias("place"), F.col("text").alias("content"))
    return calls, results
