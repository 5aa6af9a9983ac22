"""Streaming jobs.

Each has a batch twin over the same DataFrame shape; the streaming run over
all input equals the batch answer for one or many micro-batches and after
a restart from its checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.functions.frame import last_before
from souk.operators import notify, ratings
from souk.session import CLEANUP, setting, stored
from souk.sources.tables import TASK_ROWS
from souk.streaming.runner import EpochLog, file_stream, run_folder

EVENT_SCHEMA = T.StructType([
    T.StructField("event", T.StringType()), T.StructField("event_key", T.StringType()),
    T.StructField("user_id", T.StringType()), T.StructField("ref_id", T.StringType()),
    T.StructField("title_text", T.StringType()), T.StructField("amount", T.DoubleType()),
    T.StructField("note", T.StringType()), T.StructField("rating", T.StringType()),
    T.StructField("sender_label", T.StringType()), T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("actor_user_id", T.StringType()),
])

PRESENCE_SCHEMA = T.StructType([
    T.StructField("eid", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.StringType()), T.StructField("socket_id", T.StringType()),
    T.StructField("kind", T.StringType()),
])


# ------------------------------------------------------------------ W1
def notifications_from_events(m, events: DataFrame, job: str = "w1", who: DataFrame | None = None) -> DataFrame:
    """Events with a user are rendered directly; collaboration-chat events
    (no user) fan out to every participant except the actor through a
    stream-static join with the participants table (N2), then render (N1)."""
    direct = events.filter(F.col("user_id").isNotNull())
    fan = notify.fan_out(m, events.filter(F.col("user_id").isNull() & (F.col("event") == "collab_message")),
                         collab_col="ref_id", exclude_user_col="actor_user_id", who=who)
    cols = notify.EVENT_COLS
    both = direct.select(*cols).unionByName(fan.select(*cols))
    return notify.render(both, job)


def notification_stream(m, source: str, sink: str, checkpoint: str, files_per_trigger: int | None = None):
    """File stream of events → rendered notification rows appended to a
    parquet sink as they arrive (append mode, no state beyond the file log).
    The static side, participants with their users, is computed once a run and
    kept as a table that is cut and sorted by collaboration: a micro-batch deals
    and sorts only its own events, and reads the table as it lies."""
    table = _keep_audience(m, run_folder(m.spark, "w1-audience"))
    try:
        # the files of a bucket are sorted, and Spark is to know it; the stream keeps the settings it starts with
        with setting(m.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
            ev = file_stream(m.spark, source, EVENT_SCHEMA, files_per_trigger)
            q = (notifications_from_events(m, ev, who=m.spark.table(table).hint("merge")).writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink))
        q.awaitTermination()
    finally:
        m.spark.sql(f"drop table if exists {table}")  # its files stay below the checkpoint folder
    return q


#: Rows of the audience that a task of a micro-batch reads, packed, about.
AUDIENCE_ROWS = 4 * TASK_ROWS


def _keep_audience(m, path: str) -> str:
    """The name of a table of the packed audience in buckets of collaborations, a sorted file each."""
    flat = stored(notify.audience(m).select("_fo_c", "_fo_user"), f"{path}/flat")
    n = flat.count()
    buckets = max(m.spark.sparkContext.defaultParallelism, -(-n // AUDIENCE_ROWS))
    who = notify.packed(flat, max(buckets, -(-n // TASK_ROWS))).repartition(buckets, "_fo_c")
    table = "w1_audience_" + uuid.uuid4().hex
    with setting(m.spark, CLEANUP, "true"):
        who.write.format("parquet").bucketBy(buckets, "_fo_c").sortBy("_fo_c").option("path", f"{path}/packed").saveAsTable(table)
    return table


# ------------------------------------------------------------------ W2
def _presence_agg(events: DataFrame) -> DataFrame:
    stamp = F.struct("ts", "eid")
    return events.groupBy("user_id", "socket_id").agg(
        F.max(F.when(F.col("kind") == "register", stamp)).alias("last_reg"),
        F.max(F.when(F.col("kind") == "disconnect", stamp)).alias("last_disc"))


def presence_from_pairs(pairs: DataFrame) -> DataFrame:
    """Per user: the socket of the latest registration, and whether that
    socket has been disconnected since (per-(user, socket) state, so a
    disconnect removes every user on that socket)."""
    latest = pairs.filter(F.col("last_reg").isNotNull()).groupBy("user_id").agg(
        F.max_by(F.struct("socket_id", "last_reg", "last_disc"), "last_reg").alias("_l"))
    return latest.select(
        "user_id", F.col("_l.socket_id").alias("socket_id"), F.col("_l.last_reg.ts").alias("registered_at"),
        (F.col("_l.last_disc").isNull() | (F.col("_l.last_disc") < F.col("_l.last_reg"))).alias("online"))


def presence_state(events: DataFrame) -> DataFrame:
    """W2 batch: presence after all register / disconnect events."""
    return presence_from_pairs(_presence_agg(events))


PAIR_SCHEMA = ("user_id string, socket_id string, last_reg struct<ts: timestamp_ntz, eid: bigint>, "
               "last_disc struct<ts: timestamp_ntz, eid: bigint>")


def _merge_pairs(ttl: str | None):
    """Latest registration and disconnect per (user, socket).  With ``ttl`` (an
    interval) a socket that is not its user's latest is forgotten once it is
    that much older than the newest event: then the state is bounded by the
    users, and events that come later than that may find it gone."""

    def merge(rows: DataFrame) -> DataFrame:
        pairs = rows.groupBy("user_id", "socket_id").agg(F.max("last_reg").alias("last_reg"), F.max("last_disc").alias("last_disc"))
        if ttl is None:
            return pairs
        newest = rows.agg(F.max(F.greatest("last_reg.ts", "last_disc.ts"))).first()[0]  # one value
        latest = pairs.groupBy("user_id").agg(F.max("last_reg").alias("_top"))
        old = F.greatest("last_reg.ts", "last_disc.ts") < F.lit(newest) - F.expr(f"INTERVAL {ttl}")
        return pairs.join(latest, "user_id").filter(F.col("last_reg").eqNullSafe(F.col("_top")) & F.col("_top").isNotNull() | ~old).drop("_top")

    return merge


def presence_stream(spark: SparkSession, source: str, log: str, checkpoint: str, files_per_trigger: int | None = None,
                    ttl: str | None = None, every: int = 16) -> DataFrame:
    """Per micro-batch the latest registration and disconnect of each
    (user, socket), merged in a compacted log (``EpochLog``); a maximum needs
    no more state, and events may come in any order."""
    state = EpochLog(spark, log, PAIR_SCHEMA, _merge_pairs(ttl), every)
    ev = file_stream(spark, source, PRESENCE_SCHEMA, files_per_trigger)
    q = (ev.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, epoch: state.write(_presence_agg(df), epoch)).trigger(availableNow=True).start())
    q.awaitTermination()
    return presence_from_pairs(state.read())


# ------------------------------------------------------------------ W3
def deliver_online(notifications: DataFrame, presence: DataFrame, ranges: int | None = None) -> DataFrame:
    """W3 batch (an as-of join): a notification is pushed iff, at its
    creation time, the user's latest registration happened before it and
    that socket was not disconnected in between; otherwise it is only
    stored (a notification comes before a presence event of the same instant).

    Two segmented scans (``last_before``): over the presence events, the next
    disconnect of each registration's user and socket; over one timeline per
    user of registrations and notifications, the last registration with the
    end found for it.  The slices hold equal numbers of rows, so neither a
    user with a third of all events nor one crowded instant meets one task."""
    out, _ = _delivered(delivery_timeline(notifications, presence), None, ranges)
    return out


def _delivered(timeline: DataFrame, before: DataFrame | None, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The notifications of a timeline with what becomes of them, and all its
    registrations with their ends.  before: registrations from earlier on."""
    stamp = F.struct("t", "rank", "k")
    events = timeline.filter(F.col("kind") != "notify")
    if before is not None:
        events = events.unionByName(before.withColumn("kind", F.lit("register")), allowMissingColumns=True)
    else:
        events = events.withColumn("ended", F.lit(None).cast(STAMP))
    ends = last_before(events, ["user_id", "socket_id"], ["t", "rank", "k"],
                       {"_end": F.when((F.col("kind") == "disconnect") & F.col("socket_id").isNotNull(), stamp)}, ranges, after=True)
    regs = ends.filter(F.col("kind") == "register").withColumn("ended", F.coalesce("ended", "_end")).drop("_end")
    notes = timeline.filter(F.col("kind") == "notify")
    at = F.when(F.col("kind") == "register", F.struct("socket_id", "ended"))
    line = last_before(regs.unionByName(notes, allowMissingColumns=True), ["user_id"], ["t", "rank", "k"], {"_reg": at}, ranges)
    online = F.col("_reg").isNotNull() & (F.col("_reg.ended").isNull() | (F.col("_reg.ended") > stamp))
    out = line.filter(F.col("kind") == "notify").select(
        F.col("notification_id").alias("id"), "user_id", F.col("t").alias("created_at"),
        online.alias("delivered"), F.when(online, F.col("_reg.socket_id")).alias("socket_id"))
    return out, regs.select("user_id", "socket_id", "t", "rank", "k", "ended")


STAMP = "struct<t: timestamp_ntz, rank: int, k: string>"
DELIVERY_IN = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("t", T.TimestampNTZType()),
    T.StructField("rank", T.IntegerType()), T.StructField("k", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("socket_id", T.StringType()), T.StructField("notification_id", T.StringType()),
])
ONLINE_SCHEMA = f"user_id string, socket_id string, t timestamp_ntz, rank int, k string, ended {STAMP}"


def _latest_registration(rows: DataFrame) -> DataFrame:
    """Per user the latest registration; of two rows for it the one that knows its end."""
    cols = ["socket_id", "t", "rank", "k", "ended"]
    pick = F.max_by(F.struct(*cols), F.struct("t", "rank", "k", F.col("ended").isNotNull().alias("known"), "ended"))
    return rows.groupBy("user_id").agg(pick.alias("_l")).select("user_id", *[f"_l.{c}" for c in cols])


def delivery_stream(spark: SparkSession, source: str, sink: str, log: str, checkpoint: str,
                    files_per_trigger: int | None = None, every: int = 16) -> DataFrame:
    """W3 streaming: presence events and notifications in one file stream, in
    time order across micro-batches and any order within one.

    The state is each user's latest registration and its end, in a compacted
    log (``EpochLog``).  A micro-batch is the as-of join of ``deliver_online``
    over its own events and the state before it, so a user with most of the
    events is spread over slices as there.  Its notifications go to a folder of
    their own, overwritten when the batch is run again.  Returns them all."""
    state = EpochLog(spark, log, ONLINE_SCHEMA, _latest_registration, every)

    def step(df: DataFrame, epoch: int) -> None:
        out, regs = _delivered(df, state.read(epoch - 1))
        out.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        state.write(regs, epoch)

    tl = file_stream(spark, source, DELIVERY_IN, files_per_trigger)
    q = tl.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink).drop("epoch")


def delivery_timeline(notifications: DataFrame, presence: DataFrame) -> DataFrame:
    """The tagged input of ``delivery_stream`` built from the two tables."""
    p = presence.select("user_id", F.col("ts").alias("t"), F.lit(1).alias("rank"), F.col("eid").cast("string").alias("k"),
                        "kind", "socket_id", F.lit(None).cast("string").alias("notification_id"))
    n = notifications.select("user_id", F.col("created_at").alias("t"), F.lit(0).alias("rank"), F.col("id").alias("k"),
                             F.lit("notify").alias("kind"), F.lit(None).cast("string").alias("socket_id"),
                             F.col("id").alias("notification_id"))
    return p.unionByName(n)


# ------------------------------------------------------------------ W4
REVIEW_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("creator_id", T.StringType()),
                              T.StructField("rating", T.IntegerType())])


def rating_stream(m, source: str, log: str, checkpoint: str, files_per_trigger: int | None = None, every: int = 16) -> DataFrame:
    """The rating trigger as a running aggregate: sum and count per creator
    of each micro-batch, added up in a compacted log (``EpochLog``), then
    ROUND(AVG, 2) merged into the stored ratings (creators without reviews
    keep theirs)."""
    total = lambda rows: rows.groupBy("creator_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    state = EpochLog(m.spark, log, "creator_id string, s bigint, n bigint", total, every)
    rv = file_stream(m.spark, source, REVIEW_SCHEMA, files_per_trigger)
    new = lambda df: df.select("creator_id", F.col("rating").cast("bigint").alias("s"), F.lit(1).cast("bigint").alias("n"))
    q = (rv.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, epoch: state.write(new(df), epoch)).trigger(availableNow=True).start())
    q.awaitTermination()
    cur = state.read()
    avg4 = F.round(F.col("s").cast("decimal(20,0)") / F.col("n").cast("decimal(20,0)"), 4)
    new = cur.select(F.col("creator_id").alias("_rid"), F.round(avg4, 2).cast("decimal(3,2)").alias("_new_rating"))
    return ratings._merge(m["creator_profiles"], new, "rating")
