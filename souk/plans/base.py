"""Shape shared by the table jobs.

A job takes the current tables ``m`` and a command table (``cmd_id``,
``seq``, ``actor_user_id`` and a payload) and returns new versions of the
tables it changes, the rejected commands with the reason of the first
failing gate, the notifications it sends and the audit rows it writes.
One batch equals applying its commands one at a time in ``seq`` order;
each job states how it gets there (last write wins, first wins per unique
key, or a per-key fold expressed with window functions).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.functions.ids import det_uuid
from souk.operators import notify
from souk.sources.tables import conform

REJECT_SCHEMA = T.StructType([T.StructField("cmd_id", T.LongType()), T.StructField("reason", T.StringType())])


@dataclass
class JobResult:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    rejects: DataFrame | None = None
    notifications: DataFrame | None = None
    audit: DataFrame | None = None
    outputs: dict[str, DataFrame] = field(default_factory=dict)

    def apply(self, m):
        """The bundle after the job: changed tables swapped in, new
        notifications and audit rows appended."""
        frames = dict(self.tables)
        if self.notifications is not None:
            base = frames.get("notifications", m["notifications"])
            frames["notifications"] = base.unionByName(conform(self.notifications, "notifications"))
        if self.audit is not None:
            base = frames.get("admin_logs", m["admin_logs"])
            frames["admin_logs"] = base.unionByName(conform(self.audit, "admin_logs"))
        return m.replace(**frames)

    def output(self, name: str) -> DataFrame:
        if name == "rejects":
            return self.rejects
        if name in self.outputs:
            return self.outputs[name]
        if name == "notifications" and self.notifications is not None:
            return conform(self.notifications, "notifications")
        if name == "audit":
            return conform(self.audit, "admin_logs")
        return self.tables[name]


def rejects_of(cmds: DataFrame, reason_col: str = "reason") -> DataFrame:
    return cmds.filter(F.col(reason_col).isNotNull()).select(
        F.col("cmd_id").cast("bigint").alias("cmd_id"), F.col(reason_col).cast("string").alias("reason"))


def new_id(job: str, *parts) -> F.Column:
    """Deterministic id of a row a job inserts (re-runs give the same id)."""
    return det_uuid(F.lit(job), *[F.col(p) if isinstance(p, str) else p for p in parts])


def batch_time(ts) -> F.Column:
    return F.lit(ts).cast("timestamp_ntz")


def profile_of(m, kind: str) -> DataFrame:
    """user_id → creator or brand profile id."""
    t = "creator_profiles" if kind == "creator" else "brand_profiles"
    return m[t].select(F.col("user_id").alias(f"_{kind}_user"), F.col("id").alias(f"{kind}_profile_id"))


def with_profile(cmds: DataFrame, m, kind: str, user_col: str = "actor_user_id") -> DataFrame:
    p = profile_of(m, kind)
    return cmds.join(p, cmds[user_col] == F.col(f"_{kind}_user"), "left").drop(f"_{kind}_user")


def user_of_creator(m) -> DataFrame:
    return m["creator_profiles"].select(F.col("id").alias("_cp_id"), F.col("user_id").alias("creator_user_id"))


def user_of_brand(m) -> DataFrame:
    return m["brand_profiles"].select(F.col("id").alias("_bp_id"), F.col("user_id").alias("brand_user_id"))


def render(events: DataFrame, job: str) -> DataFrame:
    return notify.render(events, job)


def decidable(undecided: DataFrame, touched) -> DataFrame:
    """The commands whose outcome no other undecided command can change.

    undecided: cmd_id, seq and ``_w`` (the command writes), each with an array
    ``touched`` of the keys it reads or writes.  A reader qualifies if no
    earlier writer shares a key with it; a writer if it is the first writer of
    all its keys and leaves no earlier reader behind.  The smallest command
    always qualifies.  Grouped minima and joins: a hot key costs a row per task,
    and as many rounds as it has writes that depend on each other."""
    keys = F.explode(F.array_distinct(F.filter(touched, lambda x: x.isNotNull()))).alias("k")
    g = undecided.select("cmd_id", "seq", "_w", keys)
    first_w = g.groupBy("k").agg(F.min(F.when(F.col("_w"), F.col("seq"))).alias("mw"))
    late = g.join(first_w, "k").groupBy("cmd_id").agg(F.max(F.coalesce(F.col("mw") < F.col("seq"), F.lit(False))).alias("late"))
    g = g.join(late, "cmd_id")
    left = g.groupBy("k").agg(F.min(F.when(~F.col("_w") & F.col("late"), F.col("seq"))).alias("mb"))
    held = (g.join(left, "k").groupBy("cmd_id")
             .agg(F.max(F.col("late") | (F.col("_w") & F.coalesce(F.col("mb") < F.col("seq"), F.lit(False)))).alias("held")))
    return undecided.join(held.filter(~F.col("held")).select("cmd_id"), "cmd_id", "left_semi")
