"""Creator and brand catalog edits (T3-T5): platforms, packages, campaigns,
own profile and avatar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.frame import first_reason, last_by, update_by_key
from souk.operators.checks import apply_defaults
from souk.plans.accounts import cascade_delete
from souk.plans.base import JobResult, batch_time, decidable, new_id, rejects_of, with_profile
from souk.session import checkpoint_dir
from souk.sources.schema import ENUMS, NOT_NULL, SCHEMAS
from souk.sources.tables import conform

# table → (owner profile kind, owner column, payload columns the handler writes)
EDITABLE = {
    "creator_platforms": ("creator", "creator_id",
                          ("platform_name", "username", "profile_url", "followers", "engagement_rate")),
    "promotion_packages": ("creator", "creator_id", ("package_name", "description", "price", "delivery_days")),
    "campaigns": ("brand", "brand_id", ("title", "description", "budget", "category")),
}
UPDATABLE = {
    "promotion_packages": ("creator", "creator_id", ("package_name", "description", "price", "delivery_days")),
    "campaigns": ("brand", "brand_id", ("title", "description", "budget", "category", "status")),
}


def _typed(cmds: DataFrame, table: str, cols) -> DataFrame:
    types = {f.name: f.dataType for f in SCHEMAS[table].fields}
    return cmds.select("*", *[F.col(c).cast(types[c]).alias(f"_v_{c}") for c in cols])


def _not_null_ok(table: str, cols):
    ok = F.lit(True)
    for c in cols:
        if c in NOT_NULL.get(table, ()):
            ok = ok & F.col(f"_v_{c}").isNotNull()
    return ok


def append_rows(m, table: str, cmds: DataFrame, batch_ts) -> JobResult:
    """The actor needs the owning profile (creator for platforms and
    packages, brand for campaigns); the row is inserted with the columns the
    handler lists (an absent value is stored as NULL, so a NOT NULL column
    rejects the command), the rest take their defaults.  Order-free."""
    kind, owner_col, cols = EDITABLE[table]
    c = _typed(with_profile(cmds, m, kind), table, cols)
    c = c.withColumn("reason", first_reason((F.col(f"{kind}_profile_id").isNotNull(), "profile_not_found"),
                                            (_not_null_ok(table, cols), "not_null")))
    ok = c.filter(F.col("reason").isNull())
    rows = ok.select(new_id("t03", F.lit(table), "cmd_id").alias("id"), F.col(f"{kind}_profile_id").alias(owner_col),
                     *[F.col(f"_v_{x}").alias(x) for x in cols], batch_time(batch_ts).alias("created_at"))
    new = apply_defaults(table, conform(rows, table), batch_ts)
    if table == "creator_platforms":  # listed columns keep an explicit NULL; only unlisted ones default
        new = conform(rows, table)
    return JobResult(tables={table: m[table].unionByName(new)}, rejects=rejects_of(c))


def update_rows(m, table: str, cmds: DataFrame, batch_ts=None) -> JobResult:
    """T4: packages and campaigns by id, guarded by owner; every listed
    column is overwritten, nulls included; the last command per row wins.
    Reasons: no profile (the reference fails on it) → a NOT NULL or ENUM
    column would be violated → no row with that id → the row belongs to
    someone else (the reference answers 200 and writes nothing)."""
    kind, owner_col, cols = UPDATABLE[table]
    c = _typed(with_profile(cmds, m, kind), table, cols)
    rows = m[table].select(F.col("id").alias("_rid"), F.col(owner_col).alias("_rowner"))
    c = c.join(rows, F.col("target_id") == F.col("_rid"), "left")
    enum_ok = F.lit(True)
    for (t, col), dom in ENUMS.items():
        if t == table and col in cols:
            enum_ok = enum_ok & (F.col(f"_v_{col}").isNull() | F.col(f"_v_{col}").isin(*dom))
    c = c.withColumn("reason", first_reason(
        (F.col(f"{kind}_profile_id").isNotNull(), "profile_not_found"),
        (_not_null_ok(table, cols) & enum_ok, "invalid_value"),
        (F.col("_rid").isNotNull(), "not_found"),
        (F.col("_rowner") == F.col(f"{kind}_profile_id"), "not_owner")))
    ok = c.filter(F.col("reason").isNull())
    last = last_by(ok, "target_id", "seq", [f"_v_{x}" for x in cols]).select(
        F.col("target_id").alias("id"), *[F.col(f"_v_{x}").alias(x) for x in cols])
    return JobResult(tables={table: update_by_key(m[table], last, "id", list(cols))}, rejects=rejects_of(c))


PROFILE_COLS = ("bio", "category", "city", "country", "username")


def _name_rounds(cmds: DataFrame, names: DataFrame) -> DataFrame:
    """cmds: (cmd_id, seq, pid, un); names: (hid, hn), the profiles' names in
    lower case.  (cmd_id, taken): whether another profile holds the name when
    the command's turn comes.  A command whose name is free renames its
    profile, any other only reads; rounds decide what ``decidable`` gives."""
    checkpoint_dir(cmds.sparkSession)
    names, undecided, decided = names.checkpoint(), cmds.checkpoint(), None
    while not undecided.isEmpty():
        u = undecided.join(names, F.col("un") == F.col("hn"), "left").withColumn("_w", F.col("hid").isNull())
        touched = F.array(F.concat(F.lit("p:"), "pid"), F.concat(F.lit("n:"), "un"), F.concat(F.lit("p:"), "hid"))
        now = decidable(u, touched).select("cmd_id", "pid", "un", "_w", (F.col("hid").isNotNull() & (F.col("hid") != F.col("pid"))).alias("taken")).checkpoint()
        decided = now if decided is None else decided.unionByName(now)
        moved = now.filter("_w").select(F.col("pid").alias("_p"), F.col("un").alias("_n"))
        names = names.join(moved, F.col("hid") == F.col("_p"), "left").select("hid", F.coalesce("_n", "hn").alias("hn")).checkpoint()
        undecided = undecided.join(now.select("cmd_id"), "cmd_id", "left_anti").checkpoint()
    return cmds.limit(0).select("cmd_id", F.lit(False).alias("taken")) if decided is None else decided.select("cmd_id", "taken")


def update_own_profile(m, cmds: DataFrame, batch_ts=None) -> JobResult:
    """T4 for the signed-in creator's profile (bio, category, city, country,
    username; nulls overwrite).  Reasons: no profile → username missing →
    username held by another profile (case-insensitive) when the command's turn
    comes: names taken or freed earlier in the batch count.  Last command per
    profile wins."""
    c = with_profile(cmds, m, "creator")
    wants = c.filter(F.col("creator_profile_id").isNotNull() & F.col("username").isNotNull()).select(
        "cmd_id", "seq", F.col("creator_profile_id").alias("pid"), F.lower("username").alias("un"))
    names = m["creator_profiles"].select(F.col("id").alias("hid"), F.lower("username").alias("hn"))
    near = names.join(wants.select("un").distinct(), F.col("hn") == F.col("un"), "left_semi").unionByName(
        names.join(wants.select("pid").distinct(), F.col("hid") == F.col("pid"), "left_semi")).distinct()
    c = c.join(_name_rounds(wants, near).withColumnRenamed("cmd_id", "_dc"), F.col("cmd_id") == F.col("_dc"), "left")
    c = c.withColumn("reason", first_reason((F.col("creator_profile_id").isNotNull(), "profile_not_found"),
                                            (F.col("username").isNotNull(), "not_null"),
                                            (~F.coalesce("taken", F.lit(False)), "username_taken")))
    ok = c.filter(F.col("reason").isNull())
    last = last_by(ok, "creator_profile_id", "seq", list(PROFILE_COLS)).withColumnRenamed("creator_profile_id", "id")
    return JobResult(tables={"creator_profiles": update_by_key(m["creator_profiles"], last, "id", list(PROFILE_COLS))},
                     rejects=rejects_of(c))


def update_avatars(m, cmds: DataFrame, batch_ts=None) -> JobResult:
    """T4 avatar: the uploaded file's URL becomes the actor's avatar (last wins)."""
    c = cmds.withColumn("reason", first_reason((F.col("avatar_url").isNotNull(), "no_file")))
    last = last_by(c.filter(F.col("reason").isNull()), "actor_user_id", "seq", ["avatar_url"]).withColumnRenamed(
        "actor_user_id", "id")
    return JobResult(tables={"users": update_by_key(m["users"], last, "id", ["avatar_url"])}, rejects=rejects_of(c))


def delete_rows(m, table: str, cmds: DataFrame, batch_ts=None) -> JobResult:
    """T5: delete packages or campaigns by id when the actor owns them, then
    apply the delete rules (package → bookings.package_id SET NULL;
    campaign → invites CASCADE, bookings.campaign_id SET NULL).  Reasons: no
    profile → not the owner or no such row (the reference answers 200)."""
    kind, owner_col, _ = UPDATABLE[table]
    c = with_profile(cmds, m, kind)
    rows = m[table].select(F.col("id").alias("_rid"), F.col(owner_col).alias("_rowner"))
    c = c.join(rows, (F.col("target_id") == F.col("_rid")) & (F.col("_rowner") == F.col(f"{kind}_profile_id")), "left")
    c = c.withColumn("reason", first_reason((F.col(f"{kind}_profile_id").isNotNull(), "profile_not_found"),
                                            (F.col("_rid").isNotNull(), "not_owner")))
    gone = c.filter(F.col("reason").isNull()).select(F.col("target_id").alias("id")).distinct()
    return JobResult(tables=cascade_delete(m, {table: gone}), rejects=rejects_of(c))
