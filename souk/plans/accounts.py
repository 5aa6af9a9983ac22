"""Account, messaging and administration jobs (T1, T2, T21-T25) and the
delete-rule closure shared with T5."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.frame import first_reason, last_by, update_by_key
from souk.functions.ids import det_uuid
from souk.functions.text import col_truthy, encode_uri_component
from souk.operators import notify
from souk.plans.base import JobResult, batch_time, decidable, new_id, rejects_of
from souk.session import checkpoint_dir, run_folder, stored
from souk.sources.schema import ENUMS, FOREIGN_KEYS, TABLES, delete_order
from souk.sources.tables import conform

ROLES = ENUMS[("users", "role")]
# Fixed value: the avatar URL pattern new accounts get (seed = encodeURIComponent(name)).
AVATAR_PREFIX = "https://api.dicebear.com/7.x/avataaars/svg?seed="


# ------------------------------------------------------------------ T1
def _accept_greedy(cands: DataFrame) -> DataFrame:
    """Sequential first-wins acceptance under two unique keys (``_ek`` email,
    ``_uk`` username, the latter null for non-creators): a command is
    accepted iff no earlier *accepted* command shares either key.

    Exact, in rounds: a command that has the smallest seq among the
    undecided ones of both its key groups is accepted; undecided commands
    sharing a key with a newly accepted one are rejected.  The globally
    smallest undecided command is always accepted, so every round makes
    progress; each round is two grouped minima (partial aggregates, so a
    hot key costs one row per task) and two anti-joins, and its
    result is checkpointed to the session's checkpoint folder so the plan
    stays flat."""
    spark = cands.sparkSession
    checkpoint_dir(spark)
    undecided = cands.select("cmd_id", "seq", "_ek", "_uk")
    accepted = None
    while True:
        me = undecided.groupBy(F.col("_ek").alias("_ge")).agg(F.min("seq").alias("_me"))
        mu = (undecided.filter(F.col("_uk").isNotNull()).groupBy(F.col("_uk").alias("_gu"))
              .agg(F.min("seq").alias("_mu")))
        u = (undecided.join(me, F.col("_ek") == F.col("_ge"), "left")
                      .join(mu, F.col("_uk") == F.col("_gu"), "left"))
        now = u.filter((F.col("seq") == F.col("_me")) & (F.col("_uk").isNull() | (F.col("seq") == F.col("_mu"))))
        now = now.select("cmd_id", "seq", "_ek", "_uk").checkpoint()
        if now.isEmpty():
            break
        accepted = now if accepted is None else accepted.unionByName(now)
        rest = undecided.join(now.select("cmd_id"), "cmd_id", "left_anti")
        rest = (rest.join(now.select(F.col("_ek").alias("_x")), F.col("_ek") == F.col("_x"), "left_anti")
                    .join(now.select(F.col("_uk").alias("_y")).filter(F.col("_y").isNotNull()),
                          F.col("_uk") == F.col("_y"), "left_anti"))
        undecided = rest.checkpoint()
    if accepted is None:
        return cands.limit(0).select("cmd_id", "seq", "_ek", "_uk")
    return accepted


def register_users(m, cmds: DataFrame, batch_ts) -> JobResult:
    """Name, email, password and role given → role valid → email unused
    → (creators) username unused, where username = the given one or the
    part of the email before '@'.  Then the user, and a creator profile or a
    brand profile (company name or the user's name); avatar from the name.

    Emails and usernames compare case-insensitively, against existing rows
    and against commands accepted earlier in the batch.  A username clash
    rejects the whole command (the reference writes the user row before the
    profile insert fails; we keep the batch atomic — a deliberate
    difference).  The password itself is not handled here."""
    c = cmds.withColumn("_ek", F.lower("email")).withColumn(
        "_uname", F.when(col_truthy("username"), F.col("username")).otherwise(F.split(F.col("email"), "@")[0]))
    c = c.withColumn("_uk", F.when(F.col("role") == "creator", F.lower("_uname")))
    used_e = m["users"].select(F.lower("email").alias("_ue")).distinct().withColumn("_e_used", F.lit(True))
    used_u = (m["creator_profiles"].select(F.lower("username").alias("_uu")).distinct()
              .withColumn("_u_used", F.lit(True)))
    c = (c.join(used_e, F.col("_ek") == F.col("_ue"), "left").join(used_u, F.col("_uk") == F.col("_uu"), "left")
          .withColumn("_e_used", F.coalesce("_e_used", F.lit(False)))
          .withColumn("_u_used", F.coalesce("_u_used", F.lit(False))))
    c = c.withColumn("_static", first_reason(
        (col_truthy("name") & col_truthy("email") & F.coalesce(F.col("password_given"), F.lit(False))
         & col_truthy("role"), "missing_fields"),
        (F.col("role").isin(*ROLES), "invalid_role")))
    cands = c.filter(F.col("_static").isNull() & ~F.col("_e_used") & ~F.col("_u_used"))
    acc = _accept_greedy(cands)
    first_e = acc.groupBy(F.col("_ek").alias("_ae")).agg(F.min("seq").alias("_e_seq"))
    first_u = acc.filter(F.col("_uk").isNotNull()).groupBy(F.col("_uk").alias("_au")).agg(F.min("seq").alias("_u_seq"))
    c = (c.join(first_e, F.col("_ek") == F.col("_ae"), "left").join(first_u, F.col("_uk") == F.col("_au"), "left")
          .join(acc.select(F.col("cmd_id").alias("_acc")), F.col("cmd_id") == F.col("_acc"), "left"))
    c = c.withColumn("reason", F.coalesce(
        F.col("_static"),
        F.when(F.col("_e_used") | (F.col("_e_seq") < F.col("seq")), F.lit("email_taken")),
        F.when(F.col("_u_used") | (F.col("_u_seq") < F.col("seq")), F.lit("username_taken")),
        F.when(F.col("_acc").isNull(), F.lit("not_accepted"))))
    ok = c.filter(F.col("reason").isNull()).withColumn("_uid", new_id("t01", "cmd_id"))
    users = ok.select(F.col("_uid").alias("id"), "name", "email", "role",
                      F.concat(F.lit(AVATAR_PREFIX), encode_uri_component(F.col("name"))).alias("avatar_url"),
                      batch_time(batch_ts).alias("created_at"))
    creators = ok.filter(F.col("role") == "creator").select(
        new_id("t01c", "cmd_id").alias("id"), F.col("_uid").alias("user_id"), F.col("_uname").alias("username"),
        F.lit(0).alias("verified"), F.lit("0.00").alias("rating"), F.lit("0.00").alias("collaboration_rating"),
        batch_time(batch_ts).alias("created_at"))
    brands = ok.filter(F.col("role") == "brand").select(
        new_id("t01b", "cmd_id").alias("id"), F.col("_uid").alias("user_id"),
        F.when(col_truthy("company_name"), F.col("company_name")).otherwise(F.col("name")).alias("company_name"),
        batch_time(batch_ts).alias("created_at"))
    return JobResult(tables={
        "users": m["users"].unionByName(conform(users, "users")),
        "creator_profiles": m["creator_profiles"].unionByName(conform(creators, "creator_profiles")),
        "brand_profiles": m["brand_profiles"].unionByName(conform(brands, "brand_profiles"))},
        rejects=rejects_of(c))


# ------------------------------------------------------------------ T2
PROVIDER_COLUMN = {"google": "google_id", "facebook": "facebook_id"}


def _resolve_rounds(logins: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The logins decided as if one after the other, and the users afterwards.

    logins: (cmd_id, seq, provider, _col, provider_id, _em); state: (uid, em,
    google_id, facebook_id, social_provider, made_by) of the users they may touch.

    A login touches its provider id, its email, and the users holding them now.
    One whose provider id is held only reads; any other writes (it links the id
    to the email's user, or creates a user).  Rounds decide what ``decidable``
    gives.
    """
    spark = logins.sparkSession
    checkpoint_dir(spark)
    state = state.checkpoint()
    undecided = logins.checkpoint()
    decided = None
    while not undecided.isEmpty():
        ids = state.select("uid", F.explode(F.array(
            F.struct(F.lit("google_id").alias("c"), F.col("google_id").alias("v")),
            F.struct(F.lit("facebook_id").alias("c"), F.col("facebook_id").alias("v")))).alias("k"))
        by_id = ids.filter("k.v is not null").select(F.col("uid").alias("_hp"), F.col("k.c").alias("_kc"), F.col("k.v").alias("_kv"))
        by_mail = state.select(F.col("uid").alias("_he"), F.col("em").alias("_ke"))
        u = (undecided.join(by_id, (F.col("_col") == F.col("_kc")) & (F.col("provider_id") == F.col("_kv")), "left")
                      .join(by_mail, F.col("_em") == F.col("_ke"), "left").drop("_kc", "_kv", "_ke"))
        u = u.withColumn("_w", F.col("_hp").isNull())
        touched = F.array(F.concat_ws(":", F.lit("p"), "_col", "provider_id"), F.concat(F.lit("e:"), F.col("_em")),
                          F.concat(F.lit("u:"), F.col("_hp")), F.concat(F.lit("u:"), F.col("_he")))
        now = decidable(u, touched)
        made = det_uuid(F.lit("t02"), F.col("cmd_id").cast("string"))
        now = now.select("cmd_id", "provider", "_col", "provider_id", "_em",
                         F.coalesce("_hp", "_he", made).alias("user_id"),
                         F.when(F.col("_hp").isNotNull(), "provider").when(F.col("_he").isNotNull(), "email")
                         .otherwise("created").alias("method")).checkpoint()
        decided = now if decided is None else decided.unionByName(now)
        links = now.filter("method = 'email'").select(F.col("user_id").alias("_lu"), F.col("_col").alias("_lc"),
                                                      F.col("provider_id").alias("_lv"), F.col("provider").alias("_lp"))
        new = now.filter("method = 'created'").select(
            F.col("user_id").alias("uid"),
            F.coalesce("_em", F.lower(F.concat("provider", F.lit("_"), "provider_id", F.lit("@noemail.local")))).alias("em"),
            F.when(F.col("_col") == "google_id", F.col("provider_id")).alias("google_id"),
            F.when(F.col("_col") == "facebook_id", F.col("provider_id")).alias("facebook_id"),
            F.col("provider").alias("social_provider"), F.col("cmd_id").alias("made_by"))
        pick = lambda c: F.when(F.col("_lc") == c, F.col("_lv")).otherwise(F.col(c)).alias(c)
        state = (state.join(links, F.col("uid") == F.col("_lu"), "left")
                      .select("uid", "em", pick("google_id"), pick("facebook_id"),
                              F.coalesce("_lp", "social_provider").alias("social_provider"), "made_by")
                      .unionByName(new)).checkpoint()
        undecided = undecided.join(now.select("cmd_id"), "cmd_id", "left_anti").checkpoint()
    return decided, state


def resolve_identities(m, logins: DataFrame, batch_ts) -> JobResult:
    """A social login resolves to (1) the user holding that provider id,
    else (2) the user with that email, whose provider id is then linked,
    else (3) a new creator with email ``provider_id@noemail.local`` when none
    is given and a creator profile named ``lower(name)`` with runs of spaces
    as '_' plus '_' and the first 8 characters of the new id.  Providers
    without an id column ('github') fail as in the reference.

    Logins of a batch take effect one after the other, by seq: links and users
    made by earlier ones are seen by later ones (``_resolve_rounds``)."""
    u = m["users"]
    c = logins.withColumn("_col", F.when(F.col("provider") == "google", "google_id")
                          .when(F.col("provider") == "facebook", "facebook_id"))
    c = c.withColumn("_em", F.when(col_truthy("email"), F.lower("email")))
    c = c.withColumn("reason", first_reason((F.col("_col").isNotNull(), "unknown_provider")))
    ok = c.filter(F.col("reason").isNull())
    state = u.select(F.col("id").alias("uid"), F.lower("email").alias("em"), "google_id", "facebook_id",
                     "social_provider", F.lit(None).cast(logins.schema["cmd_id"].dataType).alias("made_by"))
    given = ok.select(F.explode(F.array(F.concat_ws(":", "_col", "provider_id"), F.concat(F.lit("e:"), F.col("_em")),
                                        F.concat(F.lit("e:"), F.lower(F.concat("provider", F.lit("_"), "provider_id", F.lit("@noemail.local")))))).alias("k"))
    keys = state.select("uid", F.explode(F.array(F.concat(F.lit("google_id:"), "google_id"), F.concat(F.lit("facebook_id:"), "facebook_id"),
                                                 F.concat(F.lit("e:"), "em"))).alias("k"))
    near = keys.join(given.filter("k is not null").distinct(), "k", "left_semi").select("uid").distinct()
    decided, after = _resolve_rounds(ok.select("cmd_id", "seq", "provider", "_col", "provider_id", "_em"),
                                     state.join(near, "uid", "left_semi"))
    if decided is None:
        return JobResult(tables={"users": u, "creator_profiles": m["creator_profiles"]}, rejects=rejects_of(c),
                         outputs={"resolved": ok.select("cmd_id", F.lit("").alias("user_id"), F.lit("").alias("method"))})
    resolved = decided.select("cmd_id", "user_id", "method")
    creators = ok.join(decided.filter("method = 'created'").select(F.col("cmd_id").alias("_mc"), F.col("user_id").alias("_uid")),
                       F.col("cmd_id") == F.col("_mc"))
    new_users = creators.select(
        F.col("_uid").alias("id"), F.col("name"),
        F.when(col_truthy("email"), F.col("email")).otherwise(
            F.concat(F.col("provider"), F.lit("_"), F.col("provider_id"), F.lit("@noemail.local"))).alias("email"),
        F.lit("creator").alias("role"), "avatar_url", batch_time(batch_ts).alias("created_at"))
    users_all = u.unionByName(conform(new_users, "users"))
    s = after.select(F.col("uid").alias("_sid"), F.col("google_id").alias("_g"), F.col("facebook_id").alias("_f"),
                     F.col("social_provider").alias("_s"))
    values = {"google_id": "_g", "facebook_id": "_f", "social_provider": "_s"}
    j = users_all.join(s, users_all["id"] == F.col("_sid"), "left")
    users_out = j.select(*[
        F.when(F.col("_sid").isNotNull(), F.col(values[col])).otherwise(users_all[col]).alias(col)
        if col in values else users_all[col] for col in users_all.columns])
    profiles = creators.select(
        new_id("t02c", "cmd_id").alias("id"), F.col("_uid").alias("user_id"),
        F.concat(F.regexp_replace(F.lower(F.coalesce(F.when(col_truthy("name"), F.col("name")), F.lit("user"))),
                                  r"\s+", "_"), F.lit("_"), F.substring("_uid", 1, 8)).alias("username"),
        F.lit(0).alias("verified"), F.lit("0.00").alias("rating"), F.lit("0.00").alias("collaboration_rating"),
        batch_time(batch_ts).alias("created_at"))
    return JobResult(tables={"users": users_out,
                             "creator_profiles": m["creator_profiles"].unionByName(conform(profiles, "creator_profiles"))},
                     rejects=rejects_of(c), outputs={"resolved": resolved})


# ------------------------------------------------------------------ T21-T25
def send_messages(m, cmds: DataFrame, batch_ts) -> JobResult:
    """The sender must not be a creator → receiver and text given →
    sender, receiver and booking (when given) exist (foreign keys).  The
    receiver is notified 'New message from <sender email>' (the token the
    reference reads carries no name).  Order-free."""
    u = m["users"]
    snd = u.select(F.col("id").alias("_sid"), F.col("role").alias("_srole"), F.col("email").alias("_semail"))
    rcv = u.select(F.col("id").alias("_rid"))
    bk = m["bookings"].select(F.col("id").alias("_bk"))
    c = (cmds.join(snd, F.col("actor_user_id") == F.col("_sid"), "left")
             .join(rcv, F.col("receiver_id") == F.col("_rid"), "left")
             .join(bk, F.col("booking_id") == F.col("_bk"), "left"))
    c = c.withColumn("reason", first_reason(
        (F.coalesce(F.col("_srole") != "creator", F.lit(True)), "creator_cannot_send"),
        (col_truthy("receiver_id") & col_truthy("message"), "missing_fields"),
        (F.col("_sid").isNotNull(), "sender_not_found"),
        (F.col("_rid").isNotNull(), "receiver_not_found"),
        (~col_truthy("booking_id") | F.col("_bk").isNotNull(), "booking_not_found")))
    ok = c.filter(F.col("reason").isNull())
    rows = ok.select(new_id("t21", "cmd_id").alias("id"), F.col("actor_user_id").alias("sender_id"), "receiver_id",
                     F.when(col_truthy("booking_id"), F.col("booking_id")).alias("booking_id"), "message",
                     batch_time(batch_ts).alias("created_at"))
    ev = notify.events_frame(ok, event="message_sent", event_key=F.col("cmd_id"), user_id="receiver_id",
                             sender_label="_semail", created_at=batch_time(batch_ts))
    return JobResult(tables={"messages": m["messages"].unionByName(conform(rows, "messages"))},
                     rejects=rejects_of(c), notifications=notify.render(ev, "t21"))


def mark_notifications_read(m, cmds: DataFrame, batch_ts=None) -> JobResult:
    """``notification_id`` given → that notification if it is the
    actor's; none → all the actor's unread ones.  Marking is idempotent, so
    the batch is order-free: a flag per matched row."""
    one = cmds.filter(F.col("notification_id").isNotNull()).select(
        F.col("notification_id").alias("_nid"), F.col("actor_user_id").alias("_nu")).distinct()
    everyone = cmds.filter(F.col("notification_id").isNull()).select(F.col("actor_user_id").alias("_au")).distinct()
    n = m["notifications"]
    j = (n.join(one.withColumn("_h1", F.lit(True)), (n["id"] == F.col("_nid")) & (n["user_id"] == F.col("_nu")), "left")
          .join(everyone.withColumn("_h2", F.lit(True)), n["user_id"] == F.col("_au"), "left"))
    hit = F.coalesce(F.col("_h1"), F.lit(False)) | F.coalesce(F.col("_h2"), F.lit(False))
    out = j.select(*[F.when(hit, F.lit(True)).otherwise(n["is_read"]).alias("is_read") if col == "is_read"
                     else n[col] for col in n.columns])
    return JobResult(tables={"notifications": out}, rejects=rejects_of(cmds.withColumn("reason", F.lit(None))))


def _referring(m, t: str, fks: list, deleted: dict[str, DataFrame]) -> DataFrame:
    """``id`` of the rows of ``t`` whose keys ``fks`` name a deleted row, once for each such key.

    The deleted ids are distinct, so an inner join finds no reference twice.  (Spark
    would move a semi join below the dealing out, and deal only what it has found.)"""
    parents = list(dict.fromkeys(fk.parent for fk in fks))
    by = ["_pt", "_pv"] if len(parents) > 1 else ["_pv"]  # a constant is no join key: Spark would shuffle again
    keys = F.array(*[F.struct(F.lit(fk.parent).alias("_pt"), F.col(fk.column).alias("_pv")) for fk in fks])
    refs = m[t].select("id", F.explode(keys).alias("_k")).select("id", "_k._pt", "_k._pv").filter("_pv is not null")
    gone = reduce(DataFrame.unionByName, [deleted[p].select(F.lit(p).alias("_pt"), F.col("id").alias("_pv")) for p in parents])
    return m.dealt(t, refs.select("id", *by), *by, times=len(fks)).join(gone.select(*by), by).select("id")


def _look_up(m, t: str, df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``df`` (rows of ``t``) with ``_gone``: whether ``column`` is one of the distinct ``ids``.

    An outer join, as Spark moves an anti join below the dealing out.  Rows without a
    key are dealt by their other values, so they do not meet in one task."""
    keyed = (df.withColumn("_null", F.col(column).isNull())
               .withColumn(column, F.coalesce(F.col(column), F.xxhash64(*df.columns).cast("string"))))
    found = ids.select(F.col("id").alias("_gid"), F.lit(True).alias("_gone"))
    return (m.dealt(t, keyed, column).join(found, F.col(column) == F.col("_gid"), "left")
             .withColumn("_gone", F.coalesce(F.col("_gone") & ~F.col("_null"), F.lit(False)))
             .withColumn(column, F.when(~F.col("_null"), F.col(column))).drop("_null", "_gid"))


def cascade_delete(m, seeds: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Delete the ``seeds`` rows (table → DataFrame with ``id``) and follow
    the delete rules of every foreign key: CASCADE deletes children,
    SET NULL clears the key.  Tables are visited parents first (the key
    graph is acyclic); each deleted-id set is written below the checkpoint
    folder once so children reuse it instead of recomputing the chain, and
    takes its shuffle files with it (``stored``).  A
    table is read once for all its keys, and large ones are dealt to tasks by
    their rows (``Market.dealt``) before they are joined."""
    kept = run_folder(m.spark, "cascade")
    deleted: dict[str, DataFrame] = {}
    for t in delete_order():
        parts = []
        if t in seeds:
            parts.append(seeds[t].select("id"))
        fks = [fk for fk in FOREIGN_KEYS if fk.table == t and fk.on_delete == "cascade" and fk.parent in deleted]
        if fks:
            parts.append(_referring(m, t, fks, deleted))
        if parts:
            d = reduce(DataFrame.unionByName, parts)
            deleted[t] = m.merged(t, stored(m.dealt(t, d, "id").distinct(), f"{kept}/{t}"))
    out: dict[str, DataFrame] = {}
    for t in TABLES:
        df = m[t]
        changed = False
        if t in deleted:
            df = _look_up(m, t, df, "id", deleted[t]).filter(~F.col("_gone")).drop("_gone")
            changed = True
        for fk in FOREIGN_KEYS:
            if fk.table == t and fk.on_delete == "set_null" and fk.parent in deleted:
                df = (_look_up(m, t, df, fk.column, deleted[fk.parent])
                      .withColumn(fk.column, F.when(~F.col("_gone"), F.col(fk.column))).drop("_gone"))
                changed = True
        if changed:
            out[t] = df
    return out


def delete_users(m, cmds: DataFrame, batch_ts) -> JobResult:
    """T23 (admin): delete users with the full CASCADE / SET NULL closure and
    write 'Deleted user <id>' per command (even when no such user exists,
    as in the reference)."""
    tables = cascade_delete(m, {"users": cmds.select(F.col("user_id").alias("id")).distinct()})
    actions = cmds.select(F.lit("user_deleted").alias("event"), F.col("cmd_id").cast("string").alias("event_key"),
                          F.col("actor_user_id").alias("actor"), F.col("user_id").alias("ref_id"),
                          F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("title_text"),
                          batch_time(batch_ts).alias("created_at"))
    return JobResult(tables=tables, rejects=rejects_of(cmds.withColumn("reason", F.lit(None))),
                     audit=notify.audit(actions, "t23"))


def change_roles(m, cmds: DataFrame, batch_ts) -> JobResult:
    """T24 (admin): no validation in the handler, but the ENUM column
    rejects other roles.  Last role per user wins; an audit row per
    accepted command, even for an unknown user id (the update simply
    matches nothing)."""
    c = cmds.withColumn("reason", first_reason((F.col("role").isin(*ROLES), "enum")))
    ok = c.filter(F.col("reason").isNull())
    last = last_by(ok, "user_id", "seq", ["role"]).select(F.col("user_id").alias("id"), "role")
    actions = ok.select(F.lit("role_changed").alias("event"), F.col("cmd_id").cast("string").alias("event_key"),
                        F.col("actor_user_id").alias("actor"), F.col("user_id").alias("ref_id"),
                        F.col("role").alias("note"), F.lit(None).cast("string").alias("title_text"),
                        batch_time(batch_ts).alias("created_at"))
    return JobResult(tables={"users": update_by_key(m["users"], last, "id", ["role"])}, rejects=rejects_of(c),
                     audit=notify.audit(actions, "t24"))


def verify_creators(m, cmds: DataFrame, batch_ts) -> JobResult:
    """T25 (admin): set verified to 1 or 0 (last command per profile wins),
    audit 'Verified|Unverified creator profile <id>' per command, and notify
    the creator when the profile exists."""
    c = cmds.withColumn("_v", F.coalesce(F.col("verified"), F.lit(False)))
    last = last_by(c.withColumn("verified_int", F.col("_v").cast("int")), "creator_profile_id", "seq",
                   ["verified_int"]).select(F.col("creator_profile_id").alias("id"),
                                            F.col("verified_int").alias("verified"))
    profiles = update_by_key(m["creator_profiles"], last, "id", ["verified"])
    actions = c.select(F.when(F.col("_v"), "creator_verified").otherwise("creator_unverified").alias("event"),
                       F.col("cmd_id").cast("string").alias("event_key"), F.col("actor_user_id").alias("actor"),
                       F.col("creator_profile_id").alias("ref_id"), F.lit(None).cast("string").alias("note"),
                       F.lit(None).cast("string").alias("title_text"), batch_time(batch_ts).alias("created_at"))
    cp = m["creator_profiles"].select(F.col("id").alias("_cp"), F.col("user_id").alias("_cpu"))
    who = c.join(cp, F.col("creator_profile_id") == F.col("_cp"))
    ev = notify.events_frame(who, event=F.when(F.col("_v"), "creator_verified").otherwise("creator_unverified"),
                             event_key=F.col("cmd_id"), user_id="_cpu", created_at=batch_time(batch_ts))
    return JobResult(tables={"creator_profiles": profiles}, rejects=rejects_of(c.withColumn("reason", F.lit(None))),
                     notifications=notify.render(ev, "t25"), audit=notify.audit(actions, "t25"))
