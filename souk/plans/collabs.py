"""Review and collaboration jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.frame import first_reason, last_by, update_by_key
from souk.functions.text import col_truthy, js_not_blank
from souk.operators import notify, ratings
from souk.plans.base import JobResult, batch_time, new_id, rejects_of, with_profile
from souk.sources.tables import conform


def _first_winner(c: DataFrame, keys: list[str], eligible) -> DataFrame:
    """Per key, the smallest seq among ``eligible`` rows (first-wins
    uniqueness inside a batch), joined back as ``_win_seq``.  A grouped
    ``min`` is a partial aggregate, so a hot key costs one row per task."""
    w = c.filter(eligible).groupBy(*[F.col(k).alias(f"_w_{k}") for k in keys]).agg(F.min("seq").alias("_win_seq"))
    cond = None
    for k in keys:
        e = F.col(k) == F.col(f"_w_{k}")
        cond = e if cond is None else cond & e
    return c.join(w, cond, "left").drop(*[f"_w_{k}" for k in keys])


def submit_reviews(m, cmds: DataFrame, batch_ts) -> JobResult:
    """Booking id and rating given → actor is a brand → the brand's own
    completed booking → not yet reviewed → rating within 1..5 (CHECK).
    The first valid command per booking wins; creator ratings of touched
    creators are then recomputed (M3)."""
    c = with_profile(cmds, m, "brand")
    b = m["bookings"].select(F.col("id").alias("_bid"), F.col("brand_id").alias("_bbrand"),
                             F.col("creator_id").alias("_bcreator"), F.col("status").alias("_bstatus"))
    had = m["reviews"].select(F.col("booking_id").alias("_rb")).distinct().withColumn("_had", F.lit(True))
    c = (c.join(b, (F.col("booking_id") == F.col("_bid")) & (F.col("_bbrand") == F.col("brand_profile_id"))
                & (F.col("_bstatus") == "completed"), "left")
          .join(had, F.col("booking_id") == F.col("_rb"), "left")
          .withColumn("_had", F.coalesce("_had", F.lit(False))))
    c = c.withColumn("_static", first_reason(
        (col_truthy("booking_id") & F.coalesce(F.col("rating") != 0, F.lit(False)), "missing_fields"),
        (F.col("brand_profile_id").isNotNull(), "not_brand"),
        (F.col("_bid").isNotNull(), "booking_not_completed")))
    rating_ok = F.col("rating").between(1, 5)
    c = _first_winner(c, ["booking_id"], F.col("_static").isNull() & ~F.col("_had") & rating_ok)
    c = c.withColumn("reason", F.coalesce(
        F.col("_static"),
        F.when(F.col("_had") | (F.col("_win_seq") < F.col("seq")), F.lit("already_reviewed")),
        F.when(~rating_ok, F.lit("rating_range"))))
    ok = c.filter(F.col("reason").isNull())
    rows = ok.select(new_id("t15", "cmd_id").alias("id"), "booking_id", F.col("brand_profile_id").alias("brand_id"),
                     F.col("_bcreator").alias("creator_id"), F.col("rating").cast("int").alias("rating"), "comment",
                     batch_time(batch_ts).alias("created_at"))
    reviews = m["reviews"].unionByName(conform(rows, "reviews"))
    after = m.replace(reviews=reviews)
    profiles = ratings.refresh_ratings(after, rows)
    return JobResult(tables={"reviews": reviews, "creator_profiles": profiles}, rejects=rejects_of(c))


def submit_collab_reviews(m, cmds: DataFrame, batch_ts) -> JobResult:
    """Ids and rating given → actor is a creator → a participant of the
    collaboration → not reviewing themself → collaboration completed; then
    the insert: rating within 1..5, the (collaboration, reviewer, reviewee)
    triple unused (first valid command wins), reviewee exists.  The reviewee
    need not be a participant.  Recomputes collaboration ratings (M2 for the
    touched creators) and notifies the reviewee."""
    c = with_profile(cmds, m, "creator")
    part = m["collaboration_participants"].select(F.col("collaboration_id").alias("_pc"),
                                                  F.col("creator_id").alias("_pcr")).distinct()
    col = m["collaborations"].select(F.col("id").alias("_cid"), F.col("status").alias("_cstatus"))
    had = (m["collaboration_reviews"].select(F.col("collaboration_id").alias("_hc"), F.col("reviewer_id").alias("_hr"),
                                             F.col("creator_id").alias("_ht")).distinct()
           .withColumn("_had", F.lit(True)))
    rev = m["creator_profiles"].select(F.col("id").alias("_tid"), F.col("user_id").alias("_tuser"))
    c = (c.join(part, (F.col("collaboration_id") == F.col("_pc")) & (F.col("creator_profile_id") == F.col("_pcr")), "left")
          .join(col, F.col("collaboration_id") == F.col("_cid"), "left")
          .join(had, (F.col("collaboration_id") == F.col("_hc")) & (F.col("creator_profile_id") == F.col("_hr"))
                & (F.col("creator_id") == F.col("_ht")), "left")
          .join(rev, F.col("creator_id") == F.col("_tid"), "left")
          .withColumn("_had", F.coalesce("_had", F.lit(False))))
    c = c.withColumn("_static", first_reason(
        (col_truthy("collaboration_id") & col_truthy("creator_id") & F.coalesce(F.col("rating") != 0, F.lit(False)),
         "missing_fields"),
        (F.col("creator_profile_id").isNotNull(), "not_creator"),
        (F.col("_pc").isNotNull(), "not_participant"),
        (F.col("creator_id") != F.col("creator_profile_id"), "self_review"),
        (F.col("_cstatus") == "completed", "not_completed")))
    rating_ok = F.col("rating").between(1, 5)
    c = _first_winner(c, ["collaboration_id", "creator_profile_id", "creator_id"],
                      F.col("_static").isNull() & rating_ok & ~F.col("_had") & F.col("_tid").isNotNull())
    c = c.withColumn("reason", F.coalesce(
        F.col("_static"),
        F.when(~rating_ok, F.lit("rating_range")),
        F.when(F.col("_had") | (F.col("_win_seq") < F.col("seq")), F.lit("already_reviewed")),
        F.when(F.col("_tid").isNull(), F.lit("creator_not_found"))))
    ok = c.filter(F.col("reason").isNull())
    rows = ok.select(new_id("t26", "cmd_id").alias("id"), "collaboration_id",
                     F.col("creator_profile_id").alias("reviewer_id"), "creator_id",
                     F.col("rating").cast("int").alias("rating"), "comment", batch_time(batch_ts).alias("created_at"))
    reviews = m["collaboration_reviews"].unionByName(conform(rows, "collaboration_reviews"))
    after = m.replace(collaboration_reviews=reviews)
    profiles = ratings.refresh_ratings(after, rows, target="collaboration_rating",
                                       review_table="collaboration_reviews")
    ev = notify.events_frame(ok, event="collab_review", event_key=F.col("cmd_id"), user_id="_tuser",
                             rating="rating", created_at=batch_time(batch_ts))
    return JobResult(tables={"collaboration_reviews": reviews, "creator_profiles": profiles}, rejects=rejects_of(c),
                     notifications=notify.render(ev, "t26"))


def create_collaborations(m, cmds: DataFrame, batch_ts) -> JobResult:
    """Title given → actor is a creator; the collaboration is inserted
    (followers_required falls back to 0) and the owner joins as 'host'.
    Order-free."""
    c = with_profile(cmds, m, "creator")
    c = c.withColumn("reason", first_reason((col_truthy("title"), "missing_title"),
                                            (F.col("creator_profile_id").isNotNull(), "not_creator")))
    ok = c.filter(F.col("reason").isNull()).withColumn("_cid", new_id("t16", "cmd_id"))
    rows = ok.select(F.col("_cid").alias("id"), F.col("creator_profile_id").alias("creator_id"), "title",
                     "description", "platform", "category", "location",
                     F.when(F.coalesce(F.col("followers_required") != 0, F.lit(False)), F.col("followers_required"))
                      .otherwise(F.lit(0)).cast("int").alias("followers_required"),
                     "collaboration_type", F.lit("open").alias("status"), batch_time(batch_ts).alias("created_at"))
    hosts = ok.select(new_id("t16h", "cmd_id").alias("id"), F.col("_cid").alias("collaboration_id"),
                      F.col("creator_profile_id").alias("creator_id"), F.lit("host").alias("role"),
                      batch_time(batch_ts).alias("joined_at"))
    return JobResult(tables={
        "collaborations": m["collaborations"].unionByName(conform(rows, "collaborations")),
        "collaboration_participants": m["collaboration_participants"].unionByName(
            conform(hosts, "collaboration_participants"))}, rejects=rejects_of(c))


def _owner_user(m) -> DataFrame:
    return m["creator_profiles"].select(F.col("id").alias("_oid"), F.col("user_id").alias("owner_user_id"))


def apply_to_collaborations(m, cmds: DataFrame, batch_ts) -> JobResult:
    """Actor is a creator → collaboration exists → it is open → not the
    actor's own → not applied before (first command per collaboration and
    applicant wins).  Inserts a pending request and notifies the owner."""
    c = with_profile(cmds, m, "creator")
    col = m["collaborations"].select(F.col("id").alias("_cid"), F.col("status").alias("_cstatus"),
                                     F.col("creator_id").alias("_owner"), F.col("title").alias("_title"))
    had = (m["collaboration_requests"].select(F.col("collaboration_id").alias("_hc"), F.col("creator_id").alias("_hr"))
           .distinct().withColumn("_had", F.lit(True)))
    c = (c.join(col, F.col("collaboration_id") == F.col("_cid"), "left")
          .join(had, (F.col("collaboration_id") == F.col("_hc")) & (F.col("creator_profile_id") == F.col("_hr")), "left")
          .withColumn("_had", F.coalesce("_had", F.lit(False))))
    c = c.withColumn("_static", first_reason(
        (F.col("creator_profile_id").isNotNull(), "not_creator"),
        (F.col("_cid").isNotNull(), "not_found"),
        (F.col("_cstatus") == "open", "not_open"),
        (F.col("_owner") != F.col("creator_profile_id"), "own_collaboration")))
    c = _first_winner(c, ["collaboration_id", "creator_profile_id"], F.col("_static").isNull() & ~F.col("_had"))
    c = c.withColumn("reason", F.coalesce(F.col("_static"), F.when(
        F.col("_had") | (F.col("_win_seq") < F.col("seq")), F.lit("already_applied"))))
    ok = c.filter(F.col("reason").isNull())
    rows = ok.select(new_id("t17", "cmd_id").alias("id"), "collaboration_id",
                     F.col("creator_profile_id").alias("creator_id"), F.lit("pending").alias("status"),
                     F.when(col_truthy("message"), F.col("message")).alias("message"),
                     batch_time(batch_ts).alias("created_at"))
    who = ok.join(_owner_user(m), F.col("_owner") == F.col("_oid"))
    ev = notify.events_frame(who, event="collab_request", event_key=F.col("cmd_id"), user_id="owner_user_id",
                             ref_id="collaboration_id", title_text="_title", created_at=batch_time(batch_ts))
    return JobResult(tables={"collaboration_requests": m["collaboration_requests"].unionByName(
        conform(rows, "collaboration_requests"))}, rejects=rejects_of(c), notifications=notify.render(ev, "t17"))


ACCEPT_MESSAGE = ('Your collaboration request for "{title}" was accepted! '
                  "Let's discuss the details here.")


def decide_requests(m, cmds: DataFrame, batch_ts) -> JobResult:
    """``decision`` 'accept' or 'reject' by the owner.  Accept: owner →
    the request belongs to the collaboration; the request becomes accepted,
    the collaboration in_progress, the applicant joins as 'collaborator'
    (insert-ignore on (collaboration, creator)), a direct message and a
    notification go to the applicant.  Reject: owner; the request (if it
    belongs to the collaboration) becomes rejected.  Last decision per
    request wins."""
    c = with_profile(cmds, m, "creator")
    col = m["collaborations"].select(F.col("id").alias("_cid"), F.col("creator_id").alias("_owner"),
                                     F.col("title").alias("_title"))
    req = m["collaboration_requests"].select(F.col("id").alias("_rid"), F.col("collaboration_id").alias("_rc"),
                                             F.col("creator_id").alias("_applicant"))
    c = (c.join(col, (F.col("collaboration_id") == F.col("_cid")) & (F.col("_owner") == F.col("creator_profile_id")),
                "left")
          .join(req, (F.col("request_id") == F.col("_rid")) & (F.col("_rc") == F.col("collaboration_id")), "left"))
    is_acc = F.col("decision") == "accept"
    c = c.withColumn("reason", first_reason(
        (F.col("decision").isin("accept", "reject"), "invalid_decision"),
        (F.col("_cid").isNotNull(), "not_owner"),
        (~is_acc | F.col("_rid").isNotNull(), "request_not_found")))
    ok = c.filter(F.col("reason").isNull())
    eff = ok.filter(F.col("_rid").isNotNull()).withColumn(
        "status", F.when(is_acc, F.lit("accepted")).otherwise(F.lit("rejected")))
    last = last_by(eff, "request_id", "seq", ["status"]).select(F.col("request_id").alias("id"), "status")
    requests = update_by_key(m["collaboration_requests"], last, "id", ["status"])
    acc = ok.filter(is_acc)
    started = acc.select(F.col("collaboration_id").alias("id"), F.lit("in_progress").alias("status")).distinct()
    collabs = update_by_key(m["collaborations"], started, "id", ["status"])
    cp = m["collaboration_participants"]
    joins = (acc.select("collaboration_id", F.col("_applicant").alias("creator_id")).distinct()
             .join(cp.select(F.col("collaboration_id").alias("_jc"), F.col("creator_id").alias("_jr")),
                   (F.col("collaboration_id") == F.col("_jc")) & (F.col("creator_id") == F.col("_jr")), "left_anti")
             .select(new_id("t18", "collaboration_id", "creator_id").alias("id"), "collaboration_id", "creator_id",
                     F.lit("collaborator").alias("role"), batch_time(batch_ts).alias("joined_at")))
    participants = cp.unionByName(conform(joins, "collaboration_participants"))
    app = m["creator_profiles"].select(F.col("id").alias("_aid"), F.col("user_id").alias("applicant_user_id"))
    who = acc.join(app, F.col("_applicant") == F.col("_aid"))
    pre, post = ACCEPT_MESSAGE.split("{title}")
    msgs = who.select(new_id("t18m", "cmd_id").alias("id"), F.col("actor_user_id").alias("sender_id"),
                      F.col("applicant_user_id").alias("receiver_id"), F.lit(None).cast("string").alias("booking_id"),
                      F.concat(F.lit(pre), F.col("_title"), F.lit(post)).alias("message"),
                      batch_time(batch_ts).alias("created_at"))
    ev = notify.events_frame(who, event="collab_accepted", event_key=F.col("cmd_id"), user_id="applicant_user_id",
                             ref_id="collaboration_id", title_text="_title", created_at=batch_time(batch_ts))
    return JobResult(tables={"collaboration_requests": requests, "collaborations": collabs,
                             "collaboration_participants": participants,
                             "messages": m["messages"].unionByName(conform(msgs, "messages"))},
                     rejects=rejects_of(c), notifications=notify.render(ev, "t18"))


def complete_collaborations(m, cmds: DataFrame, batch_ts) -> JobResult:
    """Owner only; the collaboration becomes completed and every
    participant except the owner is notified (N2 fan-out), per command."""
    c = with_profile(cmds, m, "creator")
    col = m["collaborations"].select(F.col("id").alias("_cid"), F.col("creator_id").alias("_owner"),
                                     F.col("title").alias("_title"))
    c = c.join(col, (F.col("collaboration_id") == F.col("_cid")) & (F.col("_owner") == F.col("creator_profile_id")),
               "left")
    c = c.withColumn("reason", first_reason((F.col("_cid").isNotNull(), "not_owner")))
    ok = c.filter(F.col("reason").isNull())
    done = ok.select(F.col("collaboration_id").alias("id"), F.lit("completed").alias("status")).distinct()
    collabs = update_by_key(m["collaborations"], done, "id", ["status"])
    fan = notify.fan_out(m, ok, collab_col="collaboration_id", exclude_creator_col="creator_profile_id")
    ev = notify.events_frame(fan, event="collab_completed", event_key=F.col("cmd_id"), user_id="user_id",
                             ref_id="collaboration_id", title_text="_title", created_at=batch_time(batch_ts))
    return JobResult(tables={"collaborations": collabs}, rejects=rejects_of(c), notifications=notify.render(ev, "t19"))


def post_collab_messages(m, cmds: DataFrame, batch_ts) -> JobResult:
    """Non-blank message → actor has a creator profile → is a
    participant; the message is stored and every other participant (by
    user) is notified (N2 fan-out).  Order-free."""
    c = with_profile(cmds, m, "creator")
    part = m["collaboration_participants"].select(F.col("collaboration_id").alias("_pc"),
                                                  F.col("creator_id").alias("_pcr")).distinct()
    c = c.join(part, (F.col("collaboration_id") == F.col("_pc")) & (F.col("creator_profile_id") == F.col("_pcr")),
               "left")
    c = c.withColumn("reason", first_reason(
        (js_not_blank("message"), "empty_message"),
        (F.col("creator_profile_id").isNotNull(), "no_profile"),
        (F.col("_pc").isNotNull(), "not_participant")))
    ok = c.filter(F.col("reason").isNull())
    rows = ok.select(new_id("t20", "cmd_id").alias("id"), "collaboration_id",
                     F.col("actor_user_id").alias("sender_id"), "message", batch_time(batch_ts).alias("created_at"))
    fan = notify.fan_out(m, ok, collab_col="collaboration_id", exclude_user_col="actor_user_id")
    ev = notify.events_frame(fan, event="collab_message", event_key=F.col("cmd_id"), user_id="user_id",
                             ref_id="collaboration_id", created_at=batch_time(batch_ts))
    return JobResult(tables={"collaboration_messages": m["collaboration_messages"].unionByName(
        conform(rows, "collaboration_messages"))}, rejects=rejects_of(c), notifications=notify.render(ev, "t20"))
