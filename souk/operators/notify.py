"""Notifications and audit rows.

Jobs emit *events* (one row per thing to tell someone); ``render`` turns
them into canonical notification rows with one CASE over the event type,
all inside the JVM.  ``fan_out`` replaces the reference's one-by-one loop
over participants with an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.ids import det_uuid
from souk.functions.text import locale_amount

EVENT_COLS = ["event", "event_key", "user_id", "ref_id", "title_text", "amount", "note", "rating",
              "sender_label", "created_at"]

# Notification templates of the reference, per event type:
# (title or None for the default 'Notification', message pattern, link pattern).
# {ref} = booking / collaboration / withdrawal id, {title} = collaboration title,
# {amount} = amount as toLocaleString, {note} = note, {rating} = rating,
# {sender} = sender label.
TEMPLATES: dict[str, tuple[str | None, str, str | None]] = {
    "booking_created": ("New Booking Request",
                        "You have a new booking request from a brand. Booking #{ref}", "/creator/bookings"),
    "booking_completed": ("Payment Released",
                          "Booking #{ref} is completed and payment has been released!", "/creator/earnings"),
    "message_sent": ("New Message", "New message from {sender}", "/brand/messages"),
    "collab_request": ("New Collaboration Request", 'New collaboration request for "{title}"',
                       "/collaboration/{ref}"),
    "collab_accepted": ("Collaboration Accepted",
                        'Your collaboration request for "{title}" was accepted! 🎉', "/collaboration/{ref}"),
    "collab_completed": ("Collaboration Completed",
                         'Collaboration "{title}" has been marked complete. Please leave a review!',
                         "/collaboration/{ref}"),
    "collab_message": ("New Collaboration Message", "New message in collaboration chat", "/collaboration/{ref}"),
    "creator_verified": (None, "Your profile has been verified! ✅", None),
    "creator_unverified": (None, "Your profile verification was revoked.", None),
    "escrow_released": (None, "Payment of ₹{amount} released for booking #{ref}. 🎉", None),
    "payment_received": (None, "Payment received for booking #{ref}. Please submit your content.", None),
    "withdrawal_requested": (None, "Withdrawal request of ₹{amount} submitted. "
                                   "We'll process it within 2-3 business days.", None),
    "withdrawal_approved": (None, "✅ Your withdrawal of ₹{amount} has been approved! "
                                  "Funds will be transferred within 1-2 business days.", None),
    "withdrawal_rejected": (None, "❌ Your withdrawal request of ₹{amount} was rejected. {note}", None),
    "content_submitted": (None, "Creator has submitted content for Booking #{ref}. Please review it.", None),
    "content_rejected": (None, "Your content for Booking #{ref} was rejected. Reason: {note}. Please resubmit.",
                         None),
    "collab_review": (None, "You received a {rating}⭐ collaboration review!", None),
}

# Audit texts of the reference's admin actions.
AUDIT_TEMPLATES: dict[str, str] = {
    "role_changed": "Changed role of user {ref} to {note}",
    "user_deleted": "Deleted user {ref}",
    "creator_verified": "Verified creator profile {ref}",
    "creator_unverified": "Unverified creator profile {ref}",
    "escrow_released": "Released escrow payment for booking #{ref}",
    "withdrawal_approved": "Approved withdrawal #{ref} of ₹{note} for creator #{title}",
}

DEFAULT_TITLE = "Notification"


def _fill(pattern: str | None, fields: dict[str, Column]) -> Column:
    """A template string with {slots} as a ``concat`` of literals and columns."""
    if pattern is None:
        return F.lit(None).cast("string")
    parts, rest = [], pattern
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            parts.append(F.lit(pre))
        parts.append(F.coalesce(fields[name], F.lit("")))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def events_frame(df: DataFrame, **cols) -> DataFrame:
    """Shape job rows into the event columns; missing ones become nulls."""
    out = []
    for c in EVENT_COLS:
        v = cols.get(c)
        if v is None:
            v = F.lit(None)
        elif isinstance(v, str):
            v = F.lit(v) if c == "event" else F.col(v)
        ty = {"created_at": "timestamp_ntz", "amount": "double"}.get(c, "string")
        out.append(v.cast(ty).alias(c))
    return df.select(*out)


def render(events: DataFrame, job: str) -> DataFrame:
    """Events → canonical notification rows (title defaults to
    'Notification', is_read false)."""
    fields = {"ref": F.col("ref_id"), "title": F.col("title_text"), "amount": locale_amount(F.col("amount")),
              "note": F.col("note"), "rating": F.col("rating"), "sender": F.col("sender_label")}
    title = msg = link = None
    for ev, (t, mp, lp) in TEMPLATES.items():
        cond = F.col("event") == ev
        tv = F.lit(t if t is not None else DEFAULT_TITLE)
        mv, lv = _fill(mp, fields), _fill(lp, fields)
        title = F.when(cond, tv) if title is None else title.when(cond, tv)
        msg = F.when(cond, mv) if msg is None else msg.when(cond, mv)
        link = F.when(cond, lv) if link is None else link.when(cond, lv)
    return events.select(
        det_uuid(F.lit(job), F.lit("n"), F.col("event_key"), F.col("user_id")).alias("id"),
        "user_id", title.alias("title"), msg.alias("message"), link.alias("link"),
        F.lit(False).alias("is_read"), "created_at")


def _participants(m) -> tuple[DataFrame, DataFrame]:
    j = m["collaboration_participants"].select(F.col("collaboration_id").alias("_fo_c"),
                                               F.col("creator_id").alias("_fo_pc"))
    cp = m["creator_profiles"].select(F.col("id").alias("_fo_pcid"), F.col("user_id").alias("_fo_user"))
    return j, cp


def audience(m) -> DataFrame:
    """Whom ``fan_out`` tells: each participant of each collaboration with the user."""
    j, cp = _participants(m)
    return j.join(cp, F.col("_fo_pc") == F.col("_fo_pcid"))


#: Participants that ``packed`` puts into one row at most.
PACK_ROWS = 1024


def packed(who: DataFrame, tasks: int) -> DataFrame:
    """The users of an ``audience`` in few rows: those of a collaboration as one
    text, or several of ``PACK_ROWS`` at most.  A reader that needs few of the
    collaborations copies the others' texts unread."""
    d = who.filter("_fo_c is not null").repartition(tasks, "_fo_c").sortWithinPartitions("_fo_c")
    d = d.withColumn("_block", F.floor(F.monotonically_increasing_id() / PACK_ROWS))  # bounds a group, however large the collaboration
    return d.groupBy("_fo_c", "_block").agg(F.to_json(F.collect_list("_fo_user")).alias("_fo_users")).drop("_block")


def fan_out(m, events: DataFrame, collab_col: str = "ref_id", exclude_creator_col: str | None = None,
            exclude_user_col: str | None = None, who: DataFrame | None = None) -> DataFrame:
    """One event per participant of the collaboration, except the actor
    (by creator profile id or by user id).  An equi-join on the
    collaboration plus an inequality filter, not a loop.  who: the
    ``packed`` audience, if the caller keeps one; it knows users only."""
    if who is not None:
        if exclude_creator_col or not exclude_user_col:
            raise ValueError("a packed audience is told by user, except the actor")
        out = events.join(who, events[collab_col] == F.col("_fo_c"))
        out = out.withColumn("_fo_user", F.explode(F.from_json("_fo_users", "array<string>"))).drop("_fo_users")
    else:
        j, cp = _participants(m)
        out = (events.join(j, events[collab_col] == F.col("_fo_c"))
                     .join(cp, F.col("_fo_pc") == F.col("_fo_pcid")))
    if exclude_creator_col:
        out = out.filter(F.col("_fo_pc") != F.col(exclude_creator_col))
    if exclude_user_col:
        out = out.filter(F.col("_fo_user") != F.col(exclude_user_col))
    return out.withColumn("user_id", F.col("_fo_user")).drop("_fo_c", "_fo_pc", "_fo_pcid", "_fo_user")


def audit(actions: DataFrame, job: str) -> DataFrame:
    """Admin actions → admin_logs rows.  ``actions`` carries event,
    event_key, actor (admin user id), ref_id, note, title_text and created_at."""
    fields = {"ref": F.col("ref_id"), "note": F.col("note"), "title": F.col("title_text")}
    text = None
    for ev, pattern in AUDIT_TEMPLATES.items():
        cond = F.col("event") == ev
        text = F.when(cond, _fill(pattern, fields)) if text is None else text.when(cond, _fill(pattern, fields))
    return actions.select(det_uuid(F.lit(job), F.lit("a"), F.col("event_key")).alias("id"),
                          text.alias("action"), F.col("actor").alias("admin_id"), "created_at")
