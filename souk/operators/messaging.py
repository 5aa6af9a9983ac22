"""Messages, notifications and reviews (Q30-Q34)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.frame import order_if_keyed, top_n_per_key


def booking_thread(m, booking_id: str | None = None) -> DataFrame:
    """Q30: a booking's messages, oldest first, with the sender's name and avatar."""
    msg = m["messages"].filter(F.col("booking_id").isNotNull())
    if booking_id is not None:
        msg = msg.filter(F.col("booking_id") == booking_id)
    msg = msg.alias("m")
    u = m["users"].alias("u")
    return (msg.join(u, F.col("m.sender_id") == F.col("u.id"))
               .select("m.*", F.col("u.name").alias("sender_name"), F.col("u.avatar_url").alias("sender_avatar"))
               .transform(lambda d: order_if_keyed(d, booking_id, "created_at", "id")))


def inbox(m, user_id: str | None = None, n: int = 100) -> DataFrame:
    """Q31: the ``n`` newest messages a user sent or received, with both names.

    Only messages whose two parties exist count, so they are joined before the
    limit.  Slim rows (ids and time) are ranked; the text joins the winners.
    Set-wide, each message is emitted once per distinct party (at most two
    rows) and the ranking window becomes a WindowGroupLimit that trims before
    the shuffle.  For one user the OR filter is pushed to the scan instead."""
    msg = m["messages"]
    if user_id is not None:
        msg = msg.filter((F.col("sender_id") == user_id) | (F.col("receiver_id") == user_id))
    ids = m["users"].select(F.col("id").alias("_uid"))
    slim = msg.filter(F.col("sender_id").isNotNull() & F.col("receiver_id").isNotNull()).select(
        "id", "sender_id", "receiver_id", "created_at")
    slim = (slim.join(ids, F.col("sender_id") == F.col("_uid"), "left_semi")
                .join(ids, F.col("receiver_id") == F.col("_uid"), "left_semi"))
    if user_id is not None:
        owned = slim.withColumn("inbox_user_id", F.lit(user_id))
    else:
        owned = slim.withColumn("inbox_user_id", F.explode(F.array_distinct(F.array("sender_id", "receiver_id"))))
    top = top_n_per_key(owned, "inbox_user_id", [F.col("created_at").desc(), F.col("id")], n).select(
        F.col("id").alias("_mid"), "inbox_user_id")
    u = m["users"].alias("u")
    u2 = m["users"].alias("u2")
    full = top.join(msg, F.col("_mid") == F.col("id")).select(*msg.columns, "inbox_user_id").alias("m")
    return (full.join(u, F.col("m.sender_id") == F.col("u.id"))
                .join(u2, F.col("m.receiver_id") == F.col("u2.id"))
                .select("m.*", F.col("u.name").alias("sender_name"), F.col("u.avatar_url").alias("sender_avatar"),
                        F.col("u2.name").alias("receiver_name"), F.col("u2.avatar_url").alias("receiver_avatar"))
                .transform(lambda d: order_if_keyed(d, user_id, F.col("created_at").desc(), "id")))


def notification_feed(m, user_id: str | None = None, n: int = 50) -> DataFrame:
    """Q32: the ``n`` newest notifications per user."""
    nt = m["notifications"]
    if user_id is not None:
        nt = nt.filter(F.col("user_id") == user_id)
    return (top_n_per_key(nt, "user_id", [F.col("created_at").desc(), F.col("id")], n)
            .transform(lambda d: order_if_keyed(d, user_id, F.col("created_at").desc(), "id")))


def creator_reviews(m, creator_id: str | None = None) -> DataFrame:
    """Q33: reviews of a creator with the brand user's name and avatar, newest first."""
    r = m["reviews"]
    if creator_id is not None:
        r = r.filter(F.col("creator_id") == creator_id)
    r = r.alias("r")
    bp = m["brand_profiles"].alias("bp")
    u = m["users"].alias("u")
    return (r.join(bp, F.col("r.brand_id") == F.col("bp.id"))
             .join(u, F.col("bp.user_id") == F.col("u.id"))
             .select("r.*", F.col("u.name").alias("brand_name"), F.col("u.avatar_url").alias("brand_avatar"))
             .transform(lambda d: order_if_keyed(d, creator_id, F.col("created_at").desc(), "id")))


def brand_reviews(m, brand_id: str | None = None) -> DataFrame:
    """Q34: reviews a brand wrote, with creator name, avatar, username and booking ref."""
    r = m["reviews"]
    if brand_id is not None:
        r = r.filter(F.col("brand_id") == brand_id)
    r = r.alias("r")
    cp = m["creator_profiles"].alias("cp")
    u = m["users"].alias("u")
    b = m["bookings"].alias("b")
    return (r.join(cp, F.col("r.creator_id") == F.col("cp.id"))
             .join(u, F.col("cp.user_id") == F.col("u.id"))
             .join(b, F.col("r.booking_id") == F.col("b.id"))
             .select("r.*", F.col("u.name").alias("creator_name"), F.col("u.avatar_url").alias("creator_avatar"),
                     F.col("cp.username").alias("creator_username"), F.col("b.id").alias("booking_id_ref"))
             .transform(lambda d: order_if_keyed(d, brand_id, F.col("created_at").desc(), "id")))
