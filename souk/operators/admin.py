"""Administrator reads (Q16-Q23)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.frame import order_if_keyed

USER_CARD = ["id", "name", "email", "role", "avatar_url", "created_at"]


def list_users(m) -> DataFrame:
    """Q16: users without the password column, newest first."""
    return m["users"].select(*USER_CARD).orderBy(F.col("created_at").desc(), F.col("id"))


def user_card(m, user_id: str | None = None) -> DataFrame:
    """Q16: one user's card (all users when no id is given)."""
    u = m["users"]
    if user_id is not None:
        u = u.filter(F.col("id") == user_id)
    return u.select(*USER_CARD)


def pending_creators(m) -> DataFrame:
    """Q17: unverified creator profiles with user name, email and avatar."""
    cp = m["creator_profiles"].filter(F.col("verified") == 0).alias("cp")
    u = m["users"].alias("u")
    return (cp.join(u, F.col("cp.user_id") == F.col("u.id"))
              .select("cp.*", "u.name", "u.email", "u.avatar_url")
              .orderBy(F.col("created_at").desc(), F.col("id")))


def transactions(m) -> DataFrame:
    """Q18: every payment with booking price and status, company, creator and
    escrow status, newest first."""
    p = m["payments"].alias("p")
    b = m["bookings"].alias("b")
    bp = m["brand_profiles"].alias("bp")
    cp = m["creator_profiles"].alias("cp")
    ew = m["escrow_wallet"].alias("ew")
    return (p.join(b, F.col("p.booking_id") == F.col("b.id"))
             .join(bp, F.col("b.brand_id") == F.col("bp.id"))
             .join(cp, F.col("b.creator_id") == F.col("cp.id"))
             .join(ew, F.col("ew.booking_id") == F.col("b.id"), "left")
             .select("p.*", F.col("b.price").alias("booking_price"), F.col("b.status").alias("booking_status"),
                     "bp.company_name", F.col("cp.username").alias("creator_username"),
                     F.col("ew.status").alias("escrow_status"))
             .orderBy(F.col("created_at").desc(), F.col("id")))


def platform_stats(m) -> DataFrame:
    """Q19: user, creator, brand and booking counts and completed revenue
    (0 when none) in one pass: the five inputs are unioned as tagged rows
    and folded by a single global aggregate with partial sums per task."""
    tagged = (
        m["users"].select(F.lit("u").alias("t"), F.lit(None).cast("decimal(12,2)").alias("amount"))
        .unionByName(m["creator_profiles"].select(F.lit("c").alias("t"), F.lit(None).cast("decimal(12,2)").alias("amount")))
        .unionByName(m["brand_profiles"].select(F.lit("b").alias("t"), F.lit(None).cast("decimal(12,2)").alias("amount")))
        .unionByName(m["bookings"].select(F.lit("k").alias("t"), F.lit(None).cast("decimal(12,2)").alias("amount")))
        .unionByName(m["payments"].filter(F.col("payment_status") == "completed")
                     .select(F.lit("p").alias("t"), F.col("amount")))
    )
    return tagged.agg(
        F.count_if(F.col("t") == "u").alias("total_users"),
        F.count_if(F.col("t") == "c").alias("total_creators"),
        F.count_if(F.col("t") == "b").alias("total_brands"),
        F.count_if(F.col("t") == "k").alias("total_bookings"),
        F.coalesce(F.sum("amount"), F.lit(Decimal("0.00"))).alias("total_revenue"),
    )


def _role_users(m, role: str, user_id: str | None):
    u = m["users"].filter(F.col("role") == role)
    if user_id is not None:
        u = u.filter(F.col("id") == user_id)
    return u.select(F.col("id").alias("user_id"))


def brand_booking_history(m, user_id: str | None = None) -> DataFrame:
    """Q20: bookings placed by a brand user; the creator join is LEFT."""
    who = _role_users(m, "brand", user_id).alias("w")
    bp = m["brand_profiles"].alias("bp")
    b = m["bookings"].alias("b")
    pp = m["promotion_packages"].alias("pp")
    cp = m["creator_profiles"].alias("cp")
    p = m["payments"].alias("p")
    return (b.join(bp, F.col("b.brand_id") == F.col("bp.id"))
             .join(who, F.col("bp.user_id") == F.col("w.user_id"), "left_semi")
             .join(pp, F.col("b.package_id") == F.col("pp.id"), "left")
             .join(cp, F.col("b.creator_id") == F.col("cp.id"), "left")
             .join(p, F.col("p.booking_id") == F.col("b.id"), "left")
             .select(F.col("bp.user_id").alias("history_user_id"), "b.*", "pp.package_name",
                     F.col("cp.username").alias("creator_username"), "p.payment_status",
                     F.col("p.amount").alias("paid_amount"))
             .transform(lambda d: order_if_keyed(d, user_id, F.col("created_at").desc(), F.col("id"))))


def brand_campaign_history(m, user_id: str | None = None) -> DataFrame:
    """Q21: a brand user's campaigns with their invite count (0 when none).
    Invites are counted per campaign first, then left-joined."""
    who = _role_users(m, "brand", user_id).alias("w")
    bp = m["brand_profiles"].alias("bp")
    c = m["campaigns"].alias("c")
    inv = m["campaign_invites"].groupBy(F.col("campaign_id").alias("_ic")).agg(
        F.count("id").alias("invite_count"))
    return (c.join(bp, F.col("c.brand_id") == F.col("bp.id"))
             .join(who, F.col("bp.user_id") == F.col("w.user_id"), "left_semi")
             .join(inv, F.col("c.id") == F.col("_ic"), "left")
             .select(F.col("bp.user_id").alias("history_user_id"), "c.*",
                     F.coalesce(F.col("invite_count"), F.lit(0)).alias("invite_count"))
             .transform(lambda d: order_if_keyed(d, user_id, F.col("created_at").desc(), F.col("id"))))


def creator_booking_history(m, user_id: str | None = None) -> DataFrame:
    """Q22: bookings received by a creator user."""
    who = _role_users(m, "creator", user_id).alias("w")
    cp = m["creator_profiles"].alias("cp")
    b = m["bookings"].alias("b")
    pp = m["promotion_packages"].alias("pp")
    bp = m["brand_profiles"].alias("bp")
    p = m["payments"].alias("p")
    return (b.join(cp, F.col("b.creator_id") == F.col("cp.id"))
             .join(who, F.col("cp.user_id") == F.col("w.user_id"), "left_semi")
             .join(pp, F.col("b.package_id") == F.col("pp.id"), "left")
             .join(bp, F.col("b.brand_id") == F.col("bp.id"), "left")
             .join(p, F.col("p.booking_id") == F.col("b.id"), "left")
             .select(F.col("cp.user_id").alias("history_user_id"), "b.*", "pp.package_name",
                     F.col("bp.company_name").alias("brand_name"), "p.payment_status",
                     F.col("p.amount").alias("paid_amount"))
             .transform(lambda d: order_if_keyed(d, user_id, F.col("created_at").desc(), F.col("id"))))


def creator_collab_history(m, user_id: str | None = None) -> DataFrame:
    """Q23: collaborations a creator user owns or takes part in, with the
    owner's name and ``role_in_collab``.

    The reference joins on ``owner = me OR participant = me``, which plans as
    a nested loop; here the (collaboration, creator) pairs of owners and of
    participants are unioned and de-duplicated, then equi-joined."""
    who = _role_users(m, "creator", user_id)
    me = (m["creator_profiles"].join(who, "user_id", "left_semi")
          .select(F.col("id").alias("self_id"), F.col("user_id").alias("history_user_id")))
    col = m["collaborations"]
    pairs = (col.select(F.col("id").alias("cid"), F.col("creator_id").alias("self_id"))
             .unionByName(m["collaboration_participants"].select(
                 F.col("collaboration_id").alias("cid"), F.col("creator_id").alias("self_id")))
             .distinct())
    owner = (m["creator_profiles"].alias("o")
             .join(m["users"].alias("uo"), F.col("o.user_id") == F.col("uo.id"))
             .select(F.col("o.id").alias("_oid"), F.col("uo.name").alias("owner_name")))
    c = col.alias("c")
    return (pairs.join(me, "self_id")
                 .join(c, F.col("cid") == F.col("c.id"))
                 .join(owner, F.col("c.creator_id") == F.col("_oid"))
                 .select("history_user_id", "c.id", "c.title", "c.platform", "c.category", "c.status",
                         "c.collaboration_type", "c.created_at", "owner_name",
                         F.when(F.col("c.creator_id") == F.col("self_id"), "owner")
                          .otherwise("participant").alias("role_in_collab"))
                 .transform(lambda d: order_if_keyed(d, user_id, F.col("created_at").desc(), F.col("id"))))
