"""Campaign, booking and payment reads (Q8-Q15, Q24, Q25).

Bookings, payments and escrow rows all key on the booking id, so their
joins shuffle each side once on that key and then stay co-partitioned;
profile and user lookups are left to AQE, which broadcasts a side only when
its measured runtime size is below the broadcast threshold.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.frame import order_if_keyed, paginate
from souk.functions.text import js_parse_int, js_truthy, like_any


def _newest(df: DataFrame, key, col: str = "created_at") -> DataFrame:
    return order_if_keyed(df, key, F.col(col).desc(), F.col("id"))


# --------------------------------------------------------------------- campaigns
def list_campaigns(m, status=None, category=None, page=1, limit=10) -> DataFrame:
    """Q8: campaigns with brand company name and avatar, newest first, paged."""
    c = m["campaigns"].alias("c")
    if js_truthy(status):
        c = c.filter(F.col("status") == F.lit(status)).alias("c")
    if js_truthy(category):
        c = c.filter(like_any("category", category)).alias("c")
    bp = m["brand_profiles"].alias("bp")
    u = m["users"].alias("u")
    df = (c.join(bp, F.col("c.brand_id") == F.col("bp.id"))
           .join(u, F.col("bp.user_id") == F.col("u.id"))
           .select("c.*", "bp.company_name", F.col("u.avatar_url").alias("brand_avatar")))
    return paginate(df, [F.col("created_at").desc(), F.col("id")],
                    js_parse_int(page), js_parse_int(limit))


def brand_campaigns(m, brand_id: str | None = None) -> DataFrame:
    """Q9: a brand's campaigns, newest first."""
    c = m["campaigns"]
    if brand_id is not None:
        c = c.filter(F.col("brand_id") == brand_id)
    return _newest(c, brand_id)


# --------------------------------------------------------------------- bookings
def bookings_for_brand(m, brand_id: str | None = None) -> DataFrame:
    """Q10: a brand's bookings with creator user, package name and payment
    status.  Payments are not unique per booking, so a booking repeats once
    per payment row, as in the reference."""
    b = m["bookings"].alias("b")
    if brand_id is not None:
        b = b.filter(F.col("brand_id") == brand_id).alias("b")
    cp = m["creator_profiles"].alias("cp")
    u = m["users"].alias("u")
    pkg = m["promotion_packages"].alias("pkg")
    p = m["payments"].alias("p")
    df = (b.join(cp, F.col("b.creator_id") == F.col("cp.id"))
           .join(u, F.col("cp.user_id") == F.col("u.id"))
           .join(pkg, F.col("b.package_id") == F.col("pkg.id"), "left")
           .join(p, F.col("p.booking_id") == F.col("b.id"), "left")
           .select("b.*", F.col("cp.username").alias("creator_username"),
                   F.col("u.name").alias("creator_name"), F.col("u.avatar_url").alias("creator_avatar"),
                   F.col("cp.user_id").alias("creator_user_id"), "pkg.package_name", "p.payment_status"))
    return _newest(df, brand_id)


def bookings_for_creator(m, creator_id: str | None = None) -> DataFrame:
    """Q11: a creator's bookings with brand company, avatar, package, payment status."""
    b = m["bookings"].alias("b")
    if creator_id is not None:
        b = b.filter(F.col("creator_id") == creator_id).alias("b")
    bp = m["brand_profiles"].alias("bp")
    u = m["users"].alias("u")
    pkg = m["promotion_packages"].alias("pkg")
    p = m["payments"].alias("p")
    df = (b.join(bp, F.col("b.brand_id") == F.col("bp.id"))
           .join(u, F.col("bp.user_id") == F.col("u.id"))
           .join(pkg, F.col("b.package_id") == F.col("pkg.id"), "left")
           .join(p, F.col("p.booking_id") == F.col("b.id"), "left")
           .select("b.*", F.col("bp.company_name").alias("brand_name"),
                   F.col("u.avatar_url").alias("brand_avatar"), "pkg.package_name", "p.payment_status"))
    return _newest(df, creator_id)


def bookings_recent(m, n: int = 100) -> DataFrame:
    """Q12: the newest ``n`` bookings platform-wide with brand and creator names
    (TakeOrderedAndProject: a top-n per task and one small merge)."""
    b = m["bookings"].alias("b")
    bp = m["brand_profiles"].alias("bp")
    cp = m["creator_profiles"].alias("cp")
    df = (b.join(bp, F.col("b.brand_id") == F.col("bp.id"))
           .join(cp, F.col("b.creator_id") == F.col("cp.id"))
           .select("b.*", F.col("bp.company_name").alias("brand_name"),
                   F.col("cp.username").alias("creator_username")))
    return df.orderBy(F.col("created_at").desc(), F.col("id")).limit(int(n))


def booking_detail(m, booking_id: str | None = None) -> DataFrame:
    """Q13: one booking across 8 tables (users joined twice, by role)."""
    b = m["bookings"].alias("b")
    if booking_id is not None:
        b = b.filter(F.col("id") == booking_id).alias("b")
    cp = m["creator_profiles"].alias("cp")
    uc = m["users"].alias("u_c")
    bp = m["brand_profiles"].alias("bp")
    ub = m["users"].alias("u_b")
    pkg = m["promotion_packages"].alias("pkg")
    p = m["payments"].alias("p")
    ew = m["escrow_wallet"].alias("ew")
    return (b.join(cp, F.col("b.creator_id") == F.col("cp.id"))
             .join(uc, F.col("cp.user_id") == F.col("u_c.id"))
             .join(bp, F.col("b.brand_id") == F.col("bp.id"))
             .join(ub, F.col("bp.user_id") == F.col("u_b.id"))
             .join(pkg, F.col("b.package_id") == F.col("pkg.id"), "left")
             .join(p, F.col("p.booking_id") == F.col("b.id"), "left")
             .join(ew, F.col("ew.booking_id") == F.col("b.id"), "left")
             .select("b.*", F.col("cp.username").alias("creator_username"),
                     F.col("u_c.name").alias("creator_name"), F.col("u_c.avatar_url").alias("creator_avatar"),
                     F.col("bp.company_name").alias("brand_name"), F.col("u_b.avatar_url").alias("brand_avatar"),
                     "pkg.package_name", F.col("pkg.description").alias("package_desc"), "pkg.delivery_days",
                     "p.payment_status", "p.razorpay_order_id", "p.razorpay_payment_id",
                     F.col("p.amount").alias("paid_amount"), F.col("ew.status").alias("escrow_status")))


# --------------------------------------------------------------------- payments
def payment_and_escrow(m, booking_id: str | None = None) -> DataFrame:
    """Q14: per booking, its first payment (by created_at, then id) and its
    escrow row; null when absent.  ``min`` over a struct is a partial
    aggregate, so a booking with many payments never gathers them."""
    b = m["bookings"].select(F.col("id").alias("booking_id"))
    pay = m["payments"]
    esc = m["escrow_wallet"]
    if booking_id is not None:
        b, pay, esc = (b.filter(F.col("booking_id") == booking_id),
                       pay.filter(F.col("booking_id") == booking_id),
                       esc.filter(F.col("booking_id") == booking_id))
    first = pay.groupBy(F.col("booking_id").alias("_pb")).agg(
        F.min(F.struct("created_at", "id", "razorpay_order_id", "razorpay_payment_id", "amount",
                       "payment_status")).alias("_p"))
    e = esc.select(F.col("booking_id").alias("_eb"), F.col("id").alias("escrow_id"),
                   F.col("amount").alias("escrow_amount"), F.col("status").alias("escrow_status"),
                   F.col("created_at").alias("escrow_created_at"))
    return (b.join(first, b["booking_id"] == F.col("_pb"), "left")
             .join(e, b["booking_id"] == F.col("_eb"), "left")
             .select("booking_id", F.col("_p.id").alias("payment_id"),
                     F.col("_p.razorpay_order_id").alias("razorpay_order_id"),
                     F.col("_p.razorpay_payment_id").alias("razorpay_payment_id"),
                     F.col("_p.amount").alias("payment_amount"),
                     F.col("_p.payment_status").alias("payment_status"),
                     F.col("_p.created_at").alias("payment_created_at"),
                     "escrow_id", "escrow_amount", "escrow_status", "escrow_created_at"))


def _payments_joined(m) -> DataFrame:
    p = m["payments"].alias("p")
    b = m["bookings"].alias("b")
    bp = m["brand_profiles"].alias("bp")
    cp = m["creator_profiles"].alias("cp")
    return (p.join(b, F.col("p.booking_id") == F.col("b.id"))
             .join(bp, F.col("b.brand_id") == F.col("bp.id"))
             .join(cp, F.col("b.creator_id") == F.col("cp.id")))


def payments_recent(m, n: int = 100) -> DataFrame:
    """Q15: the newest ``n`` payments with booking price, company and creator."""
    df = _payments_joined(m).select("p.*", F.col("b.price").alias("booking_price"), "bp.company_name",
                                    F.col("cp.username").alias("creator_username"))
    return df.orderBy(F.col("created_at").desc(), F.col("id")).limit(int(n))


def platform_profit(m, fee_pct: int = 10) -> DataFrame:
    """Q24: completed payments with the platform fee and creator payout,
    each ``ROUND(amount·pct/100, 2)`` in exact decimal (HALF_UP).  Parts are
    rounded separately and can exceed the whole (0.05 → 0.01 + 0.05)."""
    fee = Decimal(fee_pct) / Decimal(100)
    payout = Decimal(100 - fee_pct) / Decimal(100)
    p = m["payments"].filter(F.col("payment_status") == "completed").alias("p")
    b = m["bookings"].alias("b")
    bp = m["brand_profiles"].alias("bp")
    cp = m["creator_profiles"].alias("cp")
    ew = m["escrow_wallet"].alias("ew")
    df = (p.join(b, F.col("p.booking_id") == F.col("b.id"))
           .join(bp, F.col("b.brand_id") == F.col("bp.id"))
           .join(cp, F.col("b.creator_id") == F.col("cp.id"))
           .join(ew, F.col("ew.booking_id") == F.col("b.id"), "left")
           .select("p.id", "p.booking_id", "p.amount", "p.payment_status", "p.created_at",
                   F.col("bp.company_name").alias("brand_name"),
                   F.col("cp.username").alias("creator_username"),
                   F.round(F.col("p.amount") * F.lit(fee), 2).cast("decimal(12,2)").alias("platform_fee"),
                   F.round(F.col("p.amount") * F.lit(payout), 2).cast("decimal(12,2)").alias("creator_payout"),
                   F.col("ew.status").alias("escrow_status")))
    return df.orderBy(F.col("created_at").desc(), F.col("id"))


def platform_profit_totals(m, fee_pct: int = 10) -> DataFrame:
    """Q25: totals of Q24's rounded rows, exact in decimal, 0 when none."""
    rows = platform_profit(m, fee_pct)
    zero = F.lit(Decimal("0.00"))
    return rows.agg(
        F.coalesce(F.sum("amount"), zero).alias("total_revenue"),
        F.coalesce(F.sum("platform_fee"), zero).alias("total_platform_profit"),
        F.coalesce(F.sum("creator_payout"), zero).alias("total_creator_payout"),
        F.count(F.lit(1)).alias("n_transactions"),
    ).select(F.lit(fee_pct).alias("platform_fee_percent"), "*")
