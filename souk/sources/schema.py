"""Marketplace data model as data: column types, keys, foreign keys, enum
domains, NOT NULL columns, length limits and column defaults.

Everything that checks, loads, cascades or defaults a table reads these
structures, so the model is written down exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
L = T.LongType()
B = T.BooleanType()
TS = T.TimestampNTZType()
MONEY = T.DecimalType(12, 2)
RATING = T.DecimalType(3, 2)
RATE = T.DecimalType(5, 2)


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Canonical column lists (password is deliberately absent everywhere).
SCHEMAS: dict[str, T.StructType] = {
    "users": _struct(
        ("id", S), ("name", S), ("email", S), ("role", S), ("avatar_url", S),
        ("created_at", TS), ("google_id", S), ("facebook_id", S), ("social_provider", S),
    ),
    "creator_profiles": _struct(
        ("id", S), ("user_id", S), ("username", S), ("bio", S), ("category", S),
        ("city", S), ("country", S), ("verified", I), ("rating", RATING),
        ("collaboration_rating", RATING), ("created_at", TS),
    ),
    "brand_profiles": _struct(
        ("id", S), ("user_id", S), ("company_name", S), ("industry", S),
        ("website", S), ("created_at", TS),
    ),
    "creator_platforms": _struct(
        ("id", S), ("creator_id", S), ("platform_name", S), ("username", S),
        ("profile_url", S), ("followers", I), ("engagement_rate", RATE),
    ),
    "promotion_packages": _struct(
        ("id", S), ("creator_id", S), ("package_name", S), ("description", S),
        ("price", MONEY), ("delivery_days", I), ("created_at", TS),
    ),
    "campaigns": _struct(
        ("id", S), ("brand_id", S), ("title", S), ("description", S), ("budget", MONEY),
        ("category", S), ("status", S), ("created_at", TS),
    ),
    "campaign_invites": _struct(
        ("id", S), ("campaign_id", S), ("creator_id", S), ("status", S),
    ),
    "bookings": _struct(
        ("id", S), ("brand_id", S), ("creator_id", S), ("package_id", S),
        ("campaign_id", S), ("status", S), ("price", MONEY), ("notes", S),
        ("content_url", S), ("content_type", S), ("content_note", S),
        ("rejection_reason", S), ("created_at", TS),
    ),
    "payments": _struct(
        ("id", S), ("booking_id", S), ("razorpay_order_id", S), ("razorpay_payment_id", S),
        ("amount", MONEY), ("payment_status", S), ("created_at", TS),
    ),
    "escrow_wallet": _struct(
        ("id", S), ("booking_id", S), ("amount", MONEY), ("status", S), ("created_at", TS),
    ),
    "creator_earnings": _struct(
        ("id", S), ("creator_id", S), ("booking_id", S), ("amount", MONEY),
        ("status", S), ("created_at", TS),
    ),
    "withdrawals": _struct(
        ("id", S), ("creator_id", S), ("amount", MONEY), ("status", S),
        ("details", S), ("created_at", TS),
    ),
    "reviews": _struct(
        ("id", S), ("booking_id", S), ("brand_id", S), ("creator_id", S),
        ("rating", I), ("comment", S), ("created_at", TS),
    ),
    "messages": _struct(
        ("id", S), ("sender_id", S), ("receiver_id", S), ("booking_id", S),
        ("message", S), ("created_at", TS),
    ),
    "collaboration_messages": _struct(
        ("id", S), ("collaboration_id", S), ("sender_id", S), ("message", S), ("created_at", TS),
    ),
    "notifications": _struct(
        ("id", S), ("user_id", S), ("title", S), ("message", S), ("link", S),
        ("is_read", B), ("created_at", TS),
    ),
    "admin_logs": _struct(
        ("id", S), ("action", S), ("admin_id", S), ("created_at", TS),
    ),
    "collaborations": _struct(
        ("id", S), ("creator_id", S), ("title", S), ("description", S), ("platform", S),
        ("category", S), ("location", S), ("followers_required", I),
        ("collaboration_type", S), ("status", S), ("created_at", TS),
    ),
    "collaboration_requests": _struct(
        ("id", S), ("collaboration_id", S), ("creator_id", S), ("status", S),
        ("message", S), ("created_at", TS),
    ),
    "collaboration_participants": _struct(
        ("id", S), ("collaboration_id", S), ("creator_id", S), ("role", S), ("joined_at", TS),
    ),
    "collaboration_reviews": _struct(
        ("id", S), ("collaboration_id", S), ("reviewer_id", S), ("creator_id", S),
        ("rating", I), ("comment", S), ("created_at", TS),
    ),
}

TABLES: tuple[str, ...] = tuple(SCHEMAS)


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    on_delete: str  # "cascade" or "set_null"


# The foreign keys and their delete rules of the DDL.
FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("creator_profiles", "user_id", "users", "cascade"),
    ForeignKey("brand_profiles", "user_id", "users", "cascade"),
    ForeignKey("creator_platforms", "creator_id", "creator_profiles", "cascade"),
    ForeignKey("promotion_packages", "creator_id", "creator_profiles", "cascade"),
    ForeignKey("campaigns", "brand_id", "brand_profiles", "cascade"),
    ForeignKey("campaign_invites", "campaign_id", "campaigns", "cascade"),
    ForeignKey("campaign_invites", "creator_id", "creator_profiles", "cascade"),
    ForeignKey("bookings", "brand_id", "brand_profiles", "cascade"),
    ForeignKey("bookings", "creator_id", "creator_profiles", "cascade"),
    ForeignKey("bookings", "package_id", "promotion_packages", "set_null"),
    ForeignKey("bookings", "campaign_id", "campaigns", "set_null"),
    ForeignKey("payments", "booking_id", "bookings", "cascade"),
    ForeignKey("escrow_wallet", "booking_id", "bookings", "cascade"),
    ForeignKey("creator_earnings", "creator_id", "creator_profiles", "cascade"),
    ForeignKey("creator_earnings", "booking_id", "bookings", "cascade"),
    ForeignKey("withdrawals", "creator_id", "creator_profiles", "cascade"),
    ForeignKey("reviews", "booking_id", "bookings", "cascade"),
    ForeignKey("reviews", "brand_id", "brand_profiles", "cascade"),
    ForeignKey("reviews", "creator_id", "creator_profiles", "cascade"),
    ForeignKey("messages", "sender_id", "users", "cascade"),
    ForeignKey("messages", "receiver_id", "users", "cascade"),
    ForeignKey("messages", "booking_id", "bookings", "set_null"),
    ForeignKey("collaboration_messages", "collaboration_id", "collaborations", "cascade"),
    ForeignKey("collaboration_messages", "sender_id", "users", "cascade"),
    ForeignKey("notifications", "user_id", "users", "cascade"),
    ForeignKey("admin_logs", "admin_id", "users", "set_null"),
    ForeignKey("collaborations", "creator_id", "creator_profiles", "cascade"),
    ForeignKey("collaboration_requests", "collaboration_id", "collaborations", "cascade"),
    ForeignKey("collaboration_requests", "creator_id", "creator_profiles", "cascade"),
    ForeignKey("collaboration_participants", "collaboration_id", "collaborations", "cascade"),
    ForeignKey("collaboration_participants", "creator_id", "creator_profiles", "cascade"),
    ForeignKey("collaboration_reviews", "collaboration_id", "collaborations", "cascade"),
    ForeignKey("collaboration_reviews", "reviewer_id", "creator_profiles", "cascade"),
    ForeignKey("collaboration_reviews", "creator_id", "creator_profiles", "cascade"),
)

# Unique keys besides the primary key `id` (nulls exempt).
UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "users": (("id",), ("email",), ("google_id",), ("facebook_id",)),
    "creator_profiles": (("id",), ("user_id",), ("username",)),
    "brand_profiles": (("id",), ("user_id",)),
    "escrow_wallet": (("id",), ("booking_id",)),
    "reviews": (("id",), ("booking_id",)),
    "collaboration_requests": (("id",), ("collaboration_id", "creator_id")),
    "collaboration_participants": (("id",), ("collaboration_id", "creator_id")),
    "collaboration_reviews": (("id",), ("collaboration_id", "reviewer_id", "creator_id")),
}

# Enum domains of the DDL.
ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("users", "role"): ("creator", "brand", "admin"),
    ("campaigns", "status"): ("active", "paused", "completed", "cancelled"),
    ("campaign_invites", "status"): ("pending", "accepted", "declined"),
    ("bookings", "status"): (
        "pending", "accepted", "content_submitted", "content_rejected", "completed", "cancelled",
    ),
    ("payments", "payment_status"): ("pending", "completed", "failed", "refunded"),
    ("escrow_wallet", "status"): ("held", "released", "refunded"),
    ("creator_earnings", "status"): ("pending", "paid"),
    ("withdrawals", "status"): ("pending", "approved", "rejected", "paid"),
    ("collaborations", "status"): ("open", "in_progress", "completed", "cancelled"),
    ("collaboration_requests", "status"): ("pending", "accepted", "rejected"),
}

# NOT NULL columns of the DDL (primary keys are always checked too).
NOT_NULL: dict[str, tuple[str, ...]] = {
    "users": ("name", "email", "role"),
    "creator_profiles": ("username",),
    "brand_profiles": ("company_name",),
    "creator_platforms": ("platform_name",),
    "promotion_packages": ("package_name", "price", "delivery_days"),
    "campaigns": ("title",),
    "bookings": ("price",),
    "payments": ("amount",),
    "escrow_wallet": ("amount",),
    "creator_earnings": ("amount",),
    "withdrawals": ("creator_id", "amount"),
    "reviews": ("rating",),
    "messages": ("message",),
    "collaboration_messages": ("collaboration_id", "sender_id", "message"),
    "notifications": ("message",),
    "admin_logs": ("action",),
    "collaborations": ("creator_id", "title"),
    "collaboration_requests": ("collaboration_id", "creator_id"),
    "collaboration_participants": ("collaboration_id", "creator_id"),
    "collaboration_reviews": ("collaboration_id", "reviewer_id", "creator_id", "rating"),
}

# Rating CHECK constraints (1..5).
RATING_CHECKS: tuple[tuple[str, str], ...] = (
    ("reviews", "rating"),
    ("collaboration_reviews", "rating"),
)

# VARCHAR(n) limits of the DDL.
VARCHAR_LIMITS: dict[tuple[str, str], int] = {
    ("users", "name"): 100,
    ("users", "email"): 150,
    ("users", "avatar_url"): 500,
    ("creator_profiles", "username"): 100,
    ("creator_profiles", "category"): 100,
    ("creator_profiles", "city"): 100,
    ("creator_profiles", "country"): 100,
    ("brand_profiles", "company_name"): 200,
    ("brand_profiles", "industry"): 100,
    ("brand_profiles", "website"): 300,
    ("creator_platforms", "platform_name"): 50,
    ("creator_platforms", "username"): 150,
    ("creator_platforms", "profile_url"): 500,
    ("promotion_packages", "package_name"): 200,
    ("campaigns", "title"): 300,
    ("campaigns", "category"): 100,
    ("bookings", "content_url"): 500,
    ("bookings", "content_type"): 50,
    ("payments", "razorpay_order_id"): 200,
    ("payments", "razorpay_payment_id"): 200,
    ("collaborations", "title"): 300,
    ("collaborations", "platform"): 50,
    ("collaborations", "category"): 100,
    ("collaborations", "location"): 100,
    ("collaborations", "collaboration_type"): 100,
    ("collaboration_participants", "role"): 100,
}

# Column defaults of the DDL (created_at defaults to the batch time).
DEFAULTS: dict[str, dict[str, object]] = {
    "creator_profiles": {"verified": 0, "rating": "0.00", "collaboration_rating": "0.00"},
    "creator_platforms": {"followers": 0, "engagement_rate": "0.00"},
    "campaigns": {"status": "active"},
    "campaign_invites": {"status": "pending"},
    "bookings": {"status": "pending"},
    "payments": {"payment_status": "pending"},
    "escrow_wallet": {"status": "held"},
    "creator_earnings": {"status": "pending"},
    "withdrawals": {"status": "pending"},
    "notifications": {"title": "Notification", "is_read": False},
    "collaborations": {"followers_required": 0, "status": "open"},
    "collaboration_requests": {"status": "pending"},
    "collaboration_participants": {"role": "collaborator"},
}

TIME_COLUMN: dict[str, str | None] = {
    t: ("joined_at" if t == "collaboration_participants"
        else None if t in ("creator_platforms", "campaign_invites") else "created_at")
    for t in TABLES
}


def children_of(parent: str) -> list[ForeignKey]:
    return [fk for fk in FOREIGN_KEYS if fk.parent == parent]


def delete_order() -> list[str]:
    """Parents before children (the FK graph is acyclic)."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(t: str) -> None:
        if t in seen:
            return
        seen.add(t)
        for fk in FOREIGN_KEYS:
            if fk.table == t:
                visit(fk.parent)
        order.append(t)

    for t in TABLES:
        visit(t)
    return order
