"""Withdrawals and balances."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.functions.frame import order_if_keyed


def _zero():
    return F.lit(Decimal("0.00"))


# Withdrawal status sets of the reference.
BALANCE_WITHDRAWN = ("pending", "approved")            # per-creator balance
TOTALS_WITHDRAWN = ("pending", "approved", "paid")     # admin totals
QUEUE_ORDER = ("pending", "approved", "rejected")      # FIELD(...) order; others rank 0

DETAILS_SCHEMA = T.StructType([
    T.StructField("upi_id", T.StringType()),
    T.StructField("bank_account", T.StringType()),
    T.StructField("ifsc_code", T.StringType()),
    T.StructField("account_holder", T.StringType()),
])


def withdrawal_history(m, creator_id: str | None = None) -> DataFrame:
    """Q26: a creator's withdrawals, newest first."""
    w = m["withdrawals"]
    if creator_id is not None:
        w = w.filter(F.col("creator_id") == creator_id)
    return order_if_keyed(w, creator_id, F.col("created_at").desc(), F.col("id"))


def _ledger(m) -> DataFrame:
    """Paid earnings and withdrawals as one tagged stream of amounts."""
    earned = (m["creator_earnings"].filter(F.col("status") == "paid")
              .select("creator_id", F.col("amount").alias("earned"), F.lit(None).cast("decimal(12,2)").alias("w_amount"),
                      F.lit(None).cast("string").alias("w_status")))
    withdrawn = m["withdrawals"].select("creator_id", F.lit(None).cast("decimal(12,2)").alias("earned"),
                                        F.col("amount").alias("w_amount"), F.col("status").alias("w_status"))
    return earned.unionByName(withdrawn)


def available_balance(m, creator_id: str | None = None) -> DataFrame:
    """Q27: per creator profile, paid earnings minus pending and approved
    withdrawals, floored at 0.  One shuffle: the two inputs are unioned and
    folded by conditional sums (partial per task, so hot creators stay cheap);
    creators with neither get 0."""
    led = _ledger(m)
    cp = m["creator_profiles"].select(F.col("id").alias("creator_id"))
    if creator_id is not None:
        led = led.filter(F.col("creator_id") == creator_id)
        cp = cp.filter(F.col("creator_id") == creator_id)
    sums = led.groupBy("creator_id").agg(
        F.sum("earned").alias("earned"),
        F.sum(F.when(F.col("w_status").isin(*BALANCE_WITHDRAWN), F.col("w_amount"))).alias("withdrawn"))
    out = cp.join(sums, "creator_id", "left").select(
        "creator_id", F.coalesce("earned", _zero()).alias("earned"),
        F.coalesce("withdrawn", _zero()).alias("withdrawn"))
    return out.withColumn("available", F.greatest(_zero(), F.col("earned") - F.col("withdrawn")))


def withdrawal_queue(m) -> DataFrame:
    """Q28: all withdrawals with creator name, email and avatar, ordered like
    ``FIELD(status, 'pending','approved','rejected')`` then newest first.
    FIELD gives 0 to any other value, so ``paid`` sorts *first*."""
    w = m["withdrawals"].alias("w")
    cp = m["creator_profiles"].alias("cp")
    u = m["users"].alias("u")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in QUEUE_ORDER]), F.col("w.status")),
                      F.lit(0))
    return (w.join(cp, F.col("w.creator_id") == F.col("cp.id"))
             .join(u, F.col("cp.user_id") == F.col("u.id"))
             .select("w.*", F.col("cp.username").alias("creator_username"),
                     F.col("u.name").alias("creator_name"), F.col("u.email").alias("creator_email"),
                     F.col("u.avatar_url").alias("creator_avatar"), rank.alias("_rank"))
             .orderBy("_rank", F.col("created_at").desc(), F.col("id"))
             .drop("_rank"))


def withdrawal_totals(m) -> DataFrame:
    """Q29: platform-wide balance; unlike Q27, ``paid`` withdrawals count as
    withdrawn here."""
    led = _ledger(m)
    sums = led.agg(
        F.coalesce(F.sum("earned"), _zero()).alias("earned"),
        F.coalesce(F.sum(F.when(F.col("w_status").isin(*TOTALS_WITHDRAWN), F.col("w_amount"))), _zero())
         .alias("total_withdrawn"))
    return sums.select(F.greatest(_zero(), F.col("earned") - F.col("total_withdrawn")).alias("available_balance"),
                       "total_withdrawn")


def withdrawal_details(m) -> DataFrame:
    """The JSON ``details`` column parsed into its four payout fields."""
    w = m["withdrawals"]
    d = F.from_json(F.col("details"), DETAILS_SCHEMA)
    return w.select("id", "creator_id", d["upi_id"].alias("upi_id"),
                    d["bank_account"].alias("bank_account"), d["ifsc_code"].alias("ifsc_code"),
                    d["account_holder"].alias("account_holder"))


def details_json(upi_id, bank_account, ifsc_code, account_holder):
    """``JSON.stringify({upi_id, bank_account, ifsc_code, account_holder})``:
    undefined keys vanish, as nulls do in ``to_json``."""
    return F.to_json(F.struct(upi_id.alias("upi_id"), bank_account.alias("bank_account"),
                              ifsc_code.alias("ifsc_code"), account_holder.alias("account_holder")))
