"""Invariants after jobs on the clean sf0.001 stand-in tables: every foreign
key still resolves (delete rules included), escrow stays unique per booking,
and no creator gains a second pending withdrawal."""

import pytest
from pyspark.sql import functions as F

from souk.catalog import JOBS
from souk.operators.checks import check_foreign_keys, check_unique


@pytest.mark.parametrize("job", ["t06_create_bookings", "t11_settle_payments", "t18_decide_requests",
                                 "t23_delete_users", "t05_delete_campaigns", "t01_register_users"])
def test_foreign_keys_resolve_after_job(small, job):
    assert check_foreign_keys(small).count() == 0
    after = JOBS[job][0](small).apply(small)
    assert check_foreign_keys(after).count() == 0


def test_escrow_unique_after_settlement(small):
    after = JOBS["t11_settle_payments"][0](small).apply(small)
    assert check_unique(after, tables=["escrow_wallet"]).count() == 0


def test_no_second_pending_withdrawal(small):
    before = small["withdrawals"].filter(F.col("status") == "pending").groupBy("creator_id").count()
    after = JOBS["t13_request_withdrawals"][0](small).apply(small)
    new = (after["withdrawals"].filter(F.col("status") == "pending").groupBy("creator_id").count()
           .withColumnRenamed("count", "n_after"))
    j = new.join(before, "creator_id", "left").fillna(0, ["count"])
    assert j.filter(F.col("n_after") > F.greatest(F.col("count"), F.lit(1))).count() == 0
