"""Table jobs: goldens and the fold property (one batch of n commands equals
n batches of one, applied in seq order)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from souk.plans import bookings as bj
from souk.plans import withdrawals as wj
from tests.helpers import bundle, ts

D = Decimal
TS = "2024-02-01 00:00:00"


def _market(spark):
    users = [{"id": "ub", "name": "Brand", "email": "b@x", "role": "brand"},
             {"id": "uc", "name": "Cre", "email": "c@x", "role": "creator"},
             {"id": "ua", "name": "Adm", "email": "a@x", "role": "admin"}]
    return bundle(
        spark, users=users,
        brand_profiles=[{"id": "b1", "user_id": "ub", "company_name": "Co"}],
        creator_profiles=[{"id": "c1", "user_id": "uc", "username": "cre", "rating": D("0.00")}],
        bookings=[{"id": "bk1", "brand_id": "b1", "creator_id": "c1", "status": "accepted", "price": D("500.00"),
                   "created_at": ts(0)},
                  {"id": "bk2", "brand_id": "b1", "creator_id": "c1", "status": "pending", "price": D("70.00"),
                   "created_at": ts(1)}],
        payments=[{"id": "p1", "booking_id": "bk1", "amount": D("500.00"), "payment_status": "completed",
                   "created_at": ts(0)}],
        escrow_wallet=[{"id": "e1", "booking_id": "bk1", "amount": D("500.00"), "status": "held"}],
        creator_earnings=[{"id": "ce0", "creator_id": "c1", "booking_id": "bkx", "amount": D("1000.00"),
                           "status": "paid"}],
    )


CONTENT = [
    dict(cmd_id=1, seq=1, kind="submit", actor_user_id="uc", booking_id="bk1", content_url="https://v/1"),
    dict(cmd_id=2, seq=2, kind="submit", actor_user_id="uc", booking_id="bk1", content_url="https://v/2"),
    dict(cmd_id=3, seq=3, kind="reject", actor_user_id="ub", booking_id="bk1", rejection_reason=None),
    dict(cmd_id=4, seq=4, kind="reject", actor_user_id="ub", booking_id="bk1", rejection_reason="x"),
    dict(cmd_id=5, seq=5, kind="submit", actor_user_id="ub", booking_id="bk1", content_url="https://v/5"),
    dict(cmd_id=6, seq=6, kind="submit", actor_user_id="uc", booking_id="bk1", file_name="Clip.MP4",
         mime_type="video/mp4"),
    dict(cmd_id=7, seq=7, kind="submit", actor_user_id="uc", booking_id="bk2", content_url="https://v/7"),
]
CONTENT_SCHEMA = ("cmd_id long, seq long, kind string, actor_user_id string, booking_id string, file_name string, "
                  "mime_type string, content_url string, content_note string, rejection_reason string")

STATUS = [dict(cmd_id=i, seq=i, actor_user_id="ua", booking_id=b, status=s)
          for i, (b, s) in enumerate([("bk1", "completed"), ("bk1", "accepted"), ("bk2", "archived"),
                                      ("bk9", "accepted"), ("bk1", "completed"), ("bk2", "cancelled")], 1)]
STATUS_SCHEMA = "cmd_id long, seq long, actor_user_id string, booking_id string, status string"

WITHDRAW = [dict(cmd_id=i, seq=i, actor_user_id="uc", amount=a, upi_id=u)
            for i, (a, u) in enumerate([("50", "x"), ("900", "x"), ("300", None), ("300", "x"), ("300", "x"),
                                        ("2000", "x")], 1)]
WITHDRAW_SCHEMA = ("cmd_id long, seq long, actor_user_id string, amount string, upi_id string, bank_account string, "
                   "ifsc_code string, account_holder string")


def _cmds(spark, rows, schema):
    cols = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schema)


def test_content_fold_golden(spark):
    res = bj.content_review(_market(spark), _cmds(spark, CONTENT, CONTENT_SCHEMA), TS)
    rej = dict((r.cmd_id, r.reason) for r in res.rejects.collect())
    assert rej == {2: "bad_status", 4: "bad_status", 5: "not_your_booking", 7: "bad_status"}
    b = {r.id: r for r in res.tables["bookings"].collect()}
    assert b["bk1"].status == "content_submitted"
    assert b["bk1"].content_type == "video" and b["bk1"].content_url == "/uploads/content/content_uc_6.MP4"
    assert b["bk1"].rejection_reason is None
    msgs = sorted(r.message for r in res.notifications.collect())
    assert any("was rejected. Reason: Content did not meet requirements." in x for x in msgs)


def _state(m):
    tabs = {}
    for t in ("bookings", "escrow_wallet", "creator_earnings", "withdrawals"):
        tabs[t] = sorted(tuple(r) for r in m[t].drop("created_at").collect())
    tabs["notifications"] = sorted((r.user_id, r.message) for r in m["notifications"].collect())
    return tabs


@pytest.mark.parametrize("job,rows,schema", [
    (bj.content_review, CONTENT, CONTENT_SCHEMA),
    (bj.apply_booking_status, STATUS, STATUS_SCHEMA),
    (wj.request_withdrawals, WITHDRAW, WITHDRAW_SCHEMA),
])
def test_batch_equals_one_by_one(spark, job, rows, schema):
    m = _market(spark)
    whole = job(m, _cmds(spark, rows, schema), TS)
    batch_m = whole.apply(m)
    seq_m, seq_rejects = m, {}
    for r in rows:
        res = job(seq_m, _cmds(spark, [r], schema), TS)
        seq_rejects.update((x.cmd_id, x.reason) for x in res.rejects.collect())
        seq_m = res.apply(seq_m)
        seq_m = seq_m.replace(**{t: spark.createDataFrame(seq_m[t].collect(), seq_m[t].schema)
                                 for t in ("bookings", "escrow_wallet", "creator_earnings", "withdrawals",
                                           "notifications")})
    assert dict((x.cmd_id, x.reason) for x in whole.rejects.collect()) == seq_rejects
    a, b = _state(batch_m), _state(seq_m)
    for t in a:
        if t == "withdrawals":  # ids of new rows carry the command id either way
            assert a[t] == b[t]
        else:
            assert a[t] == b[t], t


def test_withdrawal_gates(spark):
    res = wj.request_withdrawals(_market(spark), _cmds(spark, WITHDRAW, WITHDRAW_SCHEMA), TS)
    rej = dict((r.cmd_id, r.reason) for r in res.rejects.collect())
    assert rej == {1: "min_amount", 3: "no_payout_details", 4: "insufficient_balance", 5: "insufficient_balance",
                   6: "insufficient_balance"}
    new = res.tables["withdrawals"].filter(F.col("status") == "pending").collect()
    assert [r.amount for r in new] == [D("900.00")] and new[0].details == '{"upi_id":"x"}'


def test_content_fold_is_independent_of_slices(spark):
    m = _market(spark)
    cmds = _cmds(spark, CONTENT, CONTENT_SCHEMA)
    a = bj.content_review(m, cmds, TS)
    b = bj.content_review(m, cmds, TS, ranges=7)
    assert sorted(tuple(r) for r in a.rejects.collect()) == sorted(tuple(r) for r in b.rejects.collect())
    assert sorted(tuple(r) for r in a.tables["bookings"].collect()) == \
        sorted(tuple(r) for r in b.tables["bookings"].collect())
