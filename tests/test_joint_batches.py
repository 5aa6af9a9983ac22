"""Batches of commands that depend on each other, against the handlers applied
one command at a time (plain Python) to hundreds of random commands."""

import hashlib
import hmac
import random
from decimal import Decimal

import pytest

from souk.plans.payments import payment_batch
from souk.plans.withdrawals import withdrawal_batch
from tests.helpers import bundle, ts

TS = "2024-02-01 00:00:00"
KEY = b"secret of the test"


def _sign(order, payment):
    return hmac.new(KEY, f"{order}|{payment}".encode(), hashlib.sha256).hexdigest()


def _payment_world(rng):
    bookings = [{"id": f"b{i}", "status": rng.choice(["accepted"] * 4 + ["pending"]), "price": Decimal(rng.randint(1, 900)), "creator_id": "c1",
                 "brand_id": "r1"} for i in range(14)]
    pays = []
    for i in range(12):
        for j in range(rng.randint(0, 3)):
            pays.append({"id": f"p{i}-{j}", "booking_id": f"b{i}", "razorpay_order_id": rng.choice([f"o{rng.randint(0, 9)}", f"s{i}", None]),
                         "payment_status": rng.choice(["pending"] * 4 + ["failed", "completed"]), "created_at": ts(rng.randint(0, 2)), "amount": Decimal(5)})
    escrow = [{"id": f"e{i}", "booking_id": f"b{i}", "amount": Decimal(3), "status": rng.choice(["held", "released"])} for i in range(0, 14, 3)]
    cmds = []
    for n in range(400):
        bk = "b0" if rng.random() < 0.34 else f"b{rng.randint(0, 14)}"
        if rng.random() < 0.5:
            cmds.append((n, n * 7, "order", bk, rng.choice([f"o{rng.randint(0, 9)}", f"n{n}", f"s{rng.randint(0, 11)}"]), None, None))
        else:
            order = rng.choice([c[4] for c in cmds[-30:]] + [f"o{rng.randint(0, 9)}", f"s{rng.randint(0, 11)}"])
            cmds.append((n, n * 7, "callback", bk, order, f"pay{n}", "bad" if rng.random() < 0.7 else _sign(order, f"pay{n}")))
    return bookings, pays, escrow, cmds


def _payments_one_by_one(bookings, pays, escrow, cmds):
    bookings = {b["id"]: b for b in bookings}
    pays = [{"id": None, "razorpay_payment_id": None, **p} for p in pays]
    held, rejects, orders, notes = {e["booking_id"]: dict(e) for e in escrow}, [], [], []
    for cmd, _, kind, bk, order, payment, sig in cmds:
        if kind == "order":
            own = [p for p in pays if p["booking_id"] == bk]
            if bk not in bookings:
                rejects.append((cmd, "not_found"))
            elif bookings[bk]["status"] != "accepted":
                rejects.append((cmd, "not_accepted"))
            elif any(p["payment_status"] == "completed" for p in own):
                rejects.append((cmd, "already_paid"))
            else:
                orders.append((cmd, bk, order, int(bookings[bk]["price"] * 100)))
                if own:
                    slot = min(own, key=lambda p: (p["created_at"], p["id"]))
                    slot.update(razorpay_order_id=order, razorpay_payment_id=None, payment_status="pending")
                else:
                    pays.append({"id": "new", "booking_id": bk, "razorpay_order_id": order, "razorpay_payment_id": None,
                                 "payment_status": "pending", "created_at": ts(10 ** 6), "amount": bookings[bk]["price"]})
        elif sig != _sign(order, payment):
            rejects.append((cmd, "signature_mismatch"))
        elif bk not in bookings:
            rejects.append((cmd, "booking_not_found"))
        else:
            for p in pays:
                if p["razorpay_order_id"] == order:
                    p.update(razorpay_payment_id=payment, payment_status="completed")
            held.setdefault(bk, {"booking_id": bk, "amount": bookings[bk]["price"]})["status"] = "held"
            notes.append(bk)
    return pays, held, rejects, orders, notes


@pytest.mark.parametrize("seed,ranges", [(1, 1), (2, 5), (3, 40), (4, 8)])
def test_payment_batch_equals_one_at_a_time(spark, seed, ranges):
    bookings, pays, escrow, cmds = _payment_world(random.Random(seed))
    m = bundle(spark, bookings=bookings, payments=pays, escrow_wallet=escrow, brand_profiles=[{"id": "r1", "user_id": "u-r1"}],
               creator_profiles=[{"id": "c1", "user_id": "u-c1"}])
    df = spark.createDataFrame(cmds, "cmd_id long, seq long, kind string, booking_id string, order_id string, payment_id string, signature string")
    got = payment_batch(m, df, KEY, TS, ranges)
    want_pays, held, rejects, orders, notes = _payments_one_by_one(bookings, pays, escrow, cmds)
    assert sorted(tuple(r) for r in got.rejects.collect()) == sorted(rejects)
    assert sorted(tuple(r)[:4] for r in got.outputs["orders"].collect()) == sorted(orders)
    cols = ("booking_id", "razorpay_order_id", "razorpay_payment_id", "payment_status", "amount")
    old = {p["id"] for p in pays}
    row = lambda p: str((p["id"] if p["id"] in old else "new", *[p[c] for c in cols[:4]], float(p["amount"])))
    assert sorted(row(r.asDict()) for r in got.tables["payments"].collect()) == sorted(map(row, want_pays))
    assert sorted((r["booking_id"], float(r["amount"]), r["status"]) for r in got.tables["escrow_wallet"].collect()) == sorted(
        (e["booking_id"], float(e["amount"]), e["status"]) for e in held.values())
    assert got.notifications.count() == len(notes)
    assert {"already_paid", "signature_mismatch"} <= {x for _, x in rejects} and any(p["payment_status"] == "completed" and p["id"] == "new" for p in want_pays)


def _request_id(cmd):
    h = hashlib.sha256(f"t13|{cmd}".encode()).hexdigest()[:32]
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def _withdrawal_world(rng):
    earned = [{"id": f"n{i}", "creator_id": f"c{i % 6}", "amount": Decimal(rng.randint(100, 90_000)) / 100 + 3000, "status": rng.choice(["paid"] * 4 + ["pending"])}
              for i in range(40)]
    stored = [{"id": f"w{i}", "creator_id": f"c{rng.randint(0, 6)}", "amount": Decimal(rng.randint(100, 300_000)) / 100,
               "status": rng.choice(["approved", "rejected", "paid"] * 3 + ["pending"])} for i in range(14)]
    cmds = []
    for n in range(360):
        if rng.random() < 0.5 or not cmds:
            who = "u0" if rng.random() < 0.34 else f"u{rng.randint(0, 7)}"
            amount = rng.choice(["100", "99.99", "250.5", "12000", "333.33", "9000.01", "abc", "150xyz", ""])
            cmds.append((n, n * 3, "request", who, amount, rng.choice(["upi", "upi", "upi", None]), rng.choice(["acc", None]), None, None))
        else:
            back = [c[0] for c in cmds[-9:] if c[2] == "request"] or [0]
            target = rng.choice([_request_id(rng.choice(back)), _request_id(rng.choice(back)), f"w{rng.randint(0, 14)}", _request_id(n + 1)])
            cmds.append((n, n * 3, "decide", "admin", None, None, None, target, rng.choice(["approved", "rejected", "rejected", "paid"])))
    return earned, stored, cmds


def _number(text):
    out = ""
    for ch in text or "":
        if not (ch.isdigit() or ch == "."):
            break
        out += ch
    return float(out) if out else None


def _withdrawals_one_by_one(earned, stored, cmds):
    rows, rejects, notes, audits = {w["id"]: dict(w) for w in stored}, [], [], 0
    for cmd, _, kind, who, amount, upi, bank, target, status in cmds:
        if kind == "request":
            x, creator = _number(amount), "c" + who[1:]
            own = [w for w in rows.values() if w["creator_id"] == creator]
            free = float(sum(e["amount"] for e in earned if e["creator_id"] == creator and e["status"] == "paid")) - float(
                sum(w["amount"] for w in own if w["status"] in ("pending", "approved")))
            if not amount or x is None or x < 100:
                rejects.append((cmd, "min_amount"))
            elif not upi and not bank:
                rejects.append((cmd, "no_payout_details"))
            elif who == "u7":
                rejects.append((cmd, "no_profile"))
            elif x > free:
                rejects.append((cmd, "insufficient_balance"))
            elif any(w["status"] == "pending" for w in own):
                rejects.append((cmd, "pending_exists"))
            else:
                rows[_request_id(cmd)] = {"id": _request_id(cmd), "creator_id": creator, "amount": Decimal(str(x)), "status": "pending"}
                notes.append(who)
        elif status not in ("approved", "rejected"):
            rejects.append((cmd, "invalid_status"))
        elif target not in rows:
            rejects.append((cmd, "not_found"))
        else:
            rows[target]["status"] = status
            notes.append("u" + rows[target]["creator_id"][1:])
            audits += status == "approved"
    return rows, rejects, notes, audits


@pytest.mark.parametrize("seed,fold_rows", [(1, 10_000), (2, 70), (3, 45)])
def test_withdrawal_batch_equals_one_at_a_time(spark, seed, fold_rows):
    """Balances fall and rise inside the batch, also for a creator that lies in several slices."""
    earned, stored, cmds = _withdrawal_world(random.Random(seed))
    m = bundle(spark, creator_earnings=earned, withdrawals=stored, users=[{"id": f"u{i}"} for i in range(8)],
               creator_profiles=[{"id": f"c{i}", "user_id": f"u{i}"} for i in range(7)])
    df = spark.createDataFrame([(*c[:7], None, None, *c[7:], None) for c in cmds],
                               "cmd_id long, seq long, kind string, actor_user_id string, amount string, upi_id string, bank_account string, "
                               "ifsc_code string, account_holder string, withdrawal_id string, status string, note string")
    got = withdrawal_batch(m, df, TS, fold_rows)
    rows, rejects, notes, audits = _withdrawals_one_by_one(earned, stored, cmds)
    assert sorted(tuple(r) for r in got.rejects.collect()) == sorted(rejects)
    assert sorted((r["id"], r["creator_id"], float(r["amount"]), r["status"]) for r in got.tables["withdrawals"].collect()) == sorted(
        (w["id"], w["creator_id"], float(w["amount"]), w["status"]) for w in rows.values())
    assert sorted(r["user_id"] for r in got.notifications.collect()) == sorted(notes) and got.audit.count() == audits
    passed = [c[0] for c in cmds if c[2] == "request" and c[3] == "u0" and _request_id(c[0]) in rows]
    assert passed and len(rows) - len(stored) > 7 and {"insufficient_balance", "pending_exists", "not_found"} <= {x for _, x in rejects}


def test_withdrawal_batch_without_commands(spark):
    m = bundle(spark, withdrawals=[{"id": "w1", "creator_id": "c1", "amount": Decimal(5), "status": "pending"}])
    empty = spark.createDataFrame([], "cmd_id long, seq long, kind string, actor_user_id string, amount string, upi_id string, bank_account string, "
                                      "ifsc_code string, account_holder string, withdrawal_id string, status string, note string")
    got = withdrawal_batch(m, empty, TS)
    assert [r["id"] for r in got.tables["withdrawals"].collect()] == ["w1"] and got.rejects.count() == 0
