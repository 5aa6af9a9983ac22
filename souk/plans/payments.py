"""Payment orders and payment callbacks in one batch (T10 and T11 mixed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.frame import first_reason, last_before
from souk.functions.ids import hmac_sha256_hex
from souk.plans.base import JobResult, batch_time, new_id, rejects_of
from souk.session import checkpoint_dir
from souk.plans.bookings import held_escrow
from souk.sources.tables import conform

#: Before every command.
STORED = -(1 << 62)


def payment_batch(m, cmds: DataFrame, key: bytes | str, batch_ts, ranges: int | None = None) -> JobResult:
    """T10 + T11 together: ``kind`` 'order' (a payment order for a booking) or
    'callback' (the gateway reports a payment), by ``seq``.

    Gates, order: booking exists → status accepted → no completed payment.
    Callback: signature → booking exists.  An order puts its order id on the
    booking's first open payment (its slot, a new row if there is none); a
    callback completes whatever payment bears its order id at that time, of
    any booking, and holds its own booking's escrow.

    What commands do to each other: a completed payment stays completed and
    ends its booking's orders, and up to then every order passes.  So an
    order's id is on the slot from its seq to the next order's, an untouched
    open payment bears its stored id throughout, and a booking is paid at the
    first callback that meets one of its ids in that time.  Two segmented
    scans give, for each order, the next order of the booking and the next
    callback of the order id; the rest are grouped minima and maxima.  Neither
    a booking nor an order id is gathered in one task."""
    b = m["bookings"].select(F.col("id").alias("_bid"), F.col("status").alias("_bstatus"), F.col("price").alias("_price"),
                             F.col("creator_id").alias("_bcreator"), F.col("brand_id").alias("_bbrand"))
    pays = m["payments"]
    is_order = F.col("kind") == "order"
    is_done = F.col("payment_status") == "completed"
    by_booking = pays.groupBy(F.col("booking_id").alias("_pb")).agg(
        F.max(F.coalesce(is_done, F.lit(False))).alias("_paid0"),
        F.min(F.when(~is_done, F.struct("created_at", "id", F.col("razorpay_order_id").alias("oid")))).alias("_slot"))
    c = cmds.join(b, F.col("booking_id") == F.col("_bid"), "left").join(by_booking, F.col("booking_id") == F.col("_pb"), "left")
    sig = hmac_sha256_hex(key, F.concat_ws("|", F.col("order_id"), F.col("payment_id")))
    static = F.when(is_order, first_reason((F.col("_bid").isNotNull(), "not_found"), (F.col("_bstatus") == "accepted", "not_accepted"),
                                           (~F.coalesce("_paid0", F.lit(False)), "already_paid"))) \
              .otherwise(first_reason((sig == F.col("signature"), "signature_mismatch"), (F.col("_bid").isNotNull(), "booking_not_found")))
    checkpoint_dir(m.spark)
    c = c.withColumn("_static", static).checkpoint()  # read at each step from here on
    live = c.filter(F.col("_static").isNull())
    orders = live.filter(is_order).select("booking_id", "seq", "order_id")
    calls = live.filter(~is_order).select("order_id", "seq", "payment_id")

    # the ids that open payments bear: from when, and until the next order of the slot
    slots = by_booking.filter(F.col("_slot").isNotNull() & ~F.col("_paid0")).checkpoint()
    slot_ids = slots.select(F.col("_pb").alias("booking_id"), F.lit(STORED).alias("seq"), F.col("_slot.oid").alias("order_id"))
    borne = last_before(orders.unionByName(slot_ids), ["booking_id"], ["seq"], {"_until": F.col("seq")}, ranges, after=True)
    others = pays.filter(~is_done).join(slots.select(F.col("_pb").alias("booking_id"), F.col("_slot.id").alias("_sid")), "booking_id") \
        .filter(F.col("id") != F.col("_sid")).select("booking_id", F.lit(STORED).alias("seq"), F.col("razorpay_order_id").alias("order_id"))
    borne = borne.unionByName(others, allowMissingColumns=True).filter(F.col("order_id").isNotNull())
    line = borne.unionByName(calls.select("order_id", "seq", F.col("seq").alias("_call")), allowMissingColumns=True)
    met = last_before(line, ["order_id"], ["seq"], {"_next": F.col("_call")}, ranges, after=True)
    hit = F.col("_call").isNull() & F.col("_next").isNotNull() & (F.col("_until").isNull() | (F.col("_next") < F.col("_until")))
    paid = met.filter(hit).groupBy(F.col("booking_id").alias("_hb")).agg(F.min("_next").alias("_paid_at"))
    c = c.join(paid, F.col("booking_id") == F.col("_hb"), "left")
    c = c.withColumn("reason", F.coalesce("_static", F.when(is_order & (F.col("seq") > F.col("_paid_at")), F.lit("already_paid")))).checkpoint()
    ok = c.filter(F.col("reason").isNull())

    # the payments as the orders leave them, each with the time since when it bears its id
    last = ok.filter(is_order).groupBy(F.col("booking_id").alias("_ob")).agg(
        F.max("seq").alias("_since"), F.max_by("order_id", "seq").alias("_oid"), F.max_by("_price", "seq").alias("_amount"),
        F.max_by("_slot.id", "seq").alias("_sid"))
    new = last.filter(F.col("_sid").isNull()).select(
        new_id("t10", "_ob").alias("id"), F.col("_ob").alias("booking_id"), F.col("_oid").alias("razorpay_order_id"),
        F.col("_amount").alias("amount"), F.lit("pending").alias("payment_status"), batch_time(batch_ts).alias("created_at"))
    new = conform(new, "payments").join(last.select(F.col("_ob").alias("booking_id"), "_since"), "booking_id")
    reset = last.filter(F.col("_sid").isNotNull()).select("_sid", "_oid", "_since")
    now = pays.join(reset, F.col("id") == F.col("_sid"), "left")
    was = F.col("_sid").isNotNull()
    now = now.withColumns({"razorpay_order_id": F.when(was, F.col("_oid")).otherwise(F.col("razorpay_order_id")),
                           "razorpay_payment_id": F.when(~was, F.col("razorpay_payment_id")),
                           "payment_status": F.when(was, F.lit("pending")).otherwise(F.col("payment_status"))})
    now = now.unionByName(new, allowMissingColumns=True)
    call = calls.groupBy(F.col("order_id").alias("_co")).agg(F.max("seq").alias("_cs"), F.max_by("payment_id", "seq").alias("_cp"))
    now = now.join(call, F.col("razorpay_order_id") == F.col("_co"), "left")
    done = F.coalesce(F.col("_cs") > F.coalesce("_since", F.lit(STORED)), F.lit(False))
    payments = now.withColumns({"razorpay_payment_id": F.when(done, F.col("_cp")).otherwise(F.col("razorpay_payment_id")),
                                "payment_status": F.when(done, F.lit("completed")).otherwise(F.col("payment_status"))})

    accepted = ok.filter(is_order).select("cmd_id", "booking_id", "order_id", F.round(F.col("_price") * 100).cast("bigint").alias("amount_paise"),
                                          F.lit("INR").alias("currency"))
    escrow, notes = held_escrow(m, ok.filter(~is_order), batch_ts)
    return JobResult(tables={"payments": payments.select(pays.columns), "escrow_wallet": escrow}, rejects=rejects_of(c),
                     notifications=notes, outputs={"orders": accepted})
