"""Booking, content, payment and escrow jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.frame import first_reason, last_before, last_by, update_by_key
from souk.functions.ids import hmac_sha256_hex
from souk.functions.text import col_truthy, extname
from souk.operators import notify
from souk.operators.checks import apply_defaults
from souk.plans.base import JobResult, batch_time, new_id, rejects_of, user_of_creator, with_profile
from souk.sources.schema import ENUMS
from souk.sources.tables import conform

BOOKING_STATUSES = ENUMS[("bookings", "status")]


def _flag(df: DataFrame, keys: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Add boolean ``name``: does ``df[left]`` occur in ``keys[right]``?"""
    k = keys.select(F.col(right).alias(f"_{name}_k")).distinct().withColumn(f"_{name}_v", F.lit(True))
    return (df.join(k, df[left] == F.col(f"_{name}_k"), "left")
              .withColumn(name, F.coalesce(F.col(f"_{name}_v"), F.lit(False)))
              .drop(f"_{name}_k", f"_{name}_v"))


def create_bookings(m, cmds: DataFrame, batch_ts) -> JobResult:
    """Brand profile → package exists → campaign empty or the brand's own
    → creator exists (foreign key).  Price is copied from the package; the
    creator is not checked against the package, as in the reference.
    Commands are independent of each other (order-free)."""
    c = with_profile(cmds, m, "brand")
    pkg = m["promotion_packages"].select(F.col("id").alias("_pkg"), F.col("price").alias("_price"))
    camp = m["campaigns"].select(F.col("id").alias("_cm"), F.col("brand_id").alias("_cm_brand"))
    cr = user_of_creator(m)
    c = (c.join(pkg, F.col("package_id") == F.col("_pkg"), "left")
          .join(camp, (F.col("campaign_id") == F.col("_cm")) & (F.col("_cm_brand") == F.col("brand_profile_id")),
                "left")
          .join(cr, F.col("creator_id") == F.col("_cp_id"), "left"))
    c = c.withColumn("reason", first_reason(
        (F.col("brand_profile_id").isNotNull(), "no_brand_profile"),
        (F.col("_pkg").isNotNull(), "package_not_found"),
        (~col_truthy("campaign_id") | F.col("_cm").isNotNull(), "campaign_not_owned"),
        (F.col("_cp_id").isNotNull(), "creator_not_found"),
    ))
    ok = c.filter(F.col("reason").isNull()).withColumn("_bid", new_id("t06", "cmd_id"))
    rows = ok.select(F.col("_bid").alias("id"), F.col("brand_profile_id").alias("brand_id"), "creator_id",
                     "package_id", F.when(col_truthy("campaign_id"), F.col("campaign_id")).alias("campaign_id"),
                     F.lit(None).cast("string").alias("status"), F.col("_price").alias("price"), "notes",
                     batch_time(batch_ts).alias("created_at"))
    new = apply_defaults("bookings", conform(rows, "bookings"), batch_ts)
    ev = notify.events_frame(ok, event="booking_created", event_key=F.col("cmd_id"), user_id="creator_user_id",
                             ref_id="_bid", created_at=batch_time(batch_ts))
    return JobResult(tables={"bookings": m["bookings"].unionByName(new)}, rejects=rejects_of(c),
                     notifications=notify.render(ev, "t06"))


def apply_booking_status(m, cmds: DataFrame, batch_ts) -> JobResult:
    """Booking exists → status in the ENUM (the database rejects others).
    No transition guard: the last command per booking wins.  Each
    ``completed`` command releases the escrow, inserts a ``paid`` earning
    when the booking has none yet (so at most one per booking) and notifies
    the creator — every time."""
    b = m["bookings"].select(F.col("id").alias("_bid"), F.col("creator_id").alias("_bcreator"),
                             F.col("price").alias("_bprice"))
    c = cmds.join(b, F.col("booking_id") == F.col("_bid"), "left")
    c = c.withColumn("reason", first_reason((F.col("_bid").isNotNull(), "not_found"),
                                            (F.col("status").isin(*BOOKING_STATUSES), "enum")))
    ok = c.filter(F.col("reason").isNull())
    last = last_by(ok, "booking_id", "seq", ["status"]).select(F.col("booking_id").alias("id"), "status")
    bookings = update_by_key(m["bookings"], last, "id", ["status"])
    done = ok.filter(F.col("status") == "completed")
    done_b = done.select("booking_id", "_bcreator", "_bprice").dropDuplicates(["booking_id"])
    esc = m["escrow_wallet"]
    esc = (_flag(esc, done_b, "booking_id", "booking_id", "_rel")
           .withColumn("status", F.when(F.col("_rel"), F.lit("released")).otherwise(F.col("status")))
           .drop("_rel"))
    earn_new = (done_b.join(m["creator_earnings"].select(F.col("booking_id").alias("_eb")),
                            F.col("booking_id") == F.col("_eb"), "left_anti")
                .select(new_id("t07", "booking_id").alias("id"), F.col("_bcreator").alias("creator_id"),
                        "booking_id", F.col("_bprice").alias("amount"), F.lit("paid").alias("status"),
                        batch_time(batch_ts).alias("created_at")))
    earnings = m["creator_earnings"].unionByName(conform(earn_new, "creator_earnings"))
    who = done.join(user_of_creator(m), F.col("_bcreator") == F.col("_cp_id"))
    ev = notify.events_frame(who, event="booking_completed", event_key=F.col("cmd_id"), user_id="creator_user_id",
                             ref_id="booking_id", created_at=batch_time(batch_ts))
    return JobResult(tables={"bookings": bookings, "escrow_wallet": esc, "creator_earnings": earnings},
                     rejects=rejects_of(c), notifications=notify.render(ev, "t07"))


# The upload filter's pattern and the video extensions of the reference.
ALLOWED_UPLOAD = "jpeg|jpg|png|gif|webp|mp4|mov|avi|mkv|webm"
VIDEO_EXTS = (".mp4", ".mov", ".avi", ".mkv", ".webm")
DEFAULT_REJECTION = "Content did not meet requirements"
SUBMITTABLE = ("accepted", "content_rejected")


def content_review(m, cmds: DataFrame, batch_ts, ranges: int | None = None) -> JobResult:
    """T8 + T9 together: ``kind`` 'submit' (creator sends content) or
    'reject' (brand rejects it).

    Gates, submit: upload type → booking exists → actor is the creator →
    status accepted or content_rejected → a completed payment exists →
    a file or a URL.  Reject: booking exists → actor is the brand → status
    content_submitted.

    The status gate depends on earlier commands of the same booking.  Take
    the commands that pass every other gate.  Of these a command succeeds
    exactly when the last success was of the other kind or, before any
    success, when the stored status allows it.  So with ``p`` the kind of the
    last such command before it, it succeeds if p differs from its kind, or if
    there is none and the status allows it; and the status any command sees is
    the stored one as long as all such commands before it are of the booking's
    first kind and that was not allowed, else that of p.  This takes one
    segmented scan for p (``last_before``, whose slices hold equal numbers of
    commands however many are of one booking) and the first command of each
    kind per booking, a partial aggregate."""
    b = m["bookings"].alias("bk")
    cp = user_of_creator(m)
    bp = m["brand_profiles"].select(F.col("id").alias("_bp_id"), F.col("user_id").alias("brand_user_id"))
    paid = m["payments"].filter(F.col("payment_status") == "completed").select(F.col("booking_id").alias("_pb"))
    info = (b.join(cp, F.col("bk.creator_id") == F.col("_cp_id"), "left")
             .join(bp, F.col("bk.brand_id") == F.col("_bp_id"), "left")
             .select(F.col("bk.id").alias("_bid"), F.col("bk.status").alias("status0"), "creator_user_id",
                     "brand_user_id"))
    info = _flag(info, paid, "_bid", "_pb", "paid")
    c = cmds.join(info, F.col("booking_id") == F.col("_bid"), "left")
    is_submit = F.col("kind") == "submit"
    has_file = col_truthy("file_name")
    ext = extname(F.col("file_name"))
    file_ok = ~has_file | ext.rlike(ALLOWED_UPLOAD) | F.coalesce(F.col("mime_type"), F.lit("")).rlike(ALLOWED_UPLOAD)
    actor_ok = F.when(is_submit, F.col("creator_user_id") == F.col("actor_user_id")) \
                .otherwise(F.col("brand_user_id") == F.col("actor_user_id"))
    c = (c.withColumn("_pre", first_reason((file_ok | ~is_submit, "file_type"), (F.col("_bid").isNotNull(), "not_found"),
                                           (actor_ok, "not_your_booking")))
          .withColumn("_post", F.when(is_submit, first_reason((F.col("paid"), "unpaid"),
                                                              (has_file | col_truthy("content_url"), "no_content")))))
    cls0 = F.when(F.col("status0").isin(*SUBMITTABLE), "A").when(F.col("status0") == "content_submitted", "B")
    c = c.withColumn("_cls0", F.coalesce(cls0, F.lit("X")))
    c = c.withColumn("_eff", F.when(F.col("_pre").isNull() & F.col("_post").isNull(), F.col("kind")))
    c = last_before(c, ["booking_id"], ["seq", "cmd_id"], {"_p": F.col("_eff")}, ranges)
    first = c.filter(F.col("_eff").isNotNull()).groupBy(F.col("booking_id").alias("_fb")).agg(
        F.min(F.when(is_submit, F.col("seq"))).alias("_first_s"), F.min(F.when(~is_submit, F.col("seq"))).alias("_first_r"))
    c = c.join(first, F.col("booking_id") == F.col("_fb"), "left").drop("_fb")
    # the first kind was not allowed by the stored status, and the other kind has not come yet
    submit_first = F.coalesce(F.col("_first_s") < F.col("_first_r"), F.col("_first_r").isNull())
    refused = F.when(submit_first, F.col("_cls0") != "A").otherwise(F.col("_cls0") != "B")
    other = F.when(submit_first, F.col("_first_r")).otherwise(F.col("_first_s"))
    none_yet = (F.col("_cls0") == "X") | F.col("_p").isNull() | (refused & (other.isNull() | (F.col("seq") <= other)))
    state = F.when(none_yet, F.col("_cls0")).when(F.col("_p") == "submit", "B").otherwise("A")
    state_ok = F.when(is_submit, state == "A").otherwise(state == "B")
    c = c.withColumn("reason", F.coalesce(F.col("_pre"), F.when(~state_ok, F.lit("bad_status")), F.col("_post")))

    ok = c.filter(F.col("reason").isNull())
    ok = ok.withColumn("_ext_raw", F.regexp_extract(F.col("file_name"), r"(\.[^./\\]+)$", 1))
    ok = (ok.withColumn("_url", F.when(has_file, F.concat(F.lit("/uploads/content/content_"), F.col("actor_user_id"),
                                                          F.lit("_"), F.col("cmd_id").cast("string"), F.col("_ext_raw")))
                                 .otherwise(F.col("content_url")))
            .withColumn("_type", F.when(has_file, F.when(extname(F.col("file_name")).isin(*VIDEO_EXTS), "video")
                                        .otherwise("image")).otherwise(F.lit("url")))
            .withColumn("_note", F.when(col_truthy("content_note"), F.col("content_note")))
            .withColumn("_reason_text", F.when(col_truthy("rejection_reason"), F.col("rejection_reason"))
                        .otherwise(F.lit(DEFAULT_REJECTION))))
    last = ok.groupBy(F.col("booking_id").alias("id")).agg(
        F.max_by(F.struct("kind", "_reason_text"), "seq").alias("_l"),
        F.max_by(F.when(is_submit, F.struct("_url", "_type", "_note")), F.when(is_submit, F.col("seq"))).alias("_s"))
    ch = last.select("id",
                     F.when(F.col("_l.kind") == "submit", "content_submitted").otherwise("content_rejected").alias("_st"),
                     F.col("_s").isNotNull().alias("_has_s"), F.col("_s._url").alias("_url"),
                     F.col("_s._type").alias("_type"), F.col("_s._note").alias("_note"),
                     F.when(F.col("_l.kind") == "reject", F.col("_l._reason_text")).alias("_rr"))
    bk = m["bookings"]
    j = bk.join(ch.withColumnRenamed("id", "_cid"), bk["id"] == F.col("_cid"), "left")
    hit, hs = F.col("_cid").isNotNull(), F.col("_has_s")
    bookings = j.select(*[
        F.when(hit, F.col("_st")).otherwise(bk["status"]).alias("status") if col == "status" else
        F.when(hit & hs, F.col("_url")).otherwise(bk["content_url"]).alias(col) if col == "content_url" else
        F.when(hit & hs, F.col("_type")).otherwise(bk["content_type"]).alias(col) if col == "content_type" else
        F.when(hit & hs, F.col("_note")).otherwise(bk["content_note"]).alias(col) if col == "content_note" else
        F.when(hit, F.col("_rr")).otherwise(bk["rejection_reason"]).alias(col) if col == "rejection_reason" else
        bk[col] for col in bk.columns])
    ev = notify.events_frame(
        ok, event=F.when(is_submit, "content_submitted").otherwise("content_rejected"), event_key=F.col("cmd_id"),
        user_id=F.when(is_submit, F.col("brand_user_id")).otherwise(F.col("creator_user_id")),
        ref_id="booking_id", note=F.col("_reason_text"), created_at=batch_time(batch_ts))
    ev = ev.filter(F.col("user_id").isNotNull())
    return JobResult(tables={"bookings": bookings}, rejects=rejects_of(c), notifications=notify.render(ev, "t08"))


def upsert_payment_orders(m, cmds: DataFrame, batch_ts) -> JobResult:
    """Booking exists → status accepted → no completed payment.  The
    booking's first open payment row (by created_at, id) is reset to the new
    order (payment id cleared, status pending), else one row is inserted;
    later commands of the batch reuse that row, so the last order id wins.
    The gateway's order id arrives with the command."""
    b = m["bookings"].select(F.col("id").alias("_bid"), F.col("status").alias("_bstatus"),
                             F.col("price").alias("_price"))
    pays = m["payments"]
    done = pays.filter(F.col("payment_status") == "completed").select(F.col("booking_id").alias("_done"))
    c = _flag(cmds.join(b, F.col("booking_id") == F.col("_bid"), "left"), done, "booking_id", "_done", "_paid")
    c = c.withColumn("reason", first_reason((F.col("_bid").isNotNull(), "not_found"),
                                            (F.col("_bstatus") == "accepted", "not_accepted"),
                                            (~F.col("_paid"), "already_paid")))
    ok = c.filter(F.col("reason").isNull())
    last = last_by(ok, "booking_id", "seq", ["order_id", "_price"])
    open_first = (pays.filter(F.col("payment_status") != "completed")
                  .groupBy(F.col("booking_id").alias("_ob"))
                  .agg(F.min(F.struct("created_at", "id")).alias("_first")))
    tgt = last.join(open_first, F.col("booking_id") == F.col("_ob"), "left")
    upd = tgt.filter(F.col("_ob").isNotNull()).select(F.col("_first.id").alias("id"),
                                                     F.col("order_id").alias("razorpay_order_id"),
                                                     F.lit(None).cast("string").alias("razorpay_payment_id"),
                                                     F.lit("pending").alias("payment_status"))
    ins = tgt.filter(F.col("_ob").isNull()).select(
        new_id("t10", "booking_id").alias("id"), "booking_id", F.col("order_id").alias("razorpay_order_id"),
        F.col("_price").alias("amount"), F.lit("pending").alias("payment_status"),
        batch_time(batch_ts).alias("created_at"))
    payments = update_by_key(pays, upd, "id", ["razorpay_order_id", "razorpay_payment_id", "payment_status"]) \
        .unionByName(conform(ins, "payments"))
    orders = ok.select("cmd_id", "booking_id", "order_id",
                       F.round(F.col("_price") * 100).cast("bigint").alias("amount_paise"),
                       F.lit("INR").alias("currency"))
    return JobResult(tables={"payments": payments}, rejects=rejects_of(c), outputs={"orders": orders})


def settle_payments(m, cmds: DataFrame, key: bytes | str, batch_ts) -> JobResult:
    """The callback's HMAC-SHA256(order_id|payment_id) must equal its
    signature → the booking must exist.  The payment with that order id
    becomes completed (last payment id wins); escrow is upserted to
    ``held``: a new row with the booking price, or an existing one keeps its
    amount and returns to held — even a released one, as in the reference.
    The creator is notified per accepted callback.  The key is a parameter
    and never stored."""
    sig = hmac_sha256_hex(key, F.concat_ws("|", F.col("order_id"), F.col("payment_id")))
    b = m["bookings"].select(F.col("id").alias("_bid"), F.col("price").alias("_price"),
                             F.col("creator_id").alias("_bcreator"), F.col("brand_id").alias("_bbrand"))
    c = cmds.join(b, F.col("booking_id") == F.col("_bid"), "left")
    c = c.withColumn("reason", first_reason((sig == F.col("signature"), "signature_mismatch"),
                                            (F.col("_bid").isNotNull(), "booking_not_found")))
    ok = c.filter(F.col("reason").isNull())
    last = last_by(ok, "order_id", "seq", ["payment_id"]).select(
        F.col("order_id").alias("razorpay_order_id"), F.col("payment_id").alias("razorpay_payment_id"),
        F.lit("completed").alias("payment_status"))
    payments = update_by_key(m["payments"], last, "razorpay_order_id", ["razorpay_payment_id", "payment_status"])
    escrow, notes = held_escrow(m, ok, batch_ts)
    return JobResult(tables={"payments": payments, "escrow_wallet": escrow}, rejects=rejects_of(c), notifications=notes)


def held_escrow(m, ok: DataFrame, batch_ts) -> tuple[DataFrame, DataFrame]:
    """ok: the accepted callbacks.  The escrow after them (a row per booking
    held, amounts kept) and the creators' notifications, one per callback."""
    held = ok.select("booking_id", "_price").dropDuplicates(["booking_id"])
    esc = m["escrow_wallet"]
    esc_upd = _flag(esc, held, "booking_id", "booking_id", "_h").withColumn(
        "status", F.when(F.col("_h"), F.lit("held")).otherwise(F.col("status"))).drop("_h")
    esc_new = held.join(esc.select(F.col("booking_id").alias("_eb")), F.col("booking_id") == F.col("_eb"),
                        "left_anti").select(new_id("t11", "booking_id").alias("id"), "booking_id",
                                            F.col("_price").alias("amount"), F.lit("held").alias("status"),
                                            batch_time(batch_ts).alias("created_at"))
    bp = m["brand_profiles"].select(F.col("id").alias("_bpid"))
    who = (ok.join(bp, F.col("_bbrand") == F.col("_bpid"))
             .join(user_of_creator(m), F.col("_bcreator") == F.col("_cp_id")))
    ev = notify.events_frame(who, event="payment_received", event_key=F.col("cmd_id"), user_id="creator_user_id",
                             ref_id="booking_id", created_at=batch_time(batch_ts))
    return esc_upd.unionByName(conform(esc_new, "escrow_wallet")), notify.render(ev, "t11")


def release_escrow(m, cmds: DataFrame, batch_ts) -> JobResult:
    """T12 (admin): the booking needs a ``held`` escrow.  The first such
    command per booking (a grouped ``min`` of seq, partial per task)
    releases it and completes the booking; later ones find it released.  Notifies the creator with the amount and writes an
    audit row.  Unlike T7 no earning is inserted."""
    held = m["escrow_wallet"].filter(F.col("status") == "held").select(
        F.col("booking_id").alias("_hb"), F.col("amount").alias("_amount"))
    held = held.dropDuplicates(["_hb"])
    c = cmds.join(held, F.col("booking_id") == F.col("_hb"), "left")
    first = (c.filter(F.col("_hb").isNotNull()).groupBy(F.col("booking_id").alias("_fb"))
              .agg(F.min("seq").alias("_first_seq")))
    c = c.join(first, F.col("booking_id") == F.col("_fb"), "left")
    c = c.withColumn("reason", first_reason((F.col("_first_seq") == F.col("seq"), "no_held_escrow")))
    ok = c.filter(F.col("reason").isNull())
    rel = ok.select("booking_id")
    esc = _flag(m["escrow_wallet"], rel, "booking_id", "booking_id", "_r").withColumn(
        "status", F.when(F.col("_r"), F.lit("released")).otherwise(F.col("status"))).drop("_r")
    bookings = update_by_key(m["bookings"], ok.select(F.col("booking_id").alias("id"),
                                                      F.lit("completed").alias("status")), "id", ["status"])
    bk = m["bookings"].select(F.col("id").alias("_bkid"), F.col("creator_id").alias("_bcreator"))
    who = ok.join(bk, F.col("booking_id") == F.col("_bkid")).join(user_of_creator(m),
                                                                   F.col("_bcreator") == F.col("_cp_id"))
    ev = notify.events_frame(who, event="escrow_released", event_key=F.col("cmd_id"), user_id="creator_user_id",
                             ref_id="booking_id", amount="_amount", created_at=batch_time(batch_ts))
    actions = ok.select(F.lit("escrow_released").alias("event"), F.col("cmd_id").cast("string").alias("event_key"),
                        F.col("actor_user_id").alias("actor"), F.col("booking_id").alias("ref_id"),
                        F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("title_text"),
                        batch_time(batch_ts).alias("created_at"))
    return JobResult(tables={"escrow_wallet": esc, "bookings": bookings}, rejects=rejects_of(c),
                     notifications=notify.render(ev, "t12"), audit=notify.audit(actions, "t12"))
