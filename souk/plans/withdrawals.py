"""Withdrawal jobs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.frame import first_reason, last_before, last_by, ranged, update_by_key
from souk.functions.text import col_parse_float, col_truthy
from souk.operators import notify
from souk.operators.money import BALANCE_WITHDRAWN, details_json
from souk.plans.base import JobResult, batch_time, new_id, rejects_of, with_profile
from souk.session import checkpoint_dir, run_folder, stored
from souk.sources.tables import FEW_ROWS, conform

MIN_WITHDRAWAL = 100
SUPPORT_NOTE = "Please contact support."


def _balances(m) -> DataFrame:
    """Per creator: paid earnings, pending+approved withdrawals (unfloored
    balance as the reference computes it, in floating point) and whether a
    pending withdrawal exists."""
    e = m["creator_earnings"].filter(F.col("status") == "paid").groupBy(F.col("creator_id").alias("_c")).agg(
        F.sum("amount").alias("_earned"))
    w = m["withdrawals"].groupBy(F.col("creator_id").alias("_c")).agg(
        F.sum(F.when(F.col("status").isin(*BALANCE_WITHDRAWN), F.col("amount"))).alias("_wd"),
        F.max(F.col("status") == "pending").alias("_pending0"))
    return e.join(w, "_c", "full").select(
        "_c", (F.coalesce(F.col("_earned").cast("double"), F.lit(0.0))
               - F.coalesce(F.col("_wd").cast("double"), F.lit(0.0))).alias("_avail0"),
        F.coalesce("_pending0", F.lit(False)).alias("_pending0"))


def request_withdrawals(m, cmds: DataFrame, batch_ts) -> JobResult:
    """Amount ≥ 100 → UPI id or bank account given → creator profile →
    amount ≤ balance (unfloored) → no pending withdrawal; then a pending
    withdrawal with the payout details as JSON, and a notification.

    Once a command succeeds, the new pending row makes every later command
    of that creator fail — at the balance gate when its amount exceeds the
    reduced balance, else at the pending gate.  So per creator at most the
    first command that passes the balance with no pending row succeeds; a
    ``min`` per creator finds it (partial aggregate, skew-safe)."""
    c = with_profile(cmds, m, "creator").withColumn("_amt", col_parse_float("amount"))
    c = c.join(_balances(m), F.col("creator_profile_id") == F.col("_c"), "left") \
         .withColumn("_avail0", F.coalesce("_avail0", F.lit(0.0))) \
         .withColumn("_pending0", F.coalesce("_pending0", F.lit(False)))
    static = first_reason((col_truthy("amount") & (F.col("_amt") >= MIN_WITHDRAWAL), "min_amount"),
                          (col_truthy("upi_id") | col_truthy("bank_account"), "no_payout_details"),
                          (F.col("creator_profile_id").isNotNull(), "no_profile"))
    c = c.withColumn("_static", static)
    c = c.withColumn("_stored", F.col("_amt").cast("decimal(12,2)"))
    cand = c.filter(F.col("_static").isNull() & (F.col("_amt") <= F.col("_avail0")) & ~F.col("_pending0"))
    win = cand.groupBy(F.col("creator_profile_id").alias("_wc")).agg(
        F.min(F.struct("seq", "_stored")).alias("_win"))
    c = c.join(win, F.col("creator_profile_id") == F.col("_wc"), "left")
    after = F.col("_win").isNotNull() & (F.col("seq") > F.col("_win.seq"))
    avail = F.when(after, F.col("_avail0") - F.col("_win._stored").cast("double")).otherwise(F.col("_avail0"))
    pending = F.col("_pending0") | after
    c = c.withColumn("reason", F.coalesce(
        F.col("_static"),
        F.when(F.col("_amt") > avail, F.lit("insufficient_balance")),
        F.when(pending, F.lit("pending_exists"))))
    ok = c.filter(F.col("reason").isNull())
    rows = ok.select(new_id("t13", "cmd_id").alias("id"), F.col("creator_profile_id").alias("creator_id"),
                     F.col("_stored").alias("amount"), F.lit("pending").alias("status"),
                     details_json(F.col("upi_id"), F.col("bank_account"), F.col("ifsc_code"),
                                  F.col("account_holder")).alias("details"),
                     batch_time(batch_ts).alias("created_at"))
    ev = notify.events_frame(ok, event="withdrawal_requested", event_key=F.col("cmd_id"), user_id="actor_user_id",
                             amount="_amt", created_at=batch_time(batch_ts))
    return JobResult(tables={"withdrawals": m["withdrawals"].unionByName(conform(rows, "withdrawals"))},
                     rejects=rejects_of(c), notifications=notify.render(ev, "t13"))


def decide_withdrawals(m, cmds: DataFrame, batch_ts) -> JobResult:
    """T14 (admin): status approved or rejected → withdrawal exists.  No
    state guard: the last decision per withdrawal wins; every accepted
    command notifies the creator, and approvals write an audit row with the
    amount as the database prints it."""
    w = m["withdrawals"].select(F.col("id").alias("_wid"), F.col("creator_id").alias("_wc"),
                                F.col("amount").alias("_wamount"))
    c = cmds.join(w, F.col("withdrawal_id") == F.col("_wid"), "left")
    c = c.withColumn("reason", first_reason((F.col("status").isin("approved", "rejected"), "invalid_status"),
                                            (F.col("_wid").isNotNull(), "not_found")))
    ok = c.filter(F.col("reason").isNull())
    last = last_by(ok, "withdrawal_id", "seq", ["status"]).select(F.col("withdrawal_id").alias("id"), "status")
    withdrawals = update_by_key(m["withdrawals"], last, "id", ["status"])
    notes, audit = decision_events(m, ok, batch_ts)
    return JobResult(tables={"withdrawals": withdrawals}, rejects=rejects_of(c), notifications=notes, audit=audit)


def decision_events(m, ok: DataFrame, batch_ts) -> tuple[DataFrame, DataFrame]:
    """ok: the accepted decisions.  The creators' notifications, and the audit rows of approvals."""
    approved = ok.filter(F.col("status") == "approved")
    actions = approved.select(F.lit("withdrawal_approved").alias("event"),
                              F.col("cmd_id").cast("string").alias("event_key"), F.col("actor_user_id").alias("actor"),
                              F.col("withdrawal_id").alias("ref_id"), F.col("_wamount").cast("string").alias("note"),
                              F.col("_wc").alias("title_text"), batch_time(batch_ts).alias("created_at"))
    cp = m["creator_profiles"].select(F.col("id").alias("_cpid"), F.col("user_id").alias("_cpu"))
    u = m["users"].select(F.col("id").alias("_uid"))
    who = ok.join(cp, F.col("_wc") == F.col("_cpid")).join(u, F.col("_cpu") == F.col("_uid"))
    ev = notify.events_frame(
        who, event=F.when(F.col("status") == "approved", "withdrawal_approved").otherwise("withdrawal_rejected"),
        event_key=F.col("cmd_id"), user_id="_uid", amount="_wamount",
        note=F.when(col_truthy("note"), F.col("note")).otherwise(F.lit(SUPPORT_NOTE)),
        created_at=batch_time(batch_ts))
    return notify.render(ev, "t14"), notify.audit(actions, "t14")


#: Commands of one creator that a task folds at a time.
FOLD_ROWS = 200_000


def _fold(batches):
    """The commands of creators, by creator, slice and seq, one after another:
    per command its reason, and after each slice the creator's state."""
    who, cents, waiting, live = None, 0, 0, {}
    for b in batches:
        out = []
        for r in b.to_pylist():
            if who != (r["creator"], r["_rg"]):
                if who is not None:
                    out.append((None, None, *who, cents, waiting, list(live), list(live.values())))
                who, cents, waiting = (r["creator"], r["_rg"]), r["withdrawn"], r["pending"]
                live = dict(zip(r["live"] or [], r["todo"] or [], strict=True))
            reason = None
            if r["kind"] == "request":
                if r["amt"] > r["earned"] / 100 - cents / 100:
                    reason = "insufficient_balance"
                elif waiting:
                    reason = "pending_exists"
                else:
                    cents, waiting = cents + r["stored"], waiting + 1
                    if r["n_dec"]:
                        live[r["cmd_id"]] = r["n_dec"]
            elif r["target"] is not None and r["target"] not in live:
                reason = "not_found"
            else:
                cents, waiting = cents + r["d_cents"], waiting + r["d_pending"]
                if r["target"] is not None:
                    live[r["target"]] -= 1
                    if not live[r["target"]]:
                        del live[r["target"]]
            out.append((r["cmd_id"], reason, *who, None, None, None, None))
        yield pa.RecordBatch.from_pylist([dict(zip(FOLDED.names, x, strict=True)) for x in out], FOLDED)
    if who is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(FOLDED.names, (None, None, *who, cents, waiting, list(live), list(live.values())),
                                                   strict=True))], FOLDED)


FOLDED = pa.schema([("cmd_id", pa.int64()), ("reason", pa.string()), ("creator", pa.string()), ("_rg", pa.int32()),
                    ("withdrawn", pa.int64()), ("pending", pa.int64()), ("live", pa.list_(pa.int64())), ("todo", pa.list_(pa.int64()))])
FOLDED_SQL = ("cmd_id long, reason string, creator string, _rg int, withdrawn long, pending long, live array<long>, todo array<long>")


def _cents(col):
    return (col * 100).cast("bigint")


def withdrawal_batch(m, cmds: DataFrame, batch_ts, fold_rows: int = FOLD_ROWS) -> JobResult:
    """T13 + T14 together: ``kind`` 'request' (a creator asks for money) or
    'decide' (an admin approves or rejects a withdrawal, stored or asked for
    earlier in the batch: its id follows from the request's command).

    Gates as in the two jobs.  Whether a request passes depends on the
    creator's balance and pending withdrawal at that time, so on which earlier
    requests passed and how they were decided.  What is known beforehand is
    taken out: gates that look at the command alone, and what a decision
    changes (the status before it is that of the decision before it, or the
    first one).  The rest is a fold over a creator's commands with a small
    state: cents withdrawn, pending withdrawals, and the requests that passed
    and are decided later.  It runs over slices of the order by creator and
    seq (``ranged``) of about ``fold_rows`` commands; creators that lie in
    several slices hand their state from slice to slice, a round each, so a
    creator with a third of all commands never meets one task."""
    is_req = F.col("kind") == "request"
    c = with_profile(cmds, m, "creator").withColumn("_amt", col_parse_float("amount")) \
        .withColumn("_stored", F.col("_amt").cast("decimal(12,2)"))
    asked = first_reason((col_truthy("amount") & (F.col("_amt") >= MIN_WITHDRAWAL), "min_amount"),
                         (col_truthy("upi_id") | col_truthy("bank_account"), "no_payout_details"),
                         (F.col("creator_profile_id").isNotNull(), "no_profile"))
    checkpoint_dir(m.spark)
    c = c.withColumn("_early", F.when(is_req, asked)).checkpoint()  # read at each step from here on
    own = c.filter(is_req & F.col("_early").isNull()).select(
        new_id("t13", "cmd_id").alias("_rid"), F.col("cmd_id").alias("target"), F.col("seq").alias("_rseq"),
        F.col("creator_profile_id").alias("_rc"), F.col("_stored").alias("_ramount"))
    w = m["withdrawals"].select(F.col("id").alias("_wid"), F.col("creator_id").alias("_wc"), F.col("amount").alias("_wamount"),
                                F.col("status").alias("_wstatus"))
    d = c.filter(~is_req).join(w, F.col("withdrawal_id") == F.col("_wid"), "left")
    d = d.join(own, (F.col("withdrawal_id") == F.col("_rid")) & (F.col("_rseq") < F.col("seq")), "left")
    d = d.withColumn("_early", first_reason((F.col("status").isin("approved", "rejected"), "invalid_status"),
                                            (F.col("_wid").isNotNull() | F.col("_rid").isNotNull(), "not_found")))
    d = d.withColumns({"_wc": F.coalesce("_wc", "_rc"), "_wamount": F.coalesce("_wamount", "_ramount")})
    d = last_before(d.select("cmd_id", "seq", "withdrawal_id", "status", "_early", "_wc", "_wamount", "_wstatus", "target"),
                    ["withdrawal_id"], ["seq"], {"_was": F.when(F.col("_early").isNull(), F.col("status"))})
    d = d.withColumn("_was", F.coalesce("_was", "_wstatus", F.lit("pending"))).checkpoint()
    counts_as = lambda s: F.col(s).isin(*BALANCE_WITHDRAWN).cast("int")
    decided = d.filter(F.col("_early").isNull()).select(
        "cmd_id", "seq", F.lit("decide").alias("kind"), F.col("_wc").alias("creator"), "target",
        ((counts_as("status") - F.coalesce(counts_as("_was"), F.lit(0))) * _cents(F.col("_wamount"))).alias("d_cents"),
        (-F.coalesce((F.col("_was") == "pending").cast("long"), F.lit(0))).alias("d_pending"))
    n_dec = decided.filter("target is not null").groupBy("target").agg(F.count("*").alias("n_dec"))
    requests = c.filter(is_req & F.col("_early").isNull()).select(
        "cmd_id", "seq", "kind", F.col("creator_profile_id").alias("creator"), F.col("_amt").alias("amt"), _cents(F.col("_stored")).alias("stored"))
    requests = requests.join(n_dec, F.col("cmd_id") == F.col("target"), "left").drop("target")
    events = requests.unionByName(decided, allowMissingColumns=True).filter("creator is not null")

    kept = run_folder(m.spark, "withdrawals")
    n = c.count()
    events = ranged(events, ["creator"], ["seq"], max(1, -(-n // fold_rows)), f"{kept}/events")
    place = events.groupBy("creator").agg(F.min("_rg").alias("_lo"), F.max("_rg").alias("_hi"))
    earned = m["creator_earnings"].filter(F.col("status") == "paid").groupBy(F.col("creator_id").alias("creator")).agg(
        _cents(F.sum("amount")).alias("earned"))
    held = m["withdrawals"].groupBy(F.col("creator_id").alias("creator")).agg(
        _cents(F.sum(F.when(F.col("status").isin(*BALANCE_WITHDRAWN), F.col("amount")))).alias("withdrawn"),
        F.count_if(F.col("status") == "pending").alias("pending"))
    state = place.join(earned, "creator", "left").join(held, "creator", "left").select(
        "creator", "_lo", "_hi", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("earned", "withdrawn", "pending")],
        F.lit(None).cast("array<long>").alias("live"), F.lit(None).cast("array<long>").alias("todo"))
    # large frames kept as files are not broadcast for their compressed size
    marked = lambda df: df.hint("merge") if n > FEW_ROWS else df
    state, done = stored(state, f"{kept}/state-0"), []
    while slices := [r["_lo"] for r in state.select("_lo").distinct().collect()]:  # no more than there are slices
        rows = events.filter(F.col("_rg").isin(slices)) if done else marked(events)
        rows = rows.join(state, "creator").filter(F.col("_rg") == F.col("_lo")).drop("_lo", "_hi")
        # a slice of a creator is one run of a task; the sort is over those only
        done.append(f"{kept}/folded-{len(done)}")
        folded = stored(rows.repartition("creator", "_rg").sortWithinPartitions("creator", "_rg", "seq").mapInArrow(_fold, FOLDED_SQL), done[-1])
        after = folded.filter("cmd_id is null").select("creator", "withdrawn", "pending", "live", "todo")
        state = state.filter("_lo < _hi").select("creator", (F.col("_lo") + 1).alias("_lo"), "_hi", "earned").join(after, "creator")
        state = stored(state, f"{kept}/state-{len(done)}")
    # one table of all rounds: a union of them would make a plan that grows with the rounds
    late = m.spark.read.schema(FOLDED_SQL).parquet(*done) if done else m.spark.createDataFrame([], FOLDED_SQL)
    late = marked(late.filter("cmd_id is not null").select(F.col("cmd_id").alias("_fc"), F.col("reason").alias("_late")))

    c = c.join(late, F.col("cmd_id") == F.col("_fc"), "left").withColumn("reason", F.coalesce("_early", "_late"))
    d = d.join(late, F.col("cmd_id") == F.col("_fc"), "left").withColumn("reason", F.coalesce("_early", "_late"))
    rejects = rejects_of(c.filter(is_req).select("cmd_id", "reason").unionByName(d.select("cmd_id", "reason")))
    ok, said = c.filter(is_req & F.col("reason").isNull()), d.filter(F.col("reason").isNull())
    last = last_by(said, "withdrawal_id", "seq", ["status"]).select(F.col("withdrawal_id").alias("id"), "status")
    rows = ok.select(new_id("t13", "cmd_id").alias("id"), F.col("creator_profile_id").alias("creator_id"), F.col("_stored").alias("amount"),
                     F.lit("pending").alias("status"),
                     details_json(F.col("upi_id"), F.col("bank_account"), F.col("ifsc_code"), F.col("account_holder")).alias("details"),
                     batch_time(batch_ts).alias("created_at"))
    withdrawals = update_by_key(m["withdrawals"].unionByName(conform(rows, "withdrawals")), last, "id", ["status"])
    asked_ev = notify.events_frame(ok, event="withdrawal_requested", event_key=F.col("cmd_id"), user_id="actor_user_id",
                                   amount="_amt", created_at=batch_time(batch_ts))
    notes, audit = decision_events(m, said.join(cmds.select(F.col("cmd_id").alias("_dc"), "actor_user_id", "note"), F.col("cmd_id") == F.col("_dc")),
                                   batch_ts)
    return JobResult(tables={"withdrawals": withdrawals}, rejects=rejects,
                     notifications=notify.render(asked_ev, "t13").unionByName(notes), audit=audit)
