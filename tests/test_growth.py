"""What must not grow with the number of micro-batches or with wrong size estimates."""

import os
import re
from decimal import Decimal

from pyspark.sql import functions as F

from souk.functions.text import like_any
from souk.operators import notify
from souk.operators.checks import check_foreign_keys, check_unique
from souk.operators.creators import search_creators
from souk.plans.accounts import cascade_delete
from souk.plans.payments import payment_batch
from souk.plans.withdrawals import withdrawal_batch
from souk.sources import tables
from souk.sources.schema import FOREIGN_KEYS
from souk.streaming.jobs import EVENT_SCHEMA, notification_stream, notifications_from_events
from tests.conftest import SF0001
from tests.helpers import T0, bundle


def test_stream_reads_its_static_side_once(spark, tmp_path):
    """Three micro-batches compute participants and users once, and give the batch answer."""
    seen = spark.sparkContext.accumulator(0)

    def touched(x):
        seen.add(1)
        return x

    m = bundle(spark, collaboration_participants=[{"id": f"j{i}", "collaboration_id": f"cl-{i % 2}", "creator_id": f"c{i}"} for i in range(6)],
               creator_profiles=[{"id": f"c{i}", "user_id": f"u{i}"} for i in range(6)])
    mark = F.udf(touched, "string").asNondeterministic()
    rows = m["collaboration_participants"].withColumn("collaboration_id", mark("collaboration_id"))
    events = [("collab_message", str(i), None, f"cl-{i % 2}", None, None, None, None, None, T0, f"u{i}") for i in range(6)]
    ev = spark.createDataFrame(events, EVENT_SCHEMA)
    src = str(tmp_path / "in")
    ev.repartition(3, "event_key").write.parquet(src)
    files = len([f for f in os.listdir(src) if f.endswith(".parquet")])
    assert files > 1
    q = notification_stream(m.replace(collaboration_participants=rows), src, str(tmp_path / "out"), str(tmp_path / "ckpt"), files_per_trigger=1)
    assert len(q.recentProgress) >= files and seen.value == 6
    got = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["id"] for r in notifications_from_events(m, ev).collect()) and len(got) == 12


def test_stream_leaves_its_static_side_as_it_lies(spark, tmp_path, monkeypatch):
    """A micro-batch deals and sorts its own events alone; collaborations of many packs, odd ids, null users and rows that come twice are told as in a batch."""
    monkeypatch.setattr(notify, "PACK_ROWS", 2)
    m = bundle(spark, collaboration_participants=[{"id": f"j{i}", "collaboration_id": f"cl-{i % 3}" if i != 17 else None, "creator_id": f"c{i % 15}"} for i in range(18)],
               creator_profiles=[{"id": f"c{i}", "user_id": {0: None, 1: 'u"1', 2: "ü\\2,", 3: "😀 [3]"}.get(i, f"u{i}")} for i in range(15)] + [{"id": "c4", "user_id": "u4"}])
    events = [("collab_message", str(i), None, f"cl-{i % 4}", None, None, None, None, None, T0, None if i == 7 else f"u{i}") for i in range(8)]
    ev = spark.createDataFrame(events, EVENT_SCHEMA)
    src = str(tmp_path / "in")
    ev.repartition(3, "event_key").write.parquet(src)
    q = notification_stream(m, src, str(tmp_path / "out"), str(tmp_path / "ckpt"), files_per_trigger=1)
    plan = q._jsq.explainInternal(False).split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert not [t for t in spark.catalog.listTables() if "audience" in t.name]
    got, want = spark.read.parquet(str(tmp_path / "out")).collect(), notifications_from_events(m, ev).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 20


def test_large_tables_are_merged_in_small_tasks(spark, monkeypatch):
    """Above FEW_ROWS no estimate of a file's size decides for a broadcast, tasks get few rows, and the rows stay the same."""
    names = ["collaboration_requests", "bookings", "promotion_packages"]
    plain = tables.derive_tables(spark, SF0001)
    want = {n: sorted(map(repr, plain[n].collect())) for n in names}
    monkeypatch.setattr(tables, "FEW_ROWS", 100)
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    m = tables.derive_tables(spark, SF0001)
    plan = m["collaboration_requests"]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan
    lines = spark.read.parquet(f"{SF0001}/lineitem.parquet").count()
    assert f", {-(-lines // 500)}), REPARTITION_BY_NUM" in plan
    for n in names:
        assert sorted(map(repr, m[n].collect())) == want[n]


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_wildcards_of_a_long_text(spark):
    """A LIKE with wildcards cuts the text into its code points once: no substring walks from its start."""
    rows = [(1, "ñ" * 60_000 + "xR_2é%"), (2, "ñ" * 60_000 + "xR"), (3, None), (4, ""), (5, "r😀2"), (6, "R2")]
    df = spark.createDataFrame(rows, "id int, v string")
    out = df.select("id", like_any("v", "r_2%").alias("a"), like_any("v", "x%2e\\%").alias("b"), like_any("v", "%").alias("c"))
    assert "substring" not in _plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [(1, True, True, True), (2, False, False, True), (3, None, None, None),
                                                       (4, False, False, True), (5, True, False, True), (6, False, False, True)]


def test_searched_profiles_are_dealt_to_many_tasks(spark):
    """The bios are searched after a shuffle of the profiles, whatever the join with users does."""
    m = bundle(spark, users=[{"id": f"u{i}", "name": "Zoë" if i == 1 else "n"} for i in range(6)],
               creator_profiles=[{"id": f"c{i}", "user_id": f"u{i}", "username": "x", "bio": "a ZOE b" if i == 4 else None} for i in range(6)])
    for text in ("zoe", "z_e"):
        found = search_creators(m, search=text)
        assert "REPARTITION_BY_COL" in _plan(found) and sorted(r["id"] for r in found.collect()) == ["c1", "c4"]


def test_unique_keys_in_ascii_need_no_collation(spark):
    """Printable ASCII keys are compared in lower case; a key with other values is counted whole by the collation."""
    ascii_ = bundle(spark, users=[{"id": "A", "email": "x@y"}, {"id": "a", "email": "X@Y"}, {"id": "b", "email": None}])
    out = check_unique(ascii_, tables=["users"])
    assert "collate" not in _plan(out).lower()
    assert sorted(tuple(r)[1:] for r in out.collect()) == [("email", "unique", "X@Y", "2"), ("id", "unique", "A", "2")]
    mixed = bundle(spark, users=[{"id": "e"}, {"id": "É"}, {"id": "f", "email": "q"}, {"id": "ǵ"}, {"id": "h", "email": "Q"}],
                   reviews=[{"id": "r", "booking_id": "k"}, {"id": "s", "booking_id": "K"}])
    got = sorted(tuple(r)[:2] + tuple(r)[3:] for r in check_unique(mixed, tables=["users", "reviews"]).collect())
    assert got == [("reviews", "booking_id", "K", "2"), ("users", "email", "Q", "2"), ("users", "id", "e", "2")]


def test_foreign_keys_without_lost_values_are_read_once(spark):
    """Only keys that have a missing parent are read again for the rows, each table once."""
    m = bundle(spark, users=[{"id": "u"}], creator_profiles=[{"id": "c", "user_id": "u"}],
               bookings=[{"id": "k", "creator_id": "c"}], withdrawals=[{"id": "w", "creator_id": "c-no"}, {"id": "v", "creator_id": "c"}])
    out = check_foreign_keys(m)
    assert "Union" not in _plan(out)
    assert [tuple(r) for r in out.collect()] == [("withdrawals", "creator_id", "foreign_key", "w", "c-no")]
    two = m.replace(reviews=bundle(spark, reviews=[{"id": "r", "booking_id": "k-no", "creator_id": "c-no"}, {"id": "s"}])["reviews"])
    assert sorted(tuple(r)[:2] + tuple(r)[3:] for r in check_foreign_keys(two).collect()) == [
        ("reviews", "booking_id", "r", "k-no"), ("reviews", "creator_id", "r", "c-no"), ("withdrawals", "creator_id", "w", "c-no")]


def test_deletion_deals_large_tables_by_rows(spark, monkeypatch):
    """Known large tables are dealt to tasks by their rows in a cascade, each read once; the rows stay the same."""
    rows = dict(users=[{"id": f"u{i}"} for i in range(8)], creator_profiles=[{"id": f"c{i}", "user_id": f"u{i}"} for i in range(8)],
                collaborations=[{"id": f"l{i}", "creator_id": f"c{i}"} for i in range(8)],
                collaboration_requests=[{"id": f"q{i}", "collaboration_id": f"l{i % 8}", "creator_id": f"c{(i + 1) % 8}"} for i in range(40)],
                admin_logs=[{"id": "a", "admin_id": "u1"}, {"id": "b", "admin_id": "u2"}])
    seeds = {"users": spark.createDataFrame([("u1",), (None,), ("u7",)], "id string")}
    small = bundle(spark, **rows)
    want = {t: sorted(map(repr, df.collect())) for t, df in cascade_delete(small, seeds).items()}
    monkeypatch.setattr(tables, "FEW_ROWS", 10)
    monkeypatch.setattr(tables, "TASK_ROWS", 20)
    large = tables.Market(spark, lambda name: small[name], rows=lambda name: 60)
    got = cascade_delete(large, seeds)
    assert all(re.search(rf"RepartitionByExpression \[{by}#\d+\], 3", _plan(got[t])) for t, by in (("collaboration_requests", "id"), ("admin_logs", "admin_id")))
    assert {t: sorted(map(repr, df.collect())) for t, df in got.items()} == want
    assert len(want["collaboration_requests"]) == 20 and len(want["admin_logs"]) == 2


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(found.apply(i).getName()) for i in range(found.size()) if found.apply(i).getName().startswith("shuffle")}


def test_deletion_leaves_no_shuffle_files_of_its_steps(spark):
    """The shuffle files behind a set of deleted ids go when the set is written, not when the driver collects garbage."""
    m = bundle(spark, users=[{"id": f"u{i}"} for i in range(8)], creator_profiles=[{"id": f"c{i}", "user_id": f"u{i}"} for i in range(8)],
               collaborations=[{"id": f"l{i}", "creator_id": f"c{i}"} for i in range(8)])
    before = _shuffle_files(spark)
    got = cascade_delete(m, {"users": spark.createDataFrame([("u1",), ("u7",)], "id string")})
    assert not _shuffle_files(spark) - before
    assert sorted(r["id"] for r in got["collaborations"].collect()) == [f"l{i}" for i in (0, 2, 3, 4, 5, 6)]


def _tasks_of_joins(df):
    """What deals out the inputs of the joins: the exchanges that a sort or a join stands right above."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?:Sort \[|Join)[^\n]*\n[^\n]*Exchange hashpartitioning\([^\n]*, (\d+)\), (\w+)", plan)


def test_deletion_joins_what_was_dealt(spark, monkeypatch):
    """The dealt rows are those the joins of a cascade sort: no join moves below them, nothing is shuffled again."""
    from souk.plans.accounts import _referring

    monkeypatch.setattr(tables, "FEW_ROWS", 10)
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    small = bundle(spark, users=[{"id": f"u{i}"} for i in range(4)], creator_profiles=[{"id": f"c{i}", "user_id": f"u{i}"} for i in range(4)],
                   collaborations=[{"id": f"l{i}", "creator_id": f"c{i}"} for i in range(4)],
                   collaboration_requests=[{"id": f"q{i}", "collaboration_id": f"l{i % 4}", "creator_id": f"c{(i + 1) % 4}"} for i in range(8)],
                   messages=[{"id": f"m{i}", "sender_id": "u2" if i else "u1", "booking_id": None} for i in range(40)] + [{"id": None}, {"id": None}],
                   admin_logs=[{"id": "a", "admin_id": "u1"}, {"id": None, "admin_id": None}])
    large = tables.Market(spark, lambda name: small[name].hint("merge"), rows=lambda name: 150)
    ids = {t: spark.createDataFrame([(x,)], "id string").checkpoint() for t, x in (("users", "u1"), ("creator_profiles", "c1"), ("collaborations", "l1"))}
    for t, want, tasks in (("collaborations", ["l1"], "15"), ("collaboration_requests", ["q0", "q1", "q4", "q5"], "30"), ("messages", ["m0"], "30")):
        found = _referring(large, t, [fk for fk in FOREIGN_KEYS if fk.table == t and fk.parent in ids and fk.on_delete == "cascade"], ids)
        assert (tasks, "REPARTITION_BY_NUM") in _tasks_of_joins(found) and {n for n, _ in _tasks_of_joins(found)} == {tasks}
        assert sorted(r["id"] for r in found.collect()) == want
    got = cascade_delete(large, {"users": ids["users"]})
    for t in ("collaboration_requests", "messages", "admin_logs"):
        assert {n for n, _ in _tasks_of_joins(got[t])} == {"15"}
    assert sorted(str(r["id"]) for r in got["collaboration_requests"].collect()) == ["q2", "q3", "q6", "q7"]
    assert sorted(str(r["id"]) for r in got["messages"].collect()) == sorted(["None", "None"] + [f"m{i}" for i in range(1, 40)])
    assert sorted(map(str, (tuple(r)[:1] + (r["admin_id"],) for r in got["admin_logs"].collect()))) == ["('a', None)", "(None, None)"]


def test_participants_are_dealt_for_their_joins(spark, monkeypatch):
    """Reviews and messages of large collaborations join participants dealt by their rows."""
    names = ["collaboration_reviews", "collaboration_messages"]
    plain = tables.derive_tables(spark, SF0001)
    want = {n: sorted(map(repr, plain[n].collect())) for n in names}
    monkeypatch.setattr(tables, "FEW_ROWS", 100)
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    m = tables.derive_tables(spark, SF0001)
    tasks = -(-spark.read.parquet(f"{SF0001}/lineitem.parquet").count() // 300)
    for n in names:
        assert re.search(rf"hashpartitioning\(collaboration_id#\d+, {tasks}\), REPARTITION_BY_NUM", m[n]._jdf.queryExecution().executedPlan().toString())
        assert sorted(map(repr, m[n].collect())) == want[n]


def test_large_tables_are_dealt_before_they_are_grouped(spark, monkeypatch):
    """Groups of a large table are made after its rows are dealt, in no task that grows with the file; a tiny table's keys do not deal it."""
    names = ["bookings", "campaigns", "collaborations"]
    plain = tables.derive_tables(spark, SF0001)
    want = {n: sorted(map(repr, plain[n].collect())) for n in names}
    for limit in ("FEW_ROWS", "TASK_ROWS"):
        monkeypatch.setattr(tables, limit, 100)
    m = tables.derive_tables(spark, SF0001)
    plan = {n: m[n]._jdf.queryExecution().executedPlan().toString() for n in names}
    for n, t, key in (("bookings", "lineitem", "l_orderkey"), ("campaigns", "orders", "o_custkey"), ("collaborations", "lineitem", "l_partkey")):
        tasks = -(-spark.read.parquet(f"{SF0001}/{t}.parquet").count() // 100)
        dealt = rf"Exchange hashpartitioning\({key}#\d+L, {tasks}\), REPARTITION_BY_NUM[^\n]*\n[^\n]*(Filter|FileScan)"
        assert re.search(dealt, plan[n]) and not re.search(rf"Exchange hashpartitioning\({key}#\d+L, \d+\), ENSURE_REQ", plan[n])
        assert sorted(map(repr, m[n].collect())) == want[n]
    assert re.search(r"BroadcastHashJoin \[\(p_partkey#\d+L % 25\)\]", plan["collaborations"])


def test_rows_without_a_key_are_dealt_to_many_tasks(spark, monkeypatch):
    """Rows whose key is null do not meet in one task of a dealt table."""
    monkeypatch.setattr(tables, "FEW_ROWS", 10)
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    small = bundle(spark, campaigns=[{"id": "cm"}], bookings=[{"id": f"k{i}", "campaign_id": None if i else "cm"} for i in range(200)])
    large = tables.Market(spark, lambda name: small[name].hint("merge"), rows=lambda name: 150)
    out = cascade_delete(large, {"campaigns": spark.createDataFrame([("cm",)], "id string")})["bookings"]
    per_task = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 5 and out.count() == 200 and out.filter("campaign_id is not null").count() == 0


def test_joint_batches_read_their_commands_once(spark):
    """What the commands come from is computed once, not at each step."""
    mark = "seq > -987654321"
    m = bundle(spark, bookings=[{"id": "k", "status": "accepted"}])
    pay = spark.createDataFrame([(1, 1, "order", "k", "o1", None, None), (2, 2, "order", "no", "o2", None, None)],
                                "cmd_id long, seq long, kind string, booking_id string, order_id string, payment_id string, signature string")
    out = payment_batch(m, pay.filter(mark), "key", T0).rejects
    assert "-987654321" not in _plan(out) and [tuple(r) for r in out.collect()] == [(2, "not_found")]
    wd = spark.createDataFrame([(1, 1, "decide", "u-a", "w-no", "approved", None)], "cmd_id long, seq long, kind string, actor_user_id string, "
                               "withdrawal_id string, status string, note string")
    wd = wd.filter(mark).selectExpr("*", *[f"cast(null as string) {c}" for c in ("amount", "upi_id", "bank_account", "ifsc_code", "account_holder")])
    out = withdrawal_batch(m, wd, T0).rejects
    assert "-987654321" not in _plan(out) and [tuple(r) for r in out.collect()] == [(1, "not_found")]


def test_withdrawal_plan_does_not_grow_with_its_rounds(spark):
    """A creator in many slices takes a round for each; what reads the results reads one table, however many there were."""
    m = bundle(spark, users=[{"id": "u"}], creator_profiles=[{"id": "c", "user_id": "u"}], creator_earnings=[{"id": "e", "creator_id": "c", "amount": Decimal(900), "status": "paid"}])
    cmds = spark.createDataFrame([(i, i, "request", "u", "100" if i else "950", "upi", None, None, None, None, None, None) for i in range(12)],
                                 "cmd_id long, seq long, kind string, actor_user_id string, amount string, upi_id string, bank_account string, "
                                 "ifsc_code string, account_holder string, withdrawal_id string, status string, note string")
    outs = {rows: withdrawal_batch(m, cmds, T0, rows) for rows in (1000, 2)}
    for out in outs.values():
        assert sorted(tuple(r) for r in out.rejects.collect()) == [(0, "insufficient_balance")] + [(i, "pending_exists") for i in range(2, 12)]
        assert [r["user_id"] for r in out.notifications.collect()] == ["u"]
    one, many = (out.notifications._jdf.queryExecution().optimizedPlan().treeString().count("\n") for out in outs.values())
    assert one == many
