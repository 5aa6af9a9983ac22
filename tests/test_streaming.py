"""Stream = batch: final state after one or several micro-batches and after
a restart from the checkpoint equals the batch operator over all input."""

import pyspark.sql.functions as F

from souk.session import checkpoint_dir
from souk.streaming import jobs as sj
from souk.streaming.runner import run_folder, stage_files


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_presence_restart_equals_batch(spark, small):
    ev = small.fixture("presence_events")
    base = run_folder(spark, "t-w2")
    early = ev.filter(F.col("eid") < 500)
    late = ev.filter(F.col("eid") >= 500)
    stage_files(early, base + "/in/a", key="eid")
    sj.presence_stream(spark, base + "/in/*", base + "/log", base + "/ckpt", files_per_trigger=1)
    stage_files(late, base + "/in/b", key="eid")
    got = sj.presence_stream(spark, base + "/in/*", base + "/log", base + "/ckpt", files_per_trigger=1)
    assert _rows(got) == _rows(sj.presence_state(ev))


def test_rating_stream_single_batch_equals_batch(spark, small):
    from souk.operators.ratings import creator_ratings
    base = run_folder(spark, "t-w4")
    src = stage_files(small["reviews"].select("id", "creator_id", "rating"), base + "/in")
    got = sj.rating_stream(small, src, base + "/log", base + "/ckpt").select("id", "rating")
    assert _rows(got) == _rows(creator_ratings(small).select("id", "rating"))


def test_delivery_stream_equals_as_of_join(spark, small):
    notes = small["notifications"]
    pres = small.fixture("presence_events")
    base = run_folder(spark, "t-w3")
    tl = sj.delivery_timeline(notes, pres)
    # time slices in order: each file holds one slice of the timeline
    bounds = tl.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    step = (bounds.b - bounds.a) / 4
    for i in range(4):
        lo, hi = bounds.a + step * i, bounds.a + step * (i + 1)
        part = tl.filter((F.col("t") >= lo) & ((F.col("t") < hi) if i < 3 else F.lit(True)))
        part.coalesce(1).write.parquet(f"{base}/in/slice={i}")
    got = sj.delivery_stream(spark, base + "/in", base + "/out", base + "/log", base + "/ckpt", files_per_trigger=1, every=2)
    want = sj.deliver_online(notes, pres)
    assert _rows(got) == _rows(want)


def test_checkpoint_dir_is_session_setting(spark):
    assert spark.conf.get("spark.checkpoint.dir") == checkpoint_dir(spark)


def test_as_of_join_independent_of_slices(spark, small):
    notes, pres = small["notifications"], small.fixture("presence_events")
    want = _rows(sj.deliver_online(notes, pres))
    assert _rows(sj.deliver_online(notes, pres, ranges=1)) == want
    assert _rows(sj.deliver_online(notes, pres, ranges=37)) == want


def _log(spark, every):
    from souk.streaming.runner import EpochLog
    total = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    return EpochLog(spark, run_folder(spark, "t-log"), "k string, n bigint", total, every)


def test_log_is_bounded_and_survives_replay(spark):
    """Compaction keeps two bases and few changes; a batch run again, before or after one, counts once."""
    log = _log(spark, 3)
    assert log.read().count() == 0
    want = {}
    for epoch in range(11):
        rows = [("a", epoch), (f"k{epoch % 2}", 1)]
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        for _ in range(2 if epoch in (2, 4, 8) else 1):
            before = dict(tuple(r) for r in log.read(epoch - 1).collect())
            assert before == {k: v for k, v in {k: want.get(k, 0) - sum(n for x, n in rows if x == k) for k in want}.items() if v or k in before}
            log.write(spark.createDataFrame(rows, "k string, n bigint"), epoch)
        assert dict(tuple(r) for r in log.read().collect()) == want
        have = log.parts()
        assert len(have["base"]) <= 2 and len(have["delta"]) <= 6


def test_uncommitted_base_does_not_count(spark):
    log = _log(spark, 100)
    log.write(spark.createDataFrame([("a", 2)], "k string, n bigint"), 0)
    spark.createDataFrame([("a", 99)], "k string, n bigint").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(log.path + "/base-0")
    assert [tuple(r) for r in log.read().collect()] == [("a", 2)]


def test_presence_forgets_old_sockets(spark):
    """With a time to live the state is bounded by the users; the answer is the same."""
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=i), f"u{i % 3}", f"s{i // 5}-{i % 3}", "disconnect" if i % 5 == 4 else "register") for i in range(120)]
    ev = spark.createDataFrame(rows, sj.PRESENCE_SCHEMA)
    base = run_folder(spark, "t-ttl")
    for i in range(4):
        stage_files(ev.filter((F.col("eid") >= i * 30) & (F.col("eid") < i * 30 + 30)), f"{base}/in/{i}")
        got = sj.presence_stream(spark, base + "/in/*", base + "/log", base + "/ckpt", ttl="20 MINUTES", every=1)
    assert _rows(got) == _rows(sj.presence_state(ev))
    from souk.streaming.runner import EpochLog
    kept = EpochLog(spark, base + "/log", sj.PAIR_SCHEMA, lambda x: x).read()
    assert kept.count() < ev.select("user_id", "socket_id").distinct().count() / 2
