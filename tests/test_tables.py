"""A published version reads back whole; without its marker it is refused."""

import os

import pytest
from pyspark.sql import functions as F

from souk.operators.checks import check_unique
from souk.operators.messaging import inbox
from souk.sources.tables import COMMITTED, load_tables, publish, write_tables
from tests.helpers import bundle, ts

USERS = [{"id": f"u{i}", "name": f"N{i}", "email": f"n{i}@x.test", "role": "brand", "created_at": ts(i)} for i in range(3)]


def test_version_round_trip_and_marker(spark, tmp_path):
    m = bundle(spark, users=USERS)
    path = write_tables(m, str(tmp_path / "v1"))
    back = load_tables(spark, path)
    assert back["users"].schema == m["users"].schema
    assert sorted(map(str, back["users"].collect())) == sorted(map(str, m["users"].collect()))
    assert back["bookings"].count() == 0 and len(back) == 21
    with pytest.raises(FileExistsError):  # and stays as it is
        write_tables(m, path)
    assert load_tables(spark, path)["users"].count() == 3


def test_half_written_version_is_refused(spark, tmp_path):
    path = write_tables(bundle(spark, users=USERS), str(tmp_path / "v2"))
    os.remove(f"{path}/{COMMITTED}")
    with pytest.raises(FileNotFoundError):
        load_tables(spark, path)


def test_failed_write_can_be_run_again(spark, tmp_path):
    m = bundle(spark, users=USERS)
    path = write_tables(m, str(tmp_path / "v3"))
    os.remove(f"{path}/{COMMITTED}")
    write_tables(m, path)
    assert load_tables(spark, path)["users"].count() == 3


def _snapshot(m):
    return {t: sorted(map(str, m[t].collect())) for t in ("users", "bookings", "creator_platforms", "payments")}


def _written(path):
    return {os.path.relpath(d, path) for d, _, files in os.walk(path) if any(f.endswith(".parquet") for f in files)}


def test_only_touched_parts_are_written(spark, tmp_path):
    """A job on one month of bookings writes that month; versions read back whole, old ones too."""
    month = 60 * 24 * 31
    bookings = [{"id": f"b{i}", "status": "pending", "created_at": ts(month * (i % 6))} for i in range(60)] + [{"id": "b99", "status": "pending"}]
    m = bundle(spark, users=USERS, bookings=bookings, creator_platforms=[{"id": f"p{i}", "creator_id": "c"} for i in range(40)])
    v1 = publish(m, str(tmp_path / "v1"))
    assert _snapshot(load_tables(spark, v1)) == _snapshot(m)
    hit = F.col("created_at") == F.lit(ts(month * 2))
    now = m.replace(bookings=m["bookings"].withColumn("status", F.when(hit, "accepted").otherwise(F.col("status"))))
    for changed, name in ((None, "v2"), (["bookings"], "v2b")):
        v2 = publish(now, str(tmp_path / name), v1, changed)
        assert _snapshot(load_tables(spark, v2)) == _snapshot(now)
        assert _written(v2) == {"bookings/part=2024-03"}
    fewer = now.replace(bookings=now["bookings"].filter("id <> 'b99'").filter(~hit), creator_platforms=now["creator_platforms"].filter("id <> 'p7'"))
    v3 = publish(fewer, str(tmp_path / "v3"), v2)
    assert _snapshot(load_tables(spark, v3)) == _snapshot(fewer)
    assert len(_written(v3)) == 1 and _written(v3).pop().startswith("creator_platforms/part=h")
    assert _snapshot(load_tables(spark, v1)) == _snapshot(m)
    with pytest.raises(FileExistsError):
        publish(m, v3)


def test_publication_that_broke_off(spark, tmp_path):
    """Without its marker a version is refused; run again, it is whole."""
    m = bundle(spark, users=USERS)
    v1 = publish(m, str(tmp_path / "v1"))
    more = m.replace(users=m["users"].union(m["users"].limit(1).withColumn("id", F.lit("u7"))))
    v2 = publish(more, str(tmp_path / "v2"), v1)
    os.remove(f"{v2}/{COMMITTED}")
    with pytest.raises(FileNotFoundError):
        load_tables(spark, v2)
    assert _snapshot(load_tables(spark, publish(more, v2, v1))) == _snapshot(more)


def test_unique_keys_ignore_case_and_accents(spark):
    twice = [*USERS, {**USERS[0], "id": "u9", "email": "N0@X.test"}, {**USERS[1], "id": "u8", "email": "ñ1@x.test"}]
    got = [(r.column_name, r.row_id, r.detail) for r in check_unique(bundle(spark, users=twice), ["users"]).collect()]
    assert sorted(got) == [("email", "N0@X.test", "2"), ("email", "n1@x.test", "2")]


def test_inbox_limits_after_the_joins(spark):
    msg = [{"id": "a", "sender_id": "u0", "receiver_id": "u1", "message": "old", "created_at": ts(1)},
           {"id": "b", "sender_id": None, "receiver_id": "u1", "message": "no sender", "created_at": ts(2)},
           {"id": "c", "sender_id": "gone", "receiver_id": "u1", "message": "sender unknown", "created_at": ts(3)}]
    m = bundle(spark, users=USERS, messages=msg)
    assert [r.id for r in inbox(m, "u1", n=1).collect()] == ["a"]
    assert {(r.inbox_user_id, r.id) for r in inbox(m, n=1).collect()} == {("u0", "a"), ("u1", "a")}
