"""Fold property on the stand-in command tables: applying the commands of
the two busiest keys as one batch equals applying them one at a time in seq
order (same rejects, same resulting tables, notifications and audit rows)."""

import pytest
from pyspark.sql import functions as F

from souk.catalog import BATCH_TS, JOBS

# job → (command table, key column whose repeats make commands interact, tables to compare)
CASES = {
    "t01_register_users": ("cmd_t01", "email", ["users", "creator_profiles", "brand_profiles"]),
    "t07_booking_status": ("cmd_t07", "booking_id", ["bookings", "escrow_wallet", "creator_earnings"]),
    "t12_release_escrow": ("cmd_t12", "booking_id", ["escrow_wallet", "bookings"]),
    "t13_request_withdrawals": ("cmd_t13", "actor_user_id", ["withdrawals"]),
    "t14_decide_withdrawals": ("cmd_t14", "withdrawal_id", ["withdrawals"]),
    "t15_submit_reviews": ("cmd_t15", "booking_id", ["reviews", "creator_profiles"]),
    "t17_apply_collaborations": ("cmd_t17", "collaboration_id", ["collaboration_requests"]),
    "t18_decide_requests": ("cmd_t18", "request_id", ["collaboration_requests", "collaborations",
                                                       "collaboration_participants", "messages"]),
    "t24_change_roles": ("cmd_t24", "user_id", ["users"]),
    "t25_verify_creators": ("cmd_t25", "creator_profile_id", ["creator_profiles"]),
    "t04_update_packages": ("cmd_t04_packages", "target_id", ["promotion_packages"]),
    "t26_collab_reviews": ("cmd_t26", "collaboration_id", ["collaboration_reviews", "creator_profiles"]),
}


def _busiest(cmds, key, n_keys=2, max_rows=8):
    top = (cmds.filter(F.col(key).isNotNull()).groupBy(key).count()
           .orderBy(F.col("count").desc(), F.col(key)).limit(n_keys))
    return cmds.join(top.select(key), key, "left_semi").orderBy("seq").limit(max_rows)


def _snapshot(m, tables):
    out = {t: sorted(tuple(r) for r in m[t].collect()) for t in tables}
    out["notifications"] = sorted(tuple(r) for r in m["notifications"].drop("created_at").collect())
    out["admin_logs"] = sorted(tuple(r) for r in m["admin_logs"].collect())
    return out


@pytest.mark.parametrize("job", sorted(CASES))
def test_batch_equals_one_at_a_time(spark, small, job):
    cmd_table, key, tables = CASES[job]
    runner = JOBS[job][0]  # reads m.fixture(cmd_table); it is fed the chosen commands instead
    cmds = _busiest(small.fixture(cmd_table), key)
    rows = cmds.collect()
    assert len(rows) >= 2
    cmds = spark.createDataFrame(rows, cmds.schema)

    def with_cmds(m, df):
        m2 = m.replace()
        m2._extra = lambda name, _df=df, _orig=m._extra: _df if name == cmd_table else _orig(name)
        return m2

    base = with_cmds(small, cmds)
    whole = runner(base)
    batch_state = _snapshot(whole.apply(base), tables)
    batch_rejects = sorted(tuple(r) for r in whole.rejects.collect())

    seq_m, seq_rejects = small, []
    for r in rows:
        one = spark.createDataFrame([r], cmds.schema)
        res = runner(with_cmds(seq_m, one))
        seq_rejects += [tuple(x) for x in res.rejects.collect()]
        seq_m = res.apply(seq_m)
        changed = set(res.tables) | {"notifications", "admin_logs"}
        seq_m = seq_m.replace(**{t: spark.createDataFrame(seq_m[t].collect(), seq_m[t].schema) for t in changed})
    assert batch_rejects == sorted(seq_rejects)
    assert batch_state == _snapshot(seq_m, tables)
