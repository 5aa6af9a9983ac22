"""Registered driver queries: operator calls over a table bundle, with
nested results flattened and decimals widened to double so the driver can
hash them against the DuckDB oracle.  The operators themselves keep exact
decimals and nested arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.operators import admin, bookings, collaborations, creators, messaging, money


def for_driver(df: DataFrame) -> DataFrame:
    """Decimals → double (exact decimal results, then one rounding to the
    nearest double, identical on both sides of the check)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def nullable_ints_as_double(df: DataFrame, *cols: str) -> DataFrame:
    """Integer columns that left joins can leave null are widened to double,
    so both engines hand the checker the same float representation."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


def joined(arr: str, *fields: str, sep: str = ";") -> Column:
    """array<struct> → 'f1:f2;f1:f2' in array order ('' when empty)."""
    return F.array_join(
        F.transform(F.col(arr), lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), sep)


def _q03(m):
    return nullable_ints_as_double(creators.attach_platforms(m, m["creator_profiles"].select("id", "username")),
                                   "followers")


def _q05(m):
    d = creators.creator_profile_doc(m)
    base = [c for c in d.columns if c != "reviews"]
    return d.select(*base,
                    F.array_join(F.transform("reviews", lambda x: x["id"]), ",").alias("review_ids"),
                    F.array_join(F.transform("reviews", lambda x: x["brand_name"]), ",").alias("review_brands"))


def _q37_parts(i):
    return lambda m: collaborations.collaboration_parts(m)[i]


def _q41(m):
    actors = m["users"].select(F.col("id").alias("actor_user_id"), "role")
    return creators.resolve_profile(m, actors)


SEARCH_FILTERED = dict(category="tech", min_followers="20000", location="a", max_price="100000")
SEARCH_TEXT = dict(search="creator_1")
SEARCH_WILDCARD = dict(search="r_2%")
SEARCH_PLATFORM = dict(platform="tube", page="2", limit="5")
COLLAB_WILDCARD = dict(platform="Ÿ_úT%b", location="_%a")
COLLAB_FILTERED = dict(platform="tube", location="a", followers_required="30000")

REGISTRY: dict[str, Callable] = {
    "q01_creator_categories": creators.creator_categories,
    "q02_search_creators": lambda m: nullable_ints_as_double(creators.search_creators(m), "max_followers"),
    "q02_search_creators_filtered": lambda m: nullable_ints_as_double(creators.search_creators(m, **SEARCH_FILTERED), "max_followers"),
    "q02_search_creators_text": lambda m: nullable_ints_as_double(creators.search_creators(m, **SEARCH_TEXT), "max_followers"),
    "q02_search_creators_wildcard": lambda m: nullable_ints_as_double(creators.search_creators(m, **SEARCH_WILDCARD), "max_followers"),
    "q02_search_creators_platform_page2": lambda m: nullable_ints_as_double(creators.search_creators(m, **SEARCH_PLATFORM), "max_followers"),
    "q03_attach_platforms": _q03,
    "q04_search_creators_total": lambda m: creators.search_creators_total(m),
    "q04_search_creators_total_filtered": lambda m: creators.search_creators_total(m, **SEARCH_FILTERED),
    "q05_creator_profile_doc": _q05,
    "q05_profile_children": lambda m: creators.profile_children(m),
    "q06_own_profile_doc": lambda m: creators.own_profile_doc(m),
    "q07_earnings_statement": lambda m: creators.earnings_statement(m),
    "q07_earnings_total": lambda m: creators.earnings_total(m),
    "q08_list_campaigns": lambda m: bookings.list_campaigns(m),
    "q08_list_campaigns_filtered": lambda m: bookings.list_campaigns(m, status="active", category="tech", page=2),
    "q09_brand_campaigns": lambda m: bookings.brand_campaigns(m),
    "q10_bookings_for_brand": lambda m: bookings.bookings_for_brand(m),
    "q11_bookings_for_creator": lambda m: bookings.bookings_for_creator(m),
    "q12_bookings_recent": lambda m: bookings.bookings_recent(m),
    "q13_booking_detail": lambda m: nullable_ints_as_double(bookings.booking_detail(m), "delivery_days"),
    "q14_payment_and_escrow": lambda m: bookings.payment_and_escrow(m),
    "q15_payments_recent": lambda m: bookings.payments_recent(m),
    "q16_list_users": admin.list_users,
    "q17_pending_creators": admin.pending_creators,
    "q18_transactions": admin.transactions,
    "q19_platform_stats": admin.platform_stats,
    "q20_brand_booking_history": lambda m: admin.brand_booking_history(m),
    "q21_brand_campaign_history": lambda m: admin.brand_campaign_history(m),
    "q22_creator_booking_history": lambda m: admin.creator_booking_history(m),
    "q23_creator_collab_history": lambda m: admin.creator_collab_history(m),
    "q24_platform_profit": lambda m: bookings.platform_profit(m),
    "q25_platform_profit_totals": lambda m: bookings.platform_profit_totals(m),
    "q26_withdrawal_history": lambda m: money.withdrawal_history(m),
    "q27_available_balance": lambda m: money.available_balance(m),
    "q28_withdrawal_queue": money.withdrawal_queue,
    "q29_withdrawal_totals": money.withdrawal_totals,
    "q30_booking_thread": lambda m: messaging.booking_thread(m),
    "q31_inbox": lambda m: messaging.inbox(m),
    "q32_notification_feed": lambda m: messaging.notification_feed(m),
    "q33_creator_reviews": lambda m: messaging.creator_reviews(m),
    "q34_brand_reviews": lambda m: messaging.brand_reviews(m),
    "q35_list_collaborations": lambda m: collaborations.list_collaborations(m),
    "q35_list_collaborations_filtered": lambda m: collaborations.list_collaborations(m, **COLLAB_FILTERED),
    "q35_list_collaborations_wildcard": lambda m: collaborations.list_collaborations(m, **COLLAB_WILDCARD),
    "q36_list_collaborations_total": lambda m: collaborations.list_collaborations_total(m),
    "q36_list_collaborations_total_filtered": lambda m: collaborations.list_collaborations_total(m, **COLLAB_FILTERED),
    "q37_collaboration_doc": lambda m: collaborations.collaboration_doc(m),
    "q37_collaboration_parts__participants": _q37_parts(0),
    "q37_collaboration_parts__requests": _q37_parts(1),
    "q37_collaboration_parts__reviews": _q37_parts(2),
    "q38_my_collaborations": lambda m: collaborations.my_collaborations(m),
    "q39_collaboration_thread": lambda m: collaborations.collaboration_thread(m),
    "q40_collaboration_reviews_for": lambda m: collaborations.collaboration_reviews_for(m),
    "q41_resolve_profile": _q41,
    "s4_withdrawal_details": money.withdrawal_details,
}


# ---------------------------------------------------------------- M, C, S
from souk.operators import checks, ratings  # noqa: E402
from souk.sources import migrate  # noqa: E402
from souk.sources.schema import DEFAULTS, TABLES, TIME_COLUMN  # noqa: E402
from souk.sources.tables import conform  # noqa: E402

RATINGS_SINCE = "1998-01-01"
DEFAULTS_BATCH_TS = "2000-01-01 00:00:00"


def faulty(m):
    """The bundle with bookings and reviews replaced by their fault-injected versions."""
    return m.replace(bookings=conform(m.fixture("faulty_bookings"), "bookings"),
                     reviews=conform(m.fixture("faulty_reviews"), "reviews"))


def _m3(m):
    changed = m["reviews"].filter(F.col("created_at") >= F.lit(RATINGS_SINCE).cast("timestamp_ntz"))
    return ratings.refresh_ratings(m, changed).select("id", "rating")


def _c07(table: str):
    """Defaults over the table with its default and time columns emptied in about a third of the rows."""
    cols = [*DEFAULTS[table], *([TIME_COLUMN[table]] if TIME_COLUMN[table] else [])]

    def run(m):
        df, empty = m[table], F.ascii(F.substring("id", -1, 1)) % 3 == 0
        gaps = df.select(*[F.when(~empty, F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
        return checks.apply_defaults(table, gaps, DEFAULTS_BATCH_TS)

    return run


def _c09(table: str):
    return lambda m: migrate.rekey_table(m, table)


def _c08(m):
    return migrate.unify_notifications(m.fixture("notifications_old"), m.fixture("notifications_new"))


REGISTRY.update({
    "m1_creator_ratings": lambda m: ratings.creator_ratings(m).select("id", "rating"),
    "m2_collaboration_ratings": lambda m: ratings.collaboration_ratings(m).select("id", "collaboration_rating"),
    "m3_refresh_ratings": _m3,
    "c01_not_null": lambda m: checks.check_not_null(faulty(m)),
    "c02_unique": lambda m: checks.check_unique(faulty(m)),
    "c03_enum": lambda m: checks.check_enum(faulty(m)),
    "c04_rating_range": lambda m: checks.check_rating_range(faulty(m)),
    "c05_foreign_keys": lambda m: checks.check_foreign_keys(faulty(m)),
    "c06_ranges": lambda m: checks.check_ranges(faulty(m)),
    "c07_apply_defaults": lambda m: checks.apply_defaults("bookings", faulty(m)["bookings"], DEFAULTS_BATCH_TS),
    "c08_unify_notifications": _c08,
    "c06_ranges_raw": lambda m: checks.check_ranges(m.replace(payments=m.fixture("raw_payments")), tables=["payments"]),
})
REGISTRY.update({f"c07_apply_defaults__{t}": _c07(t) for t in DEFAULTS if t != "bookings"})
REGISTRY.update({f"c09_rekey__{t}": _c09(t) for t in TABLES})


# ---------------------------------------------------------------- table jobs
from souk.plans import bookings as bjobs  # noqa: E402
from souk.plans import payments as pjobs  # noqa: E402
from souk.plans import withdrawals as wjobs  # noqa: E402
from souk.sources.commands import TEST_KEY  # noqa: E402

BATCH_TS = "2024-02-01 00:00:00"

# job name → (runner(m) -> JobResult, outputs)
JOBS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "t06_create_bookings": (lambda m: bjobs.create_bookings(m, m.fixture("cmd_t06"), BATCH_TS),
                            ("bookings", "rejects", "notifications")),
    "t07_booking_status": (lambda m: bjobs.apply_booking_status(m, m.fixture("cmd_t07"), BATCH_TS),
                           ("bookings", "escrow_wallet", "creator_earnings", "rejects", "notifications")),
    "t08_content_review": (lambda m: bjobs.content_review(m, m.fixture("cmd_t08"), BATCH_TS),
                           ("bookings", "rejects", "notifications")),
    "t10_payment_orders": (lambda m: bjobs.upsert_payment_orders(m, m.fixture("cmd_t10"), BATCH_TS),
                           ("payments", "rejects", "orders")),
    "t11_settle_payments": (lambda m: bjobs.settle_payments(m, m.fixture("cmd_t11"), TEST_KEY, BATCH_TS),
                            ("payments", "escrow_wallet", "rejects", "notifications")),
    "t10_t11_payments": (lambda m: pjobs.payment_batch(m, m.fixture("cmd_payment_batch"), TEST_KEY, BATCH_TS),
                         ("payments", "escrow_wallet", "rejects", "notifications", "orders")),
    "t12_release_escrow": (lambda m: bjobs.release_escrow(m, m.fixture("cmd_t12"), BATCH_TS),
                           ("escrow_wallet", "bookings", "rejects", "notifications", "audit")),
    "t13_request_withdrawals": (lambda m: wjobs.request_withdrawals(m, m.fixture("cmd_t13"), BATCH_TS),
                                ("withdrawals", "rejects", "notifications")),
    "t14_decide_withdrawals": (lambda m: wjobs.decide_withdrawals(m, m.fixture("cmd_t14"), BATCH_TS),
                               ("withdrawals", "rejects", "notifications", "audit")),
    "t13_t14_withdrawals": (lambda m: wjobs.withdrawal_batch(m, m.fixture("cmd_withdrawal_batch"), BATCH_TS),
                            ("withdrawals", "rejects", "notifications", "audit")),
}


def _job_output(runner, out):
    return lambda m: runner(m).output(out)


def register_jobs(jobs: dict) -> None:
    for job, (runner, outs) in jobs.items():
        for out in outs:
            REGISTRY[f"{job}__{out}"] = _job_output(runner, out)


register_jobs(JOBS)

from souk.plans import accounts as ajobs  # noqa: E402
from souk.plans import catalog_rows as rjobs  # noqa: E402
from souk.plans import collabs as cjobs  # noqa: E402


def _j(fn, cmd, *args):
    return lambda m: fn(m, *args, m.fixture(cmd), BATCH_TS)


MORE_JOBS = {
    "t01_register_users": (_j(ajobs.register_users, "cmd_t01"),
                           ("users", "creator_profiles", "brand_profiles", "rejects")),
    "t02_resolve_identities": (_j(ajobs.resolve_identities, "cmd_t02"),
                               ("resolved", "users", "creator_profiles", "rejects")),
    "t03_append_platforms": (_j(rjobs.append_rows, "cmd_t03_platforms", "creator_platforms"),
                             ("creator_platforms", "rejects")),
    "t03_append_packages": (_j(rjobs.append_rows, "cmd_t03_packages", "promotion_packages"),
                            ("promotion_packages", "rejects")),
    "t03_append_campaigns": (_j(rjobs.append_rows, "cmd_t03_campaigns", "campaigns"), ("campaigns", "rejects")),
    "t04_update_packages": (_j(rjobs.update_rows, "cmd_t04_packages", "promotion_packages"),
                            ("promotion_packages", "rejects")),
    "t04_update_campaigns": (_j(rjobs.update_rows, "cmd_t04_campaigns", "campaigns"), ("campaigns", "rejects")),
    "t04_update_profile": (_j(rjobs.update_own_profile, "cmd_t04_profile"), ("creator_profiles", "rejects")),
    "t04_update_avatar": (_j(rjobs.update_avatars, "cmd_t04_avatar"), ("users", "rejects")),
    "t05_delete_packages": (_j(rjobs.delete_rows, "cmd_t05_packages", "promotion_packages"),
                            ("promotion_packages", "bookings", "rejects")),
    "t05_delete_campaigns": (_j(rjobs.delete_rows, "cmd_t05_campaigns", "campaigns"),
                             ("campaigns", "campaign_invites", "bookings", "rejects")),
    "t15_submit_reviews": (_j(cjobs.submit_reviews, "cmd_t15"), ("reviews", "creator_profiles", "rejects")),
    "t16_create_collaborations": (_j(cjobs.create_collaborations, "cmd_t16"),
                                  ("collaborations", "collaboration_participants", "rejects")),
    "t17_apply_collaborations": (_j(cjobs.apply_to_collaborations, "cmd_t17"),
                                 ("collaboration_requests", "rejects", "notifications")),
    "t18_decide_requests": (_j(cjobs.decide_requests, "cmd_t18"),
                            ("collaboration_requests", "collaborations", "collaboration_participants", "messages",
                             "rejects", "notifications")),
    "t19_complete_collaborations": (_j(cjobs.complete_collaborations, "cmd_t19"),
                                    ("collaborations", "rejects", "notifications")),
    "t20_post_collab_messages": (_j(cjobs.post_collab_messages, "cmd_t20"),
                                 ("collaboration_messages", "rejects", "notifications")),
    "t21_send_messages": (_j(ajobs.send_messages, "cmd_t21"), ("messages", "rejects", "notifications")),
    "t22_mark_read": (_j(ajobs.mark_notifications_read, "cmd_t22"), ("notifications",)),
    "t23_delete_users": (_j(ajobs.delete_users, "cmd_t23"),
                         ("users", "creator_profiles", "brand_profiles", "bookings", "payments", "messages",
                          "admin_logs", "reviews", "collaboration_participants", "audit")),
    "t24_change_roles": (_j(ajobs.change_roles, "cmd_t24"), ("users", "rejects", "audit")),
    "t25_verify_creators": (_j(ajobs.verify_creators, "cmd_t25"), ("creator_profiles", "notifications", "audit")),
    "t26_collab_reviews": (_j(cjobs.submit_collab_reviews, "cmd_t26"),
                           ("collaboration_reviews", "creator_profiles", "rejects", "notifications")),
}
JOBS.update(MORE_JOBS)
register_jobs(MORE_JOBS)


# ---------------------------------------------------------------- streams
from souk.sources.schema import SCHEMAS as _SCHEMAS  # noqa: E402
from souk.streaming import jobs as sjobs  # noqa: E402
from souk.streaming.runner import run_folder, stage_files  # noqa: E402


def _w1(m):
    base = run_folder(m.spark, "w1")
    src = stage_files(m.fixture("notify_events"), base + "/in", key="event_key")
    sjobs.notification_stream(m, src, base + "/out", base + "/ckpt", files_per_trigger=2)
    return m.spark.read.schema(_SCHEMAS["notifications"]).parquet(base + "/out")


def _w2(m):
    base = run_folder(m.spark, "w2")
    src = stage_files(m.fixture("presence_events"), base + "/in", key="eid")
    return sjobs.presence_stream(m.spark, src, base + "/log", base + "/ckpt", files_per_trigger=2)


def _w3(m):
    return sjobs.deliver_online(m["notifications"], m.fixture("presence_events"))


def _w3_stream(m):
    """The timeline in three slices of time, each a run of the stream that goes on from the last."""
    base = run_folder(m.spark, "w3")
    tl = sjobs.delivery_timeline(m["notifications"], m.fixture("presence_events"))
    first, last = tl.agg(F.min("t"), F.max("t")).first()
    for i in range(3):
        lo, hi = (first + (last - first) * x / 3 for x in (i, i + 1))
        now = tl.filter((F.col("t") >= lo) & (F.lit(i == 2) | (F.col("t") < hi)))
        stage_files(now, f"{base}/in/{i}")
        out = sjobs.delivery_stream(m.spark, f"{base}/in/*", f"{base}/out", f"{base}/log", f"{base}/ckpt", every=2)
    return out


def _w4(m):
    base = run_folder(m.spark, "w4")
    src = stage_files(m["reviews"].select("id", "creator_id", "rating"), base + "/in", key="id")
    return sjobs.rating_stream(m, src, base + "/log", base + "/ckpt", files_per_trigger=2).select("id", "rating")


REGISTRY.update({
    "w1_notification_stream": _w1,
    "w2_presence_stream": _w2,
    "w3_deliver_online": _w3,
    "w3_delivery_stream": _w3_stream,
    "w4_rating_stream": _w4,
})


# ---------------------------------------------------------------- keyed calls
from souk.keyed import KEYED  # noqa: E402


def _keyed(name: str):
    fn, param, _, key = KEYED[name]

    def run(m):
        out = fn(m, **{param: key})
        return nullable_ints_as_double(out, "delivery_days") if "delivery_days" in out.columns else out

    run.__doc__ = f"{name} for one key"
    return run


REGISTRY.update({f"{name}__keyed": _keyed(name) for name in KEYED})


def _lists_as_text(df: DataFrame, **fields: tuple[str, ...]) -> DataFrame:
    """The arrays of a document as text, in their order."""
    return df.select(*[joined(c, *fields[c]).alias(c) if c in fields else c for c in df.columns])


_CHILDREN = dict(platforms=("id", "platform_name", "followers"), packages=("id", "package_name"))
REGISTRY.update({
    "q05_creator_profile_doc__keyed": lambda m: _lists_as_text(
        creators.creator_profile_doc(m, username="CREATOR_1"), **_CHILDREN, reviews=("id", "brand_name")),
    "q06_own_profile_doc__keyed": lambda m: _lists_as_text(creators.own_profile_doc(m, user_id="u-c-1"), **_CHILDREN),
    "q37_collaboration_doc__keyed": lambda m: _lists_as_text(
        collaborations.collaboration_doc(m, collaboration_id="cl-2"), participants=("id", "role", "name"),
        requests=("id", "status", "applicant_name"), reviews=("id", "rating", "reviewer_name")),
})
