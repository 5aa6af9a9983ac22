"""Unit goldens (FIXTURES.md §1) and scalar semantics."""

import hashlib
import hmac
from decimal import Decimal

from pyspark.sql import functions as F

from souk.functions.ids import hmac_sha256_hex
from souk.functions.text import encode_uri_component, js_parse_float, js_parse_int, locale_amount
from souk.operators import bookings, money, ratings
from tests.helpers import bundle, ts

D = Decimal


def _profit_bundle(spark, amounts):
    users = [{"id": "u1", "name": "B", "role": "brand"}, {"id": "u2", "name": "C", "role": "creator"}]
    bp = [{"id": "b1", "user_id": "u1", "company_name": "Co"}]
    cp = [{"id": "c1", "user_id": "u2", "username": "cc", "rating": D("0.00")}]
    bk = [{"id": f"bk{i}", "brand_id": "b1", "creator_id": "c1", "price": a, "status": "completed"}
          for i, a in enumerate(amounts)]
    pay = [{"id": f"p{i}", "booking_id": f"bk{i}", "amount": a, "payment_status": "completed", "created_at": ts(i)}
           for i, a in enumerate(amounts)]
    return bundle(spark, users=users, brand_profiles=bp, creator_profiles=cp, bookings=bk, payments=pay)


def test_fee_and_payout_rounding(spark):
    m = _profit_bundle(spark, [D("2500.00"), D("0.05"), D("33.33")])
    got = {r.amount: (r.platform_fee, r.creator_payout) for r in bookings.platform_profit(m).collect()}
    assert got == {D("2500.00"): (D("250.00"), D("2250.00")), D("0.05"): (D("0.01"), D("0.05")),
                   D("33.33"): (D("3.33"), D("30.00"))}
    t = bookings.platform_profit_totals(m).first()
    assert t.total_platform_profit == D("253.34") and t.total_creator_payout == D("2280.05")


def test_rating_average_rounds_half_up(spark):
    m = bundle(spark, creator_profiles=[{"id": "c1", "rating": D("1.00")}, {"id": "c2", "rating": D("3.00")}],
               reviews=[{"id": f"r{i}", "creator_id": "c1", "rating": v} for i, v in enumerate([4, 5, 5])])
    got = {r.id: r.rating for r in ratings.creator_ratings(m).collect()}
    assert got == {"c1": D("4.67"), "c2": D("3.00")}


def test_refresh_ignores_untouched(spark):
    m = bundle(spark, creator_profiles=[{"id": "c1", "rating": D("1.00")}, {"id": "c2", "rating": D("3.00")}],
               reviews=[{"id": "r1", "creator_id": "c1", "rating": 5}, {"id": "r2", "creator_id": "c2", "rating": 1}])
    changed = m["reviews"].filter(F.col("id") == "r1")
    got = {r.id: r.rating for r in ratings.refresh_ratings(m, changed).collect()}
    assert got == {"c1": D("5.00"), "c2": D("3.00")}


def test_withdrawal_queue_order(spark):
    w = [{"id": s, "creator_id": "c1", "amount": D("1.00"), "status": s, "created_at": ts(0)}
         for s in ["rejected", "approved", "pending", "paid"]]
    m = bundle(spark, users=[{"id": "u1", "name": "n"}], creator_profiles=[{"id": "c1", "user_id": "u1"}],
               withdrawals=w)
    assert [r.status for r in money.withdrawal_queue(m).collect()] == ["paid", "pending", "approved", "rejected"]


def test_balances_differ_between_creator_and_admin_views(spark):
    w = [{"id": s, "creator_id": "c1", "amount": a, "status": s}
         for s, a in [("pending", D("200")), ("approved", D("300")), ("paid", D("400")), ("rejected", D("50"))]]
    m = bundle(spark, creator_profiles=[{"id": "c1"}],
               creator_earnings=[{"id": "e1", "creator_id": "c1", "amount": D("1000"), "status": "paid"}],
               withdrawals=w)
    assert money.available_balance(m).first().available == D("500.00")
    t = money.withdrawal_totals(m).first()
    assert (t.available_balance, t.total_withdrawn) == (D("100.00"), D("900.00"))


def test_locale_amount(spark):
    df = spark.createDataFrame([(25000.0,), (25000.5,), (1234567.25,)], "x double")
    assert [r[0] for r in df.select(locale_amount("x")).collect()] == ["25,000", "25,000.5", "1,234,567.25"]


def test_hmac_matches_python(spark):
    key = b"k" * 20
    df = spark.createDataFrame([("o|p",), ("ord-1|pay_2",)], "m string")
    got = [r[0] for r in df.select(hmac_sha256_hex(key, F.col("m"))).collect()]
    assert got[0] == "f91ecb7e458067e05f654090fe26e67c31a3303ec52d17ec97b3f4722e847182"
    assert got[1] == hmac.new(key, b"ord-1|pay_2", hashlib.sha256).hexdigest()
    long_key = b"x" * 100
    got = spark.createDataFrame([("a",)], "m string").select(hmac_sha256_hex(long_key, F.col("m"))).first()[0]
    assert got == hmac.new(long_key, b"a", hashlib.sha256).hexdigest()


def test_encode_uri_component(spark):
    df = spark.createDataFrame([("Ana María (x)!'~*",)], "s string")
    assert df.select(encode_uri_component("s")).first()[0] == "Ana%20Mar%C3%ADa%20(x)!'~*"


def test_js_parsers():
    assert js_parse_int("12abc") == 12 and js_parse_float(" 3.5kg") == 3.5
    assert js_parse_int("abc") != js_parse_int("abc")  # NaN


def test_segmented_scan_equals_plain_windows(spark):
    import random

    from pyspark.sql import Window

    from souk.functions.frame import last_before
    rnd = random.Random(7)
    rows = [(rnd.choice(["hot", "hot", "k1", "k2", None]), s // 3, s, rnd.choice(["a", "b"]), rnd.choice([None, None, "x", "y"]))
            for s in rnd.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "k string, seq long, id long, v string, w string").filter("k is not null")
    for after in (False, True):
        by = [F.col(c).desc() if after else F.col(c) for c in ("seq", "id")]
        w = Window.partitionBy("k").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        want = df.select("*", F.last("v", ignorenulls=True).over(w).alias("lv"), F.last("w", ignorenulls=True).over(w).alias("lw"))
        for ranges in (1, 3, 40):
            got = last_before(df, ["k"], ["seq", "id"], {"lv": F.col("v"), "lw": F.col("w")}, ranges, after)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (after, ranges)


def test_slices_hold_equal_numbers_of_rows(spark):
    """A user with a third of all rows, half of them at one instant, fills no slice."""
    from souk.functions.frame import ranged

    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 500)).alias("user"),
                                    F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("t"), "id")
    sizes = [r["count"] for r in ranged(df, ["user"], ["t", "id"], 30).groupBy("user", "_rg").count().collect()]
    assert max(sizes) <= 2 * 30_000 / 30 and sum(sizes) == 30_000


def test_wildcards_compare_under_the_collation(spark):
    """LIKE with % and _ against a plain matcher that backtracks; case and accents do not count."""
    import itertools
    import random
    import unicodedata

    from souk.functions.text import like_any

    def fold(c):
        return unicodedata.normalize("NFD", c)[0].lower()

    def like(value, pattern):
        if not pattern:
            return not value
        if pattern[0] == "%":
            return any(like(value[i:], pattern[1:]) for i in range(len(value) + 1))
        if pattern[0] == "\\" and len(pattern) > 1:
            return bool(value) and fold(value[0]) == fold(pattern[1]) and like(value[1:], pattern[2:])
        return bool(value) and (pattern[0] == "_" or fold(value[0]) == fold(pattern[0])) and like(value[1:], pattern[1:])

    rng = random.Random(3)
    values = ["", "a", "Éa", "aéA", "b%a", "a_b", "ÀBba", None] + ["".join(rng.choices("aAéEbB%_", k=rng.randint(1, 7))) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    patterns = ["%", "_", "a%b", "_a", "e_", "A_%b", "\\%a", "\\_", "__", "é%é%a", "a_b_"] + [
        "".join(rng.choices("aéb%_", k=4)) for _ in range(12)]
    got = df.select("v", *[like_any("v", p).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    for r, (i, p) in itertools.product(got, enumerate(patterns)):
        assert r[f"p{i}"] == (None if r["v"] is None else like(r["v"], "%" + p + "%")), (r["v"], p)


def test_amounts_round_half_away_from_zero(spark):
    from souk.functions.text import locale_amount

    df = spark.createDataFrame([(100.0625,), (1234.5,), (0.0005,), (7.0,)], "x double")
    assert [r[0] for r in df.select(locale_amount("x")).collect()] == ["100.063", "1,234.5", "0.001", "7"]


def test_extname_as_node(spark):
    from souk.functions.text import extname

    df = spark.createDataFrame([("a.MP4",), (".mp4",), ("x/.png",), ("a.b.jpg",), ("a.",), ("none",)], "x string")
    assert [r[0] for r in df.select(extname("x")).collect()] == [".mp4", "", "", ".jpg", ".", ""]


def test_blank_as_javascript_trims(spark):
    from souk.functions.text import js_not_blank

    df = spark.createDataFrame([(" \n\t",), (" 　﻿",), ("",), (None,), (" x ",)], "x string")
    assert [r[0] for r in df.select(js_not_blank("x")).collect()] == [False, False, False, False, True]
