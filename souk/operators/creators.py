"""Creator discovery and profile reads (Q1-Q7, Q41).

Every operator takes an optional key: given, the plan filters on it (and
the filter reaches the parquet scan); omitted, the operator answers for all
keys at once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.frame import nest, order_if_keyed, page_count, paginate, top_n_per_key
from souk.functions.text import CI_AI, js_parse_float, js_parse_int, js_truthy, like_any


def creator_categories(m) -> DataFrame:
    """Q1: distinct non-null, non-empty categories, ascending.

    Distinctness follows the case- and accent-insensitive default collation;
    the smallest spelling represents each group."""
    cp = m["creator_profiles"]
    return (cp.filter(F.col("category").isNotNull() & (F.col("category") != ""))
              .groupBy(F.collate("category", CI_AI).alias("_k"))
              .agg(F.min("category").alias("category"))
              .select("category")
              .orderBy("category"))


def _search_base(m, category=None, platform=None, location=None, search=None) -> DataFrame:
    """Profiles ⋈ users with the WHERE part of the creator search.

    A search reads whole bios, much work for few bytes, so the profiles are
    dealt out anew and each is looked at before the join, in many tasks."""
    cp = m["creator_profiles"]
    if js_truthy(search):
        cp = cp.repartition("id").withColumn("_says", like_any("username", search) | like_any("bio", search))
    cp = cp.alias("cp")
    u = m["users"].alias("u")
    df = cp.join(u, F.col("cp.user_id") == F.col("u.id"))
    if js_truthy(category):
        df = df.filter(like_any("cp.category", category))
    if js_truthy(location):
        df = df.filter(like_any("cp.city", location) | like_any("cp.country", location))
    if js_truthy(search):
        df = df.filter(F.col("cp._says") | like_any("u.name", search))
    if js_truthy(platform):
        plt = m["creator_platforms"].filter(like_any("platform_name", platform)).select(
            F.col("creator_id").alias("_pc"))
        df = df.join(plt, F.col("cp.id") == F.col("_pc"), "left_semi")
    return df


def _having_number(value, parse) -> float:
    n = parse(value)
    if isinstance(n, float) and math.isnan(n):
        # The reference interpolates NaN into SQL text and the database rejects it.
        raise ValueError(f"not a number: {value!r}")
    return n


def search_creators(m, category=None, platform=None, min_followers=None, max_price=None,
                    location=None, search=None, page=1, limit=12) -> DataFrame:
    """Q2: filtered creator listing with MIN(package price) and MAX(followers).

    Platforms and packages are aggregated per creator *before* joining, so
    the plan never builds the platforms × packages fan-out the reference's
    double LEFT JOIN produces (MIN/MAX are unaffected by it).  HAVING is a
    filter after the aggregate.  Ties are broken by id for stable pages."""
    base = _search_base(m, category, platform, location, search)
    plat = m["creator_platforms"].groupBy(F.col("creator_id").alias("_plc")).agg(
        F.max("followers").alias("max_followers"))
    pkg = m["promotion_packages"].groupBy(F.col("creator_id").alias("_pkc")).agg(
        F.min("price").alias("min_price"))
    df = (base.join(plat, F.col("cp.id") == F.col("_plc"), "left")
              .join(pkg, F.col("cp.id") == F.col("_pkc"), "left")
              .select("cp.id", "cp.username", "cp.bio", "cp.category", "cp.city", "cp.country",
                      "cp.verified", "cp.rating", "cp.created_at", "u.name", "u.avatar_url",
                      "min_price", "max_followers"))
    if js_truthy(min_followers):
        df = df.filter(F.col("max_followers") >= F.lit(_having_number(min_followers, js_parse_int)))
    if js_truthy(max_price):
        df = df.filter(F.col("min_price") <= F.lit(_having_number(max_price, js_parse_float)))
    return paginate(df, [F.col("rating").desc(), F.col("verified").desc(), F.col("id")],
                    page, limit)


def attach_platforms(m, creators: DataFrame, id_col: str = "id", nested: bool = False) -> DataFrame:
    """Q3: the platforms (platform, followers, engagement_rate) of the given
    creators.  Flat by default: one row per (creator, platform), a creator
    without platforms keeps one row with nulls — the platform rows are
    joined, never gathered per key.  ``nested=True`` builds the reference's
    array per creator (``[]`` if none) for a bounded page of creators."""
    plat = m["creator_platforms"].select(F.col("creator_id").alias("_pcid"),
                                         F.col("platform_name").alias("platform"), "followers", "engagement_rate")
    if not nested:
        return creators.join(plat, creators[id_col] == F.col("_pcid"), "left").drop("_pcid")
    page = creators.select(F.col(id_col).alias("_k")).distinct()
    plat = plat.join(page, F.col("_pcid") == F.col("_k"), "left_semi").withColumnRenamed("_pcid", "creator_id")
    arr = nest(plat, "creator_id", ["platform", "followers", "engagement_rate"], name="platforms")
    out = creators.join(arr.withColumnRenamed("creator_id", "_pcid"), creators[id_col] == F.col("_pcid"),
                        "left").drop("_pcid")
    empty = F.array().cast(arr.schema["platforms"].dataType)
    return out.withColumn("platforms", F.coalesce(F.col("platforms"), empty))


def search_creators_total(m, category=None, platform=None, min_followers=None, max_price=None,
                          location=None, search=None, page=1, limit=12) -> DataFrame:
    """Q4: ``total`` and ``pages`` of the creator search.

    Kept as in the reference: the count ignores the min_followers and
    max_price (HAVING) filters, so it can exceed the listed rows."""
    base = _search_base(m, category, platform, location, search)
    return base.agg(F.count_distinct("cp.id").alias("total")).select(
        "total", F.lit(int(js_parse_int(page))).alias("page"),
        page_count(F.col("total"), int(limit)).alias("pages"))


PLATFORM_FIELDS = ["id", "creator_id", "platform_name", "username", "profile_url", "followers", "engagement_rate"]
PACKAGE_FIELDS = ["id", "creator_id", "package_name", "description", "price", "delivery_days", "created_at"]


def _attach(df: DataFrame, part: DataFrame, name: str) -> DataFrame:
    p = part.withColumnRenamed("creator_id", f"_{name}_cid")
    out = df.join(p, df["id"] == p[f"_{name}_cid"], "left").drop(f"_{name}_cid")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(part.schema[name].dataType)))


def _count(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(F.col(key).alias(f"_{name}_k")).agg(F.count(F.lit(1)).alias(name))


def _with_counts(df: DataFrame, m) -> DataFrame:
    for t, name in (("creator_platforms", "n_platforms"), ("promotion_packages", "n_packages")):
        c = _count(m[t], "creator_id", name)
        df = (df.join(c, df["id"] == F.col(f"_{name}_k"), "left").drop(f"_{name}_k")
                .withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint"))))
    return df


def latest_reviews(m, n: int = 10) -> DataFrame:
    """The ``n`` newest reviews per creator with the brand user's name and avatar."""
    r = m["reviews"].alias("r")
    bp = m["brand_profiles"].alias("bp")
    u = m["users"].alias("u")
    rows = (r.join(bp, F.col("r.brand_id") == F.col("bp.id"))
             .join(u, F.col("bp.user_id") == F.col("u.id"))
             .select("r.*", F.col("u.name").alias("brand_name"), F.col("u.avatar_url").alias("brand_avatar")))
    return top_n_per_key(rows, "creator_id", [F.col("created_at").desc(), F.col("id")], n)


def _nested_reviews(m, n: int) -> DataFrame:
    """At most ``n`` reviews per creator as an array, newest first (bounded)."""
    rev = latest_reviews(m, n)
    return nest(rev.withColumn("_neg", -F.unix_micros(F.col("created_at").cast("timestamp"))),
                "creator_id", list(rev.columns), order=["_neg", "id"], name="reviews")


def creator_profile_doc(m, username: str | None = None, review_limit: int = 10) -> DataFrame:
    """Q5: a creator's profile with user name, email and avatar and the
    ``review_limit`` newest reviews (bounded array).

    For one ``username`` it is the reference's document: platforms and
    packages are arrays of that one creator's rows.  Set-wide, each creator
    gets ``n_platforms`` and ``n_packages`` instead and the child rows come
    flat from ``profile_children`` — a creator holding a third of all
    packages is then spread over tasks rather than built into one row."""
    cp = m["creator_profiles"]
    if username is not None:
        cp = cp.filter(F.collate(F.col("username"), CI_AI) == F.lit(username))
    u = m["users"].select(F.col("id").alias("_uid"), "name", "email", "avatar_url")
    df = cp.join(u, cp["user_id"] == F.col("_uid")).drop("_uid")
    if username is not None:
        ids = df.select(F.col("id").alias("_k"))
        for t, fields, name in (("creator_platforms", PLATFORM_FIELDS, "platforms"),
                                ("promotion_packages", PACKAGE_FIELDS, "packages")):
            rows = m[t].join(ids, F.col("creator_id") == F.col("_k"), "left_semi")
            df = _attach(df, nest(rows, "creator_id", fields, order=["id"], name=name), name)
    else:
        df = _with_counts(df, m)
    return _attach(df, _nested_reviews(m, review_limit), "reviews")


def profile_children(m, creator_id: str | None = None) -> DataFrame:
    """Q5/Q6 children, flat: one row per platform or package of a creator
    (``kind``, item id, name, followers or price)."""
    plat = m["creator_platforms"].select("creator_id", F.lit("platform").alias("kind"), F.col("id").alias("item_id"),
                                         F.col("platform_name").alias("name"),
                                         F.col("followers").cast("decimal(20,2)").alias("amount"))
    pkg = m["promotion_packages"].select("creator_id", F.lit("package").alias("kind"), F.col("id").alias("item_id"),
                                         F.col("package_name").alias("name"),
                                         F.col("price").cast("decimal(20,2)").alias("amount"))
    out = plat.unionByName(pkg)
    return out if creator_id is None else out.filter(F.col("creator_id") == creator_id)


def own_profile_doc(m, user_id: str | None = None) -> DataFrame:
    """Q6: as Q5 for the signed-in creator, without email and reviews
    (arrays for one user, counts set-wide)."""
    cp = m["creator_profiles"]
    if user_id is not None:
        cp = cp.filter(F.col("user_id") == F.lit(user_id))
    u = m["users"].select(F.col("id").alias("_uid"), "name", "avatar_url")
    df = cp.join(u, cp["user_id"] == F.col("_uid")).drop("_uid")
    if user_id is None:
        return _with_counts(df, m)
    ids = df.select(F.col("id").alias("_k"))
    for t, fields, name in (("creator_platforms", PLATFORM_FIELDS, "platforms"),
                            ("promotion_packages", PACKAGE_FIELDS, "packages")):
        rows = m[t].join(ids, F.col("creator_id") == F.col("_k"), "left_semi")
        df = _attach(df, nest(rows, "creator_id", fields, order=["id"], name=name), name)
    return df


def earnings_statement(m, creator_id: str | None = None) -> DataFrame:
    """Q7 rows: earnings with booking date, brand user name and package name,
    newest first."""
    ce = m["creator_earnings"].alias("ce")
    if creator_id is not None:
        ce = ce.filter(F.col("creator_id") == creator_id).alias("ce")
    b = m["bookings"].alias("b")
    bp = m["brand_profiles"].alias("bp")
    u = m["users"].alias("u")
    pkg = m["promotion_packages"].alias("pkg")
    df = (ce.join(b, F.col("ce.booking_id") == F.col("b.id"))
            .join(bp, F.col("b.brand_id") == F.col("bp.id"))
            .join(u, F.col("bp.user_id") == F.col("u.id"))
            .join(pkg, F.col("b.package_id") == F.col("pkg.id"), "left")
            .select("ce.*", F.col("b.created_at").alias("booking_date"),
                    F.col("u.name").alias("brand_name"), "pkg.package_name"))
    return order_if_keyed(df, creator_id, F.col("created_at").desc(), F.col("id"))


def earnings_total(m, creator_id: str | None = None) -> DataFrame:
    """Q7 total: sum over *all* statuses of the joined statement rows, exact
    in decimal (the reference sums floats).  Partial sums run before the
    shuffle, so a creator with a third of all rows costs one row per task."""
    rows = earnings_statement(m, creator_id)
    return rows.groupBy("creator_id").agg(F.sum("amount").alias("total"),
                                          F.count(F.lit(1)).alias("n_earnings"))


def resolve_profile(m, actors: DataFrame, user_col: str = "actor_user_id") -> DataFrame:
    """Q41: add the actor's creator and brand profile ids (null when none)."""
    cp = m["creator_profiles"].select(F.col("user_id").alias("_cu"), F.col("id").alias("creator_profile_id"))
    bp = m["brand_profiles"].select(F.col("user_id").alias("_bu"), F.col("id").alias("brand_profile_id"))
    return (actors.join(cp, actors[user_col] == F.col("_cu"), "left").drop("_cu")
                  .join(bp, actors[user_col] == F.col("_bu"), "left").drop("_bu"))
