"""Creator-to-creator collaboration reads (Q35-Q40)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.frame import nest, order_if_keyed, page_count, paginate
from souk.functions.text import js_parse_int, js_truthy, like_any

LISTED = ("open", "in_progress")


def _listing_filter(c: DataFrame, platform=None, category=None, location=None,
                    followers_required=None) -> DataFrame:
    c = c.filter(F.col("status").isin(*LISTED))
    if js_truthy(platform):
        c = c.filter(like_any("platform", platform))
    if js_truthy(category):
        c = c.filter(like_any("category", category))
    if js_truthy(location):
        c = c.filter(like_any("location", location))
    if js_truthy(followers_required):
        c = c.filter(F.col("followers_required") <= F.lit(js_parse_int(followers_required)))
    return c


def _owner_card(m) -> DataFrame:
    cp = m["creator_profiles"].alias("cp")
    u = m["users"].alias("u")
    return cp.join(u, F.col("cp.user_id") == F.col("u.id")).select(
        F.col("cp.id").alias("_owner"), F.col("u.name").alias("creator_name"),
        F.col("u.avatar_url").alias("creator_avatar"), F.col("cp.username").alias("creator_username"),
        F.col("cp.rating").alias("creator_rating"), "cp.collaboration_rating", "cp.verified")


def list_collaborations(m, platform=None, category=None, location=None, followers_required=None,
                        page=1, limit=12) -> DataFrame:
    """Q35: open and in-progress collaborations with owner card and
    ``request_count``, newest first, paged.  The correlated COUNT subquery is
    a pre-aggregated count per collaboration, left-joined (0 when none)."""
    c = _listing_filter(m["collaborations"], platform, category, location, followers_required)
    req = m["collaboration_requests"].groupBy(F.col("collaboration_id").alias("_rc")).agg(
        F.count(F.lit(1)).alias("request_count"))
    df = (c.join(_owner_card(m), c["creator_id"] == F.col("_owner"))
           .join(req, c["id"] == F.col("_rc"), "left")
           .drop("_owner", "_rc")
           .withColumn("request_count", F.coalesce(F.col("request_count"), F.lit(0).cast("bigint"))))
    return paginate(df, [F.col("created_at").desc(), F.col("id")], js_parse_int(page), js_parse_int(limit))


def list_collaborations_total(m, platform=None, category=None, location=None, followers_required=None,
                              page=1, limit=12) -> DataFrame:
    """Q36: total and pages, counted from collaborations alone (no owner join)."""
    c = _listing_filter(m["collaborations"], platform, category, location, followers_required)
    lim = js_parse_int(limit)
    return c.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(js_parse_int(page)).alias("page"), page_count(F.col("total"), lim).alias("pages"))


def collaboration_parts(m):
    """Participants, requests and reviews of every collaboration as flat rows
    (the reference's three per-collaboration queries)."""
    cp = m["creator_profiles"].alias("p2")
    u = m["users"].alias("u2")
    prof = cp.join(u, F.col("p2.user_id") == F.col("u2.id"))
    participants = (m["collaboration_participants"].alias("j")
                    .join(prof, F.col("j.creator_id") == F.col("p2.id"))
                    .select("j.collaboration_id", F.col("p2.id").alias("id"), "p2.username", "p2.rating",
                            "p2.collaboration_rating", "u2.name", "u2.avatar_url", "j.role", "j.joined_at"))
    requests = (m["collaboration_requests"].alias("cr")
                .join(prof, F.col("cr.creator_id") == F.col("p2.id"))
                .select("cr.*", F.col("p2.username").alias("applicant_username"),
                        F.col("u2.name").alias("applicant_name"), F.col("u2.avatar_url").alias("applicant_avatar"),
                        F.col("p2.rating").alias("applicant_rating")))
    reviews = (m["collaboration_reviews"].alias("rv")
               .join(prof, F.col("rv.reviewer_id") == F.col("p2.id"))
               .select("rv.*", F.col("u2.name").alias("reviewer_name"),
                       F.col("u2.avatar_url").alias("reviewer_avatar")))
    return participants, requests, reviews


def collaboration_doc(m, collaboration_id: str | None = None) -> DataFrame:
    """Q37: collaboration + owner card.  For one ``collaboration_id`` it is
    the reference's document with participants, requests (newest first) and
    reviews (newest first) as arrays of that collaboration's rows.
    Set-wide, each collaboration carries ``n_participants``, ``n_requests``
    and ``n_reviews`` and the rows come flat from ``collaboration_parts``,
    so no collaboration's children are gathered into one row."""
    c = m["collaborations"]
    if collaboration_id is not None:
        c = c.filter(F.col("id") == collaboration_id)
    df = c.join(_owner_card(m), c["creator_id"] == F.col("_owner")).drop("_owner")
    participants, requests, reviews = collaboration_parts(m)
    if collaboration_id is None:
        for part, name in ((participants, "n_participants"), (requests, "n_requests"), (reviews, "n_reviews")):
            cnt = part.groupBy(F.col("collaboration_id").alias(f"_{name}")).agg(F.count(F.lit(1)).alias(name))
            df = (df.join(cnt, df["id"] == F.col(f"_{name}"), "left").drop(f"_{name}")
                    .withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint"))))
        return df
    neg = lambda col: -F.unix_micros(F.col(col).cast("timestamp"))
    key = [collaboration_id]
    parts = [
        nest(participants.filter(F.col("collaboration_id").isin(key)), "collaboration_id",
             [c_ for c_ in participants.columns if c_ != "collaboration_id"], order=["id"], name="participants"),
        nest(requests.filter(F.col("collaboration_id").isin(key)).withColumn("_o", neg("created_at")),
             "collaboration_id", requests.columns, order=["_o", "id"], name="requests"),
        nest(reviews.filter(F.col("collaboration_id").isin(key)).withColumn("_o", neg("created_at")),
             "collaboration_id", reviews.columns, order=["_o", "id"], name="reviews"),
    ]
    for p in parts:
        name = [x for x in p.columns if x != "collaboration_id"][0]
        p = p.withColumnRenamed("collaboration_id", f"_{name}")
        df = df.join(p, df["id"] == F.col(f"_{name}"), "left").drop(f"_{name}")
        df = df.withColumn(name, F.coalesce(F.col(name), F.array().cast(p.schema[name].dataType)))
    return df


def my_collaborations(m, creator_id: str | None = None) -> DataFrame:
    """Q38: collaborations a creator owns (``my_role='owner'``) and those they
    take part in without owning (their participant role), tagged by ``list``."""
    c = m["collaborations"]
    owned = c.select(F.col("creator_id").alias("self_id"), *c.columns,
                     F.lit("owner").alias("my_role"), F.lit("owned").alias("list"))
    j = m["collaboration_participants"].select(F.col("collaboration_id").alias("_cid"),
                                               F.col("creator_id").alias("self_id"), F.col("role").alias("my_role"))
    part = (c.join(j, c["id"] == F.col("_cid")).filter(F.col("creator_id") != F.col("self_id"))
             .select("self_id", *c.columns, "my_role", F.lit("participating").alias("list")))
    out = owned.unionByName(part)
    if creator_id is not None:
        out = out.filter(F.col("self_id") == creator_id)
    return order_if_keyed(out, creator_id, "list", F.col("created_at").desc(), "id")


def collaboration_thread(m, collaboration_id: str | None = None) -> DataFrame:
    """Q39: a collaboration's chat, oldest first.  The inner join to the
    sender's creator profile hides senders without one, as in the reference."""
    msg = m["collaboration_messages"]
    if collaboration_id is not None:
        msg = msg.filter(F.col("collaboration_id") == collaboration_id)
    msg = msg.alias("m")
    u = m["users"].alias("u")
    cp = m["creator_profiles"].alias("cp")
    return (msg.join(u, F.col("m.sender_id") == F.col("u.id"))
               .join(cp, F.col("cp.user_id") == F.col("u.id"))
               .select("m.*", F.col("u.name").alias("sender_name"), F.col("u.avatar_url").alias("sender_avatar"),
                       F.col("cp.username").alias("sender_username"))
               .transform(lambda d: order_if_keyed(d, collaboration_id, "created_at", "id")))


def collaboration_reviews_for(m, creator_id: str | None = None) -> DataFrame:
    """Q40: collaboration reviews about a creator with reviewer name, avatar
    and collaboration title, newest first."""
    cr = m["collaboration_reviews"]
    if creator_id is not None:
        cr = cr.filter(F.col("creator_id") == creator_id)
    cr = cr.alias("cr")
    cp = m["creator_profiles"].alias("cp")
    u = m["users"].alias("u")
    c = m["collaborations"].alias("c")
    return (cr.join(cp, F.col("cr.reviewer_id") == F.col("cp.id"))
              .join(u, F.col("cp.user_id") == F.col("u.id"))
              .join(c, F.col("cr.collaboration_id") == F.col("c.id"))
              .select("cr.*", F.col("u.name").alias("reviewer_name"), F.col("u.avatar_url").alias("reviewer_avatar"),
                      F.col("c.title").alias("collaboration_title"))
              .transform(lambda d: order_if_keyed(d, creator_id, F.col("created_at").desc(), "id")))
