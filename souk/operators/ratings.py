"""Stored ratings kept up to date (M1-M3): the reference's triggers as
set-wide aggregates merged back into creator_profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded_avg(col: str = "rating"):
    """``ROUND(AVG(int), 2)`` as MySQL computes it: the average is a decimal
    with 4 fraction digits, then rounded half-up to 2."""
    return F.round(F.avg(F.col(col).cast("decimal(10,0)")), 2).cast("decimal(3,2)")


def _averages(reviews: DataFrame, target: str) -> DataFrame:
    return reviews.groupBy(F.col("creator_id").alias("_rid")).agg(rounded_avg().alias(f"_new_{target}"))


def _merge(profiles: DataFrame, avgs: DataFrame, target: str) -> DataFrame:
    j = profiles.join(avgs, profiles["id"] == F.col("_rid"), "left")
    return j.select(*[F.coalesce(F.col(f"_new_{target}"), profiles[c]).alias(c) if c == target
                      else profiles[c] for c in profiles.columns])


def creator_ratings(m) -> DataFrame:
    """M1: creator_profiles with ``rating`` = ROUND(AVG(reviews.rating), 2) for
    creators that have reviews; the others keep their stored value."""
    return _merge(m["creator_profiles"], _averages(m["reviews"], "rating"), "rating")


def collaboration_ratings(m) -> DataFrame:
    """M2: the same for ``collaboration_rating`` over collaboration reviews."""
    return _merge(m["creator_profiles"], _averages(m["collaboration_reviews"], "collaboration_rating"),
                  "collaboration_rating")


def refresh_ratings(m, changed_reviews: DataFrame, target: str = "rating",
                    review_table: str = "reviews") -> DataFrame:
    """M3: recompute only creators touched by inserted or updated reviews
    (``changed_reviews`` carries their creator_id).  ``m[review_table]`` is
    the review table *after* the change.  Deletes fire no trigger in the
    reference, so a creator touched only by a delete keeps the old value."""
    touched = changed_reviews.select(F.col("creator_id").alias("_t")).distinct()
    reviews = m[review_table].join(touched, F.col("creator_id") == F.col("_t"), "left_semi")
    return _merge(m["creator_profiles"], _averages(reviews, target), target)
