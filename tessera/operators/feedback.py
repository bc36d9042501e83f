"""Feedback on answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_COMMENT = 1000


def normalize(feedback: DataFrame) -> DataFrame:
    """(type thumbs | rating, thumb up | down, rating, comment) -> rating 1..5 and reject_reason; thumbs are 5 and 1."""
    rating = F.when(F.col("type") == "thumbs", F.when(F.col("thumb") == "up", 5).when(F.col("thumb") == "down", 1)).otherwise(F.col("rating")).cast("int")
    reason = F.when(F.col("_r").isNull(), "no rating").when(~F.col("_r").between(1, 5), "rating out of range").when(F.length("comment") > MAX_COMMENT, "comment too long")
    return feedback.withColumn("_r", rating).withColumn("reject_reason", reason).withColumn("rating", F.col("_r")).drop("_r")


def stats(feedback: DataFrame, now: Column | None = None, days: int | None = None) -> DataFrame:
    """One row over the last `days`: total, thumbs_up (5), thumbs_down (1), up_rate, average, rating_1..rating_5."""
    own = feedback if days is None else feedback.filter(F.unix_timestamp(now) - F.unix_timestamp("created_at") <= days * 86400)
    out = own.agg(
        F.count("*").alias("total"), F.count_if(F.col("rating") == 5).alias("thumbs_up"), F.count_if(F.col("rating") == 1).alias("thumbs_down"), F.coalesce(F.avg("rating"), F.lit(0.0)).alias("average"),
        *(F.count_if(F.col("rating") == i).alias(f"rating_{i}") for i in range(1, 6)),
    )
    both = F.col("thumbs_up") + F.col("thumbs_down")
    return out.withColumn("up_rate", F.when(both > 0, F.col("thumbs_up") / both).otherwise(0.0))


def evaluation_set(feedback: DataFrame, query_logs: DataFrame, min_rating: int = 4, limit: int = 1000) -> DataFrame:
    """The best rated answers with query and response, newest first; `limit` is the size of the set asked for."""
    own = feedback.filter(F.col("rating") >= min_rating).join(query_logs.select("query_id", "query", "response"), "query_id")
    own = own.filter("query IS NOT NULL AND response IS NOT NULL")
    return own.orderBy(F.col("created_at").desc(), "query_id").limit(limit).select("query_id", "query", "response", "rating", F.when(F.col("comment") != "", F.col("comment")).alias("comment"))
