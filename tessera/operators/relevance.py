"""Relevance filtering of ranked candidates, per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores as S

MIN_SCORE, MIN_CHUNKS, MAX_CHUNKS = 0.6, 1, 5


def threshold(strategy: str, score: Column, min_score: Column, std_multiplier: float = 1.0, percentile: float = 70.0) -> Column:
    """The cut of each query. threshold: min_score. dynamic: mean - m * sample deviation, at least half of min_score. percentile: the ascending score at
    index int(n (1 - p / 100)). top_k: 0."""
    w = Window.partitionBy("query_id")
    if strategy == "dynamic":
        return F.greatest(F.avg(score).over(w) - std_multiplier * F.coalesce(F.nanvl(F.stddev_samp(score).over(w), F.lit(0.0)), F.lit(0.0)), 0.5 * min_score)
    if strategy == "percentile":
        at = F.floor(F.count(score).over(w) * F.lit(1 - percentile / 100)).cast("int")
        return F.element_at(F.sort_array(F.collect_list(score).over(w)), F.least(at + 1, F.count(score).over(w).cast("int")))
    return F.lit(0.0) if strategy == "top_k" else min_score


def filter_hits(hits: DataFrame, strategy: str = "threshold", score: str = "score", normalize=S.min_max, min_score: Column | float = MIN_SCORE, min_chunks: int = MIN_CHUNKS, max_chunks: int = MAX_CHUNKS, **options) -> DataFrame:
    """hits (query_id, chunk_id, score, rank from 1) -> those that pass, filled up to `min_chunks` with the best of the others, cut to `max_chunks`.

    Adds relevance_score, threshold_used, passed_threshold, filter_reason and a new rank from 0.
    """
    least = min_score if isinstance(min_score, Column) else F.lit(float(min_score))
    own = hits.withColumn("relevance_score", normalize(F.col(score)))
    own = own.withColumn("threshold_used", threshold(strategy, F.col("relevance_score"), least, **options))
    by = Window.partitionBy("query_id")
    passed = F.row_number().over(by.orderBy("rank")) <= max_chunks if strategy == "top_k" else F.col("relevance_score") >= F.col("threshold_used")
    own = own.withColumn("passed_threshold", passed).withColumn("input_count", F.count("*").over(by))
    own = own.withColumn("_passed", F.count_if("passed_threshold").over(by))
    place = F.row_number().over(Window.partitionBy("query_id", "passed_threshold").orderBy(F.col("relevance_score").desc(), "rank"))
    own = own.withColumn("_place", place).filter(F.col("passed_threshold") | (F.col("_passed") + F.col("_place") <= min_chunks))
    order = [F.col("passed_threshold").desc(), F.when(F.col("passed_threshold"), F.col("rank")).otherwise(F.col("_place"))]
    own = own.withColumn("new_rank", (F.row_number().over(by.orderBy(*order)) - 1).cast("long")).filter(F.col("new_rank") < max_chunks)
    reason = F.when(F.col("passed_threshold"), "").otherwise("added to meet minimum")
    return own.withColumn("filter_reason", reason).drop("_passed", "_place", "rank").withColumnRenamed("new_rank", "rank")


def filter_stats(filtered: DataFrame) -> DataFrame:
    out = filtered.groupBy("query_id").agg(
        F.max("input_count").alias("input_count"), F.count("*").alias("output_count"), F.max("threshold_used").alias("threshold_used"),
        F.avg("relevance_score").alias("avg_score"), F.min("relevance_score").alias("min_score"), F.max("relevance_score").alias("max_score"),
    )
    out = out.withColumn("filtered_count", F.col("input_count") - F.col("output_count"))
    return out.withColumns({"filter_rate": F.col("filtered_count") / F.col("input_count"), "retention_rate": F.col("output_count") / F.col("input_count")})


def adaptive_threshold(confidence: Column) -> Column:
    return 0.5 + 0.3 * confidence
