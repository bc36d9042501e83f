"""Score fusion and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scores as S

from . import bm25, vectors
from .common import topk

WEIGHTS = (5.0, 3.0, 0.2)
RRF_K = 60
HALF_LIFE_DAYS = 30.0


def recency(created: Column, now: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """0.5 ** (whole days / half life), within 0..1; 0 for a missing time."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(created)) / 86400)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow(F.lit(0.5), days / half_life))), F.lit(0.0))


def parsed_time(c: Column) -> Column:
    """A time from metadata text: an ISO time or seconds since the epoch."""
    return F.coalesce(F.try_to_timestamp(c), F.timestamp_seconds(c.try_cast("double")))


def both_sides(vector_hits: DataFrame, bm25_hits: DataFrame) -> DataFrame:
    """Full outer join of (query_id, chunk_id, score, rank), with flags for the sides that hold a row."""
    v = vector_hits.select("query_id", "chunk_id", F.col("score").alias("vector_raw"), F.col("rank").alias("vector_rank"), S.min_max(F.col("score")).alias("vector_score"))
    b = bm25_hits.select("query_id", "chunk_id", F.col("score").alias("bm25_raw"), F.col("rank").alias("bm25_rank"), S.min_max(F.col("score")).alias("bm25_score"))
    out = v.join(b, ["query_id", "chunk_id"], "full_outer")
    return out.withColumns({"from_vector": F.col("vector_raw").isNotNull(), "from_bm25": F.col("bm25_raw").isNotNull(), "vector_score": F.coalesce("vector_score", F.lit(0.0)), "bm25_score": F.coalesce("bm25_score", F.lit(0.0))})


def weighted_sum(sides: DataFrame, recency_score: Column | None = None, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    r = F.lit(0.0) if recency_score is None else recency_score
    return sides.withColumn("recency_score", r).withColumn("combined_score", weights[0] * F.col("vector_score") + weights[1] * F.col("bm25_score") + weights[2] * F.col("recency_score"))


def reciprocal_rank(sides: DataFrame, k: int = RRF_K) -> DataFrame:
    """Sum over the sides of 1 / (k + rank), ranks from 1; a side without the chunk adds nothing."""
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    return sides.withColumn("combined_score", part("vector_rank") + part("bm25_rank"))


#: "relative_score" is another name of the weighted sum.
METHODS = {"weighted_sum": weighted_sum, "relative_score": weighted_sum, "rrf": reciprocal_rank}


def cut(fused: DataFrame, k: int) -> DataFrame:
    return topk(fused, "query_id", [F.round("combined_score", 9).desc(), F.col("chunk_id")], k)


def overlap_stats(fused: DataFrame) -> DataFrame:
    """(query_id, total_vector, total_bm25, unique_results, overlap, overlap_ratio, top_score)."""
    out = fused.groupBy("query_id").agg(
        F.count_if("from_vector").alias("total_vector"), F.count_if("from_bm25").alias("total_bm25"), F.count("*").alias("unique_results"),
        F.count_if(F.col("from_vector") & F.col("from_bm25")).alias("overlap"), F.max("combined_score").alias("top_score"),
    )
    return out.withColumn("overlap_ratio", F.col("overlap") / F.col("unique_results"))


def coalesced(vector_hits: DataFrame, bm25_hits: DataFrame, fields: list[str]) -> DataFrame:
    """Full outer join of hits with their fields; the vector side's come first."""
    v = vector_hits.select("query_id", "chunk_id", *(F.col(c).alias(f"v_{c}") for c in fields), F.lit(True).alias("_v"))
    b = bm25_hits.select("query_id", "chunk_id", *(F.col(c).alias(f"b_{c}") for c in fields), F.lit(True).alias("_b"))
    out = v.join(b, ["query_id", "chunk_id"], "full_outer")
    return out.select("query_id", "chunk_id", *(F.coalesce(f"v_{c}", f"b_{c}").alias(c) for c in fields), F.col("_v").isNotNull().alias("from_vector"), F.col("_b").isNotNull().alias("from_bm25"))


def hybrid_search(queries: DataFrame, chunks: DataFrame, candidates: int = 100, k: int = 100, method: str = "weighted_sum", weights=WEIGHTS, where: Column | None = None, filter_bm25: bool = True, now: Column | None = None) -> DataFrame:
    """queries (query_id, text, embedding), chunks (chunk_id, content, embedding[, created_at, ...]) -> fused hits, the k best of each query.

    `where` holds for both sides, or with filter_bm25=False for the vector side only. Texts join again only after the cut, by the caller.
    """
    near = chunks if where is None else chunks.filter(where)
    worded = near if filter_bm25 else chunks
    v = vectors.top_k(queries, near.select(F.col("chunk_id").alias("id"), "embedding"), candidates).withColumnRenamed("id", "chunk_id")
    b = bm25.search(queries.select("query_id", "text"), worded.select("chunk_id", "content"), candidates)
    sides = both_sides(v, b)
    if method == "rrf":
        return cut(reciprocal_rank(sides), k)
    if now is None or "created_at" not in chunks.columns:
        return cut(weighted_sum(sides, weights=weights), k)
    dated = sides.join(chunks.select("chunk_id", "created_at"), "chunk_id")
    return cut(weighted_sum(dated, recency(F.col("created_at"), now), weights), k)


def vector_only(vector_hits: DataFrame) -> DataFrame:
    """Vector hits in the shape of fused ones."""
    return vector_hits.select("query_id", "chunk_id", F.col("score").alias("combined_score"), F.col("score").alias("vector_score"), F.lit(0.0).alias("bm25_score"), F.lit(True).alias("from_vector"), F.lit(False).alias("from_bm25"), "rank")


def sweep(sides: DataFrame, settings: DataFrame, k: int) -> DataFrame:
    """Fused once for each row of (setting, w_vector, w_bm25); sides are normalised once."""
    score = F.col("w_vector") * F.col("vector_score") + F.col("w_bm25") * F.col("bm25_score")
    out = sides.crossJoin(F.broadcast(settings)).withColumn("combined_score", score)
    return topk(out, ["setting", "query_id"], [F.round("combined_score", 9).desc(), F.col("chunk_id")], k)
