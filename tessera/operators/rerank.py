"""Reranking of candidate rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bm25 import tokens
from .common import topk


def jaccard(a: Column, b: Column) -> Column:
    """Token overlap of two texts, the default pair scorer; 0 if both are empty."""
    return overlap(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))


def overlap(x: Column, y: Column) -> Column:
    """The same of two arrays of distinct tokens."""
    # a transform over one element names the three sizes, so that each token set is worked out once
    sizes = F.array(F.struct(F.size(x).alias("x"), F.size(y).alias("y"), F.size(F.array_intersect(x, y)).alias("both")))
    return F.get(F.transform(sizes, lambda n: F.when(n["x"] + n["y"] == 0, 0.0).otherwise(n["both"] / (n["x"] + n["y"] - n["both"]))), 0)


def token_sets(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the distinct tokens of a text, for `overlap`: a text of many pairs is gone through once."""
    return df.withColumn(out, F.array_distinct(tokens(F.col(text))))


def rerank(hits: DataFrame, k: int = 10, candidates: int = 100, scorer: Callable[[Column, Column], Column] = jaccard, query: str = "query", content: str = "content", score: str = "score") -> DataFrame:
    """The first `candidates` rows of each query by rank, scored as (query, content) pairs; the k best, with how far each moved.

    `scorer` is a function of two columns, a pandas UDF for instance.
    """
    own = hits.filter(F.col("rank") <= candidates).withColumn("rerank_score", scorer(F.col(query), F.col(content)).cast("double"))
    out = topk(own.withColumnsRenamed({"rank": "original_rank", score: "original_score"}), "query_id", [F.round("rerank_score", 9).desc(), F.col("original_rank")], k, "new_rank")
    return out.withColumn("rank_change", F.col("original_rank") - F.col("new_rank"))


def keep_order(hits: DataFrame, k: int = 10, score: str = "score") -> DataFrame:
    """No rerank: score 1 - 0.01 i by place."""
    out = hits.filter(F.col("rank") <= k).withColumnsRenamed({"rank": "original_rank", score: "original_score"})
    return out.withColumns({"rerank_score": 1.0 - 0.01 * (F.col("original_rank") - 1), "new_rank": F.col("original_rank"), "rank_change": F.lit(0).cast("long")})


def combined_candidates(vector_hits: DataFrame, bm25_hits: DataFrame) -> DataFrame:
    """Vector hits in order, then the BM25 hits that aren't among them."""
    both = vector_hits.select("query_id", "chunk_id", "score", "rank", F.lit(0).alias("_side")).unionByName(bm25_hits.select("query_id", "chunk_id", "score", "rank", F.lit(1).alias("_side")))
    one = topk(both, ["query_id", "chunk_id"], [F.col("_side")], 1, "_r")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("_side", "rank")).cast("long")
    return one.select("query_id", "chunk_id", "score", F.when(F.col("_side") == 0, "vector").otherwise("bm25").alias("source"), order.alias("rank"))


def average_change(reranked: DataFrame) -> DataFrame:
    return reranked.groupBy("query_id").agg(F.avg(F.abs("rank_change")).alias("avg_rank_change"), F.count("*").alias("n"))
