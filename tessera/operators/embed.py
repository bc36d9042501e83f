"""Embedding of text columns, with a cache and accounting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bm25, cache

Embedder = Callable[[DataFrame], DataFrame]


def hashing_embedder(dims: int = 64, tokenizer=bm25.tokens) -> Embedder:
    """(content) -> (content, embedding): hashed term counts of unit length; deterministic. A text without a term has a zero vector."""

    def run(df: DataFrame) -> DataFrame:
        own = df.select("content", tokenizer(F.col("content")).alias("_t"))
        counted = HashingTF(numFeatures=dims, inputCol="_t", outputCol="_v").transform(own)
        unit = Normalizer(inputCol="_v", outputCol="_u").transform(counted)
        return unit.select("content", vector_to_array("_u", "float32").alias("embedding"))

    return run


def embed(df: DataFrame, embedder: Embedder, content: str = "content", model_id: str = "hashing", stored: DataFrame | None = None, now: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(df with embedding and `from_cache`, the cache with the new entries). Distinct texts alone are embedded, and of these only those the cache lacks."""
    texts = df.select(F.col(content).alias("content"), _key(content).alias("_key")).filter("content IS NOT NULL").dropDuplicates(["_key"])
    texts = texts.select("content", F.lit(model_id).alias("model_id"))
    own = df.withColumn("_key", _key(content))
    if stored is None:
        made = embedder(texts.select("content")).select(_key("content").alias("_key"), "embedding")
        return own.join(made, "_key", "left").drop("_key").withColumn("from_cache", F.lit(False)), None
    made = embedder(cache.misses(texts, stored).select("content"))
    found = cache.lookup(texts, stored).filter("embedding IS NOT NULL").select("content", "embedding", F.lit(True).alias("from_cache"))
    both = found.unionByName(made.select("content", "embedding", F.lit(False).alias("from_cache")))
    entries = made.withColumns({"model_id": F.lit(model_id), "created_at": now if now is not None else F.current_timestamp()})
    both = both.select(_key("content").alias("_key"), "embedding", "from_cache")
    return own.join(both, "_key", "left").drop("_key"), cache.put(stored, entries)


def _key(content: str) -> Column:
    """Texts meet by hash, so that no text is a key of a shuffle."""
    return F.sha2(content, 256)


def counts(embedded: DataFrame) -> DataFrame:
    return embedded.agg(F.count_if("from_cache").alias("cached"), F.count_if(~F.col("from_cache")).alias("generated"))


def batches(missing: DataFrame, order: str, size: int = 100, by: str | None = None) -> DataFrame:
    """Adds batch, `size` rows each, in order within each value of `by`; without `by` within buckets of the order's hash, so that no task gets all rows."""
    part = F.col(by) if by else F.pmod(F.xxhash64(order), F.lit(8))
    place = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    return missing.withColumn("batch", F.floor(place / size))


def cost_estimate(texts: DataFrame, models: DataFrame, content: str = "content") -> DataFrame:
    """(model_id, total_tokens, cost) for embedding all texts with each model of (model_id, price_per_million)."""
    total = texts.agg(F.coalesce(F.sum(F.size(F.regexp_extract_all(F.col(content), F.lit(r"\S+"), F.lit(0)))), F.lit(0)).cast("long").alias("total_tokens"))
    return models.crossJoin(F.broadcast(total)).select("model_id", "total_tokens", (F.col("total_tokens") / 1_000_000 * F.col("price_per_million")).alias("cost"))


def model_mismatches(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(model_id, indexed, asked): models that only one side uses; an empty result means the sides agree."""
    a = index.groupBy("model_id").agg(F.count("*").alias("indexed"))
    b = asked.groupBy("model_id").agg(F.count("*").alias("asked"))
    out = a.join(b, "model_id", "full_outer").filter("indexed IS NULL OR asked IS NULL")
    return out.select("model_id", F.coalesce("indexed", F.lit(0)).alias("indexed"), F.coalesce("asked", F.lit(0)).alias("asked"))


def check_models(index: DataFrame, asked: DataFrame) -> None:
    if not (bad := model_mismatches(index, asked)).isEmpty():
        raise ValueError(f"index and queries use different models: {sorted(r[0] for r in bad.select('model_id').limit(10).collect())}")


def model_fit(chunks: DataFrame, models: DataFrame) -> DataFrame:
    """(model_id, too_long, recommended_batch): chunks over the model's limit, and min(100000 // max(avg tokens, 100), max_batch). models: (model_id, max_tokens, max_batch)."""
    sized = chunks.select("token_count").crossJoin(F.broadcast(models))
    out = sized.groupBy("model_id", "max_tokens", "max_batch").agg(F.count_if(F.col("token_count") > F.col("max_tokens")).alias("too_long"), F.floor(F.avg("token_count")).alias("_a"))
    batch = F.least(F.floor(F.lit(100_000) / F.greatest(F.col("_a"), F.lit(100))), F.col("max_batch")).cast("long")
    return out.select("model_id", "too_long", batch.alias("recommended_batch"))
