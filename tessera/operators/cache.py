"""Embedding cache and semantic response cache as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import merge
from .rerank import jaccard
from .vectors import top_k, within

EMBEDDING_TTL, EMBEDDING_CAPACITY = 86400, 50_000
RESPONSE_TTL, RESPONSE_CAPACITY, THRESHOLD, PAIR_THRESHOLD = 3600, 10_000, 0.92, 0.7


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def cache_key(content: Column, model: Column) -> Column:
    return F.substring(F.sha2(F.concat(model, F.lit(":"), content), 256), 1, 32)


def generator_key(content: Column, model: Column) -> Column:
    return F.concat(F.substring(model, 1, 8), F.lit(":"), content_hash(content))


def query_hash(c: Column) -> Column:
    return content_hash(F.lower(F.trim(c)))


# --- embedding cache: (cache_key, content_hash, model_id, embedding, created_at)


def lookup(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (content, model_id) with the cached embedding, null for a miss; only an entry of the same model counts."""
    entry = cache.select("cache_key", F.col("model_id").alias("_m"), "embedding")
    own = wanted.withColumn("cache_key", cache_key(F.col("content"), F.col("model_id")))
    out = own.join(entry, "cache_key", "left")
    return out.withColumn("embedding", F.when(F.col("_m") == F.col("model_id"), F.col("embedding"))).drop("_m")


def misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    own = wanted.withColumn("cache_key", cache_key(F.col("content"), F.col("model_id")))
    return own.join(cache.select("cache_key", "model_id"), ["cache_key", "model_id"], "left_anti")


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (content, model_id, embedding, created_at) in; an existing key is overwritten."""
    own = entries.withColumns({"cache_key": cache_key(F.col("content"), F.col("model_id")), "content_hash": content_hash(F.col("content"))})
    return merge(cache, own.select(*cache.columns), "cache_key", F.col("created_at"))


def live(cache: DataFrame, now: Column, ttl: int, capacity: int | None = None, key: str = "cache_key") -> DataFrame:
    """Rows younger than `ttl` seconds; of these the newest `capacity`."""
    out = cache.filter(F.unix_timestamp(now) - F.unix_timestamp("created_at") < ttl)
    return out if capacity is None else out.orderBy(F.col("created_at").desc(), key).limit(capacity)


def invalidate(cache: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without the given (content, model_id) pairs."""
    return cache.join(pairs.select(cache_key(F.col("content"), F.col("model_id")).alias("cache_key")), "cache_key", "left_anti")


def stats(looked_up: DataFrame, cache: DataFrame) -> DataFrame:
    out = looked_up.agg(F.count_if(F.col("embedding").isNotNull()).alias("hits"), F.count_if(F.col("embedding").isNull()).alias("misses"))
    out = out.withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0))
    return out.crossJoin(cache.agg(F.count("*").alias("size")))


# --- response cache: (query_hash, query, response, embedding, created_at)


def exact_hits(queries: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, query_hash, response): queries whose hash is cached with a response that isn't blank."""
    own = queries.select("query_id", query_hash(F.col(text)).alias("query_hash"))
    return own.join(cache.filter(F.trim("response") != "").select("query_hash", "response"), "query_hash")


def nearest(queries: DataFrame, cache: DataFrame, least: float | None = None) -> DataFrame:
    """(query_id, query_hash, similarity): the cached query nearest to each by cosine; with `least` only where it reaches that, by a threshold join of both tables."""
    asked, held = queries.select("query_id", "embedding"), cache.filter(F.trim("response") != "").select(F.col("query_hash").alias("id"), "embedding")
    found = top_k(asked, held, 1) if least is None else within(asked, held, least)
    return found.select("query_id", F.col("id").alias("query_hash"), F.col("score").alias("similarity"))


def semantic_hits(queries: DataFrame, cache: DataFrame, exact: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of the queries without an exact hit those whose nearest cached query reaches the threshold."""
    return nearest(queries.join(exact.select("query_id"), "query_id", "left_anti"), cache, threshold)


def validated(hits: DataFrame, queries: DataFrame, cache: DataFrame, scorer=jaccard, threshold: float = PAIR_THRESHOLD, text: str = "text") -> DataFrame:
    """Hits whose pair (query, cached query) scores at least `threshold`; a null score keeps the hit."""
    pairs = hits.join(queries.select("query_id", F.col(text).alias("_q")), "query_id").join(cache.select("query_hash", F.col("query").alias("_c")), "query_hash")
    return pairs.filter(F.coalesce(scorer(F.col("_q"), F.col("_c")) >= threshold, F.lit(True))).drop("_q", "_c")


def respond(queries: DataFrame, cache: DataFrame, threshold: float = THRESHOLD, validate: bool = False, scorer=jaccard, text: str = "text") -> DataFrame:
    """(query_id, hit, layer, similarity, response) of every query: the exact layer, then the semantic one, validated if asked for."""
    exact = exact_hits(queries, cache, text)
    near = semantic_hits(queries, cache, exact, threshold)
    near = validated(near, queries, cache, scorer, text=text) if validate else near
    near = near.join(cache.select("query_hash", "response"), "query_hash")
    found = exact.select("query_id", F.lit("exact").alias("layer"), F.lit(1.0).alias("similarity"), "response")
    found = found.unionByName(near.select("query_id", F.lit("semantic").alias("layer"), "similarity", "response"))
    out = queries.select("query_id").join(found, "query_id", "left")
    return out.select("query_id", F.col("layer").isNotNull().alias("hit"), F.coalesce("layer", F.lit("miss")).alias("layer"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "response")


def put_responses(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (query, response, embedding, created_at) in; blank responses are skipped, equal hashes replaced."""
    own = entries.filter(F.trim("response") != "").withColumn("query_hash", query_hash(F.col("query")))
    return merge(cache, own.select(*cache.columns), "query_hash", F.col("created_at"))


def response_stats(responses: DataFrame, cache: DataFrame) -> DataFrame:
    out = responses.agg(F.count_if(F.col("layer") == "exact").alias("exact_hits"), F.count_if(F.col("layer") == "semantic").alias("semantic_hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"))
    return out.crossJoin(cache.agg(F.count("*").alias("size")))


def threshold_sweep(queries: DataFrame, cache: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Share of the queries whose nearest cached query reaches each threshold, clamped to 0.8..0.99."""
    own = thresholds.select(F.greatest(F.lit(0.8), F.least(F.lit(0.99), F.col("threshold"))).alias("threshold")).distinct()
    hits = nearest(queries, cache, 0.8).join(F.broadcast(own), F.round("similarity", 9) >= F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("hits"))
    out = own.join(hits, "threshold", "left").crossJoin(queries.agg(F.count("*").alias("lookups")))
    return out.select("threshold", F.coalesce("hits", F.lit(0)).alias("hits"), "lookups", (F.coalesce("hits", F.lit(0)) / F.col("lookups")).alias("hit_rate"))
