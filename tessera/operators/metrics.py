"""Query-log analytics and rate limits."""

from __future__ import annotations

from collections import deque
from math import floor

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: upper bounds of the histograms
BUCKETS = {
    "request": [0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0],
    "retrieval": [0.01, 0.02, 0.05, 0.1, 0.2, 0.5],
    "generation": [0.1, 0.5, 1.0, 2.0, 5.0, 10.0],
    "results": [0, 1, 5, 10, 20, 50, 100],
}


def request_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("endpoint", "status").agg(F.count("*").alias("requests"))


def histogram(logs: DataFrame, label: str, value: str, bounds: list[float]) -> DataFrame:
    """(label, le, bucket_count, total_count, total_sum): cumulative buckets, the last one infinite, in one pass over the log."""
    counted = logs.groupBy(label).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(value).alias("total_count"), F.sum(value).alias("total_sum"))
    cells = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("total_count").alias("n")))
    return counted.select(label, F.explode(cells).alias("c"), "total_count", "total_sum").select(label, "c.le", F.col("c.n").alias("bucket_count"), "total_count", "total_sum")


def quantiles(logs: DataFrame, label: str, value: str, exact: bool = True) -> DataFrame:
    """Exact percentiles hold each distinct value of a label in one task: for labels with a bounded number of them. Others take sketches."""
    q = F.percentile(value, [0.5, 0.99]) if exact else F.percentile_approx(value, [0.5, 0.99], 10_000)
    return logs.groupBy(label).agg(q.alias("q")).select(label, F.col("q")[0].alias("p50"), F.col("q")[1].alias("p99"))


def quantile_sketches(logs: DataFrame, label: str, value: str, ts: str = "ts", width: str = "1 hour", k: int = 400) -> DataFrame:
    """(label, start, sketch): a KLL sketch of the values of each label and window, of bounded size whatever the rows; `k` sets its rank error, about 0.8 % at 400."""
    own = logs.groupBy(label, F.window(ts, width).alias("_w")).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))
    return own.select(label, F.col("_w.start").alias("start"), "sketch")


def merged_sketches(sketches: DataFrame, label: str, width: str | None = None) -> DataFrame:
    """Sketches of finer windows as those of `width`, or of all time."""
    by = [label, F.window("start", width)["start"].alias("start")] if width else [label]
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, label: str) -> DataFrame:
    q = lambda x: F.kll_sketch_get_quantile_double("sketch", F.lit(x))
    return sketches.select(*(c for c in sketches.columns if c != "sketch"), q(0.5).alias("p50"), q(0.99).alias("p99"))


def token_usage(logs: DataFrame) -> DataFrame:
    long = logs.select("model", F.stack(F.lit(2), F.lit("prompt"), F.col("prompt_tokens"), F.lit("completion"), F.col("completion_tokens")).alias("type", "tokens"))
    return long.groupBy("model", "type").agg(F.sum("tokens").alias("tokens"))


def cache_hit_rates(lookups: DataFrame) -> DataFrame:
    return lookups.groupBy("cache_type").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def routing_distribution(logs: DataFrame) -> DataFrame:
    own = logs.groupBy("route").agg(F.count("*").alias("queries"))
    return own.withColumn("share", F.col("queries") / F.sum("queries").over(Window.partitionBy(F.lit(1))))


def cost_by_model(logs: DataFrame) -> DataFrame:
    return logs.groupBy("model").agg(F.sum("cost").alias("cost"))


def assemble_logs(events: DataFrame) -> DataFrame:
    """One row a query of (query_id, ts, kind, payload): start, retrieval, generation, cache_hit and error events folded together, the last of each kind."""
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("payload")), F.when(F.col("kind") == kind, F.col("ts")))
    return events.groupBy("query_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count("*").alias("events"),
        *(last(k).alias(k) for k in ("start", "retrieval", "generation", "cache_hit", "error")),
    )


def rate_limit(requests: DataFrame, most: int = 100, window: int = 60) -> DataFrame:
    """(client, ts, request_id, allowed, retry_after) of (client, ts in seconds, request_id): a request is allowed if fewer than `most` allowed ones are less
    than `window` seconds old; refused ones don't count.

    A client's requests stand sorted in one partition and pass with the last `most` allowed times at the most as state, so any number of them takes bounded memory.
    """
    client = requests.schema["client"].dataType

    def run(batches):
        at, kept, known = None, deque(), False
        for batch in batches:
            allowed, after = [], []
            for who, ts in zip(batch.column("client").to_pylist(), batch.column("ts").to_pylist(), strict=True):
                if not known or who != at:
                    at, kept, known = who, deque(), True
                while kept and kept[0] <= ts - window:
                    kept.popleft()
                allowed.append(len(kept) < most)
                after.append(0 if allowed[-1] else max(0, floor(window - (ts - kept[0]))))
                if allowed[-1]:
                    kept.append(ts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_()), pa.array(after, pa.int64())], [*batch.schema.names, "allowed", "retry_after"])

    own = requests.select("client", F.col("ts").cast("double").alias("ts"), F.col("request_id").cast("long").alias("request_id"))
    ordered = own.repartition("client").sortWithinPartitions("client", "ts", "request_id")
    return ordered.mapInArrow(run, f"client {client.simpleString()}, ts double, request_id long, allowed boolean, retry_after long")


def sliding_counts(requests: DataFrame, window: int = 60) -> DataFrame:
    """Adds the client's requests, this one included, of the last `window` seconds: an upper bound of what the limiter counts."""
    w = Window.partitionBy("client").orderBy(F.col("ts")).rangeBetween(-(window - 1), 0)
    return requests.withColumn("in_window", F.count("*").over(w))

