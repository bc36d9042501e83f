"""Structured Streaming forms of the live operators."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import cache as C
from tessera.operators import memory as M
from tessera.operators import delta
from tessera.operators import metrics as S
from tessera.operators import route as R
from tessera.operators.embed import Embedder
from tessera.plans.pipelines import ingest


def live_metrics(events: DataFrame, label: str = "endpoint", value: str = "latency", width: str = "5 minutes", late: str = "10 minutes", bounds: list[float] = S.BUCKETS["request"]) -> DataFrame:
    """Counts, sums and cumulative buckets of each label and tumbling window; rows later than the watermark are dropped."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", width), label)
    out = own.agg(F.count("*").alias("requests"), F.sum(value).alias("total"), *(F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)))
    return out.select(F.col("window.start").alias("start"), label, "requests", "total", *(f"le_{i}" for i in range(len(bounds))))


def sliding_requests(events: DataFrame, width: str = "60 seconds", step: str = "10 seconds", late: str = "60 seconds") -> DataFrame:
    own = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "client").agg(F.count("*").alias("requests"))
    return own.select(F.col("window.start").alias("start"), "client", "requests")


def rate_limiter(requests: DataFrame, most: int = 100, window: int = 60, late: str = "10 minutes") -> DataFrame:
    """(client, ts, request_id, allowed): the state of a client is the times of its allowed requests of the last `window` seconds, `most` at the most.

    Rows of a micro-batch are taken in order of time. Once the watermark, `late` behind the latest request, has passed a client's last request by the window,
    nothing that it did counts any more and its state is dropped. Requests older than the watermark are dropped undecided.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"])
        allowed = []
        for ts in rows["ts"]:
            while kept and kept[0] <= ts - window:
                kept.popleft()
            allowed.append(len(kept) < most)
            if allowed[-1]:
                kept.append(float(ts))
        state.update((list(kept),))
        passed = int(1000 * (float(rows["ts"].iloc[-1]) + window))
        state.setTimeoutTimestamp(max(passed, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "ts": rows["ts"], "request_id": rows["request_id"], "allowed": allowed})

    own = requests.select("client", "ts", "request_id", F.timestamp_millis((F.col("ts") * 1000).cast("long")).alias("at")).withWatermark("at", late)
    return own.groupBy("client").applyInPandasWithState(step, "client long, ts double, request_id long, allowed boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def upserts(table: delta.Table) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: a micro-batch writes its own rows to the table, and a batch that is run again writes the same; the table is folded as it grows."""

    def put(batch: DataFrame, number: int) -> None:
        delta.put(table, batch, number)
        delta.fold(table)

    return put


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots under path, by Spark's own file listing, which shows no file before its job is committed."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path")
        return sorted({int(r[0].split("/v=")[1].split("/")[0]) for r in found.collect() if "/v=" in r[0]})
    except Exception as e:  # no snapshot yet
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def latest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={max(versions(spark, path))}")


def index_table(spark: SparkSession, path: str) -> delta.Table:
    """The table of index rows (id, embedding, metadata) under path."""
    return delta.Table(spark, f"{path}/index", "id")


def ingest_stream(docs: DataFrame, path: str, embedder: Embedder, checkpoint: str, **trigger):
    """Start a stream that validates, cleans, chunks and embeds new documents (document_id, text, source_file) and upserts them into index_table(path)."""
    sink = upserts(index_table(docs.sparkSession, path))

    def each(batch: DataFrame, number: int) -> None:
        sink(ingest(batch, embedder)[1], number)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def new_queries(queries: DataFrame, ttl: str = "1 hour", text: str = "text") -> DataFrame:
    """Queries whose text, by lower case and trim, wasn't seen within the time to live."""
    return queries.withColumn("query_hash", C.query_hash(F.col(text))).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["query_hash"])


def conversation_history(messages: DataFrame, full: int = M.FULL_MESSAGES, summary_tokens: int = M.SUMMARY_TOKENS, idle_ms: int | None = 3_600_000) -> DataFrame:
    """(conversation_id, turn, history) after each message of (conversation_id, turn, role, content): compressed history as JSON.

    State holds the last `full` messages whole and the older ones cut to what a summary can show of them; idle conversations are forgotten, or with idle_ms=None
    none, as a stream that is to end needs it: while a timeout is set, Spark goes on to look for it.
    """
    longest = summary_tokens * M.CHARS_PER_TOKEN

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for turn, role, content in zip(rows["turn"], rows["role"], rows["content"], strict=True):
            held.append([role, content, len(content)])
            held = [[r, c if i >= len(held) - full else c[:longest], n] for i, (r, c, n) in enumerate(held)]
            out.append((key[0], turn, json.dumps(_history(held, full, summary_tokens))))
        state.update((json.dumps(held),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["conversation_id", "turn", "history"])

    return messages.groupBy("conversation_id").applyInPandasWithState(step, "conversation_id long, turn long, history string", "held string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def _history(held: list, full: int, summary_tokens: int) -> list[dict]:
    older, recent = held[:-full], held[-full:]
    out = []
    if older:
        most = summary_tokens // len(older) * M.CHARS_PER_TOKEN
        summary = " | ".join(f"{r}: {c[:most]}{'...' if n > most else ''}" for r, c, n in older)
        out.append({"role": "system", "content": f"Previous conversation summary: {summary}"})
    return out + [{"role": r, "content": c} for r, c, _ in recent]


def adaptive_routing(path: str, start: tuple[float, float] = (R.TIER1_MAX, R.TIER2_MAX)) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for classified queries: a batch is routed by the cuts that the one before left, then the cuts move by the shares of the tiers so far.

    `path`/cuts keeps a row for each batch, so a batch that is run again finds the same cuts.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, f"{path}/cuts") if v < number]
        t1, t2, n, n1, n3 = spark.read.parquet(f"{path}/cuts/v={max(before)}").first() if before else (*start, 0, 0, 0)
        routed = R.route(batch, t1, t2)
        routed.write.mode("overwrite").parquet(f"{path}/routed/v={number}")
        m, m1, m3 = spark.read.parquet(f"{path}/routed/v={number}").agg(F.count("*"), F.count_if(F.col("tier") == "tier_1"), F.count_if(F.col("tier") == "tier_3")).first()
        n, n1, n3 = n + m, n1 + m1, n3 + m3
        if n:
            t1 = min(0.6, t1 + R.STEP) if n1 / n < R.TARGETS[0] - 0.05 else max(0.2, t1 - R.STEP) if n1 / n > R.TARGETS[0] + 0.05 else t1
            t2 = min(0.9, t2 + R.STEP) if n3 / n > R.TARGETS[2] + 0.02 else max(t1 + 0.1, t2 - R.STEP) if n3 / n < R.TARGETS[2] - 0.02 else t2
        spark.createDataFrame([(t1, t2, n, n1, n3)], "t1 double, t2 double, n long, n1 long, n3 long").write.mode("overwrite").parquet(f"{path}/cuts/v={number}")

    return each


def assembled_logs(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row a query once its events can't come any more: (query_id, window start, events of each kind)."""
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("payload")), F.when(F.col("kind") == kind, F.col("ts"))).alias(kind)
    own = events.withWatermark("ts", late).groupBy("query_id", F.window("ts", late))
    return own.agg(F.count("*").alias("events"), *(last(k) for k in ("start", "retrieval", "generation", "cache_hit", "error"))).drop("window")
