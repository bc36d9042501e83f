"""Queries of the streaming forms, run over the whole tables as streams that end, of the sinks and of what users plug in."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.operators import bm25 as B
from tessera.operators import chunk as C
from tessera.operators import classify as L
from tessera.operators import context as X
from tessera.operators import delta as A
from tessera.operators import embed as M
from tessera.operators import evaluate as E
from tessera.operators import metrics as S
from tessera.operators import rerank as K
from tessera.operators.common import cut, shared_dir
from tessera.sources import documents as D
from tessera.streaming import streams as T

from . import frames as Z
from .service_queries import ADAPT, LIMITER, _classified
from .text_queries import ingested_chunks_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def put(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


def folder(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def stream(spark, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    # a pattern, as a streaming source takes no path of one file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def finished(out: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has given when all that there is has gone through it; `complete` results replace those of the batch before."""
    path = folder(out.sparkSession)
    write = out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-state")
    if mode == "append":
        query = write.format("parquet").option("path", path).start()
    else:
        query = write.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)


def _events(s, d):
    return Z.events_of(stream(s, d, "events"))


_LE = ", ".join(f"count(*) FILTER (latency <= {b}::DOUBLE) AS le_{i}" for i, b in enumerate(S.BUCKETS["request"]))
put("str_01_live_metrics", lambda s, d: finished(T.live_metrics(_events(s, d))).withColumn("total", F.round("total", 6)),
    Z.sql("ev", f"SELECT time_bucket(INTERVAL 5 minutes, ts::TIMESTAMP) AS start, endpoint, count(*) AS requests, round(sum(latency), 6) AS total, {_LE} FROM ev GROUP BY 1, 2 HAVING start + INTERVAL 5 minutes <= (SELECT date_trunc('millisecond', max(ts::TIMESTAMP)) FROM ev) - INTERVAL 10 minutes"))
put("str_02_sliding", lambda s, d: finished(T.sliding_requests(_events(s, d)), "complete"),
    Z.sql("ev", "SELECT time_bucket(INTERVAL 10 seconds, ts::TIMESTAMP) - to_seconds(10 * j) AS start, client, count(*) AS requests FROM ev, range(6) r(j) GROUP BY 1, 2"))


def _requests(s, d):
    return _events(s, d).select("client", F.floor(F.unix_timestamp("ts")).cast("double").alias("ts"), F.col("event_id").alias("request_id"))


put("str_03_rate_limiter", lambda s, d: finished(T.rate_limiter(_requests(s, d), most=3, window=172800)), f"WITH {LIMITER} SELECT client, ts, request_id, allowed FROM st WHERE n > 0")


def _str_04(s, d):
    """The index that a stream of documents leaves, as ids and lengths."""
    docs = stream(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text", F.lit("f.txt").alias("source_file"))
    path = folder(s)
    T.ingest_stream(docs, path, M.hashing_embedder(), f"{path}-state").awaitTermination()
    found = A.read(T.index_table(s, path)).select("id", F.col("metadata")["document_id"].cast("long").alias("document_id"), F.col("metadata")["chunk_index"].cast("long").alias("chunk_index"), F.length(F.col("metadata")["content"]).cast("long").alias("chars"), F.size("embedding").cast("long").alias("dims"))
    return found


put("str_04_ingest", _str_04, f"SELECT chunk_id AS id, document_id, chunk_index, length(content) AS chars, 64::BIGINT AS dims FROM ({ingested_chunks_sql()})")


def _asked(s, d):
    own = stream(s, d, "conversations").filter("role = 'user'")
    return own.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))


put("str_05_new_queries", lambda s, d: finished(T.new_queries(_asked(s, d))).select("query_hash"), "SELECT DISTINCT substr(sha256(lower(trim(text, ' '))), 1, 16) AS query_hash FROM conversations WHERE role = 'user'")


def _str_06(s, d):
    own = stream(s, d, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content"))
    return finished(T.conversation_history(own, idle_ms=None)).select("conversation_id", "turn", F.expr("size(from_json(history, 'array<struct<role: string, content: string>>'))").cast("long").alias("messages"), F.expr("element_at(from_json(history, 'array<struct<role: string, content: string>>'), -1).content").alias("latest"))


put("str_06_history", _str_06, "SELECT conv_id AS conversation_id, turn, CASE WHEN n > 3 THEN 4 ELSE n END AS messages, text AS latest FROM (SELECT *, count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)")


def _str_07(s, d):
    """Queries come in eight batches, by conversation; each is routed by the cuts that the one before left. The cuts after each batch and what has gone to the tiers so far."""
    path, source = folder(s), folder(s)
    rows = cut(_classified(s, d).select("query_id", "category", "confidence", "complexity", (F.floor(F.col("query_id") / 1000) % 8).alias("batch")))
    for b in range(8):  # a stream takes files by their time
        rows.filter(F.col("batch") == b).coalesce(1).write.mode("append").parquet(source)
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(T.adaptive_routing(path)).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{path}/cuts").select(F.col("v").cast("long").alias("batch"), F.round("t1", 6).alias("t1"), F.round("t2", 6).alias("t2"), "n", "n1", "n3")


_REPLAY = ADAPT.replace("(row_number() OVER (ORDER BY query_id) - 1) // 20 AS block", "query_id // 1000 % 8 AS block").replace("m < 20", "m < 1")
put("str_07_adaptive", _str_07, f"WITH {_REPLAY} SELECT block - 1 AS batch, round(t1, 6) AS t1, round(t2, 6) AS t2, n, n1, n3 FROM st WHERE block > 0")


def _query_events(events):
    kind = F.element_at(F.array(*map(F.lit, ["start", "retrieval", "generation", "cache_hit", "error"])), (F.col("event_id") % 5 + 1).cast("int"))
    return events.select(F.floor(F.col("event_id") / 5).alias("query_id"), F.timestamp_seconds(F.floor(F.col("event_id") / 5) * 600 + F.col("event_id") % 5).alias("ts"), kind.alias("kind"), F.col("k").cast("string").alias("payload"))


put("str_08_logs", lambda s, d: finished(T.assembled_logs(_query_events(_events(s, d))), "complete"),
    Z.sql("ev", "SELECT event_id // 5 AS query_id, count(*) AS events, " + ", ".join(f"max(k::VARCHAR) FILTER (event_id % 5 = {i}) AS {n}" for i, n in enumerate(["start", "retrieval", "generation", "cache_hit", "error"])) + " FROM ev GROUP BY 1"))


# --- what users plug in: a tokenizer, an embedder, a pair scorer, templates, word lists


def _letters(c: Column) -> Column:
    """A tokenizer of runs of lower-case letters."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


put("udf_01_tokenizer", lambda s, d: B.postings(Z.chunks(s, d), tokenizer=_letters), "SELECT term, doc_id AS chunk_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY ALL")


def _lengths(df: DataFrame) -> DataFrame:
    """An embedder of two numbers, characters and words, that gets Arrow batches; its pattern, as a model would be, is loaded once for a task."""

    def run(batches):
        words = re.compile(r"\S+", re.ASCII)
        for batch in batches:
            texts = batch.column("content").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([[float(len(t)), float(len(words.findall(t)))] for t in texts], pa.list_(pa.float32()))], ["content", "embedding"])

    return df.select("content").mapInArrow(run, "content string, embedding array<float>")


put("udf_02_embedder", lambda s, d: M.embed(Z.chunks(s, d), _lengths)[0].select("chunk_id", F.get("embedding", 0).cast("long").alias("chars"), F.get("embedding", 1).cast("long").alias("words")),
    r"SELECT doc_id AS chunk_id, length(text) AS chars, len(regexp_extract_all(text, '\S+'))::BIGINT AS words FROM documents")


@F.pandas_udf(DoubleType())
def _far(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A pair scorer over batches of pairs; what it needs is loaded once, before the first."""
    number = np.int64
    for a, b in pairs:
        yield -(a.astype(number) - b.astype(number)).abs().astype(float)


def _udf_03(s, d):
    hits = Z.vector_hits(s, d, 20).withColumns({"query": F.col("query_id").cast("string"), "content": F.col("chunk_id").cast("string")})
    return K.rerank(hits, k=5, scorer=_far).select("query_id", "chunk_id", "rerank_score", "original_rank", "new_rank")


put("udf_03_reranker", _udf_03, Z.sql("hv", "SELECT query_id, chunk_id, -abs(query_id - chunk_id)::DOUBLE AS rerank_score, rank AS original_rank, row_number() OVER (PARTITION BY query_id ORDER BY -abs(query_id - chunk_id) DESC, rank) AS new_rank FROM hv WHERE rank <= 20 QUALIFY new_rank <= 5"))
put("udf_04_template", lambda s, d: Z.user_turns(s, d).select("query_id", X.prompt(F.col("text"), F.lit("c"), F.lit(None).cast("string"), F.lit("short"), templates={"short": "Q: $query\nA: $context"}).alias("prompt")),
    "SELECT conv_id * 1000 + turn AS query_id, 'Q: ' || text || chr(10) || 'A: c' AS prompt FROM conversations WHERE role = 'user'")


def _udf_05(s, d):
    own = L.classify(Z.user_turns(s, d), faq=[r"^the "])
    return own.select("query_id", (F.col("category") == "faq").alias("is_faq"))


put("udf_05_patterns", _udf_05, "SELECT conv_id * 1000 + turn AS query_id, regexp_matches(lower(text), '^\\s*the ') AS is_faq FROM conversations WHERE role = 'user'")


def _snk_03(s, d):
    """Judgements and their one-row header, written as JSON and read again."""
    replies = Z.table(s, d, "labels").select(F.col("doc_id").alias("sample_id"), F.concat(F.lit('{"faithfulness": '), F.col("doc_id") % 5 + 1, F.lit(', "relevance": 4, "completeness": 3, "clarity": 5}')).alias("reply"))
    rows, path = E.judged(replies), folder(s)
    D.write_results(rows, E.judge_summary(rows), path)
    head = s.read.json(f"{path}/metrics").select("samples", F.round("avg_score", 6).alias("avg_score"))
    return s.read.json(f"{path}/results").select("sample_id", F.col("faithfulness").cast("long").alias("faithfulness"), F.round("average", 6).alias("average"), "passed").crossJoin(F.broadcast(head))


put("snk_03_results", _snk_03, """WITH j AS (SELECT doc_id AS sample_id, doc_id % 5 + 1 AS faithfulness, (doc_id % 5 + 13) / 4.0::DOUBLE AS average FROM labels)
SELECT sample_id, faithfulness, round(average, 6) AS average, average >= 3.5 AS passed, (SELECT count(*) FROM j) AS samples, (SELECT round(avg(average), 6) FROM j) AS avg_score FROM j""")
