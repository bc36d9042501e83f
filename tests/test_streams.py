import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import delta, embed, memory
from tessera.plans import pipelines
from tessera.streaming import streams as S


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def source(spark, df, path, files=1):
    df.repartition(files).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_rate_limiter_equals_batch(spark, tmp_path):
    from tessera.operators import metrics

    rows = [(i % 2, 1e6 + i * 7 % 300, i) for i in range(100)]
    df = spark.createDataFrame(rows, "client long, ts double, request_id long")
    run(S.rate_limiter(source(spark, df, str(tmp_path / "r")), 4, 60), "limited")
    got = {r.request_id: r.allowed for r in spark.table("limited").collect()}
    assert got == {r.request_id: r.allowed for r in metrics.rate_limit(df, 4, 60).collect()}


def test_history_equals_batch(spark, tmp_path):
    rows = [(c, t, "user", f"{c}-{t} " + "z" * 300) for c in (1, 2) for t in range(6)]
    df = spark.createDataFrame(rows, "conversation_id long, turn long, role string, content string")
    run(S.conversation_history(source(spark, df, str(tmp_path / "m")), idle_ms=None), "histories")
    got = {r.conversation_id: json.loads(r.history) for r in spark.table("histories").filter("turn = 5").collect()}
    want: dict = {}
    for r in memory.compressed(df).orderBy("conversation_id", "position").collect():
        want.setdefault(r.conversation_id, []).append({"role": r.role, "content": r.content})
    assert got == want


def test_limiter_forgets_idle_clients(spark, tmp_path):
    """Batches far apart in time: state rows fall once the watermark has passed, and decisions are those of the batch form."""
    from tessera.operators import metrics

    path, rows = str(tmp_path / "idle"), []
    for k in range(4):
        some = [(c, 1e6 + 1000.0 * k + i, 1000 * k + 10 * c + i) for c in range(5 if k < 2 else 1) for i in range(4)]
        spark.createDataFrame(some, "client long, ts double, request_id long").coalesce(1).write.mode("append").parquet(path)
        rows += some
    stream = spark.readStream.schema("client long, ts double, request_id long").option("maxFilesPerTrigger", 1).parquet(path)
    q = run(S.rate_limiter(stream, 3, 60), "idle")
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(held) == 5 and held[-1] <= 1
    got = {r.request_id: r.allowed for r in spark.table("idle").collect()}
    assert got == {r.request_id: r.allowed for r in metrics.rate_limit(spark.createDataFrame(rows, "client long, ts double, request_id long"), 3, 60).collect()}


def test_windows_and_duplicates(spark, tmp_path):
    rows = [(i, "a" if i % 2 else "b", i % 3, 0.1 * (i % 7), f"Q{i % 4} ") for i in range(200)]
    df = spark.createDataFrame(rows, "s long, endpoint string, client long, latency double, text string").withColumn("ts", F.timestamp_seconds("s"))
    stream = source(spark, df, str(tmp_path / "e"))
    run(S.live_metrics(stream, width="10 seconds", late="5 seconds"), "live", "complete")
    assert spark.table("live").agg(F.sum("requests")).first()[0] == 200
    run(S.sliding_requests(stream), "sliding", "complete")
    assert spark.table("sliding").agg(F.sum("requests")).first()[0] == 200 * 6
    run(S.new_queries(stream), "fresh")
    assert spark.table("fresh").count() == 4
    events = df.select(F.floor(F.col("s") / 5).alias("query_id"), "ts", F.element_at(F.array(*map(F.lit, ["start", "retrieval", "generation", "cache_hit", "error"])), (F.col("s") % 5 + 1).cast("int")).alias("kind"), F.col("text").alias("payload"))
    run(S.assembled_logs(source(spark, events, str(tmp_path / "q"))), "logs", "complete")
    assert spark.table("logs").count() == 40 and spark.table("logs").filter("start IS NULL").count() == 0


def test_ingest_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "some text that is long enough", "a.txt"), (2, "x", "b.txt")], "document_id long, text string, source_file string")
    path = str(tmp_path / "index")
    q = S.ingest_stream(source(spark, df, str(tmp_path / "d")), path, embed.hashing_embedder(8), str(tmp_path / "ck"))
    q.awaitTermination(120)
    table = S.index_table(spark, path)
    rows = delta.read(table)
    assert rows.count() == 1
    S.upserts(table)(rows, 7)
    S.upserts(table)(rows, 7)
    assert delta.read(table).count() == 1


def test_delta_table(spark, tmp_path):
    """A batch writes in proportion to itself, a rerun changes nothing, deletes hold, and folding leaves the rows as they were."""
    t = delta.Table(spark, f"{tmp_path}/t", "id", 4)
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "t").rglob("*.parquet"))
    frame = lambda rows: spark.createDataFrame(rows, "id long, value string, at long")
    rng = random.Random(1)
    want = {}

    def batch(number, rows, deleted=None):
        delta.put(t, frame(rows), number, "at", F.col("value") == "gone" if deleted else None)

    first = [(i, "".join(rng.choices("abcdef", k=40)), 0) for i in range(4000)]
    batch(0, first)
    want |= {i: v for i, v, _ in first}
    assert delta.fold(t) and {r.id: r.value for r in delta.read(t).collect()} == want
    base = size()
    second = [(i, f"new{i}", 1) for i in range(3990, 4010)] + [(5, "older", 1), (5, "newest", 2), (6, "gone", 1)]
    for _ in range(2):
        batch(1, second, True)
    assert size() - base < base / 10
    want |= {i: f"new{i}" for i in range(3990, 4010)} | {5: "newest"}
    want.pop(6)
    got = lambda: {r.id: r.value for r in delta.read(t).collect()}
    assert got() == want and not delta.fold(t)
    batch(2, [(6, "back", 3), (5, "gone", 3)], True)
    want |= {6: "back"}
    want.pop(5)
    assert got() == want
    assert {r.id: r.value for r in delta.read(t, [6, 7, 5]).collect()} == {6: "back", 7: want[7]}
    assert "PartitionFilters: [_bucket" in delta.read(t, [7])._jdf.queryExecution().toString() or "_bucket" in delta.read(t, [7])._jdf.queryExecution().toString()
    assert delta.fold(t, 0.001) and got() == want
    batch(1, [(1, "late rerun", 9)])
    assert got() == want
    with pytest.raises(ValueError):
        delta.read(delta.Table(spark, f"{tmp_path}/none", "id"))


def test_adaptive_batches(spark, tmp_path):
    each = S.adaptive_routing(str(tmp_path / "a"))
    for n in range(2):
        each(spark.createDataFrame([("simple", 0.85, 0.9)] * 10, "category string, confidence double, complexity double"), n)
    cuts = spark.read.parquet(str(tmp_path / "a/cuts/v=1")).first()
    assert (round(cuts.t1, 2), round(cuts.t2, 2), cuts.n) == (0.46, 0.81, 20)


def test_late_rows_are_dropped(spark, tmp_path):
    """Three batches: the last has a row of a window that the watermark had passed a batch before, which isn't counted."""
    path = str(tmp_path / "late")
    for rows in ([(s, "a", 0.1) for s in range(0, 3000, 100)], [(3001, "a", 0.1)], [(10, "a", 0.1), (9000, "a", 0.1)]):
        spark.createDataFrame(rows, "s long, endpoint string, latency double").select(F.timestamp_seconds("s").alias("ts"), "endpoint", "latency").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("ts timestamp, endpoint string, latency double").option("maxFilesPerTrigger", 1).parquet(path)
    run(S.live_metrics(stream), "late_rows")
    got = {r.start.timestamp(): r.requests for r in spark.sql("SELECT * FROM late_rows").collect()}
    assert got == {300.0 * k: 3 for k in range(10)} | {3000.0: 1}


def test_first_batch_is_written_once(spark, tmp_path):
    """Folding the first batch enters it as the base, without its deleted rows; a batch is shuffled once, and chunks carry their document's columns along."""
    t = delta.Table(spark, f"{tmp_path}/t", "id", 4)
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "t").rglob("*.parquet") if "log" not in p.parts)
    delta.put(t, spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("value")), 0, deleted=F.col("id") % 3 == 0)
    before = size()
    assert delta.fold(t) and not delta.fold(t) and size() == before
    assert delta.read(t).count() == 2000 and "Window" not in delta.read(t)._jdf.queryExecution().toString()
    delta.put(t, spark.range(1000).select("id", F.lit("new").alias("value")), 1)
    assert delta.fold(t) and delta.read(t).count() == 2334 and delta.read(t).filter("value = 'new'").count() == 1000
    last = delta._last(t, spark.range(100).withColumn("value", F.lit("x")), F.lit(0))._jdf.queryExecution().executedPlan().toString()
    assert last.count("Exchange") == 1
    docs = spark.createDataFrame([(1, "some text that is long enough", "a.txt"), (None, "a text that has no id at all", "b.txt")], "document_id long, text string, source_file string")
    _, rows = pipelines.ingest(docs, embed.hashing_embedder(8))
    assert sorted(r[0] for r in rows.select(F.col("metadata")["source_file"]).collect()) == ["a.txt", "b.txt"]
