import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.operators import bm25, bm25index, cells, expand, fusion, relevance, rerank, vectors
from tessera.operators import evaluate as E


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank long")


@pytest.fixture(scope="module")
def sides(spark):
    v = hits(spark, [(1, "c1", 0.95, 1), (1, "c2", 0.85, 2), (1, "c3", 0.75, 3)])
    b = hits(spark, [(1, "c2", 5.5, 1), (1, "c4", 4.2, 2), (1, "c5", 3.1, 3)])
    return fusion.both_sides(v, b).cache()


def test_min_max(spark):
    df = hits(spark, [(1, str(i), s, i) for i, s in enumerate([0.2, 0.5, 0.8, 1.0])] + [(2, "a", 0.3, 1), (2, "b", 0.3, 2)])
    got = df.withColumn("n", S.min_max(F.col("score"))).orderBy("query_id", "chunk_id").collect()
    assert [round(r.n, 9) for r in got] == [0, 0.375, 0.75, 1, 1, 1]


def test_fusion_numbers(spark, sides):
    one = spark.range(1).select((5.0 * F.lit(0.8) + 3.0 * F.lit(0.6) + 0.2 * F.lit(0.5)).alias("x")).first().x
    assert round(one, 9) == 5.9
    rrf = {r.chunk_id: r.combined_score for r in fusion.reciprocal_rank(sides).collect()}
    assert rrf["c2"] == pytest.approx(1 / 62 + 1 / 61) and rrf["c3"] == pytest.approx(1 / 63)
    got = {r.chunk_id: (r.combined_score, r.from_vector, r.from_bm25) for r in fusion.weighted_sum(sides).collect()}
    assert got["c2"][0] == pytest.approx(5 * 0.5 + 3) and got["c2"][1:] == (True, True) and got["c5"][0] == 0
    stats = fusion.overlap_stats(fusion.weighted_sum(sides)).first()
    assert (stats.unique_results, stats.overlap, round(stats.overlap_ratio, 3)) == (5, 1, 0.2)


def test_recency(spark):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame([("2024-03-01T00:00:00",), ("2024-01-01T00:00:00",), ("junk",), (None,)], "t string")
    got = [r[0] for r in df.select(fusion.recency(fusion.parsed_time(F.col("t")), now)).collect()]
    assert got == [1.0, 0.25, 0.0, 0.0]


def test_bm25_finds_codes(spark):
    chunks = spark.createDataFrame([("c1", "reset the router"), ("c2", "code ERR-404 means not found"), ("c3", "the router is lost"), ("c4", ""), ("c5", "sku_12 is sold out")], "chunk_id string, content string")
    asked = spark.createDataFrame([(1, "what is err-404"), (2, "zzz")], "query_id long, text string")
    got = bm25.search(asked, chunks).collect()
    assert [r.chunk_id for r in got if r["rank"] == 1] == ["c2"] and {r.query_id for r in got} == {1}
    plus = bm25.search(asked, chunks, variant="plus").collect()
    assert [r.chunk_id for r in plus if r["rank"] == 1] == ["c2"]


def test_vector_top_k(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "id long, embedding array<float>").repartition(5)
    asked = table.filter("id < 30").withColumnRenamed("id", "query_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: np.argsort(-(unit @ unit[i]))[:5].tolist() for i in range(30)}
    for block in (4096, 7):
        got: dict = {}
        for r in vectors.top_k(asked, table, 5, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
    plan = vectors.top_k(asked, table, 5, block=7)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "LocalTableScan" not in plan


def test_stored_index(spark, tmp_path):
    """Clustered vectors: few cells are probed, their codes alone are read, and the short list is rescored exactly."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    x = centres[np.arange(3000) % 40] + rng.normal(size=(3000, 24)) * 0.4
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9999, None)], "id long, embedding array<float>").repartition(5)
    asked = table.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = cells.build(table, f"file://{tmp_path}/index")
    again = cells.opened(spark, index.path)
    assert len(index.centres) == 55 and again.probes == index.probes and np.array_equal(again.books, index.books) and index.probes <= 12
    got = cells.search(again, asked, 10)
    exact = vectors.top_k(asked, table, 10)
    assert vectors.recall(got, exact, 10).first().recall >= 0.95
    both = got.join(exact.select("query_id", "id", F.col("score").alias("s")), ["query_id", "id"]).agg(F.max(F.abs(F.col("score") - F.col("s")))).first()[0]
    assert both < 1e-12
    assert cells.short_list(index, asked, 10).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 80
    one = cells.search(index, asked.filter("query_id = 20"), 10)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    # codes of the probed cells are all that a query reads
    read = cells._pruned(index.codes(spark), cells._asked(index, asked.filter("query_id = 20"), index.probes)).count()
    assert read < 3000 / 5


def test_stored_postings(spark, tmp_path, monkeypatch):
    """The blocks give what a full scan gives, from fewer postings; a second batch writes its own bytes, and writing it again changes nothing."""
    monkeypatch.setattr(bm25index, "SEGMENT_BITS", 4)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    odds = 1 / np.arange(1, 3001)
    text = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()))
    rows = [(i, text(rng.integers(1, 60))) for i in range(1500)] + [(1500, ""), (1501, None)]
    asked = spark.createDataFrame([(q, text(4) + f" w{600 + q} w{900 + q % 50}") for q in range(40)] + [(99, "unknown"), (98, None)], "query_id long, text string")
    chunks = spark.createDataFrame(rows, "chunk_id long, content string").repartition(4)
    path = f"file://{tmp_path}/index"
    index = bm25index.add(spark, path, chunks.filter("chunk_id < 1000"))
    size = lambda: sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    first = size()
    index = bm25index.add(spark, path, chunks.filter("chunk_id >= 1000"), 1)
    second = size()
    assert second - first < first
    index = bm25index.add(spark, path, chunks.filter("chunk_id >= 1000"), 1)
    assert abs(size() - second) < 0.01 * second
    pairs = lambda df: {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in df.collect()}
    for k in (3, 50):
        assert pairs(bm25index.top_k(index, asked, k)) == pairs(bm25.search(asked, chunks, k))
    plan = bm25index.planned(index, asked, 3)
    found = bm25index.candidates(index, plan)
    read = bm25index.essential_blocks(index, plan).agg(F.sum("n")).first()[0] + bm25index.other_blocks(index, plan, found).agg(F.sum("n")).first()[0]
    every = bm25.postings(chunks).join(asked.select("query_id", F.explode(F.array_distinct(bm25.tokens(F.col("text")))).alias("term")), "term").count()
    assert read < 0.7 * every


def test_threshold_join(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x[1000:2000] = x[:1000] + rng.normal(size=(1000, 16)) * rng.uniform(0, 0.6, (1000, 1))
    x[2000:] = x[0] + rng.normal(size=(1000, 16)) * 0.05  # a third is one heap
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    table = spark.createDataFrame(rows[1000:] + [(9999, None)], "id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame(rows[:1000], "query_id long, embedding array<double>").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit[:1000] @ unit[1000:].T
    want = {i: int(np.argmax(np.round(sim[i], 9))) + 1000 for i in range(1000) if np.round(sim[i].max(), 9) >= 0.92}
    found = vectors.within(asked, table, 0.92)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    got = {r.query_id: r.id for r in found.collect()}
    assert 100 < len(want) < 1000 and got.keys() <= want.keys() and sum(got.get(q) == v for q, v in want.items()) >= 0.99 * len(want)
    low = {r.query_id: r.id for r in vectors.within(asked.filter("query_id < 20"), table, 0.1).collect()}
    assert low == {i: int(np.argmax(np.round(sim[i], 9))) + 1000 for i in range(20) if np.round(sim[i].max(), 9) >= 0.1}
    assert vectors.within(asked, table.limit(0), 0.92).count() == 0


def test_metadata_filter_and_upsert(spark):
    df = spark.createDataFrame([("a", {"n": "5", "t": "x"}), ("b", {"n": "50"}), ("c", {})], "id string, metadata map<string,string>")
    keep = lambda c: sorted(r.id for r in df.filter(vectors.matches(c)).collect())
    assert keep({"n": {"$gt": 4}}) == ["a", "b"] and keep({"n": {"$lt": 10}, "t": "x"}) == ["a"] and keep({"t": {"$in": ["x", "y"]}}) == ["a"] and keep({}) == ["a", "b", "c"]
    assert vectors.delete(df, conditions={"t": "x"}).count() == 2 and vectors.delete(df).count() == 0
    up = spark.createDataFrame([("a", {"n": "9"}), ("d", {"n": "1"})], df.schema)
    assert {r.id: r.metadata.get("n") for r in vectors.upsert(df, up).collect()} == {"a": "9", "b": "50", "c": None, "d": "1"}


def test_uuid5(spark):
    import uuid

    df = spark.createDataFrame([("chunk_1",), ("é",), ("",)], "n string")
    assert [r[0] for r in df.select(vectors.uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in ("chunk_1", "é", "")]


def test_expansion(spark):
    df = spark.createDataFrame([(1, "what is the best way to fix a problem?"), (2, "router setup")], "query_id long, text string")
    got: dict = {}
    for r in expand.all_queries(df).orderBy("query_id", "variation_no").collect():
        got.setdefault(r.query_id, []).append(r.text)
    assert got[1] == ["what is the best way to fix a problem?", "best way fix problem", "the best way to fix a problem", "Define the best way to fix a problem?"]
    assert got[2] == ["router setup", "What is router setup?"]


def test_relevance_strategies(spark):
    df = hits(spark, [(1, f"c{i}", s, i + 1) for i, s in enumerate([1.0, 0.9, 0.5, 0.1, 0.0])] + [(2, "x", 0.4, 1)])
    got = relevance.filter_hits(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, "c0"), (1, "c1"), (2, "x")]
    filled = relevance.filter_hits(df, min_chunks=4).filter("query_id = 1").orderBy("rank").collect()
    assert [(r.chunk_id, r.passed_threshold) for r in filled] == [("c0", True), ("c1", True), ("c2", False), ("c3", False)]
    assert relevance.filter_hits(df, "top_k", max_chunks=2).filter("query_id = 1").count() == 2


def test_rerank_keeps_order_scores(spark):
    df = hits(spark, [(1, f"c{i}", 1.0 - i / 10, i + 1) for i in range(10)])
    got = rerank.keep_order(df, 5).orderBy("new_rank").collect()
    assert [round(r.rerank_score, 2) for r in got] == [1.0, 0.99, 0.98, 0.97, 0.96]

    @F.pandas_udf("double")
    def length(a, b):
        return b.str.len().astype(float)

    rows = df.withColumn("query", F.lit("q")).withColumn("content", F.repeat(F.lit("x"), F.col("rank").cast("int")))
    assert [r.chunk_id for r in rerank.rerank(rows, 2, scorer=length).orderBy("new_rank").collect()] == ["c9", "c8"]


def test_metrics(spark):
    found = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id long, doc_id string, rank long")
    rel = spark.createDataFrame([(1, "b", 1, 0), (1, "a", 2, 1), (2, "z", 1, 0)], "query_id long, doc_id string, rel int, position int")
    assert {r.query_id: r.mrr for r in E.reciprocal_rank(found, rel).collect()} == {1: 0.5, 2: 0.0}
    assert {r.query_id: r.mrr for r in E.reciprocal_rank(found, rel, "standard").collect()} == {1: 1.0, 2: 0.0}
    assert {r.query_id: r.hit_at_5 for r in E.hit_at(found, rel).collect()} == {1: 1, 2: 0}
    assert {r.query_id: round(r.ndcg, 6) for r in E.ndcg(found, rel).collect()} == {1: 1.0, 2: 0.0}
