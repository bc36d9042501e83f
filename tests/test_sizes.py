"""What only shows on larger or odder tables than the smallest ones."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


from tessera.functions import text
from tessera.operators import bm25, bm25index, cells, vectors
from tessera.plans import frames, registry


def test_upload_sizes_beyond_an_int(spark, tmp_path):
    rows = [(0, "x" * 30_000), (11, "short text of a few words"), (100, "y" * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.reject_reason for r in registry.queries()["doc_01_validate"](spark, str(tmp_path)).collect()}
    assert got == {0: "too large", 11: "chunk size", 100: None}
    assert registry.queries()["src_06_ingest_status"](spark, str(tmp_path)).agg(F.sum("n")).first()[0] == 3


def test_many_text_queries_by_blocks(spark, tmp_path, monkeypatch):
    """Few queries by blocks of postings, many by a broadcast of their weights, and more in pairs of blocks: all give what joined postings give."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    odds = 1 / np.arange(1, 401)
    text = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()))
    chunks = spark.createDataFrame([(i, text(rng.integers(1, 40))) for i in range(700)] + [(700, ""), (701, None)], "chunk_id long, content string").repartition(3)
    asked = spark.createDataFrame([(q, text(5)) for q in range(60)] + [(99, "unknown"), (98, None)], "query_id long, text string")
    pairs = lambda df: {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in df.collect()}
    want = {k: pairs(bm25.top_k(bm25.scores(asked, bm25.postings(chunks), bm25.doc_stats(chunks)), k)) for k in (4, 60)}
    index = bm25index.add(spark, f"file://{tmp_path}/index", chunks)
    for few, weights, members, probes in ((1000, 0, 0, 0), (1, 500_000, 0, 0), (1, 20, 97, 13)):
        monkeypatch.setattr(bm25index, "FEW", few)
        for name, value in (("WEIGHTS", weights), ("MEMBERS", members), ("PROBES", probes)):
            monkeypatch.setattr(bm25, name, value)
        for k in want:
            found = bm25index.top_k(index, asked, k)
            assert pairs(found) == want[k]
            if few == 1:
                assert pairs(bm25.search(asked, chunks, k)) == want[k]
                assert ("FlatMapCoGroupsInArrow" if weights == 20 else "MapInArrow") in found._jdf.queryExecution().toString()


def test_scores_of_vectors_in_tiles(monkeypatch):
    """What a task holds at once doesn't change what it finds."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)).round(1)
    table = pa.table({"id": pa.array(range(300)), "embedding": pa.array(x.tolist())})
    asked = table.slice(0, 50).rename_columns(["query_id", "embedding"])
    whole = vectors._nearest(asked, table, 7)
    monkeypatch.setattr(vectors, "SCORES", 1000)
    assert vectors._nearest(asked, table, 7).sort_by([("query_id", "ascending"), ("id", "ascending")]).to_pydict() == whole.to_pydict()
    assert vectors._nearest(asked, table, 7, 0.8).num_rows < whole.num_rows


def test_short_list_is_fitted(spark, tmp_path, monkeypatch):
    """Codes that tell few vectors apart get a longer short list, so the recall holds."""
    monkeypatch.setattr(cells, "VALUES", 4)
    x = np.random.default_rng(2).normal(size=(1500, 32))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    asked = table.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = cells.build(table, f"file://{tmp_path}/index")
    exact = vectors.top_k(asked, table, 10).cache()
    assert index.short > cells.SHORT and cells.opened(spark, index.path).short == index.short
    assert vectors.recall(cells.search(index, asked, short=cells.SHORT), exact, 10).first().recall < 0.9 < 0.94 < vectors.recall(cells.search(index, asked), exact, 10).first().recall


def test_cache_lookups_at_a_low_threshold(spark):
    """sca_02, sca_03 and sca_07 look up every vector as it is and take what reaches 0.25, by comparing all pairs."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    held = (ids % 2 == 0) & (ids % 10 != 0)
    want = set(ids[~held & ((x @ x[held].T).max(1) >= 0.25)].tolist())
    for name in ("sca_02_semantic", "sca_03_validated"):
        assert {r.query_id for r in registry.queries()[name](spark, sf).collect()} == want
    assert {r.query_id for r in registry.queries()["sca_07_lookup"](spark, sf).filter("layer = 'semantic'").collect()} == want


def test_normalizing_takes_rows_one_by_one(spark):
    plan = spark.range(3).select(text.normalize_unicode(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_judgements_leave_texts_in_place(spark, tmp_path, monkeypatch):
    """Few passages go to the texts; more are joined, with the same rows."""
    docs = [(1, "so the quick brown fox runs home"), (2, "quick brown fox"), (3, "a b c d e a b c d"), (4, None), (5, "b c x the quick brown fox runs"), (6, "")]
    passages = [(10, "the quick brown fox"), (11, "a b c d"), (12, "b c x the"), (13, "no such words here"), (14, "a b")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(10, 1), (10, 5), (11, 3), (12, 5)]
    few = frames.qrels(spark, str(tmp_path))
    assert sorted((r.query_id, r.doc_id) for r in few.collect()) == want and "Join" not in few._jdf.queryExecution().toString()
    monkeypatch.setattr(frames, "BROADCAST_ROWS", 1)
    assert sorted((r.query_id, r.doc_id) for r in frames.qrels(spark, str(tmp_path)).collect()) == want


def test_blocks_wait_for_few_queries(spark, tmp_path):
    """Many queries need neither blocks nor best postings, few ones get them when they ask; a batch written again brings its blocks up to date. No posting is shuffled."""
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 60, n))
    schema = "chunk_id long, content string"
    first, more, other = (spark.createDataFrame([(i, text(rng.integers(1, 30))) for i in range(a, a + 200)], schema) for a in (0, 200, 400))
    asked = spark.createDataFrame([(q, text(5)) for q in range(40)], "query_id long, text string")
    pairs = lambda df: {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in df.collect()}
    path = f"file://{tmp_path}/index"
    for chunks, batch in ((first, 0), (more, 1), (other, 1)):
        index = bm25index.add(spark, path, chunks, batch, late=True)
        held = first if batch == 0 else first.unionByName(chunks)
        want = bm25.top_k(bm25.scores(asked, bm25.postings(held), bm25.doc_stats(held)), 5).cache()
        before = index.posted(batch)
        assert pairs(bm25index.top_k(index, asked, 5)) == pairs(want) and index.posted(batch) == before == (chunks is other)
        assert pairs(bm25index.top_k(index, asked.filter("query_id < 3"), 5)) == pairs(want.filter("query_id < 3")) and index.posted(batch)


def test_all_scores_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Every scored pair is made where the chunk's tokens are read; with more weights in pairs of blocks."""
    chunks = spark.createDataFrame([(0, "a b b c"), (1, "c d"), (2, ""), (3, None), (4, "e e a")], "chunk_id long, content string")
    asked = spark.createDataFrame([(0, "a c c"), (1, "e x"), (2, "x"), (3, None)], "query_id long, text string")
    rows = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in df.collect())
    want = rows(bm25.scores(asked, bm25.postings(chunks), bm25.doc_stats(chunks)))
    index = bm25index.add(spark, f"file://{tmp_path}/index", chunks, late=True)
    found = bm25index.scores(index, asked)
    assert rows(found) == want and len(want) > 3 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(bm25, "WEIGHTS", 2)
    assert rows(bm25index.scores(index, asked)) == want


def test_judgements_of_short_passages(spark, tmp_path, monkeypatch):
    """evl_01 and evl_02 judge by every passage that a text contains, of however few words and without an id too, as their SQL does."""
    docs = [(1, "so the quick brown fox runs home"), (2, "quick brown fox"), (3, "a b c d e a b c d"), (4, None), (5, "b c x the quick brown fox runs"), (6, ""), (None, "an unbrown foxglove")]
    passages = [(10, "the quick brown fox"), (11, "brown fox"), (12, "ox"), (13, "nbrown foxglove of some length"), (14, "a b"), (15, None), (16, "quick brown fox"), (17, "unbrown foxglove"), (18, "  "), (19, "c d e a b"), (None, "runs")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted(((q, d) for q, p in passages for d, t in docs if p and t and p in t), key=str)
    pairs = lambda: sorted(((r.query_id, r.doc_id) for r in frames.qrels(spark, str(tmp_path), 0).collect()), key=str)
    assert pairs() == want and len(want) > 15
    monkeypatch.setattr(frames, "BROADCAST_ROWS", 3)
    assert pairs() == want
    monkeypatch.undo()
    sql = duckdb.connect()
    for name in ("documents", "benchmark"):
        sql.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("evl_01_hits", "evl_02_mrr"):
        got, twin = registry.queries()[name](spark, str(tmp_path)), sql.sql(registry.oracle_sql()[name])
        assert sorted((tuple(r) for r in got.select(*twin.columns).collect()), key=str) == sorted(twin.fetchall(), key=str) and got.count() == 8


def test_short_lists_by_blocks(spark, tmp_path, monkeypatch):
    """A block of codes gives a query its short list and no row for each cell; however the blocks are cut the list is that of all probed codes, equal ones by id."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:500] = x[7]
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    asked = table.filter("id % 9 = 7").withColumnRenamed("id", "query_id")
    index = cells.build(table, f"file://{tmp_path}/index")
    assert index.vectors(spark).schema["embedding"].dataType == table.schema["embedding"].dataType
    lists = lambda: {(r.query_id, r.id) for r in cells.short_list(index, asked, 5, short=6, probes=9).collect()}
    want = lists()
    assert {i for q, i in want if q == 7} == {7, *range(300, 329)}
    monkeypatch.setattr(cells, "MEMBERS", 150)
    monkeypatch.setattr(cells, "PROBES", 11)
    monkeypatch.setattr(cells, "SCORES", 400)
    assert lists() == want
    left, right = (t.toArrow() for t in (index.codes(spark), asked))
    rows = cells._best(left, right, index.centres, index.books, len(index.centres), 30).group_by("query_id").aggregate([("id", "count")])
    assert rows.num_rows == 100 and set(rows["id_count"].to_pylist()) == {30}
    for size in (vectors.MEMBERS, 100):
        monkeypatch.setattr(vectors, "MEMBERS", size)
        assert vectors.recall(cells.search(index, asked, 5, short=40, probes=len(index.centres)), vectors.top_k(asked, table, 5, block=10), 5).first().recall > 0.97


def test_a_block_gives_a_query_its_best_alone():
    """What the slices of a block of chunks gave is cut to the k best and their ties before it leaves the task."""
    rng = np.random.default_rng(9)
    score = rng.integers(0, 40, 3000) / 8
    table = pa.table({"query_id": pa.array(rng.integers(0, 30, 3000) * 7), "chunk_id": pa.array(range(3000)), "score": pa.array(score)})
    got = bm25._kept(table, 5).to_pandas()
    want = table.to_pandas().groupby("query_id")["score"].transform(lambda s: s >= s.nlargest(5).min() - bm25.SLACK)
    assert sorted(got["chunk_id"]) == np.flatnonzero(want).tolist() and len(got) < 1000
    assert bm25._kept(table, None).num_rows == bm25._kept(table, 3000).num_rows == 3000
