"""Queries of vector search, BM25, fusion, expansion, reranking, relevance and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.operators import bm25 as B
from tessera.operators import bm25index as BI
from tessera.operators import cells as C
from tessera.operators import delta as A
from tessera.operators import embed as M
from tessera.operators import evaluate as E
from tessera.operators import expand as X
from tessera.operators import fusion as U
from tessera.operators import relevance as L
from tessera.operators import rerank as K
from tessera.operators import vectors as V
from tessera.operators.common import shared_dir, small

from . import frames as Z
from . import pipelines as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def put(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


def r6(c):
    return F.round(c, 6).alias(c)


# --- vectors
put("vec_01_topk", lambda s, d: Z.vector_hits(s, d, 10).select("query_id", "chunk_id", r6("score"), "rank"),
    Z.sql("hv", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hv WHERE rank <= 10"))


def _vec_02(s, d):
    own = Z.embeddings(s, d)
    other = own.select((F.col("id") + 1).alias("id"), F.col("embedding").alias("e2"))
    pair = own.join(other, "id")
    return pair.select("id", *(F.round(f(F.col("embedding"), F.col("e2")), 6).alias(n) for n, f in S.METRICS.items()))


put("vec_02_metrics", _vec_02, """
WITH p AS (SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1)
SELECT id, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-9), 6) AS cosine, round(list_dot_product(x, y), 6) AS dot, round(list_distance(x, y), 6) AS euclidean FROM p""")  # fmt: skip


def _tagged(s, d):
    return Z.embeddings(s, d).withColumn("metadata", F.map_filter(F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("part"), F.when(F.col("id") % 3 != 0, (F.col("id") % 7).cast("string"))), lambda _, v: v.isNotNull()))


put("vec_03_filter", lambda s, d: _tagged(s, d).filter(V.matches({"label": {"$in": [1, 2, 3]}, "part": {"$gte": 2, "$lt": 6}})).select("id", F.col("label").cast("long").alias("label")),
    "SELECT vec_id AS id, label::BIGINT AS label FROM embeddings WHERE label IN (1, 2, 3) AND vec_id % 3 <> 0 AND vec_id % 7 BETWEEN 2 AND 5")


def _vec_04(s, d):
    own = Z.chunks(s, d).select("chunk_id", "content", "document_id", F.lit(0).alias("chunk_index"), F.lit("f").alias("source_file"), F.when(F.col("chunk_id") % 2 == 0, F.create_map(F.lit("source_file"), F.lit("own"))).alias("metadata"))
    emb = own.select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    m = F.col("metadata")
    return V.index_rows(own, emb).select("id", m["content"].alias("content"), m["document_id"].alias("document_id"), m["source_file"].alias("source_file"), F.size("metadata").cast("long").alias("keys"))


put("vec_04_index_rows", _vec_04, "SELECT doc_id AS id, text AS content, doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE 'f' END AS source_file, 4::BIGINT AS keys FROM documents")


def _vec_05(s, d):
    own = Z.embeddings(s, d).select("id", F.col("label").cast("long").alias("label"))
    new = own.filter("id % 2 = 0").select((F.col("id") + F.when(F.col("id") % 4 == 0, 1_000_000).otherwise(0)).alias("id"), F.lit(-1).cast("long").alias("label"))
    t = A.Table(s, f"{shared_dir(s)}/{uuid.uuid4().hex}", "id")
    A.put(t, own, 0)
    A.put(t, new.union(new), 1)
    return A.read(t)


put("vec_05_upsert", _vec_05, """SELECT vec_id AS id, label::BIGINT AS label FROM embeddings WHERE vec_id % 4 <> 2 UNION ALL SELECT vec_id + CASE WHEN vec_id % 4 = 0 THEN 1000000 ELSE 0 END, -1 FROM embeddings WHERE vec_id % 2 = 0""")
put("vec_06_delete", lambda s, d: V.delete(V.delete(_tagged(s, d), Z.vector_queries(s, d).select(F.col("query_id").alias("id"))), conditions={"part": 3}).select("id"),
    "SELECT vec_id AS id FROM embeddings WHERE vec_id % 20 <> 0 AND NOT (vec_id % 3 <> 0 AND vec_id % 7 = 3)")
put("vec_07_stats", lambda s, d: V.collection_stats(Z.embeddings(s, d)), "SELECT count(*) AS vectors_count, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings")
put("vec_08_uuid5", lambda s, d: Z.documents(s, d).select("document_id", V.uuid5(F.col("document_id").cast("string")).alias("uuid")),
    f"WITH h AS (SELECT doc_id AS document_id, sha1(from_hex('{V.NAMESPACE_DNS}') || doc_id::VARCHAR::BLOB) AS h FROM documents) SELECT document_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || '89ab'[instr('0123456789abcdef', substr(h, 17, 1)) % 4 + CASE WHEN instr('0123456789abcdef', substr(h, 17, 1)) % 4 = 0 THEN 4 ELSE 0 END] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h")


def _ann(s, d):
    """The stored index of all vectors, written anew."""
    return C.build(Z.embeddings(s, d), f"{shared_dir(s)}/cells/{uuid.uuid4().hex}")


put("vec_09_approximate", lambda s, d: C.search(_ann(s, d), Z.vector_queries(s, d)))


def _vec_10(s, d):
    """Recall of the exact top 10 and the share of the vectors that a query rescores, against what the index promises."""
    index, asked = _ann(s, d), Z.vector_queries(s, d)
    report = V.recall(C.search(index, asked), V.top_k(asked, Z.embeddings(s, d), 10), 10)
    read = C.short_list(index, asked).agg(F.count("*").alias("n")).crossJoin(Z.embeddings(s, d).agg(F.count("*").alias("rows")))
    return report.crossJoin(read).select("queries", "k", (F.col("recall") >= 0.95).alias("recall_reached"), (F.col("n") / F.col("queries") / F.col("rows") < 0.2).alias("under_a_fifth_rescored"))


put("vec_10_recall", _vec_10, "SELECT count(*) AS queries, 10 AS k, true AS recall_reached, true AS under_a_fifth_rescored FROM embeddings WHERE vec_id % 20 = 0")

# --- BM25


def _posted(s, d):
    return B.postings(Z.chunks(s, d))


def _scored(s, d, variant="okapi"):
    return B.scan_scores(Z.searches(s, d), Z.chunks(s, d), variant)


put("bm25_01_tokens", lambda s, d: Z.chunks(s, d).select("chunk_id", F.array_join(B.tokens(F.col("content"), 3, True), " ").alias("tokens")),
    f"SELECT doc_id AS chunk_id, array_to_string(list_filter(regexp_extract_all(lower(text), '{Z.TOKEN}'), lambda t: length(t) >= 3 AND t NOT IN ({', '.join(repr(w) for w in B.STOPWORDS)})), ' ') AS tokens FROM documents")
put("bm25_02_postings", _posted, Z.sql("posts", "SELECT term, chunk_id, tf FROM posts"))


def _bm25_03(s, d):
    c = Z.chunks(s, d)
    docs = B.doc_stats(c)
    return docs.crossJoin(F.broadcast(B.corpus_stats(docs))).select("chunk_id", "dl", "n", r6("avgdl"))


put("bm25_03_stats", _bm25_03, Z.sql("cs", "SELECT chunk_id, dl::BIGINT AS dl, n, round(avgdl, 6) AS avgdl FROM ds, cs"))


def _bm25_04(s, d):
    c = Z.chunks(s, d)
    corpus = B.corpus_stats(B.doc_stats(c))
    p = B.postings(c)
    return B.term_stats(p, corpus).join(B.term_stats(p, corpus, "plus").select("term", F.col("idf").alias("idf_plus")), "term").select("term", "df", r6("idf"), r6("idf_plus"))


put("bm25_04_idf", _bm25_04, Z.sql("ts", "SELECT term, df, round(idf, 6) AS idf, round(ln(((SELECT n FROM cs) + 1)::DOUBLE / df), 6) AS idf_plus FROM ts"))
put("bm25_05_scores_indexed", lambda s, d: BI.scores(Z.bm25_index(s, d), Z.searches(s, d)).select("query_id", "chunk_id", r6("score")),
    Z.sql("bs", "SELECT query_id, chunk_id, round(score, 6) AS score FROM bs"))
put("bm25_05_scores", lambda s, d: _scored(s, d).select("query_id", "chunk_id", r6("score")), Z.sql("bs", "SELECT query_id, chunk_id, round(score, 6) AS score FROM bs"))
_PLUS = """tp AS (SELECT term, df, ln(((SELECT n FROM cs) + 1)::DOUBLE / df) AS idf FROM ts0), bd AS (SELECT query_id, sum(qf * idf) AS bound FROM qt JOIN tp USING (term) GROUP BY query_id),
bsp AS (SELECT query_id, chunk_id, sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM qt JOIN tp USING (term) JOIN posts USING (term) JOIN ds USING (chunk_id), cs GROUP BY ALL)"""
put("bm25_05_scores_plus", lambda s, d: _scored(s, d, "plus").select("query_id", "chunk_id", r6("score")),
    Z.sql("ts0 qt", "SELECT query_id, chunk_id, round(score + bound, 6) AS score FROM bsp JOIN bd USING (query_id)", _PLUS))
put("bm25_06_topk", lambda s, d: Z.bm25_hits(s, d, 10, 1.0).select("query_id", "chunk_id", r6("score"), "rank"),
    Z.sql("bt", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bt WHERE rank <= 10 AND score > 1"))
put("bm25_07_normalize", lambda s, d: B.normalize(Z.bm25_hits(s, d)).select("query_id", "chunk_id", r6("score")),
    Z.sql("bt", "SELECT query_id, chunk_id, round(CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE score END, 6) AS score FROM bt WHERE score > 0 WINDOW w AS (PARTITION BY query_id)"))


def _bm25_08(s, d):
    """The odd chunks are added as a batch to a stored index of the even ones, and added again, which changes nothing."""
    c, path = Z.chunks(s, d), f"{shared_dir(s)}/bm25-{uuid.uuid4().hex}"
    BI.add(s, path, c.filter("chunk_id % 2 = 0"))
    for _ in range(2):
        index = BI.add(s, path, c.filter("chunk_id % 2 <> 0"), 1)
    return BI.term_stats(index).select("term", "df", r6("idf"))


put("bm25_08_add", _bm25_08, Z.sql("ts", "SELECT term, df, round(idf, 6) AS idf FROM ts"))


def _bm25_09(s, d):
    c = Z.chunks(s, d)
    top = Z.bm25_hits(s, d, 5)
    totals = B.response_totals(Z.searches(s, d), top, B.doc_stats(c)).withColumn("top_score", F.round("top_score", 6))
    return B.with_fields(top, c, ["document_id", "content"]).select("query_id", "rank", "document_id", F.length("content").cast("long").alias("chars")).join(totals, "query_id")


put("bm25_09_fields", _bm25_09, Z.sql("bt", f"""SELECT b.query_id, rank, chunk_id AS document_id, length(d.text) AS chars, len(regexp_extract_all(lower(q.text), '{Z.TOKEN}'))::BIGINT AS query_tokens, count(*) OVER w AS results,
round(max(score) OVER w, 6) AS top_score, (SELECT n FROM cs) AS total_documents FROM bt b JOIN documents d ON d.doc_id = chunk_id JOIN bq q ON q.query_id = b.query_id WHERE rank <= 5 AND score > 0 WINDOW w AS (PARTITION BY b.query_id)"""))

# --- normalisation
_W = "WINDOW w AS (PARTITION BY query_id)"
put("nrm_01_min_max", lambda s, d: Z.vector_hits(s, d).select("query_id", "chunk_id", F.round(S.min_max(F.col("score")), 6).alias("norm")), Z.sql("nv", "SELECT query_id, chunk_id, round(norm, 6) AS norm FROM nv"))
put("nrm_02_cosine", lambda s, d: Z.vector_hits(s, d).select("query_id", "chunk_id", F.round(S.cosine_to_unit(F.col("score") - 0.3), 6).alias("norm")),
    Z.sql("hv", "SELECT query_id, chunk_id, round(CASE WHEN score - 0.3 < 0 THEN (score - 0.3 + 1) / 2 ELSE score - 0.3 END, 6) AS norm FROM hv"))
put("nrm_03_sigmoid", lambda s, d: Z.vector_hits(s, d).select("query_id", "chunk_id", F.round(S.sigmoid(F.col("score"), 0.5), 6).alias("norm")),
    Z.sql("hv", "SELECT query_id, chunk_id, round(1 / (1 + exp(-(score - 0.5::DOUBLE))), 6) AS norm FROM hv"))
put("nrm_04_softmax", lambda s, d: Z.vector_hits(s, d).select("query_id", "chunk_id", F.round(S.softmax(F.col("score"), temperature=0.5), 6).alias("norm")),
    Z.sql("hv", "SELECT query_id, chunk_id, round(e / sum(e) OVER (PARTITION BY query_id), 6) AS norm FROM (SELECT *, exp((score - max(score) OVER w) / 0.5::DOUBLE) AS e FROM hv WINDOW w AS (PARTITION BY query_id))"))

# --- fusion


def _sides(s, d):
    return U.both_sides(Z.vector_hits(s, d), Z.second_hits(s, d))


_REC = "pow(0.5::DOUBLE, (31 - chunk_id % 30) / 30.0::DOUBLE)"


def _created():
    return F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.pmod(F.col("chunk_id"), F.lit(30)) * 86400)


def _fused(s, d):
    return U.weighted_sum(_sides(s, d), U.recency(_created(), Z.now()))


put("fus_01_weighted", lambda s, d: _fused(s, d).select("query_id", "chunk_id", r6("combined_score"), r6("vector_score"), r6("bm25_score"), r6("recency_score")),
    Z.sql("sides", f"SELECT query_id, chunk_id, round(5.0::DOUBLE * vector_score + 3.0::DOUBLE * bm25_score + 0.2::DOUBLE * {_REC}, 6) AS combined_score, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score, round({_REC}, 6) AS recency_score FROM sides"))
put("fus_02_rrf", lambda s, d: U.cut(U.reciprocal_rank(_sides(s, d)), 100).select("query_id", "chunk_id", r6("combined_score"), "rank"),
    Z.sql("sides", "SELECT query_id, chunk_id, round(c, 6) AS combined_score, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, chunk_id) AS rank FROM (SELECT *, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) AS c FROM sides) QUALIFY rank <= 100"))


def _fus_03(s, d):
    raw = F.when(F.col("document_id") % 3 == 0, F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("document_id") % 3 == 1, F.unix_timestamp("created_at").cast("string")).otherwise("unknown")
    own = Z.documents(s, d).withColumn("meta", raw)
    return own.select("document_id", F.round(U.recency(U.parsed_time(F.col("meta")), Z.now()), 6).alias("recency"))


put("fus_03_recency", _fus_03, "SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE round(pow(0.5::DOUBLE, (31 - doc_id % 30) / 30.0::DOUBLE), 6) END AS recency FROM documents")
put("fus_04_overlap", lambda s, d: U.overlap_stats(U.weighted_sum(_sides(s, d))).select("query_id", "total_vector", "total_bm25", "unique_results", "overlap", r6("overlap_ratio"), r6("top_score")),
    Z.sql("sides", "SELECT query_id, count(*) FILTER (from_vector) AS total_vector, count(*) FILTER (from_bm25) AS total_bm25, count(*) AS unique_results, count(*) FILTER (from_vector AND from_bm25) AS overlap, round((count(*) FILTER (from_vector AND from_bm25))::DOUBLE / count(*), 6) AS overlap_ratio, round(max(5.0::DOUBLE * vector_score + 3.0::DOUBLE * bm25_score), 6) AS top_score FROM sides GROUP BY query_id"))


def _fus_05(s, d):
    v = Z.vector_hits(s, d).withColumn("content", F.concat(F.lit("v"), F.col("rank")))
    b = Z.second_hits(s, d).withColumn("content", F.concat(F.lit("b"), F.col("rank")))
    return U.coalesced(v, b, ["content"])


put("fus_05_coalesce", _fus_05, Z.sql("sides", "SELECT query_id, chunk_id, CASE WHEN from_vector THEN 'v' || vector_rank ELSE 'b' || bm25_rank END AS content, from_vector, from_bm25 FROM sides"))
_CUT = "SELECT query_id, chunk_id, round(c, 6) AS combined_score, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, chunk_id) AS rank FROM (SELECT *, 5.0::DOUBLE * vector_score + 3.0::DOUBLE * bm25_score AS c FROM sides) QUALIFY rank <= 10"
put("fus_06_hybrid_topk", lambda s, d: U.cut(U.weighted_sum(_sides(s, d)), 10).select("query_id", "chunk_id", r6("combined_score"), "rank"), Z.sql("sides", _CUT))
put("fus_07_vector_only", lambda s, d: U.vector_only(Z.vector_hits(s, d, 10)).select("query_id", "chunk_id", r6("combined_score"), "bm25_score", "from_bm25", "rank"),
    Z.sql("hv", "SELECT query_id, chunk_id, round(score, 6) AS combined_score, 0.0::DOUBLE AS bm25_score, false AS from_bm25, rank FROM hv WHERE rank <= 10"))


def _fus_08(s, d):
    grid = s.createDataFrame([("a", 1.0, 0.0), ("b", 5.0, 3.0), ("c", 1.0, 1.0)], "setting string, w_vector double, w_bm25 double")
    top = U.sweep(_sides(s, d), grid, 10)
    own = Z.embeddings(s, d)
    label = top.join(own.select(F.col("id").alias("chunk_id"), "label"), "chunk_id").join(own.select(F.col("id").alias("query_id"), F.col("label").alias("qlabel")), "query_id")
    return label.groupBy("setting").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("qlabel")).alias("relevant"))


put("fus_08_sweep", _fus_08, Z.sql("sides", """SELECT setting, count(*) AS n, count(*) FILTER (a.label = b.label) AS relevant FROM (SELECT setting, query_id, chunk_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY round(wv * vector_score + wb * bm25_score, 9) DESC, chunk_id) AS rank
FROM sides, (VALUES ('a', 1.0::DOUBLE, 0.0::DOUBLE), ('b', 5.0::DOUBLE, 3.0::DOUBLE), ('c', 1.0::DOUBLE, 1.0::DOUBLE)) t(setting, wv, wb) QUALIFY rank <= 10) r JOIN embeddings a ON a.vec_id = chunk_id JOIN embeddings b ON b.vec_id = query_id GROUP BY setting"""))

# --- expansion
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_KW = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9_-]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"


def _ascii_turns(s, d):
    """User turns in ASCII, some of them opened like questions."""
    head = F.element_at(F.array(*map(F.lit, ["", "what is ", "How to ", "why ", "fix the best "])), (F.col("query_id") % 5 + 1).cast("int"))
    return Z.user_turns(s, d).select("query_id", F.concat(head, F.regexp_replace("text", r"[^\x00-\x7F]", "e")).alias("text"))


_AT = "aq AS (SELECT conv_id * 1000 + turn AS query_id, (['', 'what is ', 'How to ', 'why ', 'fix the best '])[(conv_id * 1000 + turn) % 5 + 1] || regexp_replace(text, '[^\\x00-\\x7F]', 'e', 'g') AS text FROM conversations WHERE role = 'user')"
put("mq_01_keywords", lambda s, d: _ascii_turns(s, d).select("query_id", F.array_join(X.keywords(F.col("text")), " ").alias("keywords")), f"WITH {_AT} SELECT query_id, array_to_string({_KW}, ' ') AS keywords FROM aq")
_REST = "CASE " + " ".join(f"WHEN starts_with(lower(text), '{p}') THEN regexp_replace(substr(text, {len(p) + 1}), '[?]+$', '')" for p in X.PREFIXES) + " END"
_SWAP = "CASE " + " ".join(f"WHEN contains(lower(text), '{a}') THEN replace(lower(text), '{a}', '{b}')" for a, b in X.SYNONYMS.items()) + " END"
_VARS = f"""{_AT}, v0 AS (SELECT query_id, text, array_to_string({_KW}, ' ') AS kw, {_REST} AS rest, {_SWAP} AS sw FROM aq),
v AS (SELECT query_id, text, list_filter([CASE WHEN kw <> '' AND kw <> lower(text) THEN kw END, CASE WHEN NOT regexp_matches(lower(text), '^({'|'.join(X.OPENINGS)})') THEN 'What is ' || text || '?' WHEN rest <> '' THEN rest END, upper(sw[1]) || sw[2:]], lambda x: x IS NOT NULL) AS vs FROM v0)"""
put("mq_02_variations", lambda s, d: _ascii_turns(s, d).select("query_id", F.posexplode(X.variations(F.col("text")))).select("query_id", F.col("pos").cast("long").alias("position"), F.col("col").alias("variation")),
    f"WITH {_VARS} SELECT query_id, k - 1 AS position, vs[k] AS variation FROM (SELECT query_id, vs, unnest(range(1, len(vs) + 1)) AS k FROM v)")
_ALL = """a AS (SELECT query_id, -1 AS p, text FROM v UNION ALL SELECT query_id, k, vs[k] FROM (SELECT query_id, vs, unnest(range(1, len(vs) + 1)) AS k FROM v)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(trim(text)) ORDER BY p) AS r FROM a QUALIFY r = 1)"""
put("mq_03_all_queries", lambda s, d: X.all_queries(_ascii_turns(s, d)), f"WITH {_VARS}, {_ALL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS variation_no, text FROM f")


def _mq_04(s, d):
    both = Z.vector_hits(s, d).withColumn("variation_no", F.lit(1)).unionByName(Z.second_hits(s, d).withColumn("variation_no", F.lit(0))).withColumnRenamed("score", "combined_score")
    return X.merge_candidates(both, 20).select("query_id", "chunk_id", r6("combined_score"), "rank")


put("mq_04_merge", _mq_04, Z.sql("hv hb", """SELECT query_id, chunk_id, round(score, 6) AS combined_score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY v, rank) AS r FROM (SELECT 1 AS v, * FROM hv UNION ALL SELECT 0, * FROM hb) QUALIFY r = 1) QUALIFY rank <= 20"""))


def _mq_05(s, d):
    turns = _ascii_turns(s, d)
    made = turns.select("query_id", F.lit(0).alias("position"), F.concat(F.lit("about "), "text").alias("text"))
    return X.all_queries(turns, external=made, most=2)


put("mq_05_external", _mq_05, f"""WITH {_VARS}, m AS (SELECT query_id, 0 AS p, 'about ' || text AS text FROM v UNION ALL SELECT query_id, k, vs[k] FROM (SELECT query_id, vs, unnest(range(1, len(vs) + 1)) AS k FROM v)),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) AS n FROM m QUALIFY n <= 2), a AS (SELECT query_id, -1 AS p, text FROM v UNION ALL SELECT query_id, p, text FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(trim(text)) ORDER BY p) AS r FROM a QUALIFY r = 1) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS variation_no, text FROM f""")

# --- reranking


def _ranked(s, d, k=100):
    """Candidates with the token sets of query and chunk; the chunks' tokens come from the stored index, of the candidates alone."""
    chunks = Z.bm25_index(s, d).table("docs").select("chunk_id", F.array_distinct("tokens").alias("content_tokens"))
    asked = K.token_sets(Z.searches(s, d), "text", "query_tokens").select("query_id", "query_tokens")
    return chunks.join(Z.held_hits(s, d, k), "chunk_id").join(small(asked), "query_id")


def _reranked(s, d):
    return K.rerank(_ranked(s, d), scorer=K.overlap, query="query_tokens", content="content_tokens")


_JAC = f"""tq AS (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '{Z.TOKEN}')) AS x FROM bq), tc AS (SELECT doc_id AS chunk_id, list_distinct(regexp_extract_all(lower(text), '{Z.TOKEN}')) AS y FROM documents),
j AS (SELECT query_id, chunk_id, score, rank AS original_rank, len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) AS rs FROM bt JOIN tq USING (query_id) JOIN tc USING (chunk_id) WHERE rank <= 100 AND score > 0),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rs, 9) DESC, original_rank) AS new_rank FROM j QUALIFY new_rank <= 10)"""
put("rrk_01_rerank", lambda s, d: _reranked(s, d).select("query_id", "chunk_id", r6("rerank_score"), "original_rank", "new_rank"),
    Z.sql("bt", "SELECT query_id, chunk_id, round(rs, 6) AS rerank_score, original_rank, new_rank FROM rr", _JAC))
put("rrk_02_keep_order", lambda s, d: K.keep_order(_ranked(s, d)).select("query_id", "chunk_id", r6("rerank_score"), "new_rank"),
    Z.sql("bt", "SELECT query_id, chunk_id, round(1.0 - 0.01 * (rank - 1), 6)::DOUBLE AS rerank_score, rank AS new_rank FROM bt WHERE rank <= 10 AND score > 0"))
put("rrk_03_combine", lambda s, d: K.combined_candidates(Z.vector_hits(s, d, 20), Z.second_hits(s, d, 20)).select("query_id", "chunk_id", "source", "rank"),
    Z.sql("hv hb", "SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY side, rank) AS rank FROM (SELECT 0 AS side, 'vector' AS source, query_id, chunk_id, rank FROM hv WHERE rank <= 20 UNION ALL SELECT 1, 'bm25', query_id, chunk_id, rank FROM hb WHERE rank <= 20 AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM hv WHERE rank <= 20))"))
put("rrk_04_rank_change", lambda s, d: K.average_change(_reranked(s, d)).select("query_id", r6("avg_rank_change"), "n"),
    Z.sql("bt", "SELECT query_id, round(avg(abs(original_rank - new_rank)), 6) AS avg_rank_change, count(*) AS n FROM rr GROUP BY query_id", _JAC))

# --- relevance


def _rel(strategy, **options):
    return lambda s, d: L.filter_hits(Z.vector_hits(s, d, 10), strategy, **options).select("query_id", "chunk_id", r6("relevance_score"), "rank", "passed_threshold", "filter_reason")


_H10 = "h AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM hv WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id))"


def _rel_sql(threshold: str, least: int = 1, most: int = 5, out: str | None = None, passed: str = "s >= t"):
    more = f"""{_H10}, t AS (SELECT *, {threshold} AS t, count(*) OVER (PARTITION BY query_id) AS input_count FROM h), p AS (SELECT *, {passed} AS ok FROM t),
    o AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY query_id) AS n_ok, row_number() OVER (PARTITION BY query_id, ok ORDER BY s DESC, rank) AS place FROM p),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ok DESC, CASE WHEN ok THEN rank ELSE place END) - 1 AS new_rank FROM o WHERE ok OR n_ok + place <= {least} QUALIFY new_rank < {most})"""
    return Z.sql("hv", out or "SELECT query_id, chunk_id, round(s, 6) AS relevance_score, new_rank AS rank, ok AS passed_threshold, CASE WHEN ok THEN '' ELSE 'added to meet minimum' END AS filter_reason FROM k", more)


put("rel_01_threshold", _rel("threshold"), _rel_sql("0.6::DOUBLE"))
put("rel_02_dynamic", _rel("dynamic"), _rel_sql("greatest(avg(s) OVER (PARTITION BY query_id) - coalesce(stddev_samp(s) OVER (PARTITION BY query_id), 0), 0.3::DOUBLE)"))
put("rel_03_percentile", _rel("percentile"), _rel_sql("(list_sort(list(s) OVER (PARTITION BY query_id)))[least(floor(count(*) OVER (PARTITION BY query_id) * (1 - 70.0::DOUBLE / 100))::BIGINT + 1, count(*) OVER (PARTITION BY query_id))]"))
put("rel_04_top_k", _rel("top_k"), _rel_sql("0.0::DOUBLE", passed="rank <= 5"))
put("rel_05_backfill", _rel("threshold", min_score=0.99, min_chunks=4), _rel_sql("0.99::DOUBLE", 4))
put("rel_06_cap", _rel("threshold", min_score=0.1, max_chunks=3), _rel_sql("0.1::DOUBLE", 1, 3))
put("rel_07_stats", lambda s, d: L.filter_stats(L.filter_hits(Z.vector_hits(s, d, 10))).select("query_id", "input_count", "output_count", "filtered_count", r6("threshold_used"), r6("avg_score"), r6("min_score"), r6("max_score"), r6("filter_rate"), r6("retention_rate")),
    _rel_sql("0.6::DOUBLE", out="SELECT query_id, max(input_count) AS input_count, count(*) AS output_count, max(input_count) - count(*) AS filtered_count, 0.6::DOUBLE AS threshold_used, round(avg(s), 6) AS avg_score, round(min(s), 6) AS min_score, round(max(s), 6) AS max_score, round((max(input_count) - count(*))::DOUBLE / max(input_count), 6) AS filter_rate, round(count(*)::DOUBLE / max(input_count), 6) AS retention_rate FROM k GROUP BY query_id"))


def _rel_08(s, d):
    own = Z.vector_hits(s, d, 10).withColumn("confidence", F.col("query_id") % 100 / 100)
    return L.filter_hits(own, min_score=L.adaptive_threshold(F.col("confidence"))).select("query_id", "chunk_id", r6("relevance_score"), "rank", "passed_threshold", "filter_reason")


put("rel_08_adaptive", _rel_08, _rel_sql("0.5::DOUBLE + 0.3::DOUBLE * (query_id % 100 / 100.0::DOUBLE)"))


def _rel_09(s, d):
    own = _reranked(s, d).select("query_id", "chunk_id", "rerank_score", F.col("new_rank").alias("rank"))
    return L.filter_hits(own, score="rerank_score").select("query_id", "chunk_id", r6("relevance_score"), "rank")


put("rel_09_reranked", _rel_09, Z.sql("bt", """SELECT query_id, chunk_id, round(s, 6) AS relevance_score, row_number() OVER (PARTITION BY query_id ORDER BY new_rank) - 1 AS rank FROM (
SELECT *, CASE WHEN max(rs) OVER w = min(rs) OVER w THEN 1.0 ELSE (rs - min(rs) OVER w) / (max(rs) OVER w - min(rs) OVER w) END AS s FROM rr WINDOW w AS (PARTITION BY query_id)) WHERE s >= 0.6 QUALIFY rank < 5""", _JAC))

# --- evaluation


def _found(s, d):
    return Z.bm25_hits(s, d, 10).select("query_id", F.col("chunk_id").alias("doc_id"), "rank", "score")


_EV = """f AS (SELECT query_id, chunk_id AS doc_id, rank FROM bt WHERE rank <= 10 AND score > 0), j AS (SELECT q.*, f.rank FROM qrels q LEFT JOIN f USING (query_id, doc_id)),
h AS (SELECT query_id, coalesce((min(rank) <= 5)::BIGINT, 0) AS hit_at_5, coalesce((min(rank) <= 10)::BIGINT, 0) AS hit_at_10, coalesce(1.0::DOUBLE / arg_min(rank, position) FILTER (rank IS NOT NULL), 0) AS mrr FROM j GROUP BY query_id),
g AS (SELECT f.query_id, sum(CASE WHEN q.rel = 1 THEN 1 / log2(f.rank + 1) ELSE 0 END) AS real, count(q.rel) AS m FROM f LEFT JOIN qrels q USING (query_id, doc_id) GROUP BY f.query_id),
n AS (SELECT h.query_id, CASE WHEN m > 0 THEN real / list_sum(list_transform(range(1, m + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg FROM h LEFT JOIN g USING (query_id))"""
put("evl_01_hits", lambda s, d: E.hit_at(_found(s, d), Z.qrels(s, d, 0)), Z.sql("bt qrels", "SELECT query_id, hit_at_5, hit_at_10 FROM h", _EV))
put("evl_02_mrr", lambda s, d: E.reciprocal_rank(_found(s, d), Z.qrels(s, d, 0)).select("query_id", r6("mrr")), Z.sql("bt qrels", "SELECT query_id, round(mrr, 6) AS mrr FROM h", _EV))
put("evl_03_ndcg", lambda s, d: E.ndcg(_found(s, d), Z.qrels(s, d, 0)).select("query_id", r6("ndcg")), Z.sql("bt qrels", "SELECT query_id, round(ndcg, 6) AS ndcg FROM n", _EV))


def _graded(s, d):
    own = E.per_query(_found(s, d), Z.qrels(s, d, 0))
    return own.withColumns({"category": (F.col("query_id") % 3).cast("string"), "difficulty": (F.col("query_id") % 2).cast("string")})


put("evl_04_breakdown", lambda s, d: E.breakdown(_graded(s, d)).select("category", "difficulty", "total", "hits", r6("recall"), r6("mrr")),
    Z.sql("bt qrels", "SELECT category, difficulty, count(*) AS total, sum(hit_at_10)::BIGINT AS hits, round(sum(hit_at_10)::DOUBLE / count(*), 6) AS recall, round(avg(mrr), 6) AS mrr FROM (SELECT *, (query_id % 3)::VARCHAR AS category, (query_id % 2)::VARCHAR AS difficulty FROM h) GROUP BY GROUPING SETS ((), (category), (difficulty))", _EV))


def _evl_05(s, d):
    a = E.per_query(_found(s, d), Z.qrels(s, d, 0)).withColumn("mode", F.lit("bm25"))
    b = E.per_query(_found(s, d).filter("rank <= 3"), Z.qrels(s, d, 0)).withColumn("mode", F.lit("top3"))
    return E.compare(a.unionByName(b), "bm25", "top3").select("metric", r6("base"), r6("other"), r6("delta"), "change")


_EV3 = _EV.replace("rank <= 10 AND score > 0", "rank <= 3 AND score > 0")
for _x in "fjhgn":
    _EV3 = _EV3.replace(f"{_x} AS (", f"{_x}3 AS (").replace(f"FROM {_x} ", f"FROM {_x}3 ").replace(f"JOIN {_x} ", f"JOIN {_x}3 ")
_EV3 = _EV3.replace("f.", "f3.").replace("h.", "h3.")
_MEANS = "SELECT 'bm25' AS mode, avg(hit_at_5) AS hit_at_5, avg(hit_at_10) AS hit_at_10, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM h JOIN n USING (query_id) UNION ALL SELECT 'top3', avg(hit_at_5), avg(hit_at_10), avg(mrr), avg(ndcg) FROM h3 JOIN n3 USING (query_id)"
put("evl_05_compare", _evl_05, Z.sql("bt qrels", f"""SELECT metric, round(a, 6) AS base, round(b, 6) AS other, round(b - a, 6) AS delta, CASE WHEN a > 0 THEN printf('%+.1f%%', 100 * (b - a) / a) ELSE 'n/a' END AS change FROM (
SELECT metric, max(value) FILTER (mode = 'bm25') AS a, max(value) FILTER (mode = 'top3') AS b FROM (UNPIVOT ({_MEANS}) ON hit_at_5, hit_at_10, mrr, ndcg INTO NAME metric VALUE value) GROUP BY metric)""", _EV + ",\n" + _EV3))
put("evl_06_failed", lambda s, d: E.failed_queries(Z.searches(s, d), Z.qrels(s, d, 0).select("query_id"), F.col("query_id") % 5 == 0), Z.sql("bq qrels", "SELECT query_id, text FROM bq WHERE query_id % 5 <> 0 AND query_id NOT IN (SELECT query_id FROM qrels)"))


def _gen_scores(s, d):
    x = F.col("doc_id") % 10 / 10
    return Z.table(s, d, "labels").select(F.when(F.col("doc_id") % 4 == 0, F.lit(float("nan"))).otherwise(0.8 + x / 5).alias("faithfulness"), F.when(F.col("doc_id") % 3 != 0, x).alias("answer_relevancy"), F.lit(None).cast("double").alias("context_recall"))


put("evl_07_generation", lambda s, d: E.generation_metrics(_gen_scores(s, d), {"faithfulness": 0.85, "answer_relevancy": 0.8, "context_recall": 0.5}).select("metric", r6("mean"), "n", "passed"),
    """WITH s AS (SELECT CASE WHEN doc_id % 4 <> 0 THEN 0.8::DOUBLE + doc_id % 10 / 10.0::DOUBLE / 5 END AS f, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 10 / 10.0::DOUBLE END AS a FROM labels)
    SELECT 'faithfulness' AS metric, round(avg(f), 6) AS mean, count(f) AS n, avg(f) >= 0.85 AS passed FROM s UNION ALL SELECT 'answer_relevancy', round(avg(a), 6), count(a), avg(a) >= 0.8 FROM s UNION ALL SELECT 'context_recall', NULL, 0, false""")  # fmt: skip


def _replies(s, d):
    k = F.col("doc_id")
    text = F.when(k % 7 == 0, "no json here").otherwise(F.concat(F.lit('Scores: {"faithfulness": '), k % 5 + 1, F.lit(', "relevance": '), k % 3 + 3, F.when(k % 2 == 0, F.concat(F.lit(', "completeness": '), k % 4 + 2)).otherwise(""), F.lit(', "clarity": 5}')))
    return Z.table(s, d, "labels").select(k.alias("sample_id"), text.alias("reply"))


put("evl_08_judge", lambda s, d: E.judged(_replies(s, d)).select("sample_id", *(F.col(c).cast("long").alias(c) for c in E.DIMENSIONS), r6("average"), "passed"),
    """WITH j AS (SELECT doc_id AS sample_id, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE doc_id % 5 + 1 END AS faithfulness, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE doc_id % 3 + 3 END AS relevance, CASE WHEN doc_id % 7 = 0 OR doc_id % 2 = 1 THEN 1 ELSE doc_id % 4 + 2 END AS completeness, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 5 END::BIGINT AS clarity FROM labels)
    SELECT *, round((faithfulness + relevance + completeness + clarity) / 4.0::DOUBLE, 6) AS average, (faithfulness + relevance + completeness + clarity) / 4.0 >= 3.5 AS passed FROM j""")  # fmt: skip
put("evl_08_judge_worst", lambda s, d: E.worst(E.judged(_replies(s, d))).select("sample_id", r6("average")),
    "SELECT doc_id AS sample_id, 1.0::DOUBLE AS average FROM labels WHERE doc_id % 7 = 0 ORDER BY doc_id LIMIT 3")


def _embedded(s, d):
    e = M.hashing_embedder()
    return P.with_embedding(Z.searches(s, d), e, "text"), P.with_embedding(Z.chunks(s, d), e, "content")


put("evl_09_pipeline", lambda s, d: P.evaluated(*_embedded(s, d), Z.qrels(s, d, 0), hold=DataFrame.persist))
put("fus_06_hybrid_search", lambda s, d: U.hybrid_search(*_embedded(s, d), k=10, now=Z.now()).select("query_id", "chunk_id", r6("combined_score"), "rank"))
