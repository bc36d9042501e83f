"""Queries of contexts, memory, classification, routing, caches, embedding jobs, feedback and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cache as H
from tessera.operators import chunk as C
from tessera.operators import classify as L
from tessera.operators import context as X
from tessera.operators import embed as E
from tessera.operators import feedback as B
from tessera.operators import memory as M
from tessera.operators import metrics as S
from tessera.operators import route as R
from tessera.operators.common import cut

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


# --- context


def _top(s, d):
    top = Z.chunks(s, d).select("chunk_id", "content").join(Z.held_hits(s, d, 12), "chunk_id")
    return top.select("query_id", "chunk_id", F.col("chunk_id").alias("document_id"), "content", "score", "rank")


_CX = """c0 AS (SELECT query_id, chunk_id, d.text AS content, score, rank, CASE query_id % 3 WHEN 0 THEN 800 WHEN 1 THEN 4000 ELSE 2000 END AS lim FROM bt JOIN documents d ON doc_id = chunk_id WHERE rank <= 10 AND score > 0),
c1 AS (SELECT *, lim * 4 AS most, sum(length(content)) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM c0),
c2 AS (SELECT *, coalesce(bool_or(upto > most) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM c1),
cx AS (SELECT *, CASE WHEN upto <= most THEN content WHEN most - (upto - length(content)) > 100 THEN substr(content, 1, (most - (upto - length(content)))::BIGINT) || '...' END AS body FROM c2 WHERE NOT gone AND (upto <= most OR most - (upto - length(content)) > 100))"""


def _built(s, d):
    kind = F.element_at(F.array(F.lit("simple"), F.lit("complex"), F.lit("default")), (F.col("query_id") % 3 + 1).cast("int"))
    return X.build(_top(s, d), X.budget(kind))


put("ctx_01_build", lambda s, d: _built(s, d).select("query_id", "rank", "text"), Z.sql("bt", "SELECT query_id, rank, body AS text FROM cx", _CX))
put("ctx_02_budget", lambda s, d: Z.user_turns(s, d).select("query_id", X.budget(X.query_type(F.element_at(F.array(*map(F.lit, ["simple", "faq", "complex"])), (F.col("query_id") % 3 + 1).cast("int"))), F.when(F.col("turn") == 2, 99)).cast("long").alias("tokens")),
    Z.sql("ut", "SELECT query_id, CASE WHEN turn = 2 THEN 99 WHEN query_id % 3 = 2 THEN 4000 ELSE 800 END::BIGINT AS tokens FROM ut"))
put("ctx_03_sources", lambda s, d: X.sources(_built(s, d)).withColumn("score", F.round("score", 6)), Z.sql("bt", "SELECT query_id, rank - 1 AS index, chunk_id AS document_id, chunk_id, round(score, 6) AS score FROM cx", _CX))


def _ctx_04(s, d):
    built = cut(_built(s, d))
    return X.joined(built).join(X.joined(built, numbered=True).withColumnRenamed("context", "numbered"), "query_id")


put("ctx_04_format", _ctx_04,
    Z.sql("bt", "SELECT query_id, string_agg(body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, string_agg('[' || rank || '] ' || body, chr(10) || chr(10) ORDER BY rank) AS numbered FROM cx GROUP BY query_id", _CX))
put("ctx_05_answer_sources", lambda s, d: X.answer_sources(_top(s, d)).select("query_id", "rank", "document_id", "preview"),
    Z.sql("bt", "SELECT query_id, rank, chunk_id AS document_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM bt JOIN documents ON doc_id = chunk_id WHERE rank <= 5 AND score > 0"))


def _prompts(s, d):
    kind = F.element_at(F.array(*map(F.lit, ["normal", "normal", "out_of_scope", "clarification", "brief"])), (F.col("query_id") % 5 + 1).cast("int"))
    own = Z.searches(s, d).join(X.joined(_built(s, d), "\n---\n").filter("query_id % 7 <> 0"), "query_id", "left")
    return own.withColumn("prompt", X.prompt(F.col("text"), F.col("context"), F.when(F.col("query_id") % 2 == 0, "user: hi"), kind, 200, {"brief": "Say $query in brief."}))


def _lit(t):
    return "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _fill(t):
    out = _lit(t)
    for k, c in (("query", "q.text"), ("context", "cut"), ("history", "'user: hi'")):
        out = out.replace(f"${k}", f"' || {c} || '")
    return out


_PR = f"""{_CX}, cj AS (SELECT query_id, string_agg(body, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM cx WHERE query_id % 7 <> 0 GROUP BY query_id),
pr AS (SELECT q.query_id, context, CASE WHEN q.query_id % 5 = 2 THEN {_fill(X.TEMPLATES['out_of_scope'])} WHEN q.query_id % 5 = 3 THEN {_fill(X.TEMPLATES['clarification'])} WHEN q.query_id % 5 = 4 THEN 'Say ' || q.text || ' in brief.'
WHEN context IS NULL THEN {_fill(X.TEMPLATES['no_context'])} WHEN q.query_id % 2 = 0 THEN {_fill(X.TEMPLATES['rag_history'])} ELSE {_fill(X.TEMPLATES['rag'])} END AS prompt
FROM bq q LEFT JOIN (SELECT *, CASE WHEN length(context) > 800 THEN substr(context, 1, 800) || '...' ELSE context END AS cut FROM cj) c ON c.query_id = q.query_id)"""
put("prm_01_prompt", lambda s, d: _prompts(s, d).select("query_id", "prompt"), Z.sql("bt", "SELECT query_id, prompt FROM pr", _PR))
put("prm_02_history", lambda s, d: X.rendered_history(Z.messages(s, d)),
    Z.sql("ms", "SELECT conversation_id, string_agg(role || ': ' || CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS r FROM ms QUALIFY r <= 3) GROUP BY conversation_id"))
put("prm_03_sizes", lambda s, d: X.prompt_sizes(_prompts(s, d).withColumn("full_chars", F.coalesce(F.length("context"), F.lit(0)))).select("query_id", "prompt_tokens", r6("reduction")),
    Z.sql("bt", "SELECT query_id, length(prompt) // 4 AS prompt_tokens, round(CASE WHEN coalesce(length(context), 0) // 4 > 0 THEN 1 - (length(prompt) // 4)::DOUBLE / (length(context) // 4) ELSE 0 END, 6) AS reduction FROM pr", _PR))

# --- memory
_MM = """b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conversation_id) AS n FROM ms),
su AS (SELECT conversation_id, string_agg(role || ': ' || substr(content, 1, 150 // (n - 3) * 4) || CASE WHEN length(content) > 150 // (n - 3) * 4 THEN '...' ELSE '' END, ' | ' ORDER BY turn) AS summary FROM b WHERE back > 3 GROUP BY conversation_id),
co AS (SELECT conversation_id, 0 AS position, 'system' AS role, 'Previous conversation summary: ' || summary AS content FROM su UNION ALL SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn), role, content FROM b WHERE back <= 3)"""
put("mem_01_compressed", lambda s, d: M.compressed(Z.messages(s, d)), Z.sql("ms", "SELECT conversation_id, position, role, content FROM co", _MM))
put("mem_02_summary", lambda s, d: M.summaries(Z.messages(s, d).filter("turn > 0")),
    Z.sql("ms", "SELECT conversation_id, string_agg(role || ': ' || substr(content, 1, 150 // n * 4) || CASE WHEN length(content) > 150 // n * 4 THEN '...' ELSE '' END, ' | ' ORDER BY turn) AS summary FROM (SELECT *, count(*) OVER (PARTITION BY conversation_id) AS n FROM ms WHERE turn > 0) GROUP BY conversation_id"))
put("mem_03_last", lambda s, d: M.last_messages(Z.messages(s, d), 2), Z.sql("ms", "SELECT conversation_id, turn, role, content FROM b WHERE back <= 2", _MM))
put("mem_04_tokens", lambda s, d: M.token_counts(Z.messages(s, d)).withColumn("reduction", F.round("reduction", 6)),
    Z.sql("ms", """SELECT conversation_id, messages, full_tokens, compressed_tokens, round(CASE WHEN full_tokens > 0 THEN 1 - compressed_tokens::DOUBLE / full_tokens ELSE 0 END, 6) AS reduction FROM
    (SELECT conversation_id, count(*) AS messages, sum(length(content) // 4)::BIGINT AS full_tokens FROM ms GROUP BY 1) JOIN (SELECT conversation_id, (sum(length(content)) // 4)::BIGINT AS compressed_tokens FROM co GROUP BY 1) USING (conversation_id)""", _MM))  # fmt: skip


def _mem_05(s, d):
    own = Z.messages(s, d)
    old = own.filter("conversation_id % 2 = 0")
    more = own.filter("turn < 2").select("conversation_id", "role", "content", F.col("turn").alias("at"))
    talks, rows = M.append(old.select("conversation_id").distinct(), old, more)
    n = rows.groupBy("conversation_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    return talks.join(n, "conversation_id")


put("mem_05_append", _mem_05, Z.sql("ms", """SELECT conversation_id, CASE WHEN conversation_id % 2 = 0 THEN count(*) ELSE 0 END + count(*) FILTER (turn < 2) AS messages, CASE WHEN conversation_id % 2 = 0 THEN max(turn) + 1 ELSE 0 END + count(*) FILTER (turn < 2) - 1 AS last_turn FROM ms GROUP BY conversation_id"""))


def _changes(s, d):
    own = Z.table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    stamp = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id"))
    return own.select("user_id", F.col("event_type").alias("key"), k.cast("string").alias("value"), stamp.alias("updated_at"), (k % 10 == 3).alias("deleted"))


put("prf_01_snapshot", lambda s, d: M.preferences(_changes(s, d), F.lit("2024-01-10 00:00:00").cast("timestamp"), 3650).select("user_id", F.concat_ws(",", F.transform(F.map_entries("preferences"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("preferences")),
    """WITH l AS (SELECT user_id, event_type AS key, json_extract_string(props, '$.k')::INT AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) + event_id DESC) AS r, ts FROM events QUALIFY r = 1)
    SELECT user_id, string_agg(key || '=' || k, ',' ORDER BY key) AS preferences FROM l WHERE k % 10 <> 3 AND epoch(TIMESTAMP '2024-01-10') - floor(epoch(ts)) < 3650 * 86400.0 GROUP BY user_id""")  # fmt: skip

# --- classification


def _asked(s, d):
    """User turns in ASCII, opened in many ways."""
    heads = ["", "what is ", "How do i get started ", "compare and contrast ", "define ", "why does it fail when ", "which is better, ", "password ", "steps to ", "where is "]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("query_id") % len(heads) + 1).cast("int"))
    body = F.regexp_replace("text", r"[^\x00-\x7F]|\n", "e")
    return Z.user_turns(s, d).select("query_id", F.concat(head, F.when(F.col("query_id") % 3 == 0, F.substring(body, 1, 8)).when(F.col("query_id") % 3 == 1, F.substring(body, 1, 90)).otherwise(body)).alias("text"))


_HEADS = "['', 'what is ', 'How do i get started ', 'compare and contrast ', 'define ', 'why does it fail when ', 'which is better, ', 'password ', 'steps to ', 'where is ']"


def _any(patterns):
    return " OR ".join("regexp_matches(low, '" + p.replace("'", "''") + "')" for p in patterns)


_CL = f"""a0 AS (SELECT conv_id * 1000 + turn AS query_id, regexp_replace(text, '[^\\x00-\\x7F]|\\n', 'e', 'g') AS body FROM conversations WHERE role = 'user'),
a1 AS (SELECT query_id, ({_HEADS})[query_id % 10 + 1] || CASE query_id % 3 WHEN 0 THEN substr(body, 1, 8) WHEN 1 THEN substr(body, 1, 90) ELSE body END AS text FROM a0),
a2 AS (SELECT *, trim(lower(text)) AS low, len(regexp_extract_all(text, '\\S+')) AS n FROM a1),
a3 AS (SELECT *, CASE {' '.join(f"WHEN {_any(p)} THEN '{k}'" for k, p in L.INTENTS.items())} ELSE 'factual' END AS intent,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN n <= 10 THEN -0.2::DOUBLE WHEN n >= 25 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END{''.join(f" + CASE WHEN {_any([p])} THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END" for p in L.COMPLEX)}{''.join(f" - CASE WHEN {_any([p])} THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END" for p in L.SIMPLE)})) AS complexity FROM a2),
a4 AS (SELECT *, CASE WHEN {_any(L.FAQ)} THEN 'faq' WHEN n <= 2 THEN 'ambiguous' WHEN complexity < 0.3::DOUBLE THEN 'simple' WHEN complexity > 0.7::DOUBLE THEN 'complex' WHEN intent = 'comparative' THEN 'complex' ELSE 'simple' END AS kind,
  CASE WHEN {_any(L.FAQ)} THEN 0.9::DOUBLE WHEN n <= 2 THEN 0.6::DOUBLE WHEN complexity < 0.3::DOUBLE THEN 0.9::DOUBLE - complexity WHEN complexity > 0.7::DOUBLE THEN complexity WHEN intent IN ('definition', 'factual', 'comparative') THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS sure FROM a3),
cl AS (SELECT *, NOT contains(low, 'blees') AS is_in_domain, CASE WHEN contains(low, 'blees') THEN 0.8 WHEN contains(low, 'tion') OR contains(low, 'ment') THEN 0.9 ELSE 0.6 END::DOUBLE AS domain_confidence,
  CASE WHEN contains(low, 'blees') THEN NULL WHEN contains(low, 'tion') THEN 'a' WHEN contains(low, 'ment') THEN 'b' END AS detected_domain,
  CASE WHEN contains(low, 'blees') THEN 'out_of_scope' ELSE kind END AS category, CASE WHEN contains(low, 'blees') THEN 0.8::DOUBLE ELSE sure END AS confidence FROM a4)"""


def _classified(s, d):
    return L.classify(_asked(s, d), domains={"a": ["Tion"], "b": ["ment"]}, out_of_scope=["BLEES"])


put("cls_01_intent", lambda s, d: _classified(s, d).select("query_id", "intent"), f"WITH {_CL} SELECT query_id, intent FROM cl")
put("cls_02_complexity", lambda s, d: _classified(s, d).select("query_id", r6("complexity")), f"WITH {_CL} SELECT query_id, round(complexity, 6) AS complexity FROM cl")
put("cls_03_category", lambda s, d: L.classify(_asked(s, d)).select("query_id", "category", r6("confidence")), f"WITH {_CL} SELECT query_id, kind AS category, round(sure, 6) AS confidence FROM cl")
put("cls_04_domain", lambda s, d: _classified(s, d).select("query_id", "is_in_domain", "domain_confidence", "detected_domain"), f"WITH {_CL} SELECT query_id, is_in_domain, domain_confidence, detected_domain FROM cl")
put("cls_05_hints", lambda s, d: _classified(s, d).select("query_id", "suggested_model", "use_cache", "needs_clarification"),
    f"WITH {_CL} SELECT query_id, CASE WHEN category = 'complex' THEN 'gpt-4' ELSE 'local' END AS suggested_model, category IN ('simple', 'faq') AS use_cache, category = 'ambiguous' AS needs_clarification FROM cl")
put("cls_06_classify", lambda s, d: _classified(s, d).groupBy("category", "intent").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")),
    f"WITH {_CL} SELECT category, intent, count(*) AS n, round(avg(confidence), 6) AS confidence FROM cl GROUP BY ALL")


def _cls_07(s, d):
    own = Z.embeddings(s, d)
    return L.by_example(Z.vector_queries(s, d), own.filter("id % 20 <> 0").select(F.col("label").cast("string").alias("category"), "embedding")).select("query_id", "category", r6("confidence"))


put("cls_07_by_example", _cls_07, Z.sql("vq", """SELECT query_id, CASE WHEN s > 0 THEN category ELSE 'simple' END AS category, round(greatest(s, 0), 6) AS confidence FROM (
SELECT query_id, e.label::VARCHAR AS category, round(list_dot_product(q, e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) AS s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, category DESC) AS r FROM vq, embeddings e WHERE e.vec_id % 20 <> 0 QUALIFY r = 1)"""))

# --- routing
_RT = f"""{_CL}, rt AS (SELECT *, CASE WHEN category IN ('out_of_scope', 'faq') THEN 'tier_1' WHEN confidence < 0.6::DOUBLE THEN CASE WHEN complexity <= 0.4::DOUBLE THEN 'tier_2' ELSE 'tier_3' END WHEN complexity <= 0.4::DOUBLE THEN 'tier_1' WHEN complexity <= 0.75::DOUBLE THEN 'tier_2' ELSE 'tier_3' END AS tier,
CASE WHEN category = 'out_of_scope' THEN 'out_of_scope' WHEN category = 'faq' THEN 'faq_query' WHEN confidence < 0.6::DOUBLE THEN 'uncertain' WHEN complexity <= 0.4::DOUBLE THEN 'simple_query' WHEN complexity <= 0.75::DOUBLE THEN 'moderate_query' ELSE 'complex_query' END AS reason,
CASE WHEN category IN ('out_of_scope', 'faq') THEN 0.9 WHEN confidence < 0.6::DOUBLE THEN 0.7 ELSE 0.85 END::DOUBLE AS route_confidence FROM cl)"""
_ROUTE = "CASE {0} WHEN 'tier_1' THEN 'gpt-3.5-turbo' WHEN 'tier_2' THEN 'gpt-4o-mini' ELSE 'gpt-4' END"
put("rte_01_route", lambda s, d: R.route(_classified(s, d)).select("query_id", "tier", "route", "reason", "route_confidence"), f"WITH {_RT} SELECT query_id, tier, {_ROUTE.format('tier')} AS route, reason, route_confidence FROM rt")


def _wishes(s, d):
    k = F.col("query_id") % 10
    return _classified(s, d).withColumns({"preferred_tier": F.when(k == 1, "tier_3"), "preferred_model": F.when(k == 2, "gpt-4o-mini").when(k == 4, "other"), "max_latency_ms": F.when(k == 3, 200).when(k == 5, 800)})


put("rte_02_overrides", lambda s, d: R.route(_wishes(s, d)).select("query_id", "tier", "reason"),
    f"WITH {_RT} SELECT query_id, CASE query_id % 10 WHEN 1 THEN 'tier_3' WHEN 2 THEN 'tier_2' WHEN 3 THEN 'tier_1' ELSE tier END AS tier, CASE query_id % 10 WHEN 1 THEN 'user_preference' WHEN 2 THEN 'user_preference' WHEN 3 THEN 'latency_requirement' ELSE reason END AS reason FROM rt")


def _available(s, d):
    up = s.range(1).select(F.lit(True).alias("tier1"), F.lit(False).alias("tier2"), F.lit(True).alias("tier3"))
    return R.apply_availability(R.route(_wishes(s, d)), up)


_T2 = f"{_RT}, av AS (SELECT query_id, text, CASE query_id % 10 WHEN 1 THEN 'tier_3' WHEN 2 THEN 'tier_2' WHEN 3 THEN 'tier_1' ELSE tier END AS was FROM rt), aw AS (SELECT *, CASE WHEN was = 'tier_2' THEN 'tier_1' ELSE was END AS now_ FROM av)"
put("rte_03_availability", lambda s, d: _available(s, d).select("query_id", "tier", "route", "is_fallback", "fallback_route"),
    f"WITH {_T2} SELECT query_id, now_ AS tier, {_ROUTE.format('now_')} AS route, was = 'tier_2' AS is_fallback, 'gpt-4o-mini' AS fallback_route FROM aw")


def _costed(s, d):
    return _available(s, d).withColumn("cost", R.cost(F.col("text"), F.col("route")))


_COST = "((len(regexp_extract_all(text, '\\S+')) * 1.3::DOUBLE + 500) / 1000 * CASE now_ WHEN 'tier_1' THEN 0.002::DOUBLE ELSE 0.03::DOUBLE END)"
put("rte_04_cost", lambda s, d: _costed(s, d).select("query_id", F.round("cost", 9).alias("cost")), f"WITH {_T2} SELECT query_id, round({_COST}, 9) AS cost FROM aw")
put("rte_05_stats", lambda s, d: R.stats(_costed(s, d)).select("total_queries", "tier1_queries", "tier2_queries", "tier3_queries", "fallbacks", r6("total_cost"), r6("savings"), r6("tier1_ratio"), r6("tier3_gap")),
    f"""WITH {_T2} SELECT count(*) AS total_queries, count(*) FILTER (now_ = 'tier_1') AS tier1_queries, 0::BIGINT AS tier2_queries, count(*) FILTER (now_ = 'tier_3') AS tier3_queries, count(*) FILTER (was = 'tier_2') AS fallbacks, round(sum({_COST}), 6) AS total_cost,
    round(sum((len(regexp_extract_all(text, '\\S+')) * 1.3::DOUBLE + 500) / 1000 * 0.03::DOUBLE) - sum({_COST}), 6) AS savings, round((count(*) FILTER (now_ = 'tier_1'))::DOUBLE / count(*), 6) AS tier1_ratio, round((count(*) FILTER (now_ = 'tier_3'))::DOUBLE / count(*) - 0.05::DOUBLE, 6) AS tier3_gap FROM aw""")  # fmt: skip
ADAPT = f"""RECURSIVE {_CL}, cq AS (SELECT query_id, category IN ('out_of_scope', 'faq') AS fixed, complexity AS c, confidence < 0.6::DOUBLE AS bump, (row_number() OVER (ORDER BY query_id) - 1) // 20 AS block FROM cl),
bl AS (SELECT block, list({{'c': c, 'fixed': fixed, 'bump': bump}}) AS h FROM cq GROUP BY block),
st AS (SELECT 0::BIGINT AS block, 0.4::DOUBLE AS t1, 0.75::DOUBLE AS t2, 0::BIGINT AS n1, 0::BIGINT AS n3, 0::BIGINT AS n UNION ALL
SELECT block + 1, t, CASE WHEN m < 20 THEN t2 WHEN n3 / n::DOUBLE > 0.05::DOUBLE + 0.02::DOUBLE THEN least(0.9::DOUBLE, t2 + 0.03::DOUBLE) WHEN n3 / n::DOUBLE < 0.05::DOUBLE - 0.02::DOUBLE THEN greatest(t + 0.1::DOUBLE, t2 - 0.03::DOUBLE) ELSE t2 END, n1, n3, n
FROM (SELECT *, CASE WHEN m < 20 THEN t1 WHEN n1 / n::DOUBLE < 0.7::DOUBLE - 0.05::DOUBLE THEN least(0.6::DOUBLE, t1 + 0.03::DOUBLE) WHEN n1 / n::DOUBLE > 0.7::DOUBLE + 0.05::DOUBLE THEN greatest(0.2::DOUBLE, t1 - 0.03::DOUBLE) ELSE t1 END AS t
FROM (SELECT st.block, t1, t2, n1 + len(list_filter(h, lambda x: x.fixed OR (x.c <= t1 AND NOT x.bump))) AS n1, n3 + len(list_filter(h, lambda x: NOT x.fixed AND (x.c > t2 OR (x.bump AND x.c > t1)))) AS n3, n + len(h) AS n, len(h) AS m FROM st JOIN bl USING (block))))"""
put("rte_06_adaptive", lambda s, d: R.adaptive(_classified(s, d), ["query_id"], every=20).select("query_id", "block", r6("tier1_max"), r6("tier2_max"), "tier"),
    f"WITH {ADAPT} SELECT query_id, block, round(t1, 6) AS tier1_max, round(t2, 6) AS tier2_max, CASE WHEN fixed THEN 'tier_1' WHEN bump THEN CASE WHEN c <= t1 THEN 'tier_2' ELSE 'tier_3' END WHEN c <= t1 THEN 'tier_1' WHEN c <= t2 THEN 'tier_2' ELSE 'tier_3' END AS tier FROM cq JOIN st USING (block)")

# --- embedding jobs and caches
put("emb_02_hashing", lambda s, d: E.hashing_embedder()(Z.chunks(s, d)).select("content", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding")))


def _emb_cache(s, d):
    """Even documents' texts are cached under two models."""
    own = Z.documents(s, d).filter("document_id % 2 = 0")
    model = F.when(F.col("document_id") % 4 == 0, "model-a").otherwise("model-b")
    return own.select(H.cache_key(F.col("text"), model).alias("cache_key"), H.content_hash(F.col("text")).alias("content_hash"), model.alias("model_id"), F.array(F.col("document_id").cast("float")).alias("embedding"), "created_at").dropDuplicates(["cache_key"])


def _wanted(s, d):
    return Z.documents(s, d).select("document_id", F.col("text").alias("content"), F.lit("model-a").alias("model_id"))


def _emb_01(s, d):
    own = _wanted(s, d).select("document_id", "content")
    out, cache = E.embed(own, E.hashing_embedder(), model_id="model-a", stored=_emb_cache(s, d), now=Z.now())
    return E.counts(out).crossJoin(cache.agg(F.count("*").alias("entries")))


put("emb_01_job", _emb_01, """WITH t AS (SELECT DISTINCT text FROM documents WHERE doc_id % 4 = 0), e AS (SELECT DISTINCT text, doc_id % 4 AS m FROM documents WHERE doc_id % 2 = 0)
SELECT count(*) FILTER (text IN (SELECT text FROM t)) AS cached, count(*) FILTER (text NOT IN (SELECT text FROM t)) AS generated, (SELECT count(DISTINCT text) FROM documents) + (SELECT count(*) FROM e WHERE m = 2) AS entries FROM documents""")
put("emb_03_batches", lambda s, d: E.batches(Z.embeddings(s, d), "id", 10, by="label").select("id", F.col("batch").cast("long").alias("batch")),
    "SELECT vec_id AS id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 10 AS batch FROM embeddings")
put("emb_04_keys", lambda s, d: Z.documents(s, d).select("document_id", H.content_hash(F.col("text")).alias("content_hash"), H.cache_key(F.col("text"), F.lit("model-a")).alias("cache_key"), H.generator_key(F.col("text"), F.lit("text-embedding")).alias("generator_key")),
    "SELECT doc_id AS document_id, substr(sha256(text), 1, 16) AS content_hash, substr(sha256('model-a:' || text), 1, 32) AS cache_key, 'text-emb:' || substr(sha256(text), 1, 16) AS generator_key FROM documents")


def _models(s):
    return s.createDataFrame([("small", 0.02, 8191, 2048), ("large", 0.13, 256, 100)], "model_id string, price_per_million double, max_tokens long, max_batch long")


put("emb_05_cost", lambda s, d: E.cost_estimate(Z.chunks(s, d), _models(s)).select("model_id", "total_tokens", F.round("cost", 9).alias("cost")),
    r"WITH t AS (SELECT sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS n FROM documents) SELECT m AS model_id, n AS total_tokens, round(n / 1000000.0::DOUBLE * p, 9) AS cost FROM t, (VALUES ('small', 0.02::DOUBLE), ('large', 0.13::DOUBLE)) v(m, p)")
put("emb_06_consistency", lambda s, d: E.model_mismatches(_emb_cache(s, d), _wanted(s, d)),
    "SELECT 'model-b' AS model_id, count(DISTINCT text) AS indexed, 0::BIGINT AS asked FROM documents WHERE doc_id % 4 = 2")
put("emb_07_fit", lambda s, d: E.model_fit(C.whole(Z.documents(s, d).select("document_id", "text")), _models(s)),
    r"WITH t AS (SELECT len(regexp_extract_all(text, '\S+')) AS n FROM documents) SELECT m AS model_id, count(*) FILTER (n > mt) AS too_long, least(100000 // greatest(floor(avg(n))::BIGINT, 100), mb)::BIGINT AS recommended_batch FROM t, (VALUES ('small', 8191, 2048), ('large', 256, 100)) v(m, mt, mb) GROUP BY m, mb")
_HAS = "EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 4 = 0 AND c.text = d.text)"
put("emc_01_lookup", lambda s, d: H.lookup(_wanted(s, d), _emb_cache(s, d)).select("document_id", "cache_key", F.col("embedding").isNotNull().alias("hit")),
    f"SELECT doc_id AS document_id, substr(sha256('model-a:' || text), 1, 32) AS cache_key, {_HAS} AS hit FROM documents d")
put("emc_02_misses", lambda s, d: H.misses(_wanted(s, d), _emb_cache(s, d)).select("document_id"), f"SELECT doc_id AS document_id FROM documents d WHERE NOT {_HAS}")


def _emc_03(s, d):
    new = _wanted(s, d).filter("document_id % 3 = 0").select("content", "model_id", F.array(F.lit(-1.0).cast("float")).alias("embedding"), Z.now().alias("created_at"))
    return H.put(_emb_cache(s, d), new).groupBy("model_id").agg(F.count("*").alias("n"), F.count_if(F.col("embedding")[0] < 0).alias("new"))


put("emc_03_put", _emc_03, """WITH o AS (SELECT DISTINCT text, CASE WHEN doc_id % 4 = 0 THEN 'model-a' ELSE 'model-b' END AS m FROM documents WHERE doc_id % 2 = 0), w AS (SELECT DISTINCT text, 'model-a' AS m FROM documents WHERE doc_id % 3 = 0)
SELECT m AS model_id, count(*) AS n, count(*) FILTER (new) AS new FROM (SELECT text, m, true AS new FROM w UNION ALL SELECT text, m, false FROM o WHERE (text, m) NOT IN (SELECT (text, m) FROM w)) GROUP BY m""")
_LIVE = "l AS (SELECT doc_id, doc_id % 30 AS day FROM documents WHERE (31 - doc_id % 30) * 86400 < 864000 ORDER BY day DESC, doc_id LIMIT 50)"
put("emc_04_ttl", lambda s, d: H.live(Z.documents(s, d), Z.now(), 864000, 50, "document_id").select("document_id"), f"WITH {_LIVE} SELECT doc_id AS document_id FROM l")
put("emc_05_invalidate", lambda s, d: H.invalidate(_emb_cache(s, d), _wanted(s, d).filter("document_id % 8 = 0")).groupBy("model_id").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN doc_id % 4 = 0 THEN 'model-a' ELSE 'model-b' END AS model_id, count(DISTINCT text) AS n FROM documents WHERE doc_id % 2 = 0 AND NOT (doc_id % 4 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 8 = 0)) GROUP BY 1")
put("emc_06_stats", lambda s, d: H.stats(H.lookup(_wanted(s, d), _emb_cache(s, d)), _emb_cache(s, d)).withColumn("hit_rate", F.round("hit_rate", 6)),
    f"SELECT count(*) FILTER ({_HAS}) AS hits, count(*) FILTER (NOT {_HAS}) AS misses, round(avg(CASE WHEN {_HAS} THEN 1 ELSE 0 END), 6) AS hit_rate, (SELECT count(*) FROM (SELECT DISTINCT text, doc_id % 4 FROM documents WHERE doc_id % 2 = 0)) AS size FROM documents d")

# --- response cache: vectors with even ids are cached, all are looked up


def _responses(s, d):
    own = Z.embeddings(s, d).filter("id % 2 = 0")
    text = F.concat(F.lit("Q "), F.col("id"))
    rows = own.select(H.query_hash(text).alias("query_hash"), text.alias("query"), F.when(F.col("id") % 10 == 0, " ").otherwise(F.concat(F.lit("r"), "id")).alias("response"), "embedding", F.timestamp_seconds(F.unix_timestamp(Z.now()) - F.col("id") * 60).alias("created_at"), "id")
    return rows


def _cached(s, d):
    return _responses(s, d).drop("id")


def _lookups(s, d):
    """All vectors by their own text; those with an odd id are the vector before them, moved towards their own, so that some are near enough and some are not."""
    own, before = Z.embeddings(s, d), Z.embeddings(s, d).select((F.col("id") + 1).alias("id"), F.col("embedding").alias("b"))
    part = 0.3 + F.col("id") % 10 / 40
    moved = F.zip_with("b", "embedding", lambda x, y: x.cast("double") + part * y.cast("double"))
    own = own.join(before, "id", "left").withColumn("embedding", F.when((F.col("id") % 2 != 0) & F.col("b").isNotNull(), moved).otherwise(F.col("embedding").cast("array<double>")))
    return own.select(F.col("id").alias("query_id"), F.concat(F.lit(" q "), F.col("id"), F.lit(" ")).alias("text"), "embedding")


def _own_lookups(s, d):
    """Every vector as it is, by its own text: at a threshold of 0.25 most have a cached one near enough."""
    return Z.embeddings(s, d).select(F.col("id").alias("query_id"), F.concat(F.lit(" q "), F.col("id"), F.lit(" ")).alias("text"), "embedding")


_RC = """rc AS (SELECT vec_id AS id, 'q ' || vec_id AS q, 'Q ' || vec_id AS query, 'r' || vec_id AS response, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 10 <> 0),
lk AS (SELECT o.vec_id AS query_id, 'q ' || o.vec_id AS q, CASE WHEN o.vec_id % 2 <> 0 AND b.embedding IS NOT NULL THEN list_transform(list_zip(b.embedding::DOUBLE[], o.embedding::DOUBLE[]), lambda x: x[1] + (0.3::DOUBLE + (o.vec_id % 10)::DOUBLE / 40) * x[2]) ELSE o.embedding::DOUBLE[] END AS e FROM embeddings o LEFT JOIN embeddings b ON b.vec_id + 1 = o.vec_id),
ex AS (SELECT query_id, response, substr(sha256(lk.q), 1, 16) AS query_hash FROM lk JOIN rc ON lk.q = rc.q),
ne AS (SELECT query_id, lk.q, rc.q AS cq, rc.id, rc.response, list_dot_product(lk.e, rc.e) / (sqrt(list_dot_product(lk.e, lk.e)) * sqrt(list_dot_product(rc.e, rc.e)) + 1e-9) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, substr(sha256(rc.q), 1, 16)) AS r FROM lk, rc QUALIFY r = 1),
se AS (SELECT * FROM ne WHERE query_id NOT IN (SELECT query_id FROM ex) AND round(s, 9) >= 0.92),
re AS (SELECT lk.query_id, ex.query_id IS NOT NULL OR se.query_id IS NOT NULL AS hit, CASE WHEN ex.query_id IS NOT NULL THEN 'exact' WHEN se.query_id IS NOT NULL THEN 'semantic' ELSE 'miss' END AS layer, round(CASE WHEN ex.query_id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(s, 0) END, 6) AS similarity, coalesce(ex.response, se.response) AS response FROM lk LEFT JOIN ex USING (query_id) LEFT JOIN se USING (query_id))"""
_LK = _RC[_RC.index("lk AS (") : _RC.index("\nex AS (")]
_RC_OWN = _RC.replace(_LK, "lk AS (SELECT vec_id AS query_id, 'q ' || vec_id AS q, embedding::DOUBLE[] AS e FROM embeddings),").replace("round(s, 9) >= 0.92", "round(s, 9) >= 0.25")
put("sca_01_exact", lambda s, d: H.exact_hits(_lookups(s, d), _cached(s, d)), f"WITH {_RC} SELECT query_id, query_hash, response FROM ex")
put("sca_02_semantic", lambda s, d: H.semantic_hits(_own_lookups(s, d), _cached(s, d), H.exact_hits(_own_lookups(s, d), _cached(s, d)), 0.25).select("query_id", "query_hash", r6("similarity")),
    f"WITH {_RC_OWN} SELECT query_id, substr(sha256(cq), 1, 16) AS query_hash, round(s, 6) AS similarity FROM se")


def _sca_03(s, d):
    near = H.semantic_hits(_own_lookups(s, d), _cached(s, d), H.exact_hits(_own_lookups(s, d), _cached(s, d)), 0.25)
    return H.validated(near, _own_lookups(s, d), _cached(s, d), threshold=0.3).select("query_id", r6("similarity"))


put("sca_03_validated", _sca_03, f"WITH {_RC_OWN} SELECT query_id, round(s, 6) AS similarity FROM se WHERE 1.0 / 3 >= 0.3")
put("sca_04_ttl", lambda s, d: H.live(_responses(s, d), Z.now(), 3600, key="query_hash").select("id"), "SELECT vec_id AS id FROM embeddings WHERE vec_id % 2 = 0 AND vec_id < 60")


def _sca_05(s, d):
    new = Z.embeddings(s, d).filter("id % 3 = 0").select(F.concat(F.lit("Q "), F.col("id")).alias("query"), F.when(F.col("id") % 9 == 0, "").otherwise("new").alias("response"), "embedding", Z.now().alias("created_at"))
    return H.put_responses(_cached(s, d), new).select("query_hash", "response")


put("sca_05_put", _sca_05, """WITH w AS (SELECT substr(sha256('q ' || vec_id), 1, 16) AS query_hash, 'new' AS response FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 9 <> 0),
o AS (SELECT substr(sha256('q ' || vec_id), 1, 16) AS query_hash, CASE WHEN vec_id % 10 = 0 THEN ' ' ELSE 'r' || vec_id END AS response FROM embeddings WHERE vec_id % 2 = 0)
SELECT * FROM w UNION ALL SELECT * FROM o WHERE query_hash NOT IN (SELECT query_hash FROM w)""")
put("sca_06_capacity", lambda s, d: H.live(_responses(s, d), Z.now(), 10**9, 25, "id").select("id"), "SELECT vec_id AS id FROM embeddings WHERE vec_id % 2 = 0 ORDER BY vec_id LIMIT 25")
put("sca_07_lookup", lambda s, d: H.respond(_own_lookups(s, d), _cached(s, d), 0.25).withColumn("similarity", F.round("similarity", 6)), f"WITH {_RC_OWN} SELECT * FROM re")
put("sca_08_stats", lambda s, d: H.response_stats(H.respond(_lookups(s, d), _cached(s, d)), _cached(s, d)).withColumn("hit_rate", F.round("hit_rate", 6)),
    f"WITH {_RC} SELECT count(*) FILTER (layer = 'exact') AS exact_hits, count(*) FILTER (layer = 'semantic') AS semantic_hits, count(*) FILTER (NOT hit) AS misses, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS hit_rate, (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0) AS size FROM re")


def _sca_09(s, d):
    grid = s.createDataFrame([(0.5,), (0.85,), (0.92,), (0.999,)], "threshold double")
    return H.threshold_sweep(_lookups(s, d), _cached(s, d), grid).withColumn("hit_rate", F.round("hit_rate", 6))


put("sca_09_sweep", _sca_09, f"WITH {_RC} SELECT t AS threshold, count(*) FILTER (round(s, 9) >= t) AS hits, count(*) AS lookups, round((count(*) FILTER (round(s, 9) >= t))::DOUBLE / count(*), 6) AS hit_rate FROM ne, (VALUES (0.8::DOUBLE), (0.85::DOUBLE), (0.92::DOUBLE), (0.99::DOUBLE)) v(t) GROUP BY t")

# --- feedback and metrics
put("fbk_01_normalize", lambda s, d: B.normalize(Z.feedback(s, d)).select("query_id", F.col("rating").cast("long").alias("rating"), "reject_reason"),
    Z.sql("fb0", "SELECT query_id, rating::BIGINT AS rating, CASE WHEN NOT rating BETWEEN 1 AND 5 THEN 'rating out of range' END AS reject_reason FROM fb0"))


def _good(s, d):
    return B.normalize(Z.feedback(s, d)).filter("reject_reason IS NULL")


put("fbk_02_stats", lambda s, d: B.stats(_good(s, d), Z.now(), 20).withColumns({"average": F.round("average", 6), "up_rate": F.round("up_rate", 6)}),
    Z.sql("fb0", f"SELECT count(*) AS total, count(*) FILTER (rating = 5) AS thumbs_up, count(*) FILTER (rating = 1) AS thumbs_down, round(avg(rating), 6) AS average, {', '.join(f'count(*) FILTER (rating = {i}) AS rating_{i}' for i in range(1, 6))}, round((count(*) FILTER (rating = 5))::DOUBLE / count(*) FILTER (rating IN (1, 5)), 6) AS up_rate FROM fb0 WHERE rating BETWEEN 1 AND 5 AND created_at >= TIMESTAMP '2024-01-12'"))


def _fbk_03(s, d):
    logs = Z.documents(s, d).select(F.col("document_id").alias("query_id"), F.col("text").alias("query"), F.when(F.col("document_id") % 5 != 0, F.lower("text")).alias("response"))
    return B.evaluation_set(_good(s, d), logs, limit=50).withColumn("rating", F.col("rating").cast("long"))


put("fbk_03_export", _fbk_03, Z.sql("fb0", "SELECT query_id, text AS query, lower(text) AS response, rating::BIGINT AS rating, CASE WHEN comment <> '' THEN comment END AS comment FROM fb0 JOIN documents ON doc_id = query_id WHERE rating BETWEEN 4 AND 5 AND doc_id % 5 <> 0 ORDER BY created_at DESC, query_id LIMIT 50"))
put("met_01_requests", lambda s, d: S.request_counts(Z.events(s, d)), Z.sql("ev", "SELECT endpoint, status, count(*) AS requests FROM ev GROUP BY ALL"))
_LE = ", ".join(f"({b}::DOUBLE)" for b in S.BUCKETS["request"]) + ", ('inf'::DOUBLE)"
put("met_02_histogram", lambda s, d: S.histogram(Z.events(s, d), "endpoint", "latency", S.BUCKETS["request"]).withColumn("total_sum", F.round("total_sum", 6)),
    Z.sql("ev", f"SELECT endpoint, le, count(*) FILTER (latency <= le) AS bucket_count, count(*) AS total_count, round(sum(latency), 6) AS total_sum FROM ev, (VALUES {_LE}) v(le) GROUP BY ALL"))
put("met_03_quantiles", lambda s, d: S.quantiles(Z.events(s, d), "endpoint", "latency").select("endpoint", r6("p50"), r6("p99")),
    Z.sql("ev", "SELECT endpoint, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.99), 6) AS p99 FROM ev GROUP BY endpoint"))


def _met_03_sketched(s, d):
    """Quantiles from sketches of hours, merged over all time, held against the log: whether each stands within 2 % of the ranks asked for."""
    logs = Z.events(s, d)
    told = S.sketched_quantiles(S.merged_sketches(S.quantile_sketches(logs, "endpoint", "latency"), "endpoint"), "endpoint")
    share = lambda q: F.count_if(F.col("latency") <= F.col(q)) / F.count("*")
    met = logs.join(F.broadcast(told), "endpoint").groupBy("endpoint").agg(F.count("*").alias("n"), share("p50").alias("a"), share("p99").alias("b"))
    return met.select("endpoint", "n", (F.abs(F.col("a") - 0.5) <= 0.02).alias("p50_within"), (F.abs(F.col("b") - 0.99) <= 0.02).alias("p99_within"))


put("met_03_sketched", _met_03_sketched, Z.sql("ev", "SELECT endpoint, count(*) AS n, true AS p50_within, true AS p99_within FROM ev GROUP BY endpoint"))
put("met_04_tokens", lambda s, d: S.token_usage(Z.events(s, d)), Z.sql("ev", "SELECT model, 'prompt' AS type, sum(prompt_tokens)::BIGINT AS tokens FROM ev GROUP BY model UNION ALL SELECT model, 'completion', sum(completion_tokens)::BIGINT FROM ev GROUP BY model"))
put("met_05_cache", lambda s, d: S.cache_hit_rates(Z.events(s, d).withColumnRenamed("endpoint", "cache_type")).withColumn("hit_rate", F.round("hit_rate", 6)),
    Z.sql("ev", "SELECT endpoint AS cache_type, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(avg(hit::INT), 6) AS hit_rate FROM ev GROUP BY 1"))
put("met_06_routing", lambda s, d: S.routing_distribution(Z.events(s, d).withColumnRenamed("model", "route")).withColumn("share", F.round("share", 6)),
    Z.sql("ev", "SELECT model AS route, count(*) AS queries, round(count(*)::DOUBLE / (SELECT count(*) FROM ev), 6) AS share FROM ev GROUP BY 1"))
put("met_07_cost", lambda s, d: S.cost_by_model(Z.events(s, d)).withColumn("cost", F.round("cost", 6)), Z.sql("ev", "SELECT model, round(sum(cost), 6) AS cost FROM ev GROUP BY 1"))


def _query_events(s, d):
    kind = F.element_at(F.array(*map(F.lit, ["start", "retrieval", "generation", "cache_hit", "error"])), (F.col("event_id") % 5 + 1).cast("int"))
    return Z.events(s, d).select(F.floor(F.col("event_id") / 5).alias("query_id"), F.timestamp_seconds(F.col("event_id")).alias("ts"), kind.alias("kind"), F.col("k").cast("string").alias("payload"))


put("met_08_assembly", lambda s, d: S.assemble_logs(_query_events(s, d)).select("query_id", "events", "start", "retrieval", "generation", "cache_hit", "error", (F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")).alias("seconds")),
    Z.sql("ev", "SELECT event_id // 5 AS query_id, count(*) AS events, " + ", ".join(f"max(k::VARCHAR) FILTER (event_id % 5 = {i}) AS {n}" for i, n in enumerate(["start", "retrieval", "generation", "cache_hit", "error"])) + ", max(event_id) - min(event_id) AS seconds FROM ev GROUP BY 1"))


def _requests(s, d):
    return Z.events(s, d).select("client", F.floor(F.unix_timestamp("ts")).cast("double").alias("ts"), F.col("event_id").alias("request_id"))


#: The limiter in turn: each step of the recursion takes the next request of every client.
LIMITER = """RECURSIVE ev0 AS (SELECT event_id AS request_id, user_id AS client, floor(epoch(ts)) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
st AS (SELECT DISTINCT client, 0::BIGINT AS n, []::DOUBLE[] AS kept, 0.0::DOUBLE AS ts, 0::BIGINT AS request_id, true AS allowed, 0::BIGINT AS retry_after FROM ev0
UNION ALL SELECT client, n, CASE WHEN len(k) < 3 THEN list_append(k, ts) ELSE k END, ts, request_id, len(k) < 3, CASE WHEN len(k) < 3 THEN 0 ELSE greatest(0, floor(172800 - (ts - list_min(k))))::BIGINT END
FROM (SELECT e.client, e.n, e.ts, e.request_id, list_filter(st.kept, lambda t: t > e.ts - 172800) AS k FROM st JOIN ev0 e ON e.client = st.client AND e.n = st.n + 1))"""
put("lim_01_rate_limit", lambda s, d: S.rate_limit(_requests(s, d), most=3, window=172800),
    f"WITH {LIMITER} SELECT client, ts, request_id, allowed, retry_after FROM st WHERE n > 0")
put("lim_01_sliding", lambda s, d: S.sliding_counts(_requests(s, d), 172800).select("request_id", "in_window"),
    Z.sql("ev", "SELECT event_id AS request_id, count(*) OVER (PARTITION BY client ORDER BY floor(epoch(ts)) RANGE BETWEEN 172799 PRECEDING AND CURRENT ROW) AS in_window FROM ev"))


def _pip_01(s, d):
    e = E.hashing_embedder()
    chunks = P.with_embedding(Z.chunks(s, d).select("chunk_id", "document_id", "content", "created_at"), e, "content")
    asked = Z.user_turns(s, d).select("query_id", "text")
    answered = Z.user_turns(s, d).filter("conv_id % 2 = 0").select(H.query_hash(F.col("text")).alias("query_hash"), F.col("text").alias("query"), F.lit("cached").alias("response"), "text").dropDuplicates(["query_hash"])
    stored = P.with_embedding(answered, e, "text").select("query_hash", "query", "response", "embedding", Z.now().alias("created_at"))
    return P.answers(asked, chunks, e, stored, k=5, hold=cut)


QUERIES["pip_01_answers"] = _pip_01
