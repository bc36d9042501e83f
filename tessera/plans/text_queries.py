"""Queries of the sources, the cleaning steps, chunking and the document table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunk as C
from tessera.operators import delta as A
from tessera.operators import embed as E
from tessera.operators.common import shared_dir
from tessera.sources import documents as D

from . import frames as Z

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# a tail with every kind of character that cleaning meets
_TAIL = "  ​“q”­ «x» – z\tt \x07 https://a.example/b?c=d e@f.example.com +1 555-123-4567 \n\n\n\n ! "
_DIRTY_SQL = (
    "d AS (SELECT doc_id, text || '  ' || chr(8203) || chr(8220) || 'q' || chr(8221) || chr(173) || ' ' || chr(171) || 'x' || chr(187) || ' ' || chr(8211) || ' z' || chr(9) || 't ' || chr(7)"
    " || ' https://a.example/b?c=d e@f.example.com +1 555-123-4567 ' || chr(10) || chr(10) || chr(10) || chr(10) || ' ! ' AS t FROM documents)"
)
_CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{AD}\p{Cf}\p{Co}]"
_ZW = "chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(173)"
_Q_FROM = " || ".join(f"chr({ord(c)})" for c in T.QUOTES)
_Q_TO = "".join(T.QUOTES.values()).replace("'", "''")
_D_FROM = " || ".join(f"chr({ord(c)})" for c in T.DASHES)
_WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_URL = r"(?i)https?://(?:[-\w.]|(?:%[\da-f]{2}))+[^\s]*"
_EMAIL = T.EMAIL
_PHONE = T.PHONE


def _rx(x: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', {to}, 'g')"


def _strip(x: str) -> str:
    return _rx(x, rf"^{_WHITE}+|{_WHITE}+$")


def _ws(x: str) -> str:
    return _rx(_rx(x, r"[ \t]+", "' '"), r" *\n *", "chr(10)")


def _base(x: str) -> str:
    quotes = f"translate({_zw(_rx(x, _CTRL))}, {_Q_FROM}, '{_Q_TO}')"
    return f"translate({quotes}, {_D_FROM}, '------')"


def _zw(x: str) -> str:
    return f"translate({x}, {_ZW}, '')"


def _newlines(x: str) -> str:
    return _rx(x, r"\n{3,}", "chr(10) || chr(10)")


def _dirty(spark, sf_dir):
    return Z.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(_TAIL)).alias("t"))


def _ascii(c):
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


_ASCII = _rx("t", r"[^\x00-\x7F]")
_STEPS = {
    "pre_01_unicode_nfc": (lambda c: T.normalize_unicode(c, "NFC"), "nfc_normalize(t)"),
    "pre_02_control": (T.strip_control, _rx("t", _CTRL)),
    "pre_03_zero_width": (T.strip_zero_width, _zw("t")),
    "pre_04_quotes": (T.normalize_quotes, f"translate(t, {_Q_FROM}, '{_Q_TO}')"),
    "pre_05_dashes": (T.normalize_dashes, f"translate(t, {_D_FROM}, '------')"),
    "pre_06_urls": (T.remove_urls, _rx("t", _URL, "' '")),
    "pre_07_emails": (lambda c: T.remove_emails(_ascii(c)), _rx(_ASCII, _EMAIL, "' '")),
    "pre_08_phones": (T.remove_phones, _rx("t", _PHONE, "' '")),
    "pre_09_whitespace": (T.normalize_whitespace, _ws("t")),
    "pre_10_newlines": (T.collapse_newlines, _newlines("t")),
    "pre_11_patterns": (lambda c: T.remove_patterns(c, ["[0-9]+", "(?:the|der) "]), _rx(_rx("t", "[0-9]+"), "(?:the|der) ")),
    "pre_12_clean": (lambda c: T.clean(c, None, urls=True, phones=True), _strip(_newlines(_ws(_rx(_rx(_base("t"), _URL, "' '"), _PHONE, "' '"))))),
    "pre_13_clean_light": (lambda c: T.clean_for_embedding(c, "NFC"), _strip(_ws(_zw("nfc_normalize(t)")))),
    "pre_14_extract": (
        lambda c: F.concat_ws("|", F.coalesce(T.found_urls(c), F.array()), F.coalesce(T.found_emails(_ascii(c)), F.array())),
        f"array_to_string(list_concat(regexp_extract_all(t, '{_URL}'), regexp_extract_all({_ASCII}, '{_EMAIL}')), '|')",
    ),
    "pre_15_headers": (
        lambda c: T.drop_headers_footers(c, "The ", "[A-Z]nd "),
        "CASE WHEN len(string_split(t, chr(10))) > 6 THEN array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^(?:The )|^(?:[A-Z]nd )')), chr(10)) ELSE t END",
    ),
}
for _name, (_f, _s) in _STEPS.items():
    QUERIES[_name] = lambda spark, sf_dir, f=_f: _dirty(spark, sf_dir).select("doc_id", f(F.col("t")).alias("out"))
    ORACLE[_name] = f"WITH {_DIRTY_SQL} SELECT doc_id, {_s} AS out FROM d"
QUERIES["pre_01_unicode"] = lambda spark, sf_dir: _dirty(spark, sf_dir).select("doc_id", T.normalize_unicode(F.col("t")).alias("out"))

# --- chunking


def _docs(spark, sf_dir):
    return Z.documents(spark, sf_dir).select("document_id", "text", "source")


_OUT = "chunk_id, document_id, content, start_char, end_char, chunk_index, total_chunks, token_count"
_ID = "'chunk_' || substr(md5(document_id::VARCHAR || ':' || start_char || ':' || substr(content, 1, 100)), 1, 12)"


def _fixed_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return rf"""
WITH p AS (SELECT doc_id AS document_id, regexp_extract_all(text, '\S+\s*') AS p FROM documents),
s AS (SELECT document_id, p, unnest(range(0, 1 + ceil(greatest(len(p) - {size}, 0) / {step}.0)::BIGINT)) AS i FROM p WHERE len(p) > 0),
c AS (SELECT document_id, i, regexp_replace(array_to_string(p[i * {step} + 1 : i * {step} + {size}], ''), '\s+$', '') AS content, length(array_to_string(p[1 : i * {step}], '')) AS start_char FROM s)
SELECT {_ID} AS chunk_id, document_id, content, start_char::BIGINT AS start_char, (start_char + length(content))::BIGINT AS end_char, i AS chunk_index,
  count(*) OVER (PARTITION BY document_id) AS total_chunks, len(regexp_extract_all(content, '\S+'))::BIGINT AS token_count FROM c"""


def _separated_sql(separators: list[str], size: int, overlap: int) -> str:
    """Pieces by separator after separator, then the chunks in turn: each step of the recursion ends one chunk."""
    tok = lambda x: rf"len(regexp_extract_all({x}, '\S+'))"
    quoted = [" || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in sep) for sep in separators]
    cuts = "".join(f""", p{k + 1} AS (SELECT document_id, flatten(list_transform(p, lambda x: CASE WHEN {tok('x')} <= {size} THEN [x] ELSE
list_transform(string_split(x, {sep}), lambda y, i: CASE WHEN i < len(string_split(x, {sep})) THEN y || {sep} ELSE y END) END)) AS p FROM p{k})""" for k, sep in enumerate(quoted))
    return rf"""
WITH RECURSIVE p0 AS (SELECT doc_id AS document_id, [text] AS p FROM documents WHERE text IS NOT NULL){cuts},
q AS (SELECT document_id, list_filter(p, lambda x: x <> '') AS p FROM p{len(separators)}),
n AS (SELECT document_id, p, len(p) AS m, list_transform(p, lambda x: {tok('x')}) AS t FROM q WHERE len(p) > 0),
u AS (SELECT *, list_transform(range(0, m + 1), lambda k: coalesce(list_sum(t[1:k]), 0)::BIGINT) AS upto FROM n),
r AS (SELECT document_id, 0::BIGINT AS i, 0::BIGINT AS j, NULL::BIGINT AS a, NULL::BIGINT AS b, false AS over FROM u
UNION ALL SELECT document_id, CASE WHEN e >= m THEN i WHEN room < 0 THEN e ELSE greatest(i, list_position(list_transform(upto, lambda x: x >= upto[e + 1] - room), true) - 1) END, e + 1, i, least(e, m), e >= m
FROM (SELECT *, CASE WHEN e < m THEN least({overlap}, {size} - t[e + 1]) END AS room
FROM (SELECT r.document_id, i, m, t, upto, CASE WHEN j >= m THEN m ELSE greatest(j, len(list_filter(upto, lambda x: x <= upto[i + 1] + {size})) - 1) END AS e FROM r JOIN u USING (document_id) WHERE NOT over))),
c AS (SELECT document_id, regexp_replace(array_to_string(p[a + 1 : b], ''), '\s+$', '') AS content, length(array_to_string(p[1:a], '')) AS start_char, a, b FROM r JOIN u USING (document_id) WHERE b > a),
d AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY a, b) - 1 AS i FROM c WHERE {_strip('content')} <> '')
SELECT {_ID} AS chunk_id, document_id, content, start_char::BIGINT AS start_char, (start_char + length(content))::BIGINT AS end_char, i AS chunk_index,
  count(*) OVER (PARTITION BY document_id) AS total_chunks, {tok('content')}::BIGINT AS token_count FROM d"""


def _put(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


_put("chk_01_fixed", lambda s, d: C.fixed(_docs(s, d), size=128, overlap=16), _fixed_sql(128, 16))
_put("chk_02_recursive", lambda s, d: C.by_separators(_docs(s, d), size=128, overlap=16), _separated_sql(C.RECURSIVE, 128, 16))
_put("chk_03_sentence", lambda s, d: C.sentence(_docs(s, d), size=128, overlap=16), _separated_sql(C.SENTENCE, 128, 16))
_put("chk_04_semantic", lambda s, d: C.semantic(_docs(s, d), size=512, overlap=50, model_max_tokens=256), _fixed_sql(256, 50))
_put(
    "chk_05_page", lambda s, d: C.pages(_docs(s, d), separator="\n", cleaned=lambda c: T.strip(T.normalize_whitespace(c))),
    rf"""WITH p AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS p FROM documents), q AS (SELECT document_id, unnest(range(1, len(p) + 1)) AS k, p FROM p),
    c AS (SELECT document_id, {_strip(_ws('p[k]'))} AS content, k AS page_number FROM q)
    SELECT document_id, content, page_number, len(regexp_extract_all(content, '\S+'))::BIGINT AS token_count FROM c WHERE content <> ''""",
)
_put(
    "chk_06_document", lambda s, d: C.whole(_docs(s, d)),
    rf"""WITH c AS (SELECT doc_id AS document_id, text AS content, 0 AS start_char FROM documents WHERE text IS NOT NULL AND {_strip('text')} <> '')
    SELECT {_ID} AS chunk_id, document_id, content, 0::BIGINT AS start_char, length(content) AS end_char, 0::BIGINT AS chunk_index, 1::BIGINT AS total_chunks, len(regexp_extract_all(content, '\S+'))::BIGINT AS token_count FROM c""",
)
_put(
    "chk_07_chunk_id", lambda s, d: _docs(s, d).select("document_id", C.chunk_id(F.col("document_id").cast("string"), F.lit(7), F.col("text")).alias("chunk_id")),
    "SELECT doc_id AS document_id, 'chunk_' || substr(md5(doc_id::VARCHAR || ':7:' || substr(text, 1, 100)), 1, 12) AS chunk_id FROM documents",
)
_put(
    "chk_08_tokens", lambda s, d: _docs(s, d).select("document_id", T.token_count(F.col("text")).alias("tokens"), T.estimated_tokens(F.col("text")).alias("estimate")),
    r"SELECT doc_id AS document_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS tokens, length(text) // 4 AS estimate FROM documents",
)


def _lines(spark, sf_dir):
    cut = F.transform(F.split("text", "\n"), lambda x: F.struct(F.when(F.length(x) % 2 == 0, x).otherwise(" ").alias("content"), F.lit(0).alias("start_char")))
    return C.finish(_docs(spark, sf_dir).withColumn("chunks", cut), ["source"])


_put(
    "chk_09_finish", _lines,
    rf"""WITH p AS (SELECT doc_id AS document_id, source, list_filter(string_split(text, chr(10)), lambda x: length(x) % 2 = 0 AND {_strip('x')} <> '') AS p FROM documents),
    c AS (SELECT document_id, source, 0 AS start_char, unnest(range(1, len(p) + 1)) AS k, p FROM p), e AS (SELECT *, p[k] AS content FROM c)
    SELECT {_ID} AS chunk_id, document_id, source, content, 0::BIGINT AS start_char, length(content) AS end_char, k - 1 AS chunk_index, len(p)::BIGINT AS total_chunks, len(regexp_extract_all(content, '\S+'))::BIGINT AS token_count FROM e""",
)

# --- sources


def _src_01(spark, sf_dir):
    own = Z.table(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".TXT"))
    m = D.described(name, F.octet_length("text"))
    return own.select(F.col("doc_id").alias("document_id"), "text", F.lit(1).cast("long").alias("page_count"), m["filename"].alias("filename"), m["file_type"].alias("file_type"), m["file_size"].alias("file_size"))


_put("src_01_text", _src_01, "SELECT doc_id AS document_id, text, 1::BIGINT AS page_count, doc_id || '.TXT' AS filename, '.txt' AS file_type, strlen(text)::VARCHAR AS file_size FROM documents")
_HTML = _rx(_rx("html", r"(?is)<(script|style)\b.*?</(script|style)\s*>"), r"(?s)<!--.*?-->|<[^>]*>", "chr(10)")
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_e}', '{_c}')"
_put(
    "src_02_html", lambda s, d: D.html_documents(Z.table(s, d, "pages")),
    rf"SELECT page_id::VARCHAR AS document_id, array_to_string(list_filter(list_transform(string_split_regex({_HTML}, '\r\n|\r|\n'), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10)) AS text FROM pages",
)


def _src_03(spark, sf_dir):
    """The customers of each nation as a CSV file, and each file read as a document."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    own = Z.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    own.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").write.option("header", True).partitionBy("c_nationkey").csv(path)
    return D.csv_files(spark, path).withColumn("document_id", F.regexp_extract("document_id", r"c_nationkey=(\d+)", 1))


_put(
    "src_03_rows", _src_03,
    "SELECT c_nationkey::VARCHAR AS document_id, string_agg(concat_ws(' ', c_custkey::VARCHAR, c_name, c_mktsegment, c_nationkey::VARCHAR), chr(10) ORDER BY c_custkey) AS text, count(*) AS n_rows FROM customer GROUP BY 1",
)


def _sets(spark, sf_dir):
    row = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.lit("c").alias("category"), F.when(F.col("item_id") % 2 == 0, "hard").alias("difficulty"))
    path = f"{shared_dir(spark)}/sets-{uuid.uuid4().hex}"
    some = Z.table(spark, sf_dir, "benchmark").groupBy((F.col("item_id") % 4).alias("part")).agg(F.to_json(F.struct(F.collect_list(row).alias("queries"))).alias("value"))
    some.repartition("part").write.partitionBy("part").text(path)  # a file for each set
    return D.eval_files(spark, path)


_put(
    "src_04_eval_sets", lambda s, d: D.eval_queries(_sets(s, d)).select("id", "query", "category", "difficulty", F.size("relevant_doc_ids").cast("long").alias("n_relevant"), "ground_truth"),
    "SELECT item_id::VARCHAR AS id, text AS query, 'c' AS category, CASE WHEN item_id % 2 = 0 THEN 'hard' ELSE 'medium' END AS difficulty, 0::BIGINT AS n_relevant, '' AS ground_truth FROM benchmark",
)


def _stored(spark, sf_dir):
    meta = F.map_filter(F.create_map(F.lit("content"), F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.lit("text"), F.when(F.col("doc_id") % 3 == 0, F.lit("t")), F.lit("document_id"), F.col("source")), lambda _, v: v.isNotNull())
    return Z.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), meta.alias("metadata"))


_put(
    "src_05_scan", lambda s, d: D.scan_vectors(_stored(s, d)).drop("metadata"),
    "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN text WHEN doc_id % 3 = 0 THEN 't' ELSE '' END AS content, coalesce(source, '') AS document_id FROM documents",
)


def _uploads(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["txt", "PDF", "exe", "md", "zip"])), (F.col("doc_id") % 5 + 1).cast("int"))
    own = Z.table(spark, sf_dir, "documents")
    return own.select("doc_id", F.concat(F.lit("f."), kind).alias("name"), (F.octet_length("text").cast("long") * F.when(F.col("doc_id") % 11 == 0, 100_000).otherwise(1)).alias("size"), "text", F.pmod(F.col("doc_id"), F.lit(2500)).alias("chunk_size"), F.pmod(F.col("doc_id"), F.lit(250)).alias("chunk_overlap"))


def _reason():
    return D.reject_reason(F.col("name"), F.col("size"), F.col("text"), F.col("chunk_size"), F.col("chunk_overlap"))


_UP = "u AS (SELECT doc_id, 'f.' || (['txt', 'PDF', 'exe', 'md', 'zip'])[doc_id % 5 + 1] AS name, (strlen(text) * CASE WHEN doc_id % 11 = 0 THEN 100000 ELSE 1 END)::BIGINT AS size, text, doc_id % 2500 AS cs, doc_id % 250 AS co FROM documents)"
_WHY = rf"CASE WHEN doc_id % 5 IN (2, 4) THEN 'unsupported type' WHEN size <= 0 THEN 'empty file' WHEN size > 52428800 THEN 'too large' WHEN NOT cs BETWEEN 100 AND 2000 THEN 'chunk size' WHEN NOT co BETWEEN 0 AND 200 THEN 'chunk overlap' WHEN length({_strip('text')}) < 10 THEN 'too little text' END"
_put("doc_01_validate", lambda s, d: _uploads(s, d).select("doc_id", _reason().alias("reject_reason")), f"WITH {_UP} SELECT doc_id, {_WHY} AS reject_reason FROM u")
_put(
    "src_06_ingest_status", lambda s, d: D.ingest_status(_uploads(s, d), _reason()).groupBy("status", "error_message").agg(F.count("*").alias("n")),
    f"WITH {_UP} SELECT CASE WHEN {_WHY} IS NULL THEN 'queued' ELSE 'failed' END AS status, {_WHY} AS error_message, count(*) AS n FROM u GROUP BY 1, 2",
)

# --- document table


def _records(spark, sf_dir):
    return Z.documents(spark, sf_dir).select("document_id", "created_at", F.when(F.col("document_id") % 4 == 0, "failed").otherwise("completed").alias("status"), F.col("source").alias("user_id"))


_put(
    "doc_02_list", lambda s, d: D.list_documents(_records(s, d), page=2, page_size=20, status="completed").select("document_id", "status", "user_id", "total"),
    "SELECT doc_id AS document_id, 'completed' AS status, source AS user_id, count(*) OVER () AS total FROM documents WHERE doc_id % 4 <> 0 ORDER BY doc_id % 30 DESC, doc_id LIMIT 20 OFFSET 20",
)


def _doc_02_after(spark, sf_dir):
    """The second page by the last row of the first."""
    first = D.list_documents(_records(spark, sf_dir), status="completed").select("created_at", "document_id").collect()
    last = max(first, key=lambda r: (-r.created_at.timestamp(), r.document_id))
    return D.list_documents(_records(spark, sf_dir), status="completed", after=(last.created_at, last.document_id)).select("document_id", "status", "user_id", "total")


_put("doc_02_list_after", _doc_02_after, ORACLE["doc_02_list"])


def _doc_03(spark, sf_dir):
    own = Z.documents(spark, sf_dir).withColumn("step", F.explode(F.sequence(F.lit(0), F.pmod(F.col("document_id"), F.lit(4)).cast("int"))))
    name = F.element_at(F.array(*map(F.lit, ["queued", "processing", "embedding", "completed"])), F.col("step") + 1)
    log = own.select("document_id", name.alias("status"), F.timestamp_seconds(F.unix_timestamp("created_at") + F.col("step") * 60).alias("ts"), F.when(F.col("step") == 2, "slow").alias("error"))
    made = C.fixed(_docs(spark, sf_dir), size=128, overlap=16).withColumn("is_embedded", F.col("chunk_index") % 2 == 0)
    out = D.document_status(log, made)
    return out.select("document_id", "status", "error_message", (F.unix_timestamp("updated_at") - F.unix_timestamp("created_at")).alias("seconds"), "chunks_created", "chunks_embedded")


_put(
    "doc_03_status", _doc_03,
    f"""WITH c AS (SELECT document_id, count(*) AS n, count(*) FILTER (chunk_index % 2 = 0) AS e FROM ({_fixed_sql(128, 16)}) GROUP BY 1)
    SELECT doc_id AS document_id, (['queued', 'processing', 'embedding', 'completed'])[doc_id % 4 + 1] AS status, CASE WHEN doc_id % 4 = 2 THEN 'slow' END AS error_message, (doc_id % 4 * 60)::BIGINT AS seconds,
    coalesce(n, 0)::BIGINT AS chunks_created, coalesce(e, 0)::BIGINT AS chunks_embedded FROM documents LEFT JOIN c ON doc_id = document_id""",
)


def _doc_04(spark, sf_dir):
    docs = Z.documents(spark, sf_dir)
    made = C.fixed(_docs(spark, sf_dir), size=128, overlap=16)
    kept, chunks, _, report = D.cascade_delete(docs.filter("document_id % 7 = 0"), docs, made, made)
    left = kept.agg(F.count("*").alias("documents_left")).crossJoin(chunks.agg(F.count("*").alias("chunks_left")))
    return report.crossJoin(F.broadcast(left))


_put(
    "doc_04_cascade_delete", _doc_04,
    f"""WITH c AS ({_fixed_sql(128, 16)}), n AS (SELECT document_id, count(*) AS n FROM c GROUP BY 1)
    SELECT doc_id AS document_id, coalesce(n, 0)::BIGINT AS chunks_deleted, (SELECT count(*) FROM documents WHERE doc_id % 7 <> 0) AS documents_left, (SELECT count(*) FROM c WHERE document_id % 7 <> 0) AS chunks_left
    FROM documents LEFT JOIN n ON doc_id = document_id WHERE doc_id % 7 = 0""",
)


def _snk_01(spark, sf_dir):
    own = Z.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("value"), F.lit(0).alias("created_at"))
    new = own.filter("id % 3 = 0").select((F.col("id") * 2).alias("id"), F.lit("new").alias("value"), F.lit(1).alias("created_at"))
    t = A.Table(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", "id")
    A.put(t, own, 0)
    for _ in range(2):  # the batch is run again
        A.put(t, new, 1, "created_at")
    A.fold(t)
    return A.read(t).select("id", "value")


_put(
    "snk_01_upsert", _snk_01,
    "WITH n AS (SELECT DISTINCT doc_id * 2 AS id, 'new' AS value FROM documents WHERE doc_id % 3 = 0) SELECT doc_id AS id, source AS value FROM documents WHERE doc_id NOT IN (SELECT id FROM n) UNION ALL SELECT id, value FROM n",
)
_put(
    "snk_02_benchmark", lambda s, d: D.qrel_maps(Z.qrels(s, d, 0)).select("query_id", F.size("judgements").cast("long").alias("n"), F.array_join(F.map_keys("judgements"), ",").alias("doc_ids")),
    Z.sql("qrels", "SELECT query_id, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS doc_ids FROM qrels GROUP BY query_id"),
)


def _doc_05(spark, sf_dir):
    """Validate, clean, chunk, embed and index the documents; what is refused stays as a failed row."""
    from .pipelines import ingest

    docs = Z.documents(spark, sf_dir).select("document_id", "text", F.concat(F.col("source"), F.lit(".txt")).alias("source_file"))
    status, rows = ingest(docs, E.hashing_embedder(), hold=DataFrame.persist)
    return status.join(rows.groupBy(F.col("metadata")["document_id"].alias("document_id")).agg(F.count("*").alias("indexed")), "document_id", "left")


_CLEANED = _strip(_newlines(_ws(_base("nfc_normalize(text)"))))


def ingested_sql(name: str) -> str:
    """(doc_id, text, e) of the documents cleaned, with why one is refused; `name` is its file's name. The texts have no compatibility characters, so NFC is NFKC."""
    return f"""(SELECT doc_id, {_CLEANED} AS text, CASE WHEN {name} IS NULL THEN 'unsupported type' WHEN coalesce(strlen(text), 0) <= 0 THEN 'empty file' WHEN length({_strip("text")}) < {D.MIN_CHARS} THEN 'too little text' END AS e FROM documents)"""


_put(
    "doc_05_ingest", _doc_05,
    rf"""WITH n AS (SELECT doc_id, e, CASE WHEN e IS NULL THEN len(regexp_extract_all(text, '\S+')) ELSE 0 END AS n FROM {ingested_sql("source")}),
    c AS (SELECT *, CASE WHEN n > 0 THEN 1 + ceil(greatest(n - 128, 0) / 112.0)::BIGINT ELSE 0 END AS k FROM n)
    SELECT doc_id::VARCHAR AS document_id, CASE WHEN e IS NULL THEN 'completed' ELSE 'failed' END AS status, e AS error_message, k::BIGINT AS chunks_created, CASE WHEN k > 0 THEN k::BIGINT END AS indexed FROM c""",
)


def ingested_chunks_sql() -> str:
    """The chunks of the documents that are taken in."""
    return _fixed_sql(128, 16).replace("FROM documents", f"FROM {ingested_sql('text')} AS d WHERE e IS NULL")
