"""Sources, sinks and the document table's life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

# fixed values: supported file types and limits
TYPES = ["pdf", "docx", "doc", "txt", "md", "html", "csv", "xlsx"]
MAX_BYTES = 50 * 1024 * 1024
MIN_CHARS = 10


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Each text or markdown file as a document; bytes that aren't UTF-8 are dropped."""
    files = spark.read.format("binaryFile").load(path)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("document_id"), text.alias("text"), name.alias("source"), F.lit(1).alias("page_count"), described(name, F.col("length")).alias("metadata"))


def described(name: Column, size: Column) -> Column:
    kind = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return F.create_map(F.lit("filename"), name, F.lit("file_type"), kind, F.lit("file_size"), size.cast("string"))


def html_documents(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(F.col(key).cast("string").alias("document_id"), T.html_text(F.col(html)).alias("text"))


def csv_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Each delimited file as one document of readable rows, in file order."""
    rows = spark.read.csv(path, header=True, **options)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    columns = [c for c in rows.columns if c not in ("_file", "_block", "_at")]
    return rows_to_documents(rows, "_file", columns, ["_block", "_at"])


def rows_to_documents(rows: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """One document for each key, a line for each row: its non-null cells, parted by spaces."""
    lines = rows.select(F.col(key).cast("string").alias("document_id"), F.struct(*order, F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("_line")).alias("_row"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_row")), lambda r: r["_line"]), "\n")
    return lines.groupBy("document_id").agg(text.alias("text"), F.count("*").alias("n_rows"))


EVAL_SET = """struct<
  queries: array<struct<id: string, query: string, category: string, difficulty: string, relevant_doc_ids: array<string>, ground_truth: string>>,
  documents: array<struct<id: string, title: string, category: string, content: string, keywords: array<string>>>,
  samples: array<struct<question: string, answer: string, contexts: array<string>, ground_truth: string>>,
  data: array<struct<question: string, answer: string, contexts: array<string>, ground_truth: string>>>"""


def eval_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, column `set`."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", EVAL_SET).alias("set"))


def eval_queries(sets: DataFrame) -> DataFrame:
    q = sets.select(F.explode("set.queries").alias("q")).select("q.*")
    return q.withColumns({"difficulty": F.coalesce("difficulty", F.lit("medium")), "relevant_doc_ids": F.coalesce("relevant_doc_ids", F.array().cast("array<string>")), "ground_truth": F.coalesce("ground_truth", F.lit(""))})


def eval_documents(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("set.documents").alias("d")).select("d.*").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def eval_samples(sets: DataFrame) -> DataFrame:
    s = sets.select(F.explode(F.coalesce("set.samples", "set.data")).alias("s")).select("s.*")
    return s.withColumns({"contexts": F.coalesce("contexts", F.array().cast("array<string>")), "ground_truth": F.coalesce("ground_truth", F.lit(""))})


def scan_vectors(vectors: DataFrame) -> DataFrame:
    """Vector rows as chunks, the vector left out: (chunk_id, content, document_id, metadata)."""
    meta = F.col("metadata")
    return vectors.select(F.col("id").alias("chunk_id"), F.coalesce(meta["content"], meta["text"], F.lit("")).alias("content"), F.coalesce(meta["document_id"], F.lit("")).alias("document_id"), "metadata")


def reject_reason(name: Column, size: Column, text: Column, chunk_size: Column | None = None, chunk_overlap: Column | None = None) -> Column:
    """Why an upload is refused, or null."""
    kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    out = F.when(~F.coalesce(kind.isin(TYPES), F.lit(False)), "unsupported type").when(F.coalesce(size, F.lit(0)) <= 0, "empty file").when(size > MAX_BYTES, "too large")
    if chunk_size is not None:
        out = out.when(~chunk_size.between(100, 2000), "chunk size").when(~chunk_overlap.between(0, 200), "chunk overlap")
    return out.when(F.length(T.strip(F.coalesce(text, F.lit("")))) < MIN_CHARS, "too little text")


def ingest_status(df: DataFrame, reason: Column) -> DataFrame:
    """Refused rows stay, as failed ones with their reason."""
    return df.withColumn("error_message", reason).withColumn("status", F.when(F.col("error_message").isNull(), "queued").otherwise("failed"))


def list_documents(docs: DataFrame, page: int = 1, page_size: int = 20, status: str | None = None, user_id=None, after: tuple | None = None) -> DataFrame:
    """One page, newest first, with the number of all rows that fit the filters. `after`, the (created_at, document_id) of the last row seen, gives the page that
    follows it: a filter that reaches the scan and the first rows of the rest, where an offset sorts all that it skips."""
    if status is not None:
        docs = docs.filter(F.col("status") == status)
    if user_id is not None:
        docs = docs.filter(F.col("user_id") == user_id)
    total = docs.agg(F.count("*").alias("total"))
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        docs = docs.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("document_id") > last)))
    rows = docs.orderBy(F.col("created_at").desc(), "document_id")
    rows = rows.limit(page_size) if after is not None else rows.offset((page - 1) * page_size).limit(page_size)
    return rows.crossJoin(F.broadcast(total))


def document_status(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Latest status, error and times of each document from (document_id, status, ts, error), with counts of its chunks."""
    last = events.groupBy("document_id").agg(F.max_by("status", "ts").alias("status"), F.max_by("error", "ts").alias("error_message"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    made = chunks.groupBy("document_id").agg(F.count("*").alias("chunks_created"), F.count_if("is_embedded").alias("chunks_embedded"))
    out = last.join(made, "document_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("chunks_created", "chunks_embedded")})


def cascade_delete(keys: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, vectors without those of the keys; report of chunks deleted by document)."""
    keys = keys.select("document_id").distinct()
    gone = chunks.join(keys, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("chunks_deleted"))
    report = keys.join(gone, "document_id", "left").withColumn("chunks_deleted", F.coalesce("chunks_deleted", F.lit(0)).cast("long"))
    return (*(t.join(keys, "document_id", "left_anti") for t in (documents, chunks, vectors)), report)


def write_benchmark(documents: DataFrame, queries: DataFrame, qrels: DataFrame, path: str) -> None:
    """Three JSON folders: documents, queries, and qrels as a map of judgements for each query."""
    documents.write.mode("overwrite").json(f"{path}/documents")
    queries.write.mode("overwrite").json(f"{path}/queries")
    qrel_maps(qrels).write.mode("overwrite").json(f"{path}/qrels")


def qrel_maps(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("doc_id").cast("string"), F.col("rel").cast("int"))))).alias("judgements"))


def write_results(results: DataFrame, metrics: DataFrame, path: str) -> None:
    """Rows and a one-row table of their metrics."""
    results.write.mode("overwrite").json(f"{path}/results")
    metrics.write.mode("overwrite").json(f"{path}/metrics")
