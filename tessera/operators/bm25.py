"""BM25 keyword search over a table of postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import fitted, products
from .common import cut, small, topk

K1, B, DELTA, EPSILON = 1.5, 0.75, 1.0, 0.25
#: Weights of query terms that are broadcast at most, and chunks whose scores a task holds at once.
WEIGHTS, SLICE = 100_000, 4_096
#: Chunks and queries of a pair of blocks at most where there are more weights.
MEMBERS, PROBES = 32_768, 32_768
#: Scores count at nine digits; a bound may be this much short.
SLACK = 1e-8

# fixed values: stop words
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "were", "will", "with", "this", "but", "they", "have", "had", "what", "when", "where", "who", "which", "why", "how",
]


def tokens(c: Column, min_length: int = 1, stopwords: bool = False) -> Column:
    """Lower-case words, codes such as err-404 and sku_12 in one piece."""
    out = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+(?:[-_][a-z0-9]+)*"), F.lit(0))
    if min_length > 1:
        out = F.filter(out, lambda t: F.length(t) >= min_length)
    return F.filter(out, lambda t: ~t.isin(STOPWORDS)) if stopwords else out


def postings(chunks: DataFrame, content: str = "content", tokenizer=tokens) -> DataFrame:
    """(term, chunk_id, tf)."""
    return chunks.select("chunk_id", F.explode(tokenizer(F.col(content))).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def doc_stats(chunks: DataFrame, content: str = "content", tokenizer=tokens) -> DataFrame:
    """(chunk_id, dl), chunks without a term included."""
    return chunks.select("chunk_id", F.size(tokenizer(F.col(content))).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(posted: DataFrame, corpus: DataFrame, variant: str = "okapi") -> DataFrame:
    """(term, df, idf) of postings."""
    return weighted(posted.groupBy("term").agg(F.count("*").alias("df")), corpus, variant)


def weighted(terms: DataFrame, corpus: DataFrame, variant: str = "okapi") -> DataFrame:
    """(term, df) with idf. Okapi: ln(N - df + 0.5) - ln(df + 0.5), negative ones replaced by EPSILON times the mean. plus: ln((N + 1) / df)."""
    df = terms.crossJoin(F.broadcast(corpus.select("n")))
    if variant == "plus":
        return df.select("term", "df", F.log((F.col("n") + 1) / F.col("df")).alias("idf"))
    raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf").alias("_mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("idf") < 0, EPSILON * F.col("_mean")).otherwise(F.col("idf")).alias("idf"))


def scores(queries: DataFrame, posted: DataFrame, docs: DataFrame, variant: str = "okapi", text: str = "text", tokenizer=tokens, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, score) of chunks that share a term with the query; a term counts as often as the query has it."""
    corpus = corpus_stats(docs)
    asked = queries.select("query_id", F.explode(tokenizer(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    weights = term_stats(posted, corpus, variant)
    own = asked.join(weights, "term")
    hits = posted.join(own, "term").join(docs, "chunk_id").crossJoin(F.broadcast(corpus))
    return _summed(hits, own, variant, k1, b)


def scan_scores(queries: DataFrame, chunks: DataFrame, variant: str = "okapi", text: str = "text", content: str = "content", tokenizer=tokens, k1: float = K1, b: float = B) -> DataFrame:
    """`scores` of a corpus without postings: document frequencies are counted map-side over all terms, but occurrences leave a task only where a query asks for the term."""
    own = chunks.select("chunk_id", tokenizer(F.col(content)).alias("_t"))
    held = own.select("chunk_id", F.explode(F.array_distinct("_t")).alias("term"))
    docs = own.select("chunk_id", F.size("_t").cast("long").alias("dl"))
    corpus = corpus_stats(docs)
    asked = queries.select("query_id", F.explode(tokenizer(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    weights = asked.join(term_stats(held, corpus, variant), "term")
    terms = small(asked.select("term").distinct())
    met = own.select("chunk_id", F.size("_t").cast("long").alias("dl"), F.explode("_t").alias("term")).join(terms, "term", "left_semi")
    hits = met.groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf")).join(small(weights), "term").crossJoin(F.broadcast(corpus))
    return _summed(hits, weights, variant, k1, b)


def _summed(hits: DataFrame, weights: DataFrame, variant: str, k1: float, b: float) -> DataFrame:
    length = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + length)
    found = hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    if variant != "plus":
        return found
    # the lower bound of every term goes to every chunk: one number a query
    bound = weights.groupBy("query_id").agg(F.sum(F.col("qf") * F.col("idf") * DELTA).alias("_bound"))
    return found.join(bound, "query_id").select("query_id", "chunk_id", (F.col("score") + F.col("_bound")).alias("score"))


def top_k(found: DataFrame, k: int = 100, threshold: float = 0.0) -> DataFrame:
    """The k best of each query, then those above the threshold."""
    return topk(found, "query_id", [F.round("score", 9).desc(), F.col("chunk_id")], k).filter(F.col("score") > threshold)


def normalize(found: DataFrame, most: float | None = None) -> DataFrame:
    """score / max; unchanged if the max is not positive."""
    top = F.lit(most) if most is not None else F.max("score").over(Window.partitionBy("query_id"))
    return found.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.col("score")))


def add(posted: DataFrame, docs: DataFrame, more: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(postings, doc stats) with new chunks; old text isn't read again."""
    return posted.unionByName(postings(more, content)), docs.unionByName(doc_stats(more, content))


def with_fields(found: DataFrame, chunks: DataFrame, fields: list[str]) -> DataFrame:
    return found.join(chunks.select("chunk_id", *fields), "chunk_id")


def response_totals(queries: DataFrame, found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, query_tokens, total_documents, results, top_score)."""
    per = found.groupBy("query_id").agg(F.count("*").alias("results"), F.max("score").alias("top_score"))
    asked = queries.select("query_id", F.size(tokens(F.col(text))).cast("long").alias("query_tokens"))
    out = asked.join(per, "query_id", "left").crossJoin(F.broadcast(docs.agg(F.count("*").alias("total_documents"))))
    return out.withColumns({"results": F.coalesce("results", F.lit(0)), "top_score": F.coalesce("top_score", F.lit(0.0))})


def best(rows: DataFrame, weights: DataFrame, key: str, k: int | None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, `key`, score): the k best rows of each query and what ties with them, with some others that the last cut drops; without k all that share a term.

    rows (`key`, dl, tokens), weights (query_id, term, weight, avgdl, least): what a query's term is worth and a score that the query's k best are known to reach.
    A task holds one slice of rows and sums the scores of one query at a time, so no posting of a query becomes a row, and from slice to slice the k-th score found
    leaves out more. Up to WEIGHTS weights are broadcast; more meet the rows in pairs of blocks over the cluster.
    """
    name, kind = weights.schema["query_id"].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    schema = f"query_id {name}, {key} {kind}, score double"
    own, rows = weights.select("query_id", "term", "weight", "avgdl", "least"), rows.select(key, "dl", "tokens")
    few = own.limit(WEIGHTS + 1).toArrow()
    if few.num_rows > WEIGHTS:
        asked = own.groupBy("query_id", "avgdl", "least").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))

        def near(left: pa.Table, right: pa.Table) -> pa.Table:
            flat = right["terms"].combine_chunks()
            at = pa.array(np.repeat(np.arange(len(flat)), pc.list_value_length(flat).to_numpy(zero_copy_only=False)))
            parts = flat.flatten()
            some = pa.table({c: right[c].combine_chunks().take(at) for c in ("query_id", "avgdl", "least")} | {"term": parts.field("term"), "weight": parts.field("weight")})
            return _kept(pa.concat_tables(_best_of(left.to_batches(), some, key, k, k1, b)), k)

        return products(rows, asked, [], key, "query_id", near, schema, fitted(rows, own.select("query_id").distinct(), (MEMBERS, PROBES)))
    sent = rows.sparkSession.sparkContext.broadcast(few)

    def run(batches):
        for found in _best_of(batches, sent.value, key, k, k1, b):
            yield from found.to_batches()

    return rows.mapInArrow(run, schema)


def _kept(found: pa.Table, k: int | None) -> pa.Table:
    """The k best rows of each query and what ties with them: what several slices of a block gave, cut once more."""
    if k is None or not found.num_rows:
        return found
    query, score = found["query_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), found["score"].to_numpy()
    order = np.lexsort((-score, query))
    first = np.searchsorted(query[order], np.arange(query.max() + 1))
    last = np.minimum(first + k, np.r_[first[1:], len(order)]) - 1
    return found.filter(pa.array(score >= score[order[last]][query] - SLACK))


def _best_of(batches, weights: pa.Table, key: str, k: int | None, k1: float, b: float):
    """Tables of `best` for batches of rows."""
    ids = weights["query_id"].combine_chunks()
    empty = lambda own: pa.table({"query_id": ids.slice(0, 0), key: own.slice(0, 0), "score": pa.array([], pa.float64())})
    coded, terms = ids.dictionary_encode(), weights["term"].combine_chunks().dictionary_encode()
    query, term = coded.indices.to_numpy(), terms.indices.to_numpy()
    order = np.lexsort((term, query))
    term, worth = term[order], weights["weight"].to_numpy()[order]
    n = len(coded.dictionary)
    upto = np.searchsorted(query[order], np.arange(n + 1))
    least = np.full(n, -np.inf)
    least[query] = weights["least"].to_numpy()
    mean = weights["avgdl"][0].as_py() if len(weights) else None
    for batch in batches:
        yield empty(batch.column(key) if isinstance(batch, pa.RecordBatch) else batch[key].combine_chunks())
        for start in range(0, batch.num_rows if n else 0, SLICE):
            some = batch.slice(start, SLICE)
            rows, count = some.column("tokens"), some.num_rows
            held = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(rows.flatten(), terms.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.repeat(np.arange(count), held)[code >= 0]
            pair, tf = np.unique(code[code >= 0] * count + at, return_counts=True)
            code, at = np.divmod(pair, count)
            dl = pc.fill_null(some.column("dl"), 0).to_numpy(zero_copy_only=False)[at]
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean)) if len(at) else np.zeros(0)
            begin = np.searchsorted(code, np.arange(len(terms.dictionary) + 1))
            places, found, score = [], [], []
            for q in range(n):
                total, met = np.zeros(count), []
                for i in range(upto[q], upto[q + 1]):
                    one = slice(begin[term[i]], begin[term[i] + 1])
                    total[at[one]] += worth[i] * part[one]
                    met.append(at[one])
                fine = np.flatnonzero(total >= least[q]) if least[q] > 0 else np.unique(np.concatenate(met))
                if k is not None and len(fine) >= k:
                    edge = np.partition(total[fine], len(fine) - k)[len(fine) - k] - SLACK
                    least[q] = max(least[q], edge)
                    fine = fine[total[fine] >= edge]
                if len(fine):
                    places.append(np.full(len(fine), q))
                    found.append(fine)
                    score.append(total[fine])
            if found:
                yield pa.table({"query_id": coded.dictionary.take(pa.array(np.concatenate(places))), key: some.column(key).take(pa.array(np.concatenate(found))), "score": pa.array(np.concatenate(score))})


def search(queries: DataFrame, chunks: DataFrame, k: int = 100, threshold: float = 0.0, variant: str = "okapi", text: str = "text", content: str = "content") -> DataFrame:
    if variant == "plus":
        return top_k(scan_scores(queries, chunks, variant, text, content), k, threshold)
    own = chunks.select("chunk_id", tokens(F.col(content)).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
    corpus = corpus_stats(own)
    asked = queries.select("query_id", F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    terms = term_stats(own.select(F.explode(F.array_distinct("tokens")).alias("term")), corpus)
    weights = asked.join(terms, "term").crossJoin(F.broadcast(corpus.select("avgdl")))
    weights = cut(weights.select("query_id", "term", (F.col("qf") * F.col("idf")).alias("weight"), "avgdl", F.lit(float("-inf")).alias("least")))
    return top_k(best(own, weights, "chunk_id", k), k, threshold)
