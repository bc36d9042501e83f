"""Vector tables: exact top-k and threshold joins, filters, upserts. The approximate index is in cells.py."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import fitted, products
from .common import merge, topk

#: Query rows that are broadcast at most, and scores that a task holds at once.
BLOCK, SCORES = 4096, 1 << 20
#: Vectors and queries of a pair of blocks at most where there are more queries.
MEMBERS, PROBES = 131_072, 8_192
#: Bands of hashed bits that a threshold join makes at most.
MOST_BANDS = 48


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 100, block: int = BLOCK, last_id: bool = False) -> DataFrame:
    """(query_id, id, score, rank): for each query vector the k nearest by cosine, ties by id, the largest first with `last_id`.

    Up to `block` queries are broadcast as one matrix, and ids and embeddings alone reach a task. More queries meet the vectors in pairs of blocks over the cluster.
    Either way a task keeps, for every query, only its own k best, so queries x vectors pairs never exist as rows.
    """
    own = queries.select("query_id", "embedding").filter("embedding IS NOT NULL")
    first = own.limit(block + 1).toArrow()
    key, vid = own.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    table = vectors.select("id", F.col("embedding").alias("embedding")).filter("embedding IS NOT NULL")
    schema = f"query_id {key}, id {vid}, score double"
    if first.num_rows > block:
        found = products(table, own, [], "id", "query_id", lambda left, right: _nearest(right, left, k), schema, fitted(table, own, (MEMBERS, PROBES)))
    else:
        asked = vectors.sparkSession.sparkContext.broadcast(first)

        def run(batches):
            for batch in batches:
                yield from _nearest(asked.value, pa.Table.from_batches([batch]), k).to_batches()

        found = table.mapInArrow(run, schema)
    return topk(found, "query_id", [F.round("score", 9).desc(), F.col("id").desc() if last_id else F.col("id")], k)


def _nearest(asked: pa.Table, table: pa.Table, k: int, least: float | None = None) -> pa.Table:
    """(query_id, id, score) of each query's k best by cosine in the table, and of all that tie with the k-th; with `least` only from there on."""
    names, ids = asked["query_id"].combine_chunks(), table["id"].combine_chunks()
    if not len(names) or not len(ids):
        return pa.table({"query_id": names.slice(0, 0), "id": ids.slice(0, 0), "score": pa.array([], pa.float64())})
    q, x = _rows(asked["embedding"].combine_chunks()), _rows(table["embedding"].combine_chunks())
    lengths, n, step, found = np.sqrt((x * x).sum(1)), min(k, len(x)), max(1, SCORES // len(x)), []
    for a in range(0, len(q), step):
        some = q[a : a + step]
        scores = (some @ x.T) / (np.sqrt((some * some).sum(1))[:, None] * lengths[None, :] + 1e-9)
        edge = np.partition(scores, len(x) - n, axis=1)[:, len(x) - n][:, None]
        fine = scores >= edge - 1e-9  # all that tie with the k-th stay for the final cut
        at, which = np.nonzero(fine if least is None else fine & (scores >= least - 1e-8))
        found.append((at + a, which, scores[at, which]))
    at, which, best = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table({"query_id": names.take(pa.array(at)), "id": ids.take(pa.array(which)), "score": pa.array(best)})


def within(queries: DataFrame, vectors: DataFrame, threshold: float, k: int = 1, miss: float = 1e-4, seed: int = 11) -> DataFrame:
    """(query_id, id, score, rank): of each query's k nearest by cosine those that reach the threshold.

    Both sides are hashed by the signs of random projections, in as many bands of bits as leave a pair at the threshold unmet with probability `miss` at most. Queries and
    vectors that share a band's bits meet in blocks and are compared exactly, so nothing passes the driver. If the threshold is too low for bands to be of use, all are compared.
    """
    n, dim = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    same = 1 - float(np.arccos(min(1.0, max(-1.0, threshold)))) / np.pi
    bits = min(20, max(2, round(np.log2(max(n, 1) / 256))))
    bands = lambda b: int(np.ceil(np.log(miss) / np.log1p(-(same**b)))) if same < 1 else 1
    while bits > 1 and bands(bits) > MOST_BANDS:
        bits -= 1
    if bits < 2 or not n or bands(bits) > 2 << bits:  # that many bands are more work than all pairs
        return top_k(queries, vectors, k).filter(F.round("score", 9) >= threshold)
    planes = np.random.default_rng(seed).standard_normal((bands(bits), dim, bits))

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        own = rows.select(name, F.col("embedding").alias("embedding")).filter("embedding IS NOT NULL")

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _rows(batch.column("embedding"))
                for band, plane in enumerate(planes):
                    key = (x @ plane > 0) @ (1 << np.arange(bits))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), band, np.int32)), pa.array(key), *batch.columns], ["band", "bits", *batch.schema.names])

        return own.mapInArrow(run, f"band int, bits long, {name} {own.schema[name].dataType.simpleString()}, embedding {own.schema['embedding'].dataType.simpleString()}")

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    found = products(keyed(vectors, "id"), keyed(queries, "query_id"), ["band", "bits"], "id", "query_id", lambda left, right: _nearest(right, left, k, threshold), schema)
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score")).filter(F.round("score", 9) >= threshold)
    return topk(found, "query_id", [F.round("score", 9).desc(), F.col("id")], k)


def _rows(lists: pa.Array) -> np.ndarray:
    """A matrix of lists of one length, in double precision."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def matches(conditions: dict, column: str = "metadata") -> Column:
    """Conjunction of {key: value} and {key: {"$eq" | "$in" | "$gt" | "$gte" | "$lt" | "$lte": value}} over a map of strings; a missing key is no match."""

    def one(key: str, op: str, value) -> Column:
        own = F.col(column)[key]
        if op == "$in":
            return own.isin([str(v) for v in value])
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            own = F.expr(f"try_cast({column}['{key}'] AS double)")
        return {"$eq": own == value, "$gt": own > value, "$gte": own >= value, "$lt": own < value, "$lte": own <= value}[op]

    tests = [one(k, op, v) for k, c in conditions.items() for op, v in (c.items() if isinstance(c, dict) else [("$eq", c)])]
    return F.coalesce(reduce(and_, tests, F.lit(True)), F.lit(False))


def index_rows(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, embedding, metadata) of chunks and their embeddings; a chunk's own metadata wins over the standard keys. Fails if a side has rows the other lacks."""
    both = chunks.join(embeddings.select(F.col("chunk_id").alias("_id"), "embedding"), F.col("chunk_id") == F.col("_id"), "full_outer")
    checked = F.when(F.col("chunk_id").isNull() | F.col("_id").isNull(), F.raise_error(F.lit("chunks and embeddings differ"))).otherwise(F.col("chunk_id"))
    base = F.create_map(F.lit("content"), "content", F.lit("document_id"), F.col("document_id").cast("string"), F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("source_file"), "source_file")
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    rest = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return both.select(checked.alias("id"), "embedding", F.map_concat(rest, own).alias("metadata"))


def upsert(vectors: DataFrame, updates: DataFrame) -> DataFrame:
    return merge(vectors, updates, "id", F.col("created_at") if "created_at" in updates.columns else None)


def delete(vectors: DataFrame, ids: DataFrame | None = None, conditions: dict | None = None) -> DataFrame:
    """Without the ids, without the rows that match, or, given neither, without any row."""
    if ids is not None:
        return vectors.join(ids.select("id"), "id", "left_anti")
    return vectors.filter(~matches(conditions)) if conditions is not None else vectors.filter(F.lit(False))


def collection_stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("vectors_count"), F.min(F.size("embedding")).cast("long").alias("min_dim"), F.max(F.size("embedding")).cast("long").alias("max_dim"))


# fixed value: the DNS name space of RFC 4122
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_DNS) -> Column:
    """RFC 4122 version 5 id of a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(F.element_at(F.array(*map(F.lit, "89ab")), nibble + 1), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def recall(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Mean share of the exact top k that the approximate one holds."""
    hit = exact.join(approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("r")).agg(F.count("*").alias("queries"), F.avg("r").alias("recall"), F.lit(k).alias("k"))
