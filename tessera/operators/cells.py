"""A stored approximate index of vectors: coarse cells, product-quantised codes, exact rescoring of a short list.

Vectors and codes are written once, as columns of a table partitioned by cell. A search reads the codes of the probed cells alone (the others are pruned as partitions), ranks
them by the vectors that the codes stand for, and reads the vectors of each query's short list. Blocks of queries meet blocks of codes, and a task keeps a query's short list alone, so queries x cells
never become rows. All scores are cosines; vectors are scaled to unit length for the codes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scores as S

from . import vectors as V
from .blocks import products
from .common import cut, small, topk

#: Rows that centres are trained on at least, and rows a centre; rows that codebooks are trained on, on the driver.
SAMPLE, PER_CELL, BOOK_SAMPLE = 20_000, 64, 8_192
#: Dimensions of a part that one byte of a code stands for, and values of such a byte.
PART, VALUES = 4, 256
#: Queries that the number of probes is fitted on, and the share of their true neighbours that the probed cells are to hold.
FIT, TARGET = 256, 0.98
#: Least short list, in multiples of k, and the share of the true neighbours that the fitted one is to hold. Cells that are pruned by a list of values at most.
SHORT, HELD, LISTED = 8, 0.965, 2_000
#: Codes and queries of a pair of blocks at most, and scores by codes that a task holds at once.
MEMBERS, PROBES, SCORES = 262_144, 2_048, 1 << 21


class Index(NamedTuple):
    path: str
    centres: np.ndarray
    books: np.ndarray
    probes: int
    short: int = SHORT

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows").select("cell", "id", "code")

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows").select("cell", "id", "embedding")


def _unit(column: pa.Array) -> np.ndarray:
    x = V._rows(column)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12) if len(x) else x


def _order(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells of each row, the nearest first."""
    return np.argsort((centres * centres).sum(1)[None, :] - 2 * x @ centres.T, axis=1, kind="stable")


def _parts(x: np.ndarray) -> np.ndarray:
    """Rows as (row, part, dimension), zeros at the end."""
    width = -(-x.shape[1] // PART) * PART
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), -1, PART)


def _codebooks(rest: np.ndarray, seed: int) -> np.ndarray:
    """(part, value, dimension): k-means of each part of a bounded sample of residuals."""
    parts, rng, out = _parts(rest), np.random.default_rng(seed), []
    for p in range(parts.shape[1]):
        x = parts[:, p]
        c = x[rng.choice(len(x), VALUES, replace=len(x) < VALUES)]
        for _ in range(8):
            own = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
            n = np.bincount(own, minlength=VALUES)
            sums = np.stack([np.bincount(own, x[:, d], VALUES) for d in range(PART)], 1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out.append(c)
    return np.array(out)


def build(vectors: DataFrame, path: str, cells: int | None = None, target: float = TARGET, k: int = 10, seed: int = 7) -> Index:
    """Writes the index of (id, embedding) and gives it opened. Every row is indexed; centres, codebooks and the number of probes are fitted on bounded samples.

    Cells grow as the square root of the rows, so a search for some cells reads a falling share of them. The number of probes is the least with which the probed
    cells hold `target` of the true k nearest of FIT sampled vectors.
    """
    spark = vectors.sparkSession
    own = vectors.select("id", "embedding").filter("embedding IS NOT NULL")
    n = own.count()
    cells = max(1, cells or round(n**0.5))
    wanted = max(SAMPLE, PER_CELL * cells)
    some = own if n <= wanted else own.sample(wanted / n, seed=seed)
    scale = F.greatest(S.norm(F.col("embedding")), F.lit(1e-12))
    unit = some.withColumn("scale", scale).select(array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.col("scale"))).alias("features"))
    centres = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(unit).clusterCenters())
    few = _unit(some.orderBy(F.xxhash64("id")).limit(BOOK_SAMPLE).toArrow()["embedding"].combine_chunks())
    books = _codebooks(few - centres[_order(few, centres)[:, 0]], seed)
    sent, kinds = spark.sparkContext.broadcast((centres, books)), [own.schema[c].dataType.simpleString() for c in own.columns]

    def coded(batches):
        centres, books = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("embedding"))
            cell = _order(x, centres)[:, 0]
            rest = _parts(x - centres[cell])
            code = np.stack([np.argmin((b * b).sum(1)[None, :] - 2 * rest[:, p] @ b.T, axis=1) for p, b in enumerate(books)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("id"), batch.column("embedding"), pa.array([c.tobytes() for c in code], pa.binary())], ["cell", "id", "embedding", "code"])

    done = own.mapInArrow(coded, f"cell int, id {kinds[0]}, embedding {kinds[1]}, code binary")
    done.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    index = Index(path, centres, books, cells)
    held = index.vectors(spark)
    asked = cut(held.orderBy(F.xxhash64("id"), "id").limit(FIT).select(F.col("id").alias("query_id"), "embedding"))
    near = small(cut(V.top_k(asked, held, k + 1).filter("query_id <> id")))
    pairs = cut(held.select("id", "cell").join(near, "id"))
    true = pairs.join(asked, "query_id").select("embedding", "cell").toArrow()
    if len(true):
        order = _order(_unit(true["embedding"].combine_chunks()), centres)
        place = np.sort(np.argmax(order == true["cell"].to_numpy()[:, None], axis=1))
        index = index._replace(probes=int(place[int(np.ceil(target * len(place))) - 1]) + 1)
    while index.short * k < n and pairs.join(short_list(index, asked, k), ["query_id", "id"], "left_semi").count() < HELD * len(true):
        index = index._replace(short=2 * index.short)
    meta = spark.createDataFrame([(centres.tolist(), books.tolist(), index.probes, index.short)], "centres array<array<double>>, books array<array<array<double>>>, probes int, short int")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return index


def opened(spark: SparkSession, path: str) -> Index:
    row = spark.read.parquet(f"{path}/meta").first()
    return Index(path, np.array(row.centres), np.array(row.books), row.probes, row.short)


def _asked(index: Index, queries: DataFrame, probes: int, blocks: int = 1) -> DataFrame:
    """(cell, block): the cells that a block's queries probe."""
    centres = queries.sparkSession.sparkContext.broadcast(index.centres)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                order = _order(_unit(batch.column("embedding")), centres.value)[:, :probes]
                block, cell = np.divmod(np.unique(_block(order, blocks, len(centres.value))[:, None] * len(centres.value) + order), len(centres.value))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32))], ["cell", "block"])

    return queries.select("embedding").filter("embedding IS NOT NULL").mapInArrow(run, "cell int, block int").distinct()


def _block(order: np.ndarray, blocks: int, cells: int) -> np.ndarray:
    """Queries are dealt by their nearest cell, so a block probes cells in common."""
    return order[:, 0].astype(np.int64) * blocks // cells


def short_list(index: Index, queries: DataFrame, k: int = 10, short: int | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, id, cell): the short * k best of each query by their codes, of the probed cells."""
    spark, probes = queries.sparkSession, probes or index.probes
    own = queries.select("query_id", "embedding").filter("embedding IS NOT NULL")
    n = own.count()
    blocks = max(1, -(-n // PROBES), min(n, spark.sparkContext.defaultParallelism))
    met = small(cut(_asked(index, own, probes, blocks)))
    sent = spark.sparkContext.broadcast((index.centres, index.books))
    codes = _pruned(index.codes(spark), met)
    key, vid, kind = own.schema["query_id"].dataType.simpleString(), codes.schema["id"].dataType.simpleString(), own.schema["embedding"].dataType.simpleString()
    r = (short or index.short) * k

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                block = _block(_order(_unit(batch.column("embedding")), sent.value[0]), blocks, len(sent.value[0]))
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), *batch.columns], ["block", *batch.schema.names])

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, *sent.value, probes, r)

    asked = cut(own.mapInArrow(placed, f"block int, query_id {key}, embedding {kind}"))
    found = products(codes.join(met, "cell"), asked, ["block"], "id", "query_id", near, f"query_id {key}, id {vid}, cell int, score double", (MEMBERS, PROBES))
    return topk(found, "query_id", [F.col("score").desc(), F.col("id")], r).select("query_id", "id", "cell")


def _best(left: pa.Table, right: pa.Table, centres: np.ndarray, books: np.ndarray, probes: int, r: int) -> pa.Table:
    """(query_id, id, cell, score) of each query's r best codes in the cells that it probes, ties by id; a code scores as the vector that it stands for, for a few queries at once."""
    left = left.take(pc.sort_indices(left["id"]))
    names, ids, cells = right["query_id"].combine_chunks(), left["id"].combine_chunks(), left["cell"].to_numpy()
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(names) and len(ids):
        code = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        held = np.concatenate([book[code[:, p]] for p, book in enumerate(books)], axis=1)
        held[:, : centres.shape[1]] += centres[cells]
        q = _unit(right["embedding"].combine_chunks())
        wide = _parts(q).reshape(len(q), -1)
        order = _order(q, centres)[:, :probes]
        probed = np.zeros((len(q), len(centres)), bool)
        np.put_along_axis(probed, order, True, axis=1)
        queries, step = np.argsort(order[:, 0], kind="stable"), max(1, SCORES // len(ids))
        for a in range(0, len(q), step):
            some = queries[a : a + step]
            which = np.flatnonzero(probed[some].any(0)[cells])
            if not len(which):
                continue
            score = np.round(wide[some] @ (held if len(which) == len(held) else held[which]).T, 9)
            score[~probed[some].take(cells[which], axis=1)] = -np.inf
            n = min(r, len(which))
            edge = np.partition(score, len(which) - n, axis=1)[:, len(which) - n]
            fine = score >= np.maximum(edge, np.finfo(np.float64).min)[:, None]
            for row in np.flatnonzero(fine.sum(1) > n):
                level = np.flatnonzero(score[row] == edge[row])
                fine[row, level[n - (score[row] > edge[row]).sum() :]] = False
            at, place = np.nonzero(fine)
            found.append((some[at], which[place], score[at, place]))
    at, which, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table({"query_id": names.take(pa.array(at)), "id": ids.take(pa.array(which)), "cell": pa.array(cells[which].astype(np.int32)), "score": pa.array(score)})


def _pruned(table: DataFrame, asked: DataFrame) -> DataFrame:
    """The partitions of the probed cells; of very many cells they are found by a join."""
    cells = asked.select("cell").distinct()
    some = [r.cell for r in cells.limit(LISTED + 1).collect()]
    table = table.withColumn("cell", F.col("cell").cast("int"))
    return table.filter(F.col("cell").isin(some)) if len(some) <= LISTED else table.join(cells, "cell", "left_semi")


def search(index: Index, queries: DataFrame, k: int = 10, short: int | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest by cosine that the index finds, with their exact scores."""
    listed = cut(short_list(index, queries, k, short, probes))
    rows = _pruned(index.vectors(queries.sparkSession), listed).select("cell", "id", F.col("embedding").alias("v"), S.norm(F.col("embedding")).alias("vn")).join(listed, ["cell", "id"])
    asked = small(queries.select("query_id", F.col("embedding").alias("q"), S.norm(F.col("embedding")).alias("qn")))
    pairs = rows.join(asked, "query_id").select("query_id", "id", (S.dot(F.col("q"), F.col("v")) / (F.col("qn") * F.col("vn") + 1e-9)).alias("score"))
    return topk(pairs, "query_id", [F.round("score", 9).desc(), F.col("id")], k)
