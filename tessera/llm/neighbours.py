"""Nearest neighbours by multiprobe p-stable hashing: each table cuts random projections into buckets, a query visits its own and perturbed buckets in the order
of their estimated success, and the members found in all tables are ranked by their exact inner product.

The largest inner product is the least distance once each vector has one more component that brings it to the largest norm, and each query a zero.
Members and probes of a bucket meet in blocks of bounded size, so that a large bucket is many groups. Equal vectors are hashed and compared once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.common import small, topk

from .common import cut

#: Recall that the number of probes is fitted to, on SAMPLE of the queries, each against all rows.
TARGET, SAMPLE = 0.96, 128
#: Mean rows of a bucket that the number of functions aims at (a probe costs about as much as a few hundred products), and bits that a function tells at this width (in distances to the k-th neighbour).
BUCKET, BITS, WIDTH = 1024, 1.46, 1.4
TABLES, MOST_PROBES = (4, 8), 256
#: Rows of one side of a block.
BLOCK = 1024


def perturbations(m: int, n: int) -> list[tuple[int, ...]]:
    """The first n perturbation sets by expected score. Item j of a set stands for the j-th nearest of the 2 m bucket borders around a query; no set moves one function both ways."""
    j = np.arange(1, 2 * m + 1)
    far = 2 * m + 1 - j
    score = np.where(j <= m, j * (j + 1), 4 * (m + 1) * (m + 2) * (1 - far / (m + 1)) + far * (far + 1)) / (4 * (m + 1) * (m + 2))
    out: list[tuple[int, ...]] = [()]
    heap = [(score[0], (0,))] if m else []
    while heap and len(out) < n:
        s, a = heapq.heappop(heap)
        if all(2 * m - 1 - x not in a for x in a):
            out.append(a)
        last = a[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (s - score[last] + score[last + 1], (*a[:-1], last + 1)))
            heapq.heappush(heap, (s + score[last + 1], (*a, last + 1)))
    return out


class Tables:
    """`tables` hash tables of m functions floor((a x + b) / width) each; a x is normal, as the normal law is 2-stable."""

    def __init__(self, dim: int, m: int, tables: int, width: float, top: float, probes: int = 1):
        rng = np.random.default_rng(20)
        self.m, self.tables, self.width, self.top = m, tables, width, top
        self.a, self.b = rng.standard_normal((tables, dim + 1, m)), rng.uniform(0, width, (tables, m))
        self.odd = rng.integers(0, 1 << 63, (tables, m), dtype=np.int64) | 1
        self.sets = perturbations(m, probes)

    def places(self, x: np.ndarray, t: int, asked: bool) -> np.ndarray:
        """Projections in bucket widths."""
        rest = np.zeros(len(x)) if asked else np.sqrt(np.maximum(0, self.top**2 - (x * x).sum(1)))
        return (x @ self.a[t, :-1] + rest[:, None] * self.a[t, -1] + self.b[t]) / self.width

    def key(self, cells: np.ndarray, t: int) -> np.ndarray:
        return (cells.astype(np.int64) * self.odd[t]).sum(-1)

    def borders(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(function, step) of each border around the rows' places, the nearest first."""
        low = at - np.floor(at)
        order = np.argsort(np.concatenate([low, 1 - low], axis=1), axis=1, kind="stable")
        return order % max(1, self.m), np.where(order < self.m, -1, 1)

    def probes(self, x: np.ndarray, t: int) -> np.ndarray:
        """Keys of the buckets that each row of x visits, in order."""
        at = self.places(x, t, True)
        which, step = self.borders(at)
        out, rows = np.empty((len(x), len(self.sets)), np.int64), np.arange(len(x))
        for k, a in enumerate(self.sets):
            cells = np.floor(at)
            for j in a:
                cells[rows, which[:, j]] += step[:, j]
            out[:, k] = self.key(cells, t)
        return out

    def found_at(self, x: np.ndarray, y: np.ndarray, t: int, rank: dict[int, int]) -> np.ndarray:
        """The probe of row i of x that meets row i of y in table t; a large number if none does."""
        at = self.places(x, t, True)
        move = np.floor(self.places(y, t, False)) - np.floor(at)
        which, step = self.borders(at)
        rows = np.arange(len(x))[:, None]
        used = (move[rows, which] == step) << np.arange(2 * self.m) if self.m else np.zeros((len(x), 1), np.int64)
        never = 1 << 40
        met = np.array([rank.get(int(u), never) for u in used.sum(1)])
        return np.where((np.abs(move) <= 1).all(1), met, never)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column in double precision, with zeros up to `dim`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _best(q: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of q, its k best rows of v, their inner products): a product of matrices picks a few more, each of which is summed again in one order of additions."""
    rough = q @ v.T
    for i in range(len(q)):
        some = np.sort(np.argsort(-rough[i], kind="stable")[: k + 16])
        exact = (q[i] * v[some]).sum(1)
        order = np.argsort(-exact, kind="stable")[:k]
        yield i, some[order], exact[order]


def _blocks(members: DataFrame, probes: DataFrame, dim: int, k: int) -> DataFrame:
    """(q, v, lo, score): of each bucket's members (t, bucket, v, lo, vec) the k best of each probe (t, bucket, q, least, vec) that score `least` at least."""
    at = ["t", "bucket"]
    sizes = members.groupBy(at).agg(F.count("*").alias("nv")).join(probes.groupBy(at).agg(F.count("*").alias("nq")), at)
    sizes = sizes.select(*at, *(F.ceil(F.col(n) / BLOCK).cast("int").alias(n) for n in ("nv", "nq"))).filter("nv > 1 OR nq > 1")
    sizes = small(cut(sizes))

    def dealt(rows: DataFrame, own: str, other: str, key: str) -> DataFrame:
        rows = rows.join(sizes, at, "left")
        part, every = (F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))).cast("int"), F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        vb, qb = (part, every) if own == "nv" else (every, part)
        return rows.withColumn("vb", vb).withColumn("qb", qb).drop("nv", "nq")

    def near(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("lo")
        v, q, least = left["v"].to_numpy(), right["q"].to_numpy(), right["least"].to_numpy()
        lo, out = left["lo"].combine_chunks(), []
        if len(v) and len(q):
            for i, rows, score in _best(_matrix(right["vec"], dim), _matrix(left["vec"], dim), k):
                rows, score = rows[score >= least[i]], score[score >= least[i]]
                out.append((np.full(len(rows), q[i]), v[rows], rows, score))
        join = lambda c, kind: np.concatenate([x[c] for x in out]) if out else np.zeros(0, kind)
        return pa.table({"q": join(0, np.int64), "v": join(1, np.int64), "lo": lo.take(pa.array(join(2, np.int64))), "score": join(3, np.float64)})

    keys = [*at, "vb", "qb"]
    sides = dealt(members, "nv", "nq", "v").groupBy(keys).cogroup(dealt(probes, "nq", "nv", "q").groupBy(keys))
    return sides.applyInArrow(near, "q long, v long, lo long, score double")


def _keyed(rows: DataFrame, tables: Tables, dim: int, visits: slice | None = None) -> DataFrame:
    """The rows once for each table and bucket: members of their own bucket, queries of those that they visit by `visits`."""
    vec = rows.schema["vec"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column("vec"), dim)
                for t in range(tables.tables):
                    keys = tables.probes(x, t)[:, visits] if visits else tables.key(np.floor(tables.places(x, t, False)), t)[:, None]
                    for k in range(keys.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(np.ascontiguousarray(keys[:, k])), *part.columns], ["t", "bucket", *part.schema.names])

    return rows.mapInArrow(run, "t int, bucket long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "vec") + f", vec {vec}")


def fitted(asked: DataFrame, vectors: DataFrame, n: int, dim: int, top: float, k: int) -> Tables:
    """Tables and probes that find TARGET of the k nearest of SAMPLE queries, whose true neighbours are worked out against all vectors."""
    sample = asked.orderBy(F.xxhash64("q"), "q").limit(SAMPLE).toArrow()
    q, own = _matrix(sample["vec"], dim), sample["q"].to_numpy()

    def exact(batches):
        for batch in batches:
            x, v = _matrix(batch.column("vec"), dim), batch.column("v").to_numpy(zero_copy_only=False)
            for i, rows, score in _best(q, x, k + 1):
                rows, score = rows[v[rows] != own[i]], score[v[rows] != own[i]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i, np.int32)), pa.array(score), batch.column("vec").take(pa.array(rows))], ["i", "score", "vec"])

    kind = vectors.schema["vec"].dataType.simpleString()
    true = topk(vectors.select("v", "vec").mapInArrow(exact, f"i int, score double, vec {kind}"), "i", [F.col("score").desc()], k).toArrow()
    if not len(true):
        return Tables(dim, 0, 1, 1.0, top)
    x, y = q[true["i"].to_numpy()], _matrix(true["vec"], dim)
    far = np.sqrt(np.maximum(0, (x * x).sum(1) + top**2 - 2 * (x * y).sum(1)))
    width = WIDTH * float(np.median(far)) or top
    for m in range(max(0, round(np.log2(max(1, n / BUCKET)) / BITS)), 0, -1):
        for tables in TABLES:
            some = Tables(dim, m, tables, width, top, MOST_PROBES)
            rank = {sum(1 << j for j in a): k for k, a in enumerate(some.sets)}
            first = np.min([some.found_at(x, y, t, rank) for t in range(tables)], axis=0)
            probes = int(np.sort(first)[int(np.ceil(TARGET * len(first))) - 1]) + 1
            if probes <= MOST_PROBES:
                return Tables(dim, m, tables, width, top, probes)
    return Tables(dim, 0, 1, width, top)


def nearest(rows: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with `asked` the k rows of largest inner product that are found, ties to the smaller key.

    A vector that is null, zero or holds a null or non-finite component takes no part; shorter ones have zeros up to the longest. Rows that repeat a key with the
    same vector are one row; with another vector they are rows of their own. A row without a key can be found but not asked. Extra columns don't matter, an empty
    table gives no rows. Of equal vectors only the k + 1 smallest keys can be among the k nearest of anything, so those alone are carried; queries with equal
    vectors are answered together. A query for which fewer than k rows are found is compared with all.
    """
    part = F.col(vector)
    fine = F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(part, lambda x: x != 0)
    own = rows.select(F.col(key).cast("long").alias("id"), F.transform(part, lambda x: x + F.lit(0).cast("float")).alias("vec"), F.coalesce(asked, F.lit(False)).alias("asked")).filter(fine)
    own = own.withColumns({"a": F.xxhash64("vec"), "b": F.xxhash64(F.lit("vector"), "vec")})
    ids = own.groupBy("a", "b", "id").agg(F.any_value("vec").alias("vec"), F.max("asked").alias("asked"))
    ids = cut(ids)
    first = topk(ids, ["a", "b"], [F.col("id").asc_nulls_last()], k + 1, "r")
    vectors = first.groupBy("a", "b").agg(F.any_value("vec").alias("vec"), F.array_sort(F.collect_list(F.struct("r", "id"))).alias("ids"))
    wanted = ids.filter("asked AND id IS NOT NULL").select("a", "b").distinct().withColumn("asked", F.lit(True))
    vectors = vectors.join(wanted, ["a", "b"], "left").withColumn("v", F.monotonically_increasing_id())
    vectors = cut(vectors.withColumns({"ids": F.transform("ids", lambda x: x["id"]), "lo": F.coalesce(F.col("ids")[0]["id"], F.lit((1 << 63) - 1)), "asked": F.coalesce("asked", F.lit(False))}))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, dim, top = vectors.agg(F.count("*"), F.max(F.size("vec")), F.max(norm)).first()
    members, queries = vectors.select("v", "lo", "vec"), vectors.filter("asked").select(F.col("v").alias("q"), "vec")
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = queries.select("q", F.lit(float("-inf")).alias("least"), "vec")
    tables = fitted(queries, members, n, dim, top, k)
    found = cut(_blocks(_keyed(members, tables, dim), _keyed(queries, tables, dim, slice(0, 1)), dim, k + 1))
    if len(tables.sets) > 1:
        # the score that the own buckets give is what the perturbed ones are to reach
        best = topk(found.select("q", "v", "score").distinct(), "q", [F.col("score").desc()], k + 1, "r").filter(F.col("r") == k + 1).select("q", F.col("score").alias("known"))
        bound = queries.join(best, "q", "left").select("q", F.coalesce("known", "least").alias("least"), "vec")
        found = found.unionByName(_blocks(_keyed(members, tables, dim), _keyed(bound, tables, dim, slice(1, None)), dim, k + 1))
    best = _ranked(found, vectors, k)
    if tables.m:
        best = cut(best)
        short = queries.join(best.filter(F.size("found") > k).select("q"), "q", "left_anti")
        every = Tables(dim, 0, 1, 1.0, top)
        if not short.isEmpty():
            rest = _ranked(_blocks(_keyed(members, every, dim), _keyed(short, every, dim, slice(0, 1)), dim, k + 1), vectors, k)
            best = best.join(short.select("q"), "q", "left_anti").unionByName(rest)
    whose = vectors.filter("asked").select(F.col("v").alias("q"), "a", "b")
    lists = best.join(whose, "q").select("a", "b", "found")
    out = ids.filter("asked AND id IS NOT NULL").select("a", "b", F.col("id").alias("query_id")).join(lists, ["a", "b"])
    others = F.slice(F.filter("found", lambda x: ~x["id"].eqNullSafe(F.col("query_id")) | ~x["same"]), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def _ranked(pairs: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(q, found): the k + 1 best rows of each q with their scores, itself included; vectors found in several tables count once."""
    rank = F.dense_rank().over(_by("q", F.col("score").desc(), "lo", "v"))
    pairs = pairs.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("q", "v").agg(F.first("score").alias("score"))
    rows = pairs.join(vectors.select("v", "ids"), "v").select("q", "v", "score", F.explode("ids").alias("id"))
    rows = topk(rows, "q", [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("v")], k + 1, "r")
    found = F.array_sort(F.collect_list(F.struct("r", "id", "score", (F.col("q") == F.col("v")).alias("same"))))
    return rows.groupBy("q").agg(found.alias("found"))


def _by(group: str, *order):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(*order)


def op12_neighbours(spark, sf_dir):
    """The 20 nearest rows of every vector whose vec_id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, F.col("vec_id") % 20 == 0)


QUERIES = {"op12_neighbours": op12_neighbours}
