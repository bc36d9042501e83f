"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.common import shared_dir

#: Bytes of text that one vectorised step inside a task works on; a step's arrays take some forty times as much.
STEP_BYTES = 1 << 20
#: Powers that a worker keeps from step to step; a longer text gets its own, which go with it.
KEPT_POWERS = (1 << 20) + (1 << 16)
#: Distinct values up to which their counts are broadcast.
BROADCAST_VALUES = 10_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(key: Column, m: int) -> Column:
    """crc32(key as text) mod m; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % m


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write to the shared folder, in a folder for each value of `by`, and read back: the lineage ends there, a lost executor costs no rerun, and the shuffle files are freed."""
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_dir(spark)}/{uuid.uuid4().hex}", spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """A written table of the rows sorted by `order` over the whole cluster, nulls first: _part is the number of a row's part, _at its place there and _id both."""
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return cut(own.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}))


def bounded_sample(rows: DataFrame, by: str, n: int, key: str = "doc_id") -> DataFrame:
    """Of each value of `by` the n rows with the smallest hash of `key`. Only a share of a large value's rows, about 2 n, is sorted."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("_size"))
    if sizes.count() <= BROADCAST_VALUES:  # else a value with most rows would be shuffled to one task before the cut
        sizes = F.broadcast(sizes)
    rank = F.xxhash64(key)
    share = F.pmod(rank, F.lit(1 << 40)) / F.lit(float(1 << 40))
    some = rows.join(sizes, by).filter(share * F.col("_size") <= 2 * n + 100)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.pmod(rank, F.lit(1 << 40)), key))
    return some.withColumn("_place", place).filter(F.col("_place") <= n).drop("_size", "_place")


def text_steps(batch: pa.RecordBatch, column: str = "text", size: int = STEP_BYTES) -> Iterator[tuple[slice, pa.Array]]:
    """(rows, their texts as a string array without nulls), in steps of about `size` bytes; one long text is a step of its own."""
    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        to = max(at + 1, to)
        yield slice(at, to), pc.fill_null(texts.slice(at, to - at), "")
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without nulls; offsets start at 0."""
    texts = pa.concat_arrays([texts.cast(pa.large_binary())])
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i, empty segments included."""
    if not len(values):
        return np.zeros(len(offsets) - 1, values.dtype)
    # the appended 0 lets a segment begin at the end; reduceat gives the value itself for an empty one
    out = np.add.reduceat(np.append(values, values.dtype.type(0)), offsets[:-1])
    out[offsets[1:] == offsets[:-1]] = 0
    return out


def worker_cache(name: str, make):
    """What make() gives, once for each Python worker: tasks that follow on the same worker find it again."""
    store = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd number and of its inverse, modulo 2**64."""
    have = worker_cache("powers", lambda: [np.ones(1, np.uint64)] * 2)
    if len(have[0]) > n:
        return have[0], have[1]
    size, out = max(n + 1, min(2 * n, KEPT_POWERS)), []
    for p in (_P, pow(_P, -1, 1 << 64)):
        steps = np.full(size, p, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps, out=steps))
    if size <= KEPT_POWERS:
        have[:] = out
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = P**i * (polynomial hash of data[i:j]), modulo 2**64."""
    p, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal bytes give equal hashes anywhere."""
    _, q = _powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * q[starts] ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, offsets of each text's words). Words are runs without ASCII white space, A-Z lower-cased."""
    at, data = buffers(texts)
    data = _LOWER[data]
    solid = ~_SPACE[data]
    before = np.append(False, solid[:-1]) if len(solid) else solid
    first = solid & ~before
    inner = at[1:-1][at[1:-1] < len(data)]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    after = np.append(solid[1:], False) if len(solid) else solid
    last = solid & ~after
    ends_at = inner[inner > 0] - 1
    last[ends_at] = solid[ends_at]
    ends = np.flatnonzero(last) + 1
    return span_hashes(prefix_sums(data), starts, ends), np.searchsorted(starts, at)
