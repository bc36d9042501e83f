"""Products of two tables in blocks: rows that share a key meet as pairs of blocks of bounded size, however many rows the key has."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small

#: Rows of one block of members and of one block of probes.
MEMBERS, PROBES = 16_384, 1_024


def fitted(members: DataFrame, probes: DataFrame, size: tuple[int, int]) -> tuple[int, int]:
    """Sizes for `products` without a key: a block of members gives each probe its best, so it stays large, and blocks of probes get smaller until every core has a pair."""
    pairs, cores = -(-members.count() // size[0]), members.sparkSession.sparkContext.defaultParallelism
    return size[0], max(1, min(size[1], -(-probes.count() * pairs // cores)))


def products(members: DataFrame, probes: DataFrame, on: list[str], member_key: str, probe_key: str, near: Callable[[pa.Table, pa.Table], pa.Table], schema: str, size: tuple[int, int] = (MEMBERS, PROBES)) -> DataFrame:
    """What near(block of members, block of probes) gives for each pair of blocks of each key in `on`; without a key all rows share one.

    A key's members are dealt by hash over as many blocks as their number asks for, and so are its probes; each block of the one side travels to each of the other.
    """
    if not on:
        on, members, probes = ["_one"], members.withColumn("_one", F.lit(0)), probes.withColumn("_one", F.lit(0))
    counts = members.groupBy(on).agg(F.count("*").alias("_m")).join(probes.groupBy(on).agg(F.count("*").alias("_p")), on)
    counts = counts.select(*on, *(F.ceil(F.col(c) / n).cast("int").alias(c) for c, n in zip(("_m", "_p"), size, strict=True))).filter("_m > 1 OR _p > 1")
    counts = small(cut(counts))

    def dealt(rows: DataFrame, own: str, other: str, key: str) -> DataFrame:
        rows = rows.join(counts, on, "left")
        rows = rows.withColumn(f"{own}b", F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))).cast("int"))
        return rows.withColumn(f"{other}b", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop(own, other)

    keys = [*on, "_mb", "_pb"]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return near(left, right)

    return dealt(members, "_m", "_p", member_key).groupBy(keys).cogroup(dealt(probes, "_p", "_m", probe_key).groupBy(keys)).applyInArrow(run, schema)
