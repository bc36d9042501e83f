"""Helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side that was counted is broadcast.
BROADCAST_ROWS = 100_000


def topk(df: DataFrame, by: str | list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; Spark cuts each partition's groups before the shuffle."""
    by = [by] if isinstance(by, str) else by
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows; only as many are counted."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def spread(scan: DataFrame) -> DataFrame:
    """A scan over all cores: files of few row groups give few tasks, which work per row would then run in. A scan of enough tasks stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it a local session, as in tests, gets a new folder; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame, name: str = "tables") -> DataFrame:
    """Written to the shared folder and read back: what several steps use is worked out once, and the lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """A written table of the rows sorted by `order` over the whole cluster, nulls first; _id numbers them in that order, with gaps between parts."""
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))


def merge(base: DataFrame, updates: DataFrame, key: str | list[str], version: Column | None = None) -> DataFrame:
    """Upsert: rows of base without the updates' keys, and of the updates one row a key, the latest by `version`."""
    key = [key] if isinstance(key, str) else key
    order = [(version if version is not None else F.lit(0)).desc(), *(F.col(c).desc() for c in updates.columns if c not in key and dict(updates.dtypes)[c].split("<")[0] not in ("map",))]
    last = updates.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")
    return base.join(last.select(*key), key, "left_anti").unionByName(last.select(*base.columns))
