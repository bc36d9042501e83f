"""Tables that are updated by key in batches: a base and small deltas, merged on read, folded together when the deltas have grown.

A batch writes its own rows alone, in a folder of its number, so writing it again changes nothing. A row of the log stands for each finished folder; what is not in the
log is not read. The first batch becomes the base as it lies. Folders hold a partition for each bucket of the key's hash, so a reader of some keys leaves the others' buckets unread.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a table, and the share of the base's rows that its deltas reach before they are folded into it.
BUCKETS, FOLD = 16, 0.25


class Table(NamedTuple):
    spark: SparkSession
    path: str
    key: str
    buckets: int = BUCKETS


def _bucket(t: Table) -> Column:
    return F.pmod(F.xxhash64(F.col(t.key)), F.lit(t.buckets)).cast("int")


def _log(t: Table) -> list[tuple[int, str, int, str]]:
    """(number, kind, rows, folder) of the finished folders that count: the last base and what came after it."""
    try:
        rows = sorted((r.number, r.kind, r.n, r.folder or f"{r.kind}/number={r.number}") for r in t.spark.read.schema("number long, kind string, n long, folder string").parquet(f"{t.path}/log").collect())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    base = max((n for n, kind, _, _ in rows if kind == "base"), default=-1)
    return [r for r in rows if (r[1] == "base" and r[0] == base) or (r[1] == "delta" and r[0] > base)]


def _write(t: Table, rows: DataFrame, number: int, kind: str) -> None:
    """Rows with their _bucket."""
    path = f"{t.path}/{kind}/number={number}"
    rows.write.mode("overwrite").partitionBy("_bucket").parquet(path)
    _enter(t, number, kind, t.spark.read.schema(rows.schema).parquet(path).count(), f"{kind}/number={number}")


def _enter(t: Table, number: int, kind: str, n: int, folder: str) -> None:
    t.spark.createDataFrame([(number, kind, n, folder)], "number long, kind string, n long, folder string").coalesce(1).write.mode("overwrite").parquet(f"{t.path}/log/entry={kind}-{number}")


def _last(t: Table, rows: DataFrame, version: Column) -> DataFrame:
    """One row a key, the latest; of equally late ones the greatest. Rows are dealt once, by parts of the buckets that they are then written to."""
    plain = [F.col(c).desc() for c, kind in rows.dtypes if c != t.key and "map<" not in kind]
    parts = -(-4 * int(t.spark.conf.get("spark.sql.shuffle.partitions")) // t.buckets)
    dealt = rows.withColumns({"_bucket": _bucket(t), "_part": F.pmod(F.xxhash64(F.lit("part"), F.col(t.key)), F.lit(parts))}).repartition("_bucket", "_part")
    first = F.row_number().over(Window.partitionBy("_bucket", "_part", t.key).orderBy(version.desc(), *plain))
    return dealt.withColumn("_r", first).filter("_r = 1").drop("_r", "_part")


def put(t: Table, rows: DataFrame, number: int, version: str | None = None, deleted: Column | None = None) -> None:
    """Batch `number`: inserts and replaces rows by key; where `deleted` holds, the key goes. Of a key's rows in the batch the latest by `version` counts."""
    if any(kind == "base" and n >= number for n, kind, _, _ in _log(t)):
        return  # this batch is in the base already
    own = _last(t, rows, F.col(version) if version else F.lit(0))
    _write(t, own.withColumn("_deleted", F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)), number, "delta")


def read(t: Table, keys: list | None = None) -> DataFrame:
    """The rows as they are after all batches; with `keys` those of these keys, from their buckets alone."""
    log = _log(t)
    if not log:
        raise ValueError(f"no batch has been written to {t.path}")
    parts = {kind: [t.spark.read.parquet(f"{t.path}/{folder}").withColumn("_number", F.lit(n)) for n, k, _, folder in log if k == kind] for kind in ("base", "delta")}
    if keys is not None:
        asked = t.spark.createDataFrame([(k,) for k in keys], t.spark.createDataFrame([], parts[log[0][1]][0].select(t.key).schema).schema)
        some = sorted({r[0] for r in asked.select(_bucket(t)).collect()})
        parts = {kind: [p.filter(F.col("_bucket").isin(some) & F.col(t.key).isin(keys)) for p in own] for kind, own in parts.items()}
    parts["base"] = [p.filter("NOT _deleted") if "_deleted" in p.columns else p for p in parts["base"]]
    if not parts["delta"]:
        return parts["base"][0].drop("_bucket", "_number", "_deleted")
    deltas = parts["delta"][0]
    for p in parts["delta"][1:]:
        deltas = deltas.unionByName(p)
    # a key stands once in each folder, so its latest folder has its row
    newest = deltas
    if len(parts["delta"]) > 1:
        newest = deltas.withColumn("_top", F.max("_number").over(Window.partitionBy(t.key))).filter("_number = _top").drop("_top")
    live = newest.filter("NOT _deleted").drop("_bucket", "_number", "_deleted")
    if not parts["base"]:
        return live
    return parts["base"][0].drop("_bucket", "_number", "_deleted").join(newest.select(t.key), t.key, "left_anti").unionByName(live)


def fold(t: Table, share: float = FOLD) -> bool:
    """Writes base and deltas as a new base if the deltas have over `share` of the base's rows; a lone delta is entered as the base."""
    log = _log(t)
    base, more = sum(n for _, kind, n, _ in log if kind == "base"), sum(n for _, kind, n, _ in log if kind == "delta")
    if not more or more <= share * base:
        return False
    if len(log) == 1:
        _enter(t, log[0][0], "base", log[0][2], log[0][3])
    else:
        _write(t, read(t).withColumn("_bucket", _bucket(t)).hint("rebalance", "_bucket"), max(number for number, *_ in log), "base")
    return True
