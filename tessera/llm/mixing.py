"""Mixing sources to target weights by Pfair scheduling: blocks get releases and deadlines from their source's exact weight, and
earliest-deadline-first deals the slots.

Ideally each source that has rows left flows at its weight's share, so after a time x the sources have given G(x) = sum of min(u x, n) blocks. The i-th block of a source
(from 0) is released at floor(G(i / u)) and due at ceil(G((i + 1) / u)); all is reckoned in whole numbers, so nothing is rounded to a period. The flow itself keeps all
windows, hence earliest-deadline-first does, and every prefix holds each source's share to less than one block, also where sources end.

The slots are dealt in chunks side by side. Which blocks are done when a chunk begins at slot t follows from the windows alone. Those due by t are; their number tells how many
of the straddlers (released before t, due after it; one a source at most) are too, say k. Sets of straddlers that can be done by t are those that leave room for all later
releases before t, which is a matroid, and earliest-deadline-first takes the k first by deadline that it allows. A run that begins empty at any slot before the straddlers'
releases meets the same later releases, hence allows the same ones: a chunk first runs over the `reach` slots before it, keeps the k first of the straddlers that this run did, and
goes on from there. `reach` is the longest window. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents

UNITS = 1 << 20
BUCKET_ROWS = 20_000
#: Slots of a chunk at least; a chunk also has twice the longest window.
SLOTS = 512
#: Blocks that one row unfolds into.
RUN = 10_000
ADDED = ("position", "release", "deadline")
_JOBS = "array<struct<due: bigint, s: int, i: bigint, release: bigint>>"
_DONE = "array<struct<slot: bigint, due: bigint, s: int, i: bigint, release: bigint>>"


def source_units(docs: DataFrame, source: str = "source", power: float = 0.5, units: int = UNITS) -> DataFrame:
    """(source, n, u): rows and weight of each source, u = n ** power in steps of 1 / units: with a power of 0.5 that moves no source by a block up to 10^12 rows."""
    site = F.coalesce(F.col(source).cast("string"), F.lit(""))
    sizes = docs.groupBy(site.alias("source")).agg(F.count("*").alias("n"))
    return sizes.withColumn("u", F.greatest(F.lit(1), F.round(F.pow("n", F.lit(power)) * units).cast("long")))


def _share(flow: str, i: str, u: str, up: bool = False) -> Column:
    """floor or ceiling of flow * i / u, in whole numbers of up to 38 digits."""
    product = f"CAST({flow} AS DECIMAL(19, 0)) * CAST({i} AS DECIMAL(19, 0))"
    return F.expr(f"({product}{f' + {u} - 1' if up else ''}) div CAST({u} AS DECIMAL(19, 0))")


def blocks(units: DataFrame) -> DataFrame:
    """(s, source, i, release, due) of every block; s numbers the sources by name. `units` has a row for each source, which are few enough for one task and for a row for each two."""
    own = units.filter("n > 0").select("source", F.col("n").cast("long"), F.greatest(F.lit(1), F.col("u")).cast("long").alias("u"))
    by_end = Window.orderBy(F.col("n") / F.col("u"), "source")
    before, after = (by_end.rowsBetween(Window.unboundedPreceding, -1), by_end.rowsBetween(0, Window.unboundedFollowing))
    own = own.withColumns({
        "s": F.row_number().over(Window.orderBy("source")), "k": F.row_number().over(by_end) - 1,
        "given": F.coalesce(F.sum("n").over(before), F.lit(0)), "flow": F.sum("u").over(after),
    })
    own = cut(own)
    # while j sources have ended, source s gives its blocks lo..hi - 1
    times = own.select(F.col("k").alias("j"), F.col("n").alias("n_j"), F.col("u").alias("u_j"), "given", "flow")
    runs = own.select("source", "s", "n", "u", "k", F.explode(F.sequence(F.lit(0), "k")).alias("j")).join(times, "j")
    by_time = Window.partitionBy("s").orderBy("j")
    runs = runs.withColumn("hi", F.when(F.col("j") == F.col("k"), F.col("n")).otherwise(_share("u", "n_j", "u_j")))
    runs = runs.withColumn("lo", F.coalesce(F.lag("hi").over(by_time), F.lit(0).cast("long"))).filter("hi > lo")
    runs = runs.withColumns({"given_before": F.lag("given").over(by_time), "flow_before": F.lag("flow").over(by_time)})
    runs = runs.withColumn("first", F.coalesce(F.col("given_before") + _share("flow_before", "lo", "u"), F.lit(0)).cast("long"))
    runs = runs.withColumn("at", F.explode(F.expr(f"sequence(lo, hi - 1, {RUN}L)"))).repartition("s", "at")
    out = runs.withColumn("i", F.explode(F.expr(f"sequence(at, least(at + {RUN}L, hi) - 1)"))).withColumn("next", F.col("i") + 1)
    release = F.when(F.col("i") == F.col("lo"), F.col("first")).otherwise(F.col("given") + _share("flow", "i", "u"))
    return out.select("s", "source", "i", release.alias("release"), (F.col("given") + _share("flow", "next", "u", True)).alias("due"))


def _edf(steps: Column, end: Column, ready: Column) -> Column:
    """(ready, done) after earliest-deadline-first over `steps` (release, jobs), a step for each release in turn, up to slot `end`."""

    def step(acc: Column, j: Column) -> Column:
        own = F.get(steps, j)
        n = (F.coalesce(F.get(steps, j + 1)["release"], end) - own["release"]).cast("int")
        # transform over one element names the queue, which is sorted once
        queue = F.array(F.array_sort(F.concat(acc["ready"], own["jobs"])))
        done = lambda q: F.transform(F.slice(q, F.lit(1), n), lambda x, at: F.struct((own["release"] + at).alias("slot"), x["due"].alias("due"), x["s"].alias("s"), x["i"].alias("i"), x["release"].alias("release")))
        return F.get(F.transform(queue, lambda q: F.struct(F.slice(q, n + 1, F.size(q)).alias("ready"), F.concat(acc["done"], done(q)).alias("done"))), 0)

    none = F.array().cast(_DONE)
    return F.aggregate(F.sequence(F.lit(0), F.size(steps) - 1), F.struct(ready.alias("ready"), none.alias("done")), step)


def schedule(units: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(source, block, position, release, deadline) of all slots: of the released blocks the one that is due first goes, ties to the first source by name.
    A chunk is a row of arrays, with the blocks released in it and in the `reach` slots before it."""
    total, flow, least = units.filter("n > 0").agg(F.sum("n"), F.sum("u"), F.min("u")).first()
    reach = (flow or 0) // max(1, least or 1) + 2
    span = max(slots, 2 * reach)
    own = blocks(units)
    # blocks due by the start of each chunk
    due = own.groupBy(F.expr(f"(due + {span - 1}) div {span}").alias("c")).agg(F.count("*").alias("n")).withColumn("far", F.expr("c div 4096"))
    due = cut(due)
    far = due.groupBy("far").agg(F.sum("n").alias("m"))
    far = far.select("far", F.coalesce(F.sum("m").over(Window.orderBy("far").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    due = due.join(far, "far").select("c", (F.col("before") + F.sum("n").over(Window.partitionBy("far").orderBy("c"))).alias("due_by"))
    chunk = F.expr(f"release div {span}")
    again = (F.col("release") >= (chunk + 1) * span - reach) & ((chunk + 1) * span < (total or 0))
    dealt = own.select(F.explode(F.when(again, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))).alias("c"), "release", F.struct("due", "s", "i", "release").alias("job"))
    steps = dealt.repartition("c").groupBy("c", "release").agg(F.collect_list("job").alias("jobs"))
    steps = steps.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("release", "jobs"))).alias("steps")).join(due, "c", "left")
    start, end = F.col("c") * span, F.least((F.col("c") + 1) * span, F.lit(total or 0))
    none = F.array().cast(_JOBS)
    at_start = F.array(F.struct(start.alias("release"), none.alias("jobs")))
    before = F.array(F.struct(F.greatest(start - reach, F.lit(0)).alias("release"), none.alias("jobs")))
    steps = steps.withColumns({
        "early": F.concat(before, F.filter("steps", lambda x: x["release"] < start)), "own": F.concat(at_start, F.filter("steps", lambda x: x["release"] >= start)),
    }).withColumn("run", _edf(F.col("early"), start, none))
    done = F.array_sort(F.transform(F.filter("run.done", lambda x: x["due"] > start), lambda x: F.struct(x["due"].alias("due"), x["s"].alias("s"), x["i"].alias("i"), x["release"].alias("release"))))
    steps = steps.withColumn("done", done).withColumn("k", F.when(start > 0, start - F.col("due_by")).otherwise(0).cast("int"))
    ready = F.concat("run.ready", F.slice("done", F.col("k") + 1, F.size("done")))
    out = steps.select(F.explode(_edf(F.col("own"), end, ready)["done"]).alias("x"))
    out = out.select("x.s", F.col("x.i").alias("block"), F.col("x.slot").alias("position"), "x.release", F.col("x.due").alias("deadline"))
    names = units.filter("n > 0").select("source", F.row_number().over(Window.orderBy("source")).alias("s"))
    return out.join(names, "s").select("source", "block", "position", "release", "deadline")


def numbered(docs: DataFrame, source: str, key: str, rows: int) -> DataFrame:
    """Adds _source and _i, a number from 0 within the source, in an order mixed by hash of `key`. A source is numbered in buckets of at most
    about BUCKET_ROWS rows whose offsets are summed up first, so that no task gets a whole source."""
    buckets = max(64, rows // BUCKET_ROWS)
    site = F.coalesce(F.col(source).cast("string"), F.lit(""))
    bucket = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(buckets))
    own = docs.withColumn("_source", site).withColumn("_bucket", bucket)
    counts = own.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_source", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy(F.xxhash64(F.col(key)), key))
    out = own.withColumn("_r", within).join(counts, ["_source", "_bucket"])
    return out.withColumn("_i", F.col("_before") + F.col("_r") - 1).drop("_bucket", "_before", "_r")


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", units: DataFrame | None = None) -> DataFrame:
    """`docs` with block, release, deadline and position: a permutation 0..n-1 in which every prefix holds each source's share, by the weights of
    the sources that have rows left, to less than one block. No row is dropped or repeated. `units`: (source, n, u), else source_units(docs).
    Columns of docs that have these four names are replaced."""
    units = cut(source_units(docs, source) if units is None else units)
    dealt = cut(schedule(units)).select(F.col("source").alias("_source"), F.col("block").alias("_i"), *(F.col(c).alias(f"_{c}") for c in ADDED))
    out = numbered(docs, source, key, docs.count()).join(dealt, ["_source", "_i"])
    own = [c for c in docs.columns if c not in ("block", *ADDED)]
    return out.select(*own, F.col("_i").cast("long").alias("block"), *(F.col(f"_{c}").alias(c) for c in ADDED))


def op6_mixing(spark, sf_dir):
    """Every document with its place in the mixture of sources, weights by the square root of their sizes.

    Null sources form one source; repeated rows and rows without a doc_id get a place each, ties between them being open; texts are not read; an empty table gives none.
    """
    return mix(documents(spark, sf_dir).select("doc_id", "source"))


QUERIES = {"op6_mixing": op6_mixing}
