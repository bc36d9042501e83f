"""Prefix trie of conversations as a z-fast trie over tables.

A node of the compacted trie is the root, the end of a conversation or a fork. Its edge covers the depths (top, depth] and is found by one handle, the prefix whose
length is the two-fattest number (most trailing zeros) of these depths. A conversation's exit node takes a fat binary search: each round looks up the prefix of
two-fattest length of the depths still open, by a join with the handles, for all conversations at once. Batches are inserted by locating their exits, splitting the
edges that they leave, and hanging new edges below. At the end edges are expanded to a node for each turn.

A prefix is told by its depth and 128 bits: the exclusive or of hashes of (place, role, text), so that runs of one conversation in many parts join their sums.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_order

#: Batches hold these shares, in 16ths of the distinct conversations.
BATCHES = (2, 14)
#: Ids of a piece that are joined before a node's digest takes them.
PIECE = 4096
NODE = ["depth", "a", "b"]


def two_fattest(low: str, high: str) -> Column:
    """The number in (low, high] with the most trailing zeros."""
    return F.expr(f"{high} & shiftleft(-1L, length(bin({low} ^ {high})) - 1)")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns, runs, ends) of the rebuilt conversations: turns (conv, part, d, u, v, chars, a, b, c) has each turn with its hashes, and those and the code points of all
    turns of its part so far; runs (conv, part, a0, b0, c0) those before a part; ends (conv, len, a, b) each conversation with its whole hash."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    own = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.left(text, F.lit(64)).alias("head"),
                                                    F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit("turn"), text, role).alias("y"), F.length(text).cast("long").alias("chars"))
    lines = in_order(own, "conv", "turn", "role", "head", "x", "y").select("conv", F.col("_part").alias("part"), "_at", "x", "y", "chars")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("conv", "part").agg(F.min("_at").alias("start"), F.count("*").alias("n"))
    parts = cut(parts.withColumns({"behind": F.coalesce(F.sum("n").over(before), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("conv")), "h": F.crc32(F.col("conv").cast("string").cast("binary")) % 6, "base": F.col("conv") - F.col("conv") % 100}))
    place = F.col("behind") + F.col("_at") - F.col("start") + 1
    heads = lines.filter("conv % 100 = 0").join(parts.filter("conv = base AND behind < 5").select("conv", "part", "start", "behind"), ["conv", "part"])
    heads = heads.select(F.col("conv").alias("base"), place.alias("place"), "x", "y", "chars").filter("place <= 5")
    # a conversation takes what there is of the first h turns of its base
    taken = parts.filter("conv = base").select("base", F.col("all").alias("m")).distinct()
    parts = parts.join(taken, "base", "left").withColumn("own", F.least("h", F.coalesce("m", F.lit(0))))
    first = parts.filter("behind = 0").join(heads, "base").filter("place <= own").select("conv", F.lit(-1).alias("part"), F.col("place").alias("d"), "x", "y", "chars")
    later = lines.join(parts.select("conv", "part", "start", "behind", "h", "own"), ["conv", "part"]).withColumn("place", place).filter("place > h")
    later = later.select("conv", "part", (F.col("own") + F.col("place") - F.col("h")).alias("d"), "x", "y", "chars")
    turns = first.unionByName(later).withColumns({"u": F.xxhash64("d", "x", "y"), "v": F.xxhash64(F.lit("place"), "y", "d", "x")})
    inside = Window.partitionBy("conv", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    turns = cut(turns.select("conv", "part", "d", "u", "v", "chars", F.bit_xor("u").over(inside).alias("a"), F.bit_xor("v").over(inside).alias("b"), F.sum("chars").over(inside).alias("c")))
    runs = turns.groupBy("conv", "part").agg(F.bit_xor("u").alias("a"), F.bit_xor("v").alias("b"), F.sum("chars").alias("c"))
    sums = (("a", F.bit_xor), ("b", F.bit_xor), ("c", F.sum))
    runs = cut(runs.select("conv", "part", "a", "b", *(F.coalesce(f(n).over(before), F.lit(0)).alias(f"{n}0") for n, f in sums)))
    whole = runs.groupBy("conv").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    length = (F.col("own") + F.greatest(F.col("all") - F.col("h"), F.lit(0))).cast("long")
    ends = parts.filter("behind = 0").select("conv", length.alias("len")).join(whole, "conv", "left").select("conv", "len", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return turns, runs.select("conv", "part", "a0", "b0", "c0"), cut(ends)


def _paths(turns: DataFrame, runs: DataFrame, strings: DataFrame) -> DataFrame:
    """(conv, d, a, b, pa, pb, c, chars, n) of the strings' conversations: the hashes of each prefix with and without its last turn, and its code points."""
    runs = runs.join(strings.select(F.col("rep").alias("conv"), "n"), "conv")
    a, b = F.col("a").bitwiseXOR(F.col("a0")), F.col("b").bitwiseXOR(F.col("b0"))
    return turns.join(runs, ["conv", "part"]).select("conv", "d", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("u")).alias("pa"), b.bitwiseXOR(F.col("v")).alias("pb"), (F.col("c") + F.col("c0")).alias("c"), "chars", "n")


def _look(rows: DataFrame, paths: DataFrame, rep: str, d: str, **names: str) -> DataFrame:
    """Adds columns of the path of conversation `rep` at depth `d`."""
    return rows.join(paths.select(F.col("conv").alias(rep), F.col("d").alias(d), *(F.col(c).alias(n) for n, c in names.items())), [rep, d], "left")


def _complete(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges (top, depth, a, b, rep) with their handle (f, fa, fb), first turn (sa, sb), parent (ta, tb) and code points (c above, ec at the end)."""
    own = edges.select("top", *NODE, "rep", two_fattest("top", "depth").alias("f"))
    asked = own.withColumn("d", F.explode(F.array_distinct(F.array(F.col("f"), F.col("top") + 1, F.col("depth")))))
    asked = asked.join(paths.select(F.col("conv").alias("rep"), "d", F.col("a").alias("xa"), F.col("b").alias("xb"), "pa", "pb", "c", "chars"), ["rep", "d"])
    at = lambda depth, value, name: F.max(F.when(F.col("d") == depth, value)).alias(name)
    first, end = F.col("top") + 1, F.col("depth")
    got = [at(F.col("f"), F.col("xa"), "fa"), at(F.col("f"), F.col("xb"), "fb"), at(first, F.col("xa"), "sa"), at(first, F.col("xb"), "sb"), at(first, F.col("pa"), "ta"), at(first, F.col("pb"), "tb")]
    return asked.groupBy("top", *NODE, "rep", "f").agg(*got, at(first, F.col("c") - F.col("chars"), "c"), at(end, F.col("c"), "ec"))


def locate(nodes: DataFrame, strings: DataFrame, paths: DataFrame) -> DataFrame:
    """The exit of each string (rep, len, a, b): low is the depth of its deepest node, l the depth up to which the trie has it, and with l > low the edge that it
    leaves is (e_top, e_depth, e_a, e_b, e_rep)."""
    edge = ["e_top", "e_depth", "e_a", "e_b", "e_rep"]
    handles = nodes.select("f", "fa", "fb", *(F.col(c[2:]).alias(c.replace("e_", "g_")) for c in edge))
    left = strings.select("rep", "len", F.lit(0).cast("long").alias("low"), F.col("len").alias("high"), *(F.lit(None).cast("long").alias(c) for c in edge))
    closed = None
    while True:
        # a handle that is met leads below its edge at once, as what parts from the edge meets no handle further down; whether it does is looked up after the last round
        probe = _look(left.withColumn("f", two_fattest("low", "high")), paths, "rep", "f", fa="a", fb="b").join(handles, ["f", "fa", "fb"], "left")
        hit = F.col("g_depth").isNotNull()
        low, high = F.when(hit, F.col("g_depth")).otherwise(F.col("low")), F.when(hit, F.col("high")).otherwise(F.col("f") - 1)
        step = cut(probe.select("rep", "len", low.alias("low"), high.alias("high"), *(F.when(hit, F.col(c.replace("e_", "g_"))).otherwise(F.col(c)).alias(c) for c in edge)))
        shut = step.filter("low >= high")
        closed = shut if closed is None else closed.unionByName(shut)
        left = step.filter("low < high")
        if left.isEmpty():
            break
    closed = closed.withColumn("end", F.least("low", "len"))
    seen = _look(closed, paths, "rep", "end", xa="a", xb="b")
    whole = F.col("e_depth").isNull() | ((F.col("e_depth") <= F.col("len")) & (F.col("xa") == F.col("e_a")) & (F.col("xb") == F.col("e_b")))
    seen = seen.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("low", F.when(F.col("whole"), F.col("low")).otherwise(F.col("e_top")))
    # what goes on below its deepest node may share the beginning of an edge that it leaves before the edge's handle
    starts = nodes.select(F.col("top").alias("low"), "sa", "sb", *(F.col(c[2:]).alias(c.replace("e_", "g_")) for c in edge))
    seen = _look(seen.withColumn("d", F.when(F.col("whole"), F.col("low") + 1)), paths, "rep", "d", sa="a", sb="b").join(starts, ["low", "sa", "sb"], "left")
    found = cut(seen.select("rep", "len", "low", *(F.when(F.col("whole"), F.col(c.replace("e_", "g_"))).otherwise(F.col(c)).alias(c) for c in edge)))
    on_edge = found.filter("e_depth IS NOT NULL").select(F.col("rep").alias("conv"), "len", "low", "e_depth", "e_rep")
    mine = paths.join(on_edge, "conv").filter("d > low AND d <= least(len, e_depth)").select("conv", "d", "a", "b", "e_rep")
    same = _look(mine, paths, "e_rep", "d", ya="a", yb="b").filter("a = ya AND b = yb").groupBy(F.col("conv").alias("rep")).agg(F.max("d").alias("l"))
    return cut(found.join(same, "rep", "left").withColumn("l", F.coalesce("l", "low")).join(strings.select("rep", "a", "b"), "rep"))


def insert(nodes: DataFrame | None, strings: DataFrame, paths: DataFrame) -> DataFrame:
    """The trie with a batch of distinct strings (rep, len, a, b)."""
    if nodes is None:
        at = strings.select("rep", "len", "a", "b", F.lit(0).cast("long").alias("l"))
    else:
        found = locate(nodes, strings, paths)
        at = found.select("rep", "len", "a", "b", "l")
    beyond = paths.join(at.filter("len > l").select(F.col("rep").alias("conv"), "l"), "conv").filter("d > l")
    beyond = cut(beyond.select(F.col("conv").alias("rep"), "l", F.col("d").alias("depth"), "a", "b", "pa", "pb"))
    turn = F.struct("a", "b")
    forks = beyond.filter("depth - 1 > l").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.min(turn).alias("x"), F.max(turn).alias("y"))
    points = forks.filter("x <> y").select(*NODE).union(at.filter("len > l").select("len", "a", "b")).distinct()
    way = Window.partitionBy("rep").orderBy("depth")
    hung = beyond.join(points, NODE).withColumn("top", F.coalesce(F.lag("depth").over(way), "l"))
    edges = hung.groupBy(*NODE).agg(F.min("top").alias("top"), F.min("rep").alias("rep")).select("top", *NODE, "rep")
    if nodes is None:
        return cut(_complete(edges, paths))
    cuts = found.filter("l > low").select(*(F.col(f"e_{c}").alias(c) for c in ("top", *NODE, "rep")), F.col("l").alias("d")).distinct()
    cuts = cut(_look(cuts, paths, "rep", "d", la="a", lb="b"))
    whole = cuts.select("top", *NODE, "rep").distinct()
    bits = cuts.unionByName(whole.withColumns({"d": F.col("depth"), "la": F.col("a"), "lb": F.col("b")}))
    above = F.lag("d").over(Window.partitionBy(*NODE).orderBy("d"))
    bits = bits.select(F.coalesce(above, "top").alias("top"), F.col("d").alias("depth"), F.col("la").alias("a"), F.col("lb").alias("b"), "rep")
    return cut(nodes.join(whole, NODE, "left_anti").unionByName(_complete(bits.unionByName(edges), paths)))


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of nodes where conversations end. Ids are joined in pieces of sorted parts; a digest takes its bytes in order, piece by piece."""
    lines = in_order(ends.withColumnRenamed("len", "depth"), *NODE, "conv")
    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string"))
    pieces = lines.groupBy(*NODE, "_part", F.floor(F.col("_at") / PIECE).alias("block")).agg(F.array_join(ids, ",").alias("piece"))

    def run(batches):
        at, sha = None, None
        for batch in batches:
            out = []
            for *key, piece in zip(*(batch.column(c).to_pylist() for c in (*NODE, "piece")), strict=True):
                if key != at:
                    if sha:
                        out.append((*at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(piece.encode())
            yield as_batch(out)
        if sha:
            yield as_batch([(*at, sha.hexdigest())])

    def as_batch(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], [*NODE, "ends_sha256"])

    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "_part", "block").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of the rebuilt conversations.

    Turns go by turn (nulls first); ties by role, the first 64 characters of the text and its hash, so repeated rows stand side by side and count as turns each. A null
    role or text is empty. Rows without a conv_id belong to no conversation. Extra columns don't matter, an empty table gives no rows, and texts of any length count
    by their hashes alone. Copies of a conversation are one string of the trie; one conversation may hold most rows and spreads over many parts.
    """
    turns, runs, ends = rebuilt(rows)
    strings = cut(ends.filter("len > 0").groupBy("len", "a", "b").agg(F.min("conv").alias("rep"), F.count("*").alias("n")))
    paths = cut(_paths(turns, runs, strings))
    batch, nodes, low = F.pmod(F.xxhash64("rep"), F.lit(16)), None, 0
    for share in BATCHES:
        some = strings.filter((batch >= low) & (batch < low + share))
        if not some.isEmpty():
            nodes = insert(nodes, some, paths)
        low += share
    empty = hashlib.sha256().hexdigest()
    found = _digests(ends)
    root = {c: F.lit(0).cast("long").alias(c) for c in NODE}
    every = ends.agg(F.count("*").alias("n"), F.min("conv").alias("m")).filter("n > 0").select(*root.values(), "n", "m")
    if nodes is None:
        only = every.join(found, NODE, "left")
        return only.select(F.col("m").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("n_children"),
                           F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    # the nodes on each string's path; what a node sums up below it, it gets from the strings and nodes that have it on their path
    way = cut(paths.select("conv", F.col("d").alias("depth"), "a", "b", "n").join(nodes.select(*NODE), NODE))
    counts = cut(way.groupBy(*NODE).agg(F.sum("n").alias("n"), F.min("conv").alias("m")).unionByName(every))
    below = nodes.groupBy(F.col("top").alias("depth"), F.col("ta").alias("a"), F.col("tb").alias("b")).agg(F.count("*").alias("n_children"))
    sized = cut(nodes.join(counts, NODE).join(below, NODE, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "edge": (F.col("n") - 1) * (F.col("ec") - F.col("c"))}))
    own = sized.select("rep", F.col("depth").alias("bottom"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("edge").alias("saved"))
    above = own.join(way.select(F.col("conv").alias("rep"), *NODE), "rep").filter("depth <= bottom").select(*NODE, "n_leaves", "saved")
    sums = [F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")]
    sums = cut(above.groupBy(*NODE).agg(*sums).unionByName(own.agg(*sums).select(*root.values(), "n_leaves", "saved")))
    parent = counts.select(F.col("depth").alias("top"), F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("m").alias("pm"))
    full = sized.drop("n_leaves").join(sums, NODE).join(parent, ["top", "ta", "tb"]).join(found, NODE, "left")
    spread = full.withColumn("d", F.explode(F.sequence(F.col("top") + 1, F.col("depth"))))
    spread = _look(spread, paths, "rep", "d", dc="c", chars="chars")
    end = F.col("d") == F.col("depth")
    out = spread.select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("top") + 1, F.col("pm")).otherwise(F.col("m")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(end, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("saved") - F.col("edge") + (F.col("n") - 1) * (F.col("ec") - F.col("dc") + F.col("chars"))).alias("saved_tokens"),
        F.coalesce(F.when(end, F.col("ends_sha256")), F.lit(empty)).alias("ends_sha256"),
    )
    top = every.join(below, NODE).join(sums, NODE).join(found, NODE, "left")
    top = top.select(F.col("m").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    return out.unionByName(top)


def op13_trie(spark, sf_dir):
    """Every node of the trie of `conversations`."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


ORACLE = {
    "op13_trie": """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, count(*) AS n, c - c % 100 AS base, list_reduce(list_concat([4294967295::UBIGINT], list_transform(list_filter(string_split(c::VARCHAR, ''), lambda s: s <> ''), lambda s: ascii(s)::UBIGINT)),
  lambda z, y: list_reduce(list_concat([xor(z, y)], [0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]), lambda u, w: xor(u >> 1, 3988292384::UBIGINT * (u & 1)))) AS z FROM t GROUP BY c),
h AS (SELECT c, n, base, (xor(z, 4294967295::UBIGINT) % 6)::BIGINT AS h FROM k),
o AS (SELECT h.*, least(h, (SELECT count(*) FROM t WHERE t.c = h.base)) AS own FROM h),
b AS (SELECT o.c, t.p AS d, r, x FROM o JOIN t ON t.c = o.base AND t.p <= o.own UNION ALL SELECT o.c, own + p - h, r, x FROM o JOIN t USING (c) WHERE p > h),
w AS (SELECT c, d, x, string_agg(sha256(r || chr(1) || x), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS key, NULL AS e FROM b),
g AS (SELECT c, 0 AS d, '' AS x, '' AS key FROM o UNION ALL SELECT c, d, x, key FROM w),
l AS (SELECT c, max(d) AS len FROM g GROUP BY c),
n AS (SELECT d, key, min(c) AS m, count(*) AS n, any_value(x) AS x, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len) AS ends FROM g JOIN l USING (c) GROUP BY d, key),
q AS (SELECT n.*, CASE WHEN d > 0 THEN left(key, 64 * (d::BIGINT - 1)) END AS up FROM n),
f AS (SELECT q.*, (SELECT count(*) FROM q AS s WHERE s.d = q.d + 1 AND s.up = q.key) AS kids FROM q)
SELECT f.m::BIGINT AS conv_id, f.d::BIGINT AS depth, (SELECT p.m FROM q AS p WHERE p.d = f.d - 1 AND p.key = f.up)::BIGINT AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN (SELECT a.d, a.key, count(*) FILTER (z.kids = 0) AS leaves, sum((z.n - 1) * length(z.x)) AS saved FROM q AS a JOIN f AS z ON z.d >= a.d AND left(z.key, 64 * a.d::BIGINT) = a.key GROUP BY a.d, a.key) AS s
  ON s.d = f.d AND s.key = f.key""",
}
QUERIES = {"op13_trie": op13_trie}
