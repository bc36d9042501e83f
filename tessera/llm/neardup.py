"""Near-duplicates by a chosen-path set similarity join.

A text's set is its distinct word shingles. Texts of equal sets are one member. Independent trees branch the members: a member follows, at each node, the
minimum of its set under the hash functions that the node selects, so similar sets follow a path together. Nodes of two to `node_limit` members are
compared exhaustively by sketch; larger ones branch again, and what a path of MAX_DEPTH steps can't part is compared in tiles. The clusters that the
sketches leave are confirmed on full sets, a cluster found in many nodes once. Only links that join two classes of a cluster leave a task, so a group of n copies gives n - 1.

A pair of similarity J goes along a tree with probability q = 1 - (1 - J q)**BRANCHES, so it would be missed by all TREES
trees with (1 - q)**TREES, 2.6e-6 at one level and 1.5e-5 at six for J = 0.8, if no two levels shared a function. As all draw on the same HASHES functions, simulated pairs
at 0.8 were missed in 5 of 800,000 cases at one level, 42 of 600,000 at four and 41 of 400,000 at six.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, mixed, text_steps, words_of
from .graph import components

HASHES = 64
TREES = 4
BRANCHES = 2
NODE_LIMIT = 4096
MAX_DEPTH = 6
_RANDOM = np.random.default_rng(20)
_A = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64)
_BRANCHES = np.arange(1, BRANCHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def branches(node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(path, hash function) of each of a node's BRANCHES branches: no two paths coincide, and a node's branches have different functions."""
    node = mixed(node)
    first, step = mixed(node), mixed(~node) | np.uint64(1)
    return [(mixed(node ^ _BRANCHES[j]), ((first + np.uint64(j) * step) % np.uint64(HASHES)).astype(np.int64)) for j in range(BRANCHES)]


def _roots() -> list[int]:
    """Nodes of the TREES trees, far apart, whose first branches all have different functions."""
    roots, used, at = [], set(), 0
    while len(roots) < TREES:
        at += 1
        root = mixed(np.array([at], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        own = {int(which[0]) for _, which in branches(root)}
        if not own & used:
            roots.append(int(root.astype(np.int64)[0]))
            used |= own
    return roots


ROOTS = _roots()


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; of fewer words the whole sequence is one, of none there is none."""
    if not len(words):
        return words
    k = min(k, len(words))
    h = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        h = mixed(h * np.uint64(0x9FB21C651E98DF25) + words[i : len(words) - k + 1 + i])
    return np.unique(mixed(h + np.uint64(k)))


def minima(own: np.ndarray) -> np.ndarray:
    """Upper halves of the minima under HASHES linear functions of the (already mixed) members."""
    low = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(own), 4096):
        low = np.minimum(low, (own[None, at : at + 4096] * _A[:, None] + _B[:, None]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, key1, key2, mins, sketch): size, 128-bit key, minima and a byte of each minimum of each text's set; the last two are null for an empty one."""

    def run(batches):
        for batch in batches:
            for rows, texts in text_steps(batch, "text"):
                words, at = words_of(texts)
                out = []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    own = shingles(words[a:b], k)
                    low = minima(own) if len(own) else None
                    both = (low.tobytes(), (low & 255).astype(np.uint8).tobytes()) if len(own) else (None, None)
                    out.append((len(own), int(mixed(own).sum().astype(np.int64)), int(mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)), *both))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_shingles", "key1", "key2", "mins", "sketch"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, n_shingles long, key1 long, key2 long, mins binary, sketch binary")


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def branch(members: DataFrame) -> DataFrame:
    """(node, doc_id, mins) -> the children that the members choose: BRANCHES rows each, (node, doc_id)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mins = _matrix(batch.column("mins"), HASHES, np.uint32)
            node = batch.column("node").to_numpy().astype(np.uint64)
            for path, which in branches(node):
                child = mixed(path ^ mixed(mins[np.arange(len(mins)), which].astype(np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(child.astype(np.int64)), batch.column("doc_id")], names=["node", "doc_id"])

    return members.select("node", "doc_id", "mins").mapInArrow(run, "node long, doc_id long")


def _groups(batches, key: str):
    """Tables of whole groups of consecutive rows of equal key, from batches in which equal keys stand together."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if last is not None and keys[-1] == last and keys[0] == last:
            held.append(batch)
            continue
        start = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])
        whole = [*held, batch.slice(0, start)] if start or (held and keys[0] != last) else held
        if start == 0 and held and keys[0] != last:
            whole = held
        if whole:
            yield pa.Table.from_batches(whole)
        held, last = [batch.slice(start)], keys[-1]
    if held:
        yield pa.Table.from_batches(held)


class _Sets:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up, self.left = list(range(n)), n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.left -= 1
        return True


def _edges(keys: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return list(zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True))


def clusters(nodes: DataFrame, least: int) -> DataFrame:
    """(cluster, doc_id): within each node, the members joined by sketches that agree in `least` places or more. Equal clusters have equal numbers."""

    def run(batches):
        for table in _groups(batches, "node"):
            table = table.combine_chunks()
            node, doc = table["node"].to_numpy(), table["doc_id"].to_numpy()
            sketch = _matrix(table["sketch"].combine_chunks(), HASHES, np.uint8)
            number, member = [], []
            for a, b in _edges(node):
                own, ids = sketch[a:b], doc[a:b]
                if len(np.unique(ids)) < len(ids):  # a doc_id repeated with another text meets itself in the joins
                    once = np.unique(np.column_stack([ids.view(np.uint8).reshape(-1, 8), own]), axis=0, return_index=True)[1]
                    own, ids = own[once], ids[once]
                n = len(ids)
                if n < 2:
                    continue
                sets = _Sets(n)
                for i in range(n - 1):
                    for j in np.flatnonzero((own[i + 1 :] == own[i]).sum(1) >= least).tolist():
                        sets.join(i, i + 1 + j)
                if sets.left == n:
                    continue
                root = np.array([sets.find(i) for i in range(n)])
                size, total = np.bincount(root, minlength=n), np.zeros(n, np.uint64)
                np.add.at(total, root, mixed(ids.astype(np.uint64)))
                keep = size[root] > 1
                number.append(mixed(total[root] + size[root].astype(np.uint64))[keep])
                member.append(ids[keep])
            if number:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(number).astype(np.int64)), pa.array(np.concatenate(member))], names=["cluster", "doc_id"])

    return nodes.select("node", "doc_id", "sketch").mapInArrow(run, "cluster long, doc_id long")


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs whose full sets reach 100 |A & B| >= percent |A | B| and that span the classes of such pairs."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (sizes.sum() - both) else []
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    by, start = owner[order], np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1]))
    count = np.diff(np.append(start, len(flat)))
    number = np.empty(len(flat), np.int64)
    number[order] = np.repeat(np.arange(len(start)), count)
    edge, joined, out = np.append(0, np.cumsum(sizes)), _Sets(n), []
    for i in range(n):
        if joined.left == 1:
            break
        own = number[edge[i] : edge[i + 1]]
        own = own[count[own] > 1]
        c = count[own]
        if not len(own):
            continue
        places = np.repeat(start[own] - np.append(0, np.cumsum(c)[:-1]), c) + np.arange(c.sum())
        both = np.bincount(by[places], minlength=n)
        for j in np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both)).tolist():
            if j != i and joined.join(i, j):
                out.append((i, j))
    return out


def confirm(members: DataFrame, k: int, percent: int) -> DataFrame:
    """(cluster, doc_id, text), equal clusters together -> links (a, b) on full sets."""

    def run(batches):
        for table in _groups(batches, "cluster"):
            table = table.combine_chunks()
            key, doc = table["cluster"].to_numpy(), table["doc_id"].to_numpy()
            texts = pa.array(table["text"].to_pylist(), pa.string())
            a_side, b_side = [], []
            for a, b in _edges(key):
                words, at = words_of(texts.slice(a, b - a))
                sets = [shingles(words[x:y], k) for x, y in zip(at[:-1], at[1:], strict=True)]
                for i, j in linked(sets, percent) if b - a > 1 else []:
                    a_side.append(doc[a + i])
                    b_side.append(doc[a + j])
            if a_side:
                yield pa.RecordBatch.from_arrays([pa.array(a_side, pa.int64()), pa.array(b_side, pa.int64())], names=["a", "b"])

    return members.select("cluster", "doc_id", "text").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, members: DataFrame, k: int, percent: int, node_limit: int = NODE_LIMIT, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(a, b) between members (doc_id, mins, sketch) of different sets; `docs` has their texts.

    Joins are by merge at every size, as all sides grow with the documents. Levels carry ids alone. A member that is alone in a node has met all that it can meet there and goes; sketches are joined to the members of the leaves."""
    roots = members.select(F.explode(F.array(*(F.lit(x).cast("long") for x in ROOTS))).alias("node"), "doc_id", "mins")
    level, leaves = cut(branch(roots)), []
    for depth in range(max_depth):
        sizes = cut(level.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"))
        leaves.append(level.join(sizes.filter(F.col("n") <= node_limit).select("node").hint("merge"), "node"))
        large = sizes.filter(F.col("n") > node_limit)
        if large.isEmpty():
            break
        rest = level.join(large.hint("merge"), "node")
        if depth == max_depth - 1:
            tiles = F.ceil(2 * F.col("n") / node_limit).cast("int")
            own = rest.withColumn("tiles", tiles).withColumn("x", F.pmod(F.xxhash64("doc_id"), F.col("tiles")))
            own = own.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1)))
            leaves.append(own.select(F.xxhash64("node", F.least("x", "y"), F.greatest("x", "y")).alias("node"), "doc_id"))
        else:
            level = cut(branch(rest.join(members.select("doc_id", "mins").hint("merge"), "doc_id")))
    j = percent / 100
    least = max(1, int(HASHES * j - 5 * (HASHES * j * (1 - j)) ** 0.5))  # five standard errors below the threshold
    nodes = leaves[0]
    for more in leaves[1:]:
        nodes = nodes.unionByName(more)
    nodes = nodes.join(members.select("doc_id", "sketch").hint("merge"), "doc_id")
    found = clusters(nodes.repartition(F.col("node")).sortWithinPartitions("node"), least).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = cut(found).join(texts.hint("merge"), "doc_id").repartition(F.col("cluster")).sortWithinPartitions("cluster")
    return confirm(own, k, percent)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, node_limit: int = NODE_LIMIT, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text): the class of texts linked by
    100 * |A & B| >= percent * |A | B| over k-word shingles, named by its smallest doc_id, which alone is kept.

    A text without words has an empty set and is its own class. Repeated rows are in one class; where a doc_id is repeated with another text, either text's
    links join its classes. Ties go to the smallest doc_id. Rows without a doc_id are linked with nothing and kept. An empty table gives no rows; other
    columns are neither read nor returned.
    """
    all_ = cut(sketches(docs, k))
    some = all_.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = some.groupBy("key1", "key2", "n_shingles").agg(F.min(F.struct("doc_id", "mins", "sketch")).alias("m"))
    first = cut(first.select("key1", "key2", "n_shingles", "m.doc_id", "m.mins", "m.sketch"))
    # one row a member even if its doc_id is repeated with another text
    pairs = links(docs, first.select("doc_id", "mins", "sketch"), k, percent, node_limit, max_depth)
    roots = components(pairs)
    named = first.select("key1", "key2", "n_shingles", F.col("doc_id").alias("node")).join(roots, "node", "left")
    named = named.select("key1", "key2", F.col("n_shingles").alias("_n"), F.coalesce("root", "node").alias("component_id"))
    out = all_.select("doc_id", "n_shingles", "key1", "key2").join(named.withColumnRenamed("key1", "k1").withColumnRenamed("key2", "k2"), (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")) & (F.col("n_shingles") == F.col("_n")), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_neardup(spark, sf_dir):
    """Classes of near-duplicate documents over 2-word shingles at a similarity of 0.8.

    Null and empty texts stand alone; repeated rows are in one class.
    """
    return near_duplicates(documents(spark, sf_dir), k=2)


QUERIES = {"op4_neardup": op4_neardup}
