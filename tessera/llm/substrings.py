"""Removal of repeated passages: every byte under a `length`-byte string that also starts earlier goes.

Only suffixes that can matter are sorted. Each window of `length` bytes has an anchor, the leftmost gram of least hash within it, so equal windows have equal
anchors at equal places. Anchors meet by hash; those that occur once drop out. Occurrences of an anchor with the same surroundings are repeats outright, all
but the first; first occurrences of different surroundings are compared as suffixes: those to the right of the anchor and, reversed, those to the left
are put in order by deep-shallow sorting, a multikey quicksort by words to a shallow depth and blind tries for what is left with a longer common prefix. Common prefixes
of neighbours then tell, for each place of the anchor in a window, which windows are equal. Occurrences with the same surroundings, most copies, are told by
two 64-bit hashes and don't reach the sort. An anchor with more than `group_limit` surroundings is compared
window by window over the cluster instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, cut, documents, in_order, mixed, prefix_sums, span_hashes, text_steps
from .neardup import _edges, _groups

LENGTH = 100
GRAM = 32
GROUP_LIMIT = 50_000
HELD = 400_000
#: Places in a step's bytes stand below the upper 24 bits of a gram's hash; a text has at most 2 GB.
_PLACE = np.uint64((1 << 40) - 1)


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, hash of its surroundings, pos, lo, hi) of each anchor of the texts data[at[i]:at[i + 1]]; it is the anchor of the windows that start at lo..hi.
    Places are relative to the text."""
    n, span = len(data), length - gram + 1
    sizes = np.diff(at)
    none = np.zeros(0, np.int64)
    if n < length or sizes.max(initial=0) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    sums = prefix_sums(data)
    starts = np.arange(n - gram + 1)
    h = span_hashes(sums, starts, starts + gram)
    low = (h & ~_PLACE) | starts.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    valid = np.zeros(n + 1, np.int64)
    long = sizes >= length
    np.add.at(valid, at[:-1][long], 1)
    np.add.at(valid, at[1:][long] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    place = (low[s] & _PLACE).astype(np.int64)
    row = np.repeat(np.flatnonzero(long), sizes[long] - length + 1)
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    lo, hi, place, row = s[new], s[np.append(new[1:], len(s)) - 1], place[new], row[new]
    around = mixed(span_hashes(sums, lo, hi + length) + (place - lo).astype(np.uint64))
    return row, h[place], around, place - at[row], lo - at[row], hi - at[row]


def repeated_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, around, doc_id, pos, lo, hi) of the anchors that occur twice or more; lo and hi count back from pos.

    A task sends one row for each of its anchors to the anchor's place, the others of its own, known to be repeated, elsewhere; so an anchor in many texts has at most a row a task there.
    """

    def find(batches):
        held: list = []

        def flush():
            if not held:
                return
            a, c, doc, pos, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(a, kind="stable")
            a, c, doc, pos, lo, hi = (x[order] for x in (a, c, doc, pos, lo, hi))
            first = np.append(True, a[1:] != a[:-1])
            same = np.append(a[1:] == a[:-1], False)
            salt = np.where(first, 0, 1 + (mixed(doc.astype(np.uint64)) % np.uint64(1000)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(salt.astype(np.int32)), pa.array(same), pa.array(c.astype(np.int64)), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array((pos - lo).astype(np.int16)), pa.array((pos - hi).astype(np.int16))], names=["anchor", "salt", "sure", "around", "doc_id", "pos", "lo", "hi"])

        for batch in batches:
            for rows, texts in text_steps(batch, "text", 1 << 20):
                at, data = buffers(texts)
                row, a, c, pos, lo, hi = anchors(data, at, length, gram)
                doc = batch.column("doc_id")[rows].to_numpy(zero_copy_only=False)
                if len(row):
                    held.append((a, c, doc[row], pos, lo, hi))
            if sum(len(x[0]) for x in held) > HELD:
                yield from flush()
        yield from flush()

    def keep(batches):
        for table in _groups(batches, "anchor"):
            table = table.combine_chunks()
            a, first = table["anchor"].to_numpy(), table["salt"].to_numpy() == 0
            alone = np.append(True, a[1:] != a[:-1]) & np.append(a[1:] != a[:-1], True)
            fine = ~first | ~alone | table["sure"].to_numpy()
            yield from table.filter(pa.array(fine)).select(["anchor", "around", "doc_id", "pos", "lo", "hi"]).to_batches()

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL")
    found = own.mapInArrow(find, "anchor long, salt int, sure boolean, around long, doc_id long, pos int, lo short, hi short")
    return found.repartition("anchor", "salt").sortWithinPartitions("anchor").mapInArrow(keep, "anchor long, around long, doc_id long, pos int, lo short, hi short")


class BlindTrie:
    """Order of distinct strings of one length: inner nodes know only a depth and branch on one byte."""

    def __init__(self):
        self.root = None

    def insert(self, x: bytes, depth: int) -> None:
        if self.root is None:
            self.root = x
            return
        node = self.root
        while not isinstance(node, bytes):
            node = node[1].get(x[node[0]]) or next(iter(node[1].values()))
        if node == x:
            return
        while x[depth] == node[depth]:
            depth += 1
        other, parent, node = node, None, self.root
        while not isinstance(node, bytes) and node[0] < depth:
            parent, node = node, node[1][x[node[0]]]
        if not isinstance(node, bytes) and node[0] == depth:
            node[1][x[depth]] = x
            return
        new = (depth, {other[depth]: node, x[depth]: x})
        if parent is None:
            self.root = new
        else:
            parent[1][x[parent[0]]] = new

    def ordered(self) -> list[bytes]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, bytes):
                out.append(node)
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def multikey(order: np.ndarray, starts: np.ndarray, keys: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of runs of equal keys) after multikey quicksort of each run order[starts[i]:starts[i + 1]] by the words keys[:, first:last].

    All runs are partitioned at once, each into the rows whose word is below, equal to and above that of its middle row; the equal part goes on with the next word."""
    n = len(order)
    size = np.diff(np.append(starts, n))
    depth = np.full(len(starts), first)
    done = [starts[size < 2]]
    starts, depth, size = starts[size > 1], depth[size > 1], size[size > 1]
    while len(starts):
        if first >= last:
            done.append(starts)
            break
        rows = np.repeat(starts - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        run = np.repeat(np.arange(len(starts)), size)
        own = order[rows]
        word, pivot = keys[own, depth[run]], keys[order[starts + size // 2], depth]
        below, above = word < pivot[run], word > pivot[run]
        edge = np.append(0, np.cumsum(size)[:-1])
        n_below, n_above = np.add.reduceat(below, edge, dtype=np.int64), np.add.reduceat(above, edge, dtype=np.int64)
        part = np.where(below, 0, np.where(above, 2, 1))
        to = np.empty(len(rows), np.int64)
        for k, offset in ((0, np.zeros_like(size)), (1, n_below), (2, size - n_above)):
            which = part == k
            nth = np.cumsum(which)
            nth -= np.append(0, nth)[edge][run]
            to[which] = (starts[run] + offset[run] + nth - 1)[which]
        order[to] = own
        n_equal = size - n_below - n_above
        starts = np.concatenate([starts, starts + n_below, starts + size - n_above])
        depth, size = np.concatenate([depth, depth + 1, depth]), np.concatenate([n_below, n_equal, n_above])
        over = (size == 1) | ((depth == last) & (size > 0))
        done.append(starts[over])
        on = (size > 1) & (depth < last)
        starts, depth, size = starts[on], depth[on], size[on]
    return order, np.sort(np.concatenate(done))


def deep_shallow(group: np.ndarray, strings: np.ndarray, skip: int = 0, words: int = 2) -> np.ndarray:
    """Order of the rows of `strings` within their groups. Rows of a group agree in the first `skip` words of 8 bytes; `words` more are sorted by multikey quicksort, the rest by blind tries."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    keys = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")  # groups come together already
    starts = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1])) if n else np.zeros(0, np.int64)
    order, edges = multikey(order, starts, keys, skip, min(skip + words, keys.shape[1]))
    depth = min(8 * (skip + words), width)
    for a, b in zip(edges, np.append(edges[1:], n), strict=True):
        if b - a > 1 and depth < width:
            places: dict[bytes, list[int]] = {}
            for i in order[a:b].tolist():
                places.setdefault(strings[i].tobytes(), []).append(i)
            if len(places) > 1:
                trie = BlindTrie()
                for x in places:
                    trie.insert(x, depth)
                order[a:b] = [i for x in trie.ordered() for i in places[x]]
    return order


def prefix_lengths(group: np.ndarray, strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row in order with the one before it; -1 at a group's start."""
    own, width = strings[order], strings.shape[1]
    equal = own[1:] == own[:-1]
    out = np.full(len(order), -1)
    out[1:] = np.where(equal.all(1), width, equal.argmin(1))
    out[1:][group[order][1:] != group[order][:-1]] = -1
    return out


def repeats(group, doc, pos, lo, hi, left, right, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the spans of windows that stand earlier in another row of the group; rows hold lo and hi as distances before pos,
    left reversed, and whole groups."""
    n = len(group)
    r_order, l_order = deep_shallow(group, right, gram // 8), deep_shallow(group, left)
    r_common, l_common = prefix_lengths(group, right, r_order), prefix_lengths(group, left, l_order)
    turn = np.empty(n, np.int64)
    turn[np.lexsort((pos, doc))] = np.arange(n)
    flags = np.zeros((n, length - gram + 3), np.int8)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(length - gram + 1):
        some = np.flatnonzero((hi <= before) & (lo >= before))
        if len(some) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < length - before)
        l_class[l_order] = np.cumsum(l_common < before) if before else np.cumsum(l_common < 0)
        key = (l_class[some] * (n + 1) + r_class[some]) * n + turn[some]
        by = np.argsort(key)
        kind = key[by] // n
        again = by[1:][kind[1:] == kind[:-1]]
        flags[some[again], before + 1] = 1
    step = np.diff(flags, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    # a run of places first..last-1 before pos is the span from the farthest window's start to the nearest one's end
    return row, pos[row] - (last - 1), pos[row] - first + length


def _surroundings(edges: DataFrame, docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Adds the bytes left of the anchor, reversed, and those from it on, both padded to the full width."""
    side = length - gram

    names = ["anchor", "doc_id", "pos", "lo", "hi", "m", "left", "right"]

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                own = batch.column("own")[i].values
                raw = np.frombuffer(batch.column("text")[i].as_py().encode(), np.uint8)
                a, pos, lo, hi, m = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("anchor", "pos", "lo", "hi", "m"))
                wide = np.concatenate([np.zeros(side, np.uint8), raw, np.zeros(length, np.uint8)])
                right = wide[pos[:, None] + side + np.arange(length)]
                left = wide[pos[:, None] + side - 1 - np.arange(side)]
                right[np.arange(length) >= (length - hi)[:, None]] = 0
                left[np.arange(side) >= lo[:, None]] = 0
                out.append((a, np.full(len(a), batch.column("doc_id")[i].as_py()), pos, lo, hi, m, left, right))
            if out:
                a, doc, pos, lo, hi, m, left, right = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16)), pa.array(m), pa.array([x.tobytes() for x in left], pa.binary()), pa.array([x.tobytes() for x in right], pa.binary())], names=names)

    lists = edges.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "pos", "lo", "hi", "m")).alias("own"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    return texts.join(lists, "doc_id").mapInArrow(run, "anchor long, doc_id long, pos int, lo short, hi short, m long, left binary, right binary")


def _sorted_spans(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for table in _groups(batches, "anchor"):
            table = table.combine_chunks()
            cols = [table[k].to_numpy().astype(np.int64) for k in ("anchor", "doc_id", "pos", "lo", "hi")]
            left = np.frombuffer(b"".join(table["left"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
            right = np.frombuffer(b"".join(table["right"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
            row, start, end = repeats(*cols, left, right, length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(cols[1][row]), pa.array(start), pa.array(end)], names=["doc_id", "start", "end"])

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, start long, end long")


def _windowed_spans(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for anchors with very many surroundings: windows meet by 128-bit hash, summed map-side."""

    def run(batches):
        for batch in batches:
            for a, doc, pos, lo, hi, _, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = left[:lo][::-1] + right[: length - hi]
                own = [text[lo - b : lo - b + length] for b in range(hi, lo + 1)]
                digest = [hashlib.blake2b(x, digest_size=16).digest() for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(own)), pa.array(digest, pa.binary()), pa.array([doc] * len(own)), pa.array([pos - b for b in range(hi, lo + 1)], pa.int64())], names=["anchor", "window", "doc_id", "start"])

    own = contexts.mapInArrow(run, "anchor long, window binary, doc_id long, start long")
    first = own.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    again = own.join(first, "window").filter((F.col("doc_id") != F.col("f.doc_id")) | (F.col("start") != F.col("f.start")))
    return again.select("doc_id", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, start, end) in bytes, possibly overlapping: all that lies under a `length`-byte string that starts earlier."""
    found = cut(repeated_anchors(docs, length, gram))
    first = found.groupBy("anchor", "around").agg(F.min(F.struct("doc_id", "pos", "lo", "hi")).alias("f"), F.count("*").alias("n"))
    first = cut(first.select("anchor", "around", "n", "f.doc_id", "f.pos", "f.lo", "f.hi"))
    more = first.filter("n > 1").select("anchor", "around", F.col("doc_id").alias("d"), F.col("pos").alias("p"))
    whole = found.join(more, ["anchor", "around"]).filter("doc_id <> d OR pos <> p")
    whole = whole.select("doc_id", (F.col("pos") - F.col("lo")).cast("long").alias("start"), (F.col("pos") - F.col("hi") + length).cast("long").alias("end"))
    several = first.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1")
    edges = first.drop("around", "n").join(several, "anchor")
    contexts = cut(_surroundings(edges, docs, length, gram))
    return whole.unionByName(_sorted_spans(contexts.filter(F.col("m") <= group_limit), length, gram)).unionByName(_windowed_spans(contexts.filter(F.col("m") > group_limit), length, gram))


def remove_spans(docs: DataFrame, spans: DataFrame, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) for every row of (doc_id, text)."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw, own = (batch.column("text")[i].as_py() or "").encode(), batch.column("own")[i].values
                kept, runs, at, removed = [], 0, 0, 0
                if own is not None and len(own):
                    a, b = own.field("start").to_numpy(), own.field("end").to_numpy()
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                    for x, y in zip(a[new].tolist(), b[np.append(new[1:], len(b)) - 1].tolist(), strict=True):
                        kept.append(raw[at:x])
                        at, runs, removed = y, runs + 1, removed + y - x
                kept = b"".join([*kept, raw[at:]])
                out.append((batch.column("doc_id")[i].as_py(), len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), *([kept] if with_bytes else [])))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=names)

    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("own"))
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(lists, "doc_id", "left")
    return own.select("doc_id", "text", "own").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)


def without_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """remove_spans of the repeated spans for rows (doc_id, text). Where a doc_id stands with several texts, each text is a document of its own, in the order of
    doc_id and a hash of the text; all documents are then told by their place in that order."""
    mark = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("mark")
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keys = cut(own.filter("doc_id IS NOT NULL").select("doc_id", mark).distinct())
    if keys.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return remove_spans(own, cut(repeated_spans(own)), with_bytes)
    keys = in_order(keys, "doc_id", "mark").select("doc_id", "mark", F.col("_id").alias("place"))
    placed = cut(own.withColumn("mark", mark).join(keys, ["doc_id", "mark"], "left").select(F.col("place").alias("doc_id"), "text"))
    out = remove_spans(placed, cut(repeated_spans(placed)), with_bytes)
    return out.withColumnRenamed("doc_id", "place").join(keys.drop("mark"), "place", "left").select("doc_id", *out.columns[1:])


def op10_substrings(spark, sf_dir):
    """Every document without the bytes of passages that stand earlier.

    Null and empty texts lose nothing; rows with the same doc_id and text are the same document, with another text another one; rows without a doc_id are left alone; of passages that tie
    the one in the smallest doc_id, and there the first, stays. A very long text is handled whole. An empty table gives no rows; other columns are not read.
    """
    return without_repeats(documents(spark, sf_dir))


QUERIES = {"op10_substrings": op10_substrings}
