"""Bulk-synchronous best-fit packing of token sequences.

Pieces are range-sorted by length over the cluster, which gives each its rank among those of its length. Documents and gaps then meet as tables of runs of
one size, so they have some thousand rows whatever the number of documents. In a round documents and gaps are sorted by size, each run of documents sweeps up to its successor
gap, the smallest that holds it, conflicts are settled by rank, the gaps are updated, and the next round follows until all is placed. Joining the ranks to the placed runs gives
each piece its sequence and offset.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import defaultdict
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, documents, text_steps, worker_cache

CAPACITY = 2048
END = 0
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Parts of a text that a worker keeps the ids of, and the characters of one at most: some 60 MB.
CACHED = 250_000
CACHED_CHARS = 40
BROADCAST_ROWS = 500_000


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    A single space between two characters that aren't white space always begins a token of the byte-level pattern, so a text of such spaces is
    encoded by its parts, which repeat and are cached. Other texts, and those that hold one of the vocabulary's added tokens, go to the tokenizer whole. Parts are encoded by the same vocabulary read as merge ranks,
    which is several times faster on one word.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, self.special = file["model"]["vocab"], [x["content"] for x in file["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items() if k not in self.special}
        self.part = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        outer = self

        class Parts(dict):
            def __missing__(self, part):
                if not part or part[0].isspace() or part[-1].isspace():
                    raise ValueError
                ids = np.array(outer.part(" " + part), "<u4").tobytes()
                if len(self) < CACHED and len(part) <= CACHED_CHARS:
                    self[part] = ids
                return ids

        self.parts = Parts()

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[0].isspace() or first[-1].isspace()) or any(x in text for x in self.special):
                raise ValueError
            return np.array(self.part(first), "<u4").tobytes() + b"".join(map(self.parts.__getitem__, rest))
        except ValueError:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(df: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False, place: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids][, _order]): each text's tokens and the end token, cut into pieces of `capacity` if longer; the first may be shorter.
    `place` names a column of whole numbers that goes along as _order."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        encode = worker_cache(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        for batch in batches:
            for rows, texts in text_steps(batch, "text"):
                out, whose = [], []
                for at, (key, text) in enumerate(zip(batch.column("doc_id")[rows].to_pylist(), texts.to_pylist(), strict=True)):
                    ids = encode(text) + END.to_bytes(4, "little")
                    n = len(ids) // 4
                    edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        own = ids[4 * a : 4 * b]
                        out.append((key, k, a, b - a, zlib.crc32(own), *([own] if with_ids else [])))
                        whose.append(at)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)]
                if place:
                    cols.append(batch.column("_order")[rows].take(pa.array(whose, pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=names + ["_order"] * bool(place))

    own = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.col(place).cast("long").alias("_order")] if place else []))
    return own.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", _order long" * bool(place))


def rounds(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Runs (length, rank, n, bin, offset): where the documents of each length go, of `sizes` (length, n). Document rank + i of a run lies in bin + i at the offset.

    Documents are runs of one length and gaps runs of one size, so the tables have some thousand rows at any number of documents. A round either opens bins, for the
    longest documents that no gap holds, or matches the longest documents with gaps; both tables are updated and written, until no document is left.
    """
    spark = sizes.sparkSession
    docs = cut(sizes.select(F.col("length").cast("long"), F.lit(0).cast("long").alias("rank"), F.col("n").cast("long")).coalesce(1))
    gaps, bins = spark.createDataFrame([], "gap long, bin long, n long"), 0
    placed = [spark.createDataFrame([], "length long, rank long, n long, bin long, offset long")]
    while True:
        most = docs.select(F.lit(0).alias("k"), "length").unionByName(gaps.select(F.lit(1).alias("k"), F.col("gap").alias("length"))).coalesce(1)
        top, room = most.agg(F.max(F.when(F.col("k") == 0, F.col("length"))), F.coalesce(F.max(F.when(F.col("k") == 1, F.col("length"))), F.lit(0))).first()
        if top is None:
            return reduce(DataFrame.unionByName, placed)
        # the longest are placed first, down to half the longest: shorter documents are kept for the gaps that these leave
        some = F.col("length") > max(top // 2, room if top > room else 0)
        own, docs = docs.filter(some), docs.filter(~some)
        if top > room:
            runs, left, more, opened = _opened(own, bins, capacity // top, capacity)
            bins += opened
            docs, gaps = docs.unionByName(left), gaps.unionByName(more)
        else:
            runs, left, gaps = _matched(own, gaps, capacity)
            docs = docs.unionByName(left)
        placed.append(runs)
        docs, gaps = (cut(x.coalesce(1)) for x in (docs, gaps))


def _opened(docs: DataFrame, bins: int, each: int, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(runs, documents left, gaps, number of bins): the longest documents in a new bin each, as many bins as hold all of `docs` with `each` in one."""
    docs = docs.coalesce(1)
    needs = -(-docs.agg(F.sum("n")).first()[0] // each)
    before = F.sum("n").over(Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1))
    own = docs.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("k", F.expr(f"greatest(0L, least(n, {needs}L - before))"))
    runs = own.filter("k > 0").selectExpr("length", "rank", "k AS n", f"before + {bins}L AS bin", "0L AS offset")
    left = own.filter("n > k").selectExpr("length", "rank + k AS rank", "n - k AS n")
    return runs, left, runs.selectExpr(f"{capacity} - length AS gap", "bin", "n").filter("gap > 0"), needs


def _matched(docs: DataFrame, gaps: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, documents left, gaps left) of one round. Documents and gaps come to the sweep sorted by size; gaps change only after it."""
    both = docs.selectExpr("0 AS kind", "length AS size", "rank AS first", "n").unionByName(gaps.selectExpr("1 AS kind", "gap AS size", "bin AS first", "n"))
    both = both.coalesce(1).sortWithinPartitions(F.col("kind").desc(), "size", "first")
    found = cut(both.mapInArrow(_sweep(capacity), "kind int, size long, first long, n long, bin long, offset long"))
    of = lambda k: found.filter(F.col("kind") == k)
    runs = of(2).selectExpr("size AS length", "first AS rank", "n", "bin", "offset")
    return runs, of(0).selectExpr("size AS length", "first AS rank", "n"), of(1).selectExpr("size AS gap", "first AS bin", "n")


def _sweep(capacity: int):
    """A task that matches runs of documents with runs of gaps, both some thousand rows at most. The longest documents come first; a run takes its successors, from the smallest
    gaps that hold it up, and puts as many documents into each as it holds; gaps that a longer run has taken are passed over."""

    def run(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        gaps = [[size, first, n] for kind, size, first, n in rows if kind == 1]  # ascending
        sizes, onward, out = [g[0] for g in gaps], list(range(len(gaps) + 1)), []

        def free(i: int) -> int:
            while onward[i] != i:
                onward[i] = onward[onward[i]]
                i = onward[i]
            return i

        for kind, length, rank, n in reversed(rows):
            if kind == 1:
                break
            at = free(bisect_left(sizes, length))
            while n and at < len(gaps):
                gap, first, m = gaps[at]
                each = min(gap // length, n)
                full, rest = min(m, n // each), 0
                for j in range(each if full else 0):
                    out.append((2, length, rank + j * full, full, first, capacity - gap + j * length))
                if full:
                    out.append((1, gap - each * length, first, full, None, None))
                rank, n = rank + each * full, n - each * full
                if full < m and n:  # the rest, fewer than `each`, share one more gap
                    rest = n
                    out += [(2, length, rank + j, 1, first + full, capacity - gap + j * length) for j in range(rest)]
                    out.append((1, gap - rest * length, first + full, 1, None, None))
                    rank, n, full = rank + rest, 0, full + 1
                gaps[at] = [gap, first + full, m - full]
                if full == m:
                    onward[at] = at + 1
                    at = free(at)
            if n:
                out.append((0, length, rank, n, None, None))
        out += [(1, *g, None, None) for g in gaps if g[2]]
        out = [x for x in out if x[0] != 1 or x[1]]
        if out:
            kinds = [pa.int32()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "size", "first", "n", "bin", "offset"])

    return run


def ranked(cut_pieces: DataFrame) -> DataFrame:
    """Adds `rank`, from 0 among the pieces of equal length, by a range sort; only a count for each partition and length is gathered."""
    spark = cut_pieces.sparkSession
    order = [F.col("length").desc(), *(["_order"] if "_order" in cut_pieces.columns else []), "doc_id", "piece"]
    own = cut_pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    own = cut(own)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # a partition's rows are in order of length, so a length's first place there tells its rank
    counts = own.groupBy(part.alias("_p"), "length").agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    rows = counts.collect()  # at most partitions + lengths rows, as the partitions are ranges of length
    seen, offsets = defaultdict(int), []
    for r in sorted(rows, key=lambda r: r["_p"]):
        offsets.append((r["_p"], r["length"], seen[r["length"]] - r["_first"]))
        seen[r["length"]] += r["_n"]
    small = spark.createDataFrame(offsets, "_p long, length long, _add long")
    out = own.withColumn("_p", part.cast("long")).withColumn("_place", place)
    return out.join(F.broadcast(small), ["_p", "length"]).withColumn("rank", F.col("_place") + F.col("_add")).drop("_p", "_place", "_add", "_at")


def in_order(placed: DataFrame) -> DataFrame:
    """Numbers the sequences of (sequence_id, _order, ...) anew by the first _order among their pieces; by a range sort, of which a count for each partition is gathered."""
    first = placed.groupBy("sequence_id").agg(F.min("_order").alias("_first"))
    own = first.repartitionByRange("_first", "sequence_id").sortWithinPartitions("_first", "sequence_id")
    own = cut(own.select("sequence_id", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    counts = sorted(own.groupBy(part.alias("p")).count().collect())
    before = [(p, sum(n for q, n in counts if q < p)) for p, _ in counts]
    small = placed.sparkSession.createDataFrame(before, "_p long, _before long")
    new = own.withColumn("_p", part).join(F.broadcast(small), "_p").select("sequence_id", (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("_new"))
    return placed.join(new, "sequence_id").withColumn("sequence_id", F.col("_new")).drop("_new")


def pack(df: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, place: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of (doc_id, text); a null text counts as empty and has the end token alone.

    `place` names a column with the documents' order: pieces of one length are taken in it, and sequences are numbered by the first of their pieces in it."""
    own = cut(pieces(df, capacity, tokenizer, place=place))
    runs = cut(rounds(own.groupBy("length").agg(F.count("*").alias("n")), capacity).select(F.col("length").alias("_length"), F.col("rank").alias("_rank"), F.col("n").alias("_n"), F.col("bin").alias("_bin"), "offset"))
    small = (F.broadcast if runs.count() <= BROADCAST_ROWS else lambda x: x)(runs)
    at = ranked(own)
    out = at.join(small, (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_rank")) & (F.col("rank") < F.col("_rank") + F.col("_n")))
    out = out.withColumn("sequence_id", F.col("_bin") + F.col("rank") - F.col("_rank"))
    if place:
        out = in_order(out)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_packing(spark, sf_dir):
    """All documents in sequences of at most 2048 tokens. Null and empty texts have the end token alone; repeated rows and rows without a doc_id are packed each; ties of length go
    by doc_id and piece; a very long text is cut into pieces of 2048 tokens; an empty table gives no rows. Columns other than doc_id and text are not read."""
    return pack(documents(spark, sf_dir))


QUERIES = {"op5_packing": op5_packing}
