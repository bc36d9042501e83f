"""Bigram language model in a log-frequency Bloom filter.

Counts are quantised to levels on a log scale, and a key of level q stands in the filter under the numbers 1..q, so a count is read by probing 1, 2, ... until
a probe fails. Three kinds of keys are held: words, word pairs, and the number of different words that follow a word. A pair is probed only when both its
words are known. The pair's probability is interpolated with the word's by absolute discounting.

Counting: each task makes its own keys distinct first and ships sorted runs by shard of the key; a shard's runs are merged in one group, whose
size is kept even by adding shards as the corpus grows. Scoring: every worker reads filter and word counts, piece by piece from the shared folder, when their measured size is at most
`broadcast_bytes`; otherwise, and where that folder is on a file system that workers can't open, each block of documents sends its distinct keys to the shards and gets the counts back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import parquet
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.common import shared_dir

from .common import buffers, cut, documents, mixed, remainder, segment_sums, text_steps, words_of

WORD, PAIR, FOLLOW = 0, 1, 2
#: Look-ups of a word's exact count, told apart from those of its level.
EXACT = -1
#: Log bases of the levels by kind.
BASES = (1.2, 2.0, 1.2)
BITS = 12
PROBES = 4
END = np.uint64(0xE7037ED1A0B428DB)
START = np.uint64(0x8EBC6AF09C88C6E3)
BROADCAST_BYTES = 256 << 20
PIECE_BYTES = 8 << 20
#: Bytes of text that are scored at once by the whole filter, whose pieces are read anew for each.
SCORED = 2 << 20
DOCS_A_SHARD = 4000
HELD = 1_000_000


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The upper half tells the left word, the lower half the pair."""
    both = mixed(left * np.uint64(0x9FB21C651E98DF25) ^ mixed(right))
    return (left & np.uint64(0xFFFFFFFF00000000)) | (both >> np.uint64(32))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, hash of the token before it, offsets by text); an end token closes each text."""
    words, at = words_of(texts)
    n = len(texts)
    at = at + np.arange(n + 1)
    out = np.empty(len(words) + n, np.uint64)
    ends = at[1:] - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = words, END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[at[:-1]] = START
    return out, before, at


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)


def means(base: float, most: int = 400) -> np.ndarray:
    """Mean of the whole numbers of each level; 0 for level 0."""
    out = np.zeros(most + 1)
    for q in range(1, most + 1):
        lo, hi = np.ceil(base ** (q - 1) - 1e-6), np.ceil(base**q - 1e-6) - 1
        out[q] = (lo + max(lo, hi)) / 2
    return out


def _bits(keys: np.ndarray, level: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash that picks the word, mask of PROBES bits in it) for key under number `level`."""
    h = mixed(keys + np.uint64(0x632BE59BD9B4E019 * (3 * level + kind + 1) % (1 << 64)))
    g = mixed(h ^ np.uint64(0xA0761D6478BD642F))
    mask = np.zeros_like(h)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((g >> np.uint64(6 * i)) & np.uint64(63))
    return h >> np.uint64(16), mask


def build(keys: np.ndarray, counts: np.ndarray, kind: int) -> np.ndarray:
    """The filter words of one shard: BITS bits for each (key, number)."""
    level = levels(counts, BASES[kind])
    words = np.zeros(max(1, -(-int(level.sum()) * BITS // 64)), np.uint64)
    q, own = 1, keys
    while len(own):
        at, mask = _bits(own, q, kind)
        np.bitwise_or.at(words, at % np.uint64(len(words)), mask)
        own, level = own[level > q], level[level > q]
        q += 1
    return words


def probe(keys: np.ndarray, start: np.ndarray, size: np.ndarray, words: np.ndarray, kind: int) -> np.ndarray:
    """Levels of the keys; key i lies in words[start[i]:start[i] + size[i]]."""
    out = np.zeros(len(keys), np.int64)
    live, q = np.arange(len(keys)), 1
    while len(live):
        at, mask = _bits(keys[live], q, kind)
        got = words[start[live] + (at % size[live]).astype(np.int64)] if len(words) else np.zeros(len(live), np.uint64)
        live = live[(got & mask) == mask]
        out[live] = q
        q += 1
    return out


def shard_of(keys: np.ndarray, shards: int, kind: int) -> np.ndarray:
    """Words are dealt by ranges of their hashes, so that sorted shards in a row are sorted; the others by another hash, as pairs of one left word share their upper half."""
    spread = keys if kind == WORD else mixed(keys ^ np.uint64(0x2545F4914F6CDD1D))
    return (((spread >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _runs(kind: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """One row for each shard that has keys."""
    own = shard_of(keys, shards, kind)
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(shards + 1))
    rows = [(s, keys[order[a:b]].tobytes(), counts[order[a:b]].astype(np.uint32).tobytes()) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "shard", "keys", "counts"])


def merged(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    return summed(np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(counts), np.uint32))


def summed(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    c = c.astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


@dataclass
class Model:
    """Statistics of the training tokens and the table of shards: (kind, shard, keys, counts, filter)."""

    table: DataFrame
    shards: int
    tokens: int
    vocabulary: int
    discount: float
    size: int


def train(docs: DataFrame, shards: int | None = None) -> Model:
    """Learn from (text); a null text counts as empty."""
    shards = shards or max(8, docs.count() // DOCS_A_SHARD)

    def count(batches):
        held = {WORD: ([], []), PAIR: ([], [])}

        def flush():
            for kind, (keys, counts) in held.items():
                if keys:
                    both = np.concatenate(keys), np.concatenate(counts)
                    keys.clear()
                    counts.clear()
                    yield _runs(kind, *summed(*both), shards)

        for batch in batches:
            for _, texts in text_steps(batch, "text"):
                words, before, _ = tokens_of(texts)
                for kind, own in ((WORD, words), (PAIR, pair_keys(before, words))):
                    k, c = np.unique(own, return_counts=True)
                    held[kind][0].append(k)
                    held[kind][1].append(c.astype(np.uint32))
                if sum(map(len, held[PAIR][0])) > HELD:
                    yield from flush()
        yield from flush()

    # words keep exact counts; pairs go into the filter at once, and how many pairs each word opens is shipped on
    out = "kind int, shard int, keys binary, counts binary, filter binary, n long, n1 long, n2 long"

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        kind, shard = int(group["kind"].iloc[0]), int(group["shard"].iloc[0])
        k, c = merged(list(group["keys"]), list(group["counts"]))
        stats = (int(c.sum()), int((c == 1).sum()), int((c == 2).sum()))
        if kind == PAIR:
            left, follow = np.unique(k & np.uint64(0xFFFFFFFF00000000), return_counts=True)
            return pd.DataFrame([(kind, shard, left.tobytes(), follow.astype(np.uint32).tobytes(), build(k, c, kind).tobytes(), *stats)], columns=[x.split()[0] for x in out.split(", ")])
        return pd.DataFrame([(kind, shard, k.tobytes() if kind == WORD else b"", c.astype(np.uint32).tobytes() if kind == WORD else b"", build(k, c, kind).tobytes(), *stats)], columns=[x.split()[0] for x in out.split(", ")])

    def redeal(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _runs(FOLLOW, np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32), shards)

    runs = docs.select(F.col("text").cast("string")).mapInArrow(count, "kind int, shard int, keys binary, counts binary")
    first = cut(runs.groupBy("kind", "shard").applyInPandas(reduce, out))
    follow = first.filter(F.col("kind") == PAIR).select("keys", "counts").mapInArrow(redeal, "kind int, shard int, keys binary, counts binary")
    follow = cut(follow.groupBy("kind", "shard").applyInPandas(reduce, out))
    empty = F.lit(b"").cast("binary")
    table = first.withColumns({c: F.when(F.col("kind") == WORD, F.col(c)).otherwise(empty) for c in ("keys", "counts")}).unionByName(follow)
    stats = {r["kind"]: r for r in table.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum(F.length("keys") / 8).alias("v")).collect()}
    size = table.agg(F.coalesce(F.sum(F.length("keys") + F.length("counts") + F.length("filter")), F.lit(0))).first()[0]
    n1, n2 = (stats[PAIR]["n1"], stats[PAIR]["n2"]) if PAIR in stats else (0, 0)
    word = stats.get(WORD)
    return Model(table.drop("n", "n1", "n2"), shards, int(word["n"]) if word else 0, int(word["v"]) if word else 0, n1 / (n1 + 2 * n2) if n1 else 0.5, int(size))


@dataclass
class Piece:
    """Shards first..last of a kind in a row: where each one's filter starts and how many words it has, and the files that hold them, in order."""

    kind: int
    first: int
    starts: np.ndarray
    sizes: np.ndarray
    files: list[str]

    def load(self, *columns: str) -> list[np.ndarray]:
        """The columns' bytes of all shards as one array each, keys and filters in 64 bits, counts in 32. Nothing is kept, so a worker has one piece at a time."""
        parts = []
        for uri in self.files:
            system, path = FileSystem.from_uri(uri)
            with system.open_input_file(path) as f:
                parts.append(parquet.ParquetFile(f).read(list(columns), use_threads=False))
        held = pa.concat_tables(parts) if parts else None
        out = []
        for c in columns:
            raw = buffers(held[c].combine_chunks())[1] if held else np.zeros(0, np.uint8)
            out.append(raw.view(np.uint32 if c == "counts" else np.uint64))
        # a shard without keys has the word of zeros at the end
        return [np.append(x, np.uint64(0)) if c == "filter" else x for c, x in zip(columns, out, strict=True)]


def opens(uri: str) -> bool:
    """Whether a worker can read files there."""
    try:
        FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def pieces(table: DataFrame, shards: int, size: int) -> list[Piece]:
    """The table in pieces of about `size` bytes, each a folder of the shared folder, which workers read as they need it: the driver learns sizes and names alone."""
    sizes = {(r[0], r[1]): (r[2], r[3]) for r in table.select("kind", "shard", F.length("filter") + F.length("keys") + F.length("counts"), F.length("filter")).collect()}
    runs = []
    for kind in (WORD, PAIR, FOLLOW):
        first = 0
        while first < shards:
            last, total = first, sizes.get((kind, first), (0,))[0]
            while last + 1 < shards and total + sizes.get((kind, last + 1), (0,))[0] <= size:
                last += 1
                total += sizes.get((kind, last), (0,))[0]
            runs.append((kind, first, last))
            first = last + 1
    firsts = {k: F.array(*(F.lit(first) for kind, first, _ in runs if kind == k)) for k in (WORD, PAIR, FOLLOW)}
    own = F.when(F.col("kind") == WORD, firsts[WORD]).when(F.col("kind") == PAIR, firsts[PAIR]).otherwise(firsts[FOLLOW])
    dealt = table.withColumn("first", F.array_max(F.filter(own, lambda x: x <= F.col("shard"))))
    dealt = cut(dealt.repartition("kind", "first").sortWithinPartitions("kind", "first", "shard"), "kind", "first")
    names: dict = {}
    for kind, first, name in sorted(tuple(r) for r in dealt.select("kind", "first", "_metadata.file_path").distinct().collect()):
        names.setdefault((kind, first), []).append(name)
    out = []
    for kind, first, last in runs:
        words = np.array([sizes.get((kind, s), (0, 0))[1] // 8 for s in range(first, last + 1)])
        starts = np.where(words > 0, np.cumsum(words) - words, words.sum())
        out.append(Piece(kind, first, starts, np.maximum(words, 1), names.get((kind, first), [])))
    return out


class Tables:
    """Look-ups by key in pieces."""

    def __init__(self, own: list[Piece], shards: int):
        self.shards, self.own = shards, own

    def _each(self, keys: np.ndarray, kind: int):
        """(piece, places of its keys, their shards within it)."""
        s = shard_of(keys, self.shards, kind)
        for piece in self.own:
            if piece.kind == kind:
                rows = np.flatnonzero((s >= piece.first) & (s < piece.first + len(piece.sizes)))
                if len(rows):
                    yield piece, rows, s[rows] - piece.first

    def level(self, keys: np.ndarray, kind: int) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for piece, rows, s in self._each(keys, kind):
            out[rows] = probe(keys[rows], piece.starts[s], piece.sizes[s].astype(np.uint64), *piece.load("filter"), kind)
        return out

    def count(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for piece, rows, _ in self._each(keys, WORD):
            out[rows] = find(*piece.load("keys", "counts"), keys[rows])
        return out


def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values of the wanted keys, 0 where there is none; keys are sorted."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.int64)


def _scores(texts: pa.Array, tables, stats: tuple[int, int, float]) -> tuple[np.ndarray, ...]:
    """(n_tokens, n_known, base_score, score) of each text. `tables` has level(keys, kind) and count(keys)."""
    total, vocabulary, discount = stats
    words, before, at = tokens_of(texts)
    own, inverse = np.unique(words, return_inverse=True)
    exact = tables.count(own)
    floor = 0.1 * (vocabulary + 1)
    base = np.log10((exact + 0.1) / (total + floor))[inverse]
    mean = [means(b) for b in BASES]
    # the start stands before the first token of each text, as often as the end after the last
    quantised = mean[WORD][tables.level(np.append(own, END), WORD)]
    follow = mean[FOLLOW][tables.level(np.append(own, START) & np.uint64(0xFFFFFFFF00000000), FOLLOW)]
    (quantised, ends), (follow, start_follow) = ((x[:-1], x[-1]) for x in (quantised, follow))
    c_left, d_left = np.empty(len(words)), np.empty(len(words))
    c_left[1:], d_left[1:] = quantised[inverse][:-1], follow[inverse][:-1]
    c_left[at[:-1]], d_left[at[:-1]] = ends, start_follow
    c_right = quantised[inverse]
    unigram = (c_right + 0.1) / (total + floor)
    joint = np.zeros(len(words))
    known = (c_left > 0) & (c_right > 0)  # a pair can't be more frequent than its words
    joint[known] = mean[PAIR][tables.level(pair_keys(before[known], words[known]), PAIR)]
    joint = np.minimum(joint, np.minimum(c_left, c_right))
    safe = np.maximum(c_left, 1)
    rest = np.clip(discount * np.clip(d_left, 1, safe) / safe, 1e-9, 1)
    p = np.where(c_left > 0, np.maximum(joint - discount, 0) / safe + rest * unigram, unigram)
    return np.diff(at), segment_sums((exact > 0)[inverse].astype(np.int64), at), segment_sums(base, at), segment_sums(np.log10(p), at)


OUT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _result(keys, found) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([keys, *(pa.array(x, t) for x, t in zip(found, kinds, strict=True))], names=[x.split()[0] for x in OUT.split(", ")])


def score(docs: DataFrame, model: Model, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of (doc_id, text)."""
    stats = (model.tokens, model.vocabulary, model.discount)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model.size > broadcast_bytes or not opens(shared_dir(docs.sparkSession)):
        return _score_by_shards(docs, model, stats)
    shards = model.shards
    sent = pieces(model.table, shards, PIECE_BYTES)

    def run(batches):
        tables = Tables(sent, shards)
        for batch in batches:
            for part, texts in text_steps(batch, "text", SCORED):
                yield _result(batch.column("doc_id")[part], _scores(texts, tables, stats))

    return docs.mapInArrow(run, OUT)


class _Asked:
    """Notes which keys a block needs, or answers from what came back."""

    def __init__(self, got: dict | None = None):
        self.got, self.need = got, {}

    def level(self, keys, kind):
        if self.got is None:
            self.need.setdefault(kind, []).append(np.unique(keys))
            return np.zeros(len(keys), np.int64)
        return find(*self.got[kind], keys) if kind in self.got else np.zeros(len(keys), np.int64)

    def count(self, keys):
        return self.level(keys, EXACT)


def _texts(group: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(group["doc_id"], pa.int64(), from_pandas=True), pa.array(group["text"], pa.string(), from_pandas=True)], names=["doc_id", "text"])


def _needs(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
    """The distinct keys, sorted, that scoring the texts looks up, by kind."""
    noted = _Asked()
    for _, texts in text_steps(batch, "text"):
        words, before, _ = tokens_of(texts)
        own = np.unique(words)
        noted.count(own)
        noted.level(np.append(own, END), WORD)
        noted.level(np.append(own, START) & np.uint64(0xFFFFFFFF00000000), FOLLOW)
        noted.level(pair_keys(before, words), PAIR)
    return {kind: np.unique(np.concatenate(keys)) for kind, keys in noted.need.items()}


def _score_by_shards(docs: DataFrame, model: Model, stats, docs_a_block: int = 4000) -> DataFrame:
    """The same by two shuffles: a block's distinct keys go to their shards, and levels and counts come back to the block.

    Replies are values alone, in the order of the keys, which the block works out again: a byte for a level.
    """
    shards = model.shards
    blocks = max(1, docs.count() // docs_a_block)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for kind, keys in _needs(_texts(group)).items():
            s = shard_of(keys, shards, max(kind, WORD))
            order = np.argsort(s, kind="stable")
            own, first = np.unique(s[order], return_index=True)
            for x, part in zip(own.tolist(), np.split(keys[order], first[1:]), strict=True):
                rows.append((max(kind, WORD), x, int(group["block"].iloc[0]), kind == EXACT, part.tobytes()))
        return pd.DataFrame(rows, columns=["kind", "shard", "block", "exact", "keys"])

    def answer(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for kind, shard, block, exact, keys in zip(asked["kind"], asked["shard"], asked["block"], asked["exact"], asked["keys"], strict=True):
            k = np.frombuffer(keys, np.uint64)
            if not len(table):
                values = np.zeros(len(k), np.int64)
            elif exact:
                values = find(np.frombuffer(table["keys"].iloc[0], np.uint64), np.frombuffer(table["counts"].iloc[0], np.uint32).astype(np.int64), k)
            else:
                words = np.frombuffer(table["filter"].iloc[0], np.uint64)
                values = probe(k, np.zeros(len(k), np.int64), np.full(len(k), len(words), np.uint64), words, int(kind))
            rows.append((int(block), EXACT if exact else int(kind), int(shard), values.astype(np.uint32 if exact else np.uint8).tobytes()))
        return pd.DataFrame(rows, columns=["block", "kind", "shard", "values"])

    def finish(group: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame(columns=[x.split()[0] for x in OUT.split(", ")])
        batch, got = _texts(group), {}
        needs = _needs(batch)
        for kind, own in replies.sort_values("shard").groupby("kind"):
            keys, raw = needs[int(kind)], np.frombuffer(b"".join(own["values"]), np.uint32 if kind == EXACT else np.uint8)
            values = np.empty(len(keys), np.int64)
            values[np.argsort(shard_of(keys, shards, max(int(kind), WORD)), kind="stable")] = raw
            got[int(kind)] = (keys, values)
        asked = _Asked(got)
        done = [_result(batch.column("doc_id")[part], _scores(texts, asked, stats)) for part, texts in text_steps(batch, "text")]
        return pa.Table.from_batches(done).to_pandas()

    asks = dealt.groupBy("block").applyInPandas(ask, "kind int, shard int, block int, exact boolean, keys binary")
    replies = asks.groupBy("kind", "shard").cogroup(model.table.groupBy("kind", "shard")).applyInPandas(answer, "block int, kind int, shard int, values binary")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(finish, OUT)


def op1_lm(spark, sf_dir):
    """Every document scored by a model of the documents outside the held-out tenth.

    Null and empty texts have the end token alone; repeated rows score each; a very long text is scored whole, in a step of its own. An empty table gives no rows;
    where nothing is learned every token has the floor's probability. Columns other than doc_id and text are not read. Words and pairs are told apart by 64-bit hash, the
    words that follow counts by its upper half.
    """
    docs = documents(spark, sf_dir)
    held = remainder(F.col("doc_id"), 10) == 0
    model = train(docs.filter(~held))
    found = score(docs, model)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op1_lm": op1_lm}
