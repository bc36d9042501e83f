"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, documents, mixed, remainder, text_steps

STRIP = ".,;:!?\"'()[]{}|*_-#…«»“”‘’"


def _split(text: str) -> list[str]:
    """Raw tokens; a line's end is a token of its own."""
    return text.lower().replace("\n", " \n ").split(" ")


class _Codes(dict):
    """raw token -> 2 * (place of its weight) + (1 if it ends a sentence); place 0 has weight 0."""

    def __init__(self, places: dict[int, int], limit: int = 200_000):
        super().__init__()
        self.places, self.limit = places, limit

    def __missing__(self, raw: str) -> int:
        if len(self) > self.limit:
            self.clear()
        code = self.places.get(word_hash(raw), 0) * 2 + (raw[-1:] in "\n.!?" and raw != "")
        if len(raw) <= 64:  # so that the cache has few bytes
            self[raw] = code
        return code


def word_hash(raw: str) -> int:
    word = raw.strip(STRIP)
    return xxhash.xxh3_64_intdigest(word) if word and word != "\n" else 0


def _bags(batches):
    """(toxic, hashes of words as bytes, number of each word's sentence as bytes), a row for each text."""
    for batch in batches:
        for rows, texts in text_steps(batch, "text"):
            words, sentences = [], []
            for text in texts.to_pylist():
                raw = _split(text)
                h = np.fromiter(map(word_hash, raw), np.uint64, len(raw))
                ends = np.fromiter((x != "" and x[-1] in "\n.!?" for x in raw), bool, len(raw))
                sentence = (np.cumsum(ends) - ends).astype(np.uint32)
                pairs = np.unique(np.stack([sentence[h > 0].astype(np.uint64), h[h > 0]], 1), axis=0)
                words.append(pairs[:, 1].tobytes())
                sentences.append(pairs[:, 0].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("toxic")[rows], pa.array(words, pa.binary()), pa.array(sentences, pa.binary())], names=["toxic", "words", "sentences"])


class Model:
    """Weights of words and a bias; P(document) = 1 - prod(1 - sigmoid(sum of a sentence's weights + bias))."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.places = {int(h): i + 1 for i, h in enumerate(hashes)}
        self.weights, self.bias = np.append(0.0, weights), float(bias)


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, n, bad): of each word's hash the documents of (text, toxic) that have it and the toxic ones among them, over all rows."""

    def run(batches):
        held: list = []

        def flush():
            if held:
                words, bad = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                held.clear()
                own, at, n = np.unique(words, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(n), pa.array(np.bincount(at, bad, len(own)).astype(np.int64))], names=["word", "n", "bad"])

        for batch in _bags(batches):
            for toxic, words in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist(), strict=True):
                own = np.unique(np.frombuffer(words, np.uint64))
                held.append((own, np.full(len(own), toxic, np.int8)))
            if sum(len(x[0]) for x in held) > 1_000_000:
                yield from flush()
        yield from flush()

    own = labelled.select(F.col("text"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "word long, n long, bad long")
    return own.groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def contexts(labelled: DataFrame, words: np.ndarray, reach: int = 2) -> DataFrame:
    """(word, n, bad) of the given word hashes, which are sorted: how many different documents of (text, toxic) have the word, and how many of those are toxic. Documents are told
    apart by the contexts of the word, the `reach` words on either side, of which each gives the one of least hash: copies agree in it, and near copies mostly do."""

    def run(batches):
        for batch in batches:
            for rows, texts in text_steps(batch, "text"):
                out = []
                for toxic, text in zip(batch.column("toxic")[rows].to_pylist(), texts.to_pylist(), strict=True):
                    raw = _split(text)
                    h = np.fromiter(map(word_hash, raw), np.uint64, len(raw))
                    at = np.flatnonzero(words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h)
                    wide = np.concatenate([np.zeros(reach, np.uint64), h, np.zeros(reach, np.uint64)])
                    around = np.zeros(len(at), np.uint64)
                    for k in range(2 * reach + 1):
                        around = mixed(around + wide[at + k])
                    pairs = np.unique(np.stack([h[at], around], 1), axis=0)
                    pairs = pairs[np.append(True, pairs[1:, 0] != pairs[:-1, 0])[: len(pairs)]]
                    out.append((pairs, np.full(len(pairs), toxic, np.int32)))
                pairs = np.concatenate([x[0] for x in out]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.concatenate([x[1] for x in out]))], names=["word", "around", "toxic"])

    own = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "word long, around long, toxic int")
    return own.groupBy("word", "around").agg(F.max("toxic").alias("toxic")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))


def telling(counts: DataFrame, docs: int, toxic: int, least: int = 5, chance: float = 1e-6, odds: float = 4.0) -> DataFrame:
    """(word, n, bad) of the words that `least` toxic documents or more have and that stand in toxic ones more often than by chance: were toxicity as frequent among them as in
    all `docs` documents, so many would be toxic with a probability below `chance` (the Chernoff bound of the binomial tail). With toxic documents rare, a word of none but toxic
    documents passes with a handful of them, however many rows there are. Their odds of toxicity are at least `odds` times those of all documents, which common words that long
    documents have don't reach."""
    base = F.lit(toxic / max(1, docs))
    share = F.col("bad") / F.col("n")
    clean = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    more = F.col("bad") * (1 - base) >= odds * (F.col("n") - F.col("bad")) * base
    return counts.filter((F.col("bad") >= least) & (share > base) & more).filter(F.col("n") * (share * F.log(share / base) + clean) >= -np.log(chance))


def train(toxic: np.ndarray, words: list[np.ndarray], sentences: list[np.ndarray], vocab: np.ndarray, prior: np.ndarray, steps: int = 500, rate: float = 0.1, ridge: float = 1e-5) -> Model:
    """Full-batch Adam on the noisy-or likelihood of the words in `vocab`, which is sorted; weights are drawn to `prior`, which they keep where the sample doesn't have the word."""
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), -8.0 if not len(toxic) or not toxic.max() else 0.0)
    n_docs, k = len(toxic), len(vocab)
    doc = np.repeat(np.arange(n_docs), [len(w) for w in words])
    flat = np.concatenate(words)
    at = np.minimum(np.searchsorted(vocab, flat), max(0, k - 1))
    used = vocab[at] == flat if k else np.zeros(len(flat), bool)
    starts = np.cumsum([0, *(int(s[-1]) + 1 if len(s) else 0 for s in sentences)])
    sent = np.concatenate(sentences).astype(np.int64) + starts[doc]
    sent_doc = np.repeat(np.arange(n_docs), np.diff(starts))
    tok, sent, n_sent = at[used], sent[used], int(starts[-1])
    share = np.where(toxic > 0, 0.5 / (toxic > 0).sum(), 0.5 / (toxic == 0).sum())
    w, bias = prior.copy(), -6.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        s = np.bincount(sent, w[tok], n_sent) + bias
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        total = np.bincount(sent_doc, np.logaddexp(0, s), n_docs)
        by_doc = share * np.where(toxic > 0, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
        slope = by_doc[sent_doc] * p
        g = np.append(np.bincount(tok, slope[sent], k) + ridge * (w - prior), slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w = w - step[:-1]
        bias -= step[-1]
    return Model(vocab, w, bias)


def fit(labelled: DataFrame, max_rows: int = 6000) -> Model:
    """Learn from (doc_id, text, toxic). Words are counted over all labelled documents; weights are fitted on at most `max_rows` of them, half of each label, those with the
    smallest hash of doc_id. A word's prior weight is its smoothed log-odds of toxicity against the base rate. Word hashes that pass are gathered, no documents or counts of others."""
    # read four times, so the join behind it is worked out once
    known = cut(labelled.filter("text IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")))
    docs, bad = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    chosen = bounded_sample(known.select("doc_id", "toxic"), "toxic", max_rows // 2).select("doc_id").distinct()
    sample = known.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most max_rows ids.select("text", "toxic")
    vocab, n, n_bad = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    if 0 < bad < docs:
        # of the words that many toxic documents have those that have it in many contexts too
        some = np.sort(telling(word_counts(known), docs, bad).select("word").toPandas()["word"].to_numpy().astype(np.uint64))
        found = telling(contexts(known, some), docs, bad).toPandas() if len(some) else None
        if found is not None:
            order = np.argsort(found["word"].to_numpy().astype(np.uint64))
            vocab, n, n_bad = found["word"].to_numpy().astype(np.uint64)[order], found["n"].to_numpy()[order], found["bad"].to_numpy()[order]
    got = sample.mapInArrow(_bags, "toxic int, words binary, sentences binary").toPandas().sort_values(["toxic", "words"])
    odds = lambda x, n: np.log((x + 0.5) / (n - x + 0.5))
    prior = odds(n_bad, n) - odds(bad, docs)
    return train(got["toxic"].to_numpy(), [np.frombuffer(x, np.uint64) for x in got["words"]], [np.frombuffer(x, np.uint32) for x in got["sentences"]], vocab, prior)


def score(df: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, n_sentences, offending): `offending` lists (start, end, score) of the sentences that reach the threshold alone,
    in characters of the text, or the highest one if only all of them together reach it. A text without sentences has score 0."""
    schema = "doc_id long, score double, n_sentences int, offending array<struct<start: int, end: int, score: double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        codes = _Codes(model.places)
        for batch in batches:
            for rows, texts in text_steps(batch, "text"):
                out = []
                for text in texts.to_pylist():
                    raw = _split(text)
                    code = np.fromiter(map(codes.__getitem__, raw), np.int64, len(raw))
                    ends = code & 1
                    sentence = np.cumsum(ends) - ends
                    place = code >> 1
                    some = place > 0
                    n = int(sentence[-1]) + 1
                    # a word counts once a sentence, as in training
                    pair = np.unique(sentence[some] * len(model.weights) + place[some])
                    s = np.bincount(pair // len(model.weights), model.weights[pair % len(model.weights)], n) + model.bias
                    worded = np.bincount(sentence, np.fromiter(map(len, raw), np.int64, len(raw)) - (code == 1), n) > 0
                    s = np.where(worded, s, -50.0)
                    p = -np.expm1(-np.logaddexp(0, s).sum())
                    spans = []
                    if p >= threshold:
                        alone = 1 / (1 + np.exp(-s))
                        hit = np.flatnonzero(alone >= threshold)
                        hit = hit if len(hit) else np.array([alone.argmax()])
                        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
                        newline = np.fromiter((x == "\n" for x in raw), bool, len(raw))
                        start = np.cumsum(size) - size - 2 * (np.cumsum(newline) - newline) - newline
                        edge = [0, *(np.flatnonzero(ends) + 1).tolist(), len(raw)]
                        spans = [{"start": int(max(0, start[edge[i]])), "end": int(min(len(text), start[edge[i + 1] - 1] + len(raw[edge[i + 1] - 1]))), "score": float(alone[i])} for i in hit]
                    out.append((float(p), n if text else 0, spans))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], kind)], names=["doc_id", "score", "n_sentences", "offending"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def offending_sentences(df: DataFrame, scored: DataFrame) -> DataFrame:
    """One row for each offending sentence: (doc_id, start, end, score, sentence)."""
    spans = scored.select("doc_id", F.explode("offending").alias("at"))
    return spans.join(df.select(F.col("doc_id").cast("long"), "text"), "doc_id").select(
        "doc_id", "at.start", "at.end", "at.score", F.expr("substring(text, at.start + 1, at.end - at.start)").alias("sentence")
    )


def op7_toxicity(spark, sf_dir):
    """The toxicity of every document, learned from the labels outside the held-out fifth.

    Null and empty texts score 0; repeated rows score each; a document labelled twice is toxic if either label says so; sentences that tie for the highest score give the first.
    A very long text is scored whole. Without labels of both kinds, as in an empty table of labels, all documents score alike.
    """
    docs = documents(spark, sf_dir)
    held = remainder(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    scored = score(docs, fit(docs.filter(~held).select("doc_id", "text").join(labels.hint("merge"), "doc_id")))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), F.expr("try_element_at(offending, 1).start").alias("first_start"))


QUERIES = {"op7_toxicity": op7_toxicity}
