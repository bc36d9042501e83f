"""Hierarchical language identification: family first, then one-versus-one linear SVMs within the family.

Features are relative frequencies of byte 2- and 3-grams of the whole lower-cased text, hashed into `DIM` buckets, so a
linear function of them is a mean over positions: each task gathers weights by position and needs no feature matrix.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, buffers, documents, remainder, segment_sums, text_steps

DIM = 4096
UNKNOWN = "und"

# fixed values: families of languages by ISO 639-1 code; a code not listed is a family of its own
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk"],
    "indic": ["hi", "bn", "mr", "ur"],
}

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
#: Bytes 0 to 127 other than a-z become a space.
_PLAIN = np.where(_LETTERS | (np.arange(256) > 127), np.arange(256), 32).astype(np.uint8)


def family_of(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang in v), lang)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, buckets of the 2-grams, of the 3-grams) over all positions; texts stand apart by spaces."""
    apart = pc.binary_join_element_wise(" ", pc.utf8_lower(texts), "  ", "")
    at, data = buffers(apart)
    b = np.append(_PLAIN[data], np.array([32, 32], np.uint8)).astype(np.uint32)
    two = (b[:-2] << np.uint32(8)) | b[1:-1]
    three = (two << np.uint32(8)) | b[2:]
    fold = lambda x: ((x * np.uint32(2654435761)) >> np.uint32(32 - 12)).astype(np.int32)
    return at, fold(two ^ np.uint32(0x5BD1E995)), fold(three)


def features(texts: pa.Array) -> np.ndarray:
    """Rows of relative frequencies, for training."""
    at, two, three = _grams(texts)
    out = np.zeros((len(texts), DIM), np.float32)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        out[i] = (np.bincount(two[a:b], minlength=DIM) + np.bincount(three[a:b], minlength=DIM)) / (2 * (b - a))
    return out


def linear(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """features(texts) @ weights.T, by gathering."""
    at, two, three = _grams(texts)
    n = np.diff(at)
    return np.stack([segment_sums((w[two] + w[three]).astype(np.float64), at) / (2 * n) for w in weights], 1) if len(weights) else np.zeros((len(texts), 0))


def has_letter(texts: pa.Array) -> np.ndarray:
    at, data = buffers(texts)
    found = segment_sums(_LETTERS[data].astype(np.int64), at) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    return found


@dataclass
class Rows:
    """Sparse feature rows: row i has `values` in the buckets `places` at starts[i]:starts[i + 1]."""

    starts: np.ndarray
    places: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.starts[i], self.starts[i + 1])
        return self.places[own], self.values[own]

    def sums(self) -> np.ndarray:
        return np.bincount(self.places, self.values, DIM)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """A row for each of these rows, a column for each of the weights."""
        return np.stack([segment_sums(w[self.places].astype(np.float64) * self.values, self.starts) for w in weights], 1) if len(weights) else np.zeros((len(self), 0))


def svm(x: Rows, rows: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 25) -> np.ndarray:
    """Weights of a linear SVM (squared hinge) over x[rows], the last one the bias, by dual coordinate descent; classes are balanced."""
    upper = np.where(y > 0, c / max(1, (y > 0).sum()), c / max(1, (y < 0).sum())) * len(y) / 2
    diag = 1 / (2 * upper)
    norm = segment_sums(x.values.astype(np.float64) ** 2, x.starts)[rows] + 1 + diag
    a, w, bias, order = np.zeros(len(y)), np.zeros(DIM, np.float32), 0.0, np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            at, own = x.row(rows[i])
            g = y[i] * (own @ w[at] + bias) - 1 + a[i] * diag[i]
            new = max(a[i] - g / norm[i], 0)
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[at] += np.float32(step) * own
                bias += step
                a[i] = new
    return np.append(w.astype(np.float64), bias)


class Model:
    """Linear functions over the features: one a family (when there are two or more), one for each pair within a family."""

    def __init__(self, x: Rows, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(k) for k in self.langs})
        own = np.array(langs)
        fam = np.array([family_of(k) for k in langs])
        scale = 1 / np.sqrt(x.sums() / len(x) + 1e-4) if len(x) else np.ones(DIM)
        x.values *= scale.astype(np.float32)[x.places]
        norm = np.float32(np.sqrt((x.values.astype(np.float64) ** 2).sum() / len(x))) if len(x) else np.float32(1)
        x.values /= norm
        scale = scale / norm
        self.pairs = [p for f in self.families for p in combinations([k for k in self.langs if family_of(k) == f], 2)]
        fits = [svm(x, np.arange(len(x)), np.where(fam == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else []
        for p, q in self.pairs:
            rows = np.flatnonzero((own == p) | (own == q))
            fits.append(svm(x, rows, np.where(own[rows] == p, 1.0, -1.0)))
        self.weights = np.array([w[:-1] * scale for w in fits], np.float32).reshape(len(fits), DIM)
        self.bias = np.array([w[-1] for w in fits])
        # x is scaled, and so are the weights: the margins of the training rows
        raw = np.array([w[:-1] for w in fits], np.float32).reshape(len(fits), DIM)
        scores = self._decide(x.dot(raw) + self.bias)[1] if len(x) else np.ones(1)
        #: Half the lowest score of a labelled text: a text below it is like none of the languages learned.
        self.bar = float(scores.min()) / 2

    def predict(self, texts: pa.Array) -> tuple[list[str], list[str], np.ndarray]:
        """(languages, families, scores)."""
        known = has_letter(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), [UNKNOWN] * len(texts), np.zeros(len(texts))
        lang, score = self._decide(linear(texts, self.weights) + self.bias)
        lang[~known], score[~known] = UNKNOWN, 0
        return lang.tolist(), [UNKNOWN if x == UNKNOWN else family_of(x) for x in lang], score

    def fine(self, texts: pa.Array) -> np.ndarray:
        """True for texts with a letter whose score reaches the bar; if no language was learned, for all texts with a letter."""
        if not self.langs:
            return has_letter(texts)
        lang, _, score = self.predict(texts)
        return (np.array(lang, object) != UNKNOWN) & (score >= self.bar)

    def _decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) by the margins of the families and pairs."""
        n = len(margins)
        odds = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        nf = len(self.families) if len(self.families) > 1 else 0
        share = np.exp(np.clip(3 * margins[:, :nf], -30, 30)) if nf else np.ones((n, 1))
        share = share / share.sum(1, keepdims=True)
        best = share.argmax(1)
        lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
        for k, f in enumerate(self.families):
            rows, own = best == k, [x for x in self.langs if family_of(x) == f]
            votes = np.ones((int(rows.sum()), len(own))) if len(own) == 1 else np.zeros((int(rows.sum()), len(own)))
            for j, (p, q) in enumerate(self.pairs):
                if p in own:
                    v = odds(margins[rows, nf + j])
                    votes[:, own.index(p)] += v / (len(own) - 1)
                    votes[:, own.index(q)] += (1 - v) / (len(own) - 1)
            lang[rows] = np.array(own, object)[votes.argmax(1)]
            score[rows] = share[rows, k] * votes.max(1)
        return lang, np.clip(score, 0, 1)


def fit(labelled: DataFrame, max_rows: int = 1600, lines: int = 3) -> Model:
    """Learn from (doc_id, text, lang). At most `max_rows` documents are read, an equal number for each language, those with the
    smallest hash of doc_id; each gives its whole text and up to `lines` of its lines as rows, so that short texts are learned too."""
    keys = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN)).select("doc_id", "lang")
    n = keys.agg(F.approx_count_distinct("lang")).first()[0]
    chosen = bounded_sample(keys, "lang", max(20, max_rows // max(1, n))).select("doc_id").distinct()

    def rows(batches):
        for batch in batches:
            for part, texts in text_steps(batch, "text"):
                langs = batch.column("lang")[part].to_pylist()
                more, whose = [], []
                for lang, text in zip(langs, texts.to_pylist(), strict=True):
                    own = [x for x in text.split("\n") if len(x) >= 20]
                    own = [text, *own[:: max(1, len(own) // lines)][:lines]]
                    more += own
                    whose += [lang] * len(own)
                keep = has_letter(pa.array(more, pa.string()))
                more, whose = [x for x, k in zip(more, keep, strict=True) if k], [x for x, k in zip(whose, keep, strict=True) if k]
                x = features(pa.array(more, pa.string()))
                filled = [(at := np.flatnonzero(r).astype(np.uint16), r[at]) for r in x.astype(np.float16)]
                yield pa.RecordBatch.from_arrays([pa.array(whose, pa.string()), *(pa.array([r[i].tobytes() for r in filled], pa.binary()) for i in (0, 1))], names=["lang", "places", "x"])

    sample = labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL").join(chosen, "doc_id", "left_semi")
    found = sample.select("text", "lang").mapInArrow(rows, "lang string, places binary, x binary").toArrow()
    found = found.sort_by([(c, "ascending") for c in ("lang", "places", "x")])
    return Model(_rows(found), found["lang"].to_pylist())


def _rows(found: pa.Table) -> Rows:
    """The filled buckets of each row and their half floats."""
    (ends, places), (_, values) = (buffers(pa.concat_arrays([pa.array([], pa.binary()), *found[c].chunks])) for c in ("places", "x"))
    return Rows(ends // 2, places.view(np.uint16), values.view(np.float16).astype(np.float32))


def identify(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, family, score) for every row; `und` and 0 for a null text or one without a letter."""

    def tag(batches):
        for batch in batches:
            for rows, texts in text_steps(batch, "text"):
                lang, fam, score = model.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], pa.array(lang, pa.string()), pa.array(fam, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "family", "score"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tag, "doc_id long, lang_pred string, family string, score double")


def known_language(df: DataFrame, model: Model) -> DataFrame:
    """The rows of df, all columns, whose text is in a language that the model knows: it has a letter and scores no lower than half of what any labelled text did.
    Without labelled rows every text with a letter stays. Null and empty texts go; a text of many steps is judged whole."""

    def keep(batches):
        for batch in batches:
            for rows, texts in text_steps(batch, "text"):
                yield batch.slice(rows.start, rows.stop - rows.start).filter(pa.array(model.fine(texts)))

    return df.mapInArrow(keep, df.schema)


def op2_langid(spark, sf_dir):
    """The language of every document, learned from those outside the held-out third.

    Null texts and texts without a letter are `und`; repeated rows are tagged each; without labelled rows all are `und`. A very long text is tagged whole;
    languages that tie go to the first by name.
    """
    docs = documents(spark, sf_dir)
    held = remainder(F.col("doc_id"), 3) == 1
    found = identify(docs, fit(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "family")


QUERIES = {"op2_langid": op2_langid}
