import bisect
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, graph, langid, linededup, lm, media, mixing, neardup, packing, quality, substrings, toxicity

LOWER = {k: k + 32 for k in range(65, 91)}
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu", "nu", "xi", "omi", "pi", "rho", "sig", "tau", "ups"]


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, ties, nulls, empty and long texts, repeated rows."""
    r = random.Random(3)
    rows = [(i, prose(r, r.randint(5, 80)), r.choice(["en", "de"]), f"s{r.randint(0, 3)}") for i in range(60)]
    base = prose(r, 120).split()
    for i in range(60, 90):
        own = list(base)
        for _ in range(r.randint(0, 5)):
            own[r.randrange(len(own))] = "x" + str(r.randint(0, 9999))
        rows.append((i, " ".join(own), "en", "s0"))
    rows += [(90, None, "en", "s0"), (91, "", None, None), (92, rows[5][1], "de", None), (93, prose(r, 4000), "en", "s1"), (94, "one", "en", "s1"), (95, "ONE", "en", "s1"), (96, "  \n\t ", "de", "s2"), (97, "A\nA\nA\n\nb c d a b c d", "de", "s2")]
    rows.append((94, "one", "en", "s1"))
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    df = spark.createDataFrame([(*x, len(x[1] or "")) for x in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    # columns that clash with names used inside
    return df.withColumns({"score": F.lit(1), "kept": F.lit("k"), "rank": F.lit(2), "host": F.lit("h"), "position_": F.lit(3)}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_word_hashes_match_words():
    texts = ["", "a b  c\td", " Foo BAR", "foo", "x\ny foo", "é É foo ", "\x0b", "a\0", "a"]
    h, at = common.words_of(pa.array(texts))
    seen: dict = {}
    for i, t in enumerate(texts):
        own = split(t)
        assert at[i + 1] - at[i] == len(own)
        for w, x in zip(own, h[at[i] : at[i + 1]], strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(80)]
    up = {x: x for p in pairs for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if any(x in p and p[0] != p[1] for p in pairs)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1


def test_lm(spark, docs, corpus, empty):
    held = common.remainder(F.col("doc_id"), 10) == 0
    model = lm.train(docs.filter(~held), shards=3)
    count = Counter(w for d, t, *_ in corpus if zlib.crc32(str(d).encode()) % 10 for w in [*split(t), "\0end"])
    n, v = sum(count.values()), len(count)
    assert (model.tokens, model.vocabulary) == (n, v)
    got = lm.score(docs, model).toPandas().sort_values(["doc_id", "score"])
    texts = {d: t for d, t, *_ in corpus}
    for r in got.itertuples():
        own = [*split(texts[r.doc_id]), "\0end"]
        assert (r.n_tokens, r.n_known) == (len(own), sum(count[w] > 0 for w in own)) and r.score < 0
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
    other = lm.score(docs, model, broadcast_bytes=0).toPandas().sort_values(["doc_id", "score"])
    assert np.allclose(got.drop(columns="doc_id"), other.drop(columns="doc_id"))
    assert lm.score(empty, model).count() == 0
    nothing = lm.score(docs, lm.train(empty)).toPandas()
    assert len(nothing) == len(corpus) and np.isfinite(nothing["score"]).all()


def test_lm_leaves_the_model_in_the_shared_folder(spark, docs, monkeypatch):
    """No piece of filter or counts passes the driver; with pieces of one shard, and where workers can't open the folder, the scores are the same."""
    held = common.remainder(F.col("doc_id"), 10) == 0
    model = lm.train(docs.filter(~held), shards=40)
    want = lm.score(docs, model, broadcast_bytes=0).toPandas().sort_values(["doc_id", "score"])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("a broadcast"))
    own = lm.pieces(model.table, 40, 1)
    assert [(p.kind, p.first, len(p.sizes)) for p in own] == [(k, s, 1) for k in (lm.WORD, lm.PAIR, lm.FOLLOW) for s in range(40)]
    assert np.concatenate([p.load("keys")[0] for p in own if p.kind == lm.WORD]).size == model.vocabulary
    assert sum(p.load("counts")[0].sum() for p in own if p.kind == lm.WORD) == model.tokens
    monkeypatch.setattr(lm, "PIECE_BYTES", 300)
    for opens in (lm.opens, lambda _: False):
        monkeypatch.setattr(lm, "opens", opens)
        assert np.allclose(lm.score(docs, model).toPandas().sort_values(["doc_id", "score"]).drop(columns="doc_id"), want.drop(columns="doc_id"))
    monkeypatch.undo()
    assert lm.opens("file:///tmp") and not lm.opens("viewfs://store/in")


def test_log_frequency_filter():
    r = np.random.default_rng(2)
    keys, counts = np.unique(r.integers(0, 1 << 62, 5000).astype(np.uint64)), None
    counts = r.integers(1, 1000, len(keys))
    for kind, base in enumerate(lm.BASES):
        words = lm.build(keys, counts, kind)
        ask = lambda k: lm.probe(k, np.zeros(len(k), np.int64), np.full(len(k), len(words), np.uint64), words, kind)  # noqa: B023, E731
        true = lm.levels(counts, base)
        assert (ask(keys) >= true).all() and (ask(keys) == true).mean() > 0.95
        absent = r.integers(0, 1 << 62, 5000).astype(np.uint64)
        assert (ask(absent) > 0).mean() < 0.05
    assert lm.means(2.0)[:5].tolist() == [0, 1, 2.5, 5.5, 11.5]


def test_filter_seldom_sees_absent_keys():
    r = np.random.default_rng(6)
    keys, absent = (np.unique(r.integers(0, 1 << 62, 100_000).astype(np.uint64)) for _ in range(2))
    words = lm.build(keys, np.ones(len(keys), np.int64), lm.PAIR)
    assert (lm.probe(absent, np.zeros(len(absent), np.int64), np.full(len(absent), len(words), np.uint64), words, lm.PAIR) > 0).mean() < 0.015
    assert np.array_equal(lm.levels(np.array([5, 6]), lm.BASES[lm.WORD]), lm.levels(np.array([5, 6]), 1.2))


# --- 2


def test_langid(spark):
    r = random.Random(9)
    kinds = {"en": ["the", "and", "thing", "with", "ther"], "de": ["der", "und", "schen", "keit", "zung"], "fr": ["le", "eau", "tion", "que", "aux"], "es": ["los", "cion", "mente", "que", "ado"]}
    rows = [(i, " ".join(r.choice(kinds[k]) for _ in range(r.randint(3, 60))), k) for i in range(240) for k in [list(kinds)[i % 4]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id % 3 <> 1"))
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    got = {x.doc_id: x for x in langid.identify(df, model).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows if i % 3 == 1) / 80 > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ... 3"), (4, "the and thing"), (5, "é")], "doc_id long, text string")
    tags = {x.doc_id: (x.lang_pred, x.score) for x in langid.identify(odd, model).collect()}
    assert tags[1] == tags[2] == tags[3] == ("und", 0.0) and tags[4][0] == "en" and tags[5][0] != "und" and all(0 <= s <= 1 for _, s in tags.values())
    none = langid.fit(df.limit(0))
    assert {x.lang_pred for x in langid.identify(df, none).collect()} == {"und"}
    # the stage rejects what scores below half of any labelled text; where nothing was learned, a letter is enough
    more = odd.withColumn("more", F.lit("x"))
    assert {x.doc_id for x in langid.known_language(more, model).collect()} == {i for i, (_, s) in tags.items() if i > 3 and s >= model.bar}
    assert {x.doc_id for x in langid.known_language(more, none).collect()} == {4, 5}
    assert langid.known_language(df, model).count() == df.count() and 0 < model.bar < 0.5
    clash = df.withColumns({"lang_pred": F.lit("x"), "family": F.lit("y"), "score": F.lit(-1.0)})
    assert langid.known_language(clash, model).columns == clash.columns and langid.identify(clash, model).filter("score < 0").count() == 0
    x = langid.features(pa.array(["der und keit", "the and"]))
    w = np.random.default_rng(0).normal(size=(2, langid.DIM)).astype(np.float32)
    assert np.allclose(x @ w.T, langid.linear(pa.array(["der und keit", "the and"]), w), atol=1e-5)


def test_langid_gathers_filled_buckets_alone(spark, monkeypatch):
    """What the driver gets to learn from are the buckets that a text fills, not all of each row, and it learns what rows of all buckets would teach."""
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["der", "und", "keit"] if i % 2 else ["the", "and", "house"]) for _ in range(9)), "de" if i % 2 else "en") for i in range(60)]
    met, own = [], langid._rows
    monkeypatch.setattr(langid, "_rows", lambda found: met.append(found) or own(found))
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert met[0].num_rows >= 60 and met[0].nbytes < met[0].num_rows * 2 * langid.DIM / 20
    rows = own(met[0])
    x = np.zeros((len(rows), langid.DIM))
    for i in range(len(rows)):
        x[i, rows.row(i)[0]] = rows.row(i)[1]
    want = langid.features(pa.array([t for _, t, _ in docs]))
    assert max(np.abs(x - v).max(1).min() for v in want) < 0.03  # a text's last 3-gram has the first letter of the text after it
    w = np.random.default_rng(0).normal(size=(3, langid.DIM))
    assert np.allclose(rows.sums(), x.sum(0)) and np.allclose(rows.dot(w), x @ w.T)
    y = np.where(np.arange(len(x)) % 3 > 0, 1.0, -1.0)
    fit = langid.svm(rows, np.arange(len(x)), y)
    assert np.isfinite(fit).all() and not fit[:-1][x.sum(0) == 0].any()
    assert langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string")).langs == [] and len(model.families) == 1


# --- 3


def quality_by_hand(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, tmp_path, docs, corpus):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = quality.op3_quality(spark, str(tmp_path)).collect()
    texts = {d: t for d, t, *_ in corpus}
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_by_hand(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    good = "A plain line of words that ends well.\n" * 3
    bad = "Home | About | News | Contact\nclick here now\n### $$$ *** words\nWOW!! NOW!! YES!!\n"
    df = spark.createDataFrame([(1, good + bad), (2, bad), (3, None), (4, "")], "doc_id long, text string")
    out = {r.doc_id: (r.clean_text, r.lost_lines, r.kept) for r in quality.clean_lines(df).collect()}
    assert out[1] == (good, 4, True) and out[2] == ("", 4, False) and out[3] == (None, 0, True) and out[4] == ("", 0, True)


# --- 4


def sets_of(rows, k):
    out = {}
    for d, t in rows:
        w = split(t)
        out[d] = frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def classes(rows, k, percent=80):
    sets = sets_of(rows, k)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize(("limit", "depth"), [(4096, 6), (4, 2)])
def test_neardup(docs, corpus, empty, k, limit, depth):
    got = neardup.near_duplicates(docs, k, node_limit=limit, max_depth=depth).collect()
    want = classes([(d, t) for d, t, *_ in corpus], k)
    assert len(got) == len(corpus) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    if limit == 4096:
        assert neardup.near_duplicates(empty, k).count() == 0


def test_neardup_without_ids(spark, corpus):
    rows = [(d, t) for d, t, *_ in corpus[60:70]] + [(None, corpus[60][1]), (None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    want = classes([x for x in rows if x[0] is not None], 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2


def test_neardup_trees_are_independent():
    r = np.random.default_rng(4)
    roots = np.array(neardup.ROOTS).astype(np.uint64)
    paths = [p for root in roots for p in neardup.branches(root[None])]
    assert len({int(p[0]) for p, _ in paths}) == len({int(w[0]) for _, w in paths}) == neardup.TREES * neardup.BRANCHES
    # pairs of 180 shingles that share 160, J = 0.8: the sets' minima lead them into a common node of the first level but for 0.2 ** 8
    n, missed = 20_000, 0
    for _ in range(n):
        own = r.integers(0, 1 << 63, 200, np.uint64)
        a, b = neardup.minima(own[:180]), neardup.minima(np.append(own[:160], own[180:]))
        missed += not any(a[w[0]] == b[w[0]] for _, w in paths)
    assert missed <= 2


def test_neardup_finds_planted_pairs(spark):
    r, rows = random.Random(8), []
    for i in range(3000):  # 89 of 111 two-word shingles are shared, J = 0.802
        own = [f"w{r.randrange(10**6)}" for _ in range(101)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:-11], *(f"y{i}_{j}" for j in range(11))]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, node_limit=64, max_depth=3)
    assert got.filter("kept").count() == 3000


def test_linked_spans_classes():
    r = random.Random(7)
    base = list(range(100))
    sets = [np.unique(np.array([x if r.random() > 0.04 else r.randint(1000, 9999) for x in base], np.uint64)) for _ in range(40)]
    got = neardup.linked(sets, 80)
    assert len(got) < len(sets)
    for a, b in got:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)


# --- 5


def test_encoder_of_texts_with_added_tokens():
    from tokenizers import Tokenizer

    encode, plain = packing.Encoder(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER)
    for text in ["abc <|endoftext|> def", "<|endoftext|>", "a<|endoftext|>b c", "x <|endoftext|", "a  b <|endoftext|><|endoftext|>"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_encoder_equals_tokenizer():
    e = packing.Encoder(packing.TOKENIZER)
    texts = ["a  b", " a", "a ", "a\n b", "it's  don't I'll", "<|endoftext|> x", "1 2 33\t4", "\n\n", " ", "", "é ß 漢字 emoji 😀 x", "x y z", "a  b", "The quick, brown fox. 12,5% of it's"]
    for t in texts:
        assert np.frombuffer(e(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids, t


def test_packing(docs, corpus, empty):
    got = packing.pack(docs).toPandas()
    e = packing.Encoder(packing.TOKENIZER)
    ids = {d: e(t or "") + b"\0\0\0\0" for d, t, *_ in corpus}
    assert len(got) == sum(-(-len(ids[d]) // 4 // 2048) for d, *_ in corpus)
    for r in got.itertuples():
        own = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert len(own) == 4 * r.length and zlib.crc32(own) == r.ids_crc32 and (r.piece == 0 or r.length == 2048)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048
    assert packing.pack(empty).count() == 0
    total = got["length"].sum()
    assert got["sequence_id"].nunique() <= -(-total // 2048) + 1
    assert b"".join(x.ids for x in packing.pieces(docs.filter("doc_id = 93"), with_ids=True).orderBy("piece").collect()) == ids[93]


def best_fit_decreasing(sizes, capacity=2048):
    """Number of bins of best fit by hand, the longest first."""
    gaps: list[int] = []
    bins = 0
    for x in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bins += at >= len(gaps) and gap == capacity
        if gap > x:
            bisect.insort(gaps, gap - x)
    return bins


@pytest.mark.parametrize("kind", ["even", "skewed", "few", "small bins", "one"])
def test_rounds_are_best_fit(spark, kind):
    r = random.Random(5)
    capacity = 100 if kind == "small bins" else 2048
    sizes = {
        "even": lambda: [r.randint(1, 2048) for _ in range(3000)],
        "skewed": lambda: [min(2048, int(r.lognormvariate(5.5, 1.3)) + 1) for _ in range(6000)],
        "few": lambda: [1] * 5000 + [2048] * 3 + [700] * 10,
        "small bins": lambda: [r.randint(1, 100) for _ in range(400)],
        "one": lambda: [5],
    }[kind]()
    count = Counter(sizes)
    runs = packing.rounds(spark.createDataFrame(list(count.items()), "length long, n long"), capacity).collect()
    bins, ranks = defaultdict(list), defaultdict(list)
    for x in runs:
        for i in range(x.n):
            bins[x.bin + i].append((x.offset, x.length))
            ranks[x.length].append(x.rank + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in count.items()}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= best_fit_decreasing(sizes, capacity) + 1 + len(sizes) // 2000


def test_packing_keeps_rows_without_an_id(spark):
    rows = [(None, "a b", "x"), (None, None, "y"), (7, "a b", "z"), (7, "a b", "z"), (7, "c", "z")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, offset string")).toPandas()
    assert len(got) == 5 and got["sequence_id"].nunique() == 1 and got["doc_id"].isna().sum() == 2
    own = got.sort_values("offset")
    assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]


# --- 6


def test_mixing(spark, docs, corpus, empty):
    got = mixing.mix(docs).toPandas()
    assert sorted(got["position"]) == list(range(len(corpus))) and {"doc_id", "lang", "host"} <= set(got.columns)
    assert (got["release"] <= got["position"]).all() and (got["position"] < got["deadline"]).all()
    assert mixing.mix(empty).count() == 0
    own = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "a").when(F.col("id") < 2400, "b").otherwise("c").alias("source"))
    units = spark.createDataFrame([("a", 1500, 5), ("b", 900, 3), ("c", 600, 2)], "source string, n long, u int")
    order = mixing.mix(own, units=units).orderBy("position").toPandas()["source"].tolist()
    given = Counter()
    for i, s in enumerate(order, 1):
        given[s] += 1
        assert all(abs(given[k] - i * w) < 1 for k, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))


def test_mixing_keeps_exact_weights_of_many_sources(spark):
    sizes = {"hot": 2000, **{f"s{k:03}": 3 + k % 3 for k in range(999)}}
    rows = [(f"{s}:{i}", s) for s, n in sizes.items() for i in range(n)]
    order = mixing.mix(spark.createDataFrame(rows, "doc_id string, source string")).orderBy("position").toPandas()
    assert (order["release"] <= order["position"]).all() and (order["position"] < order["deadline"]).all()
    # the ideal flow, slot by slot, from the unrounded weights
    n = np.array(list(sizes.values()), float)
    w, place = np.sqrt(n), {s: k for k, s in enumerate(sizes)}
    ends = np.unique(n / w)
    given = np.append(0, [np.minimum(w * x, n).sum() for x in ends])
    have = np.zeros(len(n))
    for slot, s in enumerate(order["source"], 1):
        have[place[s]] += 1
        x = np.interp(slot, given, np.append(0, ends))
        assert np.abs(have - np.minimum(w * x, n)).max() < 1 + 1e-3


def edf(sources):
    """Earliest deadline first over the exact windows, slot by slot: (source, block, position, release, deadline)."""
    flow = lambda x: sum(min(u * x, n) for _, n, u in sources)
    left = {}
    for s, n, u in sources:
        ends = [flow(Fraction(i, u)) for i in range(n + 1)]
        left[s] = [(math.floor(a), math.ceil(b), i) for i, (a, b) in enumerate(zip(ends, ends[1:]))][::-1]
    for slot in range(sum(n for _, n, _ in sources)):
        due, s = min((own[-1][1], s) for s, own in left.items() if own and own[-1][0] <= slot)
        release, _, i = left[s].pop()
        yield s, i, slot, release, due


@pytest.mark.parametrize("seed", range(4))
def test_mixing_is_earliest_deadline_first(spark, seed):
    r = random.Random(seed)
    sources = [(f"s{k}", r.choice([1, 2, 5, 20, 60, 200]), r.choice([1, 3, 7, 10, 40])) for k in range(r.randint(2, 9))]
    sources.append(("tie", *sources[0][1:]))
    units = spark.createDataFrame(sources, "source string, n long, u long")
    got = sorted(map(tuple, mixing.schedule(units, slots=1).collect()), key=lambda x: x[2])
    assert got == list(edf(sources))


def test_mixing_by_steps(spark):
    """Sources of which one is far larger: more chunks than one, and blocks that unfold in several runs."""
    units = spark.createDataFrame([("a", 30_000, 173), ("b", 100, 10), ("c", 1, 1)], "source string, n long, u long")
    got = mixing.schedule(units).toPandas().sort_values("position")
    assert got["position"].tolist() == list(range(30_101)) and ((got["release"] <= got["position"]) & (got["position"] < got["deadline"])).all()
    assert got.groupby("source")["block"].apply(lambda x: x.tolist() == list(range(len(x)))).all()


def test_mixing_replaces_columns_of_its_names(spark):
    own = spark.createDataFrame([(None, None, -1, "x"), (1, "a", -1, "y"), (1, "a", -1, "y")], "doc_id long, source string, position int, block string")
    got = mixing.mix(own).toPandas()
    assert sorted(got["position"]) == [0, 1, 2] and sorted(got["block"]) == [0, 0, 1] and list(got.columns)[:2] == ["doc_id", "source"]


# --- 7


def test_toxicity(spark):
    r = random.Random(11)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        lines = [prose(r, r.randint(4, 12)).capitalize() for _ in range(r.randint(1, 6))]
        if bad:
            lines[r.randrange(len(lines))] = f"You {r.choice(['vilea', 'vileb', 'vilec'])} fool."
        rows.append((i, "\n".join(lines) if i % 2 else " ".join(lines), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.filter("doc_id % 5 <> 0"))
    got = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    held = [x for x in rows if x[0] % 5 == 0]
    assert sum((got[d].score >= 0.5) == bool(y) for d, _, y in held) / len(held) > 0.97
    found = toxicity.offending_sentences(df, toxicity.score(df, model)).filter("doc_id % 4 = 0").collect()
    assert found and sum("vile" in x.sentence for x in found) / len(found) > 0.9 and all(len(x.sentence) < 40 for x in found if "vile" in x.sentence)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (4, "x" * 100_000)], "doc_id long, text string")
    assert all(0 <= x.score < 0.5 for x in toxicity.score(odd, model).collect())
    one = toxicity.fit(df.filter("toxic = 0"))
    assert all(x.score < 0.5 for x in toxicity.score(df, one).collect())
    assert toxicity.score(df.limit(0), model).count() == 0


# --- 8


@pytest.mark.parametrize("payload", [b"", b"a", bytes(range(256)) * 9, b"x" * 1024, b"x" * 1025, b"\xff" * 3000, b"\xff\xd0\xff\xd9\x00"])
def test_avi_round_trip(payload):
    stored = media.encode_avi(payload)
    back, frames, step = media.decode_avi(stored)
    assert back == payload + b"\0" * (-len(payload) % 64 if payload else 64) and frames == -(-len(back) // 1024) and step == 40_000
    assert stored[:4] == b"RIFF" and int.from_bytes(stored[4:8], "little") == len(stored) - 8


def test_shots_find_a_cut():
    dark, bright = np.zeros((8, 16)), np.zeros((8, 16))
    dark[:, 1], bright[:, 14] = 100, 100
    assert media.shots(np.vstack([dark, bright])) == [0, 8] and media.shots(dark[:1]) == [0]
    assert sorted(media.ZIGZAG.tolist()) == list(range(64)) and media.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]


def test_media_query(spark, tmp_path, docs, corpus):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op8_media(spark, str(tmp_path)).collect()
    texts, same = {d: t for d, t, *_ in corpus}, defaultdict(set)
    assert len(got) == len(corpus)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        stored = media.encode_avi(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        same[texts[r.doc_id] or ""].add(r.feature)
    assert all(len(x) == 1 for x in same.values())
    clips = media.clip_rows(media.read_avi(media.to_avi(docs.filter("doc_id = 93")))).collect()
    assert clips[0].start_s == 0 and all(a.end_s == b.start_s for a, b in zip(clips, clips[1:], strict=False))


def jpeg(luma, chroma, quant, restart=0):
    """A baseline 4:2:0 JPEG by hand: codes of unequal lengths, a table of quantisers, restart intervals. Blocks are coefficients in zigzag order, luma (rows, cols, 64)."""
    symbols = {0: [*range(12)], 1: sorted({r << 4 | s for r in range(16) for s in range(1, 9)} | {0, 0xF0})}
    table, code = {}, {}
    for kind, own in symbols.items():
        counts = [0] * 16
        lengths = [3 if k < 2 else 5 if k < 6 else 11 for k in range(len(own))]
        for n in lengths:
            counts[n - 1] += 1
        table[kind] = bytes(counts) + bytes(own)
        value = last = 0
        for x, n in zip(own, lengths):
            value <<= n - last
            code[kind, x], last, value = (value, n), n, value + 1
    out, runs = [], []

    def put(x, n):
        out.extend((x >> (n - 1 - i)) & 1 for i in range(n))

    def amount(x):
        n = int(abs(x)).bit_length()
        return n, x if x >= 0 else x + (1 << n) - 1

    def block(own, before):
        n, x = amount(int(own[0]) - before)
        put(*code[0, n])
        put(x, n)
        zeros = 0
        for c in own[1:]:
            if c == 0:
                zeros += 1
                continue
            while zeros > 15:
                put(*code[1, 0xF0])
                zeros -= 16
            n, x = amount(int(c))
            put(*code[1, zeros << 4 | n])
            put(x, n)
            zeros = 0
        if zeros:
            put(*code[1, 0])
        return int(own[0])

    def close():
        out.extend([1] * (-len(out) % 8))
        runs.append(bytes(int("".join(map(str, out[i : i + 8])), 2) for i in range(0, len(out), 8)).replace(b"\xff", b"\xff\x00"))
        out.clear()

    rows, cols = luma.shape[0] // 2, luma.shape[1] // 2
    before = [0, 0, 0]
    for unit in range(rows * cols):
        y, x = divmod(unit, cols)
        for k in range(4):
            before[0] = block(luma[2 * y + k // 2, 2 * x + k % 2], before[0])
        for c in (1, 2):
            before[c] = block(chroma[y, x], before[c])
        if restart and (unit + 1) % restart == 0 and unit + 1 < rows * cols:
            close()
            before = [0, 0, 0]
    close()
    mark = lambda k, b: bytes([0xFF, k]) + (len(b) + 2).to_bytes(2, "big") + b
    scan = runs[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + x for i, x in enumerate(runs[1:]))
    size = (16 * rows - 3).to_bytes(2, "big") + (16 * cols - 5).to_bytes(2, "big")
    return b"".join([b"\xff\xd8", mark(0xDB, b"\0" + bytes(quant.tolist())), mark(0xC0, b"\x08" + size + b"\x03\x01\x22\0\x02\x11\0\x03\x11\0"), mark(0xC4, b"\0" + table[0] + b"\x10" + table[1]), *[mark(0xDD, restart.to_bytes(2, "big"))] * bool(restart), mark(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0"), scan, b"\xff\xd9"])


@pytest.mark.parametrize("restart", [0, 2])
def test_decodes_frames_of_other_encoders(spark, restart):
    r = np.random.default_rng(4)
    quant = r.integers(1, 9, 64)
    luma, chroma = np.zeros((4, 6, 64), int), np.zeros((2, 3, 64), int)
    for own in (luma, chroma):
        own[..., 0] = r.integers(-60, 60, own.shape[:2])
        own[..., [1, 2, 5, 20, 60]] = r.integers(-9, 9, (*own.shape[:2], 5))
    frame = jpeg(luma, chroma, quant, restart)
    got = media.decode_jpeg(frame)
    # the inverse transform, written out
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    order = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
    want = np.zeros((32, 48))
    for y in range(4):
        for x in range(6):
            square = np.zeros(64)
            square[order] = luma[y, x] * quant
            want[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = basis @ square.reshape(8, 8) @ basis.T + 128
    assert got.shape == (29, 43) and np.abs(got - np.clip(want, 0, 255)[:29, :43]).max() <= 1
    dark = jpeg(luma * 0 - 1, chroma, quant, restart)
    chunk = lambda f: b"00dc" + len(f).to_bytes(4, "little") + f + b"\0" * (len(f) % 2)
    avi = media._avi([chunk(x) for x in [frame] * 5 + [dark] * 5])
    rows = [(1, 0, bytearray(avi)), (2, 0, None), (3, 0, bytearray(b"RIFF")), (4, 0, bytearray(avi[:400])), (5, 0, bytearray(b""))]
    found = {x.doc_id: x for x in media.read_avi(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert found[1].frames == 10 and [(c.start_s, c.end_s) for c in found[1].clips] == [(0.0, 0.2), (0.2, 0.4)] and found[1].payload_bytes is None
    assert all(found[k].frames == 0 and found[k].clips == [] for k in (2, 3, 4, 5)) and found[2].media_bytes is None and found[3].media_bytes == 4
    with pytest.raises(ValueError):
        media.decode_jpeg(frame.replace(b"\xff\xc0", b"\xff\xc2"))


def test_audio_entries_absolute_places_and_frames_without_tables():
    payload = bytes(range(256)) * 3
    avi = media.encode_avi(payload)
    want = media.decode_avi(avi)
    at = avi.index(b"idx1")
    n = int.from_bytes(avi[at + 4 : at + 8], "little")
    sound = b"01wb" + (0).to_bytes(4, "little") + (4).to_bytes(4, "little") + (0).to_bytes(4, "little")
    assert media.decode_avi(avi[: at + 4] + (n + 16).to_bytes(4, "little") + sound + avi[at + 8 :]) == want
    index, movi = bytearray(avi), avi.index(b"movi")
    for k in range(at + 8, at + 8 + n, 16):
        index[k + 8 : k + 12] = (int.from_bytes(avi[k + 8 : k + 12], "little") + movi).to_bytes(4, "little")
    assert media.decode_avi(bytes(index)) == want
    tables = media.standard_tables()
    code = lambda kind, symbol: next(f"{c:0{n}b}" for (n, c), s in tables[kind].items() if s == symbol)
    assert [len(tables[k]) for k in (0, 1, 16, 17)] == [12, 12, 162, 162]
    # code words that the standard prints
    assert (code(16, 0x00), code(16, 0xF0), code(16, 0x01), code(16, 0xFA)) == ("1010", "11111111001", "00", "1111111111111110")
    assert (code(17, 0x00), code(17, 0xF0), code(17, 0x11), code(0, 0), code(0, 11), code(1, 11)) == ("00", "1111111010", "1011", "00", "111111110", "11111111110")


def test_bits_of_a_long_scan_in_linear_time():
    bits = media._Bits(bytes(range(251)) * 4000)
    start = time.time()
    assert sum(bits.take(7) for _ in range(1_000_000)) > 0 and time.time() - start < 20


# --- 9


def test_line_dedup(spark, docs, corpus, empty):
    rows = [(i, "h", f"Menu here\nText number {i}\n\nMenu here") for i in range(20)] + [(100, "h", None), (101, None, "Menu here"), (102, "g", "Menu here\nx")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("host", F.lit("clash"))
    got = {r.doc_id: r for r in linededup.drop_boilerplate(df).collect()}
    assert got[3].text == "Text number 3\n" and (got[3].n_lines, got[3].n_removed) == (4, 2) and got[3].host == "clash"
    assert got[100].text is None and got[101].text == "Menu here" and got[102].text == "Menu here\nx"
    assert linededup.drop_boilerplate(docs).count() == len(corpus) and linededup.drop_boilerplate(empty).count() == 0


def test_linededup_by_shuffle(spark, docs, empty, monkeypatch):
    rows = lambda: sorted(map(str, linededup.drop_boilerplate(docs.select("doc_id", "source", "text").repartition(8, "doc_id")).collect()))
    one = rows()
    monkeypatch.setattr(linededup, "BROADCAST_MARKS", -1)
    assert rows() == one
    # by default every host of so few is hot; with a share of two only one with over half of the pages
    monkeypatch.setattr(linededup, "HOT_SHARE", 2)
    assert rows() == one and linededup.drop_boilerplate(empty).count() == 0


# --- 10


def test_a_doc_id_with_two_texts(spark):
    r = random.Random(8)
    passage = prose(r, 40)
    rows = [(1, "a " + passage), (2, "b " * 400 + passage), (2, passage + " c"), (2, passage + " c"), (3, "d"), (None, passage), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for x in substrings.without_repeats(df, with_bytes=True).collect():
        got.setdefault(x.doc_id, []).append((x.n_bytes, x.n_removed, bytes(x.kept)))
    assert sum(map(len, got.values())) == len(rows)
    assert got[1] == [(len(rows[0][1]), 0, rows[0][1].encode())] and got[None] == [(len(passage), 0, passage.encode())] and got[4] == [(0, 0, b"")]
    long, short = sorted(got[2], reverse=True)[0], sorted(got[2])[:2]
    assert short == [(len(passage) + 2, len(passage), b" c")] * 2 or short[0][1] >= len(passage)
    assert long[1] >= len(passage)


def spans_by_hand(rows, size=100):
    seen, out = set(), {}
    for d, t in sorted(dict(rows).items()):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - size + 1):
            w = raw[i : i + size]
            if w in seen:
                gone[i : i + size] = True
            seen.add(w)
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[d] = (len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


@pytest.fixture(scope="module")
def passages(corpus):
    r = random.Random(8)
    shared = [prose(r, 25) for _ in range(3)]
    rows = [(d, t) for d, t, *_ in corpus if d != 94]
    rows += [(200 + i, prose(r, 10) + " é " + r.choice(shared)[r.randint(0, 30) :] + prose(r, 5)) for i in range(40)]
    rows += [(300, "ab" * 400), (301, "ab" * 60), (302, "q" * 99), (303, "q" * 100), (304, "q" * 300)]
    return rows


@pytest.mark.parametrize("limit", [50_000, 1])
def test_repeated_passages(spark, passages, limit):
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(5)
    got = substrings.remove_spans(df, substrings.repeated_spans(df, group_limit=limit)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == spans_by_hand(passages)


def test_repeated_passages_edge_rows(spark):
    df = spark.createDataFrame([(1, "x" * 150), (1, "x" * 150), (None, "x" * 150)], "doc_id long, text string")
    got = substrings.remove_spans(df, substrings.repeated_spans(df), with_bytes=True).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 149), (1, 149)]
    none = df.limit(0)
    assert substrings.remove_spans(none, substrings.repeated_spans(none)).count() == 0


def test_blind_trie_and_order():
    r = random.Random(5)
    for _ in range(100):
        xs = [bytes(r.choice(b"ab") for _ in range(12)) for _ in range(r.randint(1, 30))]
        trie = substrings.BlindTrie()
        for x in xs:
            trie.insert(x, 0)
        assert trie.ordered() == sorted(set(xs))
    m = np.array([[r.choice(b"ab") for _ in range(40)] for _ in range(300)], np.uint8)
    m[::3] = m[0]
    g = np.array([r.randint(0, 3) for _ in range(300)])
    order = substrings.deep_shallow(g, m, 0, 1)
    keys = [(g[i], m[i].tobytes()) for i in order]
    assert keys == sorted(keys)


# --- pipeline


def test_pipeline(spark, tmp_path, docs, corpus):
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    own.write.parquet(str(tmp_path / "documents.parquet"))
    rows = own
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, rows, str(tmp_path)))
        assert out.dtypes == own.dtypes, name
        rows = out
        if name == "language_id":
            assert {r.doc_id for r in rows.collect()} == {d for d, t, *_ in corpus if any(map(str.isalpha, t or ""))}
        if name == "near_dedup":
            want = classes([(r.doc_id, r.text) for r in before.collect()], 5)  # noqa: F821
            assert sorted(r.doc_id for r in rows.collect()) == sorted(d for d, (_, c) in want.items() if d == c)
        before = rows  # noqa: F841
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed["doc_id"]) == {r.doc_id for r in rows.collect()}
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("values", [2, 5, 1 << 60])
def test_multikey_quicksort_orders_words(values):
    r = np.random.default_rng(values % 97)
    keys = r.integers(0, values, (500, 4)).astype(np.uint64)
    group = np.sort(r.integers(0, 40, 500))
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    order, edges = substrings.multikey(np.arange(500), starts, keys, 1, 3)
    want = sorted(range(500), key=lambda i: (group[i], keys[i, 1], keys[i, 2]))
    own = lambda i: (int(group[i]), int(keys[i, 1]), int(keys[i, 2]))
    assert [own(i) for i in order] == [own(i) for i in want] and sorted(order) == list(range(500))
    assert edges.tolist() == [k for k in range(500) if k == 0 or own(want[k]) != own(want[k - 1])]
    strings = r.integers(0, 3, (300, 40)).astype(np.uint8)
    strings[:150, :20] = 1
    group = np.sort(r.integers(0, 5, 300))
    order = substrings.deep_shallow(group, strings)
    assert [(group[i], strings[i].tobytes()) for i in order] == sorted((group[i], strings[i].tobytes()) for i in range(300))


def test_mixture_reaches_the_sequences(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    rows = [(i, prose(r, r.randint(50, 300)), "en", "a" if i % 4 else "b", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    source = {x[0]: x[3] for x in rows}
    found = []
    for weight in (1, 1000):
        units = spark.createDataFrame([("a", 150, 1), ("b", 50, weight)], "source string, n long, u long")
        monkeypatch.setattr(mixing, "source_units", lambda *_, units=units: units)
        mixed = common.cut(corpus_pipeline.mix_sources(spark, docs, ""))
        got = corpus_pipeline.pack(spark, mixed, "").toPandas().sort_values(["sequence_id", "offset"])
        assert sorted(set(got["sequence_id"])) == list(range(got["sequence_id"].nunique())) and set(got["doc_id"]) == set(source)
        assert (got.groupby("sequence_id")["length"].sum() <= packing.CAPACITY).all()
        place = {d: i for i, d in enumerate(x.doc_id for x in mixing.mix(docs).orderBy("position").collect())}
        assert got["doc_id"].map(place).groupby(got["sequence_id"]).min().is_monotonic_increasing
        found.append(got[["doc_id", "piece", "sequence_id", "offset"]].values.tolist())
    assert found[0] != found[1]


def test_pipeline_on_empty_table(spark, tmp_path, empty):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0



def test_pipeline_keeps_columns_with_the_operators_names(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, prose(r, 30), r.choice(["en", "de"]), "s", 200) for i in range(40)] + [(None, prose(r, 9), "en", "s", 60), (3, "other text of document three.", "en", None, 29)]
    own = {"n_lines": 77, "n_removed": 5, "position": "p", "block": 9, "release": "r", "deadline": 1, "_row": 8, "_lines": "l", "_site": "q", "_rest": "x", "_marks": 2, "kept": 3, "score": 4}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in own.items()})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.select(*own).distinct().collect() == [tuple(own.values())], name
        docs = common.cut(out)
    assert docs.count() == len(rows) - 1 and corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()
