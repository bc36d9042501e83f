"""Hybrid search, rerank and evaluation end to end against brute force in plain Python."""

import math
import random
import re

import numpy as np
import pytest

from tessera.operators import embed, fusion
from tessera.plans import pipelines

WORDS = [f"w{k}" for k in range(60)]
TOKEN = re.compile(r"[a-z0-9]+(?:[-_][a-z0-9]+)*")


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(12)
    weights = [1 / (k + 1) for k in range(60)]
    text = lambda n: " ".join(rng.choices(WORDS, weights, k=n))
    chunks = [(i, text(rng.randrange(3, 30))) for i in range(120)]
    queries = [(q, f"{text(3)} w{30 + q}") for q in range(8)]
    e = embed.hashing_embedder(16)
    c = pipelines.with_embedding(spark.createDataFrame(chunks, "chunk_id long, content string"), e, "content").cache()
    q = pipelines.with_embedding(spark.createDataFrame(queries, "query_id long, text string"), e, "text").cache()
    return c, q, {r.chunk_id: (r.content, np.array(r.embedding, float)) for r in c.collect()}, {r.query_id: (r.text, np.array(r.embedding, float)) for r in q.collect()}


def ranked(scores, k):
    return sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]


def scaled(hits):
    low, high = min(s for _, s in hits), max(s for _, s in hits)
    return {c: 1.0 if high == low else (s - low) / (high - low) for c, s in hits}


def hybrid(chunks, text, vector, candidates, weights):
    cos = lambda a, b: float(a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b) + 1e-9))
    near = ranked({c: cos(vector, v) for c, (_, v) in chunks.items()}, candidates)
    tokens = {c: TOKEN.findall(t.lower()) for c, (t, _) in chunks.items()}
    n, mean = len(chunks), sum(map(len, tokens.values())) / len(chunks)
    df = {}
    for own in tokens.values():
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: x if x >= 0 else floor for t, x in idf.items()}
    found = {}
    for c, own in tokens.items():
        for t in TOKEN.findall(text.lower()):
            if t in own:
                tf = own.count(t)
                found[c] = found.get(c, 0) + idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / mean))
    worded = [x for x in ranked(found, candidates) if x[1] > 0]
    a, b = scaled(near), scaled(worded) if worded else {}
    return {c: weights[0] * a.get(c, 0) + weights[1] * b.get(c, 0) for c in a.keys() | b.keys()}


def test_hybrid_search(world, spark):
    c, q, chunks, queries = world
    got = {}
    for r in fusion.hybrid_search(q, c, candidates=25, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, round(r.combined_score, 6)))
    for query, (text, vector) in queries.items():
        want = ranked(hybrid(chunks, text, vector, 25, (5.0, 3.0)), 10)
        assert sorted(got[query]) == [(k + 1, x, pytest.approx(round(s, 6), abs=2e-6)) for k, (x, s) in enumerate(want)]


def test_evaluated_pipeline(world, spark):
    """Fusion of 100 and 100, the 10 best by token overlap, and their hits and reciprocal ranks."""
    c, q, chunks, queries = world
    rels = {query: sorted(random.Random(query).sample(range(120), 6)) for query in queries}
    qrels = spark.createDataFrame([(query, x, 1, x) for query, own in rels.items() for x in own], "query_id long, doc_id long, rel int, position long")
    got = {r.query_id: r for r in pipelines.evaluated(q, c, qrels).collect()}
    for query, (text, vector) in queries.items():
        hits = ranked(hybrid(chunks, text, vector, 100, (5.0, 3.0)), 100)
        own = set(TOKEN.findall(text.lower()))
        shared = lambda x: (lambda y: len(own & y) / len(own | y))(set(TOKEN.findall(chunks[x][0].lower())))  # noqa: E731, B023
        order = sorted(range(len(hits)), key=lambda k: (-round(shared(hits[k][0]), 9), k))[:10]
        ranks = {hits[k][0]: place + 1 for place, k in enumerate(order)}
        met = [ranks[x] for x in rels[query] if x in ranks]
        assert (got[query].hit_at_5, got[query].hit_at_10) == (int(any(x <= 5 for x in met)), int(bool(met)))
        assert got[query].mrr == pytest.approx(1 / met[0] if met else 0)
        gains = sum(1 / math.log2(x + 1) for x in met)
        assert got[query].ndcg == pytest.approx(gains / sum(1 / math.log2(k + 2) for k in range(len(met))) if met else 0)
