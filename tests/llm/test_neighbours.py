"""Nearest neighbours against brute force: exact scores and order always, and nine tenths of the true neighbours at least."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=20):
    """query -> [(score, id)] by all rows but the query's own; copies of a row are one row."""
    own = list({(i, tuple(np.float32(v).tolist())): np.array(v, np.float32).astype(float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}.items())
    dim = max((len(v) for _, v in own), default=0)
    x = np.array([np.pad(v, (0, dim - len(v))) for _, v in own])
    out = {}
    for j, ((i, _), _) in enumerate(own):
        if i is not None and i % 20 == 0:
            s = (x[j] * x).sum(1)
            order = sorted((k for k in range(len(own)) if k != j), key=lambda k: (-s[k], own[k][0][0] is None, own[k][0][0] or 0))
            out[i] = [(s[k], own[k][0][0]) for k in order[:k]]
    return out


def run(spark, rows, k=20):
    df = spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], 7, "x") for i, v in rows], SCHEMA + ", score int, lo string").repartition(3)
    got = {}
    for r in sorted(N.nearest(df, F.col("vec_id") % 20 == 0, k).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in got.values())
    return {q: [x[1:] for x in v] for q, v in got.items()}


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_scores(spark, scale, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 200)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:
        x *= rng.uniform(0.5, 2, (4000, 1)).astype(np.float32)
    x[1000:2200] = x[3] + rng.standard_normal((1200, 32)).astype(np.float32) * 0.01  # a third is one cluster
    rows = [(int(i), x[i].tolist()) for i in range(4000)]
    got, want = run(spark, rows), brute(rows)
    assert recall(got, want) >= 0.9
    by_id = dict(rows)
    for q, found in got.items():
        s = [(np.array(by_id[q], np.float32).astype(float) * np.array(by_id[i], np.float32).astype(float)).sum() for _, i in found]
        assert np.allclose(s, [a for a, _ in found], rtol=0, atol=1e-14) and [a for a, _ in found] == sorted((a for a, _ in found), reverse=True)


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-2, 3, (6, 4)).tolist()
    base[0] = [1, 1, 0, 0]
    rows = [(i, base[0] if i % 3 == 0 else base[i % 6]) for i in range(150)]
    rows += [(200, None), (220, [0, 0, 0, 0]), (240, [1, None, 0, 0]), (260, [1, float("nan"), 0, 0]), (280, [float("inf"), 0, 0, 0]), (300, []), (320, [1, 2]), (None, [2, 2, 2, 2]), (60, base[0]), (60, base[0]), (340, [1, 1, 1, 1, 1])]
    got, want = run(spark, rows), brute(rows)
    assert got == {q: [(s, i) for s, i in v] for q, v in want.items()}


def test_few_rows(spark):
    rows = [(20 * i, [1.0, float(i)]) for i in range(5)]
    assert run(spark, rows) == brute(rows) and run(spark, rows[:1]) == {} and run(spark, []) == {}
    assert run(spark, [(1, [1.0])]) == {}


def test_perturbations_come_by_score():
    """All sets of three functions by their expected score, against sorting every one."""
    m = 3
    j = np.arange(1, 2 * m + 1)
    z = [a * (a + 1) / 4 / (m + 1) / (m + 2) if a <= m else 1 - (2 * m + 1 - a) / (m + 1) + (2 * m + 1 - a) * (2 * m + 2 - a) / 4 / (m + 1) / (m + 2) for a in j]
    every = [c for n in range(m + 1) for c in itertools.combinations(range(2 * m), n) if all(2 * m - 1 - x not in c for x in c)]
    got = N.perturbations(m, 100)
    assert sorted(got) == sorted(every) and len(got) == 27
    scores = [sum(z[x] for x in c) for c in got]
    assert scores == sorted(scores)


def test_probe_numbers_are_those_that_fit_counts():
    """found_at, which the fit uses, tells the probe of `probes` that has the neighbour's bucket."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    y = x + rng.standard_normal((300, 8)) * 0.4
    t = N.Tables(8, 4, 2, 1.5, float(np.linalg.norm(np.concatenate([x, y]), axis=1).max()), 81)
    rank = {sum(1 << j for j in a): k for k, a in enumerate(t.sets)}
    for table in range(2):
        keys, own = t.probes(x, table), t.key(np.floor(t.places(y, table, False)), table)
        want = [int(np.flatnonzero(k == o)[0]) if (k == o).any() else 1 << 40 for k, o in zip(keys, own, strict=True)]
        assert t.found_at(x, y, table, rank).tolist() == want
