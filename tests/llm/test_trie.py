"""The conversation trie against brute force over all prefixes."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = convs.get(base, [])[:h] + own[h:]
    members, ends = {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = []

    def visit(k):
        leaves, saved = 0, (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        for x in kids.get(k, []):
            n, s = visit(x)
            leaves, saved = leaves + n, saved + s
        leaves = leaves or 1
        said = ",".join(map(str, sorted(ends.get(k, []))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids.get(k, [])), leaves, saved, hashlib.sha256(said.encode()).hexdigest()))
        return leaves, saved

    if members:
        visit(())
    return sorted(out, key=str)


def conversations(seed, n, turns):
    rng, out = random.Random(seed), []
    for k in range(n):
        c = rng.choice([100, 200, 300, 7000]) + k if k % 4 else 100 * k
        out += [(c, t, rng.choice(["user", "assistant"]), rng.choice("ab")) for t in range(rng.randrange(turns))]
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_two_fattest(spark):
    rows = [(a, b) for a in range(40) for b in range(a + 1, 70)]
    out = spark.createDataFrame(rows, "low long, high long").withColumn("f", T.two_fattest("low", "high")).collect()
    assert all(r.f == max(range(r.low + 1, r.high + 1), key=lambda x: x & -x) for r in out)


@pytest.mark.parametrize("batches", [(3, 5, 8)])
def test_against_brute_force(spark, monkeypatch, batches):
    monkeypatch.setattr(T, "BATCHES", batches)
    rows = conversations(len(batches), 150, 9)
    assert got(T.trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_long_paths_and_prefixes(spark, monkeypatch):
    """Long shared runs, ends inside them, forks at all depths, copies: each edge is cut in several places by one batch."""
    monkeypatch.setattr(T, "BATCHES", (2, 6, 8))
    rng, rows = random.Random(4), []
    main = [("user", f"t{t}") for t in range(60)]
    for c in range(1, 70):
        at = rng.randrange(8, 60)
        turns = main[:at] + ([("assistant", f"x{rng.randrange(2)}")] * rng.randrange(4) if c % 3 else [])
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    assert got(T.trie(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


def test_query_on_table_with_nulls_ties_and_its_twin(spark, tmp_path):
    rows = [*conversations(8, 60, 8), (None, 1, "user", "a"), (31, None, "user", "b"), (31, None, "user", "a"), (31, 4, None, None), (31, 4, None, None), (32, 0, "user", "q" * 300_000), (33, 0, "user", "a"), (-150, 0, "user", "a"), (-100, 3, "user", "b")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS a", "2 AS conv", "3 AS n_convs")
    df.repartition(1).write.parquet(f"{tmp_path}/conversations.parquet")
    out = got(T.op13_trie(spark, str(tmp_path)))
    assert out == brute(rows)
    twin = duckdb.connect()
    twin.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert sorted(twin.sql(f"SELECT {names} FROM ({T.ORACLE['op13_trie']})").fetchall(), key=str) == out


def test_turnless_and_empty(spark):
    rows = [(c, 0, "user", "a") for c in range(1, 30)]  # most take turns of an absent conversation
    assert got(T.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    turnless = [(c, 0, "user", "a") for c in range(1, 200) if c % 100 and zlib.crc32(str(c).encode()) % 6]
    assert got(T.trie(spark.createDataFrame(turnless, SCHEMA))) == brute(turnless) and len(brute(turnless)) == 1
    assert got(T.trie(spark.createDataFrame([], SCHEMA).withColumn("n", F.lit(1)))) == []
