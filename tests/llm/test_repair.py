"""Conversation structure repair against a brute-force search over all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import duckdb
import pytest

from tessera.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        out += [(c, t, role, text)] * (2 if how == 3 else 1)
    return out


def brute(rows):
    """What the contract says of one conversation's rows in order, by trying all edits at each row."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = re.compile(r"^(s?(ua)+)?$")
    starts = {"", "s", "u", "a", "su"}

    @cache
    def best(i, last):
        """(cost, audit, roles and texts) from row i on, after a prefix that ends in `last`."""
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]

        def add(cost, letter, to, line):
            c, a, lines = best(i + 1, to)
            ways.append((cost + c, letter + a, ((line,) if line else ()) + lines))

        if i < len(rows):
            _, _, role, text = rows[i]
            add(3, "D", last, None)
            if faults[i] not in ("blank", "duplicate"):
                more = int(faults[i] == "truncated")
                if role[:1] and role[0] in follow:
                    add(more, "K", role[0], f"{role}:{text}")
                for to in ("user", "assistant"):
                    if to[0] in follow:
                        add(2 + more, "R", to[0], f"{to}:{text}")
        # inserted rows are never more than two in a row on a cheapest way
        for k in (1, 2):
            roles, at = [], last
            for _ in range(k):
                to = {"": "user", "s": "user", "u": "assistant", "a": "user"}[at]
                roles.append(f"{to}:")
                at = to[0]
            if i == len(rows):
                if at == "a":
                    ways.append((2 * k, "I" * k, tuple(roles)))
            else:
                _, _, role, text = rows[i]
                follow2 = {"": "su", "s": "u", "u": "a", "a": "u"}[at]
                if faults[i] not in ("blank", "duplicate"):
                    more = int(faults[i] == "truncated")
                    c, a, lines = best(i + 1, role[0]) if role[:1] and role[0] in follow2 else (None, None, None)
                    if c is not None:
                        ways.append((2 * k + more + c, "I" * k + "K" + a, (*roles, f"{role}:{text}", *lines)))
                    for to in ("user", "assistant"):
                        if to[0] in follow2:
                            c, a, lines = best(i + 1, to[0])
                            ways.append((2 * k + 2 + more + c, "I" * k + "R" + a, (*roles, f"{to}:{text}", *lines)))
                c, a, lines = best(i + 1, at)
                ways.append((2 * k + 3 + c, "I" * k + "D" + a, (*roles, *lines)))
        return min(ways)

    assert legal.match("") and starts
    cost, audit, lines = best(0, "")
    assert legal.match("".join(x[0] for x in lines))
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def wanted(rows):
    return {c: brute(sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))) for c in {r[0] for r in rows}}


def conversations(seed, n, turns):
    rng, out = random.Random(seed), []
    for c in range(n):
        kind = rng.random()
        for t in range(rng.randrange(turns)):
            role = rng.choice(["user", "assistant", "system", "tool", ""]) if kind < 0.5 else ["user", "assistant"][t % 2] if rng.random() < 0.8 else "system"
            out.append((c, 2 * t if kind < 0.3 else t, role, rng.choice(["Yes.", "no", "Why?", " ", "", "well!  ", "a. b", f"t{t}."])))
    return out


@pytest.mark.parametrize("block", [5, 1000])
def test_against_brute_force(spark, block):
    rows = conversations(block, 60, 14)
    got = R.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), block).collect()
    want = wanted(rows)
    assert {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in got} == want


def test_one_long_conversation_over_many_chunks(spark):
    """Rows without any that would bring the vectors together, and deleted ones, make long runs of fix-ups."""
    rng = random.Random(5)
    kinds = [("system", "x."), ("user", ""), ("assistant", "y")]
    rows = [(1, t, *(kinds[0] if t < 60 else kinds[1] if t < 120 else rng.choice(kinds))) for t in range(160)]
    rows = [(c, t, r, x if not x else f"{t}{x}") for c, t, r, x in rows]
    got = R.repair(spark.createDataFrame(rows, SCHEMA).repartition(4), 16).collect()
    want = wanted(rows)
    assert [(r.conv_id, r.asDict() | {}) for r in got] == [(1, {"conv_id": 1} | want[1])]


def test_damage(spark):
    rows = [*conversations(9, 80, 9), (None, None, None, None), (None, 3, "user", "a."), (5, None, None, "x."), (6, 1, "user", None)]
    got = R.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted(map(tuple, got), key=lambda r: str(key(r))) == sorted(damaged(rows), key=lambda r: str(key(r)))


def test_query_on_table(spark, tmp_path):
    rows = [*conversations(3, 50, 9), (None, None, None, None), (None, 2, "user", "a."), (70, None, "user", "x."), (70, None, "assistant", "y."), (71, 1, "user", "q" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'u' AS audit", "1 AS _at", "2 AS state", "3 AS cost")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in R.op11_repair(spark, str(tmp_path)).collect()}
    keep = damaged(rows)
    # ties of turn go by role
    want = {c: brute(sorted((r for r in keep if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))) for c in {r[0] for r in rows}}
    assert got == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert R.op11_repair(spark, str(tmp_path)).count() == 0


def test_sql_twin(spark, tmp_path):
    rows = [*conversations(11, 60, 9), (None, None, None, None), (None, 2, "user", "a."), (70, None, "user", "x."), (70, None, "assistant", "y.")]
    spark.createDataFrame(rows, SCHEMA).repartition(1).write.parquet(f"{tmp_path}/conversations.parquet")
    keep, twin = damaged(rows), duckdb.connect()
    twin.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: dict(zip(names, r[1:], strict=True)) for r in twin.sql(f"SELECT conv_id, {', '.join(names)} FROM ({R.ORACLE['op11_repair']})").fetchall()}
    assert got == {c: brute(sorted((r for r in keep if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))) for c in {r[0] for r in rows}}
