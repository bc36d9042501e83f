"""Conversation structure repair: the cheapest edits that make a conversation `(s?(ua)+)?` by role initials, found by rank-convergence parallel Viterbi.

Rows are sorted over the cluster by conversation and turn, so that one conversation may cover many parts. Chunks of them start backwards from a speculative cost
vector side by side. In a fix-up pass each chunk takes the vector that its successor has reached and reruns from its end until old and new vectors differ by a
constant alone, from where all it had holds; passes go on until no chunk's assumption is wrong. The stitched costs to the end tell at each row which edits are
on a cheapest way, and the trace takes the ASCII-least of them; its states at the chunks' starts come from chunk-wise state maps, joined by doubling.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_order

#: Rows of a chunk at most.
BLOCK = 1 << 16
#: Nothing yet, after system, after user, after assistant: what an inserted or changed row leads to, and what ending there costs.
FORWARD, END = (2, 2, 3, 2), (0, 4, 2, 0)
#: Role initials s, u, a and others: the state that a kept row leads to, by state.
KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
LEGAL = {(0, 1), (1, 2), (2, 1)}
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
GUESS = "0000"


def _ways(state: int, code: int) -> list[tuple[str, int, int]]:
    """(letter, price, state after) of the edits of a row, by letter. A code is 4 * role + fault."""
    role, fault = divmod(code, 4)
    out, more = [("D", 3, state)], int(fault == TRUNCATED)
    if fault < BLANK:
        if state in KEEP[role]:
            out.append(("K", more, KEEP[role][state]))
        out.append(("R", 2 + more, FORWARD[state]))
    return out


@cache
def _before(after: str, code: int) -> tuple[str, int]:
    """(cost vector before a row, what was taken off so that its least is 0); vectors are strings of chr(48 + cost) by state."""
    to = [ord(x) - 48 for x in after]
    best = [min(price + to[s] for _, price, s in _ways(state, code)) for state in range(4)]
    for _ in range(2):
        best = [min(best[s], 2 + best[FORWARD[s]]) for s in range(4)]
    least = min(best)
    return "".join(chr(48 + x - least) for x in best), least


@cache
def _edit(state: int, after: str, code: int) -> tuple[str, int, int]:
    """(letters, cost, state after) of the ASCII-least cheapest edits up to and with a row."""
    here, off = _before(after, code)
    left, said, cost = lambda v, s: ord(v[s]) - 48, "", 0
    while True:
        ways = [(x, p, s) for x, p, s in _ways(state, code) if p + left(after, s) - off == left(here, state)]
        if 2 + left(here, FORWARD[state]) == left(here, state):
            ways.append(("I", 2, FORWARD[state]))
        letter, price, state = min(ways)
        said, cost = said + letter, cost + price
        if letter != "I":
            return said, cost, state


def _entry(codes: str, after: str) -> str:
    for c in reversed(codes):
        after = _before(after, int(c, 16))[0]
    return after


def _fix(codes: str, old: str, entry: str, new: str) -> str:
    """The chunk's vector at its start for the end vector `new`, by that for `old`: the rerun stops where both agree."""
    for c in reversed(codes):
        if old == new:
            return entry
        old, new = _before(old, int(c, 16))[0], _before(new, int(c, 16))[0]
    return new


def _trace(codes: str, after: str, state: int, last: bool) -> tuple[str, int, int]:
    """(letters, cost, state after) of a chunk that is entered in `state`."""
    vectors = [after]
    for c in reversed(codes):
        vectors.append(_before(vectors[-1], int(c, 16))[0])
    said, total = [], 0
    for c, v in zip(codes, reversed(vectors[:-1]), strict=True):
        letters, cost, state = _edit(state, v, int(c, 16))
        said.append(letters)
        total += cost
    while last and END[state]:
        said.append("I")
        state, total = FORWARD[state], total + 2
    return "".join(said), total, state


def _chunks(lines: DataFrame, block: int) -> DataFrame:
    """(conv_id, _part, start, codes, next_part, next_start, last, first, next_code): the runs of each conversation in a part, in blocks, linked to their successors."""
    firsts = lines.groupBy("conv_id", "a", "b").agg(F.min("_id").alias("_id")).select("_id", F.lit(True).alias("new"))
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    rows = lines.select(
        "conv_id", "_id", "_part", "_at", F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)), F.lit(0)).alias("role"),
        F.when(bare == "", BLANK).alias("blank"), F.when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE).alias("end"),
    )
    rows = rows.join(firsts, "_id", "left")
    fault = F.coalesce("blank", F.when(F.col("new").isNull(), DUPLICATE).otherwise(F.col("end")))
    code = F.pmod(F.col("role") - 1, F.lit(4)) * 4 + fault
    piece = F.struct("_at", F.substr(F.lit("0123456789abcdef"), (code + 1).cast("int"), F.lit(1)).alias("c"))
    runs = rows.groupBy("conv_id", "_part", F.floor(F.col("_at") / block).alias("_block")).agg(F.min("_at").alias("start"), F.max("_at").alias("end"), F.array_sort(F.collect_list(piece)).alias("x"))
    runs = cut(runs.select("conv_id", "_part", "start", "end", F.array_join(F.transform("x", lambda p: p["c"]), "").alias("codes")))
    # parts are as many as the shuffle's partitions
    parts = sorted(lines.groupBy("_part").agg(F.max("_at").alias("top")).collect())
    spark = lines.sparkSession
    after = spark.createDataFrame([(p, t, parts[k + 1][0] if k + 1 < len(parts) else None) for k, (p, t) in enumerate(parts)], "_part int, top long, later int")
    runs = runs.join(F.broadcast(after), "_part")
    own_end = F.col("end") == F.col("top")
    runs = runs.withColumns({"next_part": F.when(own_end, F.col("later")).otherwise(F.col("_part")), "next_start": F.when(own_end, 0).otherwise(F.col("end") + 1)})
    other = runs.select(F.col("_part").alias("next_part"), F.col("start").alias("next_start"), F.col("conv_id").alias("c2"), F.substring("codes", 1, 1).alias("next_code"))
    runs = runs.join(other, ["next_part", "next_start"], "left").withColumn("last", ~F.coalesce(F.col("next_code").isNotNull() & F.col("conv_id").eqNullSafe(F.col("c2")), F.lit(False)))
    led = runs.filter("NOT last").select(F.col("next_part").alias("_part"), F.col("next_start").alias("start"), F.lit(False).alias("led"))
    runs = runs.join(led, ["_part", "start"], "left").withColumn("first", F.coalesce("led", F.lit(True)))
    return runs.select("conv_id", "_part", "start", "codes", "next_part", "next_start", "last", "first", F.when(~F.col("last"), F.col("next_code")).alias("next_code"))


def _stitched(chunks: DataFrame) -> DataFrame:
    """Chunks of conversations with two or more, with `after` (cost vector at the end, up to a constant) and `state` (at the start)."""

    @F.pandas_udf("string")
    def guess(codes: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([_entry(c, v) for c, v in zip(codes, after, strict=True)])

    @F.pandas_udf("string")
    def fix(codes: pd.Series, old: pd.Series, entry: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([_fix(*x) for x in zip(codes, old, entry, new, strict=True)])

    @F.pandas_udf("string")
    def state_map(codes: pd.Series, after: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series(["".join(str(_trace(c, v, s, e)[2]) for s in range(4)) for c, v, e in zip(codes, after, last, strict=True)])

    some = chunks.withColumn("after", F.when(F.col("last"), "".join(chr(48 + x) for x in END)).otherwise(GUESS))
    some = cut(some.withColumn("entry", guess("codes", "after")))
    while True:
        reached = some.select(F.col("_part").alias("next_part"), F.col("start").alias("next_start"), F.col("entry").alias("reached"))
        linked = some.join(reached, ["next_part", "next_start"], "left")
        wrong = ~F.col("last") & (F.col("reached") != F.col("after"))
        some = cut(linked.withColumn("wrong", wrong).withColumn("then", F.when(F.col("wrong"), F.col("reached")).otherwise(F.col("after")))
                   .withColumn("entry", fix("codes", "after", "entry", "then")).withColumn("after", F.col("then")).drop("reached", "then"))
        if some.filter("wrong").isEmpty():
            break
        some = some.drop("wrong")
    # each chunk's map covers itself and `span` chunks before it at most; the start's map has one value alone
    maps = some.select(F.col("next_part").alias("_part"), F.col("next_start").alias("start"), F.col("_part").alias("p"), F.col("start").alias("s"), F.when(F.col("last"), None).otherwise(state_map("codes", "after", "last")).alias("map"), "first")
    maps = cut(maps.filter("map IS NOT NULL").withColumns({"map": F.when(F.col("first"), F.repeat(F.substring("map", 1, 1), F.lit(4))).otherwise(F.col("map"))}))
    while not maps.filter("NOT first").isEmpty():
        back = maps.select(F.col("_part").alias("p"), F.col("start").alias("s"), F.col("p").alias("p2"), F.col("s").alias("s2"), F.col("map").alias("m2"), F.col("first").alias("f2"))
        two = maps.join(back, ["p", "s"], "left")
        both = F.concat(*(F.substr(F.col("map"), F.substring("m2", k, 1).cast("int") + 1, F.lit(1)) for k in range(1, 5)))
        done = F.col("first")
        maps = cut(two.select("_part", "start", F.when(done, F.col("p")).otherwise(F.col("p2")).alias("p"), F.when(done, F.col("s")).otherwise(F.col("s2")).alias("s"),
                              F.when(done, F.col("map")).otherwise(both).alias("map"), F.when(done, True).otherwise(F.col("f2")).alias("first")))
    starts = maps.select("_part", "start", F.substring("map", 1, 1).cast("int").alias("state"))
    return some.join(starts, ["_part", "start"], "left").withColumn("state", F.coalesce("state", F.lit(0)))


def _digests(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256). A digest takes its bytes in order, so a conversation's texts pass one task, a row at a time."""
    rows = lines.select("conv_id", "_part", "_at", F.lit(1).alias("kind"), "role", "text", F.lit(0).alias("state"))
    told = edits.select("conv_id", "_part", F.col("start").alias("_at"), F.lit(0).alias("kind"), F.lit("").alias("role"), F.col("audit").alias("text"), "state")
    key = lines.schema["conv_id"].dataType

    def run(batches):
        at, sha, any_line, letters, k, state = None, None, False, "", 0, 0

        def say(line: str) -> None:
            nonlocal any_line
            sha.update((("\n" if any_line else "") + line).encode())
            any_line = True

        def inserts() -> None:
            nonlocal k, state
            while k < len(letters) and letters[k] == "I":
                say("assistant:" if state == 2 else "user:")
                k, state = k + 1, FORWARD[state]

        for batch in batches:
            out = []
            for conv, kind, role, text, entered in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "state")), strict=True):
                if sha is None or conv != at:
                    if sha is not None:
                        inserts()
                        out.append((at, sha.hexdigest()))
                    at, sha, any_line, letters, k = conv, hashlib.sha256(), False, "", 0
                if kind == 0:
                    inserts()
                    letters, k, state = text, 0, entered
                    continue
                inserts()
                letter, k = letters[k], k + 1
                if letter == "K":
                    say(f"{role}:{text}")
                    state = KEEP["sua".index(role[0])][state]
                elif letter == "R":
                    say(("assistant:" if state == 2 else "user:") + text)
                    state = FORWARD[state]
            yield _digest_batch(out)
        if sha is not None:
            inserts()
            yield _digest_batch([(at, sha.hexdigest())])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(key)

    def _digest_batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], ["conv_id", "repaired_sha256"])

    both = rows.unionByName(told).repartition("conv_id").sortWithinPartitions("conv_id", "_part", "_at", "kind")
    return both.mapInArrow(run, f"conv_id {key.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id with rows (conv_id, turn, role, text).

    Rows are taken by turn (nulls first); ties by role, the first 64 characters of the text and its hash, so copies stand side by side. A null role or text is one
    space; rows with a null conv_id are one conversation. Extra columns don't matter; an empty table gives no rows. A text of any length is a row of its own in
    the sort. One conversation may hold most rows: all but the digest, whose bytes have an order, is dealt over the cluster by chunks of `block` rows.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    own = rows.select("conv_id", "turn", role.alias("role"), F.left(text, F.lit(64)).alias("head"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("line"), text, role).alias("b"), text.alias("text"))
    lines = in_order(own, "conv_id", "turn", "role", "head", "a", "b").drop("head")
    chunks = cut(_chunks(lines, block))
    lone = chunks.filter("first AND last").select("*", F.lit("".join(chr(48 + x) for x in END)).alias("after"), F.lit(0).alias("state"))
    many = chunks.filter("NOT (first AND last)")
    if not many.isEmpty():
        lone = lone.unionByName(_stitched(many).select(*lone.columns))

    @F.pandas_udf("blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    def edits(codes: pd.Series, after: pd.Series, state: pd.Series, last: pd.Series, following: pd.Series) -> pd.DataFrame:
        out = []
        for c, v, s, e, n in zip(codes, after, state, last, following, strict=True):
            audit, cost, _ = _trace(c, v, s, e)
            faults, roles = [int(x, 16) % 4 for x in c], [int(x, 16) // 4 for x in (c if n is None else c + n)]
            illegal = sum(pair not in LEGAL for pair in zip(roles, roles[1:], strict=False))
            out.append((faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost, audit))
        return pd.DataFrame(out, columns=["blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    done = cut(lone.withColumn("e", edits("codes", "after", "state", "last", "next_code")).select("conv_id", "_part", "start", "state", "e.*"))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    pieces = F.array_sort(F.collect_list(F.struct("_part", "start", "audit")))
    found = done.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in counts), F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"))
    turn = lambda f: f("turn").cast("decimal(38,0)")
    gaps = lines.groupBy("conv_id").agg(F.coalesce((turn(F.max) - turn(F.min) + 1 - F.count_distinct("turn")).try_cast("long"), F.lit(0)).alias("gaps"))
    return _by_id([found, gaps, _digests(lines, done)])


def _by_id(tables: list[DataFrame]) -> DataFrame:
    """Tables with at most one row a conv_id, null included, as one; what a conv_id has in none is that of no rows."""
    all_rows = tables[0]
    for t in tables[1:]:
        all_rows = all_rows.unionByName(t, allowMissingColumns=True)
    zeros: dict[str, Column] = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    zeros |= {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return all_rows.groupBy("conv_id").agg(*(F.coalesce(F.max(c) if c in all_rows.columns else F.lit(None), z).alias(c) for c, z in zeros.items()))


def damage(rows: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32 of `conv_id:turn` mod 20: 0 drops a row, 1 empties its text, 2 takes its `[.!?]`, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    own = rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), how.alias("how")).filter("how <> 0")
    return own.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1)))).drop("col")


def op11_repair(spark, sf_dir):
    """Every conv_id of `conversations`, damaged and repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return _by_id([repair(damage(rows)), rows.select("conv_id").distinct()])


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB SQL: a fold over its bytes of eight shifts each."""
    shift = "list_reduce(list_concat([xor(z, y)], list_transform(range(8), lambda i: 0::UBIGINT)), lambda u, w: xor(u >> 1, 3988292384::UBIGINT * (u & 1)))"
    data = f"list_transform(list_filter(string_split({text}, ''), lambda s: s <> ''), lambda s: ascii(s)::UBIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {data}), lambda z, y: {shift}), 4294967295::UBIGINT)"


_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
ORACLE = {
    "op11_repair": f"""
WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(_KEY)} % 20 AS h FROM conversations),
y AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM x WHERE h <> 0),
z AS (SELECT *, coalesce(conv_id::VARCHAR, '-') AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, count(*) OVER (PARTITION BY conv_id) AS n, regexp_replace(text, '[ \\t\\n\\v\\f\\r]+$', '') AS bare FROM y),
f AS (SELECT *, CASE WHEN bare = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 3 WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault,
  CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM z),
b AS (SELECT DISTINCT c, n + 1 AS k, [0, 4, 2, 0] AS v FROM f UNION ALL
SELECT c, k, [least(r0, 2 + r2, 4 + r3), least(r1, 2 + r2, 4 + r3), least(r2, 2 + r3), least(r3, 2 + r2)] FROM (SELECT f.c, f.k,
  least(3 + v[1], CASE WHEN fault < 2 THEN least(2 + fault + v[3], CASE r WHEN 0 THEN fault + v[2] WHEN 1 THEN fault + v[3] ELSE 1000000000 END) ELSE 1000000000 END) AS r0,
  least(3 + v[2], CASE WHEN fault < 2 THEN fault + v[3] + CASE r WHEN 1 THEN 0 ELSE 2 END ELSE 1000000000 END) AS r1,
  least(3 + v[3], CASE WHEN fault < 2 THEN fault + v[4] + CASE r WHEN 2 THEN 0 ELSE 2 END ELSE 1000000000 END) AS r2,
  least(3 + v[4], CASE WHEN fault < 2 THEN fault + v[3] + CASE r WHEN 1 THEN 0 ELSE 2 END ELSE 1000000000 END) AS r3 FROM b JOIN f ON f.c = b.c AND f.k = b.k - 1)),
m AS (SELECT f.c, f.k, f.n, f.fault, f.r, f.role, f.text, p.v, q.v AS w FROM f JOIN b p ON p.c = f.c AND p.k = f.k JOIN b q ON q.c = f.c AND q.k = f.k + 1
  UNION ALL SELECT DISTINCT f.c, f.n + 1, f.n, 2, 3, '', '', [0, 4, 2, 0], [1000000000, 1000000000, 1000000000, 1000000000] FROM f),
t AS (SELECT DISTINCT c, 1::BIGINT AS k, 0 AS s, '' AS audit, []::VARCHAR[] AS said FROM f UNION ALL
SELECT c, CASE e WHEN 'I' THEN k ELSE k + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN kept ELSE next END, audit || e,
  CASE e WHEN 'D' THEN said WHEN 'I' THEN list_append(said, fresh || ':') WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, fresh || ':' || text) END
FROM (SELECT *, CASE WHEN 3 + w[s + 1] = v[s + 1] THEN 'D' WHEN 2 + v[next + 1] = v[s + 1] THEN 'I' WHEN fault < 2 AND kept IS NOT NULL AND fault + w[kept + 1] = v[s + 1] THEN 'K' ELSE 'R' END AS e
FROM (SELECT t.c, t.k, s, audit, said, n, fault, role, text, v, w, CASE s WHEN 2 THEN 3 ELSE 2 END AS next, CASE s WHEN 2 THEN 'assistant' ELSE 'user' END AS fresh,
  CASE WHEN r = 0 AND s = 0 THEN 1 WHEN r = 1 AND s <> 2 THEN 2 WHEN r = 2 AND s = 2 THEN 3 END AS kept FROM t JOIN m ON m.c = t.c AND m.k = t.k WHERE t.k <= n OR s IN (1, 2)))),
o AS (SELECT t.c, audit, said FROM t JOIN (SELECT DISTINCT c, n FROM f) USING (c) WHERE k = n + 1 AND s IN (0, 3)),
g AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.v[1], 0)::BIGINT AS cost, coalesce(o.audit, '') AS audit, sha256(coalesce(array_to_string(o.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '-') AS c FROM conversations) i LEFT JOIN g ON g.c = i.c LEFT JOIN b ON b.c = i.c AND b.k = 1 LEFT JOIN o ON o.c = i.c""",
}
QUERIES = {"op11_repair": op11_repair}
