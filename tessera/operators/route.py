"""Routing of classified queries to model tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIER1_MAX, TIER2_MAX, UNCERTAIN, LOW_LATENCY_MS = 0.4, 0.75, 0.6, 500
TARGETS = (0.70, 0.25, 0.05)
STEP = 0.03

# fixed values: tiers, their routes, prices of 1000 tokens, and fallbacks
ROUTES = {"tier_1": "gpt-3.5-turbo", "tier_2": "gpt-4o-mini", "tier_3": "gpt-4"}
PRICES = {"gpt-3.5-turbo": 0.002, "gpt-4o-mini": 0.015, "gpt-4": 0.03}
FALLBACKS = {"gpt-3.5-turbo": "gpt-4o-mini", "gpt-4o-mini": "gpt-3.5-turbo", "gpt-4": "gpt-4o-mini", "local": "gpt-3.5-turbo"}


def _pick(key: Column, table: dict, otherwise=None) -> Column:
    out = F.when(F.lit(False), F.lit(otherwise))
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(F.lit(otherwise))


def tier_of(complexity: Column, tier1_max: Column | float = TIER1_MAX, tier2_max: Column | float = TIER2_MAX) -> Column:
    return F.when(complexity <= tier1_max, "tier_1").when(complexity <= tier2_max, "tier_2").otherwise("tier_3")


def route(classified: DataFrame, tier1_max: Column | float = TIER1_MAX, tier2_max: Column | float = TIER2_MAX) -> DataFrame:
    """Adds tier, route, reason and route_confidence. Columns preferred_tier, preferred_model and max_latency_ms, where there are any, come first."""
    has = set(classified.columns)
    none = F.lit(None).cast("string")
    want_tier = F.col("preferred_tier") if "preferred_tier" in has else none
    want_model = F.col("preferred_model") if "preferred_model" in has else none
    model_tier = _pick(want_model, {v: k for k, v in ROUTES.items()})
    hurry = F.coalesce((F.col("max_latency_ms") > 0) & (F.col("max_latency_ms") < LOW_LATENCY_MS), F.lit(False)) if "max_latency_ms" in has else F.lit(False)
    base = tier_of(F.col("complexity"), tier1_max, tier2_max)
    unsure = F.col("confidence") < UNCERTAIN
    bumped = F.when(base == "tier_1", "tier_2").otherwise("tier_3")
    wanted, kind = F.coalesce(want_tier, model_tier), F.col("category")
    tier = F.when(wanted.isNotNull(), wanted).when(hurry | kind.isin("out_of_scope", "faq"), "tier_1").when(unsure, bumped).otherwise(base)
    plain = _pick(base, {"tier_1": "simple_query", "tier_2": "moderate_query", "tier_3": "complex_query"})
    reason = F.when(wanted.isNotNull(), "user_preference").when(hurry, "latency_requirement").when(kind == "out_of_scope", "out_of_scope").when(kind == "faq", "faq_query").when(unsure, "uncertain").otherwise(plain)
    sure = F.when(wanted.isNotNull(), 0.95).when(hurry | kind.isin("out_of_scope", "faq"), 0.9).when(unsure, 0.7).otherwise(0.85)
    out = classified.withColumns({"tier": tier, "reason": reason, "route_confidence": sure})
    return out.withColumn("route", _pick(F.col("tier"), ROUTES))


def apply_availability(routed: DataFrame, available: DataFrame) -> DataFrame:
    """Moves routes whose tier is down. `available` has one row: tier1, tier2, tier3 (boolean). A first tier that is down goes to the second unasked."""
    own = routed.crossJoin(F.broadcast(available.select("tier1", "tier2", "tier3")))
    t = F.col("tier")
    moved = (
        F.when((t == "tier_1") & ~F.col("tier1"), "tier_2")
        .when((t == "tier_2") & ~F.col("tier2") & F.col("tier1"), "tier_1").when((t == "tier_2") & ~F.col("tier2") & F.col("tier3"), "tier_3")
        .when((t == "tier_3") & ~F.col("tier3") & F.col("tier2"), "tier_2").when((t == "tier_3") & ~F.col("tier3") & F.col("tier1"), "tier_1")
    )
    own = own.withColumn("_moved", moved).withColumn("is_fallback", F.col("_moved").isNotNull()).withColumn("tier", F.coalesce("_moved", "tier"))
    own = own.withColumn("route", _pick(F.col("tier"), ROUTES)).withColumn("fallback_route", _pick(F.col("route"), FALLBACKS, "gpt-3.5-turbo"))
    return own.drop("_moved", "tier1", "tier2", "tier3")


def cost(text: Column, route: Column) -> Column:
    words = F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))
    return (words * F.lit(1.3) + 500) / 1000 * _pick(route, PRICES, PRICES["gpt-3.5-turbo"])


def stats(routed: DataFrame, cost_column: str = "cost") -> DataFrame:
    """One row: queries and share by tier, fallbacks, cost, and what all-third-tier routing would have cost more."""
    n = F.count("*")
    out = routed.agg(
        n.alias("total_queries"), *(F.count_if(F.col("tier") == f"tier_{i}").alias(f"tier{i}_queries") for i in (1, 2, 3)), F.count_if("is_fallback").alias("fallbacks"),
        F.coalesce(F.sum(cost_column), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum(F.col(cost_column) / _pick(F.col("route"), PRICES, PRICES["gpt-3.5-turbo"]) * PRICES["gpt-4"]), F.lit(0.0)).alias("all_tier3_cost"),
    )
    some = F.greatest("total_queries", F.lit(1))
    out = out.withColumns({f"tier{i}_ratio": F.col(f"tier{i}_queries") / some for i in (1, 2, 3)})
    return out.withColumn("savings", F.col("all_tier3_cost") - F.col("total_cost")).withColumns({f"tier{i}_gap": F.col(f"tier{i}_ratio") - TARGETS[i - 1] for i in (1, 2, 3)})


def adaptive(classified: DataFrame, order: list[str], every: int = 100, start: tuple[float, float] = (TIER1_MAX, TIER2_MAX)) -> DataFrame:
    """Routes with cuts that move after every `every` queries, by the shares of the tiers so far: adds block, tier1_max, tier2_max and the routing columns.

    Blocks are summed up to histograms of (complexity, tier that is fixed whatever the cuts); one fold over the ordered histograms gives each block's cuts.
    Queries are numbered by ordered buckets, so that no task sorts them all.
    """
    own = numbered(classified, order).withColumn("block", F.floor(F.col("_n") / every))
    fixed = F.when(F.col("category").isin("out_of_scope", "faq"), 1).otherwise(0)
    cells = own.groupBy("block", F.col("complexity").alias("c"), fixed.alias("fixed"), (F.col("confidence") < UNCERTAIN).alias("bump")).agg(F.count("*").alias("n"))
    blocks = cells.groupBy("block").agg(F.collect_list(F.struct("c", "fixed", "bump", "n")).alias("h"))
    folded = f"""
    aggregate(array_sort(collect_list(struct(block, h))),
      named_struct('t1', {start[0]}D, 't2', {start[1]}D, 'n1', 0L, 'n3', 0L, 'n', 0L, 'out', cast(array() AS array<struct<block: bigint, t1: double, t2: double>>)),
      (s, b) -> transform(array(named_struct(
          'n1', s.n1 + aggregate(b.h, 0L, (a, x) -> a + IF(x.fixed = 1 OR (x.c <= s.t1 AND NOT x.bump), x.n, 0L)),
          'n3', s.n3 + aggregate(b.h, 0L, (a, x) -> a + IF(x.fixed = 0 AND (x.c > s.t2 OR (x.bump AND x.c > s.t1)), x.n, 0L)),
          'm', aggregate(b.h, 0L, (a, x) -> a + x.n))),
        k -> transform(array(CASE
            WHEN k.m < {every} THEN s.t1
            WHEN k.n1 / (s.n + k.m) < {TARGETS[0]} - 0.05 THEN least(0.6D, s.t1 + {STEP}D)
            WHEN k.n1 / (s.n + k.m) > {TARGETS[0]} + 0.05 THEN greatest(0.2D, s.t1 - {STEP}D) ELSE s.t1 END),
          t -> named_struct('t1', t,
            't2', CASE WHEN k.m < {every} THEN s.t2
              WHEN k.n3 / (s.n + k.m) > {TARGETS[2]} + 0.02 THEN least(0.9D, s.t2 + {STEP}D)
              WHEN k.n3 / (s.n + k.m) < {TARGETS[2]} - 0.02 THEN greatest(t + 0.1D, s.t2 - {STEP}D) ELSE s.t2 END,
            'n1', k.n1, 'n3', k.n3, 'n', s.n + k.m,
            'out', concat(s.out, array(named_struct('block', b.block, 't1', s.t1, 't2', s.t2)))))[0])[0],
      s -> s.out)"""
    cuts = blocks.agg(F.expr(folded).alias("o")).select(F.explode("o").alias("o")).select("o.block", F.col("o.t1").alias("tier1_max"), F.col("o.t2").alias("tier2_max"))
    return route(own.drop("_n").join(cuts, "block"), F.col("tier1_max"), F.col("tier2_max"))


def numbered(df: DataFrame, order: list[str], buckets: int = 64) -> DataFrame:
    """Adds _n, the place of each row from 0 in the order of `order`, whose first column is a number."""
    low, high = df.agg(F.min(order[0]).cast("double"), F.max(order[0]).cast("double")).first()
    width = ((high or 0) - (low or 0)) / buckets or 1.0
    own = df.withColumn("_b", F.floor((F.col(order[0]) - F.lit(low or 0)) / F.lit(width)))
    counts = own.groupBy("_b").agg(F.count("*").alias("_c"))
    before = counts.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before"))  # one row a bucket
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return own.withColumn("_r", place).join(F.broadcast(before), "_b").withColumn("_n", F.col("_before") + F.col("_r")).drop("_b", "_r", "_before")
