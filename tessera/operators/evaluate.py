"""Retrieval and answer quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, topk

DIMENSIONS = ["faithfulness", "relevance", "completeness", "clarity"]


def hit_at(results: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query_id, hit_at_k...) of results (query_id, doc_id, rank from 1); 1 if a relevant one is among the first k. Queries without relevant ids are left out."""
    best = _joined(results, qrels).groupBy("query_id").agg(F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("_best"))
    return best.select("query_id", *(F.coalesce((F.col("_best") <= k).cast("int"), F.lit(0)).cast("long").alias(f"hit_at_{k}") for k in ks))


def _joined(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Relevant ids with their ranks, null where not retrieved."""
    return qrels.join(results.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")


def reciprocal_rank(results: DataFrame, qrels: DataFrame, mode: str = "listed", k: int = 10) -> DataFrame:
    """(query_id, mrr). "listed": of the relevant ids in list order (column `position`) the first that was retrieved; "standard": the best ranked."""
    own = _joined(results.filter(F.col("rank") <= k), qrels).filter("rel > 0")
    rank = F.min_by("rank", "position") if mode == "listed" else F.min("rank")
    found = own.filter("rank IS NOT NULL").groupBy("query_id").agg((1.0 / rank).alias("mrr"))
    return own.select("query_id").distinct().join(found, "query_id", "left").withColumn("mrr", F.coalesce("mrr", F.lit(0.0)))


def ndcg(results: DataFrame, qrels: DataFrame, k: int = 10, mode: str = "retrieved") -> DataFrame:
    """(query_id, ndcg) with gain 2**rel - 1 and log2(rank + 1); the ideal sorts the retrieved list, or with "standard" all judgements."""
    gain = lambda rank: (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(rank + 1)
    got = results.filter(F.col("rank") <= k).select("query_id", "doc_id", "rank").join(qrels.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    pool = got if mode == "retrieved" else qrels
    ideal = topk(pool.select("query_id", "doc_id", "rel"), "query_id", [F.col("rel").desc(), F.col("doc_id")], k, "_r").groupBy("query_id").agg(F.sum(gain(F.col("_r"))).alias("ideal"))
    real = got.groupBy("query_id").agg(F.sum(gain(F.col("rank"))).alias("real"))
    out = qrels.select("query_id").distinct().join(real, "query_id", "left").join(ideal, "query_id", "left")
    return out.select("query_id", F.when(F.col("ideal") > 0, F.coalesce("real", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def per_query(results: DataFrame, qrels: DataFrame, mode: str = "listed") -> DataFrame:
    """(query_id, hit_at_5, hit_at_10, mrr, ndcg)."""
    results, qrels = cut(results.select("query_id", "doc_id", "rank")), cut(qrels)
    return hit_at(results, qrels).join(reciprocal_rank(results, qrels, mode), "query_id").join(ndcg(results, qrels), "query_id")


def breakdown(scored: DataFrame) -> DataFrame:
    """Overall, by category and by difficulty in one pass: (category, difficulty, total, hits, recall, mrr); null names the overall level."""
    n = F.count("*")
    return scored.groupingSets([[], [F.col("category")], [F.col("difficulty")]], F.col("category"), F.col("difficulty")).agg(
        n.alias("total"), F.sum("hit_at_10").alias("hits"), (F.sum("hit_at_10") / n).alias("recall"), F.avg("mrr").alias("mrr")
    )


def compare(scored: DataFrame, base: str, other: str) -> DataFrame:
    """(metric, base, other, delta, change) of rows with a `mode`: means of each metric and the signed change in percent."""
    metrics = ["hit_at_5", "hit_at_10", "mrr", "ndcg"]
    means = scored.groupBy("mode").agg(*(F.avg(m).alias(m) for m in metrics))
    long = means.unpivot("mode", metrics, "metric", "value").groupBy("metric").pivot("mode", [base, other]).agg(F.first("value"))
    delta = F.col(other) - F.col(base)
    text = F.when(F.col(base) > 0, F.format_string("%+.1f%%", 100 * delta / F.col(base))).otherwise("n/a")
    return long.select("metric", F.col(base).alias("base"), F.col(other).alias("other"), delta.alias("delta"), text.alias("change"))


def failed_queries(queries: DataFrame, results: DataFrame, skip: Column | None = None) -> DataFrame:
    """Queries, edge cases (`skip`) left out, without any result."""
    own = queries if skip is None else queries.filter(~skip)
    return own.join(results.select("query_id").distinct(), "query_id", "left_anti")


def generation_metrics(scores: DataFrame, metrics: dict[str, float | None]) -> DataFrame:
    """(metric, mean, n, passed) over score columns; NaN and null are left out, and a metric without a value fails. metrics: name -> least mean, or None."""
    wide = scores.agg(*(x for m in metrics for x in (F.avg(F.when(~F.isnan(m), F.col(m))).alias(f"{m}_mean"), F.count_if(F.col(m).isNotNull() & ~F.isnan(m)).alias(f"{m}_n"))))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_n").alias("n"), F.coalesce(F.col(f"{m}_mean") >= least, F.lit(False)).alias("passed") if least is not None else F.lit(None).cast("boolean").alias("passed")) for m, least in metrics.items()))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def parse_judgement(reply: Column, dimensions: list[str] = DIMENSIONS) -> Column:
    """struct of scores 1..5 from a judge's JSON reply; a missing dimension or a reply that doesn't parse counts 1."""
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), ", ".join(f"{d} int" for d in dimensions))
    return F.struct(*(F.coalesce(parsed[d], F.lit(1)).alias(d) for d in dimensions))


def judged(judgements: DataFrame, dimensions: list[str] = DIMENSIONS, least: float = 3.5) -> DataFrame:
    """(sample_id, dimensions..., average, passed) of (sample_id, reply)."""
    own = judgements.select("sample_id", parse_judgement(F.col("reply"), dimensions).alias("j")).select("sample_id", "j.*")
    mean = sum((F.col(d) for d in dimensions), F.lit(0)) / len(dimensions)
    return own.withColumn("average", mean).withColumn("passed", F.col("average") >= least)


def judge_summary(rows: DataFrame, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    return rows.agg(F.count("*").alias("samples"), *(F.avg(d).alias(f"avg_{d}") for d in dimensions), F.avg("average").alias("avg_score"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))


def worst(rows: DataFrame, n: int = 3) -> DataFrame:
    return rows.orderBy("average", "sample_id").limit(n)


def evaluate(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("queries"), *(F.avg(m).alias(m) for m in ("hit_at_5", "hit_at_10", "mrr", "ndcg")))

