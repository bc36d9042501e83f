"""Query expansion: keywords, rule variations, merging of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import topk

# fixed values: stop words, question openings and synonyms
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "to", "of", "in", "for", "on",
    "with", "at", "by", "from", "as", "into", "through", "during",
    "before", "after", "above", "below", "between", "under", "again",
    "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "each", "few", "more", "most", "other", "some", "such",
    "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "just", "i", "me", "my", "we", "our", "you", "your",
    "he", "him", "she", "her", "it", "they", "them", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "and",
    "but", "if", "or", "because", "until", "while", "please", "help",
]
OPENINGS = ["what", "how", "why", "when", "where"]
PREFIXES = ["what is ", "how to ", "why ", "when ", "where "]
SYNONYMS = {
    "how to": "steps to",
    "what is": "define",
    "best": "top",
    "problem": "issue",
    "fix": "solve",
    "create": "make",
}


def keywords(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"\b[a-zA-Z0-9_-]+\b"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 2))


def variations(c: Column, most: int = 4) -> Column:
    """Array of rule variations in order: keywords alone; a question made or taken apart; a synonym for the first phrase that has one."""
    low = F.lower(c)
    alone = F.array_join(keywords(c), " ")
    opened = low.rlike("^(" + "|".join(OPENINGS) + ")")
    rest = F.lit(None).cast("string")
    for p in reversed(PREFIXES):
        rest = F.when(low.startswith(p), F.regexp_replace(F.substr(c, F.lit(len(p) + 1)), r"\?+$", "")).otherwise(rest)
    swapped = F.lit(None).cast("string")
    for phrase, synonym in reversed(SYNONYMS.items()):
        changed = F.replace(low, F.lit(phrase), F.lit(synonym))
        swapped = F.when(low.contains(phrase), F.concat(F.upper(F.substring(changed, 1, 1)), F.lower(F.substr(changed, F.lit(2))))).otherwise(swapped)
    found = F.array(
        F.when((alone != "") & (alone != low), alone),
        F.when(~opened, F.concat(F.lit("What is "), c, F.lit("?"))).otherwise(F.when(rest != "", rest)),
        swapped,
    )
    return F.slice(F.array_compact(found), 1, most)


def all_queries(queries: DataFrame, text: str = "text", external: DataFrame | None = None, most: int = 4) -> DataFrame:
    """(query_id, variation_no, text): the original as number 0, then variations, the first of equals (by lower case and trim) alone.

    `external` (query_id, position, text) holds variations made elsewhere; they come before the rules', and `most` caps both together.
    """
    base = queries.select("query_id", F.lit(-1).alias("_p"), F.col(text).alias("text"))
    rules = queries.select("query_id", F.posexplode(variations(F.col(text), most)).alias("_p", "text")).withColumn("_p", F.col("_p") + 1_000_000)
    made = rules
    if external is not None:
        made = external.select("query_id", F.col("position").cast("int").alias("_p"), "text").unionByName(rules)
    made = topk(made, "query_id", [F.col("_p")], most, "_r").drop("_r")
    first = topk(base.unionByName(made).withColumn("_k", F.lower(F.trim("text"))), ["query_id", "_k"], [F.col("_p")], 1, "_r")
    return topk(first, "query_id", [F.col("_p")], most + 1, "_n").select("query_id", (F.col("_n") - 1).alias("variation_no"), "text")


def merge_candidates(hits: DataFrame, k: int = 100, keep: str = "first") -> DataFrame:
    """One row a chunk over the variations of (query_id, variation_no, chunk_id, combined_score, rank): its first hit, or with keep="max" its best; then the k best."""
    order = [F.col("variation_no"), F.col("rank")] if keep == "first" else [F.round("combined_score", 9).desc(), F.col("variation_no")]
    one = topk(hits, ["query_id", "chunk_id"], order, 1, "_r").drop("_r", "rank")
    return topk(one, "query_id", [F.round("combined_score", 9).desc(), F.col("chunk_id")], k)
