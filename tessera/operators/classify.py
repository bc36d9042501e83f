"""Query classification by rules or by example."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

from . import vectors

SIMPLE_MAX_WORDS, COMPLEX_MIN_WORDS = 10, 25

# fixed values: patterns, matched against the lower-cased query
INTENTS = {
    "definition": [r"^what (?:is|are) ", r"^define ", r"^meaning of ", r"^explain what "],
    "procedural": [r"^how (?:do|can|to|should) ", r"^steps to ", r"^way to ", r"^process (?:for|of|to) ", r"^guide (?:for|to) "],
    "comparative": [r"(?:difference|compare|versus|vs\.?|better)", r"(?:which|what) (?:is|are) (?:better|best)", r"pros and cons"],
    "troubleshooting": [r"(?:error|issue|problem|bug|fail|broken|not working)", r"(?:fix|solve|resolve|debug|troubleshoot)", r"why (?:is|does|doesn't|won't)"],
    "navigational": [r"(?:where|find|locate|link|url|page)", r"(?:documentation|docs|guide) for"],
}
COMPLEX = [
    r"\b(?:and|or|but)\b.*\b(?:and|or|but)\b",
    r"\?.*\?",
    r"(?:first|then|after|before|finally)",
    r"(?:if|when|unless|assuming)",
    r"(?:compare|contrast|analyze|evaluate)",
]
SIMPLE = [r"^(?:what|who|when|where) is ", r"^(?:yes|no|true|false)\?", r"^define "]
FAQ = [
    r"^how (?:do i|can i|to) (?:get started|begin|start)",
    r"^what (?:is|are) (?:the|your) (?:pricing|price|cost)",
    r"^how (?:much|many)",
    r"^(?:do you|can you|is there) (?:support|offer|have)",
    r"^what (?:are|is) (?:the|your) (?:features|capabilities)",
    r"^how (?:do i|can i) (?:contact|reach)",
    r"^(?:forgot|reset|change) (?:my )?password",
]


def lowered(c: Column) -> Column:
    return T.strip(F.lower(c))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))


def intent(low: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, patterns in INTENTS.items():
        out = out.when(low.rlike("|".join(f"(?:{p})" for p in patterns)), name)
    return out.otherwise("factual")


def complexity(low: Column) -> Column:
    """0..1; the terms are added in a fixed order, as their sums are compared with equality at the edges."""
    n = word_count(low)
    out = F.lit(0.5) + F.when(n <= SIMPLE_MAX_WORDS, -0.2).when(n >= COMPLEX_MIN_WORDS, 0.2).otherwise(0.0)
    for p in COMPLEX:
        out = out + F.when(low.rlike(p), 0.15).otherwise(0.0)
    for p in SIMPLE:
        out = out - F.when(low.rlike(p), 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def category(low: Column, complexity: Column, intent: Column, faq: list[str] = FAQ) -> tuple[Column, Column]:
    """(category, confidence)."""
    asked, short = low.rlike("|".join(f"(?:{p})" for p in faq)), word_count(low) <= 2
    kind = F.when(asked, "faq").when(short, "ambiguous").when(complexity < 0.3, "simple").when(complexity > 0.7, "complex").when(intent.isin("comparative", "exploratory"), "complex").otherwise("simple")
    sure = F.when(asked, 0.9).when(short, 0.6).when(complexity < 0.3, 0.9 - complexity).when(complexity > 0.7, complexity)
    return kind, sure.when(intent.isin("definition", "factual", "comparative", "exploratory"), 0.7).otherwise(0.6)


def domain(low: Column, domains: dict[str, list[str]] | None = None, out_of_scope: list[str] = ()) -> Column:
    """struct(is_in_domain, domain_confidence, detected_domain): the first keyword found decides, out-of-scope words before domain words."""
    made = lambda fine, sure, name: F.struct(F.lit(fine).alias("is_in_domain"), F.lit(sure).alias("domain_confidence"), F.lit(name).cast("string").alias("detected_domain"))
    out = F.when(F.lit(False), made(True, 0.6, None))
    for word in out_of_scope:
        out = out.when(low.contains(word.lower()), made(False, 0.8, None))
    for name, words in (domains or {}).items():
        for word in words:
            out = out.when(low.contains(word.lower()), made(True, 0.9, name))
    return out.otherwise(made(True, 0.6, None))


def hints(kind: Column) -> tuple[Column, Column, Column]:
    """(suggested_model, use_cache, needs_clarification)."""
    return F.when(kind == "complex", "gpt-4").otherwise("local"), kind.isin("simple", "faq"), kind == "ambiguous"


def classify(queries: DataFrame, text: str = "text", domains: dict[str, list[str]] | None = None, out_of_scope: list[str] = (), faq: list[str] = FAQ) -> DataFrame:
    """Adds intent, complexity, category, confidence, the domain's columns and hints to each query."""
    own = queries.withColumn("_low", lowered(F.col(text)))
    own = own.withColumns({"intent": intent(F.col("_low")), "complexity": complexity(F.col("_low"))})
    kind, sure = category(F.col("_low"), F.col("complexity"), F.col("intent"), faq)
    own = own.withColumns({"_kind": kind, "_sure": sure, "_domain": domain(F.col("_low"), domains, out_of_scope)})
    outside = ~F.col("_domain.is_in_domain") & (F.col("_domain.domain_confidence") > 0.7)
    own = own.withColumns({"category": F.when(outside, "out_of_scope").otherwise(F.col("_kind")), "confidence": F.when(outside, F.col("_domain.domain_confidence")).otherwise(F.col("_sure"))})
    model, cache, unclear = hints(F.col("category"))
    own = own.select("*", "_domain.*").withColumns({"suggested_model": model, "use_cache": cache, "needs_clarification": unclear})
    return own.drop("_low", "_kind", "_sure", "_domain")


def by_example(queries: DataFrame, examples: DataFrame) -> DataFrame:
    """Category of the nearest example by cosine, its score as confidence; `simple` and 0 if none scores above 0. queries (query_id, embedding), examples (category, embedding)."""
    best = vectors.top_k(queries, examples.select(F.col("category").alias("id"), "embedding"), 1, last_id=True)
    sure = F.round("score", 9)
    own = queries.select("query_id").distinct().join(best.select("query_id", "id", F.when(sure > 0, sure).alias("_s")), "query_id", "left")
    return own.select("query_id", F.when(F.col("_s").isNotNull(), F.col("id")).otherwise("simple").alias("category"), F.coalesce("_s", F.lit(0.0)).alias("confidence"))
