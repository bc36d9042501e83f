"""Context budgets and prompts over ranked chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHARS_PER_TOKEN, MAX_CHUNKS = 4, 10

# fixed values: prompt templates
SYSTEM_PROMPT = "You are a helpful assistant. Answer based on the provided context. If unsure, say so."
TEMPLATES = {
    "rag": "Context:\n$context\n\nQuestion: $query\n\nAnswer based on the context above. Be concise.",
    "rag_history": "Context:\n$context\n\nPrevious conversation:\n$history\n\nQuestion: $query\n\nAnswer based on context. Be concise.",
    "no_context": "No relevant information found for: $query\n\nExplain that you don't have information on this topic.",
    "out_of_scope": 'The question "$query" is outside the knowledge base scope.\n\nPolitely explain this is out of scope.',
    "clarification": "The question \"$query\" is ambiguous.\n\nAsk for clarification about: the specific aspect you're asking about",
}


def budget(query_type: Column, override: Column | None = None) -> Column:
    """Tokens of context by type: simple 800, complex 4000, else 2000."""
    own = F.when(query_type == "simple", 800).when(query_type == "complex", 4000).otherwise(2000)
    return F.coalesce(override, own) if override is not None else own


def query_type(category: Column) -> Column:
    return F.when(category.isin("simple", "faq"), "simple").otherwise("complex")


def build(chunks: DataFrame, limit: Column, content: str = "content", max_chunks: int = MAX_CHUNKS, chars_per_token: int = CHARS_PER_TOKEN) -> DataFrame:
    """(query_id, rank from 1, content) -> the first chunks in order that fit; the one that overflows is cut with '...' if over 100 characters remain, and ends the context."""
    own = chunks.filter(F.col("rank") <= max_chunks).withColumn("_max", limit * chars_per_token)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_to", F.sum(F.length(content)).over(w))
    # sums only rise, so the first that overflows is the only one whose predecessors fit
    over = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_over", F.coalesce(F.max(F.col("_to") > F.col("_max")).over(over), F.lit(False))).filter("NOT _over")
    left = F.col("_max") - (F.col("_to") - F.length(content))
    fits = F.col("_to") <= F.col("_max")
    own = own.withColumn("text", F.when(fits, F.col(content)).when(left > 100, F.concat(F.substr(F.col(content), F.lit(1), left), F.lit("..."))))
    return own.filter("text IS NOT NULL").drop("_max", "_to", "_over")


def sources(context: DataFrame, score: str = "score") -> DataFrame:
    return context.select("query_id", (F.col("rank") - 1).alias("index"), "document_id", "chunk_id", F.col(score).alias("score"))


def joined(context: DataFrame, separator: str = "\n\n---\n\n", numbered: bool = False, text: str = "text") -> DataFrame:
    """(query_id, context)."""
    rows = F.array_sort(F.collect_list(F.struct("rank", text)))
    if numbered:
        parts = F.transform(rows, lambda r, i: F.concat(F.lit("["), i + 1, F.lit("] "), r[text]))
        return context.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("context"))
    return context.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r[text]), separator).alias("context"))


def answer_sources(hits: DataFrame, content: str = "content", most: int = 5, chars: int = 200) -> DataFrame:
    preview = F.when(F.length(content) > chars, F.concat(F.substring(content, 1, chars), F.lit("..."))).otherwise(F.col(content))
    return hits.filter(F.col("rank") <= most).withColumn("preview", preview).drop(content)


def fill(template: str, **slots: Column) -> Column:
    """`$name` slots of a template replaced by columns."""
    parts, rest = [], template
    while rest:
        at = min(((rest.find(f"${k}"), k) for k in slots if f"${k}" in rest), default=None)
        if at is None:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[: at[0]])] * bool(at[0]) + [slots[at[1]]]
        rest = rest[at[0] + len(at[1]) + 1 :]
    return F.concat(*parts)


def prompt(query: Column, context: Column, history: Column, kind: Column, max_context_tokens: int = 2000, templates: dict[str, str] | None = None) -> Column:
    """The user prompt: by kind out_of_scope or clarification, else by whether there are context and history. More templates are picked by their name as kind."""
    own = TEMPLATES | (templates or {})
    most = max_context_tokens * 4
    cut = F.when(F.length(context) > most, F.concat(F.substring(context, 1, most), F.lit("..."))).otherwise(context)
    out = reduce(lambda c, k: c.when(kind == k, fill(own[k], query=query, context=cut, history=history)), (k for k in own if k not in ("rag", "rag_history", "no_context")), F.when(F.lit(False), ""))
    return (
        out.when(F.coalesce(context, F.lit("")) == "", fill(own["no_context"], query=query))
        .when(F.coalesce(history, F.lit("")) != "", fill(own["rag_history"], query=query, context=cut, history=history))
        .otherwise(fill(own["rag"], query=query, context=cut))
    )


def rendered_history(messages: DataFrame, last: int = 3, chars: int = 200) -> DataFrame:
    """(conversation_id, history): the last messages as `role: text` lines, long ones cut."""
    w = Window.partitionBy("conversation_id").orderBy(F.col("turn").desc())
    own = messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    body = F.when(F.length("content") > chars, F.concat(F.substring("content", 1, chars), F.lit("..."))).otherwise(F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), body).alias("line"))))
    return own.groupBy("conversation_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("history"))


def prompt_sizes(prompts: DataFrame, prompt_column: str = "prompt", full: str = "full_chars") -> DataFrame:
    """Tokens at four characters each, and the share saved against the untrimmed context."""
    tokens = F.floor(F.length(prompt_column) / 4)
    before = F.floor(F.col(full) / 4)
    return prompts.withColumn("prompt_tokens", tokens).withColumn("reduction", F.when(before > 0, 1 - tokens / before).otherwise(0.0))
