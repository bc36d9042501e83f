"""Conversation memory and user preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL_MESSAGES, SUMMARY_TOKENS, CHARS_PER_TOKEN = 3, 150, 4


def compressed(messages: DataFrame, full: int = FULL_MESSAGES, summary_tokens: int = SUMMARY_TOKENS) -> DataFrame:
    """(conversation_id, position, role, content): the last messages in full after one system row that sums up the older ones, if any."""
    recent, older = _parts(messages, full)
    old = summaries(older, summary_tokens).select("conversation_id", F.lit(0).cast("long").alias("position"), F.lit("system").alias("role"), F.concat(F.lit("Previous conversation summary: "), "summary").alias("content"))
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("turn")).cast("long")
    return old.unionByName(recent.select("conversation_id", place.alias("position"), "role", "content"))


def _parts(messages: DataFrame, full: int) -> tuple[DataFrame, DataFrame]:
    back = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.col("turn").desc()))
    own = messages.withColumn("_back", back)
    return own.filter(F.col("_back") <= full).drop("_back"), own.filter(F.col("_back") > full).drop("_back")


def summaries(older: DataFrame, summary_tokens: int = SUMMARY_TOKENS, chars_per_token: int = CHARS_PER_TOKEN) -> DataFrame:
    """(conversation_id, summary): each message cut to its share of the tokens, as `role: text`, parted by ` | `."""
    rows = older.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("_m"))
    most = F.floor(F.lit(summary_tokens) / F.size("_m")).cast("int") * chars_per_token
    lines = F.transform("_m", lambda m: F.concat(m["role"], F.lit(": "), F.substr(m["content"], F.lit(1), most), F.when(F.length(m["content"]) > most, "...").otherwise("")))
    return rows.select("conversation_id", F.array_join(lines, " | ").alias("summary"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    return _parts(messages, n)[0]


def token_counts(messages: DataFrame, full: int = FULL_MESSAGES) -> DataFrame:
    """(conversation_id, messages, full_tokens, compressed_tokens, reduction)."""
    before = messages.groupBy("conversation_id").agg(F.count("*").alias("messages"), F.sum(F.floor(F.length("content") / 4)).alias("full_tokens"))
    after = compressed(messages, full).groupBy("conversation_id").agg(F.floor(F.sum(F.length("content")) / 4).alias("compressed_tokens"))
    out = before.join(after, "conversation_id")
    return out.withColumn("reduction", F.when(F.col("full_tokens") > 0, 1 - F.col("compressed_tokens") / F.col("full_tokens")).otherwise(0.0))


def append(conversations: DataFrame, messages: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) with new messages (conversation_id, role, content, at) numbered after the old ones; unknown conversations are added."""
    known = conversations.select("conversation_id")
    created = more.select("conversation_id").distinct().join(known, "conversation_id", "left_anti")
    last = messages.groupBy("conversation_id").agg((F.max("turn") + 1).alias("_next"))
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("at", "role")) - 1
    rows = more.withColumn("_i", place).join(last, "conversation_id", "left")
    rows = rows.select("conversation_id", (F.coalesce("_next", F.lit(0)) + F.col("_i")).cast("long").alias("turn"), "role", "content")
    return conversations.unionByName(created, allowMissingColumns=True), messages.unionByName(rows)


def preferences(changes: DataFrame, now: Column, ttl_days: int = 30) -> DataFrame:
    """(user_id, preferences map): the latest value of each key of (user_id, key, value, updated_at, deleted), deletes honoured, of the last `ttl_days`."""
    last = changes.groupBy("user_id", "key").agg(F.max_by(F.struct("value", "deleted", "updated_at"), "updated_at").alias("l"))
    live = last.filter(~F.col("l.deleted") & (F.unix_timestamp(now) - F.unix_timestamp("l.updated_at") < ttl_days * 86400))
    return live.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "l.value")))).alias("preferences"))


def preference(table: DataFrame, key: str, default: str) -> Column:
    return F.coalesce(F.col("preferences")[key], F.lit(default))
