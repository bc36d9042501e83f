"""Chunking: document tables to chunk tables, by column expressions and one explode."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# fixed values: separators, from the coarsest
RECURSIVE = ["\n\n", "\n", ". ", ", ", " "]
SENTENCE = ["\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " "]


def chunk_id(document_id: Column, start: Column, content: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.md5(F.concat_ws(":", document_id, start, F.substring(content, 1, 100))), 1, 12))


def finish(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(document_id, chunks array<struct<content, start_char>>) -> one row a chunk, blank chunks dropped before they are numbered."""
    solid = F.filter("chunks", lambda x: T.strip(x["content"]) != "")
    out = df.withColumn("_solid", solid).select("document_id", *keep, F.size("_solid").cast("long").alias("total_chunks"), F.posexplode_outer("_solid").alias("chunk_index", "c"))
    # an inner explode would have its input worked out once more, in a filter below it
    out = out.filter("c IS NOT NULL")
    content, start = F.col("c.content"), F.col("c.start_char").cast("long")
    return out.select(
        chunk_id(F.col("document_id").cast("string"), start, content).alias("chunk_id"), "document_id", *keep, content.alias("content"), start.alias("start_char"),
        (start + F.length(content)).alias("end_char"), F.col("chunk_index").cast("long").alias("chunk_index"), "total_chunks", T.token_count(content).alias("token_count"),
    )


def _pieces(c: Column) -> Column:
    """Words with the white space after them; joined they are the (trimmed) text."""
    return F.regexp_extract_all(c, F.lit(r"\S+\s*"), F.lit(0))


def fixed(df: DataFrame, text: str = "text", size: int = 512, overlap: int = 50, pieces: Callable[[Column], Column] | None = None, keep: list[str] = ()) -> DataFrame:
    """Windows of `size` tokens, `size - overlap` apart; the last one ends with the text. `pieces` splits a text into tokens that join to it, words by default. `keep`: columns that go along.

    Words are matched in blocks of one stride, and a window is a block and the head of the next one, so a text is gone through once whatever its length.
    """
    step = size - overlap
    if pieces is not None or overlap > step:
        return _sliced(df, text, size, overlap, pieces or _pieces, keep)
    own = df.withColumn("_b", F.regexp_extract_all(F.col(text), F.lit(rf"(?:\S++\s*+){{1,{step}}}+"), F.lit(0)))
    count = (F.size("_b") - 1) * step + F.size(F.regexp_extract_all(F.element_at("_b", -1), F.lit(r"\S+"), F.lit(0)))
    own = own.withColumn("_k", F.when(F.size("_b") > 0, 1 + F.ceil(F.greatest(count - size, F.lit(0)) / step)).otherwise(0).cast("int"))
    head = lambda i: F.coalesce(F.regexp_extract(F.get("_b", i + 1), rf"^(?:\S++\s*+){{0,{overlap}}}+", 0), F.lit(""))
    # where each block starts: lengths are summed up in turn
    starts = F.aggregate("_b", F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + F.length(b))))
    own = own.withColumn("_at", starts)
    cut = F.transform(F.slice("_b", F.lit(1), F.col("_k")), lambda b, i: F.struct(
        F.regexp_replace(F.concat(b, head(i)), r"\s+$", "").alias("content"),
        F.get("_at", i).alias("start_char"),
    ))
    return finish(own.withColumn("chunks", cut), keep)


def _sliced(df: DataFrame, text: str, size: int, overlap: int, pieces: Callable[[Column], Column], keep: list[str] = ()) -> DataFrame:
    step = size - overlap
    own = df.withColumn("_p", pieces(F.col(text))).withColumn("_n", F.size("_p"))
    count = F.ceil(F.greatest(F.col("_n") - size, F.lit(0)) / step).cast("int")
    # the steps' texts, so that a start is a sum of few lengths
    strides = F.transform(F.sequence(F.lit(0), count), lambda i: F.length(F.array_join(F.slice("_p", i * step + 1, F.lit(step)), "")))
    own = own.withColumn("_at", F.when(F.col("_n") > 0, F.aggregate(strides, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))))
    cut = F.transform(F.sequence(F.lit(0), count), lambda i: F.struct(
        F.regexp_replace(F.array_join(F.slice("_p", i * step + 1, F.lit(size)), ""), r"\s+$", "").alias("content"),
        F.get("_at", i).alias("start_char"),
    ))
    return finish(own.withColumn("chunks", F.when(F.col("_n") > 0, cut).otherwise(F.array())), keep)


def semantic(df: DataFrame, text: str = "text", size: int = 512, overlap: int = 50, model_max_tokens: int = 256, pieces: Callable[[Column], Column] | None = None) -> DataFrame:
    """Windows in the embedding model's own tokens, at most as many as it takes."""
    return fixed(df, text, min(size, model_max_tokens), overlap, pieces)


def _split_after(separator: str, size: int) -> Callable[[Column], Column]:
    after = "(?<=" + separator.replace(".", r"\.").replace("?", r"\?") + ")"
    return lambda p: F.when(T.token_count(p) <= size, F.array(p)).otherwise(F.split(p, after))


def packed(counts: Sequence[int], lengths: Sequence[int], size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first piece, piece after the last, characters before) of each chunk of pieces with these token counts and lengths: as many as `size` tokens hold, one at least,
    each chunk starting with the last pieces of the one before up to `overlap` tokens. Ends are found in the running sums, so a text takes time by its pieces and chunks."""
    n, upto, chars = len(counts), np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(lengths)])
    out, i, j = [], 0, 0
    while j < n:
        j = max(j, int(np.searchsorted(upto, upto[i] + size, side="right")) - 1)
        if j >= n:
            break
        if j > i:
            out.append((i, j, int(chars[i])))
        room = min(overlap, size - counts[j])
        i = max(i, int(np.searchsorted(upto, upto[j] - room, side="left"))) if room >= 0 else j
        j += 1
    return out + [(i, n, int(chars[i]))] * (n > i)


def by_separators(df: DataFrame, separators: list[str] = RECURSIVE, text: str = "text", size: int = 512, overlap: int = 50, size_multiplier: int = 1) -> DataFrame:
    """Split by the coarsest separator that gives pieces of at most `size` tokens, then pack pieces up to it, starting each chunk with the last pieces
    of the one before, up to `overlap` tokens. Pieces' counts alone reach Python."""
    size, overlap = size * size_multiplier, overlap * size_multiplier

    @F.pandas_udf("array<struct<a: int, b: int, at: int>>")
    def spans(counts: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else packed(c, n, size, overlap) for c, n in zip(counts, lengths, strict=True)])

    own = df.withColumn("_p", F.array(F.col(text)))
    for sep in separators:
        own = own.withColumn("_p", F.flatten(F.transform("_p", _split_after(sep, size))))
    own = own.withColumn("_p", F.filter("_p", lambda p: p != ""))
    own = own.withColumn("_s", spans(F.transform("_p", lambda p: T.token_count(p).cast("int")), F.transform("_p", F.length)))
    cut = F.transform("_s", lambda x: F.struct(F.regexp_replace(F.array_join(F.slice("_p", x["a"] + 1, x["b"] - x["a"]), ""), r"\s+$", "").alias("content"), x["at"].alias("start_char")))
    return finish(own.withColumn("chunks", cut))


def sentence(df: DataFrame, **options) -> DataFrame:
    return by_separators(df, SENTENCE, **options)


def pages(df: DataFrame, text: str = "text", separator: str = "\f", cleaned: Callable[[Column], Column] = T.clean) -> DataFrame:
    """One chunk a page, with its number from 1; pages are split first and cleaned then."""
    own = df.select("document_id", F.posexplode(F.split(F.col(text), separator)).alias("_k", "_page"))
    own = own.withColumn("content", cleaned(F.col("_page"))).filter("content <> ''")
    return own.select("document_id", "content", (F.col("_k") + 1).cast("long").alias("page_number"), T.token_count(F.col("content")).alias("token_count"))


def whole(df: DataFrame, text: str = "text") -> DataFrame:
    """The document as its one chunk."""
    return finish(df.withColumn("chunks", F.array(F.struct(F.col(text).alias("content"), F.lit(0).alias("start_char")))))
