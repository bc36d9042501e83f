"""Site-relative line dedup: a line that stands on too large a share of its host's pages is boilerplate and goes.

DataFrame functions only. Lines shuffle as two 64-bit hashes after they are made distinct by page and counted map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents

RATIO = 0.05
MIN_PAGES = 5
BROADCAST_MARKS = 200_000
#: A host with over 1 / HOT_SHARE of all pages is dealt over SALTS tasks.
HOT_SHARE = 1000
SALTS = 64


def _mark(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, marks): of each host the hashes of its lines that stand on `min_pages` pages or more and on over `ratio` of them.

    A page counts once for a line, however often the line is repeated on it. Lines without a letter or digit don't count. A host has fewer
    than (mean lines of a page / ratio) such lines, so `marks` stays small whatever the number of pages.
    """
    site = F.coalesce(F.col(host).cast("string"), F.lit(""))
    own = pages.select(site.alias("host"), F.array_distinct(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))).alias("lines"))
    totals = own.groupBy("host").agg(F.count("*").alias("total"))
    found = own.select("host", F.explode("lines").alias("line")).select("host", _mark(F.col("line")).alias("mark"))
    found = found.groupBy("host", "mark").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    found = found.join(totals, "host").filter(F.col("n") > ratio * F.col("total"))
    return found.groupBy("host").agg(F.collect_list("mark").alias("marks"))


def _with_marks(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """`pages` joined to `marks` by shuffle on _site. Fewer than HOT_SHARE hosts can be hot; their marks are repeated for each salt."""
    sizes = pages.groupBy("_site").agg(F.count("*").alias("_n"))
    total = pages.agg(F.count("*").alias("_total"))
    hot = sizes.join(F.broadcast(total), F.col("_n") * HOT_SHARE > F.col("_total")).select("_site", F.lit(SALTS).alias("_salts"))
    hot = F.broadcast(cut(hot))
    # the number of the scan's partition, so that a task that is run again deals its rows alike
    dealt = pages.withColumn("_part", F.spark_partition_id()).join(hot, "_site", "left")
    dealt = dealt.withColumn("_salt", F.col("_part") % F.coalesce("_salts", F.lit(1))).drop("_part", "_salts")
    spread = marks.join(hot, "_site", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return dealt.join(spread.drop("_salts"), ["_site", "_salt"], "left").drop("_salt")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`pages` with the boilerplate lines cut from `text`; adds n_lines and n_removed. Other columns and the order of lines stay.

    Null hosts form one site; a null text stays null and has no lines.
    """
    site = F.coalesce(F.col(host).cast("string"), F.lit(""))
    marks = cut(boilerplate(pages, host, text, ratio, min_pages).select(F.col("host").alias("_site"), F.col("marks").alias("_marks")))
    n, hosts = marks.agg(F.coalesce(F.sum(F.size("_marks")), F.lit(0)), F.count("*")).first()
    own = pages.withColumn("_site", site)
    # with few marks no text is shuffled
    out = own.join(F.broadcast(marks), "_site", "left") if n + hosts <= BROADCAST_MARKS else _with_marks(own, marks)
    out = out.withColumn("_lines", F.split(F.col(text), "\n"))
    fine = F.filter("_lines", lambda x: ~F.array_contains(F.col("_marks"), _mark(x)))
    out = out.withColumn("_fine", F.when(F.col("_marks").isNull(), F.col("_lines")).otherwise(fine))
    out = out.withColumn("n_lines", F.coalesce(F.size("_lines"), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", (F.col("n_lines") - F.coalesce(F.size("_fine"), F.lit(0))).cast("long"))
    # a text without such a line stays as it is, byte for byte
    out = out.withColumn(text, F.when(F.col("n_removed") > 0, F.array_join("_fine", "\n")).otherwise(F.col(text)))
    return out.drop("_site", "_marks", "_lines", "_fine")


def op9_linededup(spark, sf_dir):
    """Every document with its site's boilerplate lines cut; the host is `source`. Repeated rows count as pages each."""
    return drop_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = {
    "op9_linededup": rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text FROM documents),
t AS (SELECT host, count(*) AS total FROM d GROUP BY host),
l AS (SELECT doc_id, host, k, ls[k] AS line FROM (SELECT doc_id, host, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, host, string_split(text, chr(10)) AS ls FROM d))),
c AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS n FROM l WHERE regexp_matches(line, '[\p{{L}}\p{{N}}]') GROUP BY host, line) JOIN t USING (host)
  WHERE n >= {MIN_PAGES} AND n > {RATIO}::DOUBLE * total),
m AS (SELECT l.*, c.line IS NOT NULL AS bad FROM l LEFT JOIN c ON l.host = c.host AND l.line = c.line)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed, CASE WHEN r > 0 THEN coalesce(fine, '') ELSE text END AS text
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (bad) AS r, string_agg(line, chr(10) ORDER BY k) FILTER (NOT bad) AS fine FROM m GROUP BY doc_id) USING (doc_id)""",
}
QUERIES = {"op9_linededup": op9_linededup}
