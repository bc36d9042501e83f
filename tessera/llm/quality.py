"""Line-first cleaning: every line passes punctuation, navigation and boilerplate rules or goes; a document that loses too much goes too.

DataFrame functions only. Each text is handled within its row: no line or word is exploded, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# fixed values: phrases of boilerplate lines
BOILERPLATE = [
    "all rights reserved", "click here", "cookie policy", "copyright", "enable javascript", "licensed under", "log in", "lorem ipsum",
    "privacy policy", "read more", "share this", "sign in", "sign up", "subscribe", "terms of service", "terms of use", "use cookies",
]


def words(text: Column) -> Column:
    """The words of a text: runs without ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def line_fault(line: Column) -> Column:
    """The rule that a line breaks, or null.

    symbols: over one symbol of `#*$%&<>` in five words, from three symbols on. navigation: three or more `|` or `»` parts and over one separator in
    six words. shouting: over one `!` or `?` in three words, from three on. boilerplate: a phrase of BOILERPLATE in at most 40 words.
    stub: fewer than three words without a sentence's end.
    """
    n = F.size(F.split(F.trim(line), SPACE))
    count = lambda chars: F.length(line) - F.length(F.translate(line, chars, ""))
    return (
        F.when((count("#*$%&<>") >= 3) & (count("#*$%&<>") * 5 > n), "symbols")
        .when((count("|»") >= 2) & (count("|»") * 6 > n), "navigation")
        .when((count("!?") >= 3) & (count("!?") * 3 > n), "shouting")
        .when((n <= 40) & F.lower(line).rlike("|".join(BOILERPLATE)), "boilerplate")
        .when((n < 3) & ~line.rlike(r"[.!?:;…]['\")\]»”’]*[\x20\x09-\x0D]*$"), "stub")
    )


def clean_lines(df: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """Adds clean_text (the lines that pass, in order), lost_lines, and `kept`: the removed lines hold at most `max_lost` of the text's characters
    outside white space. Lines without a word stay and count for nothing. A null text gives a null clean_text and is kept."""
    solid = lambda c: F.length(F.regexp_replace(c, SPACE, ""))
    parts = df.withColumn("_lines", F.split(F.col(text), "\n"))
    parts = parts.withColumn("_fine", F.filter("_lines", lambda x: (F.trim(x) == "") | line_fault(x).isNull()))
    parts = parts.withColumn("clean_text", F.array_join("_fine", "\n"))
    lost = solid(F.col(text)) - solid(F.col("clean_text"))
    return (
        parts.withColumn("lost_lines", F.coalesce(F.size("_lines") - F.size("_fine"), F.lit(0)))
        .withColumn("kept", F.coalesce(lost <= max_lost * solid(F.col(text)), F.lit(True)))
        .drop("_lines", "_fine")
    )


def repeated_words(df: DataFrame, words_column: str, out: str) -> DataFrame:
    """Adds how many words stand in 3-word windows that occur twice or more in the row's array of words.

    Windows are compared by 64-bit hash. The hashes are sorted with their places; neighbours that agree are the repeated windows, and the
    sum of min(3, gap) over their places in order is the number of words they cover. Rows without a repeated window skip all this.
    """
    w, n = F.col(words_column), F.size(words_column)
    df = df.withColumn("_g", F.when(n >= 4, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))))
    df = df.withColumn("_m", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.size("_g")))
    numbered = F.zip_with("_g", F.sequence(F.lit(1), F.col("_m")), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_t", F.when(F.col("_m").isNotNull(), F.sort_array(numbered)))
    df = df.withColumn("_e", F.zip_with(F.slice("_t", 1, F.col("_m") - 1), F.slice("_t", 2, F.col("_m") - 1), lambda a, b: a["h"] == b["h"]))
    no = F.array(F.lit(False))
    both = F.zip_with(F.concat(no, "_e"), F.concat(F.col("_e"), no), lambda a, b: a | b)
    df = df.withColumn("_p", F.sort_array(F.array_compact(F.zip_with("_t", both, lambda t, f: F.when(f, t["i"])))))
    gaps = F.zip_with(F.slice("_p", 1, F.size("_p") - 1), F.slice("_p", 2, F.size("_p") - 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("_p") > 0, F.aggregate(gaps, F.lit(3), lambda s, x: s + x))
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_g", "_m", "_t", "_e", "_p")


def op3_quality(spark, sf_dir):
    """Base counts and the verdict of line-first cleaning for every document.

    Null and empty texts have no words, so base_failed is true; repeated rows are judged each.
    """
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = clean_lines(docs.withColumn("_w", words(F.col("text")))).withColumnRenamed("kept", "_fine")
    docs = repeated_words(docs, "_w", "n_repeat_words")
    worded = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumn("_l", worded).withColumn("n_words", F.size("_w").cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.select(
        "doc_id", "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("_fine")).alias("kept"), F.col("lost_lines").cast("long").alias("lost_lines"),
    )


_FAULTY = rf"""
    trim(l, ' ') <> '' AND (
      (ns >= 3 AND ns * 5 > n) OR (nb >= 2 AND nb * 6 > n) OR (nx >= 3 AND nx * 3 > n)
      OR (n <= 40 AND regexp_matches(lower(l), '{"|".join(BOILERPLATE)}'))
      OR (n < 3 AND NOT regexp_matches(l, '[.!?:;…][''")\]»”’]*[\x20\x09-\x0D]*$')))"""
ORACLE = {
    "op3_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, k, ls[k] AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM w)),
m AS (SELECT *, len(string_split_regex(trim(l, ' '), '[\x20\x09-\x0D]+')) AS n, length(l) - length(regexp_replace(l, '[#*$%&<>]', '', 'g')) AS ns,
  length(l) - length(regexp_replace(l, '[|»]', '', 'g')) AS nb, length(l) - length(regexp_replace(l, '[!?]', '', 'g')) AS nx,
  length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS solid FROM l),
f AS (SELECT doc_id, sum(solid) AS total, sum(CASE WHEN {_FAULTY} THEN solid ELSE 0 END) AS lost, sum(CASE WHEN {_FAULTY} THEN 1 ELSE 0 END) AS lost_lines FROM m GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(rw.n, 0)::BIGINT AS n_repeat_words, lost, total, lost_lines
  FROM w LEFT JOIN rw USING (doc_id) LEFT JOIN f USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 * total) AS kept, lost_lines::BIGINT AS lost_lines
FROM b""",
}
QUERIES = {"op3_quality": op3_quality}
