"""Text cleaning as column expressions. Each function takes a string column and gives one; nulls stay null."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: characters and patterns of the cleaning steps
ZERO_WIDTH = "​‌‍﻿­"
QUOTES = {"‘": "'", "’": "'", "‹": "'", "›": "'", "“": '"', "”": '"', "«": '"', "»": '"', "„": '"', "‟": '"'}
DASHES = "–—―‐‑⁃"
URL = r"(?i)https?://(?:[-\w.]|(?:%[\da-f]{2}))+[^\s]*"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
#: White space of all kinds, also what `\s` leaves out.
WHITE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WHITE = r"[\s\x1c-\x1f\x85\xa0  -     　]"


def normalize_unicode(c: Column, form: str = "NFKC") -> Column:
    """No built-in does this; rows of ASCII alone skip the Python step's work."""

    # rows one by one: Arrow would hold thousands of whole texts at once, in several copies
    @F.udf("string", useArrow=False)
    def run(s: str | None) -> str | None:
        return None if s is None else unicodedata.normalize(form, s)

    # a Python step gets every row, so rows of ASCII alone go as nulls
    return F.coalesce(run(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{C}&&[^\n\t\r]]", "")


def strip_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def normalize_quotes(c: Column) -> Column:
    """Curly and angle quotes to ASCII ones."""
    return F.translate(c, "".join(QUOTES), "".join(QUOTES.values()))


def normalize_dashes(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def remove_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, " ")


def remove_phones(c: Column) -> Column:
    return F.regexp_replace(c, PHONE, " ")


def normalize_whitespace(c: Column) -> Column:
    one = F.when(c.contains("  ") | c.contains("\t"), F.regexp_replace(c, r"[ \t]+", " ")).otherwise(c)
    return F.when(one.contains(" \n") | one.contains("\n "), F.regexp_replace(one, r" *\n *", "\n")).otherwise(one)


def collapse_newlines(c: Column, most: int = 2) -> Column:
    """Three or more newlines become `most`."""
    return F.when(c.contains("\n\n\n"), F.regexp_replace(c, r"\n{3,}", "\n" * most)).otherwise(c)


def remove_patterns(c: Column, patterns: list[str]) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_CHARS))


def clean(
    c: Column,
    unicode_form: str | None = "NFKC",
    urls: bool = False,
    emails: bool = False,
    phones: bool = False,
    max_newlines: int = 2,
    patterns: list[str] = (),
) -> Column:
    """The full cleaning chain, in its fixed order; blank text becomes ''."""
    out = normalize_unicode(c, unicode_form) if unicode_form else c
    # the four steps change control characters and a part of what isn't ASCII; quotes, dashes and zero-width characters are one pass
    dirty = out.rlike(r"[^\x20-\x7E\n\t\r]")
    chars = "".join(QUOTES) + DASHES + ZERO_WIDTH
    out = F.when(dirty, F.translate(strip_control(out), chars, "".join(QUOTES.values()) + "-" * len(DASHES))).otherwise(out)
    for wanted, step in ((urls, remove_urls), (emails, remove_emails), (phones, remove_phones)):
        out = step(out) if wanted else out
    out = collapse_newlines(normalize_whitespace(out), max_newlines)
    return strip(remove_patterns(out, list(patterns)))


def clean_for_embedding(c: Column, unicode_form: str | None = "NFKC") -> Column:
    out = normalize_unicode(c, unicode_form) if unicode_form else c
    return strip(normalize_whitespace(strip_zero_width(out)))


def found_urls(c: Column) -> Column:
    """Array of the URLs of a text, null if there is none."""
    found = F.regexp_extract_all(c, F.lit(URL), F.lit(0))
    return F.when(F.size(found) > 0, found)


def found_emails(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0))
    return F.when(F.size(found) > 0, found)


def drop_headers_footers(c: Column, header: str | None = None, footer: str | None = None, max_lines: int = 3, enabled: bool = True) -> Column:
    """Lines whose start matches a pattern go, in texts of more than 2 * max_lines lines."""
    given = [p for p in (header, footer) if p]
    if not enabled or not given:
        return c
    lines = F.split(c, "\n")
    kept = F.filter(lines, lambda x: ~x.rlike("|".join(f"^(?:{p})" for p in given)))
    return F.when(F.size(lines) > 2 * max_lines, F.array_join(kept, "\n")).otherwise(c)


def html_text(c: Column) -> Column:
    """The visible text of a page: script and style bodies go, tags part lines, lines are trimmed and blank ones dropped."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)\s*>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]*>", "\n")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    lines = F.transform(F.split(out, r"\r\n|\r|\n"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def token_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def estimated_tokens(c: Column) -> Column:
    """Four characters a token."""
    return F.floor(F.length(c) / 4)
