"""Text columns: whitespace, clean-up chains, contact patterns, hashes."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that must match what the surveyed scraper matches. `(?U)` gives
# Java's \d \w \s \b the Unicode meaning they have in Python.
PHONE = r"(?U)\(?\b\d{3}\)?[-.\s]*\d{3}[-.\s]*\d{4}\b"
ADDRESS = r"(?U)\d{1,5}\s(\b\w*\b\s){1,2}\w*\.?"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
URL_IN_TEXT = (
    r"(?:(http[s]?://)?(?:[a-zA-Z0-9.-]+(?:\.[a-zA-Z]{2,4}))"
    r"|(?:www\.[a-zA-Z0-9.-]+(?:\.[a-zA-Z]{2,4})))"
)

# Unicode whitespace as Python's str.isspace has it, spelled out: a class Java matches without
# property lookups. Printable ASCII is ruled out first, which spares most characters the rest.
SPACE = r"[\x00-\x20\x7F-\uFFFF&&[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"
_SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode included."""
    return F.btrim(c, F.lit(_SPACES))


def collapse(c: Column) -> Column:
    """Each whitespace run becomes one space; no whitespace at the ends."""
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def sanitize(c: Column) -> Column:
    """`collapse`, with NULL as the empty string."""
    return collapse(F.coalesce(c, F.lit("")))


def ascii_text(c: Column) -> Column:
    """Text with tags dropped, typographic marks made ASCII and other non-ASCII blanked.

    Expects entities to be decoded already; `clean_text` also does that.
    """
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    c = F.translate(c, "\u201c\u201d\u2013\u2014\u00a0\u2018\u2019", "\"\"-- ''")
    # Runs of whitespace and non-ASCII alike become one space.
    c = F.trim(F.regexp_replace(c, r"[^\x00-\x08\x0E-\x1B\x21-\x7F]+", " "))
    return F.regexp_replace(c, r"\A[-/]\z", "")


@F.pandas_udf(T.StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """HTML entities to characters. Spark has no built-in; Arrow batches, standard library."""
    return texts.map(html.unescape, na_action="ignore")


def clean_text(c: Column) -> Column:
    return ascii_text(decode_entities(c))


def scrape_cleanup(c: Column) -> Column:
    """Three entities decoded, whitespace collapsed but kept at the ends, ASCII only."""
    c = F.replace(c, F.lit("\u00a0"), F.lit(" "))
    for entity, char in (("&amp;", "&"), ("&gt;", ">"), ("&lt;", "<")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(c, rf"{SPACE}+", " ")
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def name_safe(c: Column) -> Column:
    """Everything but ASCII letters and digits becomes an underscore."""
    return F.regexp_replace(c, "[^a-zA-Z0-9]", "_")


def page_title(c: Column) -> Column:
    return F.substring(name_safe(F.coalesce(c, F.lit("no_title"))), 1, 60)


def phones(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PHONE), 0)


def emails(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(EMAIL), 0)


def addresses(c: Column, full: bool = False) -> Column:
    """By default the last repeat of the pattern's group, as a findall gives; `full` for whole matches."""
    return F.regexp_extract_all(c, F.lit(ADDRESS), 0 if full else 1)


def content_hash(c: Column) -> Column:
    return F.md5(c)
