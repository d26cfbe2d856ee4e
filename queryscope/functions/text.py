"""Column expressions for cleaning, tokens and lemmas."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern: words and single punctuation marks; both take a position.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: Fixed pattern: what cleaning turns to spaces.
NOISE = r"[^\p{L}\p{N}_\s]+|[\p{Nd}]+|•"
#: Default stop words (parameter of every operator that uses them).
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "it", "that", "for", "with", "this", "was", "on", "are", "as", "be", "by", "an", "a", "or", "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "pour", "pas", "der", "die", "das", "und", "ein", "eine", "ist", "nicht", "mit", "sich", "el", "los", "las", "por", "con", "del", "se", "su", "para")
ENDING = "(ing|ed|es|s)$"


def clean(text: Column) -> Column:
    """Punctuation, digits and bullets to spaces, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, NOISE, " ")))


def strict_query(text: Column) -> Column:
    """Every word marked as exact: '!a !b'."""
    return F.concat(F.lit("!"), F.array_join(F.split(F.trim(text), r"\s+"), " !"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def lemma(token: Column) -> Column:
    """Fallback lemma: lower case without one common ending (``ENDING``); a token that is all ending stays.

    Told by plain suffixes, longest first, which is several times as fast as the pattern.
    """
    low = F.lower(token)
    size = F.length(low)
    cut = F.when(low.endswith("ing"), size - 3).when(low.endswith("ed") | low.endswith("es"), size - 2).when(low.endswith("s"), size - 1).otherwise(size)
    return F.when(cut > 0, F.substring(low, F.lit(1), cut)).otherwise(low)


def squeeze(text: Column) -> Column:
    """Blank lines to one line break, runs of blanks to one, ends stripped."""
    lines = F.regexp_replace(text, r"\s*\n\s*", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"[ \t]{2,}", " "), r"^\s+|\s+$", "")


def norm_title(text: Column) -> Column:
    """White space collapsed; dashes, quotes and hard spaces to their plain forms."""
    spaced = F.regexp_replace(F.regexp_replace(text, "&mdash;|&ndash;", "-"), "&quot;", '"')
    return F.trim(F.regexp_replace(F.translate(spaced, "—– «»", '-- ""'), r"\s+", " "))


def gz_rate(text: Column) -> Column:
    """Bytes of a text by bytes of its deflated form (pandas, as Spark has no deflate)."""
    @F.pandas_udf("double")
    def rate(s: pd.Series) -> pd.Series:
        raw = s.fillna("").str.encode("utf8")
        return raw.map(lambda b: len(b) / len(zlib.compress(b)))

    return rate(text)
