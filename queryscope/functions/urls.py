"""Column expressions for urls."""

from __future__ import annotations

from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed order of the character sets that percent-encoded text is read in.
CHARSETS = ("utf-8", "cp1251", "koi8-r")
SCHEME = "^(https?://)?"


def cut_prefix(url: Column) -> Column:
    """The url without its scheme and a leading www."""
    return F.regexp_replace(url, r"^(http://)?(https://)?(www\.)?", "")


def quote(url: Column) -> Column:
    """The url with everything but its scheme, slashes and unreserved characters percent-encoded as UTF-8, in the JVM."""
    scheme = F.regexp_extract(url, SCHEME, 1)
    rest = F.url_encode(F.regexp_replace(url, SCHEME, ""))
    for encoded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        rest = F.replace(rest, F.lit(encoded), F.lit(plain))
    return F.concat(scheme, rest)


def unquote(url: Column) -> Column:
    """Percent-encoded text decoded in the first of ``CHARSETS`` that fits (the last fits everything)."""

    @F.pandas_udf("string")
    def decode(urls: pd.Series) -> pd.Series:
        return urls.map(_decoded, na_action="ignore")

    return decode(url)


def _decoded(url: str) -> str:
    raw = unquote_to_bytes(url)
    for charset in CHARSETS:
        try:
            return raw.decode(charset)
        except UnicodeDecodeError:
            continue
    return raw.decode(CHARSETS[-1], "replace")
