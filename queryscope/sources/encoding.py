"""Decoding of raw pages by the character set that they declare."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of declarations, and names that stand for a larger set.
DECLARED = (rb"""(?i)<meta.*?charset=["']*(.+?)["'>]""", rb"""(?i)<meta.*?content=["']*;?charset=(.+?)["'>]""", rb"""^<\?xml.*?encoding=["']*(.+?)["'>]""")
ALIASES = {"big5": "big5hkscs", "gb2312": "gb18030", "ascii": "utf-8", "maccyrillic": "cp1251"}
#: Fixed order of what is tried without a declaration that fits; the last fits everything.
FALLBACK = ("utf-8", "cp1251", "latin-1")


def charset_of(page: bytes) -> str:
    """The first declared character set that decodes the page, else the first of ``FALLBACK`` that does."""
    declared = [m.decode("ascii", "ignore").strip().lower() for p in DECLARED for m in re.findall(p, page)]
    for name in (*(ALIASES.get(x, x) for x in declared), *FALLBACK):
        try:
            codecs.lookup(name)
            page.decode(name)
        except (LookupError, UnicodeDecodeError, ValueError):
            continue
        return name
    return FALLBACK[-1]


def decoded(page: Column) -> Column:
    """The text of a page given as bytes; null stays null."""

    @F.pandas_udf("string")
    def decode(pages: pd.Series) -> pd.Series:
        return pages.map(lambda b: bytes(b).decode(charset_of(bytes(b))), na_action="ignore")

    return decode(page)
