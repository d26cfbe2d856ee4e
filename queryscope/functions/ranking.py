"""Measures of rankings, queries and result items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed word lists: fragments of commercial and informational urls (a word listed twice counts twice).
URL_COMMERCIAL = ("shop", "catalog", "cat/", "katalog/", "card", "product", "category", "stock")
URL_INFORMATIONAL = ("news", "info", "blog", "forum", "article", "help", "wiki", "topic", "story", "post", "news", "otvet.mail.ru")
#: Fixed patterns: markers in lower-cased texts, Russian with English ones beside them.
_COMMERCIAL = "[к]?купить|прода(?:ть|жа|м|ем)|товар(?:а|ы|ов)?|руб[. ]|розниц(?:а|у|ой)|опт(?:ом)?|приобр(?:ести|рети|ай)|заказ(?:а|ы|ать|жи)|доставк(?:а|у|ой)|магазин(?:а|е)|цен(?:а|ы|е)|акци(?:я|е|и|q)|каталог|клиент|buy|price|order|shop|sale"
_INFORMATIONAL = "wiki.*|youtube|обзор|вики.*|новост(?:ь|и|ью|ей)|что такое|где|фото|видео|как|блог|в картинках|своими руками|схема|ремонт|какой|зачем|почему|how|why|what|where|review"
TEXT_COMMERCIAL = rf"(?:^|\s|[.])(?:{_COMMERCIAL})(?:$|\s|[.])"
TEXT_INFORMATIONAL = rf"(?:^|\s|[.])(?:{_INFORMATIONAL})(?:$|\s|[.])"
#: Fixed coefficients of the click-through curve.
CTR_SLOPE, CTR_SHIFT = 34.16200393, 0.83594252


def url_markers(url: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(url)
    total = F.contains(low, F.lit(words[0])).cast("int")
    for w in words[1:]:
        total = total + F.contains(low, F.lit(w)).cast("int")
    return total


def text_markers(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.lower(text), F.lit(pattern))


def commercial(url: Column, title: Column, snippet: Column) -> Column:
    return url_markers(url, URL_COMMERCIAL) + text_markers(title, TEXT_COMMERCIAL) + text_markers(snippet, TEXT_COMMERCIAL)


def informational(url: Column, title: Column, snippet: Column) -> Column:
    return url_markers(url, URL_INFORMATIONAL) + text_markers(title, TEXT_INFORMATIONAL) + text_markers(snippet, TEXT_INFORMATIONAL)


def ctr(position: Column) -> Column:
    return F.lit(CTR_SLOPE) / position - F.lit(CTR_SHIFT)


def split_duration(p: Column, delta: Column, k: Column, visitors: Column, share: Column) -> Column:
    """Days that a split test needs: visitors for the effect by visitors a day, both rounded half to even."""
    need = F.bround(F.lit(16.0) * p * (F.lit(1.0) - p) / (p * delta * p * delta) * k, 0)
    return F.bround(need / (visitors * share), 0).cast("long")


def common_items(a: Column, b: Column) -> Column:
    """Items of ``b`` that are in ``a``, repeats counted."""
    return F.size(F.filter(b, lambda x: F.array_contains(a, x)))


def rating_dist(first: DataFrame, second: DataFrame, method: str = "ctr", depth: int = 10) -> DataFrame:
    """(query_id, dist) of two rankings (query_id, pos, item) of each query, from 0 (equal) to 1 (nothing in common).

    An item that one ranking lacks stands at depth + 1 there. ``ctr`` weighs places by their inverse, ``classic`` evenly.
    """
    if method not in ("ctr", "classic"):
        raise ValueError(f"unknown method {method}")
    a, b = first.select("query_id", "item", F.col("pos").alias("p1")), second.select("query_id", "item", F.col("pos").alias("p2"))
    n1, n2 = F.coalesce("p1", F.lit(depth + 1)), F.coalesce("p2", F.lit(depth + 1))
    if method == "ctr":
        top = 2 * (sum(1 / k for k in range(1, depth + 1)) - depth / (depth + 1))
        gap = F.abs(F.lit(1.0) / n1 - F.lit(1.0) / n2)
    else:
        top, gap = float(depth * (depth + 1)), F.abs(n1 - n2)
    return a.join(b, ["query_id", "item"], "full").groupBy("query_id").agg(F.round(F.sum(gap) / F.lit(top), 6).alias("dist"))


def competitiveness(ranking: DataFrame, strict: DataFrame, depth: int = 10) -> DataFrame:
    return rating_dist(ranking, strict, "ctr", depth).select("query_id", F.round(1 - F.col("dist"), 6).alias("competitiveness"))


def complexity(compete: DataFrame, places: DataFrame) -> DataFrame:
    """Competitiveness times log2(place + 1) of one's own site; a site that is not ranked (place 0) counts as place 200."""
    place = F.when(F.col("pos") == 0, 200).otherwise(F.col("pos"))
    return compete.join(places, "query_id").select("query_id", F.round(F.col("competitiveness") * F.log2(place + 1), 6).alias("complexity"))
