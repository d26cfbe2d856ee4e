"""Relations that the operators start from, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def serp(events: DataFrame, depth: int = 10, strict: bool = False) -> DataFrame:
    """(query_id, pos, item): items of a query ranked by summed value (strict: by number of events), ties to smaller items."""
    item = F.get_json_object("props", "$.k").cast("int")
    weight = F.count(F.lit(1)) if strict else F.round(F.sum("value"), 6)
    scored = events.groupBy(F.col("user_id").alias("query_id"), item.alias("item")).agg(weight.alias("weight"), F.max("ts").alias("seen"))
    place = Window.partitionBy("query_id").orderBy(F.desc("weight"), "item")
    return scored.withColumn("pos", F.row_number().over(place)).where(F.col("pos") <= depth).select("query_id", "pos", "item")


def host(url: str = "url"):
    """Column: lower-cased host of a url, empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))


def plain_zones(pages: DataFrame) -> DataFrame:
    """(doc_id, zone, text) by patterns alone: title, first h1, and all text outside tags as body."""
    parts = [("body", F.regexp_replace("html", "<[^>]*>", " ")), ("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1)), ("h1", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1))]
    zones = F.array(*[F.struct(F.lit(z).alias("zone"), t.alias("text")) for z, t in parts])
    return pages.select(F.col("page_id").alias("doc_id"), F.explode(zones).alias("z")).select("doc_id", "z.zone", "z.text")


def body_zones(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.lit("body").alias("zone"), "text")


def query_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Cleaned, non-empty, distinct queries of a text relation; ``spark.read.text`` gives one from a file."""
    from queryscope.functions.text import clean

    return lines.select(clean(F.col(column)).alias("query")).where(F.length("query") > 0).distinct()


def ranking_json(payload: DataFrame, column: str = "payload", depth: int | None = None) -> DataFrame:
    """Unpack a ranking service's answers: {status, data: [{position, www, domain, path, title, text}]} to rows with urls.

    With ``depth`` each answer gives the places 1 to ``depth``: later ones are left out, missing ones have empty texts.
    """
    kind = "status int, data array<struct<position:int,www:int,domain:string,path:string,title:string,text:string>>"
    keys = [c for c in payload.columns if c != column]
    rows = payload.select(*keys, F.explode(F.from_json(column, kind)["data"]).alias("d"))
    url = F.concat(F.when(F.col("d.www") == 1, "http://www.").otherwise("http://"), F.col("d.domain"), F.lit("/"), F.col("d.path"))
    rows = rows.select(*keys, F.col("d.position").alias("pos"), url.alias("url"), "d.title", "d.text")
    if depth is None:
        return rows
    places = payload.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("pos"))
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("url", "title", "text")]
    return places.join(rows, [*keys, "pos"], "left").select(*keys, "pos", *texts)


def ranking_xml(payload: DataFrame, column: str = "payload", depth: int = 100) -> DataFrame:
    """Unpack a search service's XML answers (response/results/grouping/group/doc with url, title, passages) to (…, pos, url, title, text)."""
    doc = "struct<url:string,title:string,passages:struct<passage:array<string>>>"
    kind = f"response struct<results:struct<grouping:struct<group:array<struct<doc:{doc}>>>>>"
    keys = [c for c in payload.columns if c != column]
    rows = payload.select(*keys, F.posexplode(F.from_xml(F.col(column), kind)["response"]["results"]["grouping"]["group"]["doc"]).alias("at", "d"))
    text = F.coalesce(F.array_join("d.passages.passage", " "), F.lit(""))
    return rows.where(F.col("at") < depth).select(*keys, (F.col("at") + 1).alias("pos"), "d.url", "d.title", text.alias("text"))


def corresponding_page(ranking: DataFrame, site: str) -> DataFrame:
    """(query_id, pos, url): the best placed page of a site (its host or one below) in each ranking (query_id, pos, url) that has one."""
    own = F.regexp_replace(host("url"), r"^www\.", "")
    found = ranking.where((own == site) | own.endswith(f".{site}"))
    return found.groupBy("query_id").agg(F.min(F.struct("pos", "url")).alias("best")).select("query_id", "best.*")


def projections(ranking: DataFrame, item: str = "item") -> DataFrame:
    """(query_id, items): the items (ids, urls or hosts) of each ranking in order of place."""
    rows = ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col(item).alias("x")))).alias("s"))
    return rows.select("query_id", F.transform("s", lambda r: r["x"]).alias("items"))


def space_basis(ranking: DataFrame, item: str = "item") -> DataFrame:
    """(item): every item that some ranking holds, once."""
    return ranking.select(F.col(item).alias("item")).distinct()


def query_volumes(queries: DataFrame, volumes: DataFrame) -> DataFrame:
    """Monthly demand per query from a (query, data) table; missing or unreadable values are 0."""
    return queries.join(volumes, "query", "left").select("query", F.coalesce(F.expr("try_cast(data as int)"), F.lit(0)).alias("volume"))
