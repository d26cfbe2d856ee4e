"""Sources and sinks, plans and column functions that have no SQL twin."""

import zlib
from urllib.parse import quote as plain_quote

import numpy as np
from pyspark.sql import functions as F

from queryscope.functions import text, urls
from queryscope.operators import cluster, terms
from queryscope.plans import pipelines
from queryscope.sources import database, encoding, fixtures, store
from queryscope.sources.shared import ranked

SF = "/root/testdata/sf0.001"


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").select("k", f(F.col("v")).alias("x")).collect()
    return [x for _, x in sorted((r["k"], r["x"]) for r in rows)]


def test_urls(spark):
    given = ["http://a.ru/окна и двери?q=1&b=~x*(y)+z", "https://www.a.ru/%41", "a b", "", None]
    want = [None if u is None else u[: len(s)] + plain_quote(u[len(s) :]) for u in given for s in [("http://" if u and u.startswith("http://") else "https://" if u and u.startswith("https://") else "")]]
    assert column(spark, given, urls.quote) == want
    assert column(spark, given[1:], urls.cut_prefix) == ["a.ru/%41", "a b", "", None]
    back = ["http://a.ru/" + plain_quote("окна"), "http://a.ru/" + plain_quote("окна".encode("cp1251")), "a+b%20c", None]
    assert column(spark, back, urls.unquote) == ["http://a.ru/окна", "http://a.ru/окна", "a+b c", None]


def test_encoding(spark):
    page = "<html><meta charset='{}'>Окна</html>"
    given = [page.format("windows-1251").encode("cp1251"), page.format("koi8-r").encode("koi8-r"), page.format("utf-8").encode(), page.format("nonsense").encode(), "Окна".encode("cp1251"), b'<?xml version="1.0" encoding="ISO-8859-1"?>\xe9', b"", None]
    got = column(spark, given, encoding.decoded, "binary")
    assert [x and x[-11:-7] for x in got[:3]] == ["Окна"] * 3 and "Окна" in got[3] and got[4] == "Окна" and got[5].endswith("é") and got[6:] == ["", None]
    assert encoding.charset_of(b"<meta charset=gb2312>") == "gb18030"


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(k, f"q{k}") for k in range(20)], "id int, word string")
    database.write_table(df, url, "queries")
    database.write_table(df.where("id < 3"), url, "queries")
    whole, parts = database.read_table(spark, url, "queries"), database.read_table(spark, url, "queries", '"id"', 4)
    rows = sorted(tuple(r) for r in whole.collect())
    assert len(rows) == 23 and rows == sorted(tuple(r) for r in parts.collect()) and parts.rdd.getNumPartitions() == 4


def test_graph_and_matrix(spark, tmp_path):
    v, e = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, weight double")
    database.save_graph(v, e, f"{tmp_path}/g")
    assert [sorted(map(tuple, x.collect())) for x in database.load_graph(spark, f"{tmp_path}/g")] == [[(1,), (2,)], [(1, 2, 0.5)]]
    cells = database.dense_matrix(spark.createDataFrame([(0, "1.5 0 2"), (1, " 0 x 3e1")], "i long, value string"))
    database.save_matrix(cells, f"{tmp_path}/m")
    assert sorted(map(tuple, database.load_matrix(spark, f"{tmp_path}/m").collect())) == [(0, 0, 1.5), (0, 2, 2.0), (1, 2, 30.0)]


XML = """<yandexsearch><response><results><grouping>
<group><doc><url>http://www.a.ru/x</url><title>One</title><passages><passage>p</passage><passage>q</passage></passages></doc></group>
<group><doc><url>http://shop.b.ru/y</url><title>Two</title></doc></group><group><doc><url>http://a.ru/z</url><title>Three</title></doc></group>
</grouping></results></response></yandexsearch>"""


def test_xml_answers(spark):
    rows = fixtures.ranking_xml(spark.createDataFrame([(7, XML), (8, "<x></x>"), (9, None)], "query_id long, payload string"))
    assert sorted(map(tuple, rows.collect())) == [(7, 1, "http://www.a.ru/x", "One", "p q"), (7, 2, "http://shop.b.ru/y", "Two", ""), (7, 3, "http://a.ru/z", "Three", "")]
    assert sorted(map(tuple, fixtures.corresponding_page(rows, "a.ru").collect())) == [(7, 1, "http://www.a.ru/x")]
    assert sorted(map(tuple, fixtures.corresponding_page(rows, "b.ru").collect())) == [(7, 2, "http://shop.b.ru/y")]
    assert fixtures.corresponding_page(rows, "c.ru").count() == 0


def test_query_list_from_a_file(spark, tmp_path):
    (tmp_path / "q.txt").write_text("Купить окна!\nкупить  ОКНА\n\n123\nдвери • 5\n", encoding="utf-8")
    got = {r["query"] for r in fixtures.query_list(spark.read.text(str(tmp_path / "q.txt"))).collect()}
    assert got == {"купить окна", "купить  окна", "двери"}


def test_write_through(spark):
    urls_ = spark.createDataFrame([(1, "u1", "old", 10)], "url_id long, url string, title string, domain_id long")
    domains = spark.createDataFrame([(10, "d1")], "id long, domain string")
    new = spark.createDataFrame([(5, 1, "u1", "d1", "new"), (5, 2, "u2", "d2", "first"), (6, 1, "u2", "d2", "second"), (6, 2, "u3", None, None)], "query_id long, pos int, url string, domain string, title string")
    items, all_urls, all_domains = store.write_through(new, urls_, domains)
    named = {r["url"]: (r["url_id"], r["title"], r["domain_id"]) for r in all_urls.collect()}
    ids = {r["domain"]: r["id"] for r in all_domains.collect()}
    assert set(ids) == {"d1", "d2"} and ids["d1"] == 10
    assert named["u1"] == (1, "old", 10) and named["u2"][1:] == ("first", ids["d2"]) and named["u3"][1:] == (None, None)
    assert sorted(map(tuple, items.collect())) == sorted([(5, 1, 1), (5, named["u2"][0], 2), (6, named["u2"][0], 1), (6, named["u3"][0], 2)])


def test_report_file(spark, tmp_path):
    queries = spark.createDataFrame([(k, f"q{k}") for k in range(4)], "query_id long, query string")
    cl = spark.createDataFrame([(0, 2), (1, 1), (2, 1), (3, 2)], "obj_id long, cluster int")
    site = spark.createDataFrame([(1, 3, "/b"), (2, 1, "/a")], "query_id long, pos int, page string")
    store.write_report(store.cluster_report(queries, [cl, cl], site).coalesce(1), str(tmp_path / "r"))
    lines = [x for f in sorted((tmp_path / "r").glob("*.csv")) for x in f.read_text().splitlines()]
    assert lines == ["query_id;query;cl_0;cl_1;position;page", "2;q2;1;1;1;/a", "1;q1;1;1;3;/b", '0;q0;2;2;0;""', '3;q3;2;2;0;""']


def test_ranked(spark):
    df = spark.createDataFrame([(k, k * 7919 % 101) for k in range(300)], "id long, x long").repartition(7)
    rows = sorted(ranked(df, F.desc("x"), F.asc("id")).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, 301))
    assert [(r["x"], r["id"]) for r in rows] == sorted(((r["x"], r["id"]) for r in rows), key=lambda p: (-p[0], p[1]))
    assert ranked(df.limit(0), F.asc("id")).count() == 0


def test_gz_rate(spark):
    given = ["abc " * 100, "Окна", "", None]
    want = [len(b) / len(zlib.compress(b)) for b in ((x or "").encode() for x in given)]
    assert np.allclose(column(spark, given, text.gz_rate), want)


def test_index_is_kept(spark, tmp_path):
    zones = spark.createDataFrame([(1, "body", "Windows and doors, windows"), (1, "title", "Doors"), (2, "body", None)], "doc_id long, zone string, text string")
    terms.Index.build(zones, path=str(tmp_path / "i"))
    index = terms.Index.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, index.entries("window").select("doc_id", "zone", "pos").collect())) == [(1, "body", 1), (1, "body", 5)]
    assert sorted(map(tuple, index.document_frequency().collect())) == [("door", 1, 2), ("window", 1, 2)]
    assert sorted(map(tuple, index.lengths().collect())) == [(1, "body", 3), (1, "title", 1)]


def test_model_from_a_frequency_list(spark):
    lines = spark.createDataFrame([("10\tWindows",), ("5\twindow",), ("x\tbad",), ("no tab",), (None,), ("3\tdoor",)], "value string")
    counts = terms.frequency_list(lines)
    assert sorted(map(tuple, counts.collect())) == [("door", 3), ("window", 15)]
    p = {r["term"]: r["p"] for r in terms.language_model(counts).collect()}
    assert np.allclose([p["door"], p["window"]], [3.5 / 19, 15.5 / 19])
    freq = spark.createDataFrame([("door", 9), ("window", 9), ("unknown", 9)], "term string, tf long")
    assert [r["term"] for r in terms.weird(freq, terms.language_model(counts)).collect()] == ["door", "window"]


def test_text_report(spark):
    zones = fixtures.body_zones(spark.read.parquet(f"{SF}/documents.parquet"))
    found = pipelines.text_report(zones)
    assert {k: bool(df.take(1)) for k, df in found.items()} == dict.fromkeys(("colors", "top", "collocations", "weird"), True)
    assert found["top"].count() == 20


def test_diagnose(spark):
    pages = spark.createDataFrame([(k, "http://a.ru/x", "<p>same words here</p>" + ("<a>Прайс</a>" if k == 9 else "")) for k in range(10)], "page_id long, url string, html string")
    peers = pages.select("page_id", F.lit("g").alias("grp"))
    zones = spark.createDataFrame([(k, "body", "window door" if k else "door") for k in range(10)], "doc_id long, zone string, text string")
    features, words = pipelines.diagnose(pages, peers, zones)
    assert ("price_list", 1.0) in {(r["feature"], r["value"]) for r in features.where("page_id = 9").collect()}
    assert sorted(map(tuple, words.collect())) == [(0, "window")]


def test_repeated_hosts(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "a"), (3, 1, "c"), (3, 2, "c")]
    ranking = spark.createDataFrame(rows, "query_id long, pos int, host string")
    assert sorted(map(tuple, cluster.repeated_pairs(cluster.vectors(ranking, "host"), 2).collect())) == [(1, 2, 2, 0.0)]


def test_collocations_in_wider_windows(spark):
    zones = spark.createDataFrame([(1, "body", "alpha beta gamma alpha zeta gamma alpha beta"), (2, "body", "alpha delta gamma")], "doc_id long, zone string, text string")
    got = {(r["a"], r["b"]): r["n"] for r in terms.collocations(zones, window=3).collect()}
    assert got == {("alpha", "beta"): 2, ("alpha", "gamma"): 3, ("gamma", "alpha"): 2}
