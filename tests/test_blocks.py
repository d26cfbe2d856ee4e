"""Rankings compared in blocks: the same rows as plain loops, and no shuffle of pairs."""

from itertools import combinations

import numpy as np
import pytest

from queryscope.operators import blocks, cluster

N, DEPTH = 90, 10


@pytest.fixture(scope="module")
def rankings():
    rng = np.random.default_rng(11)
    out = {3 * q + 1: rng.choice(np.arange(q % 3 * 9, q % 3 * 9 + 24), rng.integers(1, DEPTH + 1), replace=False).tolist() for q in range(N - 8)}
    return out | {1000 + k: [500 + 20 * k + x for x in range(10)] for k in range(4)} | {2000 + k: out[4] for k in range(4)}


@pytest.fixture(scope="module")
def serp(spark, rankings):
    return spark.createDataFrame([(q, k + 1, i) for q, items in rankings.items() for k, i in enumerate(items)] + [(None, 1, 3)], "query_id long, pos int, item int").persist()


@pytest.fixture(params=["product", "meetings", "one block", "join"])
def way(request, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", {"one block": 256}.get(request.param, 16))
    monkeypatch.setattr(blocks, "CELLS", 200)
    if request.param == "meetings":
        monkeypatch.setattr(blocks, "PRODUCT", 0)
    if request.param == "join":
        plain = blocks.Rankings.__init__
        monkeypatch.setattr(blocks.Rankings, "__init__", lambda self, *a, **k: (plain(self, *a, **k), setattr(self, "crowded", False))[0])
    return request.param


def common(rankings):
    return {(a, b): len(set(rankings[a]) & set(rankings[b])) for a, b in combinations(sorted(rankings), 2)}


@pytest.mark.parametrize("least", [1, 4])
def test_pairs(serp, rankings, way, least):
    df = cluster.pairs(serp, DEPTH, least)
    got = {(r["i"], r["j"]): (r["common"], r["dist"]) for r in df.collect()}
    assert got == {p: (c, round(1 - c / DEPTH, 6)) for p, c in common(rankings).items() if c >= least}
    if way != "join":
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_repeated_pairs(spark, rankings, way):
    rows = [(q, k + 1, f"host{i % 7}") for q, items in rankings.items() for k, i in enumerate(items)]
    got = {(r["i"], r["j"]): r["common"] for r in cluster.repeated_pairs(spark.createDataFrame(rows, "query_id long, pos int, item string"), DEPTH).collect()}
    host = {q: [i % 7 for i in items] for q, items in rankings.items()}
    want = {(a, b): sum(x in host[a] for x in host[b]) for a, b in combinations(sorted(rankings), 2)}
    assert got == {p: c for p, c in want.items() if c}


@pytest.fixture(scope="module")
def objects(spark, rankings):
    return spark.createDataFrame([(q,) for q in rankings], "obj_id long")


def labels(rankings, least):
    label = {q: q for q in rankings}
    for (a, b), c in common(rankings).items():
        if c >= least and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {q: new if x == old else x for q, x in label.items()}
    return label


def found(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.mark.parametrize("least", [2, 5])
def test_components(serp, objects, rankings, way, least):
    assert found(cluster.shortest_open_path(objects, cluster.Rankings(serp), 1 - least / DEPTH)) == labels(rankings, least)


def test_clusters_by_rankings(spark, serp, rankings, way):
    label = labels(rankings, 5)
    clusters = spark.createDataFrame(list(label.items()), "obj_id long, cluster long")
    held, near, inner = cluster.Rankings(serp), {}, dict.fromkeys(rankings, 0)
    for (a, b), c in common(rankings).items():
        x, y = sorted((label[a], label[b]))
        if x == y:
            inner[a], inner[b] = inner[a] + c, inner[b] + c
        elif c:
            near[x, y] = min(near.get((x, y), 1), round(1 - c / DEPTH, 6))
    assert {(r["a"], r["b"]): r["dist"] for r in cluster.cluster_dist(clusters, held).collect()} == near and near
    middle = {x: min((q for q in rankings if label[q] == x), key=lambda q: (-inner[q], q)) for x in set(label.values())}
    assert found(cluster.medoids(clusters, held)) == middle
    placed = spark.createDataFrame([(q, middle[x]) for q, x in label.items()], "obj_id long, centre long")
    away = sum(1 - common(rankings)[min(q, middle[x]), max(q, middle[x])] / DEPTH for q, x in label.items() if q != middle[x])
    assert abs(cluster.quality(placed, held).first()[0] - away) < 1e-6


def test_pagerank_and_prune_by_rankings(spark, serp, objects, rankings, way):
    """The graph is never formed, ranks and degrees are those of the formed one."""
    v, held = objects.withColumnRenamed("obj_id", "id"), cluster.Rankings(serp)
    edges = spark.createDataFrame([(a, b, c / DEPTH) for (a, b), c in common(rankings).items() if c], "src long, dst long, weight double").persist()
    want, ranks = found(cluster.pagerank(v, edges, 1e-12)), cluster.pagerank(v, held, 1e-12).persist()
    got = found(ranks)
    assert got.keys() == want.keys() and all(abs(got[q] - want[q]) < 1e-11 for q in got)
    with pytest.raises(ArithmeticError):
        cluster.pagerank(v, held, tolerance=0.0, most=3)
    even = ranks.selectExpr("id", "round(pr, 12) as pr").persist()
    gone = found(cluster.prune(v, held, even, 0.9))
    assert gone == found(cluster.prune(v, edges, even, 0.9)) and gone


@pytest.mark.parametrize("radius", [0.6, 0.8])
def test_spheres_by_rankings(spark, serp, objects, rankings, way, radius):
    """FOREL, SKAT and FOREL with paths hold no square matrix and give what the pairs give."""
    p = spark.createDataFrame([(a, b, c, round(1 - c / DEPTH, 6)) for (a, b), c in common(rankings).items() if c], "i long, j long, common long, dist double").persist()
    held = cluster.Rankings(serp)
    start = cluster.forel(objects, p, radius, tries=25).persist()
    assert found(cluster.forel(objects, held, radius, tries=25)) == found(start)
    assert sorted(map(tuple, cluster.skat(objects, held, start, radius).collect())) == sorted(map(tuple, cluster.skat(objects, p, start, radius).collect()))
    assert found(cluster.forel_then_path(objects, held, radius, 0.7)) == found(cluster.forel_then_path(objects, p, radius, 0.7))


@pytest.mark.parametrize("method", sorted(cluster.METHODS))
def test_linkage_by_rankings(spark, serp, objects, rankings, method, monkeypatch):
    """The merges that the pairs give, without a row for each pair in a task."""
    p = spark.createDataFrame([(a, b, c, round(1 - c / DEPTH, 6)) for (a, b), c in common(rankings).items() if c], "i long, j long, common long, dist double").persist()
    want = sorted(map(tuple, cluster.linkage(objects, p, method).collect()))
    monkeypatch.setattr(cluster, "pairs", None)
    got = sorted(map(tuple, cluster.linkage(objects, cluster.Rankings(serp), method).collect()))
    assert [x[:4] + x[5:] for x in got] == [x[:4] + x[5:] for x in want] and want
    assert np.allclose([x[4] for x in got], [x[4] for x in want], atol=2e-6)


def test_agglomeration_takes_one_matrix():
    """At most two matrices of eight bytes an object pair, the caller's own among them; before it took four more."""
    import tracemalloc

    d = np.random.default_rng(3).random((400, 400))
    d = np.triu(d, 1) + np.triu(d, 1).T
    tracemalloc.start()
    cluster.merge_order(d, "average")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * d.nbytes


@pytest.fixture(scope="module")
def copies():
    """40 copies of 40 rankings, 300 of another: (query_id, items) with the copies of a ranking far apart."""
    rng = np.random.default_rng(5)
    kinds = [sorted(rng.choice(24, DEPTH // 2, replace=False).tolist()) for _ in range(41)]
    return [kinds[q % 40] for q in range(1600)] + [kinds[40]] * 300


@pytest.mark.parametrize("kind", ["long", "string"])
def test_copies_take_little_room(spark, copies, kind, monkeypatch, tmp_path):
    """All pairs of equal and other rankings, in files of under four bits a pair (before nine)."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(blocks, "LEAST_BLOCK", 1024)
    name = (lambda q: f"q{q:05}") if kind == "string" else int
    serp = spark.createDataFrame([(name(q), k + 1, i) for q, items in enumerate(copies) for k, i in enumerate(items)], f"query_id {kind}, pos int, item int")
    assert cluster.Rankings(serp).crowded
    cluster.pairs(serp, DEPTH).write.parquet(str(tmp_path / "pairs"))
    held = np.zeros((len(copies), 24), int)
    for q, items in enumerate(copies):
        held[q, items] = 1
    want = np.triu(held @ held.T, 1)
    got = pq.read_table(tmp_path / "pairs").to_pandas()
    at = [got[c].str[1:].astype(int).values if kind == "string" else got[c].values for c in "ij"]
    assert len(got) == np.count_nonzero(want) and (want[*at] == got["common"].values).all() and len(np.unique(at[0] * len(copies) + at[1])) == len(got)
    assert np.allclose(got["dist"], 1 - got["common"] / DEPTH)
    if kind == "long":
        assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) * 8 / len(got) < 4


@pytest.mark.parametrize("size", [1, 3, 70])
def test_runs_of_pairs(size, monkeypatch):
    """Every pair once whatever the lengths of runs and of parts of them."""
    monkeypatch.setattr(blocks, "RUN", 8)
    monkeypatch.setattr(blocks, "CELLS", 40)
    rng = np.random.default_rng(size)
    places = rng.permutation(200)
    xs, ys = np.sort(places[:size]), np.sort(places[size:])
    common = rng.integers(1, 4, len(ys)).astype(np.uint16)
    got = [r for part in blocks._paired(xs, ys, common) for r in zip(*(x.tolist() for x in part))]
    assert sorted(got) == sorted((x, y, c) for x in xs.tolist() for y, c in zip(ys.tolist(), common.tolist()))
    inside = [r for k in range(0, size, 8) for part in blocks._crossed(xs, xs[k : k + 8], later=True) for r in zip(*(x.tolist() for x in part))]
    assert sorted(inside) == [(x, y) for x in xs.tolist() for y in xs.tolist() if x < y]


def test_graph_of_copies_takes_little_room(spark, copies, monkeypatch, tmp_path):
    """The edges of copies, all of them, in files of under four bits an edge."""
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 1024)
    serp = spark.createDataFrame([(q, k + 1, i) for q, items in enumerate(copies) for k, i in enumerate(items)], "query_id long, pos int, item int")
    cluster.similarity_graph(cluster.pairs(serp, DEPTH), DEPTH).write.parquet(str(tmp_path / "graph"))
    sets = [frozenset(x) for x in copies]
    want = sum(len(a & b) / DEPTH for a, b in combinations(sets, 2))
    n, weight, ordered = spark.read.parquet(str(tmp_path / "graph")).selectExpr("count(distinct src, dst)", "sum(weight)", "bool_and(src < dst)").first()
    assert n == sum(not a.isdisjoint(b) for a, b in combinations(sets, 2)) and abs(weight - want) < 1e-3 and ordered
    assert sum(f.stat().st_size for f in (tmp_path / "graph").glob("*.parquet")) * 8 / n < 4


def test_blocks_meet_in_one_exchange(serp):
    """Rows of two blocks are shuffled once to where they meet (before three times, twice for joins)."""
    for df in (blocks.pairs(cluster.Rankings(serp)), blocks.links(cluster.Rankings(serp))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("Scan parquet") == 1


@pytest.mark.parametrize("depth", [7, 10])
def test_weights_come_from_a_table(spark, depth):
    """Weights as rounding gives them, which within the depth are not rounded row by row."""
    pairs = spark.range(1, depth + 4).selectExpr("id as i", "id + 100 as j", "id as common")
    graph = cluster.similarity_graph(pairs, depth)
    assert [r["weight"] for r in graph.orderBy("src").collect()] == [r[0] for r in pairs.selectExpr(f"round(common / {depth}, 6)", "i").orderBy("i").collect()]
    assert "element_at" in graph._jdf.queryExecution().optimizedPlan().toString()
