"""Multi-index hashing: probes find every code within a radius; recall on a full block of 16,384 rows; repeated ids."""

import numpy as np
import pytest

from queryscope.llm import ann

N, D, K = 16_384, 64, 20


def directions(rng):
    u = rng.standard_normal((N, D))
    return u / np.linalg.norm(u, axis=1, keepdims=True)


def clustered(rng):
    return directions(rng)[rng.integers(0, 160, N)] + rng.standard_normal((N, D)) * 0.05


def copies(rng):
    u = directions(rng)
    u[: N // 3] = u[0]
    return u


#: name: vectors, and the largest part of the rows that probes may admit on average.
SETS = {
    "unit": (directions, 1.0),
    "varied lengths": (lambda rng: directions(rng) * np.exp(rng.normal(0, 0.5, (N, 1))), 0.6),
    "clusters": (clustered, 0.3),
    "clusters of varied lengths": (lambda rng: clustered(rng) * np.exp(rng.normal(0, 0.5, (N, 1))), 0.3),
    "far from the origin": (lambda rng: directions(rng) + 2 * directions(rng)[0], 1.0),
    "a third equal": (copies, 1.0),
}


@pytest.mark.parametrize("name", SETS)
def test_recall_of_a_block(name):
    make, share = SETS[name]
    rng = np.random.default_rng(0)
    x, ids = make(rng), np.arange(N)
    block = ann.Block(ids, x, *ann.learn(x))
    asked = rng.choice(N, 60, replace=False)
    found = 0
    for q in asked:
        got, scores = block.search(q, x[q], K, 1.0)
        s = (x * x[q]).sum(axis=1)
        assert q not in got and np.allclose(scores, s[got]) and list(got) == list(got[np.lexsort((got, -scores))])
        s[q] = -np.inf
        worst = np.sort(s)[-K]
        found += (scores >= worst - 1e-12).sum()
    recall, probed = found / K / len(asked), block.probed / N / len(asked)
    print(f"{name}: recall {recall:.3f}, probed {probed:.3f}")
    assert recall >= 0.95 and probed <= share + 1e-9


@pytest.mark.parametrize("bits", [48, 100, 128])
def test_probes_find_every_code_within_a_radius(bits):
    rng = np.random.default_rng(bits)
    codes = rng.random((700, bits)) > 0.5
    codes[:50] = codes[0] ^ (rng.random((50, bits)) > 0.9)
    shell = ann.Shell(np.arange(700), np.zeros((700, 2)), np.ones(700), codes)
    probe = ann.Probe(shell, ann.Codes(codes[:1], shell.width))
    for radius in (0, 1, 5, 6, 17, 18, 40, bits):
        want = np.flatnonzero((codes ^ codes[0]).sum(axis=1) <= radius)
        assert sorted(probe.within(radius)) == list(want)


def test_repeated_ids_and_dimensions(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (40, [1.0]), (41, [2.0]), (60, [1.0, 1.0, 1.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(0, 1): (3, 1.0), (0, 2): (20, 0.0), (20, 1): (3, 2.0), (20, 2): (0, 0.0), (40, 1): (41, 2.0)}


def test_many_blocks_and_chunks(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = 0
    for r in ann.search(df, block_rows=200, query_rows=10).groupBy("query_id").agg({"vec_id": "collect_set"}).collect():
        s = x @ x[r[0]]
        s[r[0]] = -np.inf
        assert len(r[1]) == 20
        hits += len(set(np.argsort(-s)[:20].tolist()) & set(r[1]))
    assert hits >= 0.95 * 20 * 45
