"""SimHash links against brute force for several distances, bucket limits and partition numbers; edge rows."""

from collections import Counter

import numpy as np
import pytest

from queryscope.llm import simhash
from queryscope.llm.components import components

from . import brute


@pytest.mark.parametrize(("tau", "parts", "limit"), [(0, None, 4096), (1, 2, 4096), (2, 3, 3), (3, 4, 4096), (6, None, 4096), (6, 2, 4096), (5, 4, 5)])
def test_links(spark, tau, parts, limit):
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist()) | {0}
    for b in base.tolist():
        for _ in range(8):
            for bit in rng.integers(0, 64, rng.integers(1, 8)):
                b ^= 1 << int(bit)
            fps.add(b)
    a = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    got = {(r["u"], r["v"]) for r in simhash.links(df, tau, parts, limit).collect()}
    s = a.view(np.int64)
    want = {(min(int(s[i]), int(s[j])), max(int(s[i]), int(s[j]))) for i in range(len(a)) for j in range(i + 1, len(a)) if np.bitwise_count(a[i] ^ a[j]) <= tau}
    assert got == want


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(61), 0) | dict.fromkeys(range(100, 140), 100)


def test_edge_rows(spark):
    rows = [(3, None, "a"), (1, "", "b"), (2, "One two THREE", "c"), (7, "one  two\tthree", "d"), (7, "one  two\tthree", "d"), (None, "one two three", "e"), (9, "word " * 60_000, "f"), (8, "x", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).toPandas()
    from collections import Counter

    mine = Counter((None if np.isnan(d) else int(d), f"{int(f) & (2**64 - 1):016x}", int(c)) for d, f, c in got.itertuples(index=False))
    assert mine == brute.simhash([(d, t) for d, t, _ in rows])
    kept = simhash.dedup(docs).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 2, 8, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_go(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)]
    for k in range(10):
        w = texts[k].split()
        w[50] = "changed"
        rows.append((100 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.dedup(docs).collect()}
    assert set(range(30)) <= kept and len(kept - set(range(30))) <= 1


def exact_components(texts, least=0.8):
    """Label by text of the components of 5-word Jaccard similarity, texts without words alike, without any Hamming limit; the pairs."""
    words = [brute.SPACE.findall(brute.lowered(t)) for t in texts]
    sets = [{b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({b" ".join(w)} if w else set()) for w in words]
    holders, common = {}, Counter()
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for held in holders.values():
        common.update((i, j) for n, j in enumerate(held) for i in held[:n])
    pairs = [(i, j) for (i, j), c in common.items() if c >= least * (len(sets[i]) + len(sets[j]) - c)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps, blank = [simhash.fingerprint_of(w) for w in words], [k for k, s in enumerate(sets) if not s]
    for i, j in [*pairs, *((blank[0], k) for k in blank)]:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    return [find(k) for k in range(len(texts))], [(i, j, (fps[i] ^ fps[j]).bit_count()) for i, j in pairs]


def test_dedup_misses_no_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    label, pairs = exact_components([t for _, t in rows])
    assert sum(bits > 6 for *_, bits in pairs) > 100
    kept = [r["doc_id"] for r in simhash.dedup(docs).collect()]
    assert sorted(kept) == [d for k, (d, _) in enumerate(rows) if label[k] == k]


def kept_by_brute_force(rows):
    label, _ = exact_components([t for _, t in rows])
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[label[k]] = min(least.get(label[k], d), d)
    return Counter(d for k, (d, _) in enumerate(rows) if d is None or d == least[label[k]])


def family(rng, n, length, edits, name):
    """Near copies of one text: so many words of it changed at random, so that pairs lie on both sides of 0.8."""
    base = [f"{name}{x}" for x in rng.integers(0, 400, length)]
    for k in range(n):
        w = list(base)
        for at in rng.integers(0, length, rng.integers(0, edits + 1)):
            w[at] = f"{name}x{rng.integers(0, 10**6)}"
        yield " ".join(w)


def test_families_beyond_a_block(spark, monkeypatch):
    """Groups of near copies over several blocks, texts of equal fingerprints, repeated ids with different texts, null ids."""
    monkeypatch.setattr(simhash, "_BLOCK_TEXTS", 7)
    rng = np.random.default_rng(11)
    texts = [t for name, length, edits in (("a", 150, 9), ("b", 60, 4), ("c", 30, 3)) for t in family(rng, 60, length, edits, name)]
    echo = "echo " * 40
    texts += [echo + " ".join(f"p{k}" for k in range(30)), echo + " ".join(f"q{k}" for k in range(30)), "x", "", "  ", None, "x"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, "alone"), (3, "another text of a repeated id"), (3, "another text of a repeated id"), (500, texts[61])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r["doc_id"] for r in simhash.dedup(docs).collect()) == kept_by_brute_force(rows)


def test_texts_of_one_fingerprint_are_compared(spark):
    echo = "very much so " * 400
    a, b = (echo + " ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    assert simhash.fingerprint_of(a.encode().split()) == simhash.fingerprint_of(b.encode().split())
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.dedup(docs).collect()) == [1, 2]


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)] + [np.array([7], np.uint64)]
    got = simhash._overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(31) for j in range(31) if i != j)
