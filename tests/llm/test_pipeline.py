"""The pipeline: each stage against a brute-force version on what its predecessor kept, and edge-case tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from queryscope.llm import quality
from queryscope.llm.common import stored
from queryscope.llm.queries import table, tokenizer_path

from . import brute
from .test_simhash import kept_by_brute_force

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returned, the documents first."""
    docs, out = table(spark, SF, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, SF), name)
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def copies(docs, weights=(5, 2, 1), most=3):
    """(doc_id, source, size) to how often each id is taken: targets by sharing again until nothing is over its limit."""
    sizes = Counter()
    for _, source, size in docs:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            break
        capped |= over
    out = Counter()
    for d, s, _ in docs:
        rate = min(most, target.get(s, most * sizes[s]) / sizes[s]) if sizes[s] else 0
        at = int(hashlib.md5(f"17:{d}".encode()).hexdigest()[:13], 16) / 2**52
        out[d] += int(rate) + (at < rate % 1)
    return +out


def test_quality_stage(spark, kept):
    docs, labels = kept["documents"], table(spark, SF, "labels")
    want = {r["doc_id"] for r in quality.classify(docs, quality.fit(docs, labels)).where("predicted = 1").collect()}
    stay = {d for d, _ in rows(kept["quality"])}
    assert stay == want


def test_quality_stage_by_labels(spark):
    """Held-out labels at sf0.1, since smaller tables have a dozen bad ones at most: good documents stay, bad ones go."""
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents")
    stay = {d for d, _ in rows(STAGE["quality"](spark, docs, sf))}
    marks = [(r["doc_id"] in stay, r["quality"]) for r in table(spark, sf, "labels").collect() if brute.crc(r["doc_id"], 5) == 0]
    assert sum(q == 0 for _, q in marks) > 50
    assert np.mean([a for a, q in marks if q == 1]) >= 0.95 and np.mean([a for a, q in marks if q == 0]) <= 0.1


def test_near_duplicate_stage(kept):
    """Brute force on five-word shingles, without fingerprints: of each group of similarity 0.8 the smallest id stays."""
    assert Counter(d for d, _ in rows(kept["near_duplicates"])) == kept_by_brute_force(rows(kept["quality"]))


def test_decontamination_stage(spark, kept):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    before = rows(kept["near_duplicates"])
    clean = {x[0] for x in brute.contamination(before, items) if x[3] == 0}
    assert sorted(d for d, _ in rows(kept["decontamination"])) == sorted(clean)
    assert len(clean) < len(before)


def test_mixing_stage(kept):
    before = [(r["doc_id"], r["source"], len(brute.SPACE.findall((r["text"] or "").encode()))) for r in kept["decontamination"].collect()]
    assert Counter(d for d, _ in rows(kept["mixing"])) == copies(before)


def test_records_stage(kept):
    tok, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for d, t in sorted(rows(kept["mixing"])):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in kept["token_records"].select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_run_equals_its_stages(spark, kept):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).drop("shard", "offset").collect())) == Counter(map(tuple, kept["token_records"].drop("shard", "offset").collect()))


def test_columns_stay(kept):
    for name in list(STAGE)[:-1]:
        assert kept[name].columns == kept["documents"].columns


@pytest.mark.parametrize("empty", [(), ("documents",), ("labels", "benchmark"), ("documents", "labels", "benchmark")])
def test_edge_tables(spark, tmp_path, empty):
    """Nulls everywhere, repeated rows, a very long text and columns with the names that stages use."""
    long = "Long words go on and on here. " * 20_000
    docs = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id at all", "en", "a", 1), (3, "same row twice over", None, "b", 2), (3, "same row twice over", None, "b", 2), (4, long, "fr", None, 3), (5, "alpha beta gamma delta epsilon zeta eta theta iota", "en", "a", 4)]
    extra = "score double, row long, size long, copies int, `_gone` long, `_rate` double, `_copy` int, `_source` string, fp long"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    tables = {
        "documents": spark.createDataFrame([(*d, 0.0, 7, 8, 9, 10, 0.5, 11, "x", 12) for d in docs], schema),
        "labels": spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, None), (4, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (None, "no id at all"), (3, "")], "item_id long, text string"),
    }
    for name, df in tables.items():
        (df.limit(0) if name in empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    sf, now = str(tmp_path), table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, sf), name)
        if name != "token_records":
            assert now.columns == tables["documents"].columns
        if name == "decontamination":
            ids = {r["doc_id"] for r in now.collect()}
            assert "documents" in empty or (5 in ids) == ("benchmark" in empty)
    got = corpus_pipeline.run(spark, sf)
    assert Counter(map(tuple, got.drop("shard", "offset").collect())) == Counter(map(tuple, now.drop("shard", "offset").collect()))
    assert ("documents" in empty) == (got.count() == 0)
