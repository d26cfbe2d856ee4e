"""The eleven queries against brute force on the smallest tables."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from queryscope.llm import oracles
from queryscope.llm import queries as q

from . import brute

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def rows_of(df, cols):
    return Counter(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False)))


def test_op1_recall(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.stack(e.embedding).astype(float)
    got = q.op1_multi_index_hashing(spark, SF).toPandas()
    hits = n = 0
    for i in np.flatnonzero(e.vec_id % 20 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((e.vec_id, -s)) if j != i][:20]
        mine = got[got.query_id == e.vec_id[i]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(order) + 1))
        at = {v: k for k, v in enumerate(e.vec_id)}
        assert np.allclose(mine.score, [s[at[v]] for v in mine.vec_id], atol=1e-12)
        assert list(mine.vec_id) == list(mine.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id)
        hits += len({e.vec_id[j] for j in order} & set(mine.vec_id))
        n += len(order)
    assert hits / n >= 0.95


def test_op2_records(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(q.tokenizer_path())
    got = q.op2_token_records(spark, SF).toPandas().set_index("doc_id")
    start = 0
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert tuple(got.loc[d, ["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op3_simhash(spark, docs):
    got = q.op3_simhash(spark, SF).toPandas()
    assert rows_of(got, ["doc_id", "fingerprint", "component_id"]) == brute.simhash(list(zip(docs.doc_id, docs.text, strict=True)))


def test_op4_quality(spark, docs):
    got = q.op4_quality(spark, SF).toPandas()
    assert set(got.doc_id) == set(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [brute.crc(d, 5) == 0 for d in got.doc_id]).all()
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()
    known = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    test = known[known.held_out]
    assert (test.predicted == test.quality).mean() >= 0.85


def test_op5_language(spark, docs):
    got = q.op5_language_id(spark, SF).toPandas().merge(docs, on="doc_id")
    assert (got.held_out == [brute.crc(d, 4) == 2 for d in got.doc_id]).all() and got.score.between(0, 1).all()
    test = got[got.held_out]
    assert (test.lang_pred == test.lang).mean() >= 0.95


def test_op6_kneser_ney(spark, docs):
    got = q.op6_kneser_ney(spark, SF).toPandas().set_index("doc_id").loc[docs.doc_id]
    held = np.array([brute.crc(d, 7) == 2 for d in docs.doc_id])
    assert (got.held_out.values == held).all()
    want, p, uni = brute.kneser_ney(docs.text[~held], docs.text)
    for a, b in zip(got[["n_tokens", "n_known", "train_tokens", "base_score", "score"]].itertuples(index=False), want, strict=True):
        assert tuple(a)[:3] == b[:3]
        assert np.allclose(tuple(a)[3:], b[3:], rtol=1e-9)
    for context in ("<s>", "the", "of", "unseen-context"):
        assert abs(sum(p(context, w) for w in uni) + p(context, "\x00unknown") - 1) < 1e-9


def test_op7_warc(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = q.op7_warc(spark, SF).toPandas()
    first = {}
    for i, h in sorted(zip(pages.page_id, pages.html, strict=True)):
        first.setdefault(h, i)
    want = []
    for i, h in zip(pages.page_id, pages.html, strict=True):
        b = (h or "").encode()
        again = len(b) >= 100 and first[h] != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert rows_of(got, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]) == Counter(want)


def test_op8_winnowing(spark, docs):
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    got = q.op8_winnowing(spark, SF).toPandas()
    want = brute.contamination(list(zip(docs.doc_id, docs.text, strict=True)), list(zip(items.item_id, items.text, strict=True)))
    assert rows_of(got, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]) == want


def test_op9_targets(spark, docs):
    got = q.op9_mixing(spark, SF).toPandas()
    sources = sorted(docs.source.dropna().unique()) + ([None] if docs.source.isna().any() else [])
    size = {s: sum(len(brute.SPACE.findall((t or "").encode())) for t, x in zip(docs.text, docs.source, strict=True) if x == s or (s is None and x is None)) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        for s in over or free:
            target[s] = 3.0 * size[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        free -= over or free
    by_id = dict(zip(docs.doc_id, docs.source, strict=True))
    for r in got.itertuples():
        assert r.source_size == size[by_id[r.doc_id]] and np.isclose(r.target, target[by_id[r.doc_id]])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    assert abs(got.taken.sum() / sum(size.values()) - 1) < 0.2
    assert q.op9_mixing(spark, SF).toPandas().sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()


def test_op10_base(spark, docs):
    got = q.op10_license_scan(spark, SF).toPandas()
    want = Counter((d, *brute.base_license(t)) for d, t in zip(docs.doc_id, docs.text, strict=True))
    assert rows_of(got, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]) == want
    for r in got.itertuples():
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(oracles.oracle_sql()[name]).df()
    got = q.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert rows_of(got, cols) == rows_of(want, cols)
