"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from queryscope.llm import ann, decontam, kneser_ney, langid, license_scan, mixing, quality, warc

from . import brute

ROWS = [
    (1, None, "en", None, 1, "x"),
    (2, "", None, "b", 2, "x"),
    (None, "null id, All RIGHTS reserved", "fr", "b", 3, "x"),
    (3, "CC BY cc by 4.0 ALL rights Reserved", "en", "a", 4, None),
    (3, "CC BY cc by 4.0 ALL rights Reserved", "en", "a", 4, None),
    (4, "one two three four five six seven eight nine", "fr", "a", 5, "x"),
    (5, "Long " * 40_000, "en", "a", 6, "x"),
    (6, "123 ... !!", "en", "c", 7, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, row long, score string"
TEXTS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_ann(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.5]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as rank", "1 as v")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(df).collect()}
    assert got == {(0, 1): (3, 1.0), (0, 2): (20, 1.0), (0, 3): (4, 0.5), (20, 1): (0, 1.0), (20, 2): (3, 1.0), (20, 3): (4, 0.5)}
    assert ann.search(df.limit(0)).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, None, 0), (4, 1, 1), (4, 0, 1), (None, 1, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = quality.classify(docs, quality.fit(docs, lab)).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(docs.limit(0), quality.fit(docs, labels)).count() == 0
    assert quality.keep_good(docs, quality.fit(docs, labels)).columns == docs.columns


def test_language(docs):
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert Counter(r["lang_pred"] == "und" for r in got) == Counter({False: 5, True: 3})
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in langid.identify(docs, langid.fit(docs.limit(0))).collect())


def test_language_model(docs):
    got = kneser_ney.score(docs, kneser_ney.fit(docs)).collect()
    want, *_ = brute.kneser_ney([t for _, t in TEXTS], [t for _, t in TEXTS])
    key = lambda rows: sorted((a, b, c, round(d, 6), round(e, 6)) for a, b, c, d, e in rows)
    assert key((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == key(want)
    assert all(r["score"] == 0 and r["base_score"] == 0 for r in kneser_ney.score(docs, kneser_ney.fit(docs.limit(0))).collect())


def test_language_model_over_many_ranges(spark):
    """Ranges of a few keys, dealt at once and by way of coarse ranges, give the same model."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(200)], rng.integers(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want, *_ = brute.kneser_ney(texts, texts)
    for most in (4096, 3):
        got = {r["doc_id"]: r["score"] for r in kneser_ney.score(docs, kneser_ney.fit(docs, keys_per_range=50, most_ranges=most)).collect()}
        assert np.allclose([got[k] for k in range(150)], [w[4] for w in want], rtol=1e-9)


def test_warc(spark):
    big = "é" * 100
    rows = [(3, "http://a/\r\nX: y", big, "q"), (2, None, big, "q"), (2, "http://b", big, "q"), (None, "http://c", big, "q"), (5, "http://d", None, "q"), (6, "http://d", "", "q"), (7, "http://d", "WARC/1.1\r\n\r\n" * 20, "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(pages)).collect())
    assert got == Counter({(3, 200, "revisit", 2): 1, (2, 200, "response", None): 2, (None, 200, "response", None): 1, (5, 0, "response", None): 1, (6, 0, "response", None): 1, (7, 240, "response", None): 1})
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_contamination(spark, docs):
    items = [(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (2, "RIGHTS reserved"), (3, None), (4, "..."), (None, "one"), (5, "long long long long long long long long long")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination(docs, bench).collect())
    assert got == brute.contamination(TEXTS, [x for x in items if x[0] is not None])
    assert not any(r["n_hit"] for r in decontam.contamination(docs, bench.limit(0)).collect())
    assert decontam.decontaminate(docs, bench, min_items=1).columns == docs.columns


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in got)
    assert np.isclose(sum({r["source"]: r["target"] for r in got}.values()), sum(r["size"] for r in got))
    assert mixing.emit(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_licenses(docs):
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_scan.scan(docs).collect())
    assert got == Counter((d, *brute.base_license(t)) for d, t in TEXTS)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_license_labels(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "Released under the MIT License."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "a license to version it")]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "apache-2.0", 2: "mit", 3: "gpl,gpl-3.0", 4: ""}


def test_licenses_of_files_with_several_notices(spark):
    """All labels and the score of all beginnings, tried one by one, whatever else a file holds."""
    rng = np.random.default_rng(5)
    forms = [text for _, text, _ in license_scan.TEMPLATES]
    one_line = {label: text for label, text, _ in reversed(license_scan.TEMPLATES)}
    six = " ".join(one_line[x] for x in ("mit", "bsd", "isc", "cc0", "mpl-2.0", "epl-2.0"))
    texts = [forms[0] + " foo bar " + forms[4], forms[3] + " foo bar " + forms[6], six, " foo ".join(forms), " ".join(reversed(forms)), *forms]
    for _ in range(60):
        words = " filler words ".join(forms[k] for k in rng.integers(0, len(forms), rng.integers(2, 9))).split()
        texts.append(" ".join(w if rng.random() > 0.04 else "changed" for w in words))

    def judged(text):
        w, out, best = text.split(), set(), 0.0
        for label, form, phrases in license_scan.TEMPLATES:
            t = form.split()
            places = [next(i for i in range(len(t)) if t[i : i + len(p)] == p) for p in (p.split() for p in phrases)]
            for s in range(-len(t), len(w)):
                if all(s + at >= 0 and w[s + at : s + at + len(p.split())] == p.split() for at, p in zip(places, phrases, strict=True)):
                    share = sum(0 <= s + i < len(w) and w[s + i] == x for i, x in enumerate(t)) / len(t)
                    if share >= 0.6:
                        out.add(label)
                        best = max(best, share)
        base = brute.base_license(text)[-1]
        return ",".join(sorted(out | set(base.split(",")) - {""})), max(best, 0.5 if base else 0.0)

    found = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got, want = {r["doc_id"]: (r["labels"], r["score"]) for r in found}, {k: judged(t) for k, t in enumerate(texts)}
    assert {k: x for k, (x, _) in got.items()} == {k: x for k, (x, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert got[0][0] == "apache-2.0,mit" and got[1][0] == "bsd,mit" and got[2][0] == "bsd,cc0,epl-2.0,isc,mit,mpl-2.0"


def test_language_model_by_brute_force(spark):
    """Counts, smoothing and posterior recomputed gram by gram; texts longer than a chunk."""
    rng = np.random.default_rng(6)
    texts = [("abc Äbc " * 3, "x"), ("bcd, bcd!", "y"), ("A" + "bc d" * 300_000, "x"), ("zz", None), ("cab", "y"), ("", "x")]
    texts += [("".join(rng.choice(list("abcd e"), 60)), "xyz"[k % 3]) for k in range(12)]
    bits, columns = 10, 1 << 10

    def buckets(text):
        clean = b" " + b" ".join(bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode()).split()) + b" "
        for n in range(1, 5):
            windows = Counter(clean[i : i + n] for i in range(len(clean) - n + 1))
            for gram, count in windows.items():
                h = 0
                for c in gram:
                    h = (h * 0x100000001B3 + c + 1) % (1 << 64)
                yield ((h + n) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - bits), count

    langs = ["x", "y", "z"]
    counts, n = np.full((3, columns), 0.1), np.zeros(3)
    for text, lang in texts:
        if lang:
            n[langs.index(lang)] += 1
            for b, c in buckets(text):
                counts[langs.index(lang), b] += c
    logp = np.log(counts / counts.sum(axis=1, keepdims=True))
    df = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    for r in langid.identify(df, langid.fit(df, bits=bits)).collect():
        text = texts[r["doc_id"]][0]
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        z = np.log(n / n.sum()) + sum(logp[:, b] * c for b, c in buckets(text))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r["lang_pred"] == langs[int(z.argmax())] and abs(r["score"] - p.max()) < 1e-6


def test_quality_learns_from_repeated_ids_once(spark):
    """A third of the rows bears one id: one text of it is learnt from, and the bounds hold."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["good", "fine", "well"] if k % 2 else ["bad", "junk", "spam"], 30)) for k in range(60)]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)] + [(1, "repeated words", 1)] * 40, "doc_id long, text string, y long")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    for limits in ({}, {"max_documents": 20}, {"max_features": 2000}):
        got = quality.classify(docs, quality.fit(docs, labels, **limits)).collect()
        assert len(got) == 100 and np.mean([r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] != 1]) >= 0.9


def test_quality_examples_are_sent_packed(spark, monkeypatch):
    """What is learnt from is what plain counting gives, in order, in less than 5 bytes a bucket, with and without a bound."""
    rng = np.random.default_rng(2)
    words = ["w" + str(k) for k in range(3000)]
    texts = {k: " ".join(rng.choice(words, 400)) for k in range(40)} | {40: "", 41: "a" * 70_000, 42: "a " * 300}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in texts], "doc_id long, quality int, toxic int")
    taught = []
    monkeypatch.setattr(quality, "train", lambda examples, bits: taught.append(examples))
    for most in (1 << 24, 30_000):
        quality.fit(docs, labels, held_out=None, max_features=most)
        order = [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
        plain = {k: quality.counted(t.encode(), 17) for k, t in texts.items()}
        held = np.cumsum([len(plain[k][0]) for k in order])
        want, got = sorted(k for k, n in zip(order, held, strict=True) if n <= most), taught.pop()
        assert len(got) == len(want) > 5 and (most > held[-1] or len(want) < len(order))
        for k, (idx, cnt, y) in zip(want, got, strict=True):
            assert y == k % 2 and np.array_equal(idx, plain[k][0]) and np.array_equal(cnt, plain[k][1])
        assert sum(len(x) for r in got.rows for x in r if isinstance(x, bytes)) < 5 * sum(len(plain[k][0]) for k in want)
