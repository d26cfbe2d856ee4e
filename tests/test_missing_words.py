"""Words that a page lacks are listed where they are found: the product of pages and terms is never shuffled."""

import pytest

from queryscope.operators import terms


@pytest.mark.parametrize("sent", [10**6, 0])
def test_missing_words_are_not_shuffled(spark, monkeypatch, sent):
    monkeypatch.setattr(terms, "MAX_BROADCAST", sent)
    monkeypatch.setattr(terms, "PIECE", 3)
    texts = {k: " ".join(f"word{x}q" for x in range(20) if (x * k) % 7 < 4) for k in range(1, 30)}
    texts[30] = ""
    zones = spark.createDataFrame([(k, "body", t) for k, t in texts.items()], "doc_id long, zone string, text string")
    grp = {k: [f"h{k % 2}"] for k in texts} | {3: ["h0", "h1"], 4: [None]}
    listed = [(k, g) for k, gs in grp.items() for g in gs] + [(5, "h1"), (None, "h0")]
    peers = spark.createDataFrame(listed, "doc_id long, grp string")
    own = {k: {terms_ for terms_ in t.split()} for k, t in texts.items()}
    usual = {}
    for k, g in listed:
        for w in own.get(k, ()):
            usual[g, w] = usual.get((g, w), 0) + 1
    want = sorted((k or -1, w) for k, g in listed if g for (h, w), n in usual.items() if h == g and n > 4 and w not in own.get(k, ()))
    df = terms.missing_words(zones, peers, more_than=4)
    assert sorted((r["doc_id"] or -1, r["term"]) for r in df.collect()) == want and want
    made = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "leftanti" not in made and "generate explode" in made.split("join")[0]
