"""Token records: the encoder against the library, and the file format's round trip and checks."""

import io
import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from queryscope.llm import records
from queryscope.llm.common import tidied
from queryscope.llm.queries import tokenizer_path

TOK = Tokenizer.from_file(tokenizer_path())
ENC = records.Encoder(tokenizer_path())


def same(text):
    assert np.frombuffer(ENC.many([text])[0], f"<u{ENC.width}").tolist() == TOK.encode(text, add_special_tokens=False).ids, text


def test_fast_path_is_on():
    assert ENC.pieces and ENC.by_word


@pytest.mark.parametrize("text", ["", " ", "a", "It's we'll DON'T 'S!'s '' x²½ 3.14 1,000", "É è ÇA ß İstanbul ſ ΣΑΣ Σ", "é ́x a ́b", "<|endoftext|> x<|startoftext|>y < | >", "a\r\nb\x0bc\x0cd\x1ce\x85f\xa0g h　i", "日本語 한국어 한 😀👍🏽 ﬁ", "word,word.word--*** $$$ ***", "\x00\x01\x7f"])
def test_known_texts(text):
    same(text)


def test_every_plain_character():
    for c in map(chr, range(0x21, 0x250)):
        same(f"{c} a{c} {c}b x{c}y. {c}{c} {c.upper()}'s {c.lower()}")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aAbÉß'stlm.,! \n\t\r<|>0²́Σİ\x1c\xa0", max_size=40))
def test_any_text(text):
    same(text)


def test_frames_and_damage():
    payloads = [b"", b"x" * 5, bytes(range(256)) * 9]
    data = b"".join(map(records.frame, payloads))
    assert list(records.unframe(io.BytesIO(data))) == payloads
    for at in (3, 9, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(records.unframe(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(records.unframe(io.BytesIO(data[:-2])))


def test_edges(spark):
    rows = [(5, "b a", 1), (None, "null id", 2), (5, "b a", 3), (2, None, 4), (9, "", 5), (7, "long " * 50_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    manifest = records.write_records(docs, tokenizer_path())
    got = records.read_records(manifest).toPandas().sort_values("start")
    assert got.doc_id.fillna(-1).tolist() == [-1, 2, 5, 5, 7, 9]
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    for r, text in zip(got.itertuples(), ["null id", "", "b a", "b a", rows[5][1], ""], strict=True):
        assert np.frombuffer(r.ids, "<u4").tolist() == [*TOK.encode(text, add_special_tokens=False).ids, 1]
    m = {r["shard"]: r for r in manifest.collect()}
    for r in got.itertuples():
        doc_id, ids = records.payload_ids(records.read_at(m[r.shard]["data"], r.offset))
        assert ids.astype("<u4").tobytes() == r.ids and (doc_id is None) == np.isnan(r.doc_id)
    assert records.read_records(records.write_records(docs.limit(0), tokenizer_path())).count() == 0


def test_workers_drop_cached_pieces_before_other_work(spark):
    """A worker that encoded keeps no pieces while it works for another operator."""
    docs = spark.createDataFrame([(k, f"word{k} other{k}") for k in range(400)], "doc_id long, text string")

    def held(batches):
        for b in batches:
            n = sum(len(e) + len(e.words) for e in records._TOKENIZERS.values())
            yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows, pa.int64())], names=["n"])

    def counts(run):
        return [r["n"] for r in spark.range(4000).repartition(16).mapInArrow(run, "n long").collect()]

    records.write_records(docs, tokenizer_path()).collect()
    assert max(counts(tidied(held, "encoder"))) > 0
    assert counts(tidied(held)) == [0] * 4000


def test_task_gives_memory_back():
    """After a task the process is nearly as large as before, though freed memory lies between blocks in use."""

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    def run(batches):
        for n in batches:
            blocks = [bytes(2000) for _ in range(n)]
            kept.extend(blocks[::50])
            yield len(blocks)

    kept: list[bytes] = []
    before = resident()
    assert list(tidied(run)([100_000])) == [100_000]
    assert resident() - before < 100
