"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.llm.common import octets

#: Bytes of cleaned text that are handled at once.
_CHUNK = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
#: Longest grams, in bytes.
_N = 4
#: Entries of the log-probability matrix up to which all languages have the full number of buckets.
_MAX_ENTRIES = 1 << 22
_LETTER = regex.compile(r"\p{L}")
#: A-Z lower-cased, other ASCII but letters as a space; bytes of other characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _pieces(texts: list[bytes]):
    """Lists of (number of the text, cleaned bytes, how many of them begin a gram), a chunk at a time; long texts are cut."""
    held, size = [], 0
    for k, text in enumerate(texts):
        clean = b" " + b" ".join(text.translate(_TABLE).split()) + b" "
        for at in range(0, len(clean), _CHUNK):
            part = clean[at : at + _CHUNK + _N - 1]  # a gram belongs to the piece that it starts in
            held.append((k, part, min(len(part), _CHUNK)))
            size += len(part)
            if size >= _CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def sparse_rows(texts: list[bytes], bits: int):
    """(numbers of texts, where each one's entries start, buckets), for a chunk and a gram length at a time.

    Row by row these are the nonzero columns of the texts' count matrix, repeated as often as they are counted: the 1- to
    4-byte grams. The last bucket, 2**bits, stands for places where no gram begins.
    """
    for held in _pieces(texts):
        b = np.frombuffer(b"".join(part for _, part, _ in held), np.uint8).astype(np.uint64) + np.uint64(1)
        lengths = np.array([len(part) for _, part, _ in held])
        starts = np.cumsum(lengths) - lengths
        at = np.arange(len(b)) - np.repeat(starts, lengths)
        owned, left = np.repeat([own for *_, own in held], lengths) > at, np.repeat(lengths, lengths) - at
        numbers, h = np.array([k for k, *_ in held]), np.zeros(len(b), np.uint64)
        for n in range(1, _N + 1):
            m = max(0, len(b) - n + 1)
            h[:m] = h[:m] * _STEP + b[n - 1 :]
            bucket = ((h + np.uint64(n)) * _MULT >> np.uint64(64 - bits)).astype(np.int64)
            yield numbers, starts, np.where(owned & (left >= n), bucket, 1 << bits)


class Model:
    """``logp``: languages x buckets, with a last column of zeros; ``prior``: log share of training documents; ``langs``: names, sorted."""

    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray, bits: int):
        self.langs, self.logp, self.prior, self.bits = langs, logp, prior, bits

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its posterior for each text: a batch's sparse count matrix times the matrix of log probabilities."""
        total = np.tile(self.prior, (len(texts), 1))
        for numbers, starts, buckets in sparse_rows(texts, self.bits):
            for k, column in enumerate(self.logp):
                np.add.at(total[:, k], numbers, np.add.reduceat(column[buckets], starts))
        best = total.argmax(axis=1)
        return best, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)


def fit(docs: DataFrame, bits: int = 15, alpha: float = 0.1) -> Model:
    """Count grams of every row with a non-null ``lang`` in Spark and smooth by ``alpha``.

    Workers add up per language and bucket before the shuffle. The driver gets one number for each language and bucket.
    With many languages the buckets are made fewer, down to 256, so that the numbers stay at 2**22 up to 16,384 languages;
    beyond, each one adds 2 KB. Repeated rows count as often; very long texts are counted piece by piece.
    """
    found = {r["lang"]: r["n"] for r in docs.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(found)
    while len(langs) << bits > _MAX_ENTRIES and bits > 8:
        bits -= 1
    if not langs:
        return Model([], np.zeros((0, (1 << bits) + 1)), np.zeros(0), bits)
    at, columns = {x: k for k, x in enumerate(langs)}, (1 << bits) + 1

    def run(batches):
        sums = np.zeros(len(langs) * columns, np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                own = np.array([at[x] for x in b.column(0).slice(s, 1024).to_pylist()])
                for numbers, starts, buckets in sparse_rows(octets(b.column(1).slice(s, 1024)), bits):
                    sums += np.bincount(np.repeat(own[numbers] * columns, np.diff(np.append(starts, len(buckets)))) + buckets, minlength=len(sums))
        cells = np.flatnonzero(sums)
        k, v = np.divmod(cells, columns)
        real = v < columns - 1
        yield pa.RecordBatch.from_arrays([pa.array(k[real].astype(np.int32)), pa.array(v[real].astype(np.int32)), pa.array(sums[cells[real]])], names=["k", "v", "n"])

    rows = docs.where("lang is not null").select("lang", "text").mapInArrow(run, "k int, v int, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(langs), columns - 1), alpha)
    counts[rows.column("k").to_numpy(), rows.column("v").to_numpy()] += rows.column("n").to_numpy()
    n = np.array([found[x] for x in langs], np.float64)
    logp = np.concatenate((np.log(counts / counts.sum(axis=1, keepdims=True)), np.zeros((len(langs), 1))), axis=1)
    return Model(langs, logp, np.log(n / n.sum()), bits)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest learned language of each whole text and its posterior probability.

    Null texts, texts without a letter, and all texts if nothing was learned get ``und`` with score 0. Equal
    likelihoods go to the name that sorts first. Texts are scored whole, very long ones piece by piece; repeated rows each
    give a row; further columns are left out. The broadcast matrix has at most 2**22 numbers (32 MB) up to 16,384 languages.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.prior, model.bits))

    def run(batches):
        m = Model(*sent.value)
        for b in (b.slice(s, 1024) for b in batches for s in range(0, b.num_rows, 1024)):
            texts = b.column(1).to_pylist()
            known = [bool(m.langs) and t is not None and _LETTER.search(t) is not None for t in texts]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            where = np.flatnonzero(known)
            if len(where):
                best, p = m.scores([texts[k].encode() for k in where])
                score[where] = p
                for k, x in zip(where, best, strict=True):
                    lang[k] = m.langs[x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
