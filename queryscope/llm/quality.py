"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax, trained by numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.llm.common import octets, sendable, stored, tidied

#: A document is split into pieces of so many bytes while it is hashed, which bounds memory; every piece is used.
_PIECE = 1 << 20
#: Rows of which a worker holds the texts as bytes at once.
_ROWS = 256
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * _MULT >> np.uint64(64 - bits)).astype(np.int64)


def features(text: bytes, bits: int = 17):
    """Bucket arrays of a text: character 2- to 4-grams and words, their pairs and
    whether a pair repeats a word; case and punctuation kept."""
    for at in range(0, len(text), _PIECE):
        raw = np.frombuffer(text[at : at + _PIECE], np.uint8)
        b = raw.astype(np.uint64) + np.uint64(1)
        h = b
        for n in (2, 3, 4):
            if len(b) < n:
                break
            h = h[:-1] * _STEP + b[n - 1 :]
            yield _mixed(h + np.uint64(n), bits)
        space = (raw <= 32) & ((raw == 32) | ((raw >= 9) & (raw <= 13)))
        inner = np.concatenate(([True], space, [True]))
        edges = np.flatnonzero(inner[1:] != inner[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        #: a word's hash: the sum of its bytes' hashes by place, as a difference of running sums
        place = (np.arange(len(b), dtype=np.int64) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(b)]))))).astype(np.uint64)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b + place * np.uint64(257)) * _MULT ^ (b * _STEP << np.uint64(7)))))
        w = run[ends] - run[starts] + np.uint64(11)
        yield _mixed(w, bits)
        yield _mixed(w[:-1] * _STEP + w[1:], bits)
        #: word pairs once more, without the words: the same again, or another
        yield _mixed(np.where(w[1:] == w[:-1], np.uint64(3), np.uint64(5)), bits)


def counted(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text with their counts."""
    found = list(features(text, bits))
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def packed(numbers: np.ndarray) -> bytes:
    """Natural numbers below 2**32, of 1, 2 or 4 bytes each as the largest needs."""
    most = int(numbers.max()) if len(numbers) else 0
    return numbers.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


class Examples(Sequence):
    """(buckets, counts, label) of each document in order; buckets are kept as packed steps, counts packed."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, int]]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        n, steps, cnt, y = self.rows[k]
        return np.cumsum(unpacked(steps, n)), unpacked(cnt, n), y


class Model:
    """``table``: what each bucket adds to the log odds; ``bias``: their start. Both follow from the trained vectors."""

    def __init__(self, table: np.ndarray, bias: float, bits: int):
        self.table, self.bias, self.bits = table, bias, bits

    def score(self, text: bytes) -> float:
        total, n = 0.0, 0
        for f in features(text, self.bits):
            total += float(self.table[f].sum(dtype=np.float64))
            n += len(f)
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(examples: Sequence[tuple[np.ndarray, np.ndarray, int]], bits: int = 17, dim: int = 8, epochs: int = 6, rate: float = 1.0, seed: int = 7) -> Model:
    """Two-class softmax over the averaged bucket vectors, by stochastic gradient descent with a falling rate.

    Without examples of both classes the score is the share of label 1 (0.5 without any example).
    """
    labels = np.array([y for *_, y in examples])
    if len(set(labels.tolist())) < 2:
        p = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-3), 1 - 1e-3)
        return Model(np.zeros(1 << bits, np.float32), float(np.log(p / (1 - p))), bits)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    out[1, : dim // 2], out[0, dim // 2 :] = 0.1, 0.1
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            idx, cnt, y = examples[k]
            lr = rate * (1 - done / steps)
            done += 1
            share = (cnt / max(1, cnt.sum())).astype(np.float32)
            mean = share @ vectors[idx] if len(idx) else np.zeros(dim, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            if len(idx):
                #: the mean's gradient, with steps scaled to the document's number of features as if each were seen alone
                vectors[idx] -= lr * np.minimum(share * 200, 1)[:, None] * (p @ out)[None, :]
            out -= lr * np.outer(p, mean)
            bias -= lr * 0.1 * p
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]), bits)


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 3000, bits: int = 17, held_out: int | None = 5, max_features: int = 1 << 24) -> Model:
    """Learn ``labels.quality`` from whole texts of at most ``max_documents`` labelled ids, those of least hashed id.

    Of these, taken in that order, as many are learnt from as have ``max_features`` distinct buckets together, however long
    they are. The driver gets their buckets and counts packed, in 3 to 4 bytes a bucket for prose, 8 at most. Of different texts of one id the smallest counts; further columns are left out.

    Rows with crc32(doc_id as text) mod ``held_out`` = 0 are never learnt from. Labels other than 0 and 1, null ids and
    null labels are left out; contradicting labels of one id count as the one that more rows bear, ties as 0.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) > 0.5).cast("int").alias("y"))
    if held_out:
        known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out != 0)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)

    def run(batches):
        for b in (b.slice(s, _ROWS) for b in batches for s in range(0, b.num_rows, _ROWS)):
            n, steps, cnt = [], [], []
            for t in octets(b.column(1)):
                idx, c = counted(t, bits)
                n.append(len(idx))
                steps.append(packed(np.diff(idx, prepend=0)))
                cnt.append(packed(c))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(steps, pa.binary()), pa.array(cnt, pa.binary()), b.column(2)], names=["doc_id", "n", "steps", "cnt", "y"])

    picked = docs.select("doc_id", "text").join(sendable(stored(chosen, "chosen")), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, steps binary, cnt binary, y int"
    found = stored(picked.select("doc_id", "text", "y").mapInArrow(tidied(run), schema), "features")
    #: one row for each of at most max_documents ids; only their sizes are brought together
    place = F.xxhash64("doc_id")
    sizes = found.select(place.alias("place"), "doc_id", "n").orderBy("place", "doc_id").collect()
    fit_in = int((np.cumsum([r["n"] for r in sizes]) <= max_features).sum())
    if fit_in < len(sizes):
        after = sizes[fit_in]
        found = found.where((place < after["place"]) | (place == after["place"]) & (F.col("doc_id") < after["doc_id"]))
    rows = [r for b in found.toArrow().to_batches() for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    return train(Examples([r[1:] for r in sorted(rows, key=lambda r: r[0])]), bits)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted): every row scored on its whole text alone; null counts as empty, which scores the bias.

    Very long texts are scored piece by piece; repeated rows each give a row; further columns, whatever their names, are
    left out; an empty table gives no rows.

    The model is a fixed 2**bits floats (0.5 MB at 17 bits) and travels with the task.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.bits))

    def run(batches):
        m = Model(*sent.value)
        for b in (b.slice(s, _ROWS) for b in batches for s in range(0, b.num_rows, _ROWS)):
            s = np.array([m.score(t) for t in octets(b.column(1))], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns and in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.bits))

    def judged(columns):
        m = Model(*sent.value)
        for c in columns:
            yield pa.array([m.score(t) >= threshold for s in range(0, len(c), _ROWS) for t in octets(c.slice(s, _ROWS))], pa.bool_())

    run = tidied(judged)

    @F.arrow_udf("boolean")
    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(texts)

    return docs.where(good("text"))
