"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers memory-map.

All counts are sums by 64-bit key. A task adds up its part, cuts the sorted keys into ranges and hands each range on as
one compressed row; one task a range merges them and writes the sorted keys and sums as plain arrays to the shared
folder. Keys are hashes, so ranges are even whatever the words' frequencies. A word's key is its XXH64 and its number the
place in the sorted keys; a bigram's key is a reversible mix of the two words' numbers.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.llm.common import hashes, octets, open_fs, put, scratch, stored

#: No word holds a line break, so these stand for nothing else.
END, START = b"\n/s", b"\ns"
_A, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_UNMIX = tuple(np.uint64(pow(x, -1, 1 << 64)) for x in (_A, _B))
#: Tokens handled at once.
_CHUNK = 1 << 18
#: Keys that a task holds before it adds them up.
_HELD = 1 << 20
_MAPPED: dict[str, np.ndarray] = {}
#: One of each a worker process: they hold large buffers.
_ZSTD: dict[str, object] = {}
#: A word's columns: its count, how many words follow it once, twice and oftener, how many precede it; all but the first
#: count words, of which there are fewer than 2**32.
_COLUMNS = {"cnt": np.int64, "one": np.uint32, "two": np.uint32, "more": np.uint32, "cont": np.uint32}


def mix(x: np.ndarray) -> np.ndarray:
    y = x * np.uint64(_A)
    return (y ^ (y >> np.uint64(32))) * np.uint64(_B)


def unmix(y: np.ndarray) -> np.ndarray:
    x = y * _UNMIX[1]
    return (x ^ (x >> np.uint64(32))) * _UNMIX[0]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Range of a key: rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def add_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their rows of values (n x columns)."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first, axis=0) if len(first) else values


def _packed(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed: what is alike or zero comes together."""
    if "out" not in _ZSTD:
        _ZSTD["out"] = zstandard.ZstdCompressor(level=1)
    return _ZSTD["out"].compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpacked(data: bytes, kind, n: int) -> np.ndarray:
    if "in" not in _ZSTD:
        _ZSTD["in"] = zstandard.ZstdDecompressor()
    planes = np.frombuffer(_ZSTD["in"].decompress(data), np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


_BLOB = "bucket int, n long, keys binary, vals binary"


class Adder:
    """Sums by key within a task; memory follows the distinct keys of the task."""

    def __init__(self, columns: int):
        self.columns, self.parts, self.held, self.size = columns, [], 0, _HELD

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.parts.append((keys, values))
        self.held += len(keys)
        if self.held > self.size:
            self.merge()
            self.size = max(_HELD, 2 * self.held)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros((0, self.columns), np.int64)
        self.parts = [add_up(np.concatenate([k for k, _ in self.parts]), np.concatenate([v for _, v in self.parts]))]
        self.held = len(self.parts[0][0])
        return self.parts[0]

    def blobs(self, bucket: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A compressed row for each range that has keys; ``bucket`` rises with the key."""
        keys, values = self.merge()
        of = bucket(keys)
        cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(keys))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            delta = np.diff(keys[a:z], prepend=np.uint64(0))
            yield pa.RecordBatch.from_arrays([pa.array([of[a]], pa.int32()), pa.array([z - a]), pa.array([_packed(delta)], pa.binary()), pa.array([_packed(np.ascontiguousarray(values[a:z]))], pa.binary())], names=["bucket", "n", "keys", "vals"])


class Ranges:
    """How keys are dealt to ranges: at once, or by way of coarse ranges if there are more than ``most``.

    A task emits a row for each range that it has keys of. So that a row holds many keys however many ranges there are,
    keys go to at most ``most`` coarse ranges first, where the keys of many tasks are added up and cut finer.
    """

    def __init__(self, bucket: Callable[[np.ndarray], np.ndarray], buckets: int, columns: int, most: int):
        self.bucket, self.columns, self.width, self.coarse = bucket, columns, max(1, -(-buckets // most)), 0
        self.coarse = -(-buckets // self.width)

    def emit(self, adder: Adder) -> Iterator[pa.RecordBatch]:
        bucket, width = self.bucket, self.width
        return adder.blobs(lambda k: bucket(k) // width)

    def dealt(self, blobs: DataFrame) -> DataFrame:
        """Rows of ``emit`` as rows of fine ranges."""
        if self.width == 1:
            return blobs
        bucket, columns = self.bucket, self.columns

        def split(batches):
            adder = Adder(columns)
            for b in batches:
                for r in range(b.num_rows):
                    adder.add(*_opened(b.slice(r, 1), columns))
                    if adder.held > 8 * _HELD:
                        yield from adder.blobs(bucket)
                        adder = Adder(columns)
            yield from adder.blobs(bucket)

        return blobs.repartition(self.coarse, "bucket").mapInArrow(split, _BLOB)


def _opened(row, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a table or batch of one blob."""
    n = row.column("n")[0].as_py()
    keys = np.cumsum(_unpacked(row.column("keys")[0].as_py(), np.uint64, n), dtype=np.uint64)
    return keys, _unpacked(row.column("vals")[0].as_py(), np.int64, n).reshape(n, columns)


def _merged(table: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray]:
    adder = Adder(columns)
    for r in range(table.num_rows):
        adder.add(*_opened(table.slice(r, 1), columns))
    return adder.merge()


def mapped(uri: str, kind) -> np.ndarray:
    """A memory-mapped array of the shared folder; of a store that cannot be mapped, a nameless copy that ends with the worker."""
    if uri not in _MAPPED:
        fs, path = open_fs(uri)
        if not uri.startswith("file:"):
            with tempfile.TemporaryFile() as local, fs.open_input_stream(path) as f:
                shutil.copyfileobj(f, local)
                local.flush()
                _MAPPED[uri] = np.memmap(local, kind, "r") if local.tell() else np.zeros(0, kind)
        else:
            _MAPPED[uri] = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    return _MAPPED[uri]


class Arrays:
    """Sorted key ranges with columns beside them; ``find`` gives the global place of each key, or -1."""

    def __init__(self, folder: str, name: str, lengths: list[int], wide: frozenset[int] = frozenset()):
        """``wide``: the ranges whose counts take 64 bits."""
        self.folder, self.name, self.lengths, self.wide = folder, name, np.array(lengths, np.int64), wide
        self.offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)

    def part(self, b: int, column: str, kind) -> np.ndarray:
        return mapped(f"{self.folder}/{self.name}-{b:06d}.{column}", kind) if self.lengths[b] else np.zeros(0, kind)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """``keys`` sorted."""
        out = np.full(len(keys), -1, np.int64)
        cuts = np.searchsorted(bucket_of(keys, len(self.lengths)), np.arange(len(self.lengths) + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            own, held = keys[cuts[b] : cuts[b + 1]], self.part(b, "key", np.uint64)
            if len(held):
                at = np.minimum(np.searchsorted(held, own), len(held) - 1)
                out[cuts[b] : cuts[b + 1]] = np.where(held[at] == own, at + self.offsets[b], -1)
        return out

    def take(self, places: np.ndarray, column: str, kind) -> np.ndarray:
        """Values at sorted global places."""
        out = np.zeros(len(places), np.int64)
        cuts = np.searchsorted(places, self.offsets)
        for b in np.flatnonzero(np.diff(cuts)):
            out[cuts[b] : cuts[b + 1]] = self.part(b, column, np.uint64 if b in self.wide else kind)[places[cuts[b] : cuts[b + 1]] - self.offsets[b]]
        return out


def tokens_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, words split at ASCII white space, then one end."""
    words = text.lower().split()
    words.append(END)
    return words


def _token_chunks(batches, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word keys, lengths of the texts) of so many whole texts at a time."""
    keys, lengths, held = [], [], 0
    for b in batches:
        for s in range(0, b.num_rows, 512):
            for t in octets(b.column(column).slice(s, 512)):
                h = hashes(tokens_of(t))
                keys.append(h)
                lengths.append(len(h))
                held += len(h)
                if held >= _CHUNK:
                    yield np.concatenate(keys), np.array(lengths)
                    keys, lengths, held = [], [], 0
    if lengths:
        yield np.concatenate(keys), np.array(lengths)


def _numbers(words: Arrays, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted numbers-or--1 of the keys' distinct values, and for each key its place among these."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return words.find(distinct), inverse


def _bigrams(numbers: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """Number of the word before each token; the first of a text follows the start."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = start
    return before


def discounts(n: list[int]) -> np.ndarray:
    """D1, D2 and D3+ from the numbers of keys that occur 1, 2, 3 and 4 times; 0.5, 1 and 1.5 where they give none."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) <= 0:
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.05, 0.05, 0.05], [0.95, 1.95, 2.95])


def _by_count(values: np.ndarray) -> list[int]:
    return [int((values == k).sum()) for k in (1, 2, 3, 4)]


class Model:
    """What scoring needs besides the arrays: a few numbers, and the ranges' lengths (a row for each range)."""

    def __init__(self, words: Arrays, pairs: Arrays, train_tokens: int, types: int, start: int, d2: np.ndarray, d1: np.ndarray, pair_types: int, n_cont: np.ndarray):
        self.words, self.pairs, self.train_tokens, self.types, self.start = words, pairs, train_tokens, types, start
        self.d2, self.d1, self.pair_types = np.concatenate(([0.0], d2)), np.concatenate(([0.0], d1)), pair_types
        self.gamma = float(d1 @ n_cont) / pair_types if pair_types else 1.0

    def score(self, keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of each token in training, log10 base probability, log10 model probability)."""
        known, inverse = _numbers(self.words, keys)
        have = known >= 0
        stats = np.zeros((len(known), 5), np.int64)
        for c, (name, kind) in enumerate(_COLUMNS.items()):
            stats[have, c] = self.words.take(known[have], name, kind)
        count = stats[inverse, 0]
        base = np.log10((count + 1.0) / (self.train_tokens + self.types + 1.0))
        cont = stats[inverse, 4]
        low = np.full(len(keys), self.gamma / (self.types + 1.0))
        if self.pair_types:
            low += np.maximum(cont - self.d1[np.minimum(cont, 3)], 0.0) / self.pair_types
        numbers = known[inverse]
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        context = np.zeros((len(keys), 4), np.int64)
        context[1:] = stats[inverse[:-1], :4]
        #: a word precedes as many tokens as it occurs; the start precedes a token in every text, as the end follows one
        begin = np.zeros(4, np.int64)
        if self.start >= 0:
            begin[0] = self.words.take(self.words.find(hashes([END])), "cnt", np.int64)[0]
            begin[1:] = [self.words.take(np.array([self.start]), c, np.uint32)[0] for c in ("one", "two", "more")]
        context[first] = begin
        before = _bigrams(numbers, lengths, self.start)
        pair = np.zeros(len(keys), np.int64)
        both = np.flatnonzero((numbers >= 0) & (before >= 0))
        asked, back = np.unique(mix(before[both].astype(np.uint64) << np.uint64(32) | numbers[both].astype(np.uint64)), return_inverse=True)
        at = self.pairs.find(asked)
        seen = np.zeros(len(asked), np.int64)
        seen[at >= 0] = self.pairs.take(at[at >= 0], "cnt", np.uint32)
        pair[both] = seen[back]
        total = context[:, 0].astype(float)
        back_off = (context[:, 1:] * self.d2[None, 1:]).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total > 0, (np.maximum(pair - self.d2[np.minimum(pair, 3)], 0.0) + back_off * low) / total, low)
        return count, base, np.log10(p)


def fit(docs: DataFrame, text_col: str = "text", folder: str | None = None, keys_per_range: int = 2_000_000, most_ranges: int = 4096) -> Model:
    """Count every token and bigram of all rows of ``docs`` (null text: empty) and write the model's arrays.

    The number of ranges grows with the bytes of text, so a range stays at about ``keys_per_range`` keys; over
    ``most_ranges`` keys are dealt in two steps. The driver sees a row for each range, and tasks get the ranges' lengths by
    broadcast (8 bytes a range). Without rows every word is unknown and has probability 1.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "kneser-ney")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // 200_000)), -(-size // (6 * keys_per_range)))
    texts = docs.select(text_col)
    by_key = Ranges(lambda k: bucket_of(k, buckets), buckets, 1, most_ranges)

    def count_words(batches):
        adder = Adder(1)
        for keys, _ in _token_chunks(batches, 0):
            k, n = np.unique(keys, return_counts=True)
            adder.add(k, n.reshape(-1, 1).astype(np.int64))
        if adder.parts:
            adder.add(hashes([START]), np.zeros((1, 1), np.int64))
        yield from by_key.emit(adder)

    def write_words(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        keys, values = _merged(table, 1)
        put(f"{folder}/word-{b:06d}.key", keys.tobytes())
        put(f"{folder}/word-{b:06d}.cnt", np.ascontiguousarray(values[:, 0]).tobytes())
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": [len(keys)], "tokens": [int(values.sum())]})

    rows = stored(by_key.dealt(texts.mapInArrow(count_words, _BLOB)).groupBy("bucket").applyInArrow(write_words, "bucket int, n long, tokens long"), "word-ranges").collect()
    lengths = {r["bucket"]: r["n"] for r in rows}
    words = Arrays(folder, "word", [lengths.get(b, 0) for b in range(buckets)])
    n_words = int(words.offsets[-1])
    if n_words >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    start = int(words.find(hashes([START]))[0])
    sent_words = spark.sparkContext.broadcast(words)

    def count_pairs(batches):
        adder, words = Adder(1), sent_words.value
        for keys, lens in _token_chunks(batches, 0):
            known, inverse = _numbers(words, keys)
            numbers = known[inverse]
            before = _bigrams(numbers, lens, start)
            k, n = np.unique(mix(before.astype(np.uint64) << np.uint64(32) | numbers.astype(np.uint64)), return_counts=True)
            adder.add(k, n.reshape(-1, 1).astype(np.int64))
        yield from by_key.emit(adder)

    def write_pairs(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        keys, values = _merged(table, 1)
        wide = bool(values.max() >> 32)
        put(f"{folder}/pair-{b:06d}.key", keys.tobytes())
        put(f"{folder}/pair-{b:06d}.cnt", values[:, 0].astype(np.uint64 if wide else np.uint32).tobytes())
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": [len(keys)], "wide": [wide], "by_count": pa.array([_by_count(values[:, 0])], pa.list_(pa.int64()))})

    pair_rows = stored(by_key.dealt(texts.mapInArrow(count_pairs, _BLOB)).groupBy("bucket").applyInArrow(write_pairs, "bucket int, n long, wide boolean, by_count array<long>"), "pair-ranges")
    found = pair_rows.collect()
    lengths = {r["bucket"]: r["n"] for r in found}
    pairs = Arrays(folder, "pair", [lengths.get(b, 0) for b in range(buckets)], frozenset(r["bucket"] for r in found if r["wide"]))

    sent_pairs = spark.sparkContext.broadcast(pairs)
    by_number = Ranges(lambda k: np.searchsorted(sent_words.value.offsets, k.astype(np.int64), side="right") - 1, buckets, 4, most_ranges)

    def contexts(batches):
        """For each pair range: numbers of once, twice and oftener by first word, contexts by second word."""
        adder, pairs = Adder(4), sent_pairs.value
        for batch in batches:
            for b in batch.column(0).to_pylist():
                keys, counts = pairs.part(b, "key", np.uint64), pairs.part(b, "cnt", np.uint64 if b in pairs.wide else np.uint32)
                for s in range(0, len(keys), _CHUNK):
                    raw, c = unmix(np.asarray(keys[s : s + _CHUNK])), np.asarray(counts[s : s + _CHUNK]).astype(np.int64)
                    v = np.zeros((len(c), 4), np.int64)
                    v[:, 0], v[:, 1], v[:, 2] = c == 1, c == 2, c > 2
                    adder.add(*add_up(raw >> np.uint64(32), v))
                    w, n = np.unique(raw & np.uint64(0xFFFFFFFF), return_counts=True)
                    v = np.zeros((len(w), 4), np.int64)
                    v[:, 3] = n
                    adder.add(w, v)
        yield from by_number.emit(adder)

    def write_contexts(table: pa.Table) -> pa.Table:
        b, words = table.column("bucket")[0].as_py(), sent_words.value
        keys, values = _merged(table, 4)
        dense = np.zeros((words.lengths[b], 4), np.int64)
        dense[keys.astype(np.int64) - words.offsets[b]] = values
        for c, name in enumerate(("one", "two", "more", "cont")):
            put(f"{folder}/word-{b:06d}.{name}", dense[:, c].astype(np.uint32).tobytes())
        cont = dense[:, 3]
        return pa.table({"bucket": pa.array([b], pa.int32()), "by_count": pa.array([_by_count(cont)], pa.list_(pa.int64())), "more": [int((cont > 2).sum())], "pairs": [int(cont.sum())]})

    ranges = pair_rows.select("bucket").repartition(max(1, min(buckets, len(found))), "bucket")
    last = stored(by_number.dealt(ranges.mapInArrow(contexts, _BLOB)).groupBy("bucket").applyInArrow(write_contexts, "bucket int, by_count array<long>, more long, pairs long"), "contexts").collect()
    of_pairs = np.array([r["by_count"] for r in found] or [[0] * 4]).sum(axis=0).tolist()
    of_cont = np.array([r["by_count"] for r in last] or [[0] * 4]).sum(axis=0).tolist()
    more = sum(r["more"] for r in last)
    return Model(words, pairs, sum(r["tokens"] for r in rows), max(0, n_words - 1), start, discounts(of_pairs), discounts(of_cont), sum(r["pairs"] for r in last), np.array([of_cont[0], of_cont[1], more], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every whole text; null counts as empty.

    Scores are sums of log10 probabilities over the words and one end. Repeated rows each give a row; further columns,
    whatever their names, are left out; very long texts are scored whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for b in batches:
            ids = b.column(0)
            for s in range(0, b.num_rows, 4096):
                part, at = ids.slice(s, 4096), 0
                for keys, lengths in _token_chunks([b.slice(s, 4096)], 1):
                    count, base, p = model.score(keys, lengths)
                    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                    total = np.add.reduceat(p, first)
                    yield pa.RecordBatch.from_arrays(
                        [part.slice(at, len(lengths)), pa.array(lengths.astype(np.int64)), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)), pa.array(np.full(len(lengths), model.train_tokens)), pa.array(np.add.reduceat(base, first)), pa.array(total), pa.array(10 ** np.minimum(-total / lengths, 300))],
                        names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                    )
                    at += len(lengths)

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
