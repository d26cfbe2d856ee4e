"""Benchmark decontamination by winnowing: joined fingerprints, hits extended to whole windows and verified as text.

A window is ``span`` consecutive words. Of its span - k + 1 word k-grams the one with the least hash (the rightmost on
ties) is its fingerprint. Equal windows choose equal k-grams, so every shared window is found, whatever surrounds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.llm.common import gram_hashes, hashes, octets, sendable, stored, tidied, without

SPAN, GRAM = 8, 5
#: Bits of the filter that documents' fingerprints pass before they are shuffled: 2 MB, whatever the benchmark's size.
_FILTER_BITS = 24
#: Most windows (some 60 bytes of text each) that are sent to all tasks; more are joined by a shuffle.
_SENT = 200_000
#: A-Z to a-z, other ASCII but letters and digits to space; bytes of non-ASCII characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def winnow(words: np.ndarray, span: int = SPAN, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, start of its k-gram) of every window of ``span`` words, in order."""
    g, w = gram_hashes(words, k), span - k + 1
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        later = g[j : j + n]
        take = later <= best
        best[take] = later[take]
        at[take] = np.flatnonzero(take) + j
    return best, at


def _slot(fp: np.ndarray) -> np.ndarray:
    return (fp >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def benchmark_windows(items: DataFrame, span: int = SPAN, k: int = GRAM, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, fp long, off int, len int, win string) of every distinct window of every item.

    An item of fewer words, but not none, is one window whose fingerprint covers all its words.
    """

    def run(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), octets(b.column(1)), strict=True):
                w = words_of(text)
                h = hashes(w)
                if not w:
                    continue
                if len(w) < span:
                    fps, offs, wins = gram_hashes(h, len(w)), np.zeros(1, np.int64), [b" ".join(w)]
                else:
                    fps, at = winnow(h, span, k)
                    offs, wins = at - np.arange(len(at)), [b" ".join(w[s : s + span]) for s in range(len(at))]
                n = len(wins)
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, b.column(0).type), pa.array(fps.view(np.int64)), pa.array(offs.astype(np.int32)), pa.array(np.full(n, min(len(w), span), np.int32)), pa.array([x.decode() for x in wins])], names=["item_id", "fp", "off", "len", "win"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(tidied(run), f"item_id {kind}, fp long, off int, len int, win string").distinct()


def _filter_of(windows: DataFrame) -> bytes:
    """The benchmark's fingerprints as a bit table, built from at most 2**24 slots that Spark makes distinct."""
    slot = F.shiftrightunsigned("fp", 64 - _FILTER_BITS)
    byte = windows.select(slot.alias("s")).distinct().groupBy(F.shiftright("s", 3).alias("b")).agg(F.sum(F.expr("shiftleft(1, cast(s % 8 as int))")).alias("v")).toArrow()
    table = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    table[byte.column("b").to_numpy()] = byte.column("v").to_numpy().astype(np.uint8)
    return table.tobytes()


def scan(docs: DataFrame, windows: DataFrame, span: int = SPAN, k: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row long, doc_id, n_words long, hits array of (pos, len, fp, ctx)), one row a document, as a written table.

    A hit is a document fingerprint that the benchmark's filter lets through: a k-gram at ``pos`` with the words around
    it, or for short items a run of ``len`` words. ``row`` tells repeated rows apart.
    """
    lengths = sorted(r["len"] for r in windows.where(F.col("len") < span).select("len").distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(windows))
    back = span - k

    def run(batches):
        table = np.frombuffer(sent.value, np.uint8)

        def passed(fps: np.ndarray) -> np.ndarray:
            s = _slot(fps)
            return np.flatnonzero(table[s >> 3] >> (s & 7).astype(np.uint8) & 1)

        ctx = pa.list_(pa.string())
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("len", pa.int32()), ("fp", pa.int64()), ("ctx", ctx)]))
        for b in (b.slice(s, 512) for b in batches for s in range(0, b.num_rows, 512)):
            counts, hits = [], []
            for text in octets(b.column(1)):
                w = words_of(text)
                h, own = hashes(w), []
                counts.append(len(w))
                fps, at = winnow(h, span, k)
                new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
                for x in passed(fps[new]):
                    p = int(at[new[x]])
                    around = [w[q].decode() if 0 <= q < len(w) else None for q in range(p - back, p + span)]
                    own.append({"pos": p, "len": span, "fp": int(fps[new[x]].view(np.int64)), "ctx": around})
                for n in lengths:
                    g = gram_hashes(h, n)
                    own += [{"pos": int(p), "len": n, "fp": int(g[p].view(np.int64)), "ctx": [y.decode() for y in w[p : p + n]]} for p in passed(g)]
                hits.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(hits, kind)], names=["doc_id", "n_words", "hits"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, hits array<struct<pos:int,len:int,fp:long,ctx:array<string>>>"
    return stored(docs.select(id_col, text_col).mapInArrow(tidied(run), schema).withColumn("row", F.monotonically_increasing_id()), "scanned")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = GRAM, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row: (row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    ``n_hit`` counts the words inside any occurrence of an item's window, ``n_items`` the items with such windows.
    Fingerprints are joined, then each candidate window is compared as text; the benchmark's windows are sent to all tasks
    if their counted number allows it, so that a window that very many documents hold is no key of a shuffle. Null or empty texts have no words; null item
    ids are left out; items that repeat an id count once; without items nothing is hit. The hash of no items is that of
    the empty string. Very long texts are read whole; repeated rows each give a row; further columns are left out.
    """
    windows = stored(benchmark_windows(items, span, k), "windows")
    found = scan(docs, windows, span, k, id_col, text_col)
    hits = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    forms = sendable(stored(windows.select("fp", "off", F.col("len").alias("n"), "win").distinct(), "forms"), _SENT)
    first = F.when(F.col("len") < span, F.lit(1)).otherwise(F.lit(span - k + 1) - F.col("off"))
    same = F.array_join(F.slice("ctx", first, F.col("len")), " ") == F.col("win")
    places = stored(hits.join(forms, "fp").where((F.col("len") == F.col("n")) & same).select("row", (F.col("pos") - F.col("off")).alias("start"), "len", "win").distinct(), "places")
    covered = places.select("row", F.explode(F.expr("sequence(start, start + len - 1)")).alias("w")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    in_doc = places.select("row", "win").distinct().join(sendable(stored(windows.select("win", "item_id").distinct(), "items"), _SENT), "win").select("row", F.col("item_id").cast("string").alias("i")).distinct()
    named = in_doc.groupBy("row").agg(F.array_sort(F.collect_set("i")).alias("ids"))
    out = found.drop("hits").join(covered, "row", "left").join(named, "row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_items = F.size(ids).cast("long")
    return out.select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, min_items: int = 2, max_share: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose document is not contaminated: windows of ``min_items`` items, or ``max_share`` hit words.

    Documents are told apart by id: rows with a null id stay, rows that repeat an id all stay or all go.
    """
    c = contamination(docs, items, min_items=min_items)
    bad = F.col("contaminated") if max_share is None else F.col("contaminated") | (F.col("n_hit") > max_share * F.col("n_words"))
    gone = stored(c.where(bad).where("doc_id is not null").select("doc_id").distinct(), "gone")
    return without(docs, gone, {"doc_id": docs["doc_id"]})
