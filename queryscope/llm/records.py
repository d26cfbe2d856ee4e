"""Length-delimited binary records of token ids, with checksums and a separate offset index.

Data file ``shard-N.bin``: one record after another, each
``length u64 | masked crc32(length) u32 | payload | masked crc32(payload) u32`` (little-endian). A payload is
``doc_id i64 | flags u8 | width u8 | ids``: flags 1 means a null doc_id, width is 2 or 4 bytes an id.
Index file ``shard-N.idx``: ``magic 8 bytes | records u64 | masked crc32 of the entries u32 | entries``, an entry being
``doc_id i64 | flags u8 | offset u64 | n_tokens u64``, in file order: a reader can shuffle records without a scan.
Checksums are CRC-32, rotated right by 15 bits plus a constant, so that a checksum of data with checksums stays useful.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.llm.common import keep, open_fs, put, putting, scratch, stored, tidied

MAGIC = b"QSIDX\x00\x00\x01"
ENTRY = np.dtype([("doc_id", "<i8"), ("flags", "u1"), ("offset", "<u8"), ("n_tokens", "<u8")])
#: Cached pieces of text in a worker, of at most so many characters each; when full, the cache starts anew.
_CACHE, _LONGEST = 300_000, 64
#: Cached words of pieces in a worker.
_WORDS = 400_000
#: Printable ASCII and Latin letters, for which lower-casing goes character by character and normal form C changes nothing.
_PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u024f]*").fullmatch
#: Fixed pattern: the words that the tokenizer of this kind makes of a piece.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD = regex.compile(_PATTERN).findall
#: How byte-level models spell the letters of _PLAIN outside ASCII: bytes that Latin-1 does not print move up from 256.
_MOVED = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_SPELLED = {c: "".join(chr(256 + _MOVED.index(b) if b in _MOVED else b) for b in chr(c).encode()) for c in {ord(y) for x in range(0xA1, 0x250) for y in chr(x) + chr(x).lower()}}
_TOKENIZERS: dict[str, Encoder] = {}


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(stream) -> Iterator[bytes]:
    """Payloads of a stream of records; a cut or damaged record is an error."""
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise ValueError("damaged record length")
        n = struct.unpack("<Q", head[:8])[0]
        payload, tail = stream.read(n), stream.read(4)
        if len(payload) < n or len(tail) < 4 or struct.unpack("<I", tail)[0] != masked(payload):
            raise ValueError("damaged record")
        yield payload


def read_at(uri: str, offset: int) -> bytes:
    """The payload of the one record at an offset of the index."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return next(unframe(f))


def payload_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags, width = struct.unpack_from("<qBB", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=10).astype(np.uint32)


class Encoder(dict):
    """Token ids of whole texts by the tokenizers library; as a dict, the ids (bytes) of white-space-separated pieces.

    A piece is encoded when first looked up. Valid for tokenizers that read any run of white space as one separator and
    never join pieces across it (checked by ``piecewise`` on the file's own settings); others encode each text as it is.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.ids = [i.to_bytes(self.width, "little") for i in range(size)]
        settings = json.loads(self.tok.to_str())
        self.pieces = self.piecewise(settings)
        self.by_word = self.pieces and self.wordwise(settings)
        self.words: dict[str, bytes] = {}

    def piecewise(self, j: dict) -> bool:
        pre = j["pre_tokenizer"] or {}
        split = (pre.get("pretokenizers") or [pre])[0]
        self.pattern = (split.get("pattern") or {}).get("Regex", "") if isinstance(split.get("pattern"), dict) else ""
        drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and r"[^\s" in self.pattern
        plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or any(c.isspace() for c in a["content"]) for a in j["added_tokens"])
        return bool(drops and plain and "Prepend" not in json.dumps(j["normalizer"]) and j["post_processor"] is None)

    def wordwise(self, j: dict) -> bool:
        """Whether plain pieces can go to the library's model word by word: lower-cased, cut as _WORD does, as bytes."""
        steps = [n["type"] for n in (j["normalizer"] or {}).get("normalizers", [])]
        parts = (j["pre_tokenizer"] or {}).get("pretokenizers", [])
        bytewise = [p["type"] for p in parts] == ["Split", "ByteLevel"] and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
        special = all(a["content"].startswith("<|") for a in j["added_tokens"])
        return steps == ["NFC", "Replace", "Lowercase"] and self.pattern == _PATTERN and bytewise and special

    def many(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, ``width`` bytes each."""
        if not self.pieces:
            return [self._encoded(t) for t in texts]
        if len(self) > _CACHE:
            self.clear()
        if len(self.words) > _WORDS:
            self.words.clear()
        get = self.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").replace("\t", " ").split(" "))) for t in texts]

    def forget(self) -> None:
        self.clear()
        self.words.clear()

    def _encoded(self, text: str) -> bytes:
        return b"".join([self.ids[i] for i in self.tok.encode(text, add_special_tokens=False).ids])

    def __missing__(self, piece: str) -> bytes:
        if self.by_word and (piece.isascii() and piece.isprintable() or _PLAIN(piece)) and "<|" not in piece:
            low = piece.lower()
            if low.isalpha():
                found = self._word(low)
            elif low[:-1].isalpha():
                found = self._word(low[:-1]) + self._word(low[-1])
            else:
                found = b"".join(map(self._word, _WORD(low)))
        else:
            found = self._encoded(piece)
        if len(piece) <= _LONGEST:
            self[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            spelled = word if word.isascii() else word.translate(_SPELLED)
            found = b"".join([self.ids[t.id] for t in self.tok.model.tokenize(spelled)])
            if len(word) <= _LONGEST:
                self.words[word] = found
        return found


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    keep("encoder", _forget)
    return _TOKENIZERS[path]


def _forget() -> None:
    for enc in _TOKENIZERS.values():
        enc.forget()


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, rows_per_shard: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts (null: empty) in ascending id order and write them as shards with indexes.

    Returns the manifest (shard int, data string, index string, n_docs long, n_tokens long, first long), one row a
    shard: range partitions of the id and a hash of the text, so that shards follow one another and different texts of one
    id, or of none, can be dealt to several; empty ones write nothing. Null ids come first; rows that repeat an id each
    give a record. Records go to the file as they are made; a task keeps its index entries, 25 bytes a record. File names are unique to the call, and a repeated task writes the same
    bytes to the same names. ``tokenizer`` is a path that exists on every machine.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "records")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // rows_per_shard))
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text")).repartitionByRange(shards, F.col("doc_id"), F.col("h")).sortWithinPartitions("doc_id", "h", "text").drop("h")

    def run(batches):
        shard, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        end = enc.ids[end_id]
        names = [f"{folder}/shard-{shard:06d}.{x}" for x in ("bin", "idx")]
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        entries, offset = [], 0
        with putting(names[0]) as data:
            for b in chain([first], batches):
                for s in range(0, b.num_rows, 256):
                    ids, texts = (b.column(c).slice(s, 256).to_pylist() for c in range(2))
                    for doc_id, body in zip(ids, enc.many([t or "" for t in texts]), strict=True):
                        flags = int(doc_id is None)
                        record = frame(struct.pack("<qBB", doc_id or 0, flags, enc.width) + body + end)
                        entries.append(struct.pack("<qBQQ", doc_id or 0, flags, offset, (len(body) + len(end)) // enc.width))
                        data.write(record)
                        offset += len(record)
        table = b"".join(entries)
        put(names[1], MAGIC, struct.pack("<QI", len(entries), masked(table)), table)
        held = np.frombuffer(table, ENTRY)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "data": names[0], "index": names[1], "n_docs": len(held), "n_tokens": int(held["n_tokens"].sum()), "first": int(held["doc_id"][0])}], schema=pa.schema([("shard", pa.int32()), ("data", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first", pa.int64())]))

    return stored(ordered.mapInArrow(tidied(run, "encoder"), "shard int, data string, index string, n_docs long, n_tokens long, first long"), "manifest")


def read_index(uri: str) -> np.ndarray:
    """The checked entries of an index file."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as f:
        head, table = f.read(20), f.read()
    n, crc = struct.unpack("<QI", head[8:])
    if head[:8] != MAGIC or crc != masked(table) or len(table) != n * ENTRY.itemsize:
        raise ValueError("damaged index")
    return np.frombuffer(table, ENTRY)


def read_records(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read shards back: (doc_id, start long, n_tokens long, ids_crc32 long, shard int, offset long, ids binary as u32).

    Without ``with_ids`` the ids are read and checked all the same but the column is null.

    ``start`` counts the ids of all documents before one: those of earlier shards, by a running sum over one manifest row
    a shard, and those before it in its own. Every record is checked against its checksums and its index entry.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    todo = manifest.withColumn("before", before)
    shards = todo.repartition(max(1, todo.count()), "shard")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                start, entries = row["before"], read_index(row["index"])
                fs, path = open_fs(row["data"])
                with fs.open_input_stream(path, buffer_size=1 << 20) as f:
                    out = []
                    for entry, payload in zip(entries, unframe(f), strict=True):
                        doc_id, ids = payload_ids(payload)
                        if len(ids) != entry["n_tokens"] or (doc_id or 0) != entry["doc_id"]:
                            raise ValueError("index and data differ")
                        raw = ids.astype("<u4").tobytes()
                        out.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(raw), "shard": row["shard"], "offset": int(entry["offset"]), "ids": raw if with_ids else None})
                        start += len(ids)
                        if len(out) == 256:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return shards.select("shard", "data", "index", "before").mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, offset long, ids binary")
