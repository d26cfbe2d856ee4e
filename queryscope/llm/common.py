"""What the operators of this package share: tables and files in the cluster's shared folder, and word hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.sources.shared import scratch, sendable, shared_root, stored

__all__ = ["among", "gram_hashes", "hashes", "keep", "octets", "open_fs", "put", "putting", "scratch", "sendable", "shared_root", "shingle_views", "stored", "tidied", "without"]

_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: What a worker keeps between tasks, by name, as functions that drop it.
_KEPT: dict[str, Callable[[], None]] = {}
#: glibc's way to return freed memory to the system; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def among(df: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of ``df`` with a stored table that is counted first, so that texts are not shuffled to meet a few rows."""
    return df.join(sendable(wanted), on)


def without(df: DataFrame, gone: DataFrame, on: dict) -> DataFrame:
    """The rows of ``df`` that the stored table ``gone`` does not name; ``on`` gives the column of ``df`` for each of its columns.

    Columns of ``df`` keep their names whatever they are.
    """
    named = sendable(gone.select(*[F.col(c).alias(f"__gone_{k}") for k, c in enumerate(on)]))
    match = None
    for k, column in enumerate(on.values()):
        test = column == named[f"__gone_{k}"]
        match = test if match is None else match & test
    return df.join(named, match, "left_anti")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def putting(uri: str) -> Iterator[pa.NativeFile]:
    """A stream to a file that appears whole or not at all: a retried or speculative task repeats the same bytes under a name of its own."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(part) as out:
            yield out
    except BaseException:
        fs.delete_file(part)
        raise
    fs.move(part, path)


def put(uri: str, *chunks: bytes) -> None:
    with putting(uri) as out:
        for chunk in chunks:
            out.write(chunk)


def keep(name: str, drop: Callable[[], None]) -> None:
    """Have ``drop`` called before this worker's next task of an operator that does not use what is kept as ``name``."""
    _KEPT[name] = drop


def _leave(name: str | None) -> None:
    for other in [x for x in _KEPT if x != name]:
        _KEPT.pop(other)()


def _give_back() -> None:
    """Return freed memory to the system, which Arrow's pool and the C library hold back otherwise."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def tidied(run: Callable[[Iterator], Iterator], name: str | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` (batches to batches) as a task of a worker that lives as long as the session and passes from stage to stage.

    What other operators keep in the worker goes first, unless ``run`` uses it as ``name``; the task's own memory goes last.
    """

    def wrapped(batches):
        _leave(name)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def octets(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column's values; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def hashes(pieces, seed: int = 0) -> np.ndarray:
    """XXH64 of byte strings as unsigned 64-bit integers."""
    digest = xxhash.xxh64_digest
    if seed:
        return np.frombuffer(b"".join([digest(x, seed) for x in pieces]), dtype=">u8").astype(np.uint64)
    return np.frombuffer(b"".join(map(digest, pieces)), dtype=">u8").astype(np.uint64)


def shingle_views(words: list[bytes], n: int):
    """The space-joined runs of ``n`` words, repeats included; the whole sequence if it is shorter, nothing if empty."""
    if len(words) < n:
        return [b" ".join(words)] if words else []
    text = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [text[a:b] for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * _MULT
        h ^= h >> np.uint64(31)
    return h * _STEP
