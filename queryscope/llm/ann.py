"""Approximate nearest neighbours by inner product: multi-index hashing over learned rotated binary codes.

Taking the same vector from all candidates changes no query's ranking, so codes are signs of the centred candidates, and
of the query as it is, under several learned rotations: their Hamming distance then follows the angle that decides the
inner product among candidates of like length. Each block of the index is cut into shells of like length, longest first.
A shell keeps, for every substring of the codes, its rows sorted by that substring. A code within Hamming distance r of
the query's agrees with it within floor(r / m) bits in one of the m substrings (pigeonhole), so probing those buckets
finds every such code. The radius is where the angle lies that a candidate of the shell needs to beat the worst neighbour
found, plus a margin for what signs say of angles; the original vectors rank what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queryscope.llm.common import sendable, stored

#: Widest substring.
_SUB = 16
#: Least rows of a shell but the last, and greatest ratio of lengths within one.
_SHELL_ROWS, _SHELL_RATIO = 256, 1.2


def learn(sample: np.ndarray, rotations: int = 2, iterations: int = 15, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix d x bits): rotations of the principal axes that bring the sample's directions nearest to their own signs."""
    d = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
    x = sample - mean
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = x / np.where(length > 0, length, 1)
    axes = np.linalg.svd(x, full_matrices=False)[2] if len(x) >= d else np.eye(d)
    v, rng, out = x @ axes.T, np.random.default_rng(seed), []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(iterations if len(x) >= d else 0):
            b = np.sign(v @ r)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        out.append(axes.T @ r)
    return mean, np.concatenate(out, axis=1)


@lru_cache(maxsize=None)
def rings(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``width`` bits in order of their number of ones, and where each number begins."""
    ones = np.bitwise_count(np.arange(1 << width, dtype=np.uint32))
    return np.argsort(ones, kind="stable").astype(np.uint32), np.searchsorted(np.sort(ones), np.arange(width + 2))


class Codes:
    """Binary codes as whole words, for distances, and as substrings of about ``width`` bits, for probes."""

    def __init__(self, bits: np.ndarray, width: int):
        total = bits.shape[1]
        self.bits = total
        self.words = np.packbits(np.pad(bits, ((0, 0), (0, -total % 64))), axis=1).view(np.uint64)
        parts = np.array_split(bits.astype(np.uint32), max(-(-total // _SUB), round(total / width)), axis=1)
        self.widths = [part.shape[1] for part in parts]
        self.parts = [part @ (1 << np.arange(part.shape[1], dtype=np.uint32)) for part in parts]


class Shell:
    """Rows of like length: ids, vectors, codes, and for each substring the rows in order of its value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lengths: np.ndarray, bits: np.ndarray):
        self.ids, self.x, self.longest = ids, x, float(lengths.max())
        self.width = int(np.clip(round(np.log2(max(len(ids), 2))), 4, _SUB))
        self.codes = Codes(bits, self.width)
        self.tables = []
        for part, width in zip(self.codes.parts, self.codes.widths, strict=True):
            self.tables.append((np.searchsorted(np.sort(part), np.arange((1 << width) + 1)), np.argsort(part, kind="stable")))


class Probe:
    """The rows of a shell within a growing radius of a query's code: each bucket is looked up once at most."""

    def __init__(self, shell: Shell, query: Codes):
        self.shell, self.query = shell, query
        self.done = [-1] * len(shell.tables)
        self.hit, self.radius = np.zeros(len(shell.ids), bool), -1
        self.rows, self.distance = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def within(self, radius: int) -> np.ndarray:
        """Rows whose codes lie within ``radius``: probed by substring, then verified on the whole code."""
        self.radius = radius
        whole, extra = divmod(radius, len(self.done))
        found = []
        for j, (starts, rows) in enumerate(self.shell.tables):
            #: the first radius mod m + 1 substrings may differ in one bit more than the others
            allowed = min(whole if j <= extra else whole - 1, self.query.widths[j])
            if allowed > self.done[j]:
                values, at = rings(self.query.widths[j])
                keys = values[at[self.done[j] + 1] : at[allowed + 1]] ^ self.query.parts[j][0]
                first = starts[keys]
                lengths = starts[keys + 1] - first
                step = np.repeat(first - np.cumsum(lengths) + lengths, lengths)
                found.append(rows[step + np.arange(len(step))])
                self.done[j] = allowed
        if found:
            hit = self.hit.copy()
            for rows in found:
                hit[rows] = True
            new = np.flatnonzero(hit & ~self.hit)
            self.hit, self.rows = hit, np.concatenate((self.rows, new))
            self.distance = np.concatenate((self.distance, distances(self.shell.codes.words[new], self.query)))
        return self.rows[self.distance <= radius]


def distances(words: np.ndarray, query: Codes) -> np.ndarray:
    return np.bitwise_count(words ^ query.words).sum(axis=1, dtype=np.int64)


class Block:
    """A part of the index: shells of like length, longest first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, mean: np.ndarray, matrix: np.ndarray):
        centred = x - mean
        lengths = np.sqrt((centred * centred).sum(axis=1))
        order = np.lexsort((ids, -lengths))
        self.mean, self.matrix, self.shells, self.probed, start = mean, matrix, [], 0, 0
        while start < len(order):
            end = max(start + _SHELL_ROWS, int(np.searchsorted(-lengths[order], -lengths[order[start]] / _SHELL_RATIO, side="right")))
            if len(order) - end < _SHELL_ROWS:
                end = len(order)
            own = order[start:end]
            self.shells.append(Shell(ids[own], x[own], lengths[own], centred[own] @ matrix > 0))
            start = end
        words = np.concatenate([shell.codes.words for shell in self.shells])
        self.n, self.sample = len(words), words[:: max(1, len(words) // 1024)]

    def search(self, query_id, q: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, inner products) of the best k rows found but the query's own, ties to smaller ids.

        Shells are probed, longest first, with a radius that about 2 k codes lie within, widened until k rows are found;
        then each with the radius that its longest row would need to be among them.
        """
        length, shift, bits = float(np.sqrt(q @ q)), float(q @ self.mean), q[None, :] @ self.matrix > 0
        queries = {shell.width: Codes(bits, shell.width) for shell in self.shells}
        probes = [Probe(shell, queries[shell.width]) for shell in self.shells]
        total, whole = bits.shape[1], next(iter(queries.values()))
        near = np.sort(distances(self.sample, whole))
        radius = int(near[min(len(near) - 1, 2 * k * len(near) // self.n)])
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        while True:
            for probe in probes:
                if len(ids) < k:
                    ids, scores = self._best(ids, scores, probe.shell, probe.within(radius), query_id, q, k)
            if len(ids) == k or radius == total:
                break
            radius = min(total, radius + max(1, total // 64))
        for probe in probes:
            needed = (scores[-1] - shift) / (length * probe.shell.longest) if len(ids) == k and probe.shell.longest > 0 else 2.0
            if needed > 1:
                break
            p = np.arccos(max(needed, -1.0)) / np.pi
            wider = min(total, int(np.ceil(total * p + margin * np.sqrt(total * p * (1 - p)))))
            if wider > probe.radius:
                ids, scores = self._best(ids, scores, probe.shell, probe.within(wider), query_id, q, k)
        self.probed += sum(len(probe.rows) for probe in probes)
        return ids, scores

    @staticmethod
    def _best(ids, scores, shell: Shell, rows: np.ndarray, query_id, q: np.ndarray, k: int):
        rows = rows[(shell.ids[rows] != query_id) & ~np.isin(shell.ids[rows], ids)]
        ids, scores = np.concatenate((ids, shell.ids[rows])), np.concatenate((scores, (shell.x[rows] * q).sum(axis=1)))
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with a non-null id and a non-zero vector of finite, non-null components, as (vec_id long, v array<double>)."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))


def _once(rows: DataFrame) -> DataFrame:
    """One row an id; of different vectors the smallest. Only the rows of repeated ids are gathered by id."""
    again = stored(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated")
    if again.isEmpty():
        return rows
    again = sendable(again)
    one = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return stored(rows.join(again, "vec_id", "left_anti").unionByName(one), "vectors")


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(vectors: DataFrame, every: int = 20, k: int = 20, margin: float = 1.0, block_rows: int = 16_384, query_rows: int = 8192, max_sample: int = 20_000, rotations: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank int from 1, vec_id, score double): for each row whose id is divisible by ``every`` its k best others.

    Nearness is the inner product in double precision, ties to smaller ids. The rotations are learned on the
    ``max_sample`` rows of least hashed id (only the fit is bounded; every row is indexed). The query set meets all rows
    in blocks: an index block of about ``block_rows`` rows and a chunk of about ``query_rows`` queries to a task, so
    memory is bounded; each block returns k rows a query, which a ranking merges. ``margin`` is in standard deviations of
    a code's distance at a given angle.

    Vectors that are null, zero, or hold null or non-finite components take no part; vectors meet those of their own
    number of components, each of which has an index of its own. Rows that repeat an id count once, with the smallest of
    different vectors. A query gets fewer than k rows only if there are fewer others. An empty table gives no rows;
    further columns are left out.
    """
    spark = vectors.sparkSession
    rows = _once(stored(usable(vectors, id_col, vec_col), "vectors"))
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = [_neighbours(rows.where(F.size("v") == d), d, n, every, k, margin, block_rows, query_rows, max_sample, rotations) for d, n in sorted(sizes.items())]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _neighbours(rows: DataFrame, d: int, n: int, every: int, k: int, margin: float, block_rows: int, query_rows: int, max_sample: int, rotations: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block for each query, among vectors of ``d`` components."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).select("v").toArrow().column("v").combine_chunks()
    sent = rows.sparkSession.sparkContext.broadcast(learn(sample.values.to_numpy().reshape(-1, d), rotations))
    blocks = max(1, -(-n // block_rows))
    queries = rows.where(F.col("vec_id") % every == 0)
    chunks = max(1, -(-queries.count() // query_rows))

    def key(parts: int):
        return F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")

    index = rows.select(key(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), key(chunks).alias("chunk"), "vec_id", "v")

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = table.column("v").combine_chunks()
        return table.column("vec_id").to_numpy(), v.flatten().to_numpy().reshape(-1, d)

    def batches(block: Block, ids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(ids), 512):
            out = [block.search(i, v, k, margin) for i, v in zip(ids[s : s + 512], q[s : s + 512], strict=True)]
            yield pa.RecordBatch.from_arrays([np.repeat(ids[s : s + 512], [len(a) for a, _ in out]), np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])], schema=_FOUND)

    def matched(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        return pa.Table.from_batches(batches(Block(*arrays(left), *sent.value), *arrays(right)), _FOUND)

    return index.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(matched, "query_id long, vec_id long, score double")
