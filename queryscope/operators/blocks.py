"""Rankings compared block by block: how many items two of them share, without a row for each pair in any shuffle.

Rankings are dealt, in order of their queries, to blocks of at most ``BLOCK``; every two blocks meet in one task, which counts
common items for some rows of one block against all of the other at a time and gives back what is asked for: the pairs, a
forest of links, the numbers of neighbours, or the most that two clusters share. A ranking is shuffled once for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscope.sources.shared import ranked, stored

#: Most and fewest rankings of a block; about ten blocks are made between.
BLOCK, LEAST_BLOCK = 8192, 256
#: Most cells (rankings x rankings) counted at once.
CELLS = 1 << 20
#: Most different items of two blocks for which counts come from a matrix product.
PRODUCT = 512
#: Most rankings that copies of one ranking are paired with at a time; a multiple of 8, the values that Parquet packs together.
RUN = 128
#: Fewest pairs of a batch, but for the last.
BATCH = 1 << 17


def _by_count(common: Column, depth: int, exact: Callable[[int], float], formula: Column) -> Column:
    """``formula`` of common items, rounded half up to six places; looked up by ``exact`` as far as counts are within the depth."""
    places = [float(Decimal(repr(exact(c))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for c in range(depth + 1)]
    known = F.element_at(F.array(*[F.lit(x) for x in places]), (common + 1).cast("int"))
    return F.when(common <= depth, known).otherwise(F.round(formula, 6))


def distance(common: Column, depth: int) -> Column:
    """1 - common / depth, rounded half up to six places."""
    return _by_count(common, depth, lambda c: 1 - c / depth, 1 - common / depth)


def share(common: Column, depth: int) -> Column:
    """common / depth, rounded half up to six places."""
    return _by_count(common, depth, lambda c: c / depth, common / depth)


class Rankings:
    """Rankings (query_id, item), written once; ``crowded`` if blocks shuffle fewer rows than a join by items would."""

    def __init__(self, serp: DataFrame, held: bool = False):
        self.rows = stored(serp.select("query_id", "item").where("query_id is not null and item is not null"), "rankings")
        self.held = held
        n = F.col("n").cast("double")
        self.count = self.rows.select("query_id").distinct().count()
        joined = self.rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0.0
        self.block = max(LEAST_BLOCK, min(BLOCK, -(-self.count // 10)))
        self.blocks = -(-self.count // self.block)
        self.crowded = self.count * self.blocks < joined

    def only(self, ids: DataFrame) -> Rankings:
        """The rankings of the queries (query_id)."""
        return Rankings(self.rows.join(ids, "query_id", "left_semi"), self.held)

    def meet(self, task: Callable, schema: str, labels: DataFrame | None = None, alike: bool = False) -> DataFrame:
        """``task`` (a, b, whether they are one block, counts by rows of a) for every two blocks; ``labels`` is (query_id, label).

        ``alike``: rankings are dealt in order of their items, so that equal ones stand side by side, not of their queries.
        """
        lists = self.rows.groupBy("query_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
        if labels is not None:
            lists = lists.join(labels, "query_id")
        placed = ranked(lists, *[F.asc("items")] * alike, F.asc("query_id"), name="place").withColumn("block", F.floor((F.col("place") - 1) / self.block))
        rows = F.array_sort(F.collect_list(F.struct("place", *lists.columns)))
        blocks = stored(placed.groupBy("block").agg(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in lists.columns])).alias("rows")), "blocks")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.blocks - 1).cast("long"))).alias("other")
        two = blocks.select("block", "rows", other).select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rows")
        meetings = max(1, self.blocks * (self.blocks + 1) // 2)
        held = self.held

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, a = None, None
            for batch in batches:
                for x, y, block, b in zip(*(batch[c].to_pylist() for c in ("x", "y", "block")), batch["rows"]):
                    if block == x:
                        at, a = (x, y), b.values
                    if block == y and at == (x, y):
                        yield from task(a, b.values, x == y, lambda a=a, b=b.values: counts(a, b, held))

        return two.repartitionByRange(min(meetings, 20_000), "x", "y").sortWithinPartitions("x", "y", "block").select("x", "y", "block", "rows").mapInArrow(run, schema)


def counts(a: pa.StructArray, b: pa.StructArray, held: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, common items of some rows of ``a`` with all rows of ``b``); ``held``: repeats within a row of ``a`` count once."""
    n_a, n_b = len(a), len(b)
    row_a, row_b = (np.repeat(np.arange(len(x)), x.field("items").value_lengths().to_numpy(zero_copy_only=False)) for x in (a, b))
    codes = pa.concat_arrays([a.field("items").flatten(), b.field("items").flatten()]).dictionary_encode()
    code, m = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(codes.dictionary)
    code_a, code_b = code[: len(row_a)], code[len(row_a) :]
    if held and len(row_a):
        row_a, code_a = np.divmod(np.unique(row_a * m + code_a), m)
    step = max(1, CELLS // max(n_b, 1))
    if m <= PRODUCT:
        whole = np.bincount(row_b * m + code_b, minlength=n_b * m).reshape(n_b, m).astype(np.float32).T.copy()
        for lo in range(0, n_a, step):
            part = slice(*np.searchsorted(row_a, (lo, lo + step)))
            rows = min(step, n_a - lo)
            some = np.bincount((row_a[part] - lo) * m + code_a[part], minlength=rows * m).reshape(rows, m).astype(np.float32)
            yield lo, some @ whole
        return
    order = np.argsort(code_b, kind="stable")
    by_item, often = row_b[order], np.bincount(code_b, minlength=m)
    first = np.cumsum(often) - often
    for lo in range(0, n_a, step):
        begin, end = np.searchsorted(row_a, (lo, lo + step))
        rows = min(step, n_a - lo)
        out = np.zeros(rows * n_b, np.int32)
        much = np.cumsum(often[code_a[begin:end]])
        while begin < end:  # about CELLS meetings of equal items at a time, one item's at least
            done = much[len(much) - (end - begin) - 1] if end - begin < len(much) else 0
            stop = begin + max(1, int(np.searchsorted(much[len(much) - (end - begin) :], done + 2 * CELLS, "right")))
            c, r = code_a[begin:stop], row_a[begin:stop] - lo
            size = often[c]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first[c], size)
            out += np.bincount(np.repeat(r * n_b, size) + by_item[at], minlength=rows * n_b).astype(np.int32)
            begin = stop
        yield lo, out.reshape(rows, n_b)


def _kind(rankings: Rankings) -> str:
    return rankings.rows.schema["query_id"].dataType.simpleString()


class _Placed(NamedTuple):
    """Rows of a block and the places of their queries in the order of all."""

    rows: pa.StructArray
    at: np.ndarray


def runs(rows: pa.StructArray) -> np.ndarray:
    """First places of the runs of rows that hold the same items."""
    items = rows.field("items")
    size = items.value_lengths().to_numpy(zero_copy_only=False)
    code = items.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    other = np.bincount(row[code != code[np.arange(len(code)) - size[row]]], minlength=len(size)) > 0
    other[1:] |= size[1:] != size[:-1]
    other[0] = True
    return np.flatnonzero(other)


def _crossed(xs: np.ndarray, ys: np.ndarray, later: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of ``xs`` with the lesser of the sorted ``ys``, upwards (not if ``later``), then with the greater ones, downwards."""
    z = ys[::-1] if later else np.concatenate([ys, ys[::-1]])
    down = np.arange(len(z)) >= len(z) - len(ys)
    step = max(1, CELLS // len(z))
    for lo in range(0, len(xs), step):
        x = xs[lo : lo + step, None]
        keep = np.where(down, z > x, z < x)
        yield np.repeat(x[:, 0], np.count_nonzero(keep, axis=1)), np.broadcast_to(z, keep.shape)[keep]


def _paired(xs: np.ndarray, ys: np.ndarray, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, common): equal rankings ``xs`` with all others of the sorted ``ys``.

    Pairs come by common items and by runs of ``ys`` that the next of ``xs`` repeats, so that a columnar file holds little more
    than one run for all copies of a ranking.
    """
    if len(xs) == 1:
        order = np.argsort(2 * common + (ys > xs[0]), kind="stable")
        yield np.full(len(ys), xs[0]), ys[order], common[order]
        return
    order = np.argsort(common, kind="stable")
    ys, common = ys[order], common[order]
    ends = np.flatnonzero(np.diff(common)) + 1
    for lo, hi in zip([0, *ends], [*ends, len(ys)]):
        for k in range(lo, hi, RUN):
            for x, y in _crossed(xs, ys[k : min(k + RUN, hi)]):
                yield x, y, np.full(len(x), common[lo])


def pairs(rankings: Rankings, least: int = 1) -> DataFrame:
    """(i, j, common) of queries i < j with at least ``least`` common items; equal rankings of two blocks are compared once."""
    kind = _kind(rankings)

    def expanded(a, b, same, counted):
        """(x, y, common) by places in the order of all queries."""
        first_a, first_b = runs(a.rows), runs(b.rows)
        order = np.argsort(b.at)
        ys, of = b.at[order], (np.searchsorted(first_b, np.arange(len(b.at)), "right") - 1)[order]
        ends = np.append(first_a[1:], len(a.at))
        for lo, c in counted(a.rows.take(pa.array(first_a)), b.rows.take(pa.array(first_b))):
            c = c.astype(np.uint16 if c.max(initial=0) < 1 << 15 else np.int64)
            for p, row in enumerate(c, lo):
                xs, common = np.sort(a.at[first_a[p] : ends[p]]), row[of]
                if same and len(xs) > 1 and row[p] >= least:
                    for k in range(0, len(xs), RUN):
                        for x, y in _crossed(xs, xs[k : k + RUN], later=True):
                            yield x, y, np.full(len(x), row[p])
                met = common >= least
                if same:
                    met &= of > p
                if met.any():
                    yield from _paired(xs, ys[met], common[met])

    def task(a, b, same, counted):
        ids = pa.concat_arrays([a.field("query_id"), b.field("query_id")])
        known = pc.unique(ids)
        known = known.take(pc.sort_indices(known))
        at = pc.index_in(ids, known).to_numpy(zero_copy_only=False).astype(np.int64)
        some, n = [], 0

        def batch():
            x, y, common = (np.concatenate(column) for column in zip(*some))
            return pa.RecordBatch.from_arrays([known.take(pa.array(np.minimum(x, y))), known.take(pa.array(np.maximum(x, y))), pa.array(common.astype(np.int32))], ["i", "j", "common"])

        for part in expanded(_Placed(a, at[: len(a)]), _Placed(b, at[len(a) :]), same, counted):
            some.append(part)
            n += len(part[0])
            if n >= BATCH:
                yield batch()
                some, n = [], 0
        if n:
            yield batch()

    # of keys that may repeat the first query's count once, so its block must be the first
    return rankings.meet(task, f"i {kind}, j {kind}, common int", alike=not rankings.held).select("i", "j", F.col("common").cast("long").alias("common"))


def join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (of each object, the smallest that it reaches) after edges i, j: ends take the least label, labels jump."""
    while len(i):
        i, j = label[i], label[j]
        apart = i != j
        i, j = i[apart], j[apart]
        if not len(i):
            break
        np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
        while (label != label[label]).any():
            label = label[label]
    return label


def links(rankings: Rankings, least: int = 1) -> DataFrame:
    """(i, j): edges, fewer than two for each ranking of two blocks, that join what pairs with ``least`` common items join."""
    kind = _kind(rankings)

    def task(a, b, same, counted):
        n = len(a)
        label = np.arange(n if same else n + len(b))
        for lo, c in counted():
            i, j = np.divmod(np.flatnonzero(c.ravel() >= least), len(b))
            label = join(label, i + lo, j if same else j + n)
        ids = a.field("query_id") if same else pa.concat_arrays([a.field("query_id"), b.field("query_id")])
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(label[moved])), ids.take(pa.array(moved))], ["i", "j"])

    return rankings.meet(task, f"i {kind}, j {kind}")


def degrees(rankings: Rankings) -> DataFrame:
    """(id, degree): how many others share an item with each query that has such."""
    kind = _kind(rankings)

    def task(a, b, same, counted):
        rows, columns = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for lo, c in counted():
            some = c > 0
            if same:
                some[np.arange(len(c)), np.arange(lo, lo + len(c))] = False
            rows[lo : lo + len(c)] += np.count_nonzero(some, axis=1)
            columns += np.count_nonzero(some, axis=0)
        yield pa.RecordBatch.from_arrays([a.field("query_id"), pa.array(rows)], ["id", "n"])
        if not same:
            yield pa.RecordBatch.from_arrays([b.field("query_id"), pa.array(columns)], ["id", "n"])

    return rankings.meet(task, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("degree")).where("degree > 0")


def between(rankings: Rankings, clusters: DataFrame) -> DataFrame:
    """(a, b, common): the most items that rankings of two clusters a < b of (obj_id, cluster) share, if any."""
    kind = clusters.schema["cluster"].dataType.simpleString()

    def task(a, b, same, counted):
        name_a, name_b = (x.field("label").dictionary_encode() for x in (a, b))
        known = pa.concat_arrays([name_a.dictionary, name_b.dictionary]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        at_a, at_b = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (name_a, name_b))
        in_a, in_b = known[: len(name_a.dictionary)][at_a], known[len(name_a.dictionary) :][at_b]
        wide = len(name_b.dictionary)
        best = np.zeros(len(name_a.dictionary) * wide, np.int32)
        for lo, c in counted():
            some = (c > 0) & (in_a[lo : lo + len(c), None] != in_b[None, :])
            at = np.flatnonzero(some.ravel())
            i, j = np.divmod(at, len(b))
            np.maximum.at(best, at_a[i + lo] * wide + at_b[j], c.ravel()[at].astype(np.int32))
        at = np.flatnonzero(best)
        for k in range(0, len(at), CELLS):
            i, j = np.divmod(at[k : k + CELLS], wide)
            yield pa.RecordBatch.from_arrays([name_a.dictionary.take(pa.array(i)), name_b.dictionary.take(pa.array(j)), pa.array(best[at[k : k + CELLS]])], ["a", "b", "common"])

    found = rankings.meet(task, f"a {kind}, b {kind}, common int", clusters.select(F.col("obj_id").alias("query_id"), F.col("cluster").alias("label")))
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("common").cast("long").alias("common"))
