"""Near duplicates by SimHash fingerprints, linked with the generalised pigeonhole principle.

Correlated bits are grouped into partitions; each probing fingerprint spreads the allowed distance over the partitions
unequally, by dynamic programming on estimated candidate counts; equal partition values are joined and verified.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.llm.common import gram_hashes, hashes, octets, sendable, shingle_views, stored, tidied, without
from queryscope.llm.components import components

BITS = 64
_BLOCK = 8
#: Most probes that one partition may make for a fingerprint.
_MAX_FLIPS = 1 << 17
#: MinHash bands and the values in each: a pair of Jaccard similarity 0.8 shares none with probability 1.2e-7.
_BANDS, _ROWS = 40, 5
#: Most texts and shingles of a bucket's block; two blocks meet in one task's group.
_BLOCK_TEXTS, _BLOCK_SHINGLES = 512, 1 << 20


def fingerprint_of(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64; no words give zero."""
    pieces = shingle_views(words, shingle)
    return majority(len(pieces), (hashes(pieces[k : k + (1 << 15)], seed) for k in range(0, len(pieces), 1 << 15)))


def majority(n: int, blocks) -> int:
    """The bits that are set in over half of ``n`` hashes, which come in arrays."""
    counts = np.zeros(BITS, np.int64)
    for block in blocks:
        counts += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): fingerprints of whole texts, A-Z lower-cased, words split at ASCII white space.

    Null text counts as empty (fingerprint zero); rows with a null id keep it; further columns are left out.
    """

    def run(batches):
        for b in (b.slice(s, 512) for b in batches for s in range(0, b.num_rows, 512)):
            fps = [fingerprint_of(t.lower().split(), shingle) for t in octets(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"doc_id {kind}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    """n x 64 zeros and ones; column k is the bit of weight 2**k."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _correlations(fps: DataFrame) -> np.ndarray:
    """|correlation| of the bits over all fingerprints, from 64 x 64 co-occurrence counts summed in Spark."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for b in batches:
            x = _bits(b.column(0).to_numpy().view(np.uint64)).astype(np.float32)
            for k in range(0, len(x), 1 << 16):
                total += x[k : k + (1 << 16)].T @ x[k : k + (1 << 16)]
        i, j = np.indices((BITS, BITS)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(tidied(run), "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r["i"], r["j"]] = r["n"]
    n = max(1.0, fps.count())
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size: each starts at the most correlated free pair and takes the bits closest to it."""
    free, groups = set(range(len(corr))), []
    for k in range(m):
        size = len(free) // (m - k)
        order = sorted(free)
        sub = corr[np.ix_(order, order)].copy()
        np.fill_diagonal(sub, -1)
        group = [order[x] for x in np.unravel_index(int(sub.argmax()), sub.shape)] if size > 1 else order[:1]
        while len(group) < size:
            group.append(max(sorted(free - set(group)), key=lambda b: corr[b, group].mean()))
        groups.append(sorted(group))
        free -= set(group)
    return groups


def _flips(group: list[int], tau: int) -> list[np.ndarray]:
    """By threshold up to tau: the masks of at most so many bits of a group; thresholds of over ``_MAX_FLIPS`` are left out."""
    out, total = [], 0
    for t in range(tau + 1):
        total += comb(len(group), t)
        if total > _MAX_FLIPS:
            break
        new = [sum(1 << b for b in c) for c in combinations(group, t)]
        out.append(np.concatenate([*out[-1:], np.array(new, np.uint64)]))
    return out


class Plan:
    """Partitions, the histograms that candidate counts are estimated from, and the probes of a fingerprint."""

    def __init__(self, groups: list[list[int]], hist: dict[tuple[int, int], np.ndarray], n: int, tau: int):
        self.groups, self.tau, self.n = groups, tau, n
        self.masks = [sum(1 << b for b in g) for g in groups]
        self.blocks = [[g[k : k + _BLOCK] for k in range(0, len(g), _BLOCK)] for g in groups]
        self.hist = [[hist[i, k] for k in range(len(bl))] for i, bl in enumerate(self.blocks)]
        pop = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        #: by partition and block: share of all fingerprints at distance d from a block value
        self.near = [[np.stack([((pop == d) * hist[i, k][None, :]).sum(axis=1) for d in range(tau + 1)], axis=1) / max(n, 1) for k in range(len(bl))] for i, bl in enumerate(self.blocks)]
        self.flips = [_flips(g, tau) for g in groups]

    def _allot(self, dists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(thresholds n x m, work n): the least estimated work of thresholds from -1 to tau that sum to tau - m + 1.

        ``dists`` holds, by partition, n rows of the expected share of all fingerprints at each distance; work is probes
        plus candidates, infinite if no thresholds with enumerable flips reach the sum.
        """
        n, m, tau = len(dists[0]), len(self.groups), self.tau
        goal = tau - m + 1
        best = np.full((n, tau + m + 2), np.inf)  # over sums from -m to tau + 1
        best[:, m] = 0
        chosen = []
        for flips, dist in zip(self.flips, dists, strict=True):
            costs = {-1: np.zeros(n)} | {t: len(f) + self.n * dist[:, : t + 1].sum(axis=1) for t, f in enumerate(flips)}
            new, pick = np.full_like(best, np.inf), np.full(best.shape, -1, np.int8)
            for t, cost in costs.items():
                shifted = np.full_like(best, np.inf)
                if t < 0:
                    shifted[:, :-1] = best[:, 1:]
                else:
                    shifted[:, t:] = best[:, : best.shape[1] - t]
                total = shifted + cost[:, None]
                better = total < new
                new[better], pick[better] = total[better], t
            best = new
            chosen.append(pick)
        out, at, rows = np.zeros((n, m), np.int64), np.full(n, goal + m), np.arange(n)
        work = best[rows, at]
        for i in range(m - 1, -1, -1):
            out[:, i] = chosen[i][rows, at]
            at = at - out[:, i]
        return out, work

    def _spread(self, steps: list[np.ndarray]) -> np.ndarray:
        """Shares by distance of a partition from those of its blocks, which count as independent."""
        dist = np.zeros((len(steps[0]), self.tau + 1))
        dist[:, 0] = 1
        for step in steps:
            new = np.zeros_like(dist)
            for d in range(self.tau + 1):
                new[:, d:] += dist[:, : self.tau + 1 - d] * step[:, d : d + 1]
            dist = new
        return dist

    def work(self) -> float:
        """Estimated probes and candidates of an average fingerprint; infinite if the plan cannot reach tau."""
        shares = [[h / max(self.n, 1) for h in hs] for hs in self.hist]
        return float(self._allot([self._spread([(s @ near)[None, :] for s, near in zip(ss, ns, strict=True)]) for ss, ns in zip(shares, self.near, strict=True)])[1][0])

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """n x m thresholds from -1 to tau that sum to tau - m + 1 and have the least estimated work (probes + candidates)."""
        bits, dists = _bits(fps), []
        for i, blocks in enumerate(self.blocks):
            steps = []
            for k, block in enumerate(blocks):
                value = np.zeros(len(fps), np.int64)
                for w, b in enumerate(block):
                    value |= bits[:, b].astype(np.int64) << w
                steps.append(self.near[i][k][value])
            dists.append(self._spread(steps))
        return self._allot(dists)[0]

    def probes(self, fps: np.ndarray):
        """(partition, value, fingerprint, thresholds) arrays of all probes; thresholds + 1 take 4 bits a partition."""
        t = self.thresholds(fps)
        packed = np.zeros(len(fps), np.int64)
        for i in range(len(self.masks)):
            packed |= (t[:, i] + 1) << (4 * i)
        for i, mask in enumerate(self.masks):
            for k, flips in enumerate(self.flips[i]):
                own, own_t = fps[t[:, i] == k], packed[t[:, i] == k]
                for s in range(0, len(own), max(1, (1 << 18) // len(flips))):
                    part, part_t = (x[s : s + max(1, (1 << 18) // len(flips))] for x in (own, own_t))
                    keys = (part & np.uint64(mask))[:, None] ^ flips[None, :]
                    yield i, keys.ravel(), np.repeat(part, len(flips)), np.repeat(part_t, len(flips))


def make_plan(fps: DataFrame, tau: int, parts: int | None = None) -> Plan:
    """A plan over all rows of ``fps`` (fp long, distinct): of 1 to tau + 1 partitions (at most 15), the number that has
    the least estimated work, or ``parts``. One pass counts the histograms of all these numbers."""
    n = fps.count()
    corr = _correlations(fps)
    groups = {m: group_bits(corr, m) for m in ([parts] if parts else range(1, min(tau + 1, 15) + 1))}
    blocks = [(m, i, k, g[_BLOCK * k : _BLOCK * (k + 1)]) for m, gs in groups.items() for i, g in enumerate(gs) for k in range(-(-len(g) // _BLOCK))]

    def run(batches):
        hist = np.zeros((len(blocks), 256), np.int64)
        for b in batches:
            bits = _bits(b.column(0).to_numpy().view(np.uint64))
            for h, (*_, block) in zip(hist, blocks, strict=True):
                value = np.zeros(len(bits), np.int64)
                for w, bit in enumerate(block):
                    value |= bits[:, bit].astype(np.int64) << w
                h += np.bincount(value, minlength=256)
        at, v = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(hist[at, v])], names=["at", "v", "n"])

    hist = np.zeros((len(blocks), 256))
    for r in fps.select("fp").mapInArrow(tidied(run), "at int, v int, n long").groupBy("at", "v").agg(F.sum("n").alias("n")).collect():
        hist[r["at"], r["v"]] = r["n"]
    plans = [Plan(gs, {(i, k): h for h, (of, i, k, _) in zip(hist, blocks, strict=True) if of == m}, n, tau) for m, gs in groups.items()]
    return min(plans, key=Plan.work)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, tau: int = 2, parts: int | None = None, long_bucket: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp long) to all pairs (u < v) that differ in at most ``tau`` bits.

    A bucket of more than ``long_bucket`` fingerprints is split once more: pairs within ``tau`` agree on one of tau + 1
    blocks of the other bits, so bucket and block together are the key. That loses no pair.
    """
    plan = make_plan(fps, tau, parts)
    masks = plan.masks

    def run(batches):
        for b in batches:
            for i, keys, own, t in plan.probes(b.column(0).to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(own.view(np.int64)), pa.array(t)], names=["part", "key", "u", "t"])

    index = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mk))).alias("key"), F.col("fp").alias("v")) for i, mk in enumerate(masks)])).alias("x")).select("x.*")
    probes = fps.select("fp").mapInArrow(tidied(run), "part int, key long, u long, t long")
    keys = ["part", "key"]
    lengthy = stored(index.groupBy(*keys).count().where(F.col("count") > long_bucket).select(*keys), "lengthy")
    split_more = not lengthy.isEmpty()
    if split_more:
        rest = [[b for b in range(BITS) if not mk >> b & 1] for mk in masks]
        subs = F.array(*[F.array(*[F.lit(_signed(sum(1 << b for b in chunk))) for chunk in np.array_split(r, tau + 1)]) for r in rest])

        def split(df: DataFrame, own: str) -> DataFrame:
            df = df.join(lengthy.withColumn("lengthy", F.lit(True)), keys, "left")
            df = df.withColumn("sub", F.explode(F.when(F.col("lengthy"), F.sequence(F.lit(0), F.lit(tau))).otherwise(F.array(F.lit(-1)))))
            mask = F.when(F.col("sub") >= 0, F.element_at(F.element_at(subs, F.col("part") + 1), F.col("sub") + 1)).otherwise(F.lit(0))
            return df.withColumn("subkey", F.col(own).bitwiseAND(mask)).drop("lengthy")

        index, probes, keys = split(index, "v"), split(probes, "u"), [*keys, "sub", "subkey"]
    p, x = probes.alias("p"), index.alias("x")
    on = [F.col(f"p.{k}") == F.col(f"x.{k}") for k in keys]
    diff = F.col("u").bitwiseXOR(F.col("v"))
    on += [F.col("u") < F.col("v"), F.bit_count(diff) <= tau]
    for k, mk in enumerate(masks[:-1]):
        #: a pair that several partitions find comes from the first of them alone
        allowed = F.shiftright("t", 4 * k).bitwiseAND(F.lit(15)) - 1
        on.append((F.col("p.part") <= k) | (F.bit_count(diff.bitwiseAND(F.lit(_signed(mk)))) > allowed))
    found = p.join(x, on).select("u", "v")
    return found.distinct() if split_more else found


def near_duplicates(docs: DataFrame, tau: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id): smallest id among the documents that links reach, the document itself included.

    Equal fingerprints are collapsed before anything is joined, so a group of copies costs one fingerprint. Null or
    wordless texts have fingerprint zero and are linked like others; rows with a null id keep it and do not name
    components. Repeated rows each give a row; very long texts are read whole, piece by piece; further columns are left out.
    """
    each = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = stored(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    labels = components(links(distinct.select("fp"), tau))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    names = stored(named.join(least, "label").select("fp", "component_id"), "names")
    return each.join(names, "fp").select("doc_id", "fp", "component_id")


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, repeats included, from the words' hashes; the whole sequence if it is shorter."""
    return gram_hashes(words, min(n, len(words))) if len(words) else words


def _shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(_grams(hashes(text.lower().split()), n))


def _name(shingles: np.ndarray) -> str:
    """A 128-bit name of a set of shingles: texts of one name have the similarity 1."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def band_keys(shingles: np.ndarray, bands: int = _BANDS, rows: int = _ROWS) -> np.ndarray:
    """A key for each band of MinHash values; sets of Jaccard similarity j agree on one with probability j ** rows."""
    rng = np.random.default_rng(7)
    flip, times = (rng.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32) for _ in range(2))
    mix = rng.integers(0, 1 << 64, bands * rows, dtype=np.uint64) | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 1 << 12):
        h = short[None, k : k + (1 << 12)] ^ flip
        h *= times | np.uint32(1)
        least = np.minimum(least, h.min(axis=1))
    wide = (least.astype(np.uint64) + np.uint64(1)) * mix
    return ((wide ^ (wide >> np.uint64(29))) * mix).reshape(bands, rows).sum(axis=1, dtype=np.uint64)


def _sketches(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """(doc_id, text_key, node, fp, n, bands) of (doc_id, text): one pass over the texts, one text at a time."""
    schema = pa.schema([("node", pa.string()), ("fp", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sketch(text: bytes) -> tuple:
        h = hashes(text.lower().split())
        grams, s = _grams(h, shingle), np.unique(_grams(h, words))
        fp = majority(len(grams), (grams[k : k + (1 << 15)] for k in range(0, len(grams), 1 << 15)))
        return _name(s), fp - (1 << 64) if fp >> 63 else fp, len(s), band_keys(s).view(np.int64) if len(s) else []

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = list(zip(*map(sketch, octets(part.column(2))), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(x, f.type) for x, f in zip(found, schema, strict=True)]], names=["doc_id", "text_key", *schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _text_key("text").alias("text_key"), "text").mapInArrow(tidied(run), f"doc_id {kind}, text_key long, node string, fp long, n long, bands array<long>")


def _text_key(column: str):
    return F.xxhash64(F.coalesce(column, F.lit("")))


def _shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(nid, s array of hashes) of the ``wanted`` (nid, node, doc_id, text_key), from the texts.

    A text that only shares the key is passed over. A document that is repeated gives its set as often, which does no harm.
    """

    def run(batches):
        for b in (b.slice(s, 512) for b in batches for s in range(0, b.num_rows, 512)):
            for nid, node, text in zip(b.column(0), b.column(1).to_pylist(), octets(b.column(2)), strict=True):
                s = _shingles(text, words)
                if _name(s) == node:
                    yield pa.RecordBatch.from_arrays([pa.array([nid.as_py()]), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], names=["nid", "s"])

    d, w = docs.select("doc_id", _text_key("text").alias("text_key"), "text"), sendable(wanted)
    texts = d.join(w, (d["text_key"] == w["text_key"]) & d["doc_id"].eqNullSafe(w["doc_id"]))
    return texts.select("nid", "node", "text").mapInArrow(tidied(run), "nid long, s array<long>")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all pairs of sets: rare elements pair by pair, frequent ones as products of matrices."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(tokens)))
    total = np.zeros((m, m), np.float32)
    for c in range(2, 8):
        own = owner[starts[counts == c][:, None] + np.arange(c)[None, :]]
        for i in range(c):
            for j in range(i + 1, c):
                np.add.at(total, (own[:, i], own[:, j]), 1)
                np.add.at(total, (own[:, j], own[:, i]), 1)
    often = np.flatnonzero(counts >= 8)
    for k in range(0, len(often), 2048):
        part = often[k : k + 2048]
        held = np.zeros((m, len(part)), np.float32)
        at = np.repeat(starts[part] - np.concatenate(([0], np.cumsum(counts[part])[:-1])), counts[part]) + np.arange(counts[part].sum())
        held[owner[at], np.repeat(np.arange(len(part)), counts[part])] = 1
        total += held @ held.T
    return total


def joined_labels(nids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges that join the labels of sets with at least the Jaccard similarity ``least``: a tree of each group, not its pairs."""
    n = np.array([len(s) for s in sets], np.float32)
    common = _overlaps(sets)
    alike = common + 1e-3 >= least * (n[:, None] + n[None, :] - common)
    alike |= labels[:, None] == labels[None, :]
    np.fill_diagonal(alike, True)
    group, old = np.arange(len(n)), None
    while old is None or (group != old).any():
        old = group
        group = np.where(alike, group[None, :], len(n)).min(axis=1)
    first: dict[tuple[int, int], int] = {}
    for k, (g, x) in enumerate(zip(group.tolist(), labels.tolist(), strict=True)):
        first.setdefault((g, x), k)
    return [(int(nids[g]), int(nids[k])) for (g, x), k in first.items() if x != labels[g]]


def _across(shared: DataFrame, sets: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Edges (u, v) between the labels of texts that share a bucket (key, nid, n) and have the Jaccard similarity ``least``.

    Of each bucket with several labels, those texts that do not bear its commonest label are dealt into blocks that meet
    each other and the blocks of the commonest label, so its own texts are not compared among themselves. A block holds
    about 512 texts and a million shingles; a group of two blocks is one task's unit of work and returns a tree's edges.
    """
    rows = shared.join(labels.select(F.col("node").alias("nid"), "label"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    marks = [F.bit_xor(F.xxhash64("nid", F.lit(k))).alias(f"x{k}") for k in range(2)]
    by_label = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("m"), *marks)
    most = F.struct("c", "label", "m")
    per = by_label.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("c"), F.sum("m").alias("m"), F.max(most).alias("main"), *[F.bit_xor(f"x{k}").alias(f"x{k}") for k in range(2)]).where("kinds > 1")
    #: copies agree on many bands: of buckets with the same texts one is enough
    per = per.groupBy("c", "m", "x0", "x1", "main").agg(F.min("key").alias("key"))

    def blocks(texts, shingles):
        return F.greatest(F.ceil(texts / F.lit(_BLOCK_TEXTS)), F.ceil(shingles / F.lit(_BLOCK_SHINGLES)), F.lit(1)).cast("int")

    per = per.select("key", F.col("main.label").alias("main"), blocks(F.col("c") - F.col("main.c"), F.col("m") - F.col("main.m")).alias("other"), blocks(F.col("main.c"), F.col("main.m")).alias("mains"))
    own = F.col("label") != F.col("main")
    dealt = rows.join(per, "key").withColumn("b", F.pmod(F.xxhash64("nid", "key"), F.when(own, F.col("other")).otherwise(F.col("mains"))).cast("int"))
    meets = F.when(own, F.transform(F.sequence(F.lit(0), F.col("other") + F.col("mains") - 1), lambda x: F.struct(F.least("b", x).alias("i"), F.greatest("b", x).alias("j"))))
    meets = meets.otherwise(F.transform(F.sequence(F.lit(0), F.col("other") - 1), lambda x: F.struct(x.alias("i"), (F.col("other") + F.col("b")).alias("j"))))
    groups = dealt.select("key", "nid", "label", F.explode(meets).alias("at")).select("key", "at.i", "at.j", "nid", "label").join(sets, "nid")

    def compare(table: pa.Table) -> pa.Table:
        nids, labels, column = table.column("nid").to_numpy(), table.column("label").to_numpy(), table.column("s").combine_chunks()
        found = joined_labels(nids, labels, [column[k].values.to_numpy() for k in range(len(nids))], least) if len(set(labels.tolist())) > 1 else []
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return groups.groupBy("key", "i", "j").applyInArrow(compare, "u long, v long")


def similar_texts(docs: DataFrame, tau: int = 5, shingle: int = 3, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key long, component_id) of documents whose distinct ``words``-word shingles have the Jaccard similarity ``least``.

    A node is a distinct set of shingles. SimHash fingerprints within ``tau`` bits propose the first links, which the sets
    confirm; equal fingerprints are confirmed as well. Copies of similarity 0.8 often differ in more bits than any radius
    could probe, so texts of different components that share a MinHash band are then compared as sets, all of them but
    through trees of edges. Texts without words (null, empty, blank) have equal, empty sets: they are one another's
    copies. ``text_key`` tells repeated ids apart. Null ids do not name components; a component without any other has
    none. Repeated rows each give a row; an empty table gives none; further columns are left out.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    each = stored(_sketches(docs, shingle, words), "sketches")
    nodes = each.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bands").alias("bands"))
    nodes = stored(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")  # the number holds since it is written
    wordy = nodes.where("n > 0")
    heads = stored(wordy.groupBy("fp").agg(F.min("nid").alias("head")), "heads")
    ends = links(heads.select("fp"), tau).join(heads.select(F.col("fp").alias("u"), F.col("head").alias("p")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("q")), "v").select("p", "q")
    ends = stored(ends.unionByName(wordy.join(heads, "fp").where("nid <> head").select(F.col("head").alias("p"), F.col("nid").alias("q"))), "links")
    rows = wordy.select("nid", "n", F.explode("bands").alias("key"))
    shared = stored(rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "key"), "shared")
    open_ids = ends.select(F.col("p").alias("nid")).unionByName(ends.select(F.col("q").alias("nid"))).unionByName(shared.select("nid")).distinct()
    wanted = stored(nodes.join(open_ids, "nid").select("nid", "node", "first.*"), "wanted")
    sets = stored(_shingle_sets(docs, wanted, words), "shingles")

    common = F.size(F.array_intersect("sp", "sq"))
    alike = common >= F.lit(least) * (F.size("sp") + F.size("sq") - common)
    one = ends.join(sets.select(F.col("nid").alias("p"), F.col("s").alias("sp")), "p")
    two = sets.select(F.col("nid").alias("r"), F.col("s").alias("sq"))
    edges = stored(one.join(two, (F.col("q") == F.col("r")) & alike).select(F.col("p").alias("u"), F.col("q").alias("v")), "confirmed")
    edges = edges.unionByName(stored(_across(shared, sets, components(edges), least), "across"))
    named = nodes.select("node", "nid", "first_id").join(components(edges).withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    names = named.join(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "label").select("node", "component_id")
    return each.select("doc_id", "text_key", "node").join(stored(names, "names"), "node").select("doc_id", "text_key", "component_id")


def dedup(docs: DataFrame, tau: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component in ``similar_texts``; rows with a null id stay.

    Of rows that repeat an id, those with equal texts all stay or all go; different texts are judged by themselves.
    """
    found = similar_texts(docs, tau, least=least)
    gone = stored(found.where("doc_id <> component_id").select("doc_id", "text_key").distinct(), "gone")
    return without(docs, gone, {"doc_id": docs["doc_id"], "text_key": F.xxhash64(F.coalesce(docs["text"], F.lit("")))})
