"""Plain single-machine versions of what the operators compute."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def fingerprint(text):
    w = SPACE.findall(lowered(text))
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash(rows, tau=2):
    """{(doc_id, fingerprint, component)} as a Counter."""
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= tau) + i + 1:
            parent[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True)))


def contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lowered(text))
        n = min(len(w), 8)
        for s in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[s : s + n])].add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for d, text in rows:
        w = WORD.findall(lowered(text))
        hit, ids = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    ids |= windows[g]
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(ids) >= 2))
    return Counter(out)


def base_license(text):
    w = [x.decode() for x in WORD.findall(lowered(text))]
    at, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def kneser_ney(train, texts):
    """Base and model log10 scores with the textbook formulas on dictionaries."""
    toks = lambda t: [x.decode("utf8", "surrogateescape") for x in SPACE.findall(lowered(t))] + ["</s>"]
    uni, bi = Counter(), Counter()
    for t in train:
        w = toks(t)
        uni.update(w)
        bi.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)
    follow, cont, total = defaultdict(Counter), Counter(), Counter()
    for (a, b), c in bi.items():
        follow[a][min(c, 3)] += 1
        total[a] += c
        cont[b] += 1

    def discounts(values):
        k = Counter(values)
        if min(k[1], k[2], k[3]) <= 0:
            return [0, 0.5, 1.0, 1.5]
        y = k[1] / (k[1] + 2 * k[2])
        d = [1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3]]
        return [0, *[min(max(x, 0.05), j + 0.95) for j, x in enumerate(d)]]

    d2, d1 = discounts(bi.values()), discounts(cont.values())
    kinds = Counter(min(c, 3) for c in cont.values())
    gamma = sum(d1[k] * kinds[k] for k in (1, 2, 3)) / len(bi) if bi else 1.0

    def low(w):
        return gamma / (v + 1) + (max(cont[w] - d1[min(cont[w], 3)], 0) / len(bi) if bi else 0)

    def p(a, w):
        if a not in total:
            return low(w)
        c = bi[a, w]
        return (max(c - d2[min(c, 3)], 0) + sum(d2[k] * follow[a][k] for k in (1, 2, 3)) * low(w)) / total[a]

    out = []
    for t in texts:
        w = toks(t)
        out.append((len(w), sum(uni[x] > 0 for x in w), n, sum(np.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(np.log10(p(a, x)) for a, x in zip(["<s>", *w[:-1]], w, strict=True))))
    return out, p, uni


def crc(x, mod):
    return zlib.crc32(str(x).encode()) % mod
