"""Definitions of the text operators in plain Python, for tests."""

import hashlib
import zlib

import numpy as np
import xxhash

from silt.llm import quality

M = (1 << 64) - 1


def words(t, lower=False):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


def simple_print(t):
    """A SimHash fingerprint, bit by bit."""
    w = words(t, True)
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(pairs):
    """(find, least): the group of a fingerprint, and each group's smallest key, for rows (key, text)."""
    prints = {t: simple_print(t) for _, t in pairs}
    nodes = sorted(set(prints.values()))
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(b)] = find(a)
    least = {}
    for k, t in pairs:
        if k is not None:
            r = find(prints[t])
            least[r] = min(k, least.get(r, k))
    return prints, find, least


def holds(text, item):
    """(the item's shingles, those in the text)."""
    w, v = words(item, True), words(text, True)
    k = min(5, len(w))
    own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return len(own), len(own & {tuple(v[i : i + k]) for i in range(len(v) - k + 1)})


def plain_statistics(text):
    """The numbers about a text, byte by byte and word by word."""
    from collections import Counter
    from math import log, log1p

    data = (text or "").encode()
    w = data.split()
    if not w:
        return [0.0] * 21
    n, counts = len(data), Counter(data)

    def kind(b):
        c = chr(b)
        if b >= 128:
            return 8
        if "a" <= c <= "z":
            return 1
        if "A" <= c <= "Z":
            return 2
        if "0" <= c <= "9":
            return 3
        if c == "\n":
            return 5
        if c.isspace():
            return 4
        return 6 if c in ".,;:'\"?-" else 7 if 33 <= b < 127 else 0

    share = [sum(k for b, k in counts.items() if kind(b) == i) / n for i in range(9)]
    entropy = -sum(k / n * log(k / n) for k in counts.values())
    part = lambda test: sum(map(test, w)) / len(w)
    full = [x.strip() for x in data.split(b"\n") if x.strip()]
    sentences = sum(data[i : i + 2] in (b". ", b".\n") for i in range(n)) + data.endswith(b".")
    return [
        log1p(n), log1p(len(w)), sum(map(len, w)) / len(w), *share[1:], entropy, len(set(w)) / len(w), part(lambda x: len(x) > 20), part(lambda x: x[-1:] in b"#$%&*!|~^=_"), part(bytes.isupper),
        sum(x == y for x, y in zip(w, w[1:])) / len(w), part(lambda x: x in (b"|", b"-", b"*", b"=")), 1 - len(set(full)) / max(len(full), 1), log1p(len(full)) / log1p(len(w)), sentences / len(w),
    ]


def plain_fourier(z):
    """Random Fourier features, one after the other, and a constant."""
    rng = np.random.default_rng(quality.SEED)
    w = rng.standard_normal((quality.N_STATS, quality.FEATURES)) / quality.WIDTH
    phase = rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.clip(z, -8, 8)
    columns = [np.cos(sum(z[:, i] * w[i, f] for i in range(z.shape[1])) + phase[f]) * (2 / quality.FEATURES) ** 0.5 for f in range(quality.FEATURES)]
    return np.array([*columns, np.ones(len(z))]).T


def plain_isotonic(x, y):
    """Neighbours whose means don't rise are merged, one pair at a time, until all do."""
    blocks = [[float(y[x == v].sum()), int((x == v).sum()), float(v * (x == v).sum())] for v in sorted(set(x.tolist()))]
    while True:
        i = next((i for i in range(len(blocks) - 1) if blocks[i][0] / blocks[i][1] >= blocks[i + 1][0] / blocks[i + 1][1]), None)
        if i is None:
            break
        blocks[i : i + 2] = [[a + b for a, b in zip(blocks[i], blocks[i + 1])]]
    share = [(s + 2 * y.mean()) / (n + 2) for s, n, _ in blocks]
    return np.array([t / n for _, n, t in blocks]), np.array([max(share[: i + 1]) for i in range(len(share))])


def quality_score(rows, labels):
    """A function from a text to its score: ridge on all labelled rows, calibration on each row's raw score from the other folds."""
    crc = lambda k: zlib.crc32(str(k).encode())
    used = [(t, y, k) for k, y in labels if y is not None and k is not None and crc(k) % 4 != 2 for d, t in rows if d == k]
    measured = {t: plain_statistics(t) for t, _, _ in used}
    x, y = np.array([measured[t] for t, _, _ in used]), np.array([y for _, y, _ in used], float)
    fold = np.array([crc(k) // 16 % quality.FOLDS for _, _, k in used])
    mean, spread = x.mean(0), np.where(x.std(0) < 1e-9, 1.0, x.std(0))
    z, w = plain_fourier((x - mean) / spread), np.where(y > 0.5, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ridge = lambda at: np.linalg.solve((z[at] * w[at, None]).T @ z[at] + quality.RIDGE * np.eye(z.shape[1]), (z[at] * w[at, None]).T @ y[at])
    raw = np.array([z[i] @ ridge(fold != fold[i]) for i in range(len(y))])
    # Equal texts have equal raw scores; the last bits of a product depend on the row's place, so they are cut before equals are looked for.
    knots, share = plain_isotonic(np.array([float(f"{v:.12g}") for v in raw]), y)
    weights = ridge(np.ones(len(y), bool))
    return lambda t: float(np.interp(plain_fourier((np.array([plain_statistics(t)]) - mean) / spread) @ weights, knots, share)[0])


def scrambled(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def phrases(symbols, named):
    """One level of locally consistent parsing, symbol by symbol; ``named``: symbols are names of phrases."""
    c = 0x9E3779B97F4A7C15
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    names = [scrambled(s + c & M) for s, _ in runs]
    names = [scrambled(x ^ n * c & M) if n > 1 else x for x, (_, n) in zip(names, runs)]
    labels = names if named else [s for s, _ in runs]
    for _ in range(4):
        tossed = []
        for i, x in enumerate(labels):
            differ = x ^ (labels[i - 1] if i else x ^ 1)
            bit = (differ & -differ).bit_length() - 1
            tossed.append(2 * bit + (x >> bit & 1))
        labels = tossed
    out = []
    for i, x in enumerate(labels):
        if not i or x > labels[i - 1] and x > (labels[i + 1] if i + 1 < len(labels) else -1):
            out.append([])
        out[-1].append(names[i])
    return [scrambled(sum(scrambled(x + j * c & M) for j, x in enumerate(p)) & M) for p in out]


def parsed_print(text):
    """64 slots of a text's fingerprint, None where empty."""
    least = [None] * 64
    symbols = [ord(ch) for ch in text]
    for level in (1, 2, 3):
        symbols = phrases(symbols, level > 1) if symbols else []
        if level > 1:
            for x in symbols:
                own = scrambled(x + level & M)
                k, v = own % 64, own // 64
                least[k] = v if least[k] is None else min(v, least[k])
    return [None if v is None else scrambled(v) % 0xFFFF for v in least]


def shared(a, b):
    """The likeness of two fingerprints."""
    some = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    if not some:
        return 1.0
    j = sum(x == y for x, y in some) / len(some)
    return 2 * j / (1 + j)


def plain_runs(w, least=12):
    """Runs (start, length, period): all stretches of equal words at all distances, those of one extent by their smallest distance."""
    n, found = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - start + p
            if i > start and length >= max(least, 2 * p):
                found.setdefault((start, length), p)
            i += 1
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_runs_row(key, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return [
        key, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in dropped)),
    ]


def plain_manifest(rows):
    """Rows of the manifest for rows (doc_id, source, lang, n_chars, text), by whole lists of levels."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r, t: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], t)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: levels([leaf(r, r[4]) for r in groups[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            own = leaf(r, r[4])
            lower = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            now = leaf(r, lower) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            proof = ""
            for tree, k in ((trees[s], i), (top, at)):
                for nodes in tree[:-1]:
                    a = k // 16 * 16
                    left, right = "".join(nodes[a:k]), "".join(nodes[k + 1 : a + 16])
                    proof, now, k = proof + left + right, h(left + now + right), k // 16
            out.append((r[0], own, trees[s][-1][0], top[-1][0], h(proof), now, now == top[-1][0]))
    return sorted(out, key=str)


def plain_targets(rows, weights, share, most):
    """source: (words, target as a fraction) for rows (source, size), sharing what is above until none is."""
    from fractions import Fraction

    sizes = {}
    for s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    capped, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        part = {s: (left - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if part[s] > most * sizes[s]]
        if not above:
            return {s: (sizes[s], capped.get(s, part.get(s))) for s in order}
        capped.update((s, Fraction(most) * sizes[s]) for s in above)
