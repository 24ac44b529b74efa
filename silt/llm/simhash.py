"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint has a bit set where over half of its 3-word shingle hashes (XXH64, seed 42) have it.
Distinct fingerprints are dealt into buckets such that two fingerprints which differ in at most ``max_bits``
bits meet in at least one (they agree on all but ``max_bits`` of the blocks into which the 64 bits are cut).
Inside a bucket every fingerprint has a row in a table of Hamming distances to many reference fingerprints.  By the
triangle inequality two fingerprints whose rows differ by more than ``max_bits`` in any coordinate can't be
close: those pairs are discarded, and what is left is verified bit by bit.

A pivot table alone gives no key to deal pairs out by (random fingerprints lie at a distance of 32 +- 4 from any
reference, so every coordinate cell would hold a large share of all rows); the blocks supply that key, and lose no pair.

Exact copies collapse to one fingerprint before any join.  A bucket of over ``BUCKET`` fingerprints is cut into
slices, and each pair of slices is its own group, so no task gets an unbounded bucket.  Out of a bucket come
only edges from a fingerprint to the smallest one of its group, never all pairs.

Defined cases: null and wordless texts have fingerprint 0, linked like any other; one or two words are one shingle;
rows with a null doc_id keep it, and it never becomes a component_id unless nothing else is reachable; repeated
rows stay; an empty table gives an empty result; other columns are ignored by the query and kept by ``dedupe``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import chunks, map_arrow, partitions, saved, text_bytes
from silt.llm.components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 3
PIVOTS = 24
BUCKET = 4096
_NEAR = 24


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned integer."""
    held: list[bytes] = []
    ones, n = np.zeros(64, np.int64), 0

    def count(grams) -> int:
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        for at in range(0, len(h), 65536):
            ones[:] += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return len(h)

    for part in chunks(text_bytes(text)):
        words = held + part.lower().split()
        n += count(map(b" ".join, zip(words, words[1:], words[2:])))
        held = words[-(SHINGLE - 1) :]
    if not n and held:
        n = count([b" ".join(held)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): one row for each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, fp long")


def block_masks(n_rows: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks of bits; two values at most ``max_bits`` apart agree under one of them.  More rows, longer keys."""
    blocks = max_bits + 1
    while blocks < max_bits + 4 and 2 ** (64 * (blocks - max_bits) // blocks) * 64 < n_rows:
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints."""
    pivots = np.random.default_rng(SEED).integers(0, 2**64, PIVOTS, np.uint64)
    return np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component under the links a-b."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    return lab


def _within(fp: np.ndarray, tab: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of the pairs i-j survive the pivot coordinates, a few at a time, and the comparison itself."""
    keep = np.arange(len(i))
    for c in range(0, tab.shape[1], 4):
        near = np.abs(tab[i[keep], c : c + 4] - tab[j[keep], c : c + 4]).max(1, initial=0) <= max_bits
        keep = keep[near]
    return keep[np.bitwise_count(fp[i[keep]] ^ fp[j[keep]]) <= max_bits]


def bucket_edges(fp: np.ndarray, tab: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each component of one bucket: a visited fingerprint is compared with unvisited ones only."""
    order = np.argsort(tab[:, 0], kind="stable")
    left = order.copy()
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            first = tab[left, 0]
            lo, hi = np.searchsorted(first, [tab[x, 0] - max_bits, tab[x, 0] + max_bits + 1])
            span = left[lo:hi]
            hit = _within(fp, tab, np.full(len(span), x), span, max_bits)
            if len(hit):
                found = span[hit]
                a += [x] * len(found)
                b += found.tolist()
                queue += found.tolist()
                left = np.delete(left, lo + hit)
    return np.array(a, np.int64), np.array(b, np.int64)


def _edges_of(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest of its group) in rows sorted by key."""
    n, tab = len(fp), pivot_table(fp)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= _NEAR, sizes)
    a, b = [], []
    for d in range(1, min(_NEAR, n)):
        i = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        if not len(i):
            break
        hit = _within(fp, tab, i, i + d, max_bits)
        a.append(i[hit])
        b.append(i[hit] + d)
    for s, m in zip(starts[sizes > _NEAR], sizes[sizes > _NEAR]):
        x, y = bucket_edges(fp[s : s + m], tab[s : s + m], max_bits)
        a.append(x + s)
        b.append(y + s)
    lab = roots(n, np.concatenate(a), np.concatenate(b)) if a else np.arange(n)
    moved = np.flatnonzero(lab != np.arange(n))
    return fp[moved], fp[lab[moved]]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) which connect exactly the distinct fingerprints of ``fps`` (fp) that links connect."""
    masks = [m - 2**64 if m >= 2**63 else m for m in block_masks(fps.count(), max_bits)]
    keyed = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > BUCKET).select("key", F.ceil(F.col("count") / BUCKET).cast("int").alias("slices"))
    cut = keyed.join(large, "key", "left").withColumn("slice", F.when(F.col("slices").isNotNull(), F.pmod(F.xxhash64("fp", F.lit(7)), F.col("slices")).cast("int")))
    meets = F.when(F.col("slice").isNull(), F.array(F.col("key"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.xxhash64(F.col("key"), F.least(j, F.col("slice")), F.greatest(j, F.col("slice"))))
    )
    dealt = cut.select("fp", F.explode(meets).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in _with_end(batches):
            if b is not None:
                key = np.r_[key, b.column(0).to_numpy(zero_copy_only=False)]
                fp = np.r_[fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
                if len(key) < 65536:
                    continue
                cut_at = int(np.searchsorted(key, key[-1]))
            else:
                cut_at = len(key)
            if cut_at:
                x, y = _edges_of(key[:cut_at], fp[:cut_at], max_bits)
                key, fp = key[cut_at:], fp[cut_at:]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    spread = dealt.repartition(partitions(fps), "key").sortWithinPartitions("key").select("key", "fp")
    return spread.mapInArrow(run, "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp, component): component is the smallest key that a row reaches over links, itself included."""
    prints = saved(fingerprints(docs, key, text), "simhash")
    fps = saved(prints.groupBy("fp").agg(F.min("key").alias("least")), "simhash-distinct")
    tree = components(links(fps.select("fp"), max_bits)).withColumnsRenamed({"node": "fp"})
    rooted = fps.join(tree, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(rooted.join(least, "root").select("fp", "component"), "fp").select("key", "fp", "component")


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is their component's smallest; of rows that share it, and where it is null, all.

    The keys that go are written first: they are the fewer ones, and Spark broadcasts them as long as their stored size is under its threshold, so texts stay where they lie.
    """
    own = F.col("key").eqNullSafe(F.col("component"))
    gone = near_duplicates(docs, key, text).groupBy("key").agg(F.max(own).alias("stays")).where("not stays").select(F.col("key").alias("__gone"))
    gone = saved(gone, "simhash-gone")
    return docs.join(gone, docs[key].eqNullSafe(gone["__gone"]), "left_anti")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    return near_duplicates(docs).select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
