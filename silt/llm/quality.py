"""Quality classifier: random Fourier features, partition-summed normal equations, isotonic calibration.

Statistics of each whole text (shares of kinds of bytes, word lengths, repetition, entropy) are standardised and mapped to
random Fourier features, which approximate a Gaussian kernel.  Each partition of labelled rows sums its own normal
equations; the sums are added and a ridge solution gives raw scores.  Isotonic regression turns raw scores into
probabilities, interpolated linearly; it sees raw scores of every labelled row from equations without that row's fold
(``FOLDS`` by crc32(doc_id as text) div 16), at every size alike.

Labels are learned from rows whose crc32(doc_id as text) mod 4 is not 2.  Of over ``MAX_LABELLED`` such labels that share of hash values is used which
leaves about so many, so they fit a broadcast and only their texts are measured for the fit; everything else covers all rows.

Defined cases: null, empty and wordless texts have statistics of zeros and get a score like any other; labels that are null are left out, those that
have no document count for nothing, those that contradict each other count as given (a row each); with no usable labels, or labels of one kind only, the score is the
labels' mean (0.5 without any); rows with a null doc_id are held in, never learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.boost import isotonic
from silt.llm.common import chunks, map_arrow, saved, text_bytes

FEATURES, SEED, RIDGE, WIDTH = 256, 42, 1e-2, 6.0
MAX_LABELLED = 200_000
FIT_PARTITIONS, FOLDS = 16, 4
THRESHOLD = 0.7

_KIND = np.zeros(256, np.int64)  # of each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 .,;:'"?-, 7 other ASCII marks, 8 above ASCII
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 8 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace() else 6 if _c in ".,;:'\"?-" else 7 if 33 <= _b < 127 else 0
N_STATS = 21


def statistics(text: str | None) -> list[float]:
    """N_STATS numbers about a whole text."""
    data = text_bytes(text)
    if not data.strip():
        return [0.0] * N_STATS
    counts, n_words, letters, long_, marked, shouted, doubled, bare, seen = np.zeros(256, np.int64), 0, 0, 0, 0, 0, 0, 0, set()
    last = b""
    for part in chunks(data):
        counts += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        words = part.split()
        n_words += len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters += int(sizes.sum())
        long_ += int((sizes > 20).sum())
        shouted += sum(map(bytes.isupper, words))
        marked += sum(w[-1:] in b"#$%&*!|~^=_" for w in words)
        bare += sum(w in (b"|", b"-", b"*", b"=") for w in words)
        doubled += sum(map(bytes.__eq__, words, [last, *words[:-1]]))
        last = words[-1] if words else last
        seen.update(map(hash, words))
    n = int(counts.sum())
    kinds = np.bincount(_KIND, counts, 9) / n
    p = counts[counts > 0] / n
    lines = data.split(b"\n")
    full = [x.strip() for x in lines if x.strip()]
    sentences = data.count(b". ") + data.count(b".\n") + data.endswith(b".")
    w = max(n_words, 1)
    return [
        np.log1p(n), np.log1p(n_words), letters / w, *kinds[1:9].tolist(), float(-(p * np.log(p)).sum()),
        len(seen) / w, long_ / w, marked / w, shouted / w, doubled / w, bare / w,
        1 - len(set(full)) / max(len(full), 1), np.log1p(len(full)) / np.log1p(w), sentences / w,
    ]


def measured(docs: DataFrame, key: str = "key", text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """(key, stats) and the columns ``others`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()], np.float64).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), *b.columns[2:]], names=["key", "stats", *others])

    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *others)
    kinds = "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in others)
    return map_arrow(own, run, f"key {own.schema['key'].dataType.simpleString()}, stats array<double>{kinds}")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    raw: np.ndarray  # knots of the calibration
    share: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(fourier((x - self.mean) / self.spread) @ self.weights, self.raw, self.share), 0.0, 1.0)


def fourier(z: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((N_STATS, FEATURES)) / WIDTH
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.cos(np.clip(z, -8, 8) @ w + phase) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])


def chosen(labels: DataFrame, label: str = "quality", label_key: str = "doc_id", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(known, y, fold, n): the labels that are learned from, and how often each occurs; about ``max_labelled`` rows at most, however often labels are repeated."""
    crc = F.crc32(F.col(label_key).cast("string"))
    usable = labels.where(F.col(label).isNotNull() & (crc % 4 != 2)).select(F.col(label_key).alias("known"), F.col(label).cast("double").alias("y"), (F.floor(crc / 16) % FOLDS).cast("int").alias("fold"))
    distinct = saved(usable.groupBy("known", "y", "fold").agg(F.count("*").alias("n")), "quality-labels")
    return bounded(distinct, max_labelled, "known", "y")


def bounded(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """About ``most`` of the rows, which differ in ``keys``, by a hash of these; all where they are no more."""
    share = (1 << 32) * most // max(rows.count(), 1)
    return rows if share >= 1 << 32 else rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 32)) < share)


def fit(rows: DataFrame) -> Model:
    """A model from measured rows (stats, y, fold, n), each of which counts n times; of more than MAX_LABELLED different ones (documents may share a key) a share by hash."""
    alike = saved(rows.groupBy("stats", "y", "fold").agg(F.sum("n").cast("double").alias("n")).repartition(FIT_PARTITIONS), "quality-labelled")
    rows = bounded(alike, MAX_LABELLED, "stats", "y", "fold")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summed(batches, lambda x, y, n: np.concatenate([[n.sum()], n @ x, n @ (x * x), [n @ y]]), 2 * N_STATS + 2)

    m = sum((np.frombuffer(r[1]) for r in rows.mapInArrow(moments, "fold int, sums binary").collect()), start=np.zeros(2 * N_STATS + 2))
    n = float(m[0])
    if not n or not 0 < m[-1] < n:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(FEATURES + 1), np.zeros(1), np.array([m[-1] / n if n else 0.5]))
    mean = m[1 : 1 + N_STATS] / n
    spread = np.sqrt(np.maximum(m[1 + N_STATS : 1 + 2 * N_STATS] / n - mean**2, 0))
    spread[spread < 1e-9] = 1.0
    d = FEATURES + 1
    share = m[-1] / n

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(x, y, n):
            z = fourier((x - mean) / spread)
            w = (n * np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)))[:, None]  # both labels weigh the same
            return np.concatenate([(z.T @ (w * z)).ravel(), z.T @ (w[:, 0] * y)])

        yield from _summed(batches, part, d * d + d)

    sums = np.zeros((FOLDS, d * d + d))
    for fold, s in rows.repartitionById(FIT_PARTITIONS, F.col("fold") * F.lit(FIT_PARTITIONS // FOLDS) + F.pmod(F.hash("stats"), F.lit(FIT_PARTITIONS // FOLDS))).mapInArrow(normal, "fold int, sums binary").collect():
        sums[fold] += np.frombuffer(s)
    solve = lambda s: np.linalg.solve(s[: d * d].reshape(d, d) + RIDGE * np.eye(d), s[d * d :])
    without = np.array([solve(sums.sum(0) - s) for s in sums])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
            z = fourier((x - mean) / spread)
            yield pa.RecordBatch.from_arrays([pa.array((z * without[b.column(2).to_numpy(zero_copy_only=False)]).sum(1)), b.column(1), b.column(3)], names=["raw", "y", "n"])

    seen = rows.mapInArrow(raw, "raw double, y double, n double").toPandas()
    return Model(mean, spread, solve(sums.sum(0)), *isotonic(seen["raw"].to_numpy(), seen["y"].to_numpy(), seen["n"].to_numpy()))


def _summed(batches, part, size: int) -> Iterator[pa.RecordBatch]:
    """One row for each fold in a partition: its number and the sum of ``part`` over its rows."""
    totals: dict[int, np.ndarray] = {}
    for b in batches:
        x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
        y, fold, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        for k in np.unique(fold).tolist():
            own = fold == k
            totals[k] = totals.get(k, np.zeros(size)) + part(x[own], y[own], n[own])
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["fold", "sums"])


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """(key, score) for every measured row."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(x))], names=["key", "score"])

    return map_arrow(stats.select("key", "stats"), run, f"key {stats.schema['key'].dataType.simpleString()}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = saved(measured(docs, "doc_id"), "quality-stats")
    held_out = F.coalesce(F.crc32(F.col("key").cast("string")) % 4 == 2, F.lit(False))
    model = fit(stats.join(F.broadcast(chosen(labels)), F.col("key") == F.col("known")))
    return scores(stats, model).select(F.col("key").alias("doc_id"), held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, scored where they lie: texts are not shuffled, and for the fit only labelled ones are measured."""
    known = F.broadcast(chosen(labels))
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(known, F.col("key") == F.col("known"))
    model = docs.sparkSession.sparkContext.broadcast(fit(measured(own, others=("y", "fold", "n"))))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(at).to_pylist()], np.float64).reshape(-1, N_STATS)
            yield b.filter(pa.array(model.value.score(x) >= THRESHOLD))

    return map_arrow(docs, run, docs.schema)


def held_out(doc_id: object) -> bool:
    """The contract's held-out rule, for tests."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
