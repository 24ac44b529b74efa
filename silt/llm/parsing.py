"""Document fingerprints by locally consistent parsing.

A text's code points are parsed into phrases, the phrases' names into longer phrases, and so on.  At each level, runs of one symbol become one; deterministic
coin tossing replaces a symbol by the lowest bit in which it differs from its left neighbour, and that bit, four times over, which leaves labels below six; local
maxima of the labels open phrases; a phrase's name is a hash of its symbols.  Cuts depend on a few symbols around them, so equal substrings have equal names
inside, wherever they stand.

A fingerprint is a table of ``SLOTS`` minima over the names of ``LEVELS``, 16 bits each, as hex.  Likeness is 2J / (1 + J), the shared part of two texts of equal size, with J the share of slots that agree.

For the edited texts, documents are dealt by ranges of keys whose limits are keys that exist; each limit's document also goes to the range above, so that every
document meets its successor without a global sort, and a task holds two batches.

Defined cases: null texts are empty, and empty texts have the fingerprint of no names, alike with itself alone; of documents with equal keys the order is by text;
null keys come last; rows of one key (null too) are one range, which streams through one task; a single document is its own next one; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import map_arrow, mixed, partitions

SLOTS, LEVELS = 64, (2, 3)
BATCH_CHARS = 1 << 20
SAMPLE = 32  # keys looked at for each range
EMPTY = 0xFFFF
_C = np.uint64(0x9E3779B97F4A7C15)


def _toss(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    differ = x ^ before
    low = (differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1)
    place = np.bitwise_count(low)
    return (2 * place + ((x >> place.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def _phrases(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level over several texts at once: names of phrases, and which of them open a text."""
    before = np.r_[x[:1], x[:-1]]
    keep = first | (x != before)
    at = np.flatnonzero(keep)
    run = np.diff(np.r_[at, len(x)])
    x, first = x[at], first[at]
    names = mixed(x.astype(np.uint64) + _C)
    names = np.where(run > 1, mixed(names ^ (run.astype(np.uint64) * _C)), names)
    label = names if x.dtype == np.uint64 else x
    opens = np.flatnonzero(first)
    for _ in range(4):
        before = np.r_[label[:1], label[:-1]]
        before[opens] = label[opens] ^ label.dtype.type(1)
        label = _toss(label, before)
    label = label.astype(np.int8)
    left, right = np.r_[label[:1], label[:-1]], np.r_[label[1:], label[-1:]]
    left[opens] = -1
    right[np.r_[opens[1:], len(x)] - 1] = -1
    at = np.flatnonzero(first | ((label > left) & (label > right)))
    offset = (np.arange(len(x)) - np.repeat(at, np.diff(np.r_[at, len(x)]))).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(names + offset * _C), at)), first[at]


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """A row of SLOTS numbers for each text."""
    out = np.full((len(texts), SLOTS), EMPTY, np.uint16)
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_CHARS):
            size += len(texts[to])
            to += 1
        _fill(texts[at:to], out[at:to])
        at = to
    return out


def _fill(texts: list[str], out: np.ndarray) -> None:
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return
    x = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(x), bool)
    first[np.r_[0, np.cumsum([len(texts[i]) for i in full])[:-1]]] = True
    least = np.full(len(full) * SLOTS, ~np.uint64(0))
    for level in range(1, max(LEVELS) + 1):
        x, first = _phrases(x, first)
        if level in LEVELS:
            own = mixed(x + np.uint64(level))
            np.minimum.at(least, (np.cumsum(first) - 1) * SLOTS + (own % np.uint64(SLOTS)).astype(np.int64), own // np.uint64(SLOTS))
    slots = np.where(least == ~np.uint64(0), np.uint64(EMPTY), mixed(least) % np.uint64(EMPTY)).astype(np.uint16)
    out[full] = slots.reshape(-1, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between rows of slots."""
    some = (a != EMPTY) | (b != EMPTY)
    j = ((a == b) & some).sum(1) / np.maximum(some.sum(1), 1)
    return np.where(some.any(1), 2 * j / (1 + j), 1.0)


def written(slots: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in slots]


def edited(text: str, following: str) -> str:
    """The last half of ``text``, in code points, replaced by as many of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def range_limits(keys: DataFrame, n: int) -> tuple[list, object]:
    """(up to n - 1 keys, ascending, that cut all keys into ranges of about equal numbers of different keys, the largest key).

    They come from about ``SAMPLE`` keys a range, by hash: some hundred thousand on the driver at most, since ``partitions`` has a limit.
    """
    rows, top = keys.agg(F.count("key"), F.max("key")).first()
    share = min(1 << 32, (1 << 32) * SAMPLE * n // max(rows, 1))
    found = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 32)) < share).distinct().collect()) if n > 1 else []
    return sorted({found[len(found) * i // n] for i in range(1, n)} - {top}) if found else [], top


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(part, main, key, text): each range of keys, descending, then the document that follows its last."""
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found, top = range_limits(own.select("key").where("key is not null"), partitions(docs))
    held = docs.sparkSession.sparkContext.broadcast((found, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, top = held.value
        for b in batches:
            part, again = np.zeros(b.num_rows, np.int32), []
            for i, k in enumerate(b.column(0).to_pylist()):
                if k is not None:
                    part[i] = bisect_left(limits, k)
                    if part[i] < len(limits) and limits[part[i]] == k:
                        again.append((i, part[i] + 1))  # it follows the last one of the range above
                if k == top:
                    again.append((i, 0))  # it follows the last one of all
            rows = np.concatenate([np.arange(b.num_rows), np.array([i for i, _ in again], np.int64)])
            parts = np.concatenate([part, np.array([p for _, p in again], np.int32)])
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(np.arange(len(rows)) < b.num_rows), b.column(0).take(at), b.column(1).take(at)], names=["part", "main", "key", "text"])

    rows = map_arrow(own, run, f"part int, main boolean, key {own.schema['key'].dataType.simpleString()}, text string")
    return rows.repartitionById(len(found) + 1, "part").sortWithinPartitions(F.desc("main"), F.desc_nulls_last("key"), F.asc_nulls_first("text"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple], following: str) -> pa.RecordBatch:
            texts = [t for _, t in rows]
            changed = [edited(t, u) for t, u in zip(texts, [*texts[1:], following])]
            a = fingerprints_of([*texts, following])
            b = fingerprints_of(changed)
            columns = [
                pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array(written(a[:-1])), pa.array(written(b)), pa.array(likeness(a[:-1], b)), pa.array(likeness(a[:-1], a[1:])),
            ]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind), *columns], names=names)

        held: list[tuple] = []
        kind, done, size = None, False, 0
        for b in batches:
            kind = b.column(1).type
            for main, k, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                if done:
                    continue
                if not main or len(held) >= 512 or size > 4 * BATCH_CHARS:
                    if held:
                        yield made(held, t or "")
                    held, done, size = [], not main, 0
                if main:
                    held.append((k, t or ""))
                    size += len(t or "")
        if held:
            raise ValueError("a range has no following document")

    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(with_next(docs, key, text).select("main", "key", "text"), run, schema)
