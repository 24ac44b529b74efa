"""Substring deduplication by level-wise doubling.

A window is ``WINDOW`` consecutive words of one document.  A word goes if a window covers it whose words also start in a document with a smaller key;
windows are judged on the input.  Levels, each on what repeated at the one before:

1. ``WINDOW / 2`` words.  Of the half-windows inside a window the one with the smallest hash (leftmost of equals) stands for it: equal windows have the
   same one, so counting only those, about one in 13 positions, loses no window.  Those that occur in one document alone die.
2. The run of all windows that share a surviving half-window, up to three half-windows long.  Where an equal run starts in an earlier document, all its windows are decided,
   and copies of a text go no further: only the first holder of each distinct run does.
3. ``WINDOW`` words, twice the first length, for the windows of those first holders; then no candidates are left, for the length asked for is reached.

Keys of levels 2 and 3 have 96 bits.  Counts are (min, max) of document keys, combined before each shuffle; joins have one distinct side, so a passage
that many documents share is split over tasks.  A document's lists are bounded by its own length.

Defined cases: null, empty and short texts have no windows and keep all words; documents with equal keys don't remove from each other; rows with a null key keep all
words and remove none; repeated rows give a row each; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import chunks, map_arrow, mixed, saved, text_bytes, word_hashes, written

WINDOW = 50
_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xD1342543DE82EF95)


_CACHED = 1 << 16  # powers that a worker keeps
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i for i up to ``n``, modulo 2 ** 64."""
    found = _powers.get(int(base))
    if found is None or len(found[0]) <= n:
        size = max(n, _CACHED) + 1
        found = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, np.uint64(pow(int(base), -1, 1 << 64))))
        if size == _CACHED + 1:
            _powers[int(base)] = found
    return found


class Rolling:
    """Hashes of runs of words from prefix sums, modulo 2 ** 64."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        n = len(words)
        powers, self.inverse = _power_table(base, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """Of all runs of ``size`` words."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n] + np.uint64(size))


class Windows:
    """The windows of one text, the half-windows that stand for them, and their runs."""

    def __init__(self, words: np.ndarray, window: int = WINDOW):
        half = window // 2
        self.n, self.window = len(words), window
        self.first, self.second = None, None
        self._words = words
        if self.n < window:
            self.starts = self.stops = np.empty(0, np.int64)
            return
        self.first = Rolling(words, _M)
        halves = self.first.every(half)
        wide = window - half + 1
        count, step = len(halves) - wide + 1, halves.strides[0]
        span = np.lib.stride_tricks.as_strided(halves, (count, wide), (step, step))
        pick = span.argmin(1) if count <= 65536 else np.concatenate([span[i : i + 65536].argmin(1) for i in range(0, count, 65536)])
        pick += np.arange(count)
        turns = np.flatnonzero(pick[1:] != pick[:-1]) + 1
        self.starts = np.concatenate([[0], turns])  # first window of each run
        self.stops = np.concatenate([turns, [count]])  # one past its last window
        self.halves = halves[pick[self.starts]]

    def keys(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96-bit keys of runs of words: a long and an int each."""
        if not len(start):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        if self.second is None:
            self.second = Rolling(mixed(self._words + _M2), _M2)
        return self.first.of(start, stop).view(np.int64), (self.second.of(start, stop) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def run_keys(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys(self.starts, self.stops - 1 + self.window)


def _hashes(text: str | None) -> np.ndarray:
    return np.concatenate([word_hashes(c.split()) for c in chunks(text_bytes(text))])


def _runs(docs: DataFrame, kind: str, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"half": [np.empty(0, np.int64)], "h": [np.empty(0, np.int64)], "g": [np.empty(0, np.int32)]}
            ids = []
            for i, t in enumerate(b.column(1).to_pylist()):
                w = Windows(_hashes(t), window)
                if len(w.starts):
                    h, g = w.run_keys()
                    _, once = np.unique(h, return_index=True)
                    out["half"].append(w.halves[once].view(np.int64))
                    out["h"].append(h[once])
                    out["g"].append(g[once])
                    ids.append(np.full(len(once), i))
            at = pa.array(np.concatenate([np.empty(0, np.int64), *ids]))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(v)) for v in out.values()), b.column(0).take(at)], names=["half", "h", "g", "key"])

    return map_arrow(docs.where(F.col("key").isNotNull()), run, f"half long, h long, g int, key {kind}")


def _members(h: np.ndarray, g: np.ndarray, listed: list[tuple[int, int]]) -> np.ndarray:
    """Which keys (h, g) are listed."""
    if not listed or not len(h):
        return np.zeros(len(h), bool)
    kind = np.dtype([("h", np.int64), ("g", np.int32)])
    own, other = np.empty(len(h), kind), np.array(listed, kind)
    own["h"], own["g"] = h, g
    return np.isin(own, other)


def _windows_of(w: Windows, chosen: np.ndarray) -> np.ndarray:
    """First words of the windows in the chosen runs."""
    if not chosen.any():
        return np.empty(0, np.int64)
    return np.concatenate([np.arange(a, b) for a, b in zip(w.starts[chosen], w.stops[chosen])])


def _pairs(flat) -> list[tuple[int, int]]:
    return [(x["h"], x["g"]) for x in flat or ()]


def _met(rows: DataFrame, sums: DataFrame, column: str, *others: str) -> DataFrame:
    """``rows`` with the columns of ``sums`` for their keys.

    The sums come out dealt by their keys; joined as they are, a hot key's rows would be bound to one task.  By a key of the same
    information under another name both sides are dealt anew, and Spark splits the large one.
    """
    name = F.col(column).bitwiseXOR(F.lit(1)).alias("__key")
    return rows.select("*", name).join(sums.select(*[c for c in sums.columns if c != column], name), ["__key", *others]).drop("__key")


def _later(rows: DataFrame) -> DataFrame:
    """Rows (h, g, key) with ``least``, the smallest key that holds (h, g)."""
    return _met(rows, rows.groupBy("h", "g").agg(F.min("key").alias("least")), "h", "g")


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, text, decided, found): per row the keys of its runs and of its windows that an earlier document holds."""
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    runs = saved(_runs(own, kind, window), "repeats-runs")
    twice = runs.groupBy("half").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("half")
    live = saved(_met(runs, twice, "half").select("h", "g", "key"), "repeats-live")
    lists = _later(live).groupBy("key").agg(
        F.collect_list(F.when(F.col("key") > F.col("least"), F.struct("h", "g"))).alias("decided"), F.collect_list(F.when(F.col("key") == F.col("least"), F.struct("h", "g"))).alias("open")
    )
    lists = saved(lists.select(F.col("key").alias("k"), "decided", "open"), "repeats-lists")
    # The last step joins texts and lists once more: the windows in between come from a table, so no work on texts is done twice.
    joined = own.join(lists, F.col("key") == F.col("k"), "left").select("key", "text", "decided", "open")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs, gs = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for i, listed in enumerate(b.column(3).to_pylist()):
                if not listed:
                    continue
                w = Windows(_hashes(b.column(1)[i].as_py()), window)
                at = _windows_of(w, _members(*w.run_keys(), _pairs(listed)))
                h, g = w.keys(at, at + window)
                _, once = np.unique(h, return_index=True)
                ids.append(np.full(len(once), i))
                hs.append(h[once])
                gs.append(g[once])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(gs)), b.column(0).take(pa.array(np.concatenate(ids)))], names=["h", "g", "key"])

    fine = saved(map_arrow(joined, windows, f"h long, g int, key {kind}"), "repeats-windows")
    first = fine.groupBy("h", "g").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("h", "g", "least")
    found = _met(fine, first, "h", "g").where(F.col("key") > F.col("least")).groupBy("key").agg(F.collect_list(F.struct("h", "g")).alias("found"))
    found = found.withColumnRenamed("key", "k2")
    return joined.join(found, F.col("key") == F.col("k2"), "left").select("key", "text", "decided", "found")


def kept(text: str | None, decided: list[tuple[int, int]], found: list[tuple[int, int]], window: int = WINDOW) -> tuple[int, np.ndarray | None]:
    """A text's number of words, and the numbers of those that stay; None for all."""
    words = _hashes(text)
    if not decided and not found:
        return len(words), None
    w = Windows(words, window)
    h, g = w.run_keys()
    steps = np.zeros(len(words) + 1, np.int64)
    done = _members(h, g, decided)
    np.add.at(steps, w.starts[done], 1)
    np.add.at(steps, w.stops[done] - 1 + window, -1)
    if found:
        at = _windows_of(w, ~done)
        at = at[_members(*w.keys(at, at + window), found)]
        np.add.at(steps, at, 1)
        np.add.at(steps, at + window, -1)
    return len(words), np.flatnonzero(np.cumsum(steps[:-1]) == 0)


def _applied(docs: DataFrame, key: str, text: str, window: int, row, schema: str) -> DataFrame:
    """``row(number of words, of those that stay, these in parts)`` gives a document's columns; a worker holds the words of one part, however long the text is."""
    names, types = zip(*((s.split()[0], {"long": pa.int64(), "string": pa.string()}[s.split()[1]]) for s in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, d, f in zip(b.column(1), *(b.column(i).to_pylist() for i in (2, 3))):
                t = t.as_py()
                n, stay = kept(t, _pairs(d), _pairs(f), window)
                rows.append(row(n, n if stay is None else len(stay), written(text_bytes(t), stay)))
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, types))], names=[key, *names])

    return map_arrow(marked(docs, key, text, window), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {schema}")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256)."""

    def row(n: int, left: int, parts: Iterator[bytes]) -> tuple[int, int, str]:
        digest = hashlib.sha256()
        for p in parts:
            digest.update(p)
        return n, n - left, digest.hexdigest()

    return _applied(docs, key, text, window, row, "n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, text): the words that stay, joined by single spaces."""
    return _applied(docs, key, text, window, lambda n, left, parts: (b"".join(parts).decode("utf-8", "replace"),), f"{text} string")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
wins AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT s, min(doc_id) AS m FROM wins GROUP BY s),
hits AS (SELECT r, i FROM wins JOIN least USING (s) WHERE m < doc_id),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
covered AS (
  SELECT words.r, p, x, coalesce(max(CASE WHEN i IS NOT NULL THEN 1 END) OVER (PARTITION BY words.r ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS c
  FROM words LEFT JOIN hits ON hits.r = words.r AND hits.i = words.p),
kept AS (SELECT r, CAST(sum(c) AS BIGINT) AS n, string_agg(x, ' ' ORDER BY p) FILTER (c = 0) AS t FROM covered GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
