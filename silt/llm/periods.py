"""Periodic runs of words, by online dyadic square catching.

A run is a stretch with smallest period q, of at least ``LEAST`` and 2q words, that no neighbouring word extends keeping the period.  Words are appended
to ``Catchers``, which keep, for each size H = 1, 2, 4, ..., a hash of each completed block of H words that starts at a multiple of H.  Each appended
word ends a suffix of H words; that suffix is compared with the two blocks whose distance p lies in the level's periods, [2H - 1, 4H - 1).  A square of
period p has p words in a row that equal the words p later, and so many always hold a whole block: no square is missed.  (A period below ``LEAST`` takes a larger
block, for its runs have at least LEAST - p such words.)  A caught block is extended, word by word, to the stretch of all such words; stretches of period p merge
into one, those that reach the last word stay open and advance with the words appended next, and one of at least p words is a run.  A run of period q also has the periods
2q, 3q, ...: of stretches with the same words the smallest period counts, and blocks inside a known run at such distances are let go at once.

A document's work is O(n log n) and its state a few numbers a word; texts are read in chunks, so no more than one chunk's words are Python objects.  Documents don't meet:
there is no shuffle, and a group of copies is spread as the table is.

Defined cases: null, empty and short texts have no runs; repeated rows give a row each; rows with a null key are read like others (and never planted, see ``report``);
an empty table gives an empty result; extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import CRC_SQL, SLICE, chunks, crc32_sql, map_arrow, text_bytes, word_hashes, written

LEAST = 12
APPEND = 1 << 16  # words appended at once
TOGETHER = 1 << 15  # words of short texts that share catchers
_MARK = np.uint64(1 << 63)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_SHIFT = np.uint64(29)
Run = tuple[int, int, int]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of blocks from those of their halves; not linear, so that no pattern of words cancels out."""
    x = left * _A + right
    x ^= x >> _SHIFT
    x *= _B
    return x


def block_size(period: int, least: int) -> int:
    """The largest power of two H such that each run of this period has 2H - 1 words in a row that equal the words a period later."""
    return 1 << ((max(period, least - period) + 1) // 2).bit_length() - 1


def levels(longest: int, least: int) -> list[tuple[int, int, int]]:
    """(H, low, high): periods in [low, high) are caught by blocks of H words."""
    out, low = [], 1
    while low <= longest:
        size, high = block_size(low, least), low + 1
        if low >= least:
            high = 4 * size - 1
        else:
            while high < least and block_size(high, least) == size:
                high += 1
        out.append((size, low, min(high, longest + 1)))
        low = high
    return out


class Catchers:
    """The runs of a sequence of at most ``room`` words (as 64-bit numbers) that grows by appending; none is longer than ``longest``."""

    def __init__(self, room: int, least: int = LEAST, longest: int | None = None):
        self.least, self.size = least, 0
        self.words = np.empty(room, np.uint64)
        self.levels = levels((room if longest is None else longest) // 2, least)
        top = max((size for size, _, _ in self.levels), default=0)
        self.suffixes: dict[int, tuple[int, np.ndarray]] = {}  # by H: the first position and the hashes that the next words still need
        self.blocks: dict[int, np.ndarray] = {}
        size = 1
        while size <= top:
            self.suffixes[size] = (0, np.empty(0, np.uint64))
            self.blocks[size] = np.empty(room // size + 1, np.uint64)
            size *= 2
        self.open: dict[int, int] = {}  # by period: the start of the stretch that reaches the last word
        self.found: dict[tuple[int, int], int] = {}  # (start, length): period

    def append(self, new: np.ndarray) -> None:
        before = self.size
        self.size += len(new)
        self.words[before : self.size] = new
        for period, start in list(self.open.items()):
            self._settle(period, start, self._right(max(start, before - period), period))
        caught = self._caught(before)
        if len(caught[0]):
            self._extend(*caught)
        squares = [(p, s) for p, s in self.open.items() if self.size - p - s >= p]
        for q, start in squares:
            for p in [p for p, s in self.open.items() if p > q and p % q == 0 and s == start]:
                del self.open[p]

    def finish(self) -> list[Run]:
        for period, start in self.open.items():
            self._report(period, start, self.size - period)
        self.open = {}
        return sorted(((start, length, period) for (start, length), period in self.found.items()), key=lambda r: (r[0], r[2]))

    def _report(self, period: int, start: int, stop: int) -> bool:
        if stop - start < max(period, self.least - period):
            return False
        at = (start, stop - start + period)
        self.found[at] = min(period, self.found.get(at, period))
        return True

    def _settle(self, period: int, start: int, stop: int) -> bool:
        """A stretch [start, stop): open where it reaches the last word, else reported; whether it holds a square so far."""
        if stop == self.size - period:
            self.open[period] = start
            return stop - start >= period
        self.open.pop(period, None)
        return self._report(period, start, stop)

    def _right(self, at: int, period: int) -> int:
        """The first position from ``at`` on whose word differs from the one a period later, or the last that has one."""
        w, end, step = self.words, self.size - period, 32
        while at < end:
            stop = min(at + step, end)
            differ = w[at:stop] != w[at + period : stop + period]
            first = int(differ.argmax())
            if differ[first]:
                return at + first
            at, step = stop, min(4 * step, SLICE)
        return end

    def _left(self, at: int, period: int) -> int:
        """The first position of the stretch that ends before ``at``."""
        w, step = self.words, 32
        while at > 0:
            start = max(at - step, 0)
            differ = (w[start:at] != w[start + period : at + period])[::-1]
            first = int(differ.argmax())
            if differ[first]:
                return at - first
            at, step = start, min(4 * step, SLICE)
        return 0

    def _hashed(self, before: int) -> None:
        """Hashes of the suffixes that the new words end, and of the blocks they complete."""
        below = None
        for size, blocks in self.blocks.items():
            first, kept = self.suffixes[size]
            done = first + len(kept)  # positions before this one are hashed
            if below is None:
                new = self.words[before : self.size]
            else:
                start, shorter = below
                at, half, count = done - start, size // 2, max(self.size - size + 1 - done, 0)
                new = _joined(shorter[at : at + count], shorter[at + half : at + half + count])
            values = np.concatenate([kept, new]) if len(kept) else new
            k = -(-first // size)
            own = values[k * size - first :: size]
            blocks[k : k + len(own)] = own
            self.suffixes[size] = below = (first, values)

    def _caught(self, before: int) -> tuple[np.ndarray, np.ndarray]:
        """(period, start of the block) of each suffix, ended by a new word, that equals a block at a distance among its level's periods; one of blocks in a row."""
        self._hashed(before)
        periods, starts = [], []
        for size, low, high in self.levels:
            first, values = self.suffixes[size]
            from_ = max(before - size + 1, low, first)
            if self.size - size < from_:
                continue
            suffix = values[from_ - first : self.size - size + 1 - first]
            at = np.arange(from_, from_ + len(suffix))
            block = (at - low) // size
            for back in range(-(-(high - low) // size)):
                k = block - back
                same = np.flatnonzero((self.blocks[size][k] == suffix) & (k >= 0))  # k < 0 reads some other block
                if len(same):
                    start = k[same] * size
                    period = at[same] - start
                    fits = period < high
                    periods.append(period[fits])
                    starts.append(start[fits])
        for size, (first, values) in self.suffixes.items():  # the level above needs as many words back as it is long
            cut = max(self.size - 2 * size + 1, first)
            self.suffixes[size] = (cut, values[cut - first :].copy())
        if not periods:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        period, start = np.concatenate(periods), np.concatenate(starts)
        order = np.lexsort((start, period))
        return period[order], start[order]

    def _extend(self, periods: np.ndarray, starts: np.ndarray) -> None:
        """Caught blocks, by period and start, become stretches."""
        live = np.ones(len(periods), bool)
        own, which = np.unique(periods, return_inverse=True)
        sizes = np.array([block_size(int(p), self.least) for p in own])[which]
        live[1:] = (periods[1:] != periods[:-1]) | (starts[1:] - starts[:-1] > sizes[1:])
        for q, start in self.open.items():
            if self.size - q - start >= q:
                live &= (periods % q != 0) | (starts < start)
        past = (0, 0)
        for i in np.flatnonzero(live):
            if not live[i]:
                continue
            period, start = int(periods[i]), int(starts[i])
            if period == past[0] and start < past[1] or start >= self.open.get(period, self.size):
                continue
            stop = self._right(start, period)
            if stop - start < sizes[i]:
                continue  # two blocks of one hash
            first = self._left(start, period)
            past = (period, stop)
            if self._settle(period, first, stop):
                live[i:] &= (periods[i:] % period != 0) | (starts[i:] < first) | (starts[i:] + periods[i:] >= stop + period)


def runs(words: np.ndarray, least: int = LEAST, step: int = APPEND, longest: int | None = None) -> list[Run]:
    """(start, length, period) of all runs, by start and then period."""
    c = Catchers(len(words), least, longest)
    for at in range(0, len(words), step):
        c.append(words[at : at + step])
    return c.finish()


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[list[Run]]:
    """The runs of each of several sequences.  Short ones are appended to the same catchers, parted by words that occur once."""
    out: list[list[Run]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        stop, room = at, 0
        while stop < len(texts) and (stop == at or room + len(texts[stop]) < TOGETHER):
            room += len(texts[stop]) + 1
            stop += 1
        parts = [np.append(t & ~_MARK, _MARK | np.uint64(i)) for i, t in enumerate(texts[at:stop])]
        starts = np.cumsum([0, *map(len, parts)])
        found = runs(np.concatenate(parts), least, longest=max(map(len, texts[at:stop])))
        own = np.searchsorted(starts, [r[0] for r in found], side="right") - 1
        for (start, length, period), i in zip(found, own.tolist()):
            out[at + i].append((start - int(starts[i]), length, period))
        at = stop
    return out


def kept(n: int, found: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay: of each run the first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def hashed(data: bytes) -> np.ndarray:
    return np.concatenate([word_hashes(c.split()) for c in chunks(data)])


def planted(key: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): in a tenth of the documents, by key, the words from ``a`` on repeat with period ``p``."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    a = h // 10 % n
    return a, 1 + (n - a) // (3 + h // 10 % 8)


def _mapped(docs: DataFrame, key: str, text: str, schema: str, fn: Callable) -> DataFrame:
    """``fn(keys, texts)`` gives the rows (tuples) of each of several documents."""
    names, types = zip(*((s.split()[0], {"long": pa.int64(), "string": pa.string()}[s.split()[1]]) for s in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(b.column(0).to_pylist(), [text_bytes(t.as_py()) for t in b.column(1)])
            at = np.repeat(np.arange(len(made)), [len(rows) for rows in made])
            columns = zip(*(row for rows in made for row in rows)) if len(at) else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, types))], names=[key, *names])

    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_arrow(own, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {schema}")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, start, length, period): every run of every document."""
    return _mapped(docs, key, text, "start long, length long, period long", lambda _, texts: runs_of([*map(hashed, texts)], least))


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, collapsed): each run cut down to its first period, words joined by single spaces."""

    def fn(_, texts: list[bytes]):
        words = [*map(hashed, texts)]
        for data, w, found in zip(texts, words, runs_of(words, least)):
            at = np.flatnonzero(kept(len(w), found)) if found else None
            yield [(b"".join(written(data, at)).decode("utf-8", "replace"),)]

    return _mapped(docs, key, text, "collapsed string", lambda keys, texts: [*fn(keys, texts)])


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Per document its number of runs, the longest one, and digests of all runs and of what stays; a tenth of the documents are given a periodic end first."""

    def row(data: bytes, n: int, order: np.ndarray | None, found: list[Run]) -> tuple:
        if found:
            stay = np.flatnonzero(kept(n, found))
            order = stay if order is None else order[stay]
        all_runs, left = hashlib.sha256(), hashlib.sha256()
        for i in range(0, len(found), SLICE):
            all_runs.update("".join(f"{s},{length},{q}\n" for s, length, q in found[i : i + SLICE]).encode())
        for part in written(data, order):
            left.update(part)
        start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        return len(found), start, length, period, 1000 * length // period if found else None, all_runs.hexdigest(), left.hexdigest()

    def fn(keys: list, texts: list[bytes]) -> list[list[tuple]]:
        words, orders = [*map(hashed, texts)], []
        for i, (k, w) in enumerate(zip(keys, words)):
            order = None
            if plant := planted(k, len(w)):
                a, p = plant
                order = np.arange(len(w))
                order[a:] = a + (order[a:] - a) % p
                words[i] = w[order]
            orders.append(order)
        return [[row(data, len(w), order, found)] for data, w, order, found in zip(texts, words, orders, runs_of(words, least))]

    return _mapped(docs, key, text, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", fn)


ORACLE_SQL = rf"""
WITH {CRC_SQL},
d AS (
  SELECT row_number() OVER () AS r, doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS own, {crc32_sql("doc_id")} AS h FROM documents, crc),
plants AS (SELECT *, len(own) AS n, (h // 10) % greatest(len(own), 1) AS a, h // 10 % 8 AS m FROM d),
words AS (
  SELECT r, i, own[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + m)) ELSE i END] AS x
  FROM (SELECT *, unnest(range(n)) AS i FROM plants)),
same AS (SELECT v.r, w.i - v.i AS p, v.i FROM words v JOIN words w ON v.r = w.r AND v.x = w.x AND w.i > v.i),
stretches AS (
  SELECT r, p, min(i) AS s, count(*) AS c FROM (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS g FROM same) GROUP BY r, p, g HAVING count(*) >= greatest(p, 12 - p)),
runs AS (SELECT r, s, c + p AS l, min(p) AS q FROM stretches GROUP BY r, s, c + p),
every AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY r),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY l DESC, s, q) = 1),
turns AS (SELECT r, i, sum(x) AS x FROM (SELECT r, s + q AS i, 1 AS x FROM runs UNION ALL SELECT r, s + l, -1 FROM runs) GROUP BY r, i),
depths AS (SELECT words.r, words.i, words.x, sum(coalesce(turns.x, 0)) OVER (PARTITION BY words.r ORDER BY words.i) AS c FROM words LEFT JOIN turns ON turns.r = words.r AND turns.i = words.i),
texts AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM depths WHERE c = 0 GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli,
  sha256(coalesce(every.t, '')) AS runs_sha256, sha256(coalesce(texts.t, '')) AS collapsed_sha256
FROM d LEFT JOIN every USING (r) LEFT JOIN longest USING (r) LEFT JOIN texts USING (r)
"""
