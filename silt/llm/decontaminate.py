"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item lies inside a long document, so their Jaccard similarity says little; what counts is the share of
the item's shingles (``SHINGLE`` words, ASCII lower case) that the document holds.  Items are partitioned by their
number of distinct shingles, in classes that double.  In a class whose largest size is u, an item's sketch is its
k = floor((1 - threshold) * u) + 1 smallest shingle hashes (bottom-k MinHash).  A document that holds the threshold's
share misses fewer than k of an item's shingles, so it holds at least one value of the sketch: the search loses no pair.
Items which a document's own hashes meet in a sketch are candidates; each is verified by the exact words of its shingles.

Items go to the executors in blocks of about ``BLOCK_BYTES`` of text, measured before they are read, so what is
broadcast is bounded; a larger benchmark takes more blocks, each over all documents and one at a time: its result is written and
its index dropped before the driver reads the next.  Documents are never shuffled.

Defined cases: null and wordless texts hold nothing; a null or wordless item is in no document; an item of fewer than
``SHINGLE`` words is one shingle of its own length; repeated rows on either side give a row each; null keys are kept as keys;
an empty table on either side gives an empty result, and ``drop_contaminated`` then keeps all; extra columns are left alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import chunks, gram_hashes, map_arrow, saved, text_bytes, word_hashes

SHINGLE, THRESHOLD = 5, Fraction(4, 5)
BLOCK_BYTES = 16 << 20
REMEMBERED = 4096  # items whose shingles a worker keeps


class ItemIndex:
    """Sketches of one block of items, in classes of size, as arrays of hashes, and the items' texts: at most four times the texts' size."""

    def __init__(self, items: list[tuple[object, str | None]], threshold: Fraction = THRESHOLD):
        self.threshold = threshold
        self.keys: list[object] = []
        self.texts: list[bytes] = []  # lower case, words joined by single spaces
        self.sizes: list[tuple[int, int]] = []  # words in a shingle, shingles
        self._sets: dict[int, frozenset] = {}
        every: dict[int, list[np.ndarray]] = defaultdict(list)
        sketch: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for key, text in items:
            words = text_bytes(text).lower().split()
            if not words:
                continue
            k = min(SHINGLE, len(words))
            n = len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
            hashes = np.unique(gram_hashes(word_hashes(words), k))
            largest = 1 << (n - 1).bit_length()
            sketch[k].append((hashes[: floor((1 - threshold) * largest) + 1], len(self.keys)))
            every[k].append(hashes)
            self.keys.append(key)
            self.texts.append(b" ".join(words))
            self.sizes.append((k, n))
        self.every = {k: np.unique(np.concatenate(v)) for k, v in every.items()}
        self.filters = {k: _bits(v) for k, v in self.every.items()}
        self.sketch: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # hashes, and the item of each
        for k, v in sketch.items():
            hashes, owner = np.concatenate([h for h, _ in v]), np.repeat(np.array([i for _, i in v], np.int32), [len(h) for h, _ in v])
            order = np.argsort(hashes, kind="stable")
            self.sketch[k] = hashes[order], owner[order]

    def shingles(self, i: int) -> frozenset:
        """An item's shingles; those of items met lately are kept."""
        if i not in self._sets:
            if len(self._sets) >= REMEMBERED:
                self._sets.clear()
            words, k = self.texts[i].split(b" "), self.sizes[i][0]
            self._sets[i] = frozenset(tuple(words[j : j + k]) for j in range(len(words) - k + 1))
        return self._sets[i]

    def held(self, text: str | None) -> Iterator[tuple[object, int, int]]:
        """(item key, its shingles, those in the text) of each item of which the text holds the threshold's share."""
        met: dict[int, set] = defaultdict(set)  # the text's shingles that may be of an item, by length
        seen: set[int] = set()
        tail: list[bytes] = []
        for part in chunks(text_bytes(text)):
            words = tail + part.lower().split()
            h = word_hashes(words)
            for k, bits in self.filters.items():
                grams = gram_hashes(h, k)
                at = np.flatnonzero(_set(bits, grams))
                if not len(at):
                    continue
                spot = np.minimum(np.searchsorted(self.every[k], grams[at]), len(self.every[k]) - 1)
                at = at[self.every[k][spot] == grams[at]]
                for i in at.tolist():
                    met[k].add(tuple(words[i : i + k]))
                hashes, owner = self.sketch[k]
                low, high = np.searchsorted(hashes, grams[at], "left"), np.searchsorted(hashes, grams[at], "right")
                for a, b in zip(low[high > low].tolist(), high[high > low].tolist()):
                    seen.update(owner[a:b].tolist())
            tail = words[-(SHINGLE - 1) :]
        for i in sorted(seen):
            k, whole = self.sizes[i]
            n = len(self.shingles(i) & met[k])
            if Fraction(n, whole) >= self.threshold:
                yield self.keys[i], whole, n


def _places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for each hash, of ``size`` bytes (a power of two)."""
    mask = np.uint64(8 * size - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _bits(hashes: np.ndarray) -> np.ndarray:
    """A filter of one to two bytes a hash: most shingles of a document end here."""
    out = np.zeros(1 << max(10, int(len(hashes) - 1).bit_length()), np.uint8)
    for bit in _places(hashes, len(out)):
        np.bitwise_or.at(out, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
    return out


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both bits."""
    first, second = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) for bit in _places(hashes, len(bits)))
    return (first & second & 1).astype(bool)


def indexes(items: DataFrame, key: str, text: str) -> Iterator[tuple[object, bool]]:
    """(broadcast index, whether it is the last) of one block of items after the other; all but the last are dropped when the next is asked for."""
    spark = items.sparkSession
    total = items.select(F.coalesce(F.sum(F.octet_length(text) + 16), F.lit(0))).first()[0]
    n = total // BLOCK_BYTES + 1
    dealt = items.select(F.col(key).alias("key"), F.col(text).alias("text"), F.pmod(F.xxhash64(text, key), F.lit(n)).alias("block"))
    for i in range(n):
        index = spark.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in dealt.where(F.col("block") == i).select("key", "text").collect()]))
        yield index, i == n - 1
        if i < n - 1:
            index.destroy()


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, n_shingles, n_shared, containment) of each document and item it holds to the threshold or more."""
    kinds = f"{key} {docs.schema[key].dataType.simpleString()}, {item_key} {items.schema[item_key].dataType.simpleString()}"
    out = None
    for index, last in indexes(items, item_key, item_text):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(i, *hit) for i, t in enumerate(b.column(1).to_pylist()) for hit in index.value.held(t)]
                keys = b.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                rest = [pa.array([x[1] for x in found], item_type), *(pa.array([x[j] for x in found], pa.int64()) for j in (2, 3))]
                yield pa.RecordBatch.from_arrays([keys, *rest, pa.array([x[3] / x[2] for x in found], pa.float64())], names=[key, item_key, "n_shingles", "n_shared", "containment"])

        item_type = _arrow(items.schema[item_key].dataType)
        rows = map_arrow(docs.select(key, text), run, f"{kinds}, n_shingles long, n_shared long, containment double")
        rows = rows if last else saved(rows, "contained")
        out = rows if out is None else out.unionByName(rows)
    return out


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item; decided row by row, so all columns stay and nothing is shuffled."""
    at = docs.columns.index(text)
    for index, last in indexes(items, item_key, item_text):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([next(index.value.held(t), None) is None for t in b.column(at).to_pylist()], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
        docs = docs if last else saved(docs, "decontaminated")
    return docs


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contained(docs, items)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
i AS (
  SELECT row_number() OVER () AS r, item_id,
         [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM benchmark),
ig AS (
  SELECT DISTINCT r, item_id, least(5, len(w)) AS k, array_to_string(w[g:g + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT r, item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS g FROM i WHERE len(w) > 0)),
dg AS (
  SELECT DISTINCT r, doc_id, k, array_to_string(w[g:g + k - 1], ' ') AS s
  FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS g FROM d, (SELECT DISTINCT k FROM ig) WHERE len(w) >= k)),
n AS (SELECT r, count(*) AS n_shingles FROM ig GROUP BY r)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM ig JOIN dg USING (k, s) JOIN n ON n.r = ig.r
GROUP BY dg.r, doc_id, ig.r, item_id, n_shingles
HAVING count(*) * 5 >= n_shingles * 4
"""
