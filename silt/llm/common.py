"""What the text operators share: reading, word splitting, hashing, Arrow maps, tables in the shared folder.

Words are maximal runs of bytes other than space and 0x09-0x0D, which is how ``bytes.split`` without
arguments splits UTF-8.  Texts longer than ``CHUNK`` bytes are taken apart at white space, so a worker holds
the words of one chunk and not those of a whole giant document.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.shared import shared_dir

CHUNK = 1 << 20
BLOCK = 4 << 20  # bytes of text whose words a worker holds at once
SLICE = 1 << 16  # words written at once
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
PARTITION_BYTES = 64 << 20  # stored bytes of input that a shuffle by key deals to one partition,
MAX_PARTITIONS = 20_000  # or more of them where that would make more partitions than this: map tasks times partitions are blocks to keep track of
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def made_here() -> Iterator[list[str]]:
    """The paths that this thread's ``saved`` and ``new_folder`` make inside, for ``delete`` once nothing reads them; what is left in the list also counts for who called."""
    paths: list[str] = []
    outer = _made.get()
    token = _made.set(paths)
    try:
        yield paths
    finally:
        _made.reset(token)
        if outer is not None:
            outer.extend(paths)


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later steps don't recompute it."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders and takes them off the list."""
    jvm = spark.sparkContext._jvm
    while paths:
        p = jvm.org.apache.hadoop.fs.Path(paths.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if b.num_rows <= 1 or b.num_rows <= BATCH_ROWS and b.nbytes <= BATCH_BYTES:
        yield b
        return
    half = b.num_rows // 2
    yield from _parts(b.slice(0, half))
    yield from _parts(b.slice(half))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose batches hold at most BATCH_ROWS rows and, but for a longer single row, BATCH_BYTES; Spark itself bounds what it sends at once (64 MB and a row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(part for b in batches for part in _parts(b))

    return df.mapInArrow(run, schema)


_SPACES = b" \t\n\v\f\r"
_LOWER = bytes(range(256)).lower()


def word_blocks(column: pa.Array, lower: bool) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The words (binary) of all texts of a column and the row of each, in order, in blocks of about BLOCK bytes of text."""
    column = column.cast(pa.large_string()).fill_null("")
    limits = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not len(column) or data is None or limits[0] == limits[-1]:
        return
    text, at, last = np.frombuffer(data, np.uint8), int(limits[0]), int(limits[-1])
    while at < last:
        stop = min(at + BLOCK, last)
        if stop < last:
            space = _SPACE.search(data, stop, int(limits[np.searchsorted(limits, stop)]))
            stop = space.start() if space else int(limits[np.searchsorted(limits, stop)])
        part = text[at:stop]
        word = (part != 32) & (part - np.uint8(9) > 4)
        turns = np.flatnonzero(word[1:] != word[:-1]) + 1  # a word or a run of spaces ends
        rows = np.arange(*np.searchsorted(limits, [at + 1, stop], side="left"))
        cuts = np.unique(limits[rows]) - at  # a text ends inside the block
        cuts = cuts[word[cuts] & word[cuts - 1]]
        if len(cuts):
            turns = np.sort(np.r_[turns, cuts, cuts])  # one word ends there and another begins
        turns = np.r_[[0] * bool(word[0]), turns, [len(part)] * bool(word[-1])].astype(np.int64)
        starts = turns[::2]
        ends = np.r_[0, np.cumsum(turns[1::2] - starts)]
        kept = part.tobytes().translate(_LOWER if lower else None, _SPACES)
        tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
        yield tokens, np.searchsorted(limits, starts + at, side="right") - 1
        at = stop


def chunks(data: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """``data`` cut at white space into parts of about ``size`` bytes; the words of the parts are its words."""
    at, n = 0, len(data)
    while n - at > size:
        cut = _SPACE.search(data, at + size)
        if cut is None:
            break
        yield data[at : cut.start()]
        at = cut.end()
    yield data[at:] if at else data


def word_limits(data: bytes, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all words, and the bytes behind their last ones."""
    raw, turns, inside = np.frombuffer(data, np.uint8), [np.empty(0, np.int64)], False
    for at in range(0, len(raw), block):
        part = raw[at : at + block]
        word = (part != 32) & (part - np.uint8(9) > 4)
        turn = np.flatnonzero(word[1:] != word[:-1]) + 1 + at
        turns.append(np.r_[[at] * int(word[0] != inside), turn].astype(np.int64))
        inside = bool(word[-1])
    every = np.concatenate([*turns, [len(raw)] * int(inside)]).astype(np.int32)
    return every[::2], every[1::2]


def written(data: bytes, at: np.ndarray | None) -> Iterator[bytes]:
    """The words ``at`` (all, where None) joined by single spaces, in parts."""
    between = b""
    if at is None:
        for c in chunks(data):
            if words := c.split():
                yield between + b" ".join(words)
                between = b" "
        return
    starts, stops = word_limits(data)
    for i in range(0, len(at), SLICE):
        part = at[i : i + SLICE]
        yield between + b" ".join([data[a:b] for a, b in zip(starts[part].tolist(), stops[part].tolist())])
        between = b" "


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _MIX + h[j : j + n]
    return mixed(out)


def hash_arrays(text: str | None, lower: bool, seed: int = 0) -> np.ndarray:
    """The word hashes of a whole text."""
    data = text_bytes(text)
    parts = [word_hashes((c.lower() if lower else c).split(), seed) for c in chunks(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def partitions(df: DataFrame) -> int:
    """How many partitions to deal ``df`` to: the session's number, or up to MAX_PARTITIONS where its sources hold more than PARTITION_BYTES for each of those."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    stored = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    known = stored if stored < 1 << 60 else 0  # a leaf of unknown size counts as endless
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-known // PARTITION_BYTES), MAX_PARTITIONS))


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    end = ""
    while any((s + end).lower() in taken for s in stems):
        end += "_"
    return [s + end for s in stems]


def sha2_hex(col) -> F.Column:
    return F.sha2(F.encode(col, "UTF-8"), 256)


# DuckDB has no crc32: a CTE with its table, and the checksum of a column's decimal or text form.
CRC_SQL = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc32_sql(column: str) -> str:
    """SQL for the checksum of ``column`` (ASCII), beside a join with ``crc``."""
    codes = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])))"


def on_cluster_path(path: str) -> str:
    return path if re.match(r"\w+:", path) else f"file://{os.path.abspath(path)}"
