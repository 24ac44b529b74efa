"""Pairs of people from lists of them, in two steps of Arrow tasks with one shuffle between.

A list is a sorted array of people who share something.  Each person is dealt to a part by a hash of the name, and a part gets, once for each list with people of its own, the
list from the first of them on.  What a task sends to a part goes as columns that are compressed together, so an entry of a list takes a few bytes and not a row with a name;
the part counts the pairs of its people with those behind them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ENTRIES = 2 << 20  # entries of lists that a task packs, or pairs that it counts, at once
KEPT = 16 << 20  # entries that a part unpacks at once; where it has more, it takes its people in turns
TURNS = 254
ROWS = 1 << 17
PACKED = "part int, lists long, entries long, chars long, packed binary"
PAIRS = "a string, na long, b string, nb long, shared long"
_CODEC = pa.Codec("zstd")


class Lists(NamedTuple):
    """Lists one after another: how long each is, and for each entry its turn (1 and up for the part's own people, else 0), side (entries of equal sides but 0 don't pair), n and name."""

    sizes: np.ndarray
    turns: np.ndarray
    sides: np.ndarray
    n: np.ndarray
    names: pa.Array


def _planes(x: np.ndarray) -> bytes:
    """The bytes of equal weight side by side: those that hardly differ take no room once compressed."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplaned(data: np.ndarray, kind: type, count: int) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(-1, count).T).reshape(-1).view(kind)


def _alike(lengths: np.ndarray) -> bool:
    """Whether names are all of one length, so that their bytes have equal places too."""
    return len(lengths) > 0 and lengths[0] > 0 and bool((lengths == lengths[0]).all())


def _limits(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    return np.repeat(starts - _limits(lengths)[:-1], lengths) + np.arange(lengths.sum())


def pack(x: Lists) -> tuple[int, int, int, bytes]:
    """Numbers of lists, entries and bytes of names, and all of it compressed."""
    offsets = np.frombuffer(x.names.buffers()[1], np.int64)[x.names.offset : x.names.offset + len(x.names) + 1]
    chars = x.names.buffers()[2]
    chars = b"" if chars is None else chars.to_pybytes()[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    text = _planes(np.frombuffer(chars, np.uint8).reshape(len(lengths), -1)) if _alike(lengths) else chars
    data = b"".join([_planes(x.sizes.astype(np.int64)), x.turns.tobytes(), x.sides.tobytes(), _planes(x.n), _planes(lengths), text])
    return len(x.sizes), len(x.names), len(chars), _CODEC.compress(data, asbytes=True)


def unpack(lists: int, entries: int, chars: int, packed: bytes) -> Lists:
    data = np.frombuffer(_CODEC.decompress(packed, decompressed_size=8 * lists + 18 * entries + chars), np.uint8)
    sizes, turns, sides, n, lengths, text = np.split(data, np.cumsum([8 * lists, entries, entries, 8 * entries, 8 * entries]))
    lengths = _unplaned(lengths, np.int64, entries)
    text, offsets = _unplaned(text, np.uint8, entries) if _alike(lengths) else text, _limits(lengths)
    names = pa.LargeStringArray.from_buffers(entries, pa.py_buffer(offsets), pa.py_buffer(text))
    return Lists(_unplaned(sizes, np.int64, lists), turns, sides, _unplaned(n, np.int64, entries), names)


def _cuts(work: np.ndarray, most: int) -> list[int]:
    """Places that cut a sequence into parts of about ``most`` work each."""
    done = np.cumsum(work) // most
    return [0, *(np.flatnonzero(done[1:] != done[:-1]) + 1).tolist(), len(work)] if len(work) else [0]


def _packed(b: pa.RecordBatch, parts: int, most: int) -> Iterator[pa.RecordBatch]:
    people = b["people"]
    offsets = people.offsets.to_numpy().astype(np.int64)
    name, n, slice_, h = people.values.flatten()
    name, n, slice_, h = name.cast(pa.large_string()), n.to_numpy(), slice_.to_numpy(), h.to_numpy()
    part, turn = np.mod(h, parts), (1 + np.mod(h // parts, TURNS)).astype(np.uint8)
    i, j = b["i"].to_numpy(), b["j"].to_numpy()
    sizes = np.diff(offsets)
    for x, y in pairwise(_cuts(sizes * (sizes - 1) // 2, ENTRIES)):
        ends = offsets[x + 1 : y + 1]
        at, row = np.arange(offsets[x], offsets[y]), np.repeat(np.arange(y - x), sizes[x:y])
        own = at[(n[at] <= most) & (at < ends[row] - 1)]
        keys, first = np.unique(part[own] * (y - x) + row[own - offsets[x]], return_index=True)
        if not len(keys):
            continue
        to, of, first = keys // (y - x), keys % (y - x), own[first]
        lengths = ends[of] - first
        every, limits = _runs(first, lengths), _limits(lengths)
        turns = np.where((n[every] <= most) & (part[every] == np.repeat(to, lengths)), turn[every], np.uint8(0))
        crossed = np.repeat((i != j)[x:y][of], lengths)
        sides = np.where(crossed, np.where(slice_[every] == np.repeat(i[x:y][of], lengths), 1, 2), 0).astype(np.uint8)
        rows = []
        for u, v in pairwise([0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]):
            s, e = limits[u], limits[v]
            rows.append((int(to[u]), *pack(Lists(lengths[u:v], turns[s:e], sides[s:e], n[every[s:e]], name.take(pa.array(every[s:e]))))))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])], ["part", "lists", "entries", "chars", "packed"])


def _taken(x: Lists, turn: int, turns: int) -> tuple[Lists, np.ndarray]:
    """The lists with people whose turn it is, and the places of these."""
    mine = (x.turns > 0) & (x.turns % turns == turn)
    if turns > 1:
        row = np.repeat(np.arange(len(x.sizes)), x.sizes)
        kept = np.bincount(row[mine], minlength=len(x.sizes)) > 0
        every = np.flatnonzero(kept[row])
        x, mine = Lists(x.sizes[kept], x.turns[every], x.sides[every], x.n[every], x.names.take(pa.array(every))), mine[every]
    return x, np.flatnonzero(mine)


def _pairs(found: Sequence[tuple[int, int, int, bytes]], turn: int, turns: int) -> Iterator[pa.RecordBatch]:
    names, n, sides, places, behind, at = [], [], [], [], [], 0
    for blob in found:
        x, mine = _taken(unpack(*blob), turn, turns)
        ends = np.repeat(np.cumsum(x.sizes), x.sizes)
        names.append(x.names.dictionary_encode())
        n.append(x.n)
        sides.append(x.sides)
        places.append(mine + at)
        behind.append(ends[mine] - mine - 1)
        at += len(x.names)
    coded = pa.chunked_array(names, names[0].type).unify_dictionaries()
    known = coded.chunk(0).dictionary
    code = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
    del names, coded
    side, places, behind = np.concatenate(sides), np.concatenate(places), np.concatenate(behind)
    n_of = np.zeros(len(known), np.int64)
    n_of[code] = np.concatenate(n)
    order = np.argsort(code[places], kind="stable")
    places, behind = places[order], behind[order]
    who = code[places]
    firsts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.empty(0, np.int64)
    limits = np.r_[firsts, len(who)]
    for u, v in pairwise(_cuts(np.add.reduceat(behind, firsts) if len(firsts) else firsts, ENTRIES)):
        s, e = limits[u], limits[v]
        left, right = np.repeat(places[s:e], behind[s:e]), _runs(places[s:e] + 1, behind[s:e])
        keys = code[left] << 32 | code[right]
        keys = np.sort(keys[(side[left] == 0) | (side[left] != side[right])])
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        shared, keys = np.diff(np.r_[starts, len(keys)]), keys[starts]
        for k in range(0, len(keys), ROWS):
            a, b = keys[k : k + ROWS] >> 32, keys[k : k + ROWS] & 0xFFFFFFFF
            one, other = (known.take(pa.array(c)).cast(pa.string()) for c in (a, b))
            yield pa.record_batch([one, pa.array(n_of[a]), other, pa.array(n_of[b]), pa.array(shared[k : k + ROWS])], ["a", "na", "b", "nb", "shared"])


def pairs_of(lists: DataFrame, parts: int, most: int) -> DataFrame:
    """(a, na, b, nb, shared): how many lists hold both ``a``, of at most ``most`` as ``n``, and ``b`` behind it.

    ``lists`` has i, j and people, an array of (author, n, slice, h: a hash of the author) by author; where i and j differ, only people of different slices pair.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _packed(b, parts, most)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [tuple(r.values()) for b in batches for r in b.select(["lists", "entries", "chars", "packed"]).to_pylist()]
        turns = min(-(-sum(r[1] for r in found) // KEPT), TURNS)
        for turn in range(turns):
            yield from _pairs(found, turn, turns)

    return lists.select("i", "j", "people").mapInArrow(packed, PACKED).repartitionById(parts, "part").mapInArrow(counted, PAIRS)
