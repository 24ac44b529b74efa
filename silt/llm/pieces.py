"""SentencePiece encoding and decoding by a max-plus parallel scan.

The model is a byte-pair one with byte fallback.  Its encoding of a text is the one path through the lattice of pieces on which every two
neighbours are compatible, that is, on which encoding the two alone gives the two back: merges inside a pair's span happen in the same order
whatever stands beside it, so a path of compatible pairs is the full encoding, and there is only one.  Paths therefore have weights in the max-plus
semiring: 0 for a compatible step, minus infinity for any other.

Where no piece can span a place (before a space run, beside a character that is in no longer piece) all paths pass through it.  Between two such
places the best path is a function of the characters, so it is worked out once for each distinct segment and remembered.

Texts of over ``GIANT`` characters are split into chunks at any place.  A state of a chunk's boundary is a piece that crosses it or ends there, given by the
characters it has on either side; a chunk yields the transfer matrix from its entry states to its exit states (kept sparse: what is absent is minus
infinity).  Matrices are combined in a tree, ``FANIN`` neighbours at a time and each group of them in a task of its own, up to the whole text's; from there down every group's entry
and exit fix those of its members, and every chunk is then traced back by itself, in another task.

Defined cases: null and empty texts have no ids and decode to an empty text; equal texts have equal ids; characters unknown to the model become their UTF-8 bytes;
a literal U+2581 decodes to a space, as the model has it; null keys and repeated rows stay; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import map_arrow, partitions, saved, text_bytes, unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT, CHUNK_CHARS = 1 << 16, 1 << 14
FANIN = 8
REMEMBERED = 350_000
SPACE = "▁"
State = tuple[int, int]  # characters of a piece before and after a boundary
START: State = (0, 0)
_FREE = 0xFFFF  # in place of the piece before the first


class Codec:
    """The pieces of a model and its encoding as a path of compatible pieces."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.vocab_size()
        odd = [i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)]
        self.pieces = {p: i for i, p in enumerate(sp.id_to_piece(list(range(n)))) if i not in set(odd)}
        self.scores = {p: sp.get_score(i) for p, i in self.pieces.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.plain = [b""] * n
        for p, i in self.pieces.items():
            self.plain[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.plain[i] = bytes([b])
        self.longest = max(map(len, self.pieces))
        joined = {c for p in self.pieces if len(p) > 1 for c in p}
        self.joined = joined
        self.bigrams = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.names = dict(zip(self.pieces.values(), self.pieces))
        self.whole = all(c in self.pieces for c in joined) and n < _FREE
        ranks = {s: 2 * r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.ranks = {i: ranks[self.scores[p]] if len(p) > 1 else -1 for p, i in self.pieces.items()}
        tied = {s for s in self.scores.values() if s <= -1e9}
        self.tied = {i for p, i in self.pieces.items() if self.scores[p] in tied and len(p) > 1}
        self.trie: dict[str, tuple[int, dict]] = {}  # a character: (the piece that ends here or -1, what may follow)
        for p in sorted(self.pieces, key=len):
            kids = self.trie
            for c in p[:-1]:
                kids = kids.setdefault(c, (-1, {}))[1]
            kids[p[-1]] = (self.pieces[p], kids[p[-1]][1] if p[-1] in kids else {})
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._joint: dict[int, bool] = {}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("pieces that hold a space after a letter aren't supported")
        # A run of letters ends, for good, at a mark that follows a letter in no piece.
        marks = "".join(re.escape(chr(q)) for q in range(33, 127) if not chr(q).isalnum() and not any(g[1] == chr(q) and g[0].isalpha() for g in self.bigrams))
        line = "" if "\n" in joined else r"\n"
        self.segment = re.compile(rf"{line or '(?!)'}|{SPACE}*[^\W\d_]++(?=[{marks}{SPACE}{line}]|\Z)|{SPACE}*[^{SPACE}{line}]+|{SPACE}+")
        self._pairs: dict[tuple[str, str], bool] = {}
        self._new: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}
        self._runs: dict[str, tuple[int, ...]] = {}

    def normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merged(self, s: str, trace: list | None = None) -> list[str]:
        """The encoding of a few characters by its definition: merge the best-scored, leftmost pair until none is left."""
        parts, scores = list(s), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            if trace is not None:
                trace.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a ('' before the first)."""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > 2 * REMEMBERED:
                self._pairs.clear()
            found = self._pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def split(self, b: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes piece b of its own characters; (-1, -1) for one character, None if they don't encode to b."""
        if b not in self._splits:
            p, trace = self.names[b], []
            alone = self.merged(p, trace) == [p]
            self._splits[b] = None if not alone else (self.pieces[trace[-1][0]], self.pieces[trace[-1][1]]) if trace else (-1, -1)
        return self._splits[b]

    def joint(self, a: int, b: int) -> bool:
        """``compatible`` by ids: merges are undone from the last one, and between any two of them the pieces at the seam must not have merged first."""
        if self.split(b) is None or a != _FREE and self.split(a) is None:
            return False
        if a == _FREE:
            return True
        if a in self.tied or b in self.tied:
            return self.merged(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
        limit = 1 << 60
        while True:
            c = self.pieces.get(self.names[a] + self.names[b])
            if c is not None and self.ranks[c] < limit:
                return False
            ra, rb = self.ranks[a], self.ranks[b]
            if ra > rb:
                limit, a = ra, self.split(a)[1]
            elif rb < 0:
                return True
            else:
                limit, b = rb + 1, self.split(b)[0]

    def run_ids(self, s: str) -> list[int]:
        """Ids of characters that are all pieces: ``forward`` and ``back`` by ids."""
        n, joint, chars, root = len(s), self._joint, list(s), self.trie
        last, start = [_FREE] * (n + 1), [0] * (n + 1)
        for j in range(n):
            a, i, kids = last[j] << 16, j, root
            for c in chars[j:]:
                i += 1
                node = kids.get(c)
                if node is None:
                    break
                b, kids = node
                if b >= 0 and last[i] == _FREE:
                    ok = joint.get(a | b)
                    if ok is None:
                        if len(joint) > 4 * REMEMBERED:
                            joint.clear()
                        ok = joint[a | b] = self.joint(last[j], b)
                    if ok:
                        last[i], start[i] = b, j
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def _worked_out(self, s: str) -> tuple[int, ...]:
        """Ids of a segment: cut wherever no piece holds the two characters, then the path through each run."""
        if len(s) > CHUNK_CHARS:
            return tuple(self.scanned(s))
        if not self.whole:
            return tuple(self.back(s, self.forward(s, {0: -1}, 0, len(s)), len(s), 0))
        bigrams = self.bigrams
        cuts = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in bigrams]
        if not cuts and len(s) > 1:
            return tuple(self.run_ids(s))
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(s)]):
            run = s[a:b]
            if b - a == 1:
                out += self.ids_of(run)
                continue
            found = self._runs.get(run)
            if found is None:
                found = tuple(self.run_ids(run))
                if b - a <= 32:
                    if len(self._runs) >= REMEMBERED:
                        self._runs.clear()
                    self._runs[run] = found
            out += found
        return tuple(out)

    def forward(self, z: str, last: dict[int, int], start: int, stop: int) -> dict[int, int]:
        """For each place up to ``stop`` that a path from the places in ``last`` reaches: where its last piece starts (-1: a free start)."""
        pieces, longest, pairs = self.pieces, self.longest, self._pairs
        for i in range(start + 1, stop + 1):
            for j in range(max(start, i - longest), i):
                before = last.get(j)
                if before is None:
                    continue
                p = z[j:i]
                if i - j > 1 and p not in pieces:
                    continue
                a = z[before:j] if before >= 0 else ""
                ok = pairs.get((a, p))
                if ok or ok is None and self.compatible(a, p):
                    last[i] = j
                    break
        return last

    def ids_of(self, p: str) -> tuple[int, ...]:
        i = self.pieces.get(p)
        return (i,) if i is not None else tuple(self.bytes[b] for b in text_bytes(p))

    def back(self, z: str, last: dict[int, int], at: int, to: int) -> list[int]:
        """Ids of the pieces on the path from place ``to`` to place ``at``."""
        parts = []
        while at > to:
            parts.append(z[last[at] : at])
            at = last[at]
        return [x for p in reversed(parts) for x in self.ids_of(p)]

    def segment_ids(self, s: str) -> tuple[int, ...]:
        found = self._new.get(s)
        if found is None:
            found = self._old.pop(s, None)
            if found is None:
                found = self._worked_out(s)
            if len(s) <= 64:
                if len(self._new) >= REMEMBERED:
                    self._old, self._new = self._new, {}
                self._new[s] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        out: list[int] = []
        for s in self.segment.findall(self.normal(text or "")):
            out += self.segment_ids(s)
        return np.array(out, np.int32)

    def decode(self, ids) -> str:
        data = b"".join(map(self.plain.__getitem__, ids))
        return data.decode("utf-8", "replace")[1:] if data.startswith(b" ") else data.decode("utf-8", "replace")

    # ---- the scan over chunks

    def chunked(self, z: str, size: int = CHUNK_CHARS) -> list[tuple[str, str, str]]:
        """(context before, body, context after) of each chunk of a normalised text."""
        cuts = list(range(0, max(len(z) - size // 2, 1), size)) + [len(z)]
        k = self.longest
        return [(z[max(0, a - k) : a], z[a:b], z[b : b + k]) for a, b in zip(cuts, cuts[1:])]

    def states(self, z: str, at: int) -> list[State]:
        """Pieces that cross place ``at`` or end there."""
        k = self.longest
        return [(at - s, e - at) for s in range(max(0, at - k), at) for e in range(at, min(len(z), s + k) + 1) if e - s == 1 or z[s:e] in self.pieces]

    def cut(self, z: str, start: int, stop: int) -> int | None:
        """The first place in (start, stop] through which all paths pass."""
        for p in range(start + 1, stop + 1):
            if (z[p] == SPACE and z[p - 1] != SPACE) or z[p] not in self.joined or z[p - 1] not in self.joined:
                return p
        return None

    def _exits(self, last: dict[int, int], end: int, n: int) -> list[State]:
        return [(end - last[i], i - end) for i in range(end, n + 1) if last.get(i, end) < end]

    def transfer(self, before: str, body: str, after: str, first: bool) -> dict[State, list[State]]:
        """The chunk's matrix: the exit states that each entry state reaches."""
        z, at, end = before + body + after, len(before), len(before) + len(body)
        entries = [START] if first else self.states(z, at)
        far = max(e for _, e in entries)
        cut = self.cut(z, at + far, end - 1) if at + far < end - 1 else None
        shared = None
        out = {}
        for s, e in entries:
            last = {at + e: at - s if s else -1}
            if cut is None:
                exits = self._exits(self.forward(z, last, at + e, len(z)), end, len(z))
            else:
                if cut not in self.forward(z, last, at + e, cut):
                    continue
                if shared is None:
                    shared = self._exits(self.forward(z, {cut: -1}, cut, len(z)), end, len(z))
                exits = shared
            if exits:
                out[s, e] = exits
        return out

    def trace(self, before: str, body: str, after: str, entry: State, leave: State) -> list[int]:
        """Ids of the pieces that end in the chunk or cross its end, after the entry piece."""
        z, at, end = before + body + after, len(before), len(before) + len(body)
        start = at + entry[1]
        last = self.forward(z, {start: at - entry[0] if entry[0] else -1}, start, end - leave[0])
        return [*self.back(z, last, end - leave[0], start), *self.ids_of(z[end - leave[0] : end + leave[1]])]

    def scanned(self, z: str, size: int = CHUNK_CHARS) -> list[int]:
        """A normalised text's ids by chunks, in one place."""
        parts = self.chunked(z, size)
        path = route([self.transfer(*p, i == 0) for i, p in enumerate(parts)])
        return [x for p, (entry, leave) in zip(parts, path) for x in self.trace(*p, entry, leave)]


def product(a: dict[State, list[State]], b: dict[State, list[State]]) -> dict[State, list[State]]:
    """The max-plus product of two matrices: associative, so any bracketing of a text's chunks will do."""
    out = {i: sorted({k for j in js for k in b.get(j, ())}) for i, js in a.items()}
    return {i: ks for i, ks in out.items() if ks}


def route(matrices: list[dict[State, list[State]]], start: State = START, end: State | None = None) -> list[tuple[State, State]]:
    """Entry and exit of each chunk on the one path from state ``start`` to ``end`` (None: the end of a text)."""
    ahead = [{start: [start]}]
    for m in matrices:
        ahead.append(product(ahead[-1], m))
    ends = [s for s in ahead[-1].get(start, ()) if (s == end if end else s[1] == 0)]
    if len(ends) != 1:
        raise ValueError(f"{len(ends)} paths")
    leave, out = ends[0], []
    for m, reached in zip(reversed(matrices), reversed(ahead[:-1])):
        entry = [s for s in reached[start] if leave in m.get(s, ())]
        if len(entry) != 1:
            raise ValueError(f"{len(entry)} ways into a chunk")
        out.append((entry[0], leave))
        leave = entry[0]
    return out[::-1]


def _flat(m: dict[State, list[State]]) -> list[int]:
    return [v for i, js in m.items() for j in js for v in (*i, *j)]


def _matrix(flat) -> dict[State, list[State]]:
    m: dict[State, list[State]] = {}
    for a, b, x, y in np.asarray(flat).reshape(-1, 4).tolist():
        m.setdefault((a, b), []).append((x, y))
    return m


def ways(matrices: DataFrame, n: int) -> DataFrame:
    """(k, c, way): each chunk's entry and exit, from the chunks' matrices (k, c, m) of texts of at most ``n`` chunks."""

    def combined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c")
        out = _matrix(rows["m"].iloc[0])
        for flat in rows["m"].iloc[1:]:
            out = product(out, _matrix(flat))
        return pd.DataFrame({"k": rows["k"].iloc[:1], "c": [rows["c"].iloc[0] // FANIN], "m": [_flat(out)]})

    def routed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c")
        way = rows["way"].iloc[0]
        found = route([_matrix(x) for x in rows["m"]], *((tuple(way[:2]), tuple(way[2:])) if way is not None else ()))
        return pd.DataFrame({"k": rows["k"], "c": rows["c"], "way": [[*i, *o] for i, o in found]})

    up, group = [matrices], F.floor(F.col("c") / FANIN).cast("int")
    while n > FANIN:
        up.append(saved(up[-1].groupBy("k", group).applyInPandas(combined, "k string, c int, m array<int>"), "piece-matrices"))
        n = -(-n // FANIN)
    found = up[-1].withColumn("way", F.lit(None).cast("array<int>")).groupBy("k").applyInPandas(routed, "k string, c int, way array<int>")
    for level in reversed(up[:-1]):
        above = saved(found, "piece-ways").withColumnRenamed("c", "p")
        found = level.withColumn("p", group).join(above, ["k", "p"]).groupBy("k", "p").applyInPandas(routed, "k string, c int, way array<int>")
    return found


_codecs: dict[bytes, Codec] = {}


def codec(proto: bytes) -> Codec:
    """One codec for each model in a worker, so that what it remembers outlives a task."""
    key = hashlib.md5(proto).digest()
    if key not in _codecs:
        _codecs[key] = Codec(proto)
    return _codecs[key]


def _ids(docs: DataFrame, text: str, ids: str, model: str, giant: int, size: int) -> tuple[DataFrame, DataFrame, object]:
    """The short documents, the giant ones with a new column ``ids``, and the model's bytes."""
    spark = docs.sparkSession
    with open(model, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())
    long_ = F.length(F.coalesce(F.col(text), F.lit(""))) > giant
    (name,) = unused(docs, "k")
    short, giants = docs.where(~long_), docs.where(long_).withColumn(name, F.sha2(F.col(text), 256))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(proto.value)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = c.chunked(c.normal(t), size)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(parts)), pa.array(range(len(parts)), pa.int32()), *(pa.array([p[i] for p in parts], pa.string()) for i in range(3))], names=["k", "c", "before", "body", "after"])

    texts = giants.groupBy(F.col(name).alias("k")).agg(F.first(text).alias("t"))
    parts = saved(map_arrow(texts, split, "k string, c int, before string, body string, after string").repartition(partitions(giants), "k", "c"), "piece-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(proto.value)
        for b in batches:
            rows = b.to_pydict()
            found = [_flat(c.transfer(x, y, z, i == 0)) for i, x, y, z in zip(rows["c"], rows["before"], rows["body"], rows["after"])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["k", "c", "m"])

    n = parts.agg(F.coalesce(F.max("c"), F.lit(0))).first()[0] + 1
    routes = ways(saved(map_arrow(parts, matrices, "k string, c int, m array<int>"), "piece-matrices"), n)

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(proto.value)
        for b in batches:
            rows = b.to_pydict()
            found = [c.trace(x, y, z, tuple(w[:2]), tuple(w[2:])) for x, y, z, w in zip(rows["before"], rows["body"], rows["after"], rows["way"])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["k", "c", "ids"])

    dealt = parts.join(routes, ["k", "c"]).select("k", "c", "before", "body", "after", "way").repartition(partitions(giants), "k", "c")
    found = map_arrow(dealt, traced, "k string, c int, ids array<int>")
    whole = found.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("p")).select(F.col("k").alias(name), F.flatten("p.ids").alias(ids))
    return short, giants.join(whole, name).drop(name), proto


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL, giant: int = GIANT, size: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` with the ids of each whole text instead of the text, under the name ``ids``; another column of that name goes."""
    docs = docs.drop(ids) if ids != text else docs
    (found,) = unused(docs, "found")
    short, giants, proto = _ids(docs, text, found, model, giant, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(proto.value)
        for b in batches:
            yield b.set_column(at, ids, pa.array([c.encode(t) for t in b.column(at).to_pylist()], pa.list_(pa.int32())))

    at = docs.columns.index(text)
    names = [ids if c == text else c for c in docs.columns]
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([StructField(ids, ArrayType(IntegerType())) if f.name == text else f for f in docs.schema])
    return map_arrow(short, run, schema).toDF(*names).unionByName(giants.select(*[F.col(found).alias(ids) if n == text else F.col(n) for n in docs.columns]))


def decode(encoded: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of each array of ids instead of it, under the name ``text``; another column of that name goes.  Null ids give an empty text."""
    encoded = encoded.drop(text) if text != ids else encoded
    with open(model, "rb") as f:
        proto = encoded.sparkSession.sparkContext.broadcast(f.read())
    from pyspark.sql.types import StringType, StructField, StructType

    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(proto.value)
        for b in batches:
            yield b.set_column(at, text, pa.array([c.decode(x or ()) for x in b.column(at).to_pylist()], pa.string()))

    return map_arrow(encoded, run, StructType([StructField(text, StringType()) if f.name == ids else f for f in encoded.schema]))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, giant: int = GIANT, size: int = CHUNK_CHARS) -> DataFrame:
    """(key, n_chars, n_pieces, n_bytes: those that stand for single bytes, ids_sha256 over little-endian int32, decoded_sha256, round_trip)."""
    short, giants, proto = _ids(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "ids", model, giant, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(proto.value)
        single = np.zeros(len(c.plain), bool)
        single[c.bytes] = True
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [np.asarray(x, np.int32) for x in b.column(2).to_pylist()] if b.num_columns > 2 else [c.encode(t) for t in texts]
            back = [c.decode(x.tolist()) for x in ids]
            columns = [
                pa.array([len(t or "") for t in texts], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(single[x].sum()) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                pa.array([t == (u or "") for t, u in zip(back, texts)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["key", "n_chars", "n_pieces", "n_bytes", "ids_sha256", "decoded_sha256", "round_trip"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, n_chars long, n_pieces long, n_bytes long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    out = map_arrow(short, run, schema).unionByName(map_arrow(giants.select("key", "text", "ids"), run, schema))
    return out.withColumnRenamed("key", key)
