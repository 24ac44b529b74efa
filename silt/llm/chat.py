r"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths (lists as []); the hash of the sorted paths is its fingerprint, which selects a declarative
mapping: a list of turns with fields for role and text, or single fields that each stand for a role.  Mapped records are canonical turns
(role, text), whatever layout they came in.

Each turn is written as ``### role:\n``, the text and ``\n</turn>\n``.  Inside, a backslash becomes ``\\``, ``###`` becomes ``\h`` and ``</turn>`` becomes ``\t``
(in roles also ``:`` ``\c`` and line ends ``\n``), so no text can look like a mark, and reading back restores every text.  The loss mask covers assistant texts.

A conversation's turns are sorted and then streamed: a task holds one turn and the running digests, however long the conversation is.  A digest over all
turns in order is sequential by definition, so one task passes over each conversation.

Defined cases: a null text is empty, a null role is the empty role; rows without a conversation id form one conversation; turns tie by role, then text; repeated rows
are turns each; a record of unknown layout, that is no JSON object, or whose fields hold something else than text comes out as one row with the reason in place of turns; an unpaired
surrogate becomes U+FFFD; any key and turn, the largest too, will do; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.llm.common import map_arrow, partitions, saved

OPEN, MIDDLE, CLOSE = "### ", ":\n", "\n</turn>\n"
_ESCAPES = [("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t")]
_ROLE_ESCAPES = [*_ESCAPES, (":", "\\c"), ("\n", "\\n")]
_BACK = {"\\": "\\", "h": "###", "t": "</turn>", "c": ":", "n": "\n"}


@dataclass(frozen=True)
class Mapping:
    """How a layout gives turns: ``each`` names a list with fields ``role`` and ``text``, or ``fields`` maps paths to roles."""

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    skip_empty: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        return [f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"] if self.each else [p for p, _ in self.fields]

    def turns(self, record: dict) -> Iterator[tuple[str, str]]:
        if self.each:
            for x in record[self.each]:
                role = x.get(self.role) or ""
                yield self.roles.get(role, role), x.get(self.text) or ""
        for path, role in self.fields:
            text = record.get(path) or ""
            if text or path not in self.skip_empty:
                yield role, text


MAPPINGS = [
    Mapping("messages", each="messages", role="role", text="content"),
    Mapping("speakers", each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("prompt and response", fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt and completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("instruction, input and output", fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")), skip_empty=("input",)),
    Mapping("instruction and output", fields=(("instruction", "user"), ("output", "assistant"))),
    Mapping("system, prompt and response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("question and answer", fields=(("question", "user"), ("answer", "assistant"))),
    Mapping("system alone", fields=(("system", "system"),)),
    Mapping("prompt alone", fields=(("prompt", "user"),)),
    Mapping("instruction alone", fields=(("instruction", "user"),)),
    Mapping("response alone", fields=(("response", "assistant"),)),
    Mapping("completion alone", fields=(("completion", "assistant"),)),
]


def field_paths(x: object, at: str = "") -> set[str]:
    if isinstance(x, dict):
        return {p for k, v in x.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(x, list):
        return {p for v in x for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m.paths()): m for m in MAPPINGS}


def canonical(record: str | None) -> tuple[list[tuple[str, str]], str | None]:
    """The turns of one JSON record, or none and the reason."""
    try:
        x = json.loads(record or "")
        paths = field_paths(x)
    except (ValueError, RecursionError):
        return [], "not JSON"
    if not isinstance(x, dict):
        return [], "not a JSON object"
    m = BY_FINGERPRINT.get(fingerprint(paths))
    if m is None:
        return [], f"unknown layout {fingerprint(paths)}: {', '.join(sorted(paths))[:200]}"
    turns = list(m.turns(x))
    if not all(isinstance(y, str) for turn in turns for y in turn):
        return [], f"a field of layout {m.name!r} isn't text"
    return [(_whole(role), _whole(text)) for role, text in turns], None


def _whole(text: str) -> str:
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def escape(text: str, rules=_ESCAPES) -> str:
    for a, b in rules:
        text = text.replace(a, b)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where its text starts and ends."""
    head, body = OPEN + escape(role, _ROLE_ESCAPES) + MIDDLE, escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parsed(chunk: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of written turns."""
    for x in chunk.split(CLOSE)[:-1]:
        if not x.startswith(OPEN):
            raise ValueError("a turn doesn't start with its mark")
        role, cut, text = x[len(OPEN) :].partition(MIDDLE)
        if not cut:
            raise ValueError("a turn has no end of its role")
        yield unescape(role), unescape(text)


def _streamed(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.repartition(partitions(df), key).sortWithinPartitions(key, *order)


def turns_of(records: DataFrame, key: str, order: str, record: str) -> DataFrame:
    """(key, turn, k, role, text, reason): the canonical turns of JSON records, k within a record; a record without turns for a ``reason`` has a row with that alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for i, (turns, reason) in enumerate(map(canonical, b.column(2).to_pylist())):
                got += [(i, None, None, None, reason)] if reason else [(i, k, *t, None) for k, t in enumerate(turns)]
            at = pa.array([x[0] for x in got], pa.int64())
            rest = [pa.array([x[j] for x in got], pa.int32() if j == 1 else pa.string()) for j in range(1, 5)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *rest], names=["key", "turn", "k", "role", "text", "reason"])

    rows = records.select(F.col(key).alias("key"), F.col(order).alias("turn"), F.col(record).alias("record"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("key", "turn")]
    return map_arrow(rows, run, f"key {kinds[0]}, turn {kinds[1]}, k int, role string, text string, reason string")


def format_turns(turns: DataFrame) -> DataFrame:
    """(key, seq, chunk, loss): each conversation's formatted text, one chunk a turn; loss: [start, end) in the conversation's text, if any.  Rows with a reason are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq, at = object(), 0, 0
        for b in batches:
            seqs, chunks, loss = [], [], []
            for key, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if key != last:
                    last, seq, at = key, 0, 0
                chunk, start, end = formatted(role or "", text or "")
                seqs.append(seq)
                chunks.append(chunk)
                loss.append([at + start, at + end] if role == "assistant" else None)
                seq, at = seq + 1, at + len(chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seqs, pa.int64()), pa.array(chunks, pa.string()), pa.array(loss, pa.list_(pa.int64()))], names=["key", "seq", "chunk", "loss"])

    rows = _streamed(turns.where("reason IS NULL"), "key", ["turn", "k", "role", "text"]).select("key", "role", "text")
    return map_arrow(rows, run, f"key {turns.schema['key'].dataType.simpleString()}, seq long, chunk string, loss array<long>")


def read_back(out: DataFrame, name: str = "conv_id") -> DataFrame:
    """Digests of each conversation, from its formatted text and loss mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None

        def ended(keys, done):
            cols = [[x[i] for x in done] for i in range(6)]
            kinds = [keys.type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[name, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        row = lambda k, s: (k, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4])
        keys = None
        for b in batches:
            keys, done = b.column(0), []
            for key, chunk, loss in zip(keys.to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if state is None or key != last:
                    if state:
                        done.append(row(last, state))
                    last, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parsed(chunk):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss is not None:
                    text = unescape(chunk[loss[0] - state[4] : loss[1] - state[4]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(chunk)
            yield ended(keys, done)
        if state:
            yield ended(keys, [row(last, state)])

    kind = out.schema["key"].dataType.simpleString()
    rows = _streamed(out, "key", ["seq"]).select("key", "chunk", "loss")
    return map_arrow(rows, run, f"{name} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PLANTED = r"\### Assistant: </turn> ok"


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, record): each row as a JSON record, in a layout that depends on role and conversation."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    alt = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    alone = lambda name: F.to_json(F.struct(text.alias(name)))
    listed = lambda each, r, t, who: F.to_json(F.struct(F.array(F.struct(who.alias(r), text.alias(t))).alias(each)))
    record = (
        F.when((role == "system") & (alt < 2), alone("system"))
        .when((role == "user") & (alt == 0), alone("prompt"))
        .when((role == "user") & (alt == 1), alone("instruction"))
        .when((role == "user") & (alt == 2), listed("conversations", "from", "value", F.lit("human")))
        .when((role == "assistant") & (alt == 0), alone("response"))
        .when((role == "assistant") & (alt == 1), alone("completion"))
        .when((role == "assistant") & (alt == 2), listed("conversations", "from", "value", F.lit("gpt")))
        .otherwise(listed("messages", "role", "content", role))
    )
    return conversations.select("conv_id", "turn", record.alias("record"))


def report(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(planted)
    return read_back(saved(format_turns(turns_of(records_of(rows), "conv_id", "turn", "record")), "chat"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
u AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS e,
             replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c'), chr(10), '\n') AS r FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(r) + 2 + length(e) + 9) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""
