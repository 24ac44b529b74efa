"""The history log: entries of preludes and line counts, parted by blank lines.

``read_log`` parses with DataFrame operations and splits large files; ``parse_lines`` is the same grammar for a stream of lines, with the first error in log
order, and serves the command line, the data source and the tests.
"""

from __future__ import annotations

import datetime as dt
import io
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from operator import eq, ge, gt, le, lt

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from silt.errors import SiltError
from silt.schema import FACT
from silt.shared import opened

MAX_LINE = 1 << 20
CONTROL = r"[\x00-\x08\x0a-\x1f\x7f]"
_CONTROL = re.compile(CONTROL)
# What counts as white space in a blank line, beside control characters, which are errors wherever they stand.
BLANKS = "\t \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_REV, _DATE, _INT = re.compile(r"[0-9a-f]+\Z"), re.compile(r"\d{4}-\d{2}-\d{2}\Z", re.A), re.compile(r"[+-]?[0-9]+\Z")


def checked(line: str, size: int) -> str:
    """A line without its terminator; ``size``: its bytes, terminator included or not."""
    if size >= MAX_LINE and len(line.removesuffix("\n").removesuffix("\r").encode("utf-8", "surrogateescape")) >= MAX_LINE:
        raise SiltError("internal_error", f"a line is longer than {MAX_LINE} bytes")
    line = line.removesuffix("\n").removesuffix("\r")
    if _CONTROL.search(line):
        raise SiltError("invalid_control_char", "the log holds a control character")
    return line


def entries(lines: Iterable[str]) -> Iterator[list[str]]:
    """Runs of lines that aren't blank; a line keeps no terminator."""
    entry: list[str] = []
    for line in lines:
        line = checked(line, 4 * len(line))
        if line.strip(BLANKS):
            entry.append(line)
        elif entry:
            yield entry
            entry = []
    if entry:
        yield entry


def parse_lines(lines: Iterable[str]) -> Iterator[tuple]:
    """Fact rows in log order; raises the first error."""
    n = ord_ = 0
    for n, entry in enumerate(entries(lines), 1):
        for row in _entry_rows(n, entry):
            yield (*row, ord_)
            ord_ += 1
    if not n:
        raise SiltError("empty_log", "the log has no entries")


def _bad(n: int, line: str, why: str) -> SiltError:
    return SiltError("parse_error", f"entry {n}, line {line!r}: {why}", {"entry": n, "line": line})


def _head(n: int, entry: list[str]) -> tuple[int, list[str]]:
    """How many preludes an entry starts with, and the fields of the last one, which is the one that counts."""
    leading = 0
    while leading < len(entry) and entry[leading].startswith("--"):
        leading += 1
    if not leading:
        raise _bad(n, entry[0], "an entry starts with --")
    head = entry[leading - 1]
    fields = head.split("--")
    if len(fields) < 4 or not _REV.match(fields[1]) or not _DATE.match(fields[2]):
        raise _bad(n, head, "a prelude is --<commit>--<date>--<author>[--<subject>]")
    return leading, fields


def _entry_rows(n: int, entry: list[str]) -> Iterator[tuple]:
    leading, fields = _head(n, entry)
    message = "--".join(fields[4:]) if len(fields) > 4 else "-"
    for line in entry[leading:]:
        parts = line.split("\t", 2)
        if len(parts) < 3:
            raise _bad(n, line, "expected counts and a path")
        added, deleted, path = parts
        binary = "-" in (added, deleted)
        if not binary and not all(_INT.match(x) and -(1 << 63) <= int(x) < 1 << 63 for x in (added, deleted)):
            raise _bad(n, line, "a count isn't a number")
        yield path, fields[1], fields[2], fields[3], message, 0 if binary else int(added), 0 if binary else int(deleted), binary, True


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, at, length, n): the lines of the log, the file block each was read in, and their order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")).alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.col("_metadata.file_block_length").alias("length"),
        F.monotonically_increasing_id().alias("n"),
    )


LINE_BITS = 36  # ord: the block's number, then the line's in it


@dataclass
class Before:
    """What a block finds in front of its first line: entries so far, and of an entry that goes on, whether lines other than preludes were met, and its last leading prelude."""

    number: int
    entries: int
    full: bool
    closed: bool
    head: bytes | None
    next_prelude: bool = False  # what the block's last line is followed by


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool | None]]:
    """The stretches of a batch that are of one block, each with whether a prelude of the same block follows it; None at the block's end."""
    filled = (b for b in batches if b.num_rows)
    batch = next(filled, None)
    while batch is not None:
        ahead, block = next(filled, None), batch["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for start, stop in zip(cuts, cuts[1:]):
            inside = stop == len(block) and ahead is not None and ahead["block"][0].as_py() == block[-1]
            yield batch.slice(start, stop - start), ahead["prelude"][0].as_py() if inside else None
        batch = ahead


class _Walk:
    """The lines of a block, stretch by stretch: entries are counted and each line gets its entry's last leading prelude."""

    def __init__(self, before: Before):
        self.entries, self.full, self.closed, self.head = before.entries, before.full, before.closed, before.head

    def go(self, full: np.ndarray, prelude: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(entry, leading, head) of each line; ``texts`` has at least the preludes'."""
        i, other = np.arange(len(full)), full & ~prelude
        opens = full & ~np.concatenate(([self.full], full[:-1]))
        entry, start, met = self.entries + np.cumsum(opens), np.maximum.accumulate(np.where(opens, i, -1)), np.cumsum(other)
        closed = np.where(start >= 0, met - met[start] + other[start] > 0, self.closed | (met > 0))
        leading = prelude & ~closed
        last = np.maximum.accumulate(np.where(leading, i, -1))
        found = np.where((last >= start) & (last >= 0), last, np.where(start < 0, len(full), -1))  # behind the texts: the head from before
        known = pa.concat_arrays([texts, pa.array([self.head], texts.type)])
        heads = known.take(pa.array(found, mask=found < 0))
        self.entries, self.full = int(entry[-1]), bool(full[-1])
        self.closed, self.head = (bool(closed[-1]), heads[-1].as_py()) if self.full else (False, None)
        return entry, leading, heads


def _flags(run: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(run[c].to_numpy(zero_copy_only=False) for c in ("full", "prelude"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: what is needed to place it and to know where the next one stands."""
    walk, row = None, {}
    for run, following in _runs(batches):
        full, prelude = _flags(run)
        if walk is None:
            walk = _Walk(Before(0, 0, False, False, None))
            row = {c: run[c][0].as_py() for c in ("block", "file", "at")} | {"first": bool(full[0]), "first_prelude": bool(prelude[0]), "whole": True}
        walk.go(full, prelude, run["value"])
        row["whole"] &= bool(full.all())
        if following is None:
            yield pa.RecordBatch.from_pylist([row | {"opened": walk.entries, "last": walk.full, "closed": walk.closed, "head": walk.head}], schema=_SUMS)
            walk = None


_SUMS = pa.schema([("block", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("first", pa.bool_()), ("first_prelude", pa.bool_()), ("whole", pa.bool_()), ("opened", pa.int64()), ("last", pa.bool_()), ("closed", pa.bool_()), ("head", pa.binary())])
_SUMS_DDL = "block long, file string, at long, first boolean, first_prelude boolean, whole boolean, opened long, last boolean, closed boolean, head binary"


def _placed(sums: list) -> dict[int, Before]:
    """What each block finds before it, from the blocks' sums in order."""
    out: dict[int, Before] = {}
    entries, full, closed, head, last = 0, False, False, None, None
    for i, s in enumerate(sorted(sums, key=lambda s: (s["file"], s["at"]))):
        if last is None or last["file"] != s["file"]:
            full, closed, head = False, False, None
        else:
            out[last["block"]].next_prelude = s["first_prelude"]
        out[s["block"]] = Before(i, entries, full, closed, head)
        goes_on = full and s["first"]
        entries += s["opened"] - goes_on
        if goes_on and s["whole"]:
            closed, head = closed or s["closed"], head if closed else s["head"] or head
        else:
            closed, head = s["closed"], s["head"]
        full, last = s["last"], s
    if len(out) != len(sums):
        raise RuntimeError("two blocks of the log have one number")
    return out


def numbered(lines: DataFrame) -> DataFrame:
    """(value, entry, head, leading, ord): lines with the number of their entry and its last leading prelude; of the leading ones the last alone.

    ``lines`` are as ``read_lines`` reads them, their values changed or not: a block's lines lie in one task, in order, so no line is shuffled.  Blocks are read twice:
    first for a row each, of which the driver holds as many as there are blocks, then with what lies before them.
    """
    # A line that is an error by itself is never blank: it stays, and ``parsed`` names it.
    broken = F.col("value").rlike(CONTROL) | (F.octet_length("value") >= MAX_LINE)
    full = broken | F.col("value").rlike(f"[^{BLANKS}]")  # found at a line's first character but for blank ones
    marked = lines.withColumn("block", F.xxhash64("file", "at", "length")).withColumn("full", full).withColumn("prelude", full & F.col("value").startswith("--"))
    heads = marked.select("block", "file", "at", "full", "prelude", F.when(F.col("prelude"), F.col("value")).cast("binary").alias("value"))
    before = _placed(heads.mapInArrow(_sums, _SUMS_DDL).collect())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for run, following in _runs(batches):
            if walk is None:
                at = before.get(run["block"][0].as_py())
                if at is None:
                    raise RuntimeError("the log was split in another way while it was read")
                walk, n = _Walk(at), at.number << LINE_BITS
            full, prelude = _flags(run)
            entry, leading, found = walk.go(full, prelude, run["value"])
            ends = leading & ~np.concatenate((prelude[1:], [at.next_prelude if following is None else following]))
            keep = pa.array(full & (~leading | ends))
            columns = {"value": run["value"], "entry": pa.array(entry), "head": found, "leading": pa.array(leading), "ord": pa.array(n + np.arange(len(full)))}
            yield pa.RecordBatch.from_pydict(columns).filter(keep)
            n += len(full)
            if following is None:
                walk = None

    # As bytes: a log may hold what isn't UTF-8.
    rows = marked.select("block", "full", "prelude", F.col("value").cast("binary").alias("value")).mapInArrow(place, "value binary, entry long, head binary, leading boolean, ord long")
    return rows.select(*[F.col(c).cast("string").alias(c) if c in ("value", "head") else c for c in rows.columns])


def parsed(rows: DataFrame) -> DataFrame:
    """Fact columns, ``entry`` and ``error`` (null, or the code of what is wrong) for each line that isn't a prelude, and for each entry's head."""
    rows = rows.withColumns({"f": F.split("head", "--", -1), "p": F.split("value", "\t", 3)})  # columns, so that each line is split once
    f, p = F.col("f"), F.col("p")
    good_head = (F.size(f) >= 4) & F.get(f, F.lit(1)).rlike(r"^[0-9a-f]+\z") & F.get(f, F.lit(2)).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    added, deleted = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    binary = (added == "-") | (deleted == "-")
    number = lambda c: F.when(c.rlike(r"^[+-]?[0-9]+\z"), F.regexp_replace(c, r"^\+", "").try_cast("bigint"))
    good = (F.size(p) == 3) & (binary | (number(added).isNotNull() & number(deleted).isNotNull()))
    error = (
        F.when(F.col("value").rlike(CONTROL), "invalid_control_char")
        .when(F.octet_length("value") >= MAX_LINE, "internal_error")
        .when(F.col("head").isNull() | ~good_head, "parse_error")
        .when(~F.col("leading") & ~good, "parse_error")
    )
    return rows.select(
        F.when(~F.col("leading"), F.get(p, F.lit(2))).alias("entity"),
        F.get(f, F.lit(1)).alias("rev"),
        F.get(f, F.lit(2)).alias("date"),
        F.get(f, F.lit(3)).alias("author"),
        F.when(F.size(f) > 4, F.array_join(F.slice(f, F.lit(5), F.greatest(F.size(f) - 4, F.lit(1))), "--")).otherwise("-").alias("message"),
        F.when(binary, 0).otherwise(number(added)).cast("bigint").alias("loc_added"),
        F.when(binary, 0).otherwise(number(deleted)).cast("bigint").alias("loc_deleted"),
        binary.alias("binary"),
        F.lit(True).alias("has_loc"),
        "ord",
        "entry",
        error.alias("error"),
        "value",
        "leading",
    )


def read_log(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """The fact table of a log; ``ord`` orders it.  With ``check``, one pass finds the first error, in log order, and tells an empty log."""
    rows = parsed(numbered(read_lines(spark, path)))
    if check:
        found = rows.agg(F.count("*").alias("n"), F.min_by(F.struct("error", "entry", "value"), F.when(F.col("error").isNotNull(), F.col("ord"))).alias("e"), F.count("error").alias("bad")).first()
        if found["bad"]:
            code, entry, line = found["e"]
            if code == "parse_error":
                raise _bad(entry, line, "not in the expected format")
            raise SiltError(code, "the log holds a control character" if code == "invalid_control_char" else f"a line is longer than {MAX_LINE} bytes")
        if not found["n"]:
            raise SiltError("empty_log", "the log has no entries")
    return rows.where("not leading").select(*[f.name for f in FACT])


def preludes(spark: SparkSession, path: str) -> DataFrame:
    """(rev, date) of every prelude line, those of commits without files too."""
    v = F.col("value")
    lines = read_lines(spark, path).where(v.rlike(r"^--[0-9a-f]+--[0-9]{4}-[0-9]{2}-[0-9]{2}--"))
    return lines.select(F.get(F.split(v, "--"), F.lit(1)).alias("rev"), F.get(F.split(v, "--"), F.lit(2)).alias("date"))


def write_log(facts: DataFrame, path: str, commits: DataFrame | None = None) -> None:
    """A history as a log that ``read_log`` reads: files in order of (date, rev), no commit in two of them; ``commits`` (rev, date, author, message) may have such without files."""
    head = ["rev", "date", "author", "message"]
    commits = facts.select(*head).distinct() if commits is None else commits
    preludes_ = commits.select("date", "rev", F.lit(None).cast(facts.schema["ord"].dataType).alias("ord"), F.concat(F.lit("\n--"), F.concat_ws("--", *head)).alias("line"))
    count = lambda c: F.when(F.col("binary"), F.lit("-")).otherwise(F.col(c).cast("string"))
    lines = facts.select("date", "rev", "ord", F.concat_ws("\t", count("loc_added"), count("loc_deleted"), "entity").alias("line"))
    dealt = preludes_.unionByName(lines).repartitionByRange("date", "rev").sortWithinPartitions("date", "rev", F.asc_nulls_first("ord"))
    dealt.select("line").write.text(path)


class GitLogSource(DataSource):
    """After ``register(spark)``, spark.read.format("gitlog").load(path): logs of any encoding, read by ranges of bytes.

    Options: ``encoding`` (utf-8), ``range_bytes`` (64 MB), ``ranges`` (a number of ranges a file, in place of a size).  ``path`` is a file or a folder, local or of any store that Arrow opens (hdfs, s3, gs).
    Conditions on date, author and rev are applied to an entry's head, before its lines are read; entries they leave out aren't checked further.
    """

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self):
        return FACT

    def reader(self, schema):
        return GitLogReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and has Spark hand it its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitLogSource)


@dataclass
class Range(InputPartition):
    """The entries whose last blank line before them starts in [start, stop) of a file; a file's first entry belongs to its first range."""

    file: str
    number: int
    start: int
    stop: int


RANGE_BYTES = 64 << 20
FILE_BITS = 43  # ord: the file's number, then the byte at which a line starts
FIELD = {"rev": 1, "date": 2, "author": 3}
TESTS = {EqualTo: eq, GreaterThan: gt, GreaterThanOrEqual: ge, LessThan: lt, LessThanOrEqual: le, StringStartsWith: str.startswith}


def wide(encoding: str) -> bool:
    """Whether lines can't be told apart in the bytes: such a file is one range."""
    return "\n".encode(encoding) != b"\n"


def _lines(f, start: int, encoding: str) -> Iterator[tuple[int, str, int]]:
    """(place, line, bytes) of the lines that start at ``start`` or later."""
    if start:
        f.seek(start - 1)
    at = max(start - 1, 0)
    rest, skip = b"", start > 0  # up to the first line end from the byte before on, nothing is a whole line
    if wide(encoding):
        for line in io.TextIOWrapper(f, encoding, "surrogateescape", newline="\n"):
            yield at, line, 4 * len(line)
            at += len(line)
        return
    while block := f.read(1 << 20):
        rest += block
        if len(rest) > 2 * MAX_LINE and b"\n" not in rest:
            raise SiltError("internal_error", f"a line is longer than {MAX_LINE} bytes")
        *lines, rest = rest.split(b"\n")
        for line in lines:
            if not skip:
                yield at, line.decode(encoding, "surrogateescape"), len(line)
            skip = False
            at += len(line) + 1
    if rest and not skip:
        yield at, rest.decode(encoding, "surrogateescape"), len(rest)


def _entries_of(f, part: Range, encoding: str) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """(place, [(place, line)]) of a range's entries."""
    mine, entry = part.start == 0, []
    for at, line, size in _lines(f, part.start, encoding):
        if not mine and at >= part.stop:
            return  # an entry that goes on through the whole range
        blank = not line.strip(BLANKS + "\r\n")
        if mine:
            line = checked(line, size)
        if not blank:
            if mine:
                entry.append((at, line))
            continue
        if entry:
            yield entry[0][0], entry
            entry = []
        mine = at < part.stop
        if not mine:
            return
    if entry:
        yield entry[0][0], entry


class GitLogReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.encoding = options["path"], options.get("encoding", "utf-8")
        self.size, self.ranges = int(options.get("range_bytes", RANGE_BYTES)), int(options.get("ranges", 0))
        self.conditions: list[tuple[int, Callable, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in FIELD and type(f) in TESTS:
                self.conditions.append((FIELD[column], TESTS[type(f)], f.value))
            elif column in FIELD and isinstance(f, In):
                self.conditions.append((FIELD[column], lambda x, values: x in values, set(f.value)))
            elif column in FIELD and isinstance(f, IsNotNull):
                continue  # an entry has all three
            else:
                yield f

    def partitions(self):
        store, path = opened(self.path)
        found = store.get_file_info(path)
        if found.type == pafs.FileType.NotFound:
            raise SiltError("log_open_failed", f"{self.path} can't be opened", {"path": self.path})
        listed = [found] if found.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((f for f in listed if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        if not any(f.size for f in files):
            raise SiltError("empty_log", "the log has no entries")
        out = []
        for i, f in enumerate(files):
            n = 1 if wide(self.encoding) else min(self.ranges or -(-f.size // self.size), f.size) or 1
            out += [Range(f.path, i, f.size * k // n, f.size * (k + 1) // n) for k in range(n)]
        return out

    def read(self, partition):
        store, _ = opened(self.path)
        with store.open_input_file(partition.file) as f:
            for at, entry in _entries_of(f, partition, self.encoding):
                leading, fields = _head(at, [line for _, line in entry])
                if all(test(fields[i], value) for i, test, value in self.conditions):
                    rows = _entry_rows(at, [line for _, line in entry])
                    for (place, _), row in zip(entry[leading:], rows):
                        yield (*row, partition.number << FILE_BITS | place)


# Fixed value: the command whose output this module reads.
COMMAND = "git log --numstat --date=short --pretty=format:'--%h--%ad--%aN--%s' --no-renames --use-mailmap"


def log_command(after: str = "", every_ref: bool = False) -> str:
    """The command that makes a log."""
    if after:
        try:
            if dt.date.fromisoformat(after).isoformat() != after:
                raise ValueError(after)
        except ValueError as e:
            raise SiltError("invalid_after_date", f"{after!r} isn't a date", {"after": after}) from e
    return COMMAND.replace("git log", "git log --all" if every_ref else "git log", 1) + (f" --after={after}" if after else "")
