"""Tables of structure and results that other tools or earlier runs wrote as JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from silt.errors import SiltError
from silt.shared import opened
from silt.sources.emitted import columns_of

REPORT = "struct<reports:array<struct<name:string,stats:struct<code:bigint>>>>"


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """(entity, loc) from a JSON of languages, each with reports of name and stats.code; Total is skipped."""
    whole = spark.read.option("wholetext", True).text(path)
    langs = whole.select(F.explode(F.from_json("value", f"map<string,{REPORT}>")).alias("lang", "x")).where("lang <> 'Total'")
    files = langs.select(F.explode("x.reports").alias("r")).select(F.regexp_replace("r.name", r"^(?:\./)+", "").alias("entity"), F.col("r.stats.code").alias("loc"))
    return files.groupBy("entity").agg(F.max("loc").alias("loc"))


def read_envelope(spark: SparkSession, path: str, schema: T.StructType | None = None, ranges: int = 0) -> DataFrame:
    """The rows of a result's envelope, or of a bare list of rows, in a JSON file or a folder of such files.

    Without a schema an envelope's columns follow from its analysis and their meanings, which are all that the driver reads, and its rows are read by ranges of bytes; the columns of
    a bare list are inferred by Spark.
    """
    if schema is None:
        head = head_of(path)
        if head is None:
            return spark.read.option("multiLine", True).json(path)
        spark.dataSource.register(EnvelopeSource)
        return spark.read.format("siltenvelope").schema(columns_of(head)).option("ranges", ranges).load(path)
    whole, kind = spark.read.option("wholetext", True).text(path), schema.simpleString()
    rows = F.coalesce(F.from_json(F.get_json_object("value", "$.rows"), f"array<{kind}>"), F.from_json("value", f"array<{kind}>"))
    return whole.select(F.inline(rows))


EDGE = 1 << 20  # bytes at a file's ends in which an envelope keeps what isn't rows; and by which a range is read on
RANGE_BYTES = 64 << 20  # also what a task reads of many small ranges
TASKS = 64  # as many tasks at least, where there are as many ranges
ROWS = b'"rows":['


def files_of(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    store, at = opened(path)
    found = store.get_file_info(at)
    listed = [found] if found.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(at, recursive=True)) if found.type == pafs.FileType.Directory else []
    files = sorted((f for f in listed if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
    if not files:
        raise SiltError("input_file_open_failed", f"{path} can't be opened", {"path": path})
    return store, files


def head_of(path: str) -> dict | None:
    """An envelope without its rows, from the ends of its (first) file; None for a list."""
    store, (file, *_) = files_of(path)
    with store.open_input_file(file.path) as f:
        start = f.read(min(EDGE, file.size)).lstrip()
        f.seek(max(file.size - EDGE, 0))
        end = f.read()
    if start[:1] == b"[":
        return None
    if file.size <= EDGE:
        return {k: v for k, v in json.loads(start).items() if k != "rows"}
    at = start.index(ROWS)
    before = json.loads(start[:at].rstrip(b" ,") + b"}")
    for m in reversed(list(re.finditer(rb"[}\[]\](?=[,}])", end))):  # the last end of a list of rows after which the rest is an object's
        try:
            return before | json.loads(b'{"":0' + end[m.end() :])
        except ValueError:
            continue
    raise ValueError(f"{path} has no end of rows")


class EnvelopeSource(DataSource):
    """The rows of envelopes, split: a range starts at the next row that begins in it, known by a row's opening and one of its columns' names, which no string can hold unescaped."""

    @classmethod
    def name(cls) -> str:
        return "siltenvelope"

    def reader(self, schema):
        return EnvelopeReader(self.options, schema)


@dataclass
class Range:
    file: str
    start: int
    stop: int


@dataclass
class Ranges(InputPartition):
    """What one task reads: as many ranges as have ``RANGE_BYTES`` together, so that many small files don't become as many tasks."""

    ranges: list[Range]


def packed(ranges: list[Range], least: int) -> list[Ranges]:
    """``ranges`` in order, in lists of up to ``RANGE_BYTES``, or of less where they would be fewer than ``least``."""
    most = min(RANGE_BYTES, -(-sum(r.stop - r.start for r in ranges) // least))
    out, size = [], 0
    for r in ranges:
        if not out or size + r.stop - r.start > most:
            out.append(Ranges([]))
            size = 0
        out[-1].ranges.append(r)
        size += r.stop - r.start
    return out


class EnvelopeReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.ranges, self.names = options["path"], int(options.get("ranges", 0)), schema.names
        self.doubles = {f.name for f in schema if isinstance(f.dataType, T.DoubleType)}

    def partitions(self):
        out = []
        for f in files_of(self.path)[1]:
            n = min(self.ranges or -(-f.size // RANGE_BYTES), f.size)
            out += [Range(f.path, f.size * i // n, f.size * (i + 1) // n) for i in range(n)]
        return packed(out, TASKS)

    def read(self, part):
        for r in part.ranges:
            yield from self.rows_of(r)

    def rows_of(self, part):
        store, _ = opened(self.path)
        opening = re.compile(rb'(?:\},|"rows":\[)(\{"(?:' + b"|".join(re.escape(json.dumps(n)[1:-1].encode()) for n in self.names) + rb')":)')
        with store.open_input_file(part.file) as f:
            at = max(part.start - len(ROWS), 0)  # what stands before a row's opening counts too
            f.seek(at)
            data = f.read(part.stop - at + EDGE)
            spot = next((m.start(1) for m in opening.finditer(data) if at + m.start(1) >= part.start), -1)
            if spot < 0:
                return
            decoder = json.JSONDecoder()
            while at + spot < part.stop:
                end = opening.search(data, spot)
                stop = end.start(1) - 1 if end else len(data)
                if end is None:
                    # The last row, or one that goes on behind what has been read.
                    more = f.read(EDGE)
                    if more:
                        data += more
                        continue
                row, _ = decoder.raw_decode(data[spot:stop].decode())
                yield tuple(float(row[n]) if n in self.doubles and row.get(n) is not None else row.get(n) for n in self.names)
                if end is None:
                    return
                spot = end.start(1)
