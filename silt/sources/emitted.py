"""Results as a data source: tasks write the rows, the commit writes the envelope.

A result is a folder: ``envelope.json`` and, named there as ``rows_in``, a folder of its rows, one JSON object a line, in the order of the files' names.  The envelope is written
last, so a folder that has one is whole; a job that fails leaves nothing, and a result that is written over one before takes its place when it is whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from silt.errors import SiltError
from silt.plans.encoding import encode
from silt.registry import analyses
from silt.schema import ROLES, TYPES
from silt.shared import opened

ENVELOPE = "envelope.json"


class ResultSource(DataSource):
    """After ``register(spark)``, df.write.format("siltresult").option("head", JSON of the envelope without rows).save(path).

    The head's keys are kept; ``row_count`` follows from what is written where the head has it, and ``total_count`` and ``truncated`` stay only where fewer rows are written.
    """

    @classmethod
    def name(cls) -> str:
        return "siltresult"

    def writer(self, schema, overwrite):
        return ResultWriter(self.options["path"], json.loads(self.options.get("head", "{}")), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResultSource)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


SPECIAL = r'["\\<>&\x00-\x1f]|\x{2028}|\x{2029}'  # what ``encode`` escapes


def _values(column: pa.Array) -> pa.Array:
    """Each value as ``encode`` writes it: whole columns at once, but for strings with something to escape and for types that are written otherwise."""
    if pa.types.is_integer(column.type) or pa.types.is_boolean(column.type):
        return column.cast(pa.string())
    if not pa.types.is_string(column.type):
        return pa.array([None if v is None else encode(v) for v in column.to_pylist()], pa.string())
    out, odd = pc.binary_join_element_wise('"', column, '"', ""), pc.fill_null(pc.match_substring_regex(column, SPECIAL), False)
    return pc.replace_with_mask(out, odd, pa.array([encode(v) for v in column.filter(odd).to_pylist()], pa.string())) if pc.any(odd).as_py() else out


def json_lines(batch: pa.RecordBatch) -> pa.Array:
    """The rows of a batch as ``encode`` writes them, nulls left out, each with its line end."""
    pieces = [pc.fill_null(pc.binary_join_element_wise(f",{encode(n)}:", _values(c), ""), "") for n, c in zip(batch.schema.names, batch.columns)]
    return pc.binary_join_element_wise("{", pc.utf8_slice_codeunits(pc.binary_join_element_wise(*pieces, ""), 1), "}\n", "")


class ResultWriter(DataSourceArrowWriter):
    def __init__(self, path: str, head: dict, overwrite: bool):
        self.path, self.head, self.overwrite = path, head, overwrite
        self.folder = f"rows-{uuid.uuid4().hex}"
        store, root = opened(path)
        if not overwrite and store.get_file_info(f"{root}/{ENVELOPE}").type != pafs.FileType.NotFound:
            raise SiltError("invalid_value", f"{path} holds a result already", {"path": path})
        store.create_dir(f"{root}/{self.folder}", recursive=True)  # here and not in tasks: one that outlives the job's end finds no folder and fails

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = opened(self.path)
        context = TaskContext.get()
        name, n = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.json", 0
        with store.open_output_stream(f"{root}/{self.folder}/{name}") as f:
            for b in iterator:
                if b.num_rows:
                    f.write("".join(json_lines(b).to_pylist()).encode())
                n += b.num_rows
        return Part(name, n)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = opened(self.path)
        parts = {m.name for m in messages if m}
        n = sum(m.rows for m in messages if m)
        for f in store.get_file_info(pafs.FileSelector(f"{root}/{self.folder}")):
            if f.base_name not in parts:  # of an attempt that came to nothing
                store.delete_file(f.path)
        head = dict(self.head)
        if "row_count" in head:
            head["row_count"] = n
        if head.get("total_count", n) <= n:
            head = {k: v for k, v in head.items() if k not in ("total_count", "truncated")}
        with store.open_output_stream(f"{root}/{ENVELOPE}.new") as f:
            f.write(encode(head | {"rows_in": self.folder}).encode())
        store.move(f"{root}/{ENVELOPE}.new", f"{root}/{ENVELOPE}")
        for f in store.get_file_info(pafs.FileSelector(root)):  # of results before this one
            if f.type == pafs.FileType.Directory and f.base_name.startswith("rows-") and f.base_name != self.folder:
                store.delete_dir(f.path)

    def abort(self, messages: list[Part | None]) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.folder}").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/{self.folder}")


def columns_of(head: dict) -> T.StructType:
    """The columns of a result's rows, from its envelope: types and order from the analysis where it is known, else from the columns' meanings."""
    known = {c.name: c for a in analyses() if a.name == head.get("analysis") for c in a.columns}
    meanings = head.get("semantics", {})
    by_role = lambda s: T.DoubleType() if s in ("percentage", "ratio") else T.LongType() if ROLES.get(s) in ("additive", "intensive") else T.BooleanType() if s == "flag" else T.StringType()
    order = [c for c in known if c in meanings] + [c for c in meanings if c not in known]
    return T.StructType([T.StructField(c, TYPES[known[c].type] if c in known else by_role(meanings[c]), True, {"semantic": meanings[c]}) for c in order])


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a result, read by as many tasks as it has blocks; the driver reads the envelope alone."""
    found = spark.read.option("wholetext", True).text(f"{path}/{ENVELOPE}").first()
    head = json.loads(found[0])
    schema = columns_of(head)
    return spark.read.schema(schema).json(f"{path}/{head['rows_in']}").select(*[F.col(f.name).alias(f.name, metadata=f.metadata) for f in schema])
