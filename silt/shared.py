"""The folder that driver and executors share, for what is written on the way."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where none is set, a local session takes a temporary one; a cluster has none to take."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='silt-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows doesn't compute it again, and a lost executor takes nothing with it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame, stored: int) -> int:
    """How many partitions to deal ``df`` to: the session's number, or one for each ``stored`` bytes of its sources where those are more, up to 20,000."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    known = size if size < 1 << 60 else 0  # a leaf of unknown size counts as endless
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-known // stored), 20_000))


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, s3, gs), for code in tasks that Spark's readers don't serve, and the path there."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if re.match(r"\w+:/", path) else f"file://{os.path.abspath(path)}")
