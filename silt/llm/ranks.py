"""Positions of rows in their groups' order, where a group may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silt.llm.common import partitions, saved

_INSIDE = (1 << 33) - 1


def ranked(df: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``df`` with ``pos`` (from 0, in the order of ``order``, which should tell all rows of a group apart) and ``n``, the group's size; ``group`` holds no null.

    Rows are dealt by ranges of (group, order) and written; a row's place in its partition and the sums over the partitions before it, one row for each
    partition and group, give its position.
    """
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    placed = saved(df.repartitionByRange(partitions(df), *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), label)
    placed = placed.withColumns({"__part": F.shiftright("__at", 33), "__in": F.col("__at").bitwiseAND(F.lit(_INSIDE))})
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("__count").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = placed.groupBy(group, "__part").agg(F.min("__in").alias("__first"), F.count("*").alias("__count"))
    sums = sums.select(group, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__count").over(own).alias("n"))
    return placed.join(sums, [group, "__part"]).select(*df.columns, (F.col("__in") + F.col("__shift")).alias("pos"), "n")
