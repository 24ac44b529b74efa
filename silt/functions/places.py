"""The place of each row in an order of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silt.shared import kept

_INSIDE = (1 << 33) - 1


def placed(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with its rows' places, from 0, as ``name``: dealt by ranges and written; one row a range, its size, meets in one task, never the rows themselves."""
    dealt = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    return dealt.withColumn("__part", part).join(starts, "__part").select(*df.columns, (F.col("__at").bitwiseAND(F.lit(_INSIDE)) + F.col("__start")).alias(name))
