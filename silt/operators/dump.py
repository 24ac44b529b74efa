"""The records themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.operators.counts import ENTITY
from silt.registry import analysis
from silt.schema import Column


@analysis(
    "parse",
    "The records that all analyses work on, in log order",
    [
        ENTITY,
        Column("rev", "string", "commit_id", "commit, or last day of its window"),
        Column("date", "string", "date", "day of the commit"),
        Column("author", "string", "person", "who, or their team"),
        Column("message", "string", "text", "subject; - without one"),
        Column("loc_added", "int", "loc", "lines added"),
        Column("loc_deleted", "int", "loc", "lines deleted"),
        Column("binary", "bool", "flag", "true for binary files"),
    ],
    ["ord"],
    aliases=("identity",),
)
def dump(facts: DataFrame) -> DataFrame:
    loc = lambda c: F.when(F.col("has_loc"), F.col(c)).alias(c)
    return facts.select("entity", "rev", "date", "author", "message", loc("loc_added"), loc("loc_deleted"), F.when(F.col("binary"), True).alias("binary"), "ord")
