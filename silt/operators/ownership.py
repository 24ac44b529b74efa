"""Main developers: whose lines, deletions or changes are most of an entity's."""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.functions.exprs import centi_ratio
from silt.operators.churn import LOC
from silt.operators.counts import ENTITY
from silt.registry import analysis
from silt.schema import Column

DEVELOPER = Column("main_dev", "string", "person", "who did most; of equals, the first by name")
OWNERSHIP = Column("ownership", "float", "ratio", "their share")


def main_developer(facts: DataFrame, measure: C, part: str, whole: str) -> DataFrame:
    """By a two-level sum."""
    return best_of(facts.groupBy("entity", "author").agg(measure.alias("v")), F.col("v"), part, whole)


def best_of(own: DataFrame, measure: C, part: str, whole: str) -> DataFrame:
    """Of rows (entity, author) with a measure the largest of each entity; with the smallest author it is the smallest pair (-part, author)."""
    own = own.select("entity", "author", measure.alias("v"))
    best = own.groupBy("entity").agg(F.min(F.struct((-F.col("v")).alias("low"), "author")).alias("m"), F.sum("v").alias(whole))
    out = best.select("entity", F.col("m.author").alias("main_dev"), (-F.col("m.low")).alias(part), whole)
    return out.withColumn("ownership", centi_ratio(F.col(part), F.col(whole)))


@analysis(
    "main-developer", "Who added most lines to each entity",
    [ENTITY, DEVELOPER, Column("added", "int", "loc", "lines they added"), Column("total_added", "int", "loc", "lines all added"), OWNERSHIP], ["entity"], aliases=("main-dev",), **LOC,
)
def by_lines(facts: DataFrame) -> DataFrame:
    return main_developer(facts, F.sum("loc_added"), "added", "total_added")


@analysis(
    "refactoring-main-developer", "Who deleted most lines from each entity",
    [ENTITY, DEVELOPER, Column("removed", "int", "loc", "lines they deleted"), Column("total_removed", "int", "loc", "lines all deleted"), OWNERSHIP], ["entity"], aliases=("refactoring-main-dev",), **LOC,
)
def by_deletions(facts: DataFrame) -> DataFrame:
    return main_developer(facts, F.sum("loc_deleted"), "removed", "total_removed")


@analysis(
    "main-developer-by-revisions", "Who changed each entity most often",
    [ENTITY, DEVELOPER, Column("added", "int", "count", "changes by them"), Column("total_added", "int", "count", "changes by all"), OWNERSHIP], ["entity"], aliases=("main-dev-by-revs",),
)
def by_revisions(facts: DataFrame) -> DataFrame:
    return main_developer(facts, F.count("*"), "added", "total_added")
