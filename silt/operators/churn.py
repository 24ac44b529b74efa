"""Lines added and deleted by date, person and entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.operators.counts import ENTITY
from silt.registry import analysis
from silt.schema import Column

ADDED = Column("added", "int", "loc", "lines added")
DELETED = Column("deleted", "int", "loc", "lines deleted")
COMMITS = Column("commits", "int", "count", "commits")
LOC = {"needs": "loc", "errors": ("empty_log", "missing_metrics")}


def churn(facts: DataFrame, key: str) -> DataFrame:
    return facts.groupBy(key).agg(F.sum("loc_added").alias("added"), F.sum("loc_deleted").alias("deleted"), F.countDistinct("rev").alias("commits"))


@analysis("absolute-churn", "Lines added and deleted on each date", [Column("date", "string", "date", "day of the commits"), ADDED, DELETED, COMMITS], ["date", "added", "deleted"], aliases=("abs-churn",), **LOC)
def absolute_churn(facts: DataFrame) -> DataFrame:
    return churn(facts, "date")


@analysis("author-churn", "Lines added and deleted by each person", [Column("author", "string", "person", "who"), ADDED, DELETED, COMMITS], ["author", "added"], **LOC)
def author_churn(facts: DataFrame) -> DataFrame:
    return churn(facts, "author")


@analysis("entity-churn", "Lines added to and deleted from each entity", [ENTITY, ADDED, DELETED, COMMITS], ["-added", "entity"], **LOC)
def entity_churn(facts: DataFrame) -> DataFrame:
    return churn(facts, "entity")


@analysis("entity-ownership", "Each person's lines in each entity", [ENTITY, Column("author", "string", "person", "who"), ADDED, DELETED], ["entity", "author"], **LOC)
def entity_ownership(facts: DataFrame) -> DataFrame:
    return facts.groupBy("entity", "author").agg(F.sum("loc_added").alias("added"), F.sum("loc_deleted").alias("deleted"))
