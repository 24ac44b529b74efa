"""Change frequency, distinct authors and the overview."""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silt.functions.exprs import centi
from silt.registry import analysis
from silt.schema import Column

ENTITY = Column("entity", "string", "filepath", "path of the file, or name of its layer")


@analysis(
    "authors",
    "How many people changed each entity",
    [ENTITY, Column("n_authors", "int", "count", "people who changed it"), Column("n_revs", "int", "count", "changes to it")],
    ["-n_authors", "-n_revs", "entity"],
)
def authors(facts: DataFrame) -> DataFrame:
    return facts.groupBy("entity").agg(F.countDistinct("author").alias("n_authors"), F.count("*").alias("n_revs"))


@analysis("revisions", "How often each entity changed", [ENTITY, Column("n_revs", "int", "count", "commits that changed it")], ["-n_revs", "entity"])
def revisions(facts: DataFrame) -> DataFrame:
    return facts.groupBy("entity").agg(F.countDistinct("rev").alias("n_revs"))


@analysis("summary", "Totals of the history", [Column("statistic", "string", "label", "what is counted"), Column("value", "int", "count", "how many")], ["place"])
def summary(facts: DataFrame) -> DataFrame:
    """Always four rows, zeros for an empty history."""
    one = facts.agg(F.countDistinct("rev").alias("c"), F.countDistinct("entity").alias("e"), F.count("*").alias("m"), F.countDistinct("author").alias("a"))
    return one.selectExpr(
        "stack(4, 0, 'number-of-commits', c, 1, 'number-of-entities', e, 2, 'number-of-entities-changed', m, 3, 'number-of-authors', a) as (place, statistic, value)"
    )


@analysis(
    "entity-effort",
    "Each person's share of an entity's changes",
    [ENTITY, Column("author", "string", "person", "who"), Column("author_revs", "int", "count", "changes by them"), Column("total_revs", "int", "count", "changes by all")],
    ["entity", "-author_revs", "author"],
)
def entity_effort(facts: DataFrame) -> DataFrame:
    """One shuffle of the facts, one of the sums; a window's task holds an entity's people, not its changes, and spills."""
    own = facts.groupBy("entity", "author").agg(F.count("*").alias("author_revs"))
    return own.withColumn("total_revs", F.sum("author_revs").over(Window.partitionBy("entity")))


def square(n: C, total: C) -> C:
    return (n.cast("double") / total) * (n.cast("double") / total)


def squares(own: DataFrame) -> DataFrame:
    """(entity, fractal_value, total_revs) of rows (entity, author, n): one less the squares of shares, added in the order of authors, since the last bit of a sum of doubles depends on it."""
    each = own.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("author", "n"))).alias("a"), F.sum("n").alias("total_revs"))
    share = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + square(x["n"], F.col("total_revs")))
    return each.select("entity", centi(F.lit(1.0) - share).alias("fractal_value"), "total_revs")


@analysis(
    "fragmentation",
    "How spread an entity's changes are over people",
    [ENTITY, Column("fractal_value", "float", "ratio", "0: one person; towards 1: many"), Column("total_revs", "int", "count", "changes to it")],
    ["-fractal_value", "-total_revs", "entity"],
)
def fragmentation(facts: DataFrame) -> DataFrame:
    return squares(facts.groupBy("entity", "author").agg(F.count("*").alias("n")))
