"""Entities that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silt.functions.exprs import average, percentage, truncated
from silt.operators.counts import ENTITY
from silt.registry import Flag, analysis
from silt.schema import Column
from silt.shared import partitions

FLAGS = (
    Flag("min-revs", "int", 5, "least average number of commits of a pair"),
    Flag("min-shared-revs", "int", 5, "least number of shared commits"),
    Flag("min-coupling", "int", 30, "least degree in percent"),
    Flag("max-coupling", "int", 100, "largest degree in percent"),
    Flag("max-changeset-size", "int", 30, "commits of more entities are left out"),
    Flag("verbose", "bool", False, "also the numbers of commits"),
)


SETS_BYTES = 2 << 20  # stored bytes of input for each partition of commits: their pairs are many times as many as records


def touched(facts: DataFrame) -> DataFrame:
    """(rev, entity), each once, dealt by commit: one shuffle serves the distinct rows, sizes and sets, and a task has about as many pairs at any size of the history."""
    return facts.select("rev", "entity").repartition(partitions(facts, SETS_BYTES), "rev").distinct()


def sized(facts: DataFrame, largest: int) -> DataFrame:
    """(rev, entity) of commits that touched at most ``largest`` entities."""
    return touched(facts).withColumn("n", F.count("*").over(Window.partitionBy("rev"))).where(F.col("n") <= largest).drop("n")


def change_sets(facts: DataFrame, largest: int) -> DataFrame:
    """(rev, entities): the sorted distinct entities of each commit that has at most ``largest``.

    The size is counted by a window, which spills, before anything is collected, so an array has ``largest`` entries at most.
    """
    return sized(facts, largest).groupBy("rev").agg(F.sort_array(F.collect_list("entity")).alias("entities"))


def pair_counts(sets: DataFrame) -> DataFrame:
    """(a, b, shared): in how many change sets a <= b are together; a = b counts a's change sets."""
    pairs = F.flatten(F.transform("entities", lambda x, i: F.transform(F.slice("entities", i + 1, F.size("entities")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("shared"))


def candidates(facts: DataFrame, largest: int) -> DataFrame:
    """Every pair with its numbers, before any threshold.

    Each entity takes its number of commits along into the sets, so the pairs, many times as many as the records, are shuffled once, to be counted, and joined with nothing.
    """
    kept = sized(facts, largest).where("entity is not null")
    own = kept.groupBy("entity").agg(F.count("*").alias("revs"))
    dealt = kept.join(own, "entity").repartition(partitions(facts, SETS_BYTES), "rev")
    sets = dealt.groupBy("rev").agg(F.sort_array(F.collect_list(F.struct("entity", "revs"))).alias("entities"))
    both = lambda x, y: F.struct(x["entity"].alias("a"), y["entity"].alias("b"), x["revs"].alias(REVS[0]), y["revs"].alias(REVS[1]))
    pairs = F.flatten(F.transform("entities", lambda x, i: F.transform(F.slice("entities", i + 2, F.size("entities")), lambda y: both(x, y))))
    return degrees(sets.select(F.inline(pairs)).groupBy("a", "b", *REVS).agg(F.count("*").alias("shared")))


REVS = ["first_entity_revisions", "second_entity_revisions"]


def numbers(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, shared), those with a = b among them, with the commits of each and the degree."""
    own = pairs.where("a = b")
    first = own.select("a", F.col("shared").alias("first_entity_revisions"))
    second = own.select("b", F.col("shared").alias("second_entity_revisions"))
    return degrees(pairs.where("a < b").join(first, "a").join(second, "b"))


def degrees(out: DataFrame) -> DataFrame:
    avg = average(F.col("first_entity_revisions"), F.col("second_entity_revisions"))
    return out.withColumn("avg", avg).withColumn("degree_f", percentage(F.col("shared") / F.col("avg")))


@analysis(
    "coupling",
    "Pairs of entities that change in the same commits",
    [
        ENTITY,
        Column("coupled", "string", "filepath", "the other of the pair"),
        Column("degree", "int", "percentage", "shared commits in percent of the pair's average"),
        Column("average_revs", "int", "count", "average number of commits of the two"),
        Column("first_entity_revisions", "int", "count", "commits of the first", "verbose"),
        Column("second_entity_revisions", "int", "count", "commits of the other", "verbose"),
        Column("shared_revisions", "int", "count", "commits of both", "verbose"),
    ],
    ["-degree", "-average_revs", "entity", "coupled"],
    flags=FLAGS,
    change_sets=True,
)
def coupling(facts: DataFrame, min_revs: int, min_shared_revs: int, min_coupling: int, max_coupling: int, max_changeset_size: int, verbose: bool) -> DataFrame:
    return chosen(candidates(facts, max_changeset_size), min_revs, min_shared_revs, min_coupling, max_coupling)


def chosen(pairs: DataFrame, min_revs: int = 5, min_shared_revs: int = 5, min_coupling: int = 30, max_coupling: int = 100) -> DataFrame:
    """The pairs that reach all thresholds."""
    kept = pairs.where(
        (truncated(F.col("avg")) >= min_revs) & (F.col("shared") >= min_shared_revs) & (F.col("degree_f") >= min_coupling) & (F.floor("degree_f") <= max_coupling)
    )
    return kept.select(
        F.col("a").alias("entity"),
        F.col("b").alias("coupled"),
        truncated(F.col("degree_f")).alias("degree"),
        F.ceil("avg").alias("average_revs"),
        "first_entity_revisions",
        "second_entity_revisions",
        F.col("shared").alias("shared_revisions"),
    )


def all_filtered(facts: DataFrame, min_revs: int = 5, min_shared_revs: int = 5, min_coupling: int = 30, max_coupling: int = 100, max_changeset_size: int = 30, **_) -> dict | None:
    """Which thresholds no candidate pair reaches, and the best there is; None if there is no candidate."""
    best = candidates(facts, max_changeset_size).agg(
        F.count("*").alias("n"), F.max(truncated(F.col("degree_f"))).alias("degree"), F.max("shared").alias("shared"), F.max(truncated(F.col("avg"))).alias("avg")
    )
    n, degree, shared, avg = best.first()
    if not n:
        return None
    blocking = [f for f, bad in (("min-revs", avg < min_revs), ("min-shared-revs", shared < min_shared_revs), ("min-coupling", degree < min_coupling), ("max-coupling", degree > max_coupling)) if bad]
    return {
        "candidate_pairs": n,
        "blocking": blocking,
        "observed": {"max_degree": degree, "max_shared_revs": shared, "max_average_revs": avg},
        "thresholds": {"min-revs": min_revs, "min-shared-revs": min_shared_revs, "min-coupling": min_coupling, "max-coupling": max_coupling},
    }


@analysis(
    "sum-of-coupling",
    "How many entities changed beside each, over all commits",
    [ENTITY, Column("soc", "int", "count", "entities that changed beside it")],
    ["-soc", "-entity"],
    aliases=("soc",),
    flags=(Flag("min-revs", "int", 5, "only sums above this"),),
    change_sets=True,
)
def sum_of_coupling(facts: DataFrame, min_revs: int) -> DataFrame:
    sized = touched(facts).withColumn("n", F.count("*").over(Window.partitionBy("rev")) - 1)
    return sized.groupBy("entity").agg(F.sum("n").alias("soc")).where(F.col("soc") > min_revs)
