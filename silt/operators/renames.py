"""Files that change their names: histories followed over renames, each record under the name that its file ends up with.

A rename is a row (old, new, at); ``at`` has the type of the facts' ``ord`` and orders both.  A name may be given up and used again, so which rename follows another is a question of time: the next one
of its new name.  ``following`` answers it for any number of rows under one name; ``endings`` follows the links of all renames at once by pointer doubling, so a chain of n
renames takes log2(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silt.shared import kept

MAX_ROUNDS = 64


def following(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """``rows`` with ``next``: the first ``value`` that isn't null among the rows of the same ``key`` (never null) that come later by the columns of ``order``.

    Rows are dealt by ranges of (key, order), written, and looked through range by range; what lies beyond a range comes from one row for each range and key.  So rows
    of one key may be any share of all.
    """
    at = [F.asc(key), *map(F.asc, order)]
    dealt = kept(rows.withColumn("__v", value).repartitionByRange(*at).withColumn("__part", F.spark_partition_id()), "asof")
    # From the last row back: a frame that only grows is read once, one that only shrinks is read again for each row.
    inside = Window.partitionBy(key, "__part").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.where(F.col("__v").isNotNull()).groupBy(key, "__part").agg(F.min_by("__v", F.struct(*order)).alias("__f"))
    parts = dealt.select(key, "__part").distinct().join(first, [key, "__part"], "left")
    beyond = Window.partitionBy(key).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    later = parts.select(key, "__part", F.last("__f", ignorenulls=True).over(beyond).alias("__later"))
    near = dealt.withColumn("__near", F.last("__v", ignorenulls=True).over(inside))
    return near.join(later, [key, "__part"]).select(*rows.columns, F.coalesce("__near", "__later").alias("next"))


def endings(renames: DataFrame) -> DataFrame:
    """(id, old, new, at, final) of renames (id, old, new, at): ``final`` is the name that the file ends up with."""
    events = renames.select(F.col("old").alias("name"), "at", F.lit(0).alias("turn"), "id", F.col("id").alias("opens"))
    asks = renames.select(F.col("new").alias("name"), "at", F.lit(1).alias("turn"), "id", F.lit(None).cast(renames.schema["id"].dataType).alias("opens"))
    both = events.unionByName(asks)
    # renames at one place don't follow each other
    links = following(both, "name", ["at", "turn", "id"], F.col("opens")).where("turn = 1").select("id", F.col("next").alias("to"))
    state = kept(links.select("id", F.coalesce("to", "id").alias("to"), F.col("to").isNull().alias("done")), "renames")
    for _ in range(MAX_ROUNDS):
        if state.where("not done").isEmpty():
            break
        # ``done``: the pointer is at a chain's end; only the others look further, so an end that many chains share is no hot key.
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("done").alias("ended"))
        moved = state.where("not done").join(ahead, "to").select("id", F.col("further").alias("to"), F.col("ended").alias("done"))
        state = kept(state.where("done").unionByName(moved), "renames")
    else:
        raise RuntimeError("the renames didn't settle")
    ends = state.join(renames.select(F.col("id").alias("to"), F.col("new").alias("final")), "to").select("id", "final")
    return renames.join(ends, "id")


def renamed(facts: DataFrame, renames: DataFrame) -> DataFrame:
    """``facts`` with ``path``, the name a record has in the log, and ``entity``, the name its file ends up with.

    A record belongs to the next rename of its name that isn't earlier than it; a record of the old name at a rename's own place is of the file that is renamed.
    Rows with a null entity or place keep it.  A row is written and shuffled with each of its columns once.
    """
    ids = kept(renames.select("old", "new", "at").distinct().withColumn("id", F.xxhash64("old", "new", F.to_json(F.struct("at")))), "renames")
    ends = endings(ids)
    rest = [c for c in facts.columns if c not in ("entity", "ord")]
    row = F.struct(*rest) if rest else F.lit(True)
    marks = ends.select(F.col("old").alias("entity"), F.col("at").alias("ord"), F.lit(1).alias("turn"), "final", F.lit(None).cast(facts.select(row.alias("r")).schema["r"].dataType).alias("r"))
    own = facts.select("entity", "ord", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("final"), row.alias("r"))
    known = own.where("entity is not null and ord is not null").unionByName(marks)
    met = following(known, "entity", ["ord", "turn", "final"], F.col("final")).where("turn = 0")
    free = facts.where("entity is null or ord is null").select(*facts.columns, F.col("entity").alias("path"))
    columns = [F.coalesce("next", "entity").alias(c) if c == "entity" else F.col("ord") if c == "ord" else F.col("r")[c].alias(c) for c in facts.columns]
    return met.select(*columns, F.col("entity").alias("path")).unionByName(free)


def versions(facts: DataFrame, renames: DataFrame, entity: str) -> DataFrame:
    """(rev, date, ord, path), the oldest first: the commits of one file over all its names, each with the name it had then."""
    return renamed(facts, renames).where(F.col("entity") == entity).select("rev", "date", "ord", "path").distinct().orderBy("ord")
