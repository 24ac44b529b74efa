"""People who work on the same entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silt.functions.exprs import average, percentage, truncated
from silt.operators.peers import pairs_of
from silt.registry import analysis
from silt.schema import Column
from silt.shared import partitions

SLICE = 1024
HOT = 1024
RECORDS_BYTES = 8 << 20  # stored bytes of input for each partition of records,
PAIRS_BYTES = 4 << 20  # and of pairs, of which there are many times as many


@analysis(
    "communication",
    "How much people's work overlaps",
    [
        Column("author", "string", "person", "one of the pair"),
        Column("peer", "string", "person", "the other"),
        Column("shared", "int", "count", "entities that both changed"),
        Column("average", "int", "count", "average number of entities of the two"),
        Column("strength", "int", "percentage", "shared entities in percent of the average"),
    ],
    ["-strength", "-author", "-peer"],
)
def communication(facts: DataFrame) -> DataFrame:
    """Each pair is counted once, at the person who is first by name, and mirrored after it is summed.

    The people of an entity meet in one sorted list, with how many entities each touched. A task packs its lists for each part of the people and compresses them by columns, so a pair
    takes a few bytes of the one shuffle that grows with the pairs, which are counted where they arrive.  The pairs of people of over ``HOT`` entities are summed ahead of their shuffle
    instead, so none of them is one task's.

    An entity of over ``SLICE`` people is cut into slices of about so many by a hash of the name, and every two slices meet under a key of their own, so no list
    has more than two slices' people; the other entities' lists are formed where their people were counted.
    """
    count = lambda key: F.count("*").over(Window.partitionBy(key))
    named = facts.select("entity", "author").where("author is not null")
    n = partitions(facts, RECORDS_BYTES)
    many = [n] if n > int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    own = named.repartition(*many, "entity", "author").distinct().repartition(*many, "author").withColumn("n", count("author")).where("entity is not null").repartition(*many, "entity")
    sized = own.withColumn("slices", F.ceil(count("entity") / SLICE).cast("int"))
    cut = sized.where("slices > 1").withColumn("slice", F.pmod(F.xxhash64("author"), F.col("slices")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: F.struct(F.least(k, F.col("slice")).alias("i"), F.greatest(k, F.col("slice")).alias("j")))
    met = cut.select("entity", "author", "n", "slice", F.inline(others)).repartition("entity", "i", "j")
    people = F.sort_array(F.collect_list(F.struct("author", "n", "slice", F.xxhash64("author").alias("h")))).alias("people")
    none = F.lit(0).alias("i"), F.lit(0).alias("j")
    whole = sized.where("slices = 1").withColumn("slice", F.lit(0)).groupBy("entity").agg(people).select(*none, "people")
    lists = whole.unionByName(met.groupBy("entity", "i", "j").agg(people).select("i", "j", "people")).where(F.size("people") > 1)
    each = lists.where(F.exists("people", lambda x: x["n"] > HOT)).select("i", "j", "people", F.posexplode("people").alias("place", "one")).where(F.col("one.n") > HOT)
    behind = F.slice("people", F.col("place") + 2, F.size("people"))
    apart = F.when(F.col("i") == F.col("j"), behind).otherwise(F.filter(behind, lambda x: x["slice"] != F.col("one.slice")))
    peers = F.transform(apart, lambda x: F.struct(x["author"].alias("b"), x["n"].alias("nb")))
    hot = each.select(F.col("one.author").alias("a"), F.col("one.n").alias("na"), F.inline(peers)).groupBy("a", "na", "b", "nb").agg(F.count("*").alias("shared"))
    pairs = pairs_of(lists.where(F.exists("people", lambda x: x["n"] <= HOT)), partitions(facts, PAIRS_BYTES), HOT).unionByName(hot)
    mean = F.ceil(average(F.col("na"), F.col("nb")))
    ways = F.array(F.struct(F.col("a").alias("author"), F.col("b").alias("peer")), F.struct(F.col("b").alias("author"), F.col("a").alias("peer")))
    out = pairs.select(F.explode(ways).alias("w"), "shared", mean.alias("average"))
    return out.select("w.author", "w.peer", "shared", "average", truncated(percentage(F.col("shared") / F.col("average"))).alias("strength"))
