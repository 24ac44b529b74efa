"""Connected components of an edge table, by contraction, without bringing anything to the driver.

Each round hooks every node to its smallest neighbour, halves the paths until they end at roots, and rewrites the edges
to the roots; edges inside one tree vanish.  Rounds and halvings grow with the logarithm of the number of nodes.  Every
aggregation is a ``min``, which Spark combines before the shuffle, so a hub with many edges costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import delete, made_here, saved

MAX_ROUNDS = 64


def _step(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (a > b): roots (v, p) of all end points after hooking, and the edges between roots."""
    ends = edges.select(F.col("a").alias("v"), F.col("b").alias("p")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("p")))
    parents = saved(ends.groupBy("v").agg(F.min("p").alias("p")), "parents")
    for _ in range(MAX_ROUNDS):
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        halved = saved(parents.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "parents")
        parents = halved.select("v", "p")
        if halved.where("moved").isEmpty():
            break
    left = parents.select(F.col("v").alias("a"), F.col("p").alias("pa"))
    right = parents.select(F.col("v").alias("b"), F.col("p").alias("pb"))
    moved = edges.join(left, "a").join(right, "b").where("pa <> pb")
    return parents, saved(moved.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node of its component.

    Loops and repeated edges don't matter; an empty table gives an empty result; null ends are dropped.
    """
    with made_here() as made:
        whole = _components(edges)
        last = made.pop()
        delete(edges.sparkSession, made)
        made.append(last)
    return whole


def _components(edges: DataFrame) -> DataFrame:
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    whole = None
    for _ in range(MAX_ROUNDS):
        if whole is not None and e.isEmpty():
            break
        parents, e = _step(e)
        if whole is None:
            whole = parents.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            step = parents.select(F.col("v").alias("root"), F.col("p").alias("to"))
            whole = whole.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        whole = saved(whole, "components")
    else:
        raise RuntimeError("the components didn't settle")
    return whole
