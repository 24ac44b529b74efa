"""Entities in commits whose message matches an expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.functions.patterns import linear_regex
from silt.operators.counts import ENTITY
from silt.registry import Flag, analysis
from silt.schema import Column


@analysis(
    "messages",
    "How often each entity changed in commits whose message matches",
    [ENTITY, Column("matches", "int", "count", "matching commits that changed it")],
    ["-matches", "-entity"],
    flags=(Flag("expression", "string", None, "regular expression, found anywhere in a message", True),),
    errors=("empty_log", "invalid_expression", "missing_messages"),
    needs="messages",
)
def messages(facts: DataFrame, expression: str) -> DataFrame:
    return facts.where(F.col("message").rlike(linear_regex(expression, "invalid_expression"))).groupBy("entity").agg(F.countDistinct("rev").alias("matches"))
