"""Months since an entity's last change."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.errors import SiltError
from silt.functions.exprs import day, months_between
from silt.operators.counts import ENTITY
from silt.registry import Flag, analysis
from silt.schema import Column


def parsed_now(text: str) -> dt.date:
    if not text:
        return dt.datetime.now(dt.timezone.utc).date()
    try:
        found = dt.date.fromisoformat(text)
        if found.isoformat() != text:
            raise ValueError(text)
        return found
    except ValueError as e:
        raise SiltError("invalid_time_now", f"{text!r} isn't a date", {"time-now": text}) from e


@analysis(
    "code-age",
    "Months since each entity last changed",
    [ENTITY, Column("age_months", "int", "duration_months", "whole months")],
    ["age_months", "entity"],
    aliases=("age",),
    flags=(Flag("time-now", "string", "", "the day to count from; today if empty"),),
    errors=("empty_log", "invalid_time_now"),
)
def code_age(facts: DataFrame, time_now: str) -> DataFrame:
    now = F.lit(parsed_now(time_now))
    d = day(F.col("date"))
    last = facts.where(d < now).groupBy("entity").agg(F.max(d).alias("last"))
    return last.select("entity", months_between(now, F.col("last")).alias("age_months"))
