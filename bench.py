"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: the fact table is cached, each query is warmed up once and timed three times; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from silt.operators import second
from silt.plans.batch import lattice
from silt.operators.transforms import map_teams, temporal_windows
from silt.queries import LOW, layered, table
from silt.sources.adapters import nation_teams, order_history

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
RUNS = 3


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    facts = order_history(spark, SF).cache()
    rows = facts.count()
    teams = map_teams(facts, nation_teams(spark, SF)).cache()
    teams.count()
    runs = {
        "authors": lambda: table("authors", facts),
        "revisions": lambda: table("revisions", facts),
        "summary": lambda: table("summary", facts),
        "absolute_churn": lambda: table("absolute-churn", facts),
        "entity_churn": lambda: table("entity-churn", facts),
        "entity_ownership": lambda: table("entity-ownership", facts),
        "main_developer": lambda: table("main-developer", facts),
        "entity_effort": lambda: table("entity-effort", facts),
        "fragmentation": lambda: table("fragmentation", facts),
        "code_age": lambda: table("code-age", facts, time_now="2002-03-30"),
        "messages": lambda: table("messages", facts, expression="URG|NOT"),
        "coupling": lambda: table("coupling", facts, **LOW),
        "sum_of_coupling": lambda: table("sum-of-coupling", facts),
        "communication": lambda: table("communication", teams),
        "group_layers": lambda: table("authors", layered(facts)),
        "temporal_window": lambda: temporal_windows(facts, 3, check=False),
        "monthly_momentum": lambda: second.monthly_momentum(table("absolute-churn", facts)),
        "commit_vocabulary": lambda: second.vocabulary(facts),
    }
    # The machine by itself: an aggregation that no change touches, in no total; rounds are compared by the ratio to it.
    runs = {"calibration": lambda: facts.groupBy("entity").count()} | runs | {"batch_counts": lambda: lattice(facts)}
    took = {}
    for name, make in runs.items():
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 4)
    calibration, batch = took.pop("calibration"), took.pop("batch_counts")
    print(json.dumps({"metric": "history_analyses_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/")), "fact_rows": rows, "cpus": int(CPUS), "calibration": calibration, "lattice_of_12": batch}))
    spark.stop()


if __name__ == "__main__":
    main()
