"""Histories that keep arriving: fact rows from a growing folder, and analyses that follow them.

Sums are kept as state.  Distinct counts are not defined on streams, so what is counted is deduplicated first: ``distinct_counts`` keeps each combination that it has seen, exactly and for good, so
files may come in any order; ``revisions`` forgets by a watermark, and a row that comes later isn't counted.  ``pair_changes`` follows the pairs of change sets, and takes back those of a commit that
outgrows the limit.  ``follow`` is exact for every analysis: it stores each batch and evaluates the whole history again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from silt.operators.coupling import chosen, numbers
from silt.registry import lookup
from silt.schema import FACT


def read_facts(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet fact files that are put into a folder."""
    return spark.readStream.schema(FACT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB: a task holds a part of it, and a batch writes what it changes, not a copy of the rest."""
    old = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep_batch(out: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` in update mode: each batch's changed rows in a folder of their own, so a batch that is retried is stored once."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")


def newest(changed: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key, from what ``keep_batch`` stored: a table of the whole stream, of which no batch wrote more than it changed."""
    rest = [c for c in changed.columns if c not in (*keys, "batch")]
    return changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def timed(facts: DataFrame, delay: str = "30 days") -> DataFrame:
    """With the commit's day as event time; rows without a real day are left out."""
    return facts.withColumn("ts", F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))).where("ts is not null").withWatermark("ts", delay)


def ownership(facts: DataFrame) -> DataFrame:
    """(entity, author, added, deleted) so far."""
    return facts.groupBy("entity", "author").agg(F.sum("loc_added").alias("added"), F.sum("loc_deleted").alias("deleted"))


def churn(facts: DataFrame, key: str) -> DataFrame:
    """(key, added, deleted) so far."""
    return facts.groupBy(key).agg(F.sum("loc_added").alias("added"), F.sum("loc_deleted").alias("deleted"))


def revisions(facts: DataFrame, delay: str = "30 days") -> DataFrame:
    """(entity, n_revs) so far: each commit counts once for an entity; what is remembered ends with the watermark."""
    return timed(facts, delay).dropDuplicatesWithinWatermark(["entity", "rev"]).groupBy("entity").agg(F.count("*").alias("n_revs"))


def distinct_counts(facts: DataFrame, key: str, **counted: str) -> DataFrame:
    """(key, one column for each of ``counted``: name=column) so far: distinct values of each column for each value of ``key``, exact whatever the order of arrival.

    Each row is taken apart into one (key, name, value) for each column; the state has one entry for each that differs, spread by all three, so a hot key isn't one task's.  Rows
    themselves are counted by a column that tells them apart, such as ``ord``.
    """
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in counted.items()])
    seen = facts.select(F.col(key), F.explode(parts).alias("x")).select(key, "x.name", "x.value").where("value is not null").dropDuplicates([key, "name", "value"])
    return seen.groupBy(key).agg(*[F.count(F.when(F.col("name") == n, 1)).alias(n) for n in counted])


def authors(facts: DataFrame) -> DataFrame:
    """(entity, n_authors, n_revs) so far, as the analysis of the same name has them; rows are told apart by ``ord``, so one that comes twice counts once."""
    return distinct_counts(facts, "entity", n_authors="author", n_revs="ord")


def pair_changes(facts: DataFrame, largest: int = 30, buckets: int = 1 << 14) -> DataFrame:
    """(a, b, change) of pairs a <= b of entities of a commit, to be summed over all batches; append mode.

    What is kept of a commit is its entities, ``largest`` at most: with one more its pairs are taken back and only that it is too wide is kept.  Commits are dealt to
    ``buckets`` by a hash, and one entry of state is a bucket's commits, as JSON: a call of Python for each commit and batch would take most of the time.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: dict[str, list[str] | None] = json.loads(state.get[0]) if state.exists else {}
        touched: dict[str, set[str]] = {}
        for part in rows:
            for rev, entity in zip(part["rev"].tolist(), part["entity"].tolist()):
                if rev in kept and kept[rev] is None:
                    continue
                now = touched.get(rev)
                if now is None:
                    now = touched[rev] = set(kept.get(rev, ()))
                if entity is not None and len(now) <= largest:
                    now.add(entity)
        changed = []
        for rev, now in touched.items():
            before = set(kept.get(rev, ()))
            if len(now) > largest:
                kept[rev] = None
                changed += [(a, b, -1) for a in before for b in before if a <= b]
            else:
                kept[rev] = sorted(now)
                changed += [(min(a, b), max(a, b), 1) for a in now - before for b in now if b in before or a <= b]
            if len(changed) >= 1 << 16:
                yield pd.DataFrame(changed, columns=["a", "b", "change"])
                changed = []
        state.update((json.dumps(kept),))
        if changed:
            yield pd.DataFrame(changed, columns=["a", "b", "change"])

    own = facts.where("rev is not null").select("rev", "entity", F.pmod(F.xxhash64("rev"), F.lit(buckets)).alias("bucket"))
    return own.groupBy("bucket").applyInPandasWithState(step, "a string, b string, change long", "commits string", "append", "NoTimeout")


def coupled(changes: DataFrame, **thresholds: int) -> DataFrame:
    """The coupling analysis, all its columns, from the stored changes of pairs."""
    pairs = changes.groupBy("a", "b").agg(F.sum("change").alias("shared")).where("shared > 0")
    return chosen(numbers(pairs), **thresholds)


def sliding_churn(facts: DataFrame, days: int, delay: str = "30 days") -> DataFrame:
    """(start, end, added, deleted) of windows of days that move by a day; in append mode a window comes out when the watermark passes it."""
    w = timed(facts, delay).groupBy(F.window("ts", f"{days} days", "1 day").alias("w"))
    return w.agg(F.sum("loc_added").alias("added"), F.sum("loc_deleted").alias("deleted")).select("w.start", "w.end", "added", "deleted")


def follow(facts: DataFrame, name: str, store: str, checkpoint: str, use: Callable[[DataFrame, int], None], **flags) -> StreamingQuery:
    """Runs an analysis again after each batch, over all that has come, and gives it to ``use``; a batch that is retried is stored once."""

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{store}/batch={n}")
        so_far = df.sparkSession.read.schema(FACT).parquet(store)
        use(lookup(name).run(so_far, **flags), n)

    return facts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
