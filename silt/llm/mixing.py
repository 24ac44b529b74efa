"""Mixing sources to target weights by the cube method of balanced sampling.

Sources, in the order of their names, have weights; together they get ``share`` times the words of all documents, by weight, none more than ``most`` times its own words
(what is above goes to the others by weight, until none is above).  A document is taken floor(target / own words of its source) times for sure, and once more with the rest as its inclusion probability.

The cube method decides who is taken once more: probabilities move at random through the null space of the constraints, which keep a source's words and number
of documents, until they reach 0 or 1.  Three probabilities always have such a direction, so a flight over a block of documents leaves at most two open.  Flights
run in blocks of about ``BLOCK`` documents of one source, dealt by hash, and keep up to ``POOL`` documents of graded sizes out; what they leave open and keep out meets in as many fewer blocks in the next round.  In a source's last
block these are the landing problem: of at most 2 ** (POOL + 2) roundings the one nearest to the source's words and number of documents is taken.

Documents of one key, source and size are interchangeable: they are counted before anything is dealt, the whole part of their expected number is taken, and one
stands for the rest.  Numbers at random follow from keys, sizes and ``SEED``, so results don't depend on how the table is partitioned.

Defined cases: null and empty texts have size 0 and are decided like others; null keys are a key; the null source is the last one; of repeated rows each counts; an empty table gives an empty result;
extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.llm.common import partitions, saved
from silt.llm.ranks import ranked

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, POOL, SEED = 1024, 14, 13
NEAR = 1e-4  # of a source's target: roundings that near are compared by their number of documents
COPIES = 4096  # equal rows that one row becomes at once
EPS = 1e-9
MAX_ROUNDS = 64


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(g, source_size, rows, target) of the sources ``g`` of rows (g, size)."""
    sums = sized.groupBy("g").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.lit("").alias("one"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights)).cast("int"))
    own = saved(ranked(sums, "one", ["g"], "mix-sources").select("g", "source_size", "rows", weight.alias("w")), "mix-sources")
    cap = most * F.col("source_size")
    whole = share * (own.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words for each unit of weight; each round can only raise it, so the sources above stay above
    while True:
        below, free = own.agg(F.sum(F.when(F.col("w") * level > cap, cap).otherwise(0)), F.sum(F.when(F.col("w") * level > cap, 0).otherwise(F.col("w")))).first()
        raised = (whole - (below or 0)) / free if free else level
        if raised <= level:
            break
        level = raised
    return own.select("g", "source_size", "rows", F.least(cap.cast("double"), F.col("w") * level).alias("target"))


def flight(sizes: list[float], rest: list[float], draws: Iterator[float]) -> None:
    """Moves ``rest`` in place, keeping its sum and that of ``sizes`` times it, until at most two of its values aren't 0 or 1."""
    window: list[int] = []
    for i in range(len(rest)):
        window.append(i)
        while len(window) == 3 or len(window) == 2 and sizes[window[0]] == sizes[window[1]]:
            s = [sizes[k] for k in window]
            u = [1.0, -1.0] if len(s) == 2 else [s[1] - s[2], s[2] - s[0], s[0] - s[1]]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            up = min((1 - rest[k] if d > 0 else rest[k]) / abs(d) for k, d in zip(window, u) if d)
            down = min((rest[k] if d > 0 else 1 - rest[k]) / abs(d) for k, d in zip(window, u) if d)
            step = up if next(draws) * (up + down) < down else -down
            for k, d in zip(window, u):
                moved = rest[k] + step * d
                rest[k] = 0.0 if moved < EPS else 1.0 if moved > 1 - EPS else moved
            window = [k for k in window if 0 < rest[k] < 1]


def graded(sizes: list[float], pool: int) -> list[int]:
    """Up to ``pool`` rows of graded sizes: the largest, then such of at most half of what those after it must make up, so that parts of them sum to about anything."""
    out, short = [], float("inf")
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if len(out) < pool and 0 < sizes[i] <= short / 2:
            out.append(i)
            short = max(short - sizes[i], sizes[i]) if len(out) > 1 else sizes[i]
    return out


def land(sizes: np.ndarray, rest: np.ndarray, near: float) -> np.ndarray:
    """0 or 1 for each row: of all roundings within ``near`` words of the expected sum the one nearest in number, else the one nearest in words."""
    k = len(rest)
    every = np.arange(1 << k)[:, None] >> np.arange(k) & 1
    words = np.abs(every @ sizes - rest @ sizes)
    count = np.abs(every.sum(1) - rest.sum())
    close = np.flatnonzero(words <= max(near, words.min() + EPS))
    return every[close[np.lexsort((words[close], count[close]))[0]]]


def _flown(number: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The flight of a block in the round ``number``; a source's last block lands."""

    def fly(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["draw", "size"], ignore_index=True)
        first = t.iloc[0]
        rng = np.random.default_rng([SEED, number, zlib.crc32(first["g"].encode()), int(first["block"])])
        last = int(first["blocks"]) == 1
        sizes, rest = t["size"].astype(float).tolist(), t["rest"].tolist()
        held = set(graded(sizes, POOL))
        flying = [i for i in range(len(rest)) if i not in held]
        moved = [rest[i] for i in flying]
        flight([sizes[i] for i in flying], moved, iter(rng.random, None))
        for i, x in zip(flying, moved):
            rest[i] = x
        if last:
            landing = [i for i in range(len(rest)) if 0 < rest[i] < 1]
            s, r = np.array([sizes[i] for i in landing]), np.array([rest[i] for i in landing])
            for i, x in zip(landing, land(s, r, NEAR * float(first["target"]))):
                rest[i] = float(x)
        return t.assign(rest=rest)

    return fly


def decide(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(g, key, size, c, source_size, target, whole, extra): for rows (g, key, size), of which there are c alike, each is taken ``whole`` times and ``extra`` of them once more."""
    sources = targets(sized, weights, share, most)
    units = sized.groupBy("g", "key", "size").agg(F.count("*").alias("c")).join(sources, "g")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + EPS)
    units = units.withColumn("whole", whole).withColumn("more", F.greatest(ratio - whole, F.lit(0.0)) * F.col("c")).withColumn("base", F.floor(F.col("more") + EPS))
    units = units.withColumn("rest", F.col("more") - F.col("base")).withColumn("rest", F.when(F.col("rest") < EPS, 0.0).otherwise(F.col("rest"))).drop("more")
    units = units.withColumn("draw", F.xxhash64("key", "size", F.lit(SEED))).withColumn("blocks", F.ceil(F.col("rows") / BLOCK)).drop("rows")
    open_ = saved(units, "mix-units")
    decided = [open_.where("rest = 0")]
    open_ = open_.where("rest > 0")
    for number in range(MAX_ROUNDS):
        if open_.isEmpty():
            break
        dealt = open_.withColumn("block", F.pmod(F.xxhash64("draw", F.lit(number)), "blocks"))
        flown = saved(dealt.groupBy("g", "block").applyInPandas(_flown(number), dealt.schema).drop("block"), "mix-flown")
        decided.append(flown.where("rest in (0, 1)"))
        open_ = flown.where("rest > 0 and rest < 1").withColumn("blocks", F.ceil(F.col("blocks") * (POOL + 2) / BLOCK))  # what a block leaves at most
    else:
        raise RuntimeError("the flights didn't end")
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.select("g", "key", "size", "c", "source_size", "target", "whole", (F.col("base") + F.col("rest")).cast("long").alias("extra"))


def sizes_of(docs: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(g, key, size), written; ``g`` sorts by code points, null last."""
    g = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("~"))
    return saved(docs.select(g.alias("g"), F.col(key).alias("key"), words_in(F.col(text)).alias("size")), "mix-sizes")


def report(docs: DataFrame, key: str = "doc_id", group: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, size, source_size, target, taken), one row a document."""
    units = saved(decide(sizes_of(docs, key, group, text), weights, share, most), "mix-decided")
    many = (units.agg(F.max("c")).first()[0] or 0) > COPIES
    parts = units.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"), F.lit(COPIES).cast("long"))))
    if many:  # rows alike by the thousand come out in several tasks
        parts = parts.repartition(partitions(docs))
    rows = parts.withColumn("i", F.explode(F.sequence("from", F.least(F.col("from") + COPIES - 1, "c"))))
    taken = F.col("size") * (F.col("whole") + (F.col("i") <= F.col("extra")).cast("long"))
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", group: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    g = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit("~"))
    rows = docs.select(g.alias("g"), F.col(key).alias("key"), words_in(F.col(text)).alias("size"), F.struct("*").alias("row"))
    units = saved(decide(sizes_of(docs, key, group, text), weights, share, most), "mix-decided")
    met = rows.join(units, (rows["g"] == units["g"]) & rows["key"].eqNullSafe(units["key"]) & (rows["size"] == units["size"])).select("row", "c", "whole", "extra", units["g"], units["key"], units["size"])
    single = met.where("c = 1").select("row", (F.col("whole") + F.col("extra")).alias("times"))
    alike = met.where("c > 1").select("row", "whole", "extra", F.to_json(F.struct("g", "key", "size")).alias("unit"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    several = ranked(alike, "unit", ["salt"], "mix-alike").select("row", (F.col("whole") + (F.col("pos") < F.col("extra")).cast("long")).alias("times"))
    taken = single.unionByName(several).where("times > 0")
    return taken.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
