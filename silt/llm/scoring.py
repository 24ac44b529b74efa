"""LM scoring of whole documents: counts over the whole training corpus, and a gated recurrent model (see ``gru``).

Tokens are words in ASCII lower case and one end.  Counts cover all training tokens; tasks sum them first.  The model knows the ``KNOWN`` most frequent tokens; another token's
probability is that of "another token" times its own add-one share among those.  It is trained in tasks, once on every training token: texts are cut into stretches
of ``STRETCH`` tokens, which are dealt to ``ROUNDS`` rounds and, in each, to slots by a hash of key, place and tokens, and sorted inside a slot.  Their number follows from the number of training tokens
alone (its power 2/3), so neither the model nor, in hundredths, to which they are rounded, scores depend on how the input is partitioned or on which task ran again (but for a score within a millionth of a rounding edge).  Slots start from one model; theirs are averaged, weighted by tokens, in a tree of tasks.

The most frequent tokens, about ``HOT``, go to the executors; what is rarer meets its counts in a join.  Nothing else leaves the executors but sums.

Defined cases: null and empty texts are the end alone; rows with a null key are held in and trained on; repeated rows count each and give a row each (equal in key and text, they
share their slots); with no training tokens N and V are 0, every token has the base probability 1 and the score is the model's log probability before any training; an empty table gives an
empty result; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import map_arrow, saved, word_blocks
from silt.llm.gru import LANES, WIDEST, Gru

KNOWN, HOT = 2048, 100_000
STRETCH, ROUNDS = 128, 2
SLOT = 4096  # a round of T tokens has T ** (2 / 3) / SLOT slots
COUNTED = 16 << 20  # bytes of words that a task holds before it passes its sums on
SCORED = 2_000_000  # tokens scored at once
FANIN = 16
END = b""


def held_out(key: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))


def _counts(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            nonlocal held, size
            found = pa.chunked_array(held, pa.large_binary()).value_counts()
            held, size = [], 0
            return pa.RecordBatch.from_arrays([found.field(0).cast(pa.binary()), found.field(1)], names=["token", "n"])

        for b in batches:
            held.append(pa.array([END], pa.large_binary()).take(pa.array(np.zeros(b.num_rows, np.int64))))
            for tokens, _ in word_blocks(b.column(0), lower=True):
                held.append(tokens)
                size += tokens.nbytes
                if size > COUNTED:
                    yield flush()
        yield flush()

    return map_arrow(train.select("text"), run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _ids(column: pa.Array, values: pa.Array, none: int, end: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Each text's tokens, its end among them, as places in ``values`` (``none``: elsewhere), where each text's begin, and (words, rows) of the words that are elsewhere."""
    ids, rows, rare = [np.empty(0, np.int32)], [np.empty(0, np.int64)], []
    for tokens, at in word_blocks(column, lower=True):
        got = pc.index_in(tokens, values)
        rare.append((tokens.filter(got.is_null()), at[got.is_null().to_numpy(zero_copy_only=False)]))
        ids.append(got.fill_null(none).to_numpy())
        rows.append(at)
    words, rows = np.concatenate(ids), np.concatenate(rows)
    sizes = np.bincount(rows, minlength=len(column)) + 1
    starts = np.r_[0, np.cumsum(sizes)]
    out = np.full(starts[-1], end, np.int32)
    out[np.arange(len(words)) + rows] = words
    return out, starts, rare


def _segments(train: DataFrame, tokens, rounds: int, slots: int) -> DataFrame:
    """(part, slot, h, ids): all training tokens as stretches of 16-bit ids, dealt to rounds and slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(tokens.value, pa.large_binary())
        end = values.index(END).as_py()
        for b in batches:
            ids, starts, _ = _ids(b.column(1), values, len(values), end if end >= 0 else len(values))
            parts = -(-np.diff(starts) // STRETCH)
            row = np.repeat(np.arange(b.num_rows), parts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            limits = np.r_[starts[row] + place * STRETCH, starts[-1]] * 2
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(limits.astype(np.int64)), pa.py_buffer(ids.astype(np.uint16))])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(place.astype(np.int64)), data.cast(pa.binary())], names=["key", "place", "ids"])

    kind = train.schema["key"].dataType.simpleString()
    cut = map_arrow(train.select("key", "text"), run, f"key {kind}, place long, ids binary").withColumn("h", F.xxhash64("key", "place", "ids"))
    turn = F.pmod("h", F.lit(rounds * slots))
    return cut.select((turn % rounds).cast("int").alias("part"), F.floor(turn / rounds).cast("int").alias("slot"), F.xxhash64("h").alias("h"), "ids")


def _averaged(model: Gru, segments: DataFrame, slots: int, lanes: int) -> Gru:
    """One round: each slot's model after its segments, averaged."""
    start = segments.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        slot = first.column(0)[0].as_py()

        ids = (np.frombuffer(x, np.uint16) for b in chain([first], batches) for x in b.column(1).to_pylist())
        m, n = start.value.train(ids, lanes)
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([n], pa.int64()), pa.array([m.vector().tobytes()], pa.binary())], names=["slot", "n", "v"])

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("slot"), int(rows["n"].sum())
        v = sum((np.frombuffer(x, np.float32) * (k / n) for x, k in zip(rows["v"], rows["n"])), start=0.0)
        return pd.DataFrame({"slot": [int(rows["slot"].iloc[0]) // FANIN], "n": [n], "v": [v.astype(np.float32).tobytes()]})

    dealt = segments.repartitionById(slots, F.col("slot")).sortWithinPartitions("h", "ids").select("slot", "ids")
    means = dealt.mapInArrow(run, "slot long, n long, v binary")
    while slots > 1:
        means = means.groupBy(F.floor(F.col("slot") / FANIN)).applyInPandas(mean, "slot long, n long, v binary")
        slots = -(-slots // FANIN)
    rows = means.collect()
    return model.with_vector(np.frombuffer(rows[0]["v"], np.float32)) if rows else model


def _most_frequent(counts: DataFrame) -> list:
    """About HOT tokens, the most frequent first: whole classes of a histogram of counts and, of the class that is too large, a share by hash, so no task sends more than it has of these."""
    level = F.floor(F.log2("n") * 16)
    total, least, share = 0, 1 << 20, 1.0
    for r in counts.groupBy(level.alias("b")).count().orderBy(F.desc("b")).collect():
        least, share = r["b"], min(1.0, (HOT - total) / r["count"])
        total += r["count"]
        if total >= HOT:
            break
    keep = (level > least) | (level == least) & (F.pmod(F.xxhash64("token"), F.lit(1 << 32)) < int(share * (1 << 32)))
    return sorted(((bytes(r["token"]), r["n"]) for r in counts.where(keep).collect()), key=lambda r: (-r[1], r[0]))


def trained(train: DataFrame, top: list, total: int) -> Gru:
    """The model after all rounds; ``top``: (token, count) of the tokens it knows, ``total``: how many training tokens there are."""
    model = Gru.fresh(np.array([n for _, n in top], float), total - sum(n for _, n in top))
    slots = max(1, math.ceil((total / ROUNDS) ** (2 / 3) / SLOT))
    segments = saved(_segments(train, train.sparkSession.sparkContext.broadcast([t for t, _ in top]), ROUNDS, slots), "lm-segments")
    for i in range(ROUNDS):
        model = _averaged(model, segments.where(F.col("part") == i), slots, WIDEST if i else LANES)
    return model


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    train = own.where(~held_out("key"))
    counts = saved(_counts(train), "lm-counts")
    total, distinct = counts.select(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = _most_frequent(counts)
    top = hot[:KNOWN]
    in_top = sum(n for _, n in top)
    held = spark.sparkContext.broadcast((trained(train, top, total), hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gru, found = held.value
        values = pa.array([t for t, _ in found], pa.large_binary())
        logs = np.log10(np.array([*(n for _, n in found), 0], float) + 1)
        end = values.index(END).as_py()
        uid = TaskContext.get().partitionId() << 33
        ready, ids, pending = [], [], 0

        def flush():
            nonlocal ready, ids, pending
            got = gru.score(ids)
            whole = pa.Table.from_batches(ready).combine_chunks().append_column("model", pa.array(got))
            ready, ids, pending = [], [], 0
            return whole.to_batches()

        for b in batches:
            at, starts, rare = _ids(b.column(1), values, -1, end)
            sizes, row = np.diff(starts), np.repeat(np.arange(b.num_rows), np.diff(starts))
            known, outside = at >= 0, (at < 0) | (at >= gru.size)
            count = lambda of: np.bincount(row[of], minlength=b.num_rows)  # noqa: E731, B023
            weigh = lambda of: np.bincount(row[of], logs[at[of]], b.num_rows).astype(float)  # noqa: E731, B023
            columns = [uid + np.arange(b.num_rows), sizes, count(known), count(outside), weigh(known), weigh(known & outside)]
            if end < 0:
                rare.append((pa.array([END] * b.num_rows, pa.large_binary()), np.arange(b.num_rows)))
            words = pa.chunked_array([w for w, _ in rare], pa.large_binary()).combine_chunks().dictionary_encode()
            code = np.concatenate([np.empty(0, np.int64), *(r for _, r in rare)]) * max(len(words.dictionary), 1) + words.indices.to_numpy()
            code, n = np.unique(code, return_counts=True)
            owner, word = np.divmod(code, max(len(words.dictionary), 1))
            pairs = pa.StructArray.from_arrays([words.dictionary.take(pa.array(word)).cast(pa.binary()), pa.array(n, pa.int64())], names=["token", "n"])
            rare_ = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)), pa.int32()), pairs)
            ready.append(pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in columns), rare_], names=["key", "uid", "n_tokens", "n_hot", "n_other", "hot_logs", "other_logs", "rare"]))
            ids += np.split(np.where(outside, gru.size, at).astype(np.uint16), starts[1:-1])
            uid += b.num_rows
            pending += len(at)
            if pending > SCORED:
                yield from flush()
        if ready:
            yield from flush()

    kind = own.schema["key"].dataType.simpleString()
    first = saved(map_arrow(own, run, f"key {kind}, uid long, n_tokens long, n_hot long, n_other long, hot_logs double, other_logs double, rare array<struct<token:binary,n:long>>, model double"), "lm-scored")
    rare = first.select("uid", F.inline("rare")).withColumnRenamed("n", "tf").join(counts, "token")
    met = rare.groupBy("uid").agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("rare_logs"), F.sum("tf").alias("n_rare")).withColumnRenamed("uid", "u")
    base, other = math.log10(total + distinct + 1), math.log10(total - in_top + distinct - len(top) + 1)
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return first.join(met, F.col("uid") == F.col("u"), "left").select(
        F.col("key").alias(key),
        held_out("key").alias("held_out"),
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_logs") + logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + F.col("other_logs") + logs - F.col("n_other") * other).alias("score"),
    )
