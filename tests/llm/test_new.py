"""Runs, manifests and mixes against definitions in plain Python."""

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from silt.llm import common, manifest, mixing, periods

from brute import plain_manifest, plain_runs, plain_runs_row, plain_targets, words

# ---- periodic runs


@pytest.mark.parametrize("seed", range(60))
def test_runs(seed):
    r = random.Random(seed)
    for _ in range(12):
        n, k = r.randint(0, 140), r.choice([1, 2, 2, 3, 5, 30])
        w = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            if n > 3:
                a = r.randrange(n)
                p = r.randint(1, max(1, (n - a) // 3))
                for i in range(a, min(n, a + r.randint(1, n))):
                    w[i] = w[a + (i - a) % p]
        least, step = r.choice([12, 12, 2, 5, 30]), r.choice([1, 3, 17, 1000])
        assert periods.runs(np.array(w, np.uint64), least, step) == plain_runs(w, least), (w, least, step)


def test_runs_of_texts_that_share_catchers(monkeypatch):
    monkeypatch.setattr(periods, "TOGETHER", 50)
    r = random.Random(3)
    texts = [[r.randrange(2) for _ in range(r.choice([0, 1, 11, 12, 13, 40, 90]))] for _ in range(80)]
    assert periods.runs_of([np.array(t, np.uint64) for t in texts]) == [plain_runs(t) for t in texts]


def test_block_sizes():
    """Each period of a run has a level, and its stretch of equal words holds a whole block of that level."""
    for least in (1, 2, 5, 12, 40):
        found = periods.levels(300, least)
        assert [p for _, low, high in found for p in range(low, high)] == list(range(1, 301))
        for size, low, high in found:
            assert all(2 * size - 1 <= max(p, least - p) for p in range(low, high)) or size == 1
            assert size & (size - 1) == 0


def test_long_runs_are_linear():
    """One word, two words in turn, Fibonacci words: a run for each, however long."""
    assert periods.runs(np.zeros(300_000, np.uint64)) == [(0, 300_000, 1)]
    assert periods.runs(np.arange(200_001, dtype=np.uint64) % np.uint64(7)) == [(0, 200_001, 7)]


def test_report(docs, pairs, empty):
    """Texts of up to some thousand words; the giant one by its length alone."""
    rows = {}
    for r in periods.report(docs).collect():
        rows.setdefault(r["doc_id"], []).append(list(r))
    want = {}
    for k, t in pairs:
        if k != 302:
            want.setdefault(k, []).append(plain_runs_row(k, t))
    assert set(rows) == {k for k, _ in pairs}
    assert all(sorted(rows[k], key=str) == sorted(v, key=str) for k, v in want.items())
    assert periods.report(empty).collect() == [] and periods.find(empty).collect() == []


def test_planted_documents(spark, prose):
    keys = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(k, prose(k, 1 + 3 * i)) for i, k in enumerate(keys)]
    got = periods.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(list(r) for r in got) == sorted(plain_runs_row(k, t) for k, t in rows)
    assert sum(r["n_runs"] > 0 for r in got) > len(rows) // 2


def test_collapse(spark):
    text = "start " + "one two three " * 9 + "end"
    df = spark.createDataFrame([(1, text), (2, "plain words"), (3, None), (4, "ha " * 40)], "doc_id long, text string")
    assert {r["doc_id"]: r["collapsed"] for r in periods.collapse(df).collect()} == {1: "start one two three end", 2: "plain words", 3: "", 4: "ha"}
    assert [tuple(r) for r in periods.find(df).orderBy("doc_id").collect()] == [(1, 1, 27, 3), (4, 0, 40, 1)]


def test_words_are_written_in_parts(monkeypatch):
    monkeypatch.setattr(common, "SLICE", 3)
    data = "  a bb\tccc\n dd é ".encode()
    starts, stops = common.word_limits(data, 4)
    assert [data[a:b] for a, b in zip(starts, stops)] == data.split()
    assert b"".join(common.written(data, np.array([4, 0, 1, 3, 2]))) == "é a bb dd ccc".encode()
    assert b"".join(common.written(data, None)) == b" ".join(data.split())


# ---- manifests

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 20}", "en", i, f"Text {i}") for i in range(1200)]
    rows += [(None, None, None, None, None), (5, "big", "en", 1, None), (7, None, "x", 2, "A"), (7, None, "x", 2, "A"), (9, "", "", 0, ""), (10, "é", "", 0, "ÄB")]
    docs = spark.createDataFrame(rows, FIELDS).withColumn("digest", F.lit(1)).withColumn("g", F.lit("x")).repartition(7)
    got = sorted((tuple(r) for r in manifest.report(docs).collect()), key=str)
    assert got == plain_manifest(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    got = manifest.report(spark.createDataFrame(rows, FIELDS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)


def test_proofs_fold_to_the_root(spark):
    rows = [(i, f"s{i % 18}", "en", 1, f"T{i}") for i in range(600)]
    for r in manifest.versions(spark.createDataFrame(rows, FIELDS)).collect():
        assert manifest.folded(r["leaf"], r["lefts"], r["rights"]) == r["root"] == r["version_root"]


def test_every_root_is_recomputed(spark, monkeypatch):
    """A sibling damaged on its way down shows in every row below it, tampered with or not: no row's root is taken over."""
    plain = manifest.descend

    def damaged(steps, above, label):
        out = plain(steps, above, label)
        return out.withColumn("rights", F.transform("rights", lambda x: F.concat(x, F.lit("0"))))

    monkeypatch.setattr(manifest, "descend", damaged)
    rows = [(i, f"s{i % 3}", "en", 1, f"T{i}") for i in range(600)]
    got = manifest.report(spark.createDataFrame(rows, FIELDS)).collect()
    assert len(got) == 600 and not [r["doc_id"] for r in got if r["verified"] or r["folded_root"] == r["root"]]


def test_versions_share_nodes():
    """A change copies the nodes on one path; every other node is the same object in both versions."""
    tree = manifest.built([hashlib.sha256(bytes([i])).hexdigest() for i in range(200)], 2)
    new = tree.version(manifest.way_to(37, 2), "x")
    assert new.digest != tree.digest and tree.children[2].children[5].digest != "x" and new.children[2].children[5].digest == "x"
    assert all(a is b for i, (a, b) in enumerate(zip(tree.children, new.children)) if i != 2)
    assert all(a is b for i, (a, b) in enumerate(zip(tree.children[2].children, new.children[2].children)) if i != 5)


# ---- mixes

MIX = "doc_id long, source string, text string"


def mixed_rows(seed, sources=5, docs=300):
    r = random.Random(seed)
    rows = [(i, r.choice([None, "", "é", *(f"s{j}" for j in range(sources))]), " w" * r.choice([0, 1, 3, 20, 100, 400, 2000])) for i in range(docs)]
    return rows + [(None, "s1", None), (None, "s1", "a b"), (3, "s1", "same size"), (3, "s1", "same text"), (3, "s1", "same text")]


def test_targets(spark):
    for weights, share, most in (((3, 1, 2), 1.5, 2), ((1,), 0.3, 2), ((1, 100), 1.9, 2), ((5, 1, 1, 9), 2, 2)):
        rows = mixed_rows(4)
        own = mixing.targets(mixing.sizes_of(spark.createDataFrame(rows, MIX), "doc_id", "source", "text"), weights, share, most)
        got = {r["g"]: (r["source_size"], r["target"]) for r in own.collect()}
        want = plain_targets([(s, len(words(t))) for _, s, t in rows], weights, Fraction(share), most)
        assert len(got) == len(want)
        for s, (size, target) in want.items():
            assert got["~" if s is None else f":{s}"] == (size, pytest.approx(float(target)))


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)  # several rounds of flights
    rows = mixed_rows(1, docs=900)
    docs = spark.createDataFrame(rows, MIX).withColumn("size", F.lit("x")).withColumn("g", F.lit(1))
    got = [sorted(map(tuple, mixing.report(d).collect()), key=str) for d in (docs, docs.repartition(7))]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    want = plain_targets([(s, len(words(t))) for _, s, t in rows], (3, 1, 2), Fraction(3, 2), 2)
    by_id = {}
    for k, s, t in rows:
        by_id.setdefault((k, len(words(t))), []).append(s)
    taken = dict.fromkeys(want, 0)
    for k, size, source_size, target, took in got[0]:
        s = next(s for s in by_id[k, size] if want[s][0] == source_size)
        assert target == pytest.approx(float(want[s][1])) and took % max(size, 1) == 0 and took <= 2 * size
        low = int(target / source_size + 1e-9) if source_size else 0
        assert took in (low * size, (low + 1) * size)
        taken[s] += took
    for s, (_, target) in want.items():
        assert abs(taken[s] - target) <= max(20, 1e-3 * target), s


def test_flights_keep_sums():
    r = random.Random(5)
    for _ in range(200):
        n = r.randint(0, 40)
        sizes = [float(r.choice([0, 1, 1, 5, 80, r.randint(1, 10000)])) for _ in range(n)]
        rest = [r.choice([0.5, r.random() * 0.98 + 0.01]) for _ in range(n)]
        before = sum(rest), sum(s * x for s, x in zip(sizes, rest))
        mixing.flight(sizes, rest, iter(r.random, None))
        assert sum(0 < x < 1 for x in rest) <= 2 and all(0 <= x <= 1 for x in rest)
        assert sum(rest) == pytest.approx(before[0], abs=1e-6) and sum(s * x for s, x in zip(sizes, rest)) == pytest.approx(before[1], rel=1e-6, abs=1e-3)


def test_flights_keep_probabilities():
    """Over many draws each row is taken as often as its probability says."""
    r, sizes, rest = random.Random(6), [3.0, 5.0, 5.0, 9.0, 20.0, 1.0, 7.0], [0.2, 0.5, 0.7, 0.4, 0.9, 0.3, 0.6]
    total = np.zeros(7)
    for _ in range(4000):
        own = list(rest)
        mixing.flight(sizes, own, iter(r.random, None))
        total += own
    assert np.abs(total / 4000 - rest).max() < 0.03


def test_landing_is_the_best_rounding():
    r = random.Random(7)
    for _ in range(50):
        k = r.randint(0, 8)
        s, p = np.array([float(r.randint(0, 99)) for _ in range(k)]), np.array([r.random() for _ in range(k)])
        got = mixing.land(s, p, 0.0)
        best = min((abs(np.dot(x, s) - np.dot(p, s)) for x in itertools.product((0, 1), repeat=k)), default=0)
        assert abs(np.dot(got, s) - np.dot(p, s)) == pytest.approx(best, abs=1e-6)


def test_alike_rows_and_the_mix_itself(spark, monkeypatch):
    """A third of the rows alike: counted first, and dealt out in parts."""
    monkeypatch.setattr(mixing, "COPIES", 50)
    rows = [(1, "a", "x y z")] * 400 + [(i, "abc"[i % 3], "w " * (i % 37)) for i in range(2, 800)]
    docs = spark.createDataFrame(rows, MIX)
    got = mixing.report(docs).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 1 for r in got) == 400
    per = {}
    for r in got:
        per[r["doc_id"], r["size"]] = per.get((r["doc_id"], r["size"]), 0) + r["taken"]
    whole = {}
    for r in mixing.mixed(docs).collect():
        n = len(words(r["text"]))
        whole[r["doc_id"], n] = whole.get((r["doc_id"], n), 0) + n
    assert {k: v for k, v in per.items() if v} == {k: v for k, v in whole.items() if v}


def test_empty_mix(empty):
    assert mixing.report(empty).collect() == [] and mixing.mixed(empty).collect() == []
