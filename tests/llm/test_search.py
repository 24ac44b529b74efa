"""Near duplicates, repeated passages, benchmark passages and fingerprints, against brute force."""

import hashlib
import pickle
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from silt.llm import common, decontaminate, parsing, repeats, simhash
from silt.llm.components import components
from silt.llm.common import CHUNK, chunks

from brute import holds, near_groups, parsed_print, shared, simple_print, words


def test_chunks_keep_words():
    data = b"  " + b"word\x0bof text\n" * 50 + b"z" * 300 + b" end"
    for size in (1, 7, 64, 299, 10**6):
        assert [w for c in chunks(data, size) for w in c.split()] == data.split()


def test_simhash(docs, pairs):
    prints, find, least = near_groups(pairs)
    expected = Counter((k, f"{prints[t]:016x}", least.get(find(prints[t]))) for k, t in pairs)
    assert Counter(tuple(r) for r in simhash.report(docs).collect()) == expected
    kept = {r["doc_id"] for r in simhash.dedupe(docs).collect()}
    assert kept == {k for k, t in pairs if k == least.get(find(prints[t]))}
    assert simhash.dedupe(docs).columns == docs.columns


def test_simhash_long_text_in_chunks(prose):
    t = prose(1, 400_000)
    assert len(t) > 2 * CHUNK // 2 and simhash.fingerprint(t) == _fast_print(t)


def _fast_print(t):
    w = words(t, True)
    h = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)], np.uint64)
    bits = [int((((h >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(h)) for b in range(64)]
    return sum(b << i for i, b in enumerate(bits))


def test_simhash_tight_and_loose_groups(spark):
    """Links through dense balls of fingerprints and random ones; slices of a bucket included."""
    rng = np.random.default_rng(0)
    center = int(rng.integers(0, 2**63))
    ball = {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))}
    chain = [0]
    for i in range(12):
        chain.append(chain[-1] ^ (0b111 << (5 * i)))
    fps = np.array(sorted(ball | set(chain) | set(rng.integers(0, 2**63, 400).tolist())), np.uint64)
    old, simhash.BUCKET = simhash.BUCKET, 50
    try:
        df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
        tree = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    finally:
        simhash.BUCKET = old
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    a, b = np.nonzero(np.triu(near, 1))
    roots = simhash.roots(len(fps), a, b)
    own = [tree.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len({(o, int(r)) for o, r in zip(own, roots)}) == len(set(own)) == len(set(roots.tolist()))


def test_pivots_lose_nothing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 200):
        fp = rng.integers(0, 2**64, n, np.uint64)
        if n > 10:
            fp[1::2] = fp[::2] ^ (np.uint64(1) << rng.integers(0, 64, n // 2).astype(np.uint64))
        a, b = simhash.bucket_edges(fp, simhash.pivot_table(fp))
        x, y = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1)) if n else ([], [])
        assert np.array_equal(simhash.roots(n, a, b), simhash.roots(n, np.array(x, int), np.array(y, int)))
    for n in (10, 10**7, 10**12):
        masks = simhash.block_masks(n)
        for _ in range(50):
            flip = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(not flip & m for m in masks)


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (3, 2), (None, 4)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert components(df.limit(0)).count() == 0


def test_repeats(docs, pairs):
    first = {}
    for k, t in sorted((p for p in pairs if p[0] is not None), key=lambda p: p[0]):
        w = words(t)
        for i in range(len(w) - 49):
            first.setdefault(b" ".join(w[i : i + 50]), k)
    expected = Counter()
    for k, t in pairs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if k is not None and first[b" ".join(w[i : i + 50])] < k:
                gone[i : i + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        expected[k, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    assert Counter(tuple(r) for r in repeats.report(docs).collect()) == expected
    assert sum(n for (_, _, n, _), c in expected.items() for _ in range(c)) > 500
    assert repeats.without_repeats(docs).where("doc_id = 100").first()["text"] == ""


def test_repeats_of_one_word(spark):
    """Periodic texts: every window is like its neighbour."""
    df = spark.createDataFrame([(2, "la " * 500), (1, "la " * 60), (3, "la " * 49 + "di " * 80), (4, "di " * 51)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in repeats.report(df).collect()}
    assert got == {1: 0, 2: 500, 3: 0, 4: 51}


def test_contained(spark, docs, pairs, prose):
    base = dict((k, t) for k, t in pairs if k is not None)
    part = " ".join(base[9].split()[20:45])
    changed = part.split()
    changed[12] = "other"
    items = spark.createDataFrame(
        [(1, part.upper()), (2, " ".join(changed)), (3, "zq xq vq"), (4, None), (5, ""), (6, "One"), (7, part), (7, part), (None, part), (8, " ".join(base[9].split()[:10] + ["nope"] * 20))],
        "item_id long, text string",
    )
    expected = Counter()
    for ik, it in [tuple(r) for r in items.collect()]:
        w = words(it, True)
        if w:
            k = min(5, len(w))
            own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
            for dk, dt in pairs:
                v = words(dt, True)
                n = len(own & {tuple(v[i : i + k]) for i in range(len(v) - k + 1)})
                if n * 5 >= len(own) * 4:
                    expected[dk, ik, len(own), n, n / len(own)] += 1
    assert Counter(tuple(r) for r in decontaminate.contained(docs, items).collect()) == expected and len(expected) >= 3
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and Counter(r["doc_id"] for r in clean.collect()) == Counter(k for k, _ in pairs if k not in {e[0] for e in expected})
    old, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 100
    try:
        assert Counter(tuple(r) for r in decontaminate.contained(docs, items).collect()) == expected
        assert Counter(map(str, decontaminate.drop_contaminated(docs, items).collect())) == Counter(map(str, clean.collect()))
        seen = []
        for index, last in decontaminate.indexes(items, "item_id", "text"):
            seen += index.value.keys
            assert last == (len(seen) == sum(bool(words(r["text"], True)) for r in items.collect()))
    finally:
        decontaminate.BLOCK_BYTES = old
    assert decontaminate.contained(docs, items.limit(0)).count() == 0 and decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(pairs)


def test_an_index_is_bounded_by_its_text(prose):
    """Pickled, as it is broadcast: at most four times the items' text, for long items and for short ones."""
    for size in (40, 400):
        texts = [prose(i, size) for i in range(60_000 // size)]
        index = decontaminate.ItemIndex(list(enumerate(texts)))
        assert len(pickle.dumps(index, protocol=5)) <= 4 * sum(len(t.encode()) + 16 for t in texts)
        assert all((i, *holds(t, t)) in list(index.held("before " + t + " after")) for i, t in enumerate(texts[:20]))


def test_ranges_don_t_grow_the_plan(spark):
    """Limits are data, not literals; and there are no more ranges than MAX_PARTITIONS."""
    keys = spark.range(40_000).select((F.col("id") * 3 % 40_000).alias("key"))
    limits, top = parsing.range_limits(keys, 2_000)
    assert top == 39_999 and 1_500 < len(limits) < 2_000 and limits == sorted(limits)
    sizes = np.diff([0, *limits, 40_000])
    assert sizes.max() < 40_000 / 2_000 * 4
    assert common.MAX_PARTITIONS <= 20_000


def test_neighbours_over_many_ranges(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(i * 7 % 500, f"text {i * 7 % 500} " * 3) for i in range(500)] + [(None, "null key"), (499, "another")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = Counter(map(tuple, parsing.report(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        assert Counter(map(tuple, parsing.report(df).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_fingerprints(docs, pairs):
    """Against a parser that goes symbol by symbol; the longest text is left to ``test_equal_parts_share_names``."""
    docs, pairs = docs.where("text IS NULL OR length(text) < 20000"), [p for p in pairs if len(p[1] or "") < 20000]
    order = sorted(pairs, key=lambda p: (p[0] is None, -(p[0] or 0), p[1] is not None, p[1] or ""))
    prints = {}
    own = lambda t: prints.setdefault(t, parsed_print(t))
    hexed = lambda f: "".join(f"{0xFFFF if x is None else x:04x}" for x in f)
    expected = Counter()
    for i, (k, t) in enumerate(order):
        t, u = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        expected[k, len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(own(t)), hexed(own(e)), round(shared(own(t), own(e)), 9), round(shared(own(t), own(u)), 9)] += 1
    got = Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in parsing.report(docs).collect())
    assert got == expected


def test_equal_parts_share_names(prose):
    """Wherever a passage stands, its inner phrases have the same names, at all levels."""
    t = prose(5, 800)

    def names(text, level):
        x, first = np.array([ord(c) for c in text], np.uint32), np.zeros(len(text), bool)
        first[0] = True
        for _ in range(level):
            x, first = parsing._phrases(x, first)
        return set(x.tolist())

    for level in (1, 2, 3):
        own = names(t, level)
        for shift in (1, 2, 3, 17, 400):
            moved = names("Z" * 3 + prose(shift, 30)[:shift] + t, level)
            assert len(own & moved) > 0.9 * len(own) - 3
    a = parsing.fingerprints_of([t, t[: len(t) // 2] + prose(6, 400), prose(7, 800), ""])
    like = [float(parsing.likeness(a[:1], a[i : i + 1])[0]) for i in range(4)]
    assert like[0] == 1 and 0.3 < like[1] < 0.8 and like[2] < 0.2 and like[3] == 0 and float(parsing.likeness(a[3:], a[3:])[0]) == 1


def test_edited():
    assert parsing.edited("abcd", "xyz") == "abxy" and parsing.edited("abcde", "x") == "abcx" and parsing.edited("a", "x") == "a" and parsing.edited("", "x") == ""


@pytest.mark.parametrize("run", [simhash.report, repeats.report, parsing.report, simhash.dedupe, repeats.without_repeats])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_single_document(spark):
    df = spark.createDataFrame([(5, "some words here " * 10)], "doc_id long, text string")
    r = parsing.report(df).first()
    assert r["near_next"] == 1.0 and simhash.report(df).first()["component_id"] == 5 and repeats.report(df).first()["n_removed"] == 0


