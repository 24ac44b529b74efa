"""Transforms and streams in the forms that large histories need, against the plain ones."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silt.functions.patterns import glob_to_regex, is_plain, literal_prefix
from silt.operators import transforms
from silt.operators.transforms import filter_paths, group_layers, in_folders, layer, map_teams, temporal_windows
from silt.registry import lookup
from silt.schema import FACT
from silt.streaming import history as streams


def history(spark, seed, n=600, entities=12, days=40, authors=6):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        e = "/".join(["src", r.choice("abc"), f"f{r.randrange(entities)}"][: r.randint(1, 3)])
        rows.append((e, f"r{r.randrange(n // 4)}", f"2024-{1 + r.randrange(days) // 28:02d}-{1 + r.randrange(28):02d}", f"p{r.randrange(authors)}", "-", r.randrange(9), r.randrange(9), False, True, i))
    return spark.createDataFrame(rows, FACT)


# ---- filters

GLOBS = ["src/a/*", "src/**", "**/f1", "s?c/a/f1", "src/{a,b}/f2", "src/a/f3", "src/[ab]/*", "src/a\\/f4", "{src,lib}/**", "src/a**", "", "src"]


def test_starts_of_globs():
    assert [literal_prefix(g) for g in GLOBS] == ["src/a/", "src", "", "s", "src/", "src/a/f3", "src/", "src/a", "", "src/a", "", "src"]
    paths = ["src", "src/a", "src/a/f1", "src/b/f2", "src/a/f3", "src/a/f4", "lib/x", "src/abc"]
    for g in GLOBS:
        if g:
            pattern = re.compile(glob_to_regex(g).replace(r"\z", r"\Z"))
            assert all(p.startswith(literal_prefix(g)) for p in paths if pattern.match(p)), g


@pytest.mark.parametrize("include", [["src/a/*"], ["src/a/**", "src/b/f?"], ["src/a/f1", "src/a/**"], ["**/f1", "src/a/*"], []])
def test_filters_keep_what_the_expressions_keep(spark, include):
    facts = history(spark, 1)
    want = [r for r in facts.collect() if not include or any(re.match(glob_to_regex(g).replace(r"\z", r"\Z"), r["entity"]) for g in include)]
    assert sorted(filter_paths(facts, include).collect()) == sorted(want)


def test_starts_reach_the_scan(spark, tmp_path):
    """In a sorted table the condition leaves out row groups."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    facts = spark.range(200_000).select(F.concat(F.lit("src/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("entity"), F.col("id").alias("rev"))
    facts.coalesce(1).sortWithinPartitions("entity").write.option("parquet.block.size", 65536).option("parquet.page.size", 8192).parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = filter_paths(spark.read.parquet(str(tmp_path / "t")), ["src/0000*"])
        assert out.count() == 100 and "StringStartsWith(entity,src/0000)" in out._jdf.queryExecution().executedPlan().toString()
        out.collect()
        plan = out._jdf.queryExecution().executedPlan()
        assert plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value() < 50_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


# ---- layers


def test_many_rules_are_looked_up(spark, monkeypatch):
    facts = history(spark, 2).withColumns({"folder2": F.lit(1), "rule1": F.lit(2)})
    rules = [layer("src/b", "B"), layer("^src/a/f1$", "one"), layer("src/a", "A"), layer("src/b", "later"), layer("src", "rest"), layer("lib", "L"), layer("^s", "any")]
    few = sorted(map(str, group_layers(facts, rules).collect()))
    monkeypatch.setattr(transforms, "FEW_RULES", 2)
    many = group_layers(facts, rules)
    assert many.columns == facts.columns and sorted(map(str, many.collect())) == few
    for some in (rules[:1] + rules[3:4] + rules[4:5] + rules[5:6], rules[2:3]):
        monkeypatch.setattr(transforms, "FEW_RULES", 100)
        want = sorted(map(str, group_layers(facts, some).collect()))
        monkeypatch.setattr(transforms, "FEW_RULES", 0)
        assert sorted(map(str, group_layers(facts, some).collect())) == want


def test_ten_thousand_rules(spark):
    facts = spark.range(5000).select(F.concat(F.lit("d"), F.col("id") % 10_000, F.lit("/x/f")).alias("entity"))
    rules = [layer(f"d{i}", f"n{i % 7}") for i in range(10_000)]
    out = group_layers(facts, rules)
    assert out.groupBy("entity").count().count() == 7 and out.count() == 5000
    assert out._jdf.queryExecution().executedPlan().toString().count("RLIKE") == 0
    assert in_folders(facts, spark.createDataFrame([], transforms.RULES)).count() == 0


def test_plain_patterns():
    assert is_plain("src/core") and not any(is_plain(p) for p in ("src/a.b", "^src", "src/[ab]", "a|b", "a\\b", "x*", "(a)"))


# ---- windows and teams


@pytest.mark.parametrize("days", [1, 2, 5, 400])
def test_dense_windows(spark, days):
    facts = history(spark, 3, entities=2, days=50).unionByName(history(spark, 4, n=5).withColumn("entity", F.lit(None).cast("string")).withColumn("ord", F.col("ord") + 10_000))
    plain, dense = (sorted(map(str, temporal_windows(facts, days, dense=d).collect())) for d in (False, True))
    assert plain == dense and bool(plain) == (days < 400)  # no window that is longer than the history


def test_a_layer_is_a_row_a_day_before_it_is_sorted(spark):
    """One layer of very many records: the window reads one row for each of its days."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    facts = spark.range(20_000).select(F.lit("layer").alias("entity"), F.col("id").cast("string").alias("rev"), F.date_format(F.date_add(F.lit("2024-01-01"), (F.col("id") % 30).cast("int")), "yyyy-MM-dd").alias("date"), F.lit("p").alias("author"), F.lit("-").alias("message"), F.lit(1).cast("long").alias("loc_added"), F.lit(1).cast("long").alias("loc_deleted"), F.lit(False).alias("binary"), F.lit(True).alias("has_loc"), F.col("id").alias("ord"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = temporal_windows(facts, 3, dense=True)
        assert out.count() == 28
        out.collect()
        plan = out._jdf.queryExecution().executedPlan()
        found, left = [], [plan]
        while left:
            node = left.pop()
            if node.nodeName() == "Exchange":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            children = node.children()
            left += [children.apply(i) for i in range(children.size())]
        assert found and max(found) <= 30 * 16, found  # a row for each day and task, not for each record
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_teams_of_any_number(spark, monkeypatch):
    facts = history(spark, 5)
    teams = {f"p{i}": f"t{i % 2}" for i in range(4)}
    want = sorted(map(str, map_teams(facts, teams).collect()))
    monkeypatch.setattr(transforms, "TEAM_BROADCAST", 1)
    assert sorted(map(str, map_teams(facts, teams).collect())) == want
    twice = spark.createDataFrame([*teams.items(), ("p1", "t0"), ("p1", "t1")], "author string, team string")
    assert sorted(map(str, map_teams(facts, twice).collect())) == want


# ---- streams


def written(facts, path, files, seed):
    """The rows in files, in an order of their own, some twice."""
    r = random.Random(seed)
    rows = [tuple(x) for x in facts.collect()]
    r.shuffle(rows)
    for i in range(files):
        facts.sparkSession.createDataFrame(rows[i::files], FACT).coalesce(1).write.mode("append").parquet(path)


def run_stream(df, mode, tmp_path):
    out = str(tmp_path / f"out-{mode}")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"state-{mode}")).trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").start(out).awaitTermination()
    else:
        w.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def test_distinct_counts_on_streams(spark, tmp_path):
    facts = history(spark, 6, n=200)
    written(facts, str(tmp_path / "in"), 4, 1)
    facts.limit(20).write.mode("append").parquet(str(tmp_path / "in"))  # these come twice
    got = run_stream(streams.authors(streams.read_facts(spark, str(tmp_path / "in"), 1)), "complete", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in lookup("authors").run(facts).collect())


def test_pairs_on_streams(spark, tmp_path):
    """Commits outgrow the limit in later files: their pairs are taken back."""
    facts = history(spark, 7, n=160)
    written(facts, str(tmp_path / "in"), 5, 2)
    changes = run_stream(streams.pair_changes(streams.read_facts(spark, str(tmp_path / "in"), 1), 3), "append", tmp_path)
    assert changes.where("change < 0").count() > 0
    low = {"min_revs": 1, "min_shared_revs": 1, "min_coupling": 1, "max_coupling": 100}
    want = lookup("coupling").run(facts, **low, max_changeset_size=3, verbose=True)
    assert sorted(map(tuple, streams.coupled(changes, **low).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    """And the newest rows are the whole table."""
    facts = history(spark, 8, n=400)
    written(facts, str(tmp_path / "in"), 8, 3)
    out = str(tmp_path / "out")
    sums = streams.ownership(streams.read_facts(spark, str(tmp_path / "in"), 1))
    with streams.state_on_disk(spark):
        q = sums.writeStream.outputMode("update").foreachBatch(streams.keep_batch(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.select("batch").distinct().count() == 8 and stored.count() <= 400
    want = lookup("entity-ownership").run(facts)
    assert sorted(map(tuple, streams.newest(stored, "entity", "author").collect())) == sorted(map(tuple, want.collect()))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


@pytest.mark.parametrize("buckets", [1, 3])
def test_commits_share_entries_of_state(spark, tmp_path, buckets):
    facts = history(spark, 9, n=160)
    written(facts, str(tmp_path / "in"), 5, 2)
    changes = streams.pair_changes(streams.read_facts(spark, str(tmp_path / "in"), 1), 3, buckets)
    w = changes.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    w.awaitTermination()
    assert w.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= buckets
    low = {"min_revs": 1, "min_shared_revs": 1, "min_coupling": 1, "max_coupling": 100}
    want = lookup("coupling").run(facts, **low, max_changeset_size=3, verbose=True)
    got = streams.coupled(spark.read.schema(changes.schema).parquet(str(tmp_path / "out")), **low)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["stream_authors", "stream_coupling", "stream_ownership"])
def test_batches_do_not_grow_with_files(spark, monkeypatch, name):
    from silt import queries

    seen, kept = [], streams.read_facts
    monkeypatch.setattr(queries, "FILE_ROWS", 300)  # 6,000 lines: 20 files
    monkeypatch.setattr(streams, "read_facts", lambda s, path, n: seen.append((len(list(s.read.parquet(path).inputFiles())), n)) or kept(s, path, n))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 1 and seen[0][0] >= 20 and -(-seen[0][0] // seen[0][1]) <= 4


# ---- people


def shuffled(df):
    """Rows written by each shuffle of a query that has run."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return found


def test_pairs_of_people_are_counted_where_they_lie(spark):
    """20 entities of 100 people: 99,000 pairs and 198,000 rows come from shuffles of 2,000 records and lists."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    facts = spark.createDataFrame([(f"e{i}", "r", "2024-01-01", f"p{i:02}-{j:02}", "-", 1, 1, False, True, i * 100 + j) for i in range(20) for j in range(100)], FACT)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = lookup("communication").table(facts)
        assert len(out.collect()) == 198_000
        assert max(shuffled(out)) <= 2000, shuffled(out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def bytes_shuffled(df):
    """Bytes written by all shuffles of a query that has run."""
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        found += node.metrics().apply("shuffleBytesWritten").value() if node.nodeName() == "Exchange" else 0
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return found


def test_pairs_of_people_are_shuffled_in_few_bytes(spark):
    """2,000 entities of 40 people: 3.1 million rows come from 1.56 million pairs, for each of which all shuffles together write fewer than 8 bytes."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    entity, who = F.concat(F.lit("src/e"), F.col("id") % 2000), F.format_string("Customer#%09d", F.pmod(F.xxhash64("id"), F.lit(20_000)))
    facts = spark.range(80_000).select(entity.alias("entity"), who.alias("author"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = lookup("communication").table(facts)
        assert sum(r["shared"] for r in out.collect()) > 3_000_000
        assert 0 < bytes_shuffled(out) < 8 * 1_560_000, bytes_shuffled(out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


@pytest.mark.parametrize("names", [["aé", "bcd", "xyz"], ["aé", "", "b\u00e9c", "x\0"], ["", ""]])
def test_lists_of_people_unpack_as_packed(names):
    from silt.operators import peers

    x = peers.Lists(np.array([len(names)]), np.arange(len(names), dtype=np.uint8), np.ones(len(names), np.uint8), np.arange(len(names), dtype=np.int64) << 40, pa.array(names, pa.large_string()))
    y = peers.unpack(*peers.pack(x))
    assert [list(a) for a in y[:4]] == [list(a) for a in x[:4]] and y.names.to_pylist() == names


def lists_of_people(r, n):
    """Lists of people by name, some of two slices, as ``peers.pairs_of`` takes them, and how many hold each pair."""
    rows, want = [], {}
    n_of = {f"p{k}é" if k else "": r.randint(1, 9) for k in range(40)}
    for _ in range(n):
        i, j = r.choice([(0, 0), (1, 1), (0, 2)])
        people = [{"author": a, "n": n_of[a], "slice": r.choice([i, j]), "h": zlib.crc32(a.encode()) * 2**31 - 2**61} for a in sorted(r.sample(sorted(n_of), r.randint(1, 20)))]
        rows.append({"i": i, "j": j, "people": people})
        for k, x in enumerate(people):
            for y in people[k + 1 :]:
                if x["n"] <= 5 and (i == j or x["slice"] != y["slice"]):
                    key = (x["author"], x["n"], y["author"], y["n"])
                    want[key] = want.get(key, 0) + 1
    return rows, want


@pytest.mark.parametrize("parts", [1, 3, 100])
@pytest.mark.parametrize("turns", [1, 4])
def test_packed_lists_of_people(monkeypatch, parts, turns):
    """Each pair is counted once whole, in one part and turn, however lists are cut and dealt."""
    from silt.operators import peers

    monkeypatch.setattr(peers, "ENTRIES", 50)
    rows, want = lists_of_people(random.Random(parts), 60)
    kind = pa.struct([("author", pa.string()), ("n", pa.int64()), ("slice", pa.int32()), ("h", pa.int64())])
    batch = pa.record_batch([pa.array([x["i"] for x in rows], pa.int32()), pa.array([x["j"] for x in rows], pa.int32()), pa.array([x["people"] for x in rows], pa.list_(kind))], ["i", "j", "people"])
    dealt = {}
    for b in [b for half in (batch.slice(0, 25), batch.slice(25)) for b in peers._packed(half, parts, 5)]:
        for r in b.to_pylist():
            dealt.setdefault(r.pop("part"), []).append(tuple(r.values()))
    got = [tuple(r.values()) for found in dealt.values() for turn in range(turns) for b in peers._pairs(found, turn, turns) for r in b.to_pylist()]
    assert len(got) == len(want) and {x[:4]: x[4] for x in got} == want and set(dealt) <= set(range(parts))


@pytest.mark.parametrize("hot", [0, 3, 10_000])
@pytest.mark.parametrize("slice_", [2, 1024])
def test_hot_people_and_others(spark, monkeypatch, hot, slice_):
    from silt.operators import network

    facts = history(spark, 10, n=120, authors=9)
    facts = facts.unionByName(facts.limit(9).withColumn("entity", F.lit(None).cast("string"))).unionByName(facts.limit(9).withColumn("author", F.lit(None).cast("string")))
    own = {(r["entity"], r["author"]) for r in facts.collect() if r["author"]}
    people = {a for _, a in own}
    n = {a: sum(x == a for _, x in own) for a in people}
    shared = {(a, b): len({e for e, x in own if x == a and e} & {e for e, x in own if x == b and e}) for a in people for b in people if a != b}
    monkeypatch.setattr(network, "HOT", hot)
    monkeypatch.setattr(network, "SLICE", slice_)
    got = {(r["author"], r["peer"]): (r["shared"], r["average"]) for r in lookup("communication").run(facts).collect()}
    assert got == {(a, b): (k, -(-(n[a] + n[b]) // 2)) for (a, b), k in shared.items() if k}


# ---- change sets


def test_partitions_of_commits_follow_the_input(spark, monkeypatch, tmp_path):
    """One shuffle, by commit, of as many partitions as the input asks for."""
    from silt.operators import coupling

    history(spark, 11).write.parquet(str(tmp_path / "in"))
    facts = spark.read.parquet(str(tmp_path / "in"))
    want = sorted(map(str, coupling.change_sets(facts, 5).collect()))
    monkeypatch.setattr(coupling, "SETS_BYTES", 1 << 10)
    sets = coupling.change_sets(facts, 5)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and sets.rdd.getNumPartitions() > 4
    assert sorted(map(str, sets.collect())) == want


def test_pairs_are_shuffled_once(spark, tmp_path):
    """Pairs are counted and joined with nothing: their names are exchanged only where they are grouped."""
    from silt.operators import coupling

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = history(spark, 12)
        out = coupling.candidates(facts, 5)
        pairs = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(a#" in x or "Exchange hashpartitioning(b#" in x]
        assert len(pairs) == 1
        columns = ["a", "b", "shared", *coupling.REVS, "avg", "degree_f"]
        want = coupling.numbers(coupling.pair_counts(coupling.change_sets(facts, 5)))
        assert sorted(map(str, out.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_the_joins_of_a_history_follow_the_input(spark, monkeypatch):
    """Lines and orders are dealt by the size of the lines where that asks for more partitions than the session's."""
    from silt.sources import adapters

    plain = adapters.order_history(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(adapters, "JOINED", 1 << 12)
    dealt = adapters.order_history(spark, "/root/testdata/sf0.001")
    many = dealt._jdf.queryExecution().executedPlan().toString()
    assert many.count("REPARTITION_BY_NUM") == 2 and "REPARTITION_BY_NUM" not in plain._jdf.queryExecution().executedPlan().toString()
    assert dealt.rdd.getNumPartitions() > 4
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
