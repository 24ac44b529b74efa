"""Renames, results that tasks write, and the lattice of counts."""

import io
import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silt import cli
from silt.operators import renames as R
from silt.operators import second as S
from silt.errors import SiltError
from silt.plans.batch import counted, lattice
from silt.plans.encoding import encode
from silt.sources.emitted import json_lines
from silt.sources.results import Range, packed
from silt.sources.gitlog import numbered, parse_lines, parsed, read_lines, read_log
from silt.plans.charts import CHANNELS, chart_spec
from silt.plans.result import emit, run, store
from silt.registry import lookup
from silt.schema import FACT
from silt.sources.emitted import columns_of, read_result, register
from silt.sources.gitlog import parse_lines
from silt.sources.results import read_envelope

from history import LOG


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(list(parse_lines(LOG.splitlines())), FACT).cache()


# ---- renames


def followed(facts, renames):
    """Each record's path and last name, one rename after the other."""
    renames = sorted(set(renames), key=lambda e: e[2])
    out = []
    for name, rev, at in facts:
        last, limit = name, at
        while last is not None and at is not None:
            e = next((e for e in renames if e[0] == last and e[2] >= limit), None)
            if e is None:
                break
            last, limit = e[1], e[2] + 1
        out.append((last, rev, at, name))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, n, names", [(1, 40, 5), (2, 250, 15), (3, 3, 2)])
def test_renames(spark, seed, n, names):
    r = random.Random(seed)
    renames = [(f"n{r.randrange(names)}", f"n{r.randrange(names)}", at) for at in r.sample(range(600), n)]
    records = [(f"n{r.randrange(names)}", f"r{i}", r.randrange(600)) for i in range(400)] + [(None, "x", 3), ("n1", "y", None)]
    f = spark.createDataFrame(records, "entity string, rev string, ord long").withColumns({"name": F.lit(1), "next": F.lit(2), "place": F.lit(3)}).repartition(5)
    e = spark.createDataFrame(renames + renames[:2], "old string, new string, at long").repartition(3)
    out = R.renamed(f, e)
    assert out.columns == [*f.columns, "path"]
    rows = out.collect()
    assert sorted(((x["entity"], x["rev"], x["ord"], x["path"]) for x in rows), key=str) == followed(records, renames)
    assert all((x["name"], x["next"], x["place"]) == (1, 2, 3) for x in rows)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_ROUNDS", 11)  # 2 ** 10 > 1000
    e = spark.createDataFrame([(f"c{i}", f"c{i + 1}", i) for i in range(1000)], "old string, new string, at long")
    f = spark.createDataFrame([("c0", "a", 0), ("c500", "b", 500), ("c500", "c", 501)], "entity string, rev string, ord long")
    assert sorted((x["rev"], x["entity"]) for x in R.renamed(f, e).collect()) == [("a", "c1000"), ("b", "c1000"), ("c", "c500")]


def test_versions_and_empty_tables(spark, facts):
    none = spark.createDataFrame([], "old string, new string, at long")
    assert sorted(map(tuple, R.renamed(facts, none).select("entity", "path", "rev").collect())) == sorted((r["entity"], r["entity"], r["rev"]) for r in facts.collect())
    assert R.renamed(facts.limit(0), none).collect() == []
    f = spark.createDataFrame([("old", "r1", "2024-01-01", 1), ("new", "r2", "2024-01-02", 5), ("old", "r3", "2024-01-03", 9)], "entity string, rev string, date string, ord long")
    e = spark.createDataFrame([("old", "new", 4)], "old string, new string, at long")
    assert [tuple(x) for x in R.versions(f, e, "new").collect()] == [("r1", "2024-01-01", 1, "old"), ("r2", "2024-01-02", 5, "new")]
    assert [tuple(x) for x in R.versions(f, e, "old").collect()] == [("r3", "2024-01-03", 9, "old")]


# ---- results that tasks write


def test_emitted_results(spark, facts, tmp_path):
    path = str(tmp_path / "r")
    emit("authors", facts, path, rows=2, fields="rows.entity,row_count,total_count")
    head = json.load(open(f"{path}/envelope.json"))
    assert (head["row_count"], head["total_count"], head["semantics"]) == (2, 5, {"entity": "filepath"})
    assert [tuple(r) for r in read_result(spark, path).collect()] == [("src/core/b.py",), ("src/ui/c.py",)]
    emit("fragmentation", facts, path)  # over the one before
    want = run("fragmentation", facts)
    head = json.load(open(f"{path}/envelope.json"))
    assert {k: v for k, v in head.items() if k != "rows_in"} == json.loads(json.dumps({k: v for k, v in want.envelope().items() if k != "rows"}))
    assert sorted(map(str, (r.asDict() for r in read_result(spark, path).collect()))) == sorted(map(str, want.rows))
    assert sorted(os.listdir(path)) == ["envelope.json", head["rows_in"]]
    emit("authors", facts.limit(0), path)
    assert read_result(spark, path).collect() == [] and read_result(spark, path).columns == ["entity", "n_authors", "n_revs"]


def test_a_failed_task_leaves_nothing(spark, facts, tmp_path):
    register(spark)
    path = str(tmp_path / "r")
    emit("revisions", facts, path)
    before = sorted(os.listdir(path))
    bad = facts.repartition(3).select("entity", F.when(F.col("entity") == "src/ui/c.py", F.raise_error(F.lit("broken"))).alias("x"))
    for mode, at in (("overwrite", path), ("append", str(tmp_path / "new"))):
        with pytest.raises(Exception, match="broken"):
            bad.write.format("siltresult").mode(mode).save(at)
    assert sorted(os.listdir(path)) == before and read_result(spark, path).count() == 5
    assert not os.path.exists(tmp_path / "new") or os.listdir(tmp_path / "new") == []
    with pytest.raises(Exception, match="holds a result already"):
        facts.select("entity").write.format("siltresult").mode("append").save(path)


def test_command_line_writes_results(spark, tmp_path):
    log, out, err = tmp_path / "f.log", io.StringIO(), io.StringIO()
    log.write_text(LOG)
    assert cli.main(["entity-effort", "--log", str(log), "--out", str(tmp_path / "r")], spark, None, out, err) == 0 and not out.getvalue()
    assert sorted(map(tuple, read_result(spark, str(tmp_path / "r")).collect())) == sorted(tuple(r) for r in lookup("entity-effort").run(spark.createDataFrame(list(parse_lines(LOG.splitlines())), FACT)).collect())
    assert cli.main(["authors", "--log", str(log), "--fields", "rows.nothing", "--out", str(tmp_path / "s")], spark, None, out, err) == 64


def test_columns_of_unknown_results():
    kinds = {f.name: f.dataType.simpleString() for f in columns_of({"analysis": "mine", "semantics": {"a": "filepath", "b": "count", "c": "ratio", "d": "flag", "e": "duration_months"}})}
    assert kinds == {"a": "string", "b": "bigint", "c": "double", "d": "boolean", "e": "bigint"}


def test_rows_are_encoded_by_columns():
    """As row by row, whatever they hold; only what has something to escape is looked at by itself."""
    rows = [{"a": a, "n\"<": n, "x": x, "b": b} for a, n, x, b in [("p", 1, 1.0, True), ('q"\\', None, 0.25, None), (None, -(1 << 63), None, False), ("<é&\u2028\u2029\n\x1f\x7f", 0, 1e22, True), (None, None, None, None), ("", 7, -0.5, False)]]
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("a", pa.string()), ("n\"<", pa.int64()), ("x", pa.float64()), ("b", pa.bool_())]))
    assert json_lines(batch).to_pylist() == [encode({k: v for k, v in r.items() if v is not None}) + "\n" for r in rows]
    assert json_lines(batch.slice(0, 0)).to_pylist() == []


def test_many_small_envelopes_are_few_tasks():
    ranges = [Range(f"f{i}", 1000 * k, 1000 * (k + 1)) for i in range(5000) for k in range(4)]
    tasks = packed(ranges, 64)
    assert 64 <= len(tasks) <= 65 and [r for t in tasks for r in t.ranges] == ranges
    assert len(packed([Range("f", 0, 64 << 20), Range("f", 64 << 20, 100 << 20)], 1)) == 2 and packed([], 64) == []


# ---- logs in blocks


def test_no_line_of_a_log_is_shuffled(spark, tmp_path):
    """Entries over many blocks, in two files, are as the plain parser has them; bytes that aren't UTF-8 pass."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    files = []
    for k in range(2):
        text = "".join(f"{' ' * (i % 3)}\n--{i:x}--2024-01-0{1 + i % 9}--A--{'x' * (i % 7)}\n" * (1 + (i % 4 == 0)) + "".join(f"{j}\t1\tf{k}/{j}\n--late\n"[: None if i % 50 == 49 else -7] for j in range(i % 6)) for i in range(48))
        files.append("\n" + "\n".join(x for x in text.split("\n") if not x.startswith("--late")) + "\n")
        (tmp_path / f"{k}.log").write_text(files[-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "70")
    try:
        rows = parsed(numbered(read_lines(spark, str(tmp_path))))
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        got = read_log(spark, str(tmp_path)).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r)[:9] for r in got] == [x[:9] for f in files for x in parse_lines(f.split("\n"))]
    (tmp_path / "latin.log").write_bytes("--a--2024-01-01--J\xe9r\xf4me\n1\t2\tx\n".encode("latin-1"))
    assert read_log(spark, str(tmp_path / "latin.log")).count() == 1


def test_renamed_rows_carry_each_column_once(spark, monkeypatch):
    f = spark.createDataFrame([("a", "r1", 1, 7), ("b", "r2", 3, 8)], "entity string, rev string, ord long, more long")
    e = spark.createDataFrame([("a", "b", 2)], "old string, new string, at long")
    seen, kept = [], R.kept
    monkeypatch.setattr(R, "kept", lambda df, label: seen.append((label, df.schema)) or kept(df, label))
    assert sorted(map(tuple, R.renamed(f, e).select("entity", "rev", "ord", "more", "path").collect())) == [("b", "r1", 1, 7, "a"), ("b", "r2", 3, 8, "b")]
    written = [s for label, s in seen if label == "asof" and "r" in s.names]
    assert len(written) == 1 and "place" not in written[0].names and written[0]["r"].dataType.names == ["rev", "more"]
    assert R.renamed(f.select("entity", "ord"), e).columns == ["entity", "ord", "path"]


# ---- runs over facts that lie in files


def test_facts_in_files_are_not_kept_again(spark, facts, tmp_path, monkeypatch):
    """``keep=False`` persists nothing, and a limit's total comes from the one pass over the facts."""
    facts.write.parquet(str(tmp_path / "facts"))
    lie = spark.read.parquet(str(tmp_path / "facts"))
    want = [run("authors", facts, rows=n).envelope() for n in (1, 2, 100)]
    asked = []
    monkeypatch.setattr(type(facts), "persist", lambda df, *a: asked.append(df) or df)
    monkeypatch.setattr(type(facts), "count", lambda df: asked.append(df))
    assert [run("authors", lie, rows=n, keep=False).envelope() for n in (1, 2, 100)] == want
    store("entity-churn", lie, str(tmp_path / "out"), keep=False)
    assert not asked
    monkeypatch.undo()
    assert json.loads((spark.read.text(str(tmp_path / "out/envelope")).first()[0]))["row_count"] == lookup("entity-churn").run(facts).count()


# ---- the lattice


def test_counts_from_one_lattice(spark, facts):
    odd = spark.createDataFrame([(None, "r9", "2024-05-05", "Zed", "-", 1, 2, False, True, 90), ("n", None, None, None, "-", None, None, False, True, 91)], FACT)
    for f in (facts, facts.unionByName(odd), facts.limit(0)):
        for name, table in counted(f).items():
            want = lookup(name).table(f).select(*table.columns)
            assert sorted(map(str, table.collect())) == sorted(map(str, want.collect())), name
            assert table.schema == want.schema or [x.dataType for x in table.schema] == [x.dataType for x in want.schema]


def test_the_lattice_shuffles_facts_twice(spark, facts, monkeypatch):
    seen = []
    monkeypatch.setattr("silt.plans.batch.kept", lambda df, label: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    lattice(facts)
    assert seen[0].count("Exchange hashpartitioning") == 2



def test_tables_of_entities_are_not_shuffled_again(spark, facts):
    """Commits of several people and days, and of none, count once; what follows the lattice only reads what is written."""
    rows = [(f"e{i % 3}", None if i % 7 == 0 else f"r{i % 4}", f"2024-01-0{1 + i % 2}", f"p{i % 5}", "-", i, None if i % 2 else i, False, True, i) for i in range(60)]
    tables = counted(spark.createDataFrame(rows, FACT))
    for name, table in tables.items():
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert name in ("summary", "absolute-churn", "author-churn") or "Exchange" not in plan, name
        want = lookup(name).table(spark.createDataFrame(rows, FACT)).select(*table.columns)
        assert sorted(map(str, table.collect())) == sorted(map(str, want.collect())), name


# ---- envelopes and folders


@pytest.mark.parametrize("fields", ["", "rows.*,row_count", "rows.entity,rows.author"])
def test_envelopes_in_ranges(spark, tmp_path, fields, monkeypatch):
    """Every cut of an envelope gives its rows, wherever the keys beside them stand, whatever the strings hold."""
    monkeypatch.setattr("silt.sources.results.EDGE", 600)
    names = ['a},{"entity":1', "b\\", 'c"}],"x', "d é", "[]", 'e},{"', "plain"]
    rows = [(f"{n}{i}", f"r{i}", "2024-01-01", f'p"{i % 3}', "-", i, 1, False, True, i) for i, n in enumerate(names * 6)]
    facts = spark.createDataFrame(rows, FACT)
    (tmp_path / "e.json").write_text(run("entity-ownership", facts).json(fields))
    columns = ["entity", "author"] if fields == "rows.entity,rows.author" else ["entity", "author", "added", "deleted"]
    want = sorted(tuple(r) for r in lookup("entity-ownership").run(facts).select(*columns).collect())
    for n in (1, 3, 40):
        back = read_envelope(spark, str(tmp_path / "e.json"), ranges=n)
        assert sorted(back.columns) == sorted(columns) and sorted(map(tuple, back.select(*columns).collect())) == want, n
    (tmp_path / "list.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2}]))
    assert sorted(map(str, read_envelope(spark, str(tmp_path / "list.json")).collect())) == ["Row(a=1, b='x')", "Row(a=2, b=None)"]
    (tmp_path / "none.json").write_text(run("entity-ownership", facts.limit(0)).json())
    assert read_envelope(spark, str(tmp_path / "none.json")).collect() == []


def test_intervals(spark):
    leaves = spark.createDataFrame([("a/b/x", 1), ("a/b/y", 2), ("a-b/z", 3), ("a/c", 4), ("w", 5)], "entity string, size long")
    got = {r["path"]: (r["left"], r["right"], r["files"], r["size"]) for r in S.intervals(leaves).collect()}
    assert got == {"": (0, 8, 5, 15), "a": (1, 5, 3, 7), "a/b": (2, 4, 2, 3), "a/b/x": (3, 3, 1, 1), "a/b/y": (4, 4, 1, 2), "a/c": (5, 5, 1, 4), "a-b": (6, 7, 1, 3), "a-b/z": (7, 7, 1, 3), "w": (8, 8, 1, 5)}
    for p, (left, right, _, _) in got.items():
        inside = {q for q in got if q == p or p == "" or q.startswith(p + "/")}
        assert inside == {q for q, (at, *_) in got.items() if left <= at <= right}


def test_nested_is_as_before():
    leaves = [{"entity": e, "size": i} for i, e in enumerate(["a/b/x", "a/c", "b", "a/b/y"])]
    assert S.nested(leaves) == {"name": "root", "children": [{"name": "a", "children": [{"name": "b", "children": [{"name": "x", "size": 0}, {"name": "y", "size": 3}]}, {"name": "c", "size": 1}]}, {"name": "b", "size": 2}]}


# ---- charts


@pytest.mark.parametrize(
    "meanings, more, want",
    [
        ({"a": "person", "b": "person", "n": "count"}, {}, ("echarts", "Network Graph", {"x": "a", "y": "b", "size": "n"})),
        ({"a": "person", "b": "person", "n": "count"}, {"library": "vegalite"}, ("vegalite", "Heatmap", {"x": "a", "y": "b", "color": "n"})),
        ({"e": "filepath", "d": "date", "n": "count", "r": "ratio"}, {}, ("vegalite", "Bar Chart", {"x": "d", "y": "r", "color": "e"})),
        ({"n": "count", "l": "loc", "r": "ratio"}, {}, ("vegalite", "Scatter Plot", {"x": "r", "y": "l"})),
        ({"e": "filepath", "n": "count", "r": "ratio", "l": "loc"}, {"template": "Scatter Plot"}, ("vegalite", "Scatter Plot", {"x": "e", "y": "r", "size": "l"})),
        ({"m": "duration_months"}, {}, ("vegalite", "Histogram", {"x": "m"})),
        ({"e": "filepath", "m": "duration_months"}, {"analysis": "code-age"}, None),
        ({"entity": "filepath", "age_months": "duration_months"}, {"analysis": "code-age"}, ("vegalite", "Histogram", {"x": "age_months"})),
        ({"entity": "filepath", "age_months": "duration_months"}, {"analysis": "code-age", "template": "Lollipop Chart"}, ("vegalite", "Lollipop Chart", {"x": "entity", "y": "age_months"})),
        ({"e": "filepath", "n": "count"}, {"library": "echarts"}, None),
        ({"e": "filepath", "n": "count"}, {"template": "Pie"}, None),
        ({"e": "filepath", "n": "count"}, {"template": "Network Graph", "library": "vegalite"}, None),
        ({"t": "text", "c": "commit_id"}, {}, None),
        ({"t": "nonsense"}, {}, None),
        ({"e": "filepath"}, {"template": "KPI Card"}, None),
        ({"e": "filepath", "n": "count", "f": "person"}, {"template": "Network Graph"}, None),  # a channel that the template lacks isn't given
    ],
)
def test_charts(meanings, more, want):
    if want is None and more.get("template") != "Network Graph" or more.get("library") == "vegalite" and want is None:
        with pytest.raises(SiltError):
            chart_spec(meanings, **more)
        return
    spec = chart_spec(meanings, **more)
    if want is None:
        assert set(spec["channels"]) <= set(CHANNELS[spec["library"]][spec["template"]])
    else:
        assert (spec["library"], spec["template"], spec["channels"]) == want
        assert set(spec["kinds"]) <= set(meanings)
