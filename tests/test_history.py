import datetime as dt
import io
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silt import cli
from silt.errors import CODES, SiltError
from silt.functions.exprs import centi, months_between
from silt.functions.patterns import glob_to_regex, linear_regex
from silt.operators import network, transforms
from silt.operators import second as S
from silt.operators.coupling import candidates
from silt.operators.transforms import Transforms, filter_paths, group_layers, layer, map_teams, temporal_windows
from silt.plans.batch import GENERATED, run_all
from silt.plans.describe import command_list, command_schema
from silt.plans.result import encode, run, store
from silt.registry import analyses, lookup
from silt.schema import FACT, ROLES, roles_of
from silt.shared import shared_dir
from silt.sources.adapters import as_facts
from silt.sources.definitions import parse_layers, parse_teams
from silt.sources.gitlog import log_command, parse_lines, preludes, read_log, register, write_log
from silt.sources.results import read_envelope, read_structure

from history import LOG, coupling, rows_of, windows


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    p = tmp_path_factory.mktemp("log") / "f1.log"
    p.write_text(LOG)
    return str(p)


@pytest.fixture(scope="module")
def facts(spark, log):
    return spark.createDataFrame(list(parse_lines(LOG.splitlines())), FACT).cache()


def got(name, facts, **flags):
    return [tuple(r) for r in lookup(name).run(facts, **flags).collect()]


EXPECTED = {
    "authors": "b 3 3; c 3 3; a 2 3; L 1 1; G 1 1",
    "revisions": "a 3; b 3; c 3; L 1; G 1",
    "absolute-churn": "2024-01-05 14 0 1; 2024-01-06 4 3 1; 2024-01-31 5 5 1; 2024-02-10 9 3 1; 2024-02-29 1 10 1",
    "author-churn": "Ana 19 5 2; Ben 13 6 2; Chi 1 10 1",
    "entity-churn": "a 15 2 3; c 12 14 3; b 5 5 3; G 1 0 1; L 0 0 1",
    "entity-ownership": "L Ana 0 0; G Chi 1 0; a Ana 10 0; a Ben 5 2; b Ana 4 0; b Ben 1 1; b Chi 0 4; c Ana 5 5; c Ben 7 3; c Chi 0 6",
    "main-developer": "L Ana 0 0 0; G Chi 1 1 1; a Ana 10 15 0.67; b Ana 4 5 0.8; c Ben 7 12 0.58",
    "refactoring-main-developer": "L Ana 0 0 0; G Chi 0 0 0; a Ben 2 2 1; b Chi 4 5 0.8; c Chi 6 14 0.43",
    "main-developer-by-revisions": "L Ana 1 1 1; G Chi 1 1 1; a Ben 2 3 0.67; b Ana 1 3 0.33; c Ana 1 3 0.33",
    "entity-effort": "L Ana 1 1; G Chi 1 1; a Ben 2 3; a Ana 1 3; b Ana 1 3; b Ben 1 3; b Chi 1 3; c Ana 1 3; c Ben 1 3; c Chi 1 3",
    "fragmentation": "b 0.67 3; c 0.67 3; a 0.44 3; L 0 1; G 0 1",
    "communication": "Ben Ana 3 4 75; Ana Ben 3 4 75; Chi Ben 2 3 66; Ben Chi 2 3 66; Chi Ana 2 4 50; Ana Chi 2 4 50",
}


@pytest.mark.parametrize("name", EXPECTED)
def test_fixture(facts, name):
    expected = [tuple(x if isinstance(x, float) else x for x in r) for r in rows_of(EXPECTED[name])]
    assert [tuple(float(x) if isinstance(x, (int, float)) else x for x in r) for r in got(name, facts)] == expected


def test_fixture_with_flags(facts):
    n = lambda rows: [tuple(float(x) if isinstance(x, (int, float)) else x for x in r) for r in rows]
    assert n(got("code-age", facts, time_now="2024-03-30")) == rows_of("G 1; a 1; b 1; c 1; L 2")
    assert n(got("messages", facts, expression="fix")) == rows_of("b 2; c 1; a 1; G 1")
    assert got("sum-of-coupling", facts) == []
    assert n(got("sum-of-coupling", facts, min_revs=0)) == rows_of("b 5; a 4; c 3; G 2; L 2")
    low = {"min_revs": 1, "min_shared_revs": 1, "min_coupling": 0, "verbose": True}
    assert n(got("coupling", facts, **low)) == rows_of("a b 66 3 3 3 2; L a 50 2 1 3 1; L b 50 2 1 3 1; G b 50 2 1 3 1; G c 50 2 1 3 1; a c 33 3 3 3 1; b c 33 3 3 3 1")
    assert n(got("coupling", facts, **low, max_changeset_size=2)) == rows_of("a b 66 2 2 1 1; a c 50 2 2 2 1")
    assert [tuple(r) for r in lookup("summary").run(facts).collect()] == [("number-of-commits", 5), ("number-of-entities", 5), ("number-of-entities-changed", 11), ("number-of-authors", 3)]


def test_temporal_fixture(facts):
    by = {}
    for r in temporal_windows(facts, 2).orderBy("ord").collect():
        by.setdefault(r["rev"], []).append((r["entity"].split("/")[-1][0], r["date"]))
    assert {k: "".join(sorted(e for e, _ in v)) for k, v in by.items()} == {
        "2024-01-06": "abl", "2024-01-07": "ab", "2024-01-31": "c", "2024-02-01": "c", "2024-02-10": "ac", "2024-02-11": "ac", "2024-02-29": "bcg"}
    assert {d for _, d in by["2024-01-06"]} == {"2024-01-05"}


def test_empty(spark):
    empty = spark.createDataFrame([], FACT)
    for a in analyses():
        rows = a.run(empty, **({"expression": "x"} if a.name == "messages" else {})).collect()
        assert len(rows) == (4 if a.name == "summary" else 0), a.name


# ---- parsing


def errors_of(spark, tmp_path, text):
    out = []
    p = tmp_path / "x.log"
    p.write_text(text, newline="")
    for f in (lambda: list(parse_lines(io.StringIO(text, newline="\n"))), lambda: read_log(spark, str(p)).collect()):
        try:
            f()
            out.append(None)
        except SiltError as e:
            out.append((e.code, e.exit_code, (e.details or {}).get("entry"), (e.details or {}).get("line")))
    return out


@pytest.mark.parametrize(
    "text, code",
    [
        ("", "empty_log"), ("  \n\t\n", "empty_log"), ("--a1--2024-01-01--X\nbad\n", "parse_error"), ("1\t2\tf\n", "parse_error"), ("--a1--2024-1-1--X\n1\t2\tf\n", "parse_error"),
        ("--G1--2024-01-01--X\n1\t2\tf\n", "parse_error"), ("--a1--2024-01-01--X\n1\t2\tf\n--a2--2024-01-01--Y\n", "parse_error"), ("--a1--2024-01-01--X\n1\t2\t\x00f\n", "invalid_control_char"),
        ("--a1--2024-01-01--X\n1\rx\t2\tf\n", "invalid_control_char"), ("--a1--2024-01-01--X\n1\t2\tf\n\x0c\n", "invalid_control_char"), ("\x0b\n", "invalid_control_char"),
        ("--a1--2024-01-01--X\n1\t2\tf\n\r\r\n", "invalid_control_char"), ("--a1--2024-01-01--X\n\n" + " " * (1 << 20) + "\n", "internal_error"), ("\u200b\n", "parse_error"), ("--a1--2024-01-01--X\n1\t99999999999999999999\tf\n", "parse_error"),
    ],
)
def test_log_errors(spark, tmp_path, text, code):
    a, b = errors_of(spark, tmp_path, text)
    assert a == b and a[0] == code and a[1] == (70 if code == "internal_error" else CODES[code][0])


@pytest.mark.parametrize(
    "text",
    [
        LOG, LOG.replace("\n", "\r\n"), "\n\n \n" + LOG + "\n\n\n", "--a1--2024-01-01--X\n", "--a1--2024-01-01--X--\n+1\t-2\tp\twith\ttabs \n-\t5\tb\n", "--a1--2024-01-01--A--B--C\n0\t0\té x\n",
        "--bad\n--a1--9999-99-99--X--m\n1\t1\tf", "--a1--2024-01-01--X\n1\t2\tf\n\u3000\u2003\n--a2--2024-01-02--Y\n1\t2\tg\n\x85\xa0\n", "--a1--2024-01-01--X\n1\t2\tf\n\u1680\r\n\n",
    ],
)
def test_log_parsers_agree(spark, tmp_path, text):
    p = tmp_path / "x.log"
    p.write_text(text, newline="")
    a = [r[:9] for r in parse_lines(io.StringIO(text, newline="\n"))]
    assert [tuple(r)[:9] for r in read_log(spark, str(p)).orderBy("ord").collect()] == a
    register(spark)
    assert [tuple(r)[:9] for r in spark.read.format("gitlog").load(str(p)).orderBy("ord").collect()] == a


def test_log_source_in_ranges(spark, tmp_path):
    """The same rows and places with 1 and 64 ranges; conditions go down to the entries' heads."""
    register(spark)
    r = random.Random(4)
    text = "".join("\n" * r.randint(0, 3) + f"--{i:06x}--2024-01-{1 + i % 28:02d}--P{i % 7}é\n" * r.randint(1, 2) + "".join(f"{r.randint(0, 9)}\t1\tf{r.randint(0, 50)}\n" for _ in range(r.randint(0, 30))) + " \r\n" for i in range(600))
    (tmp_path / "logs").mkdir()
    for i, part in enumerate((text, "\n\n", text[len(text) // 2 :].split(" \r\n", 1)[1])):
        (tmp_path / "logs" / f"{i}.log").write_text(part, newline="")
    read = lambda n, path="logs/0.log": spark.read.format("gitlog").option("ranges", n).load(str(tmp_path / path))
    want = [tuple(x)[:9] for x in parse_lines(io.StringIO(text, newline="\n"))]
    one = [tuple(x) for x in read(1).orderBy("ord").collect()]
    assert [x[:9] for x in one] == want
    for n in (7, 64):
        assert [tuple(x) for x in read(n).orderBy("ord").collect()] == one, n
    assert read(64).rdd.getNumPartitions() == 64
    every = [tuple(x)[:9] for x in read(9, "logs").orderBy("ord").collect()]
    assert every[: len(want)] == want and len(every) > len(want)
    some = read(64).where("date >= '2024-01-10' and date < '2024-01-12' and author in ('P1é', 'P2é')")
    assert sorted(tuple(x)[:9] for x in some.collect()) == sorted(x for x in want if "2024-01-10" <= x[2] < "2024-01-12" and x[3] in ("P1é", "P2é")) != []
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter [" not in plan.replace("RuntimeFilters: [", ""), plan
    # What a condition leaves out isn't parsed: a broken line in such an entry goes unseen.
    (tmp_path / "broken.log").write_text("--a1--2024-01-01--X\nbroken\n\n--a2--2024-01-02--X\n1\t2\tf\n")
    assert [x["rev"] for x in read(1, "broken.log").where("date = '2024-01-02'").collect()] == ["a2"]
    with pytest.raises(Exception, match="expected counts"):
        read(1, "broken.log").collect()
    (tmp_path / "wide.log").write_text(LOG, encoding="utf-16")
    assert [tuple(x)[:9] for x in spark.read.format("gitlog").options(encoding="utf-16", ranges=5).load(str(tmp_path / "wide.log")).orderBy("ord").collect()] == [x[:9] for x in parse_lines(LOG.splitlines())]


def test_large_log_in_blocks(spark, tmp_path):
    r = random.Random(3)
    text = "".join("\n" * r.randint(0, 2) + f"--{i:06x}--2024-01-{1 + i % 28:02d}--P{i % 7}\n" * r.randint(1, 2) + "".join(f"{r.randint(0, 9)}\t1\tf{r.randint(0, 50)}\n" for _ in range(r.randint(0, 4))) + "\n" for i in range(4000))
    p = tmp_path / "big.log"
    p.write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = read_log(spark, str(p))
        assert [tuple(x)[:9] for x in df.orderBy("ord").collect()] == [x[:9] for x in parse_lines(io.StringIO(text))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_preludes(spark, log):
    assert tuple(S.active_window(preludes(spark, log)).first()) == ("2024-01-05", "2024-03-01", 6)


# ---- expressions and patterns


def test_centi_is_two_significant_digits(spark):
    r = random.Random(1)
    values = [0.0, 5.0, 0.834, 0.0834, 1 / 3, 0.125, 0.625, 0.155, 1.0] + [r.random() * 10 ** r.randint(-3, 2) for _ in range(2000)]
    out = spark.createDataFrame([(v,) for v in values], "v double").select("v", centi(F.col("v")).alias("c")).collect()
    assert all(c == float(f"{v:.1e}") for v, c in out)


def test_months(spark):
    cases = [("2020-02-29", "2020-01-31", 0), ("2020-03-31", "2020-01-31", 2), ("2024-03-30", "2024-02-29", 1), ("2024-01-01", "2023-12-31", 0)]
    df = spark.createDataFrame(cases, "n string, t string, m int")
    assert all(r[0] == r[1] for r in df.select(months_between(F.to_date("n"), F.to_date("t")), "m").collect())


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("**/*.go", ["a.go", "x/y/a.go"], ["a.gox"]), ("src/*", ["src/a"], ["src/a/b", "src"]), ("src/**", ["src/a/b", "src/a", "src"], ["srcx"]), ("a?c", ["abc"], ["a/c"]), ("{a,b}/*.x", ["a/1.x", "b/2.x"], ["c/1.x"]),
        ("[!a]b", ["xb"], ["ab", "/b"]), ("**/vendor/**", ["vendor/x", "a/vendor/b/c"], ["vendors/x"]), ("a**b", ["axxb"], ["ax/b"]), ("x.y", ["x.y"], ["xzy"]),
    ],
)
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "p string")
    assert [r[0] for r in df.select(F.col("p").rlike(glob_to_regex(glob))).collect()] == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize("bad", ["", "[a", "{a", "x" * 1001, "a\\"])
def test_bad_globs(bad):
    with pytest.raises(SiltError) as e:
        glob_to_regex(bad)
    assert e.value.code == "invalid_glob"


@pytest.mark.parametrize("bad", ["", "(", "a(?=b)", r"(a)\1", "x" * 1001, "a++", "[[:nope:]]", "(?<!a)b"])
def test_bad_expressions(bad):
    with pytest.raises(SiltError):
        linear_regex(bad, "invalid_expression")


@pytest.mark.parametrize(
    "rx, yes, no",
    [("^fix", ["fix a"], ["a fix"]), ("end$", ["the end"], ["end\n"]), ("[[:alpha:]]+-1", ["ab-1"], ["12-1"]), (r"(?P<n>a|b)c", ["bc"], ["cc"]), (r"a\sb", ["a b"], ["a\x0bb"]), ("(?i)FIX", ["fix"], ["fox"]), ("a[]]b", ["a]b"], ["a[b"])],
)
def test_expressions(spark, rx, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "p string")
    assert [r[0] for r in df.select(F.col("p").rlike(linear_regex(rx, "invalid_expression"))).collect()] == [True] * len(yes) + [False] * len(no)


# ---- transforms


def test_layers_and_teams(facts):
    rules = parse_layers("src/core => Core\n\n^.*\\.md$ => Docs\nsrc => Rest\n")
    assert {r[0]: r[1] for r in group_layers(facts, rules).groupBy("entity").count().collect()} == {"Core": 6, "Rest": 3, "Docs": 1}
    teams = parse_teams("Author, Team\nAna Ruiz, Red\nBen Okoro,Red\nAna Ruiz,Blue\n")
    assert teams == {"Ana Ruiz": "Blue", "Ben Okoro": "Red"}
    assert {r[0] for r in map_teams(facts, teams).select("author").distinct().collect()} == {"Blue", "Red", "Chi Wen"}
    assert parse_teams('[{"author":"a","team":"t"}]', "json") == parse_teams('{"a":"t"}', "json") == {"a": "t"}
    for bad in (lambda: parse_layers("x"), lambda: parse_layers("=> y"), lambda: parse_layers("( => y"), lambda: parse_teams("a,b,c"), lambda: parse_teams("3", "json"), lambda: parse_teams("", "xml")):
        with pytest.raises(SiltError):
            bad()


def test_filter_before_layers(facts):
    t = Transforms(exclude=["src/core/a.py"], layers=[layer("src/core", "Core")])
    assert t.apply(facts).count() == 3
    assert t.record() == {"exclude": ["src/core/a.py"], "group": True}
    assert filter_paths(facts, ["src/**"], ["**/b.py"]).count() == 6


def test_bad_dates(spark):
    row = ("f", "a", "2024-13-01", "A", "m", 1, 1, False, True, 0)
    df = spark.createDataFrame([row], FACT)
    with pytest.raises(SiltError) as e:
        temporal_windows(df, 2)
    assert e.value.code == "invalid_temporal_date"
    assert got("code-age", df, time_now="2024-12-01") == [] and got("absolute-churn", df) == [("2024-13-01", 1, 1, 1)]


histories = st.lists(st.tuples(st.sampled_from("abcde"), st.integers(0, 9), st.sampled_from("xyz"), st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40)


def as_rows(h):
    return [(e, f"{r:x}", (dt.date(2024, 2, 25) + dt.timedelta(r)).isoformat(), a, "m", p, q, False, True, i) for i, (e, r, a, p, q) in enumerate(h)]


@settings(max_examples=12, deadline=None)
@given(histories, st.integers(1, 4))
def test_against_definitions(spark, h, n):
    rows = as_rows(h)
    df = spark.createDataFrame(rows, FACT)
    assert {(r["a"], r["b"]): (r["shared"], r["first_entity_revisions"], r["second_entity_revisions"]) for r in candidates(df, n).collect()} == coupling(rows, n)
    expected = windows([(r[0], r[1], dt.date.fromisoformat(r[2]).toordinal(), r[9]) for r in rows], n)
    blocks, slices = transforms.DAYS_BLOCK, network.SLICE
    try:
        transforms.DAYS_BLOCK, network.SLICE = n + len(rows) % 3, 1 + len(rows) % 2  # many blocks of days, many slices of people
        for check in (True, False):
            out = temporal_windows(df, n, check).select("rev", "entity", F.col("ord.o").alias("o")).collect()
            assert len(out) == len(expected) and {(dt.date.fromisoformat(r[0]).toordinal(), r[1]): r[2] for r in out} == {k: v[3] for k, v in expected.items()}
        sliced = got("communication", df)
    finally:
        transforms.DAYS_BLOCK, network.SLICE = blocks, slices
    own = {(r[0], r[3]) for r in rows}
    shared = {(a, b): len({e for e, x in own if x == a} & {e for e, x in own if x == b}) for a in "xyz" for b in "xyz" if a != b}
    assert {(r[0], r[1]): r[2] for r in sliced} == {k: v for k, v in shared.items() if v} and sorted(sliced) == sorted(got("communication", df))


def test_order_of_rows_does_not_matter(facts):
    mixed = facts.orderBy(F.rand(3)).repartition(7)
    for a in analyses():
        flags = {"expression": "fix"} if a.name == "messages" else {"time_now": "2024-03-30"} if a.name == "code-age" else {}
        assert a.run(facts, **flags).collect() == a.run(mixed, **flags).collect(), a.name


# ---- results


def test_envelope(facts):
    r = run("authors", facts, rows=2)
    assert r.envelope()["rows"] == [{"entity": "src/core/b.py", "n_authors": 3, "n_revs": 3}, {"entity": "src/ui/c.py", "n_authors": 3, "n_revs": 3}]
    assert list(r.envelope()) == ["schema_version", "ok", "analysis", "shape", "semantics", "row_count", "total_count", "truncated", "rows"]
    p = json.loads(run("authors", facts).json("rows.entity"))
    assert list(p) == sorted(p) and set(p) == {"ok", "rows", "schema_version", "semantics", "shape"} and p["semantics"] == {"entity": "filepath"}
    with pytest.raises(SiltError) as e:
        run("authors", facts).json("rows.nope")
    assert e.value.code == "invalid_field"
    assert "params" in run("coupling", facts).envelope() and run("coupling", facts).warnings[0]["code"] == "coupling_all_filtered"
    assert run("authors", facts, Transforms(layers=[])).envelope()["semantics"]["entity"] == "label"
    w = run("authors", facts, Transforms(period=2)).warnings
    assert w[0]["details"] == {"period_days": 2, "affected_columns": ["n_authors", "n_revs"], "analysis": "authors"}
    assert encode({"a": 1.0, "b": "<&>\u2028", "c": 0.5}) == '{"a":1,"b":"\\u003c\\u0026\\u003e\\u2028","c":0.5}'
    dump = run("parse", facts).envelope()["rows"]
    assert dump[2] == {"entity": "assets/logo.png", "rev": "c1a0001", "date": "2024-01-05", "author": "Ana Ruiz", "message": "Start engine", "loc_added": 0, "loc_deleted": 0, "binary": True}


def test_guards(spark, facts):
    with pytest.raises(SiltError, match="line counts"):
        run("entity-churn", facts.withColumn("has_loc", F.lit(False)))
    with pytest.raises(SiltError, match="subjects"):
        run("messages", facts.withColumn("message", F.lit("-")), expression="x")
    with pytest.raises(SiltError) as e:
        run("messages", facts)
    assert e.value.code == "missing_required_flag"
    with pytest.raises(SiltError) as e:
        run("code-age", facts, time_now="2024-1-1")
    assert e.value.code == "invalid_time_now"


def test_contract():
    listed = command_list()
    assert len(analyses()) == 18 and len(listed["commands"]) == 20 and set(listed["aggregation_roles"]) == set(ROLES)
    assert {e["code"]: e["exit_code"] for e in listed["errors"]} == {c: x for c, (x, _) in CODES.items()}
    for c in listed["commands"]:
        d = command_schema(c["name"])
        assert d["command"] == c["name"] and set(d["error_codes"]) <= set(CODES)
        for alias in c["aliases"]:
            assert command_schema(alias)["command"] == c["name"]


def test_command_line(spark, log, tmp_path):
    def call(*args, stdin=""):
        out, err = io.StringIO(), io.StringIO()
        code = cli.main(list(args), spark, io.StringIO(stdin), out, err)
        return code, out.getvalue(), err.getvalue()

    code, out, _ = call("revisions", "--log", log, "--rows", "1")
    assert code == 0 and json.loads(out)["rows"] == [{"entity": "src/core/a.py", "n_revs": 3}]
    assert json.loads(call("summary", stdin=LOG)[1])["rows"][0]["value"] == 5
    (tmp_path / "g").write_text("src/core => Core")
    assert json.loads(call("authors", "--log", log, "--group", str(tmp_path / "g"))[1])["rows"] == [{"entity": "Core", "n_authors": 3, "n_revs": 6}]
    for args, want in (
        (("authors", "--log", "/nope"), (74, "log_open_failed")), (("authors", "--log", log, "--group", "/nope"), (74, "input_file_open_failed")), (("nope",), (64, "unknown_command")),
        (("authors", "--nope"), (64, "unknown_flag")), (("messages", "--log", log), (64, "missing_required_flag")), (("authors", "--log", log, "--rows", "x"), (64, "invalid_value")),
        (("schema", "--command", "nope"), (64, "unknown_schema_command")), (("print-log-command", "--after", "2024-2-1"), (64, "invalid_after_date")), (("authors", "--log", log, "--include", "[a"), (64, "invalid_glob")),
    ):
        code, _, err = call(*args)
        assert (code, json.loads(err)["error"]["code"]) == want
    with pytest.MonkeyPatch.context() as m:
        m.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
        assert json.loads(call("summary", stdin=LOG)[2])["error"]["code"] == "log_open_failed"
    assert json.loads(call("summary", "--log", f"file://{log}")[1])["rows"][0]["value"] == 5
    assert call("print-log-command", "--after", "2024-02-01", "--all")[1].strip() == log_command("2024-02-01", True)
    assert json.loads(call("schema")[1])["ok"] and json.loads(call("schema", "--command", "soc")[1])["command"] == "sum-of-coupling"


# ---- second stage and batch


def test_second_stage(spark, facts, tmp_path):
    ages = lookup("code-age").run(facts, time_now="2024-03-30")
    assert roles_of(ages.schema) == {"entity": "dimension", "age_months": "intensive"}
    with pytest.raises(S.AggregationError):
        S.sum_for_value(ages, "age_months")
    with pytest.raises(S.AggregationError):
        S.sum_for_rank(ages, "entity", ["entity"])
    assert S.sum_for_value(lookup("entity-churn").run(facts), "added").first()[0] == 33
    pairs = lookup("communication").run(facts)
    assert {r["key"]: r["total"] for r in S.sum_for_rank(pairs, "strength", ["author", "peer"]).collect()} == {"Ana Ruiz": 250.0, "Ben Okoro": 282.0, "Chi Wen": 232.0}
    m = {(r[0], r[1]): r[2] for r in S.pair_matrix(pairs, "author", "peer", "strength", 2).collect()}
    assert m == {("Ben Okoro", "Ana Ruiz"): 75.0, ("Ana Ruiz", "Ben Okoro"): 75.0}
    (tmp_path / "t.json").write_text(json.dumps({"Python": {"reports": [{"name": "./src/core/a.py", "stats": {"code": 90}}, {"name": "new.py", "stats": {"code": 5}}]}, "Total": {"reports": [{"name": "z", "stats": {"code": 1}}]}}))
    tree = read_structure(spark, str(tmp_path / "t.json"))
    leaves = S.map_leaves(lookup("revisions").run(facts), "n_revs", tree)
    assert sorted(tuple(r) for r in leaves.collect()) == [("new.py", 5.0, 0.0), ("src/core/a.py", 90.0, 1.0)]
    assert [tuple(r) for r in S.domination(leaves).collect()] == [("src/core/a.py", 90.0, 95)]
    assert sorted(r["category"] for r in S.category_leaves(lookup("main-developer").run(facts), "main_dev", tree).collect()) == ["(unowned)", "Ana Ruiz"]
    assert {r["path"]: r["files"] for r in S.hierarchy(leaves).collect()} == {"": 2, "new.py": 1, "src": 1, "src/core": 1, "src/core/a.py": 1}
    assert S.nested([{"entity": "a/b", "size": 1}, {"entity": "c", "size": 2}])["children"][0] == {"name": "a", "children": [{"name": "b", "size": 1}]}
    assert tuple(S.age_statistics(ages).first()) == (1, 1, 2)
    assert tuple(S.churn_totals(lookup("absolute-churn").run(facts)).first()) == (5, 33, 21, 1.57, "2024-01-05")
    assert {r["rev"]: r["message"] for r in S.subjects(facts).collect()}["c1a0003"] == "-"
    assert [tuple(r) for r in S.hotspot_candidates(lookup("revisions").run(facts), tree).collect()] == [("src/core/a.py", 3)]
    src = spark.createDataFrame([(1, "def f():\n    x\n\n\tif y:\n"), (2, None)], "ord int, source string")
    assert [tuple(r) for r in S.complexity_trend(src, "ord", "source").orderBy("ord").collect()] == [(1, 3, 3.0), (2, 0, 0.0)]
    (tmp_path / "e.json").write_text(run("authors", facts).json())
    assert read_envelope(spark, str(tmp_path / "e.json"), lookup("authors").run(facts).schema).count() == 5
    assert read_envelope(spark, str(tmp_path / "e.json")).count() == 5
    nodes, links = S.coupling_graph(lookup("coupling").run(facts, min_revs=1, min_shared_revs=1, min_coupling=0), None, 60)
    assert sorted(r["id"] for r in nodes.collect()) == ["src/core/a.py", "src/core/b.py"] and links.count() == 1
    assert [tuple(r) for r in S.crisis_cadence(facts, "REVERT|merge").orderBy("month").collect()] == [("2024-02", 2)]
    assert S.chart_columns(ages)["intensive"] == ["age_months"]
    assert {r["term"]: r["n"] for r in S.word_cloud(spark.createDataFrame([("a", "Don't re-use it's", 1), ("a", "Don't re-use C++ at x y", 2), ("b", "re-use", 1), ("c", None, 1)], "rev string, message string, ord int"), ["USE"]).collect()} == {"don't": 1, "re-use": 2, "c++": 1}
    # Files that no commit changed, and changed files that the structure lacks.
    few = facts.where("entity = 'src/core/a.py'")
    assert sorted(tuple(r) for r in S.map_leaves(lookup("revisions").run(few), "n_revs", tree).collect()) == [("new.py", 5.0, 0.0), ("src/core/a.py", 90.0, 0.0)]
    assert S.hotspot_candidates(lookup("revisions").run(facts), tree.where("entity = 'new.py'")).count() == 0


def test_charts(facts):
    table = lambda n, **f: lookup(n).run(facts, **f)
    assert S.chart(table("authors"), "authors")[0] == "Scatter Plot"
    assert S.chart(table("main-developer")) == ("Bar Chart", {"x": "entity", "y": "ownership", "color": "main_dev"})
    assert S.chart(table("absolute-churn")) == ("Bar Chart", {"x": "date", "y": "added"})
    assert S.chart(table("communication")) == ("Network Graph", {"x": "author", "y": "peer", "size": "strength"})
    assert S.chart(table("code-age", time_now="2024-03-30").select("age_months")) == ("Histogram", {"x": "age_months"})
    assert S.chart(table("entity-churn").select("commits", "added")) == ("Scatter Plot", {"x": "added", "y": "commits"})
    with pytest.raises(ValueError):
        S.chart(table("parse").select("rev", "message"))


def test_stored_results(spark, facts, tmp_path):
    r = store("authors", facts, str(tmp_path / "a"))
    assert [tuple(x) for x in spark.read.parquet(str(tmp_path / "a/rows")).orderBy(*lookup("authors").order()).collect()] == got("authors", facts)
    head = json.loads(spark.read.text(str(tmp_path / "a/envelope")).first()[0])
    assert head["row_count"] == r.total == len(got("authors", facts)) and "rows" not in head and head["semantics"] == run("authors", facts).envelope()["semantics"]
    assert store("coupling", facts, str(tmp_path / "b")).warnings[0]["code"] == "coupling_all_filtered"
    with pytest.raises(SiltError, match="line counts"):
        store("entity-churn", facts.withColumn("has_loc", F.lit(False)), str(tmp_path / "c"))


def test_written_logs(spark, facts, tmp_path):
    commits = facts.select("rev", "date", "author", "message").distinct().unionByName(spark.createDataFrame([("ffff", "2024-01-01", "Nobody", "no files -- at all")], "rev string, date string, author string, message string"))
    write_log(facts.repartition(3), str(tmp_path / "log"), commits)
    back = read_log(spark, str(tmp_path / "log"))
    assert sorted(tuple(r)[:9] for r in back.collect()) == sorted(tuple(r)[:9] for r in facts.collect())
    assert preludes(spark, str(tmp_path / "log")).where("rev = 'ffff'").count() == 1


def test_shared_folder(spark, monkeypatch):
    assert shared_dir(spark)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(spark)


def test_batch(facts):
    assert len(GENERATED) == 22
    out = run_all(facts, months=1, code_age={"time_now": "2024-03-30"})
    assert len(out) == 17 and out["summary"].first()["value"] == 3 and out["code-age"].count() == 5


def test_adapter(spark, facts):
    assert as_facts(facts.drop("has_loc", "ord")).columns == [f.name for f in FACT]
    with pytest.raises(ValueError):
        as_facts(facts.drop("rev"))


def test_streams(spark, facts, tmp_path):
    from silt.streaming import history as H

    for i, (lo, hi) in enumerate(((0, 6), (6, 99))):
        facts.where((F.col("ord") >= lo) & (F.col("ord") < hi)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    src = str(tmp_path / "in/*")

    def final(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [tuple(r) for r in spark.table(name).collect()]

    assert sorted(final(H.ownership(H.read_facts(spark, src)), "complete", "own")) == sorted(got("entity-ownership", facts))
    assert sorted(final(H.revisions(H.read_facts(spark, src), "400 days"), "complete", "revs")) == sorted(got("revisions", facts))
    seen = {}
    q = H.follow(H.read_facts(spark, src, 1), "authors", str(tmp_path / "store"), str(tmp_path / "cp"), lambda df, n: seen.update({n: df.collect()}))
    q.awaitTermination(120)
    assert [tuple(r) for r in seen[max(seen)]] == got("authors", facts)
