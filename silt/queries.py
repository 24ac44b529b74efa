"""Queries over the driver's tables, each with its DuckDB SQL where SQL expresses it (all of these do)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.errors import SiltError
from silt.operators import renames as R
from silt.operators import second as S
from silt.operators.coupling import all_filtered
from silt.operators.transforms import Transforms, filter_paths, group_layers, in_folders, layer, map_teams, temporal_windows
from silt.plans.batch import GENERATED, counted, trailing
from silt.plans.encoding import encode
from silt.plans.charts import chart_spec, meanings_of
from silt.plans.describe import command_list, command_schema
from silt.plans.result import Result, emit, run, store
from silt.registry import lookup
from silt.schema import roles_of
from silt.shared import kept, shared_dir
from silt.sources.adapters import nation_teams, order_history, order_key
from silt.sources.definitions import parse_layers, parse_teams
from silt.sources.emitted import read_result
from silt.sources.gitlog import numbered, parsed, preludes, read_lines, read_log, register, write_log
from silt.sources.results import read_envelope, read_structure
from silt.streaming import history as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

FACTS = """WITH facts AS (
  SELECT *, row_number() OVER (ORDER BY date, rev, entity, author, message, loc_added, loc_deleted, "binary") AS ord FROM (
    SELECT 'src/' || lower(replace(p_brand, '#', '')) || '/part' || CAST(l_partkey AS VARCHAR) AS entity, lower(hex(o_orderkey)) AS rev, strftime(o_orderdate, '%Y-%m-%d') AS date,
           c_name AS author, o_orderpriority AS message,
           CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS loc_added,
           CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(round(l_discount * 100) AS BIGINT) END AS loc_deleted, l_returnflag = 'N' AS "binary"
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey))"""
NOW = "2002-03-30"


def centi(x: str) -> str:
    return f"CAST(printf('%.1e', CAST({x} AS DOUBLE)) AS DOUBLE)"


def query(sql: str, name: str = "") -> Callable[[Query], Query]:
    """Registers a query and its SQL; $FACTS in the SQL starts it with the fact table."""

    def add(fn: Query) -> Query:
        n = name or fn.__name__
        QUERIES[n] = fn
        ORACLE_SQL[n] = sql.replace("$FACTS", FACTS)
        return fn

    return add


def table(name: str, facts: DataFrame, **flags) -> DataFrame:
    """An analysis's declared columns, unsorted: a sort would only cost."""
    a = lookup(name)
    return a.table(facts, **flags).select(*[c.name for c in a.visible(a.options(flags))])


def simple(name: str, sql: str, **flags) -> None:
    query(sql, name.replace("-", "_"))(lambda spark, d: table(name, order_history(spark, d), **flags))


simple("authors", "$FACTS SELECT entity, count(DISTINCT author) AS n_authors, count(*) AS n_revs FROM facts GROUP BY entity")
simple("revisions", "$FACTS SELECT entity, count(DISTINCT rev) AS n_revs FROM facts GROUP BY entity")
simple(
    "summary",
    """$FACTS SELECT 'number-of-commits' AS statistic, count(DISTINCT rev) AS value FROM facts UNION ALL SELECT 'number-of-entities', count(DISTINCT entity) FROM facts
    UNION ALL SELECT 'number-of-entities-changed', count(*) FROM facts UNION ALL SELECT 'number-of-authors', count(DISTINCT author) FROM facts""",
)
for _key, _name in (("date", "absolute-churn"), ("author", "author-churn"), ("entity", "entity-churn")):
    simple(_name, f"$FACTS SELECT {_key}, CAST(sum(loc_added) AS BIGINT) AS added, CAST(sum(loc_deleted) AS BIGINT) AS deleted, count(DISTINCT rev) AS commits FROM facts GROUP BY {_key}")
simple("entity-ownership", "$FACTS SELECT entity, author, CAST(sum(loc_added) AS BIGINT) AS added, CAST(sum(loc_deleted) AS BIGINT) AS deleted FROM facts GROUP BY entity, author")
for _name, _measure, _part, _whole in (
    ("main-developer", "sum(loc_added)", "added", "total_added"),
    ("refactoring-main-developer", "sum(loc_deleted)", "removed", "total_removed"),
    ("main-developer-by-revisions", "count(*)", "added", "total_added"),
):
    simple(
        _name,
        f"""$FACTS, o AS (SELECT entity, author, CAST({_measure} AS BIGINT) AS v FROM facts GROUP BY entity, author),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY v DESC, author) AS n, CAST(sum(v) OVER (PARTITION BY entity) AS BIGINT) AS t FROM o)
    SELECT entity, author AS main_dev, v AS {_part}, t AS {_whole}, {centi("CAST(v AS DOUBLE) / greatest(t, 1)")} AS ownership FROM r WHERE n = 1""",
    )
simple("entity-effort", "$FACTS SELECT entity, author, count(*) AS author_revs, CAST(sum(count(*)) OVER (PARTITION BY entity) AS BIGINT) AS total_revs FROM facts GROUP BY entity, author")
simple(
    "fragmentation",
    f"""$FACTS, o AS (SELECT entity, author, count(*) AS n FROM facts GROUP BY entity, author),
    t AS (SELECT entity, CAST(sum(n) AS BIGINT) AS t, list(n ORDER BY author) AS ns FROM o GROUP BY entity)
    SELECT entity, {centi("1 - list_reduce([(CAST(n AS DOUBLE) / t) * (CAST(n AS DOUBLE) / t) FOR n IN ns], lambda a, b: a + b, CAST(0 AS DOUBLE))")} AS fractal_value, t AS total_revs FROM t""",
)
simple(
    "code-age",
    f"""$FACTS, l AS (SELECT entity, max(CAST(date AS DATE)) AS d FROM facts WHERE date < '{NOW}' GROUP BY entity)
    SELECT entity, (year(DATE '{NOW}') - year(d)) * 12 + month(DATE '{NOW}') - month(d) - CASE WHEN day(DATE '{NOW}') < day(d) THEN 1 ELSE 0 END AS age_months FROM l""",
    time_now=NOW,
)
simple("messages", "$FACTS SELECT entity, count(DISTINCT rev) AS matches FROM facts WHERE regexp_matches(message, '^[0-4]-.*(URG|NOT)') GROUP BY entity", expression="^[0-4]-.*(URG|NOT)")
simple("parse", """$FACTS SELECT entity, rev, date, author, message, loc_added, loc_deleted, CASE WHEN "binary" THEN true END AS "binary" FROM facts""")
SOC = """s AS (SELECT DISTINCT rev, entity FROM facts), n AS (SELECT entity, count(*) OVER (PARTITION BY rev) - 1 AS k FROM s),
    soc AS (SELECT entity, CAST(sum(k) AS BIGINT) AS soc FROM n GROUP BY entity HAVING sum(k) > 5)"""
simple("sum-of-coupling", f"$FACTS, {SOC} SELECT entity, soc FROM soc")


def coupling_sql(cap: int, revs: int, shared: int, least: int, source: str = "facts", verbose: bool = True, most: int = 100) -> str:
    more = ", ra AS first_entity_revisions, rb AS second_entity_revisions, shared AS shared_revisions" if verbose else ""
    return f"""cs AS (SELECT DISTINCT rev, entity FROM {source}), sized AS (SELECT *, count(*) OVER (PARTITION BY rev) AS n FROM cs), kept AS (SELECT rev, entity FROM sized WHERE n <= {cap}),
    m AS (SELECT entity, count(*) AS r FROM kept GROUP BY entity),
    p AS (SELECT x.entity AS a, y.entity AS b, count(*) AS shared FROM kept x JOIN kept y ON x.rev = y.rev AND x.entity < y.entity GROUP BY 1, 2),
    q AS (SELECT a, b, shared, ma.r AS ra, mb.r AS rb, (ma.r + mb.r) / 2.0::DOUBLE AS avg FROM p JOIN m ma ON ma.entity = a JOIN m mb ON mb.entity = b),
    g AS (SELECT *, (CAST(shared AS DOUBLE) / avg) * 100 AS deg FROM q),
    coupling AS (SELECT a AS entity, b AS coupled, CAST(floor(deg) AS BIGINT) AS degree, CAST(ceil(avg) AS BIGINT) AS average_revs{more} FROM g
    WHERE floor(avg) >= {revs} AND shared >= {shared} AND deg >= {least} AND floor(deg) <= {most})"""


LOW = {"min_revs": 1, "min_shared_revs": 3, "min_coupling": 5}
PAIRS = coupling_sql(30, 1, 3, 5, verbose=False)
query(f"$FACTS, {PAIRS} SELECT * FROM coupling", "coupling")(lambda spark, d: table("coupling", order_history(spark, d), **LOW))
query(f"$FACTS, {coupling_sql(30, 1, 3, 5)} SELECT * FROM coupling", "coupling_verbose")(lambda spark, d: table("coupling", order_history(spark, d), **LOW, verbose=True))
query(f"$FACTS, {coupling_sql(4, 1, 2, 5)} SELECT * FROM coupling", "coupling_capped")(
    lambda spark, d: table("coupling", order_history(spark, d), min_revs=1, min_shared_revs=2, min_coupling=5, max_changeset_size=4, verbose=True)
)

TEAMS = "teams AS (SELECT f.entity, f.rev, f.date, n_name AS author, f.message, f.loc_added, f.loc_deleted, f.\"binary\", f.ord FROM facts f JOIN customer ON c_name = f.author JOIN nation ON c_nationkey = n_nationkey)"
COMMUNICATION = f"""{TEAMS}, ea AS (SELECT DISTINCT entity, author FROM teams), tot AS (SELECT author, count(*) AS n FROM ea GROUP BY author),
    sh AS (SELECT x.author, y.author AS peer, count(*) AS shared FROM ea x JOIN ea y ON x.entity = y.entity AND x.author <> y.author GROUP BY 1, 2),
    av AS (SELECT s.author, s.peer, s.shared, CAST(ceil((a.n + b.n) / 2.0) AS BIGINT) AS average FROM sh s JOIN tot a ON a.author = s.author JOIN tot b ON b.author = s.peer),
    communication AS (SELECT author, peer, shared, average, CAST(floor((CAST(shared AS DOUBLE) / average) * 100) AS BIGINT) AS strength FROM av)"""


def team_facts(spark: SparkSession, d: str) -> DataFrame:
    return map_teams(order_history(spark, d), nation_teams(spark, d))


query(f"$FACTS, {COMMUNICATION} SELECT * FROM communication", "communication")(lambda spark, d: table("communication", team_facts(spark, d)))
query(f"$FACTS, {TEAMS} SELECT author, CAST(sum(loc_added) AS BIGINT) AS added, CAST(sum(loc_deleted) AS BIGINT) AS deleted, count(DISTINCT rev) AS commits FROM teams GROUP BY author", "team_map")(
    lambda spark, d: table("author-churn", team_facts(spark, d))
)


@query(
    "$FACTS SELECT entity, count(DISTINCT rev) AS n_revs FROM facts WHERE (regexp_matches(entity, '^src/brand[1-3][^/]/part[^/]*$') OR entity LIKE 'src/brand55/%') AND NOT regexp_matches(entity, '^(.*/)?part[^/]*[05]$') GROUP BY entity"
)
def filter_include_exclude(spark: SparkSession, d: str) -> DataFrame:
    return table("revisions", filter_paths(order_history(spark, d), ["src/brand[1-3]?/part*", "src/brand55/**"], ["**/part*[05]"]))


LAYERS = [("src/brand1[1-3]", "low"), ("^src/brand[0-9]*1/", "ones"), ("src/brand[45].", "high")]
LAYERED = """layered AS (SELECT * REPLACE (CASE WHEN regexp_matches(entity, '^src/brand1[1-3]/') THEN 'low' WHEN regexp_matches(entity, '^src/brand[0-9]*1/') THEN 'ones' WHEN regexp_matches(entity, '^src/brand[45]./') THEN 'high' END AS entity) FROM facts),
    grouped AS (SELECT * FROM layered WHERE entity IS NOT NULL)"""


def layered(facts: DataFrame) -> DataFrame:
    return group_layers(facts, [layer(p, n) for p, n in LAYERS])


query(f"$FACTS, {LAYERED} SELECT entity, count(DISTINCT author) AS n_authors, count(*) AS n_revs FROM grouped GROUP BY entity", "group_layers")(lambda spark, d: table("authors", layered(order_history(spark, d))))
query(f"$FACTS, {LAYERED}, {coupling_sql(30, 5, 20, 3, 'grouped')} SELECT * FROM coupling", "coupling_layers")(
    lambda spark, d: table("coupling", layered(order_history(spark, d)), min_revs=5, min_shared_revs=20, min_coupling=3, verbose=True)
)


def windows_sql(days: int, source: str = "facts") -> str:
    return f"""lim AS (SELECT min(CAST(date AS DATE)) AS lo, max(CAST(date AS DATE)) AS hi FROM {source}),
    spread AS (SELECT f.*, CAST(f.date AS DATE) AS d, CAST(unnest(generate_series(greatest(CAST(f.date AS DATE), lo + {days - 1})::TIMESTAMP, least(CAST(f.date AS DATE) + {days - 1}, hi)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS w FROM {source} f, lim),
    first AS (SELECT *, row_number() OVER (PARTITION BY w, entity ORDER BY d, ord) AS n FROM spread),
    windowed AS (SELECT * REPLACE (strftime(w, '%Y-%m-%d') AS rev) FROM first WHERE n = 1)"""


query(f"$FACTS, {windows_sql(3)} SELECT entity, rev, date, author, message, loc_added, loc_deleted FROM windowed", "temporal_window")(
    lambda spark, d: temporal_windows(order_history(spark, d), 3).select("entity", "rev", "date", "author", "message", "loc_added", "loc_deleted")
)
query(f"$FACTS, {LAYERED}, {windows_sql(2, 'grouped')}, {coupling_sql(30, 1, 1, 5, 'windowed')} SELECT * FROM coupling", "temporal_coupling")(
    lambda spark, d: table("coupling", temporal_windows(layered(order_history(spark, d)), 2), min_revs=1, min_shared_revs=1, min_coupling=5, verbose=True)
)


@query(
    f"""$FACTS, {LAYERED.replace("FROM facts)", "FROM facts WHERE entity NOT LIKE '%7')")}, {windows_sql(2, "grouped")},
    named AS (SELECT w.entity, n_name AS author FROM windowed w JOIN customer ON c_name = w.author JOIN nation ON c_nationkey = n_nationkey)
    SELECT entity, author, count(*) AS author_revs, CAST(sum(count(*)) OVER (PARTITION BY entity) AS BIGINT) AS total_revs FROM named GROUP BY entity, author"""
)
def pipeline_all(spark: SparkSession, d: str) -> DataFrame:
    t = Transforms(exclude=["**/part*7"], layers=[layer(p, n) for p, n in LAYERS], period=2, teams=nation_teams(spark, d))
    return table("entity-effort", t.apply(order_history(spark, d)))


query("$FACTS SELECT entity, count(DISTINCT author) AS n_authors, count(*) AS n_revs FROM facts GROUP BY entity ORDER BY n_authors DESC, n_revs DESC, entity LIMIT 25", "rows_topk")(
    lambda spark, d: lookup("authors").run(order_history(spark, d), rows=25)
)
query("$FACTS SELECT entity, count(*) AS n_revs FROM facts GROUP BY entity", "fields_projection")(lambda spark, d: table("authors", order_history(spark, d)).select("entity", "n_revs"))
query(
    """$FACTS, c AS (SELECT date, sum(loc_added) AS added, sum(loc_deleted) AS deleted, count(DISTINCT rev) AS commits FROM facts GROUP BY date)
    SELECT substr(date, 1, 7) AS month, CAST(sum(commits) AS BIGINT) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted FROM c GROUP BY 1""",
    "monthly_momentum",
)(lambda spark, d: S.monthly_momentum(table("absolute-churn", order_history(spark, d))))
query("$FACTS SELECT substr(date, 1, 7) AS month, count(DISTINCT rev) AS commits FROM facts WHERE regexp_matches(message, '(?i)urgent|high') GROUP BY 1", "crisis_cadence")(
    lambda spark, d: S.crisis_cadence(order_history(spark, d), "urgent|high")
)
INVOLVED = "inv AS (SELECT k, sum(v) AS t FROM (SELECT {a} AS k, {w} AS v FROM {s} UNION ALL SELECT {b}, {w} FROM {s}) GROUP BY k)"
query(
    f"""$FACTS, {COMMUNICATION}, {INVOLVED.format(a="author", b="peer", w="strength", s="communication")}, best AS (SELECT k FROM inv ORDER BY t DESC, k LIMIT 8),
    ways AS (SELECT author AS "row", peer AS "column", author AS a, peer AS b, strength AS w FROM communication UNION ALL SELECT peer, author, author, peer, strength FROM communication),
    one AS (SELECT "row", "column", w, row_number() OVER (PARTITION BY "row", "column" ORDER BY a DESC, b DESC, w DESC) AS n FROM ways)
    SELECT "row", "column", CAST(w AS DOUBLE) AS weight FROM one WHERE n = 1 AND "row" IN (FROM best) AND "column" IN (FROM best)""",
    "pair_matrix",
)(lambda spark, d: S.pair_matrix(table("communication", team_facts(spark, d)), "author", "peer", "strength", 8))
query(
    f"""$FACTS, {PAIRS}, {SOC.replace("s AS (", "s0 AS (", 1).replace("FROM s)", "FROM s0)")}, ids AS (SELECT entity AS id FROM coupling WHERE degree >= 6 UNION SELECT coupled FROM coupling WHERE degree >= 6)
    SELECT id, regexp_extract(id, '[^/]*$') AS label, split_part(id, '/', 1) AS "group", coalesce(soc, 1) AS val FROM ids LEFT JOIN soc ON entity = id""",
    "coupling_graph_nodes",
)(lambda spark, d: S.coupling_graph(table("coupling", order_history(spark, d), **LOW), table("sum-of-coupling", order_history(spark, d)), 6)[0])
query(
    f"""$FACTS, {COMMUNICATION}, strong AS (SELECT * FROM communication WHERE strength >= 50), {INVOLVED.format(a="author", b="peer", w="strength", s="strong")}
    SELECT k AS id, round(CAST(t AS DOUBLE), 1) AS val FROM inv""",
    "network_node_strength",
)(lambda spark, d: S.people_network(table("communication", team_facts(spark, d)), 50)[0])
STRUCTURE = "structure AS (SELECT 'src/' || lower(replace(p_brand, '#', '')) || '/part' || CAST(p_partkey AS VARCHAR) AS entity, CAST(p_size * p_size AS BIGINT) AS loc FROM part)"


def structure(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files, with their squared sizes as lines."""
    p = spark.read.parquet(f"{d}/part.parquet")
    path = F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/part"), F.col("p_partkey").cast("string"))
    return p.select(path.alias("entity"), (F.col("p_size") * F.col("p_size")).cast("bigint").alias("loc"))


query(
    f"""$FACTS, {STRUCTURE}, w AS (SELECT entity, count(DISTINCT rev) AS v FROM facts GROUP BY entity), lim AS (SELECT min(v) AS lo, max(v) AS hi FROM w)
    SELECT s.entity, CAST(loc AS DOUBLE) AS size, coalesce(round(CAST(v - lo AS DOUBLE) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 4), 0) AS weight FROM structure s LEFT JOIN w USING (entity), lim""",
    "enclosure_leaves",
)(lambda spark, d: S.map_leaves(table("revisions", order_history(spark, d)), "n_revs", structure(spark, d)))
query(
    f"""$FACTS, {STRUCTURE}, o AS (SELECT entity, author, sum(loc_added) AS v FROM facts GROUP BY entity, author), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY v DESC, author) AS n FROM o)
    SELECT s.entity, loc AS size, coalesce(author, '(unowned)') AS category FROM structure s LEFT JOIN r ON r.entity = s.entity AND n = 1""",
    "category_leaves",
)(lambda spark, d: S.category_leaves(table("main-developer", order_history(spark, d)), "main_dev", structure(spark, d)))
query(
    f"WITH {STRUCTURE}, b AS (SELECT split_part(entity, '/', 2) AS entity, sum(loc) AS size FROM structure GROUP BY 1), t AS (SELECT sum(size) AS t FROM b) SELECT entity, CAST(size AS BIGINT) AS size, CAST(round_even(size / t * 100, 0) AS BIGINT) AS percent FROM b, t WHERE size > t * 0.04::DOUBLE ORDER BY size DESC, entity LIMIT 5",
    "domination",
)(lambda spark, d: S.domination(structure(spark, d).groupBy(F.element_at(F.split("entity", "/"), 2).alias("entity")).agg(F.sum("loc").alias("size")), 0.04))
query(
    f"""WITH {STRUCTURE}, l AS (SELECT '' AS path, 0 AS depth, loc FROM structure UNION ALL SELECT split_part(entity, '/', 1), 1, loc FROM structure
    UNION ALL SELECT split_part(entity, '/', 1) || '/' || split_part(entity, '/', 2), 2, loc FROM structure UNION ALL SELECT entity, 3, loc FROM structure)
    SELECT path, depth, count(*) AS files, CAST(sum(loc) AS BIGINT) AS size FROM l GROUP BY path, depth""",
    "hierarchy",
)(lambda spark, d: S.hierarchy(structure(spark, d), "loc"))
EFFORT = "eff AS (SELECT entity, author, count(*) AS author_revs, CAST(sum(count(*)) OVER (PARTITION BY entity) AS BIGINT) AS total_revs FROM facts GROUP BY entity, author)"
query(
    f"""$FACTS, {EFFORT}, best AS (SELECT entity FROM (SELECT entity, max(total_revs) AS t FROM eff GROUP BY entity) ORDER BY t DESC, entity LIMIT 10)
    SELECT entity, author, author_revs, total_revs, CAST(author_revs AS DOUBLE) / total_revs AS share FROM eff WHERE entity IN (FROM best)""",
    "fractal_topn",
)(lambda spark, d: S.author_shares(table("entity-effort", order_history(spark, d)), 10))


def with_documents(facts: DataFrame) -> DataFrame:
    """Some parts as documents, so that both kinds of files occur."""
    return facts.withColumn("entity", F.when(F.col("entity").rlike("[37]$"), F.concat("entity", F.lit(".md"))).otherwise(F.concat("entity", F.lit(".py"))))


MIXED = "mixed AS (SELECT * REPLACE (entity || CASE WHEN regexp_matches(entity, '[37]$') THEN '.md' ELSE '.py' END AS entity) FROM facts), code AS (SELECT * FROM mixed WHERE entity NOT LIKE '%.md')"
query(
    f"""$FACTS, {MIXED}, r AS (SELECT CASE WHEN entity LIKE '%.md' THEN 'other' ELSE 'code' END AS kind, entity, count(DISTINCT rev) AS n_revs FROM mixed GROUP BY entity),
    n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n_revs DESC, entity) AS k FROM r) SELECT kind, entity, n_revs FROM n WHERE k <= CASE kind WHEN 'code' THEN 12 ELSE 6 END""",
    "digest_hotspots",
)(lambda spark, d: S.hotspots(table("revisions", with_documents(order_history(spark, d)))))
query(f"$FACTS, {PAIRS} SELECT * FROM coupling ORDER BY degree DESC, average_revs DESC, entity, coupled LIMIT 12", "digest_coupling")(lambda spark, d: S.strongest_coupling(table("coupling", order_history(spark, d), **LOW)))
query(
    f"""$FACTS, {MIXED}, o AS (SELECT entity, author, sum(loc_added) AS v FROM code GROUP BY entity, author),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY v DESC, author) AS n, sum(v) OVER (PARTITION BY entity) AS t FROM o),
    m AS (SELECT author AS main_dev, {centi("CAST(v AS DOUBLE) / greatest(t, 1)")} AS ownership FROM r WHERE n = 1), t AS (SELECT count(*) FILTER (ownership >= 0.999) AS whole, count(*) AS "of" FROM m)
    SELECT main_dev, files, whole, "of" FROM (SELECT main_dev, count(*) AS files FROM m GROUP BY main_dev ORDER BY files DESC, main_dev LIMIT 8), t""",
    "digest_owners",
)(lambda spark, d: S.owners(table("main-developer", with_documents(order_history(spark, d)))))
AGES = f"""last AS (SELECT entity, max(CAST(date AS DATE)) AS d FROM code GROUP BY entity),
    ages AS (SELECT entity, (year(DATE '{NOW}') - year(d)) * 12 + month(DATE '{NOW}') - month(d) - CASE WHEN day(DATE '{NOW}') < day(d) THEN 1 ELSE 0 END AS age_months FROM last)"""
query(
    f"""$FACTS, {MIXED}, {AGES}, n AS (SELECT age_months, row_number() OVER (ORDER BY age_months) - 1 AS i, count(*) OVER () AS c FROM ages)
    SELECT min(age_months) AS "min", max(age_months) FILTER (i = c // 2) AS median, max(age_months) AS "max" FROM n""",
    "digest_age_stats",
)(lambda spark, d: S.age_statistics(table("code-age", with_documents(order_history(spark, d)), time_now=NOW)))
query(f"$FACTS, {MIXED}, {AGES} SELECT entity, age_months FROM ages ORDER BY age_months DESC, entity LIMIT 5", "digest_oldest")(lambda spark, d: S.oldest(table("code-age", with_documents(order_history(spark, d)), time_now=NOW)))
query(
    """$FACTS, c AS (SELECT date, sum(loc_added) AS a, sum(loc_deleted) AS x FROM facts GROUP BY date)
    SELECT count(*) AS periods, CAST(sum(a) AS BIGINT) AS added, CAST(sum(x) AS BIGINT) AS deleted, round(CAST(sum(a) AS DOUBLE) / CAST(sum(x) AS DOUBLE), 2) AS ratio, (SELECT date FROM c ORDER BY a + x DESC, date LIMIT 1) AS spike_date FROM c""",
    "digest_churn",
)(lambda spark, d: S.churn_totals(table("absolute-churn", order_history(spark, d))))
query(
    f"$FACTS, {COMMUNICATION} SELECT *, (SELECT count(DISTINCT author) FROM communication) AS people FROM communication ORDER BY strength DESC, author DESC, peer DESC LIMIT 8",
    "digest_communication",
)(lambda spark, d: S.strongest_ties(table("communication", team_facts(spark, d))))
STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(S.STOP_WORDS))
query(
    f"""$FACTS, m AS (SELECT rev, max_by(message, ord) AS message FROM facts GROUP BY rev), t AS (SELECT unnest(regexp_extract_all(lower(message), '[a-z][a-z0-9_-]{{2,}}')) AS term FROM m)
    SELECT term, count(*) AS n FROM t WHERE term NOT IN ({STOP_SQL}) GROUP BY term ORDER BY n DESC, term LIMIT 20""",
    "commit_vocabulary",
)(lambda spark, d: S.vocabulary(order_history(spark, d)))
query(
    r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) AS line FROM documents),
    f AS (SELECT doc_id, length(replace(regexp_extract(line, '^\s*'), chr(9), '        ')) / 4.0::DOUBLE AS c FROM l WHERE trim(regexp_replace(line, '\s', ' ', 'g')) <> '')
    SELECT d.doc_id, count(c) AS lines, round(coalesce(sum(c), 0), 2) AS complexity FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""",
    "complexity_trend",
)(lambda spark, d: S.complexity_trend(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text"))
query(
    """$FACTS, l AS (SELECT strftime(max(CAST(date AS DATE)) - INTERVAL 12 MONTH, '%Y-%m-%d') AS s FROM facts) SELECT entity, count(DISTINCT rev) AS n_revs FROM facts, l WHERE date > s GROUP BY entity""",
    "trailing_window",
)(lambda spark, d: table("revisions", trailing(order_history(spark, d), 12)))
query(
    f"""$FACTS, {STRUCTURE}, best AS (SELECT entity, count(DISTINCT rev) AS n_revs FROM facts GROUP BY entity ORDER BY n_revs DESC, entity LIMIT 40)
    SELECT entity, n_revs FROM best WHERE entity IN (SELECT entity FROM structure)""",
    "hotspot_candidates",
)(lambda spark, d: S.hotspot_candidates(table("revisions", order_history(spark, d)), structure(spark, d), 40))
query("$FACTS SELECT CAST(sum(a) AS BIGINT) AS added FROM (SELECT sum(loc_added) AS a FROM facts GROUP BY entity)", "guarded_sum")(lambda spark, d: S.sum_for_value(table("entity-churn", order_history(spark, d)), "added"))
query(f"$FACTS, {COMMUNICATION.replace('FROM teams)', 'FROM facts)')} SELECT * FROM communication", "communication_people")(lambda spark, d: table("communication", order_history(spark, d)))
query(
    f"$FACTS, {PAIRS} SELECT entity AS source, coupled AS target, degree AS value FROM coupling WHERE degree >= 6",
    "coupling_graph_links",
)(lambda spark, d: S.coupling_graph(table("coupling", order_history(spark, d), **LOW), None, 6)[1])
query(f"$FACTS, {COMMUNICATION} SELECT author AS source, peer AS target, strength AS value FROM communication WHERE strength >= 50", "network_links")(
    lambda spark, d: S.people_network(table("communication", team_facts(spark, d)), 50)[1]
)
query(
    f"""$FACTS, {MIXED}, o AS (SELECT entity, author, count(*) AS n FROM code GROUP BY entity, author), t AS (SELECT entity, CAST(sum(n) AS BIGINT) AS t, list(n ORDER BY author) AS ns FROM o GROUP BY entity),
    f AS (SELECT entity, {centi("1 - list_reduce([(CAST(n AS DOUBLE) / t) * (CAST(n AS DOUBLE) / t) FOR n IN ns], lambda a, b: a + b, CAST(0 AS DOUBLE))")} AS fractal_value, t AS total_revs FROM t)
    SELECT * FROM f ORDER BY fractal_value DESC, total_revs DESC, entity LIMIT 8""",
    "digest_fragmentation",
)(lambda spark, d: S.most_fragmented(table("fragmentation", with_documents(order_history(spark, d)))))
query(
    f"""$FACTS, m AS (SELECT rev, max_by(message, ord) AS message FROM facts GROUP BY rev), t AS (SELECT unnest(regexp_extract_all(lower(message), '[a-z][a-z''+-]+')) AS term FROM m)
    SELECT term, count(*) AS n FROM t WHERE length(term) >= 3 AND term NOT IN ({STOP_SQL}) GROUP BY term""",
    "commit_cloud",
)(lambda spark, d: S.word_cloud(order_history(spark, d)))


def with_generated(facts: DataFrame) -> DataFrame:
    """Some parts under the names of vendored and generated files."""
    e = F.col("entity")
    return facts.withColumn("entity", F.when(e.endswith("0"), F.concat(F.lit("lib/vendor/"), e)).when(e.endswith("1"), F.concat(e, F.lit(".min.js"))).when(e.endswith("2"), F.concat(e, F.lit("/package-lock.json"))).otherwise(e))


query("$FACTS SELECT entity, count(DISTINCT rev) AS n_revs FROM facts WHERE NOT regexp_matches(entity, '[012]$') GROUP BY entity", "generated_excludes")(
    lambda spark, d: table("revisions", filter_paths(with_generated(order_history(spark, d)), exclude=GENERATED))
)


# ---- sources and sinks: written to the shared folder from the tables, and read back


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def order_commits(spark: SparkSession, d: str) -> DataFrame:
    """All orders as commits, those without lines too."""
    orders, people = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet")
    own = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    return own.select(F.lower(F.hex("o_orderkey")).alias("rev"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("c_name").alias("author"), F.col("o_orderpriority").alias("message"))


def order_log(spark: SparkSession, d: str, facts: DataFrame | None = None) -> str:
    path = scratch(spark, "log")
    write_log(order_history(spark, d) if facts is None else facts, path, order_commits(spark, d))
    return path


@query("""$FACTS SELECT entity, rev, date, author, message, loc_added, loc_deleted, "binary" FROM facts""")
def log_source(spark: SparkSession, d: str) -> DataFrame:
    """The history written as a log and parsed in parallel."""
    return read_log(spark, order_log(spark, d)).select("entity", "rev", "date", "author", "message", "loc_added", "loc_deleted", "binary")


@query("SELECT min(date) AS first, max(date) AS last, count(DISTINCT date) AS days FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders JOIN customer ON o_custkey = c_custkey)")
def active_window(spark: SparkSession, d: str) -> DataFrame:
    """Over the log's preludes, those of commits without files too."""
    return S.active_window(preludes(spark, order_log(spark, d)))


@query(
    """$FACTS, x AS (SELECT *, CASE WHEN loc_added % 7 = 3 AND NOT "binary" THEN 'control' WHEN loc_deleted % 5 = 4 AND NOT "binary" THEN 'parse' END AS bad FROM facts)
    SELECT CASE bad WHEN 'control' THEN 'invalid_control_char' ELSE 'parse_error' END AS error, count(*) AS lines, CAST(count(DISTINCT rev) AS BIGINT) AS entries,
    arg_min(CASE WHEN bad = 'control' THEN loc_added || chr(9) || loc_deleted || chr(9) || entity || chr(7) ELSE loc_added || chr(9) || loc_deleted END, ord) AS first_line FROM x WHERE bad IS NOT NULL GROUP BY 1"""
)
def log_errors(spark: SparkSession, d: str) -> DataFrame:
    """What the parser says of a log in which some lines hold a control character or have no path."""
    facts, path = order_history(spark, d), scratch(spark, "broken-log")
    write_log(facts, path, order_commits(spark, d))
    f = F.split("value", "\t", 3)
    count = lambda i: F.get(f, F.lit(i)).try_cast("bigint")
    entry = ~F.col("value").startswith("--") & (F.size(f) == 3)
    broken = F.when(entry & (count(0) % 7 == 3), F.concat("value", F.lit("\x07"))).when(entry & (count(1) % 5 == 4), F.concat_ws("\t", F.get(f, F.lit(0)), F.get(f, F.lit(1)))).otherwise(F.col("value"))
    lines = read_lines(spark, path).withColumn("value", broken)
    found = parsed(numbered(lines)).where("error IS NOT NULL")
    return found.groupBy("error").agg(F.count("*").alias("lines"), F.countDistinct("entry").alias("entries"), F.min_by("value", "ord").alias("first_line"))


@query(f"WITH {STRUCTURE} SELECT entity, loc FROM structure")
def structure_source(spark: SparkSession, d: str) -> DataFrame:
    """The parts written as documents of languages with their files, of a brand's some thousand at most each, and read as a structure."""
    slices = F.pmod(F.xxhash64("p_partkey"), F.lit(max(1, spark.read.parquet(f"{d}/part.parquet").count() // 100_000)))
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand"), slices.alias("slice"), F.concat(F.lit("./src/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/part"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") * F.col("p_size")).cast("bigint").alias("code"))
    reports = parts.groupBy("p_brand", "slice").agg(F.collect_list(F.struct("name", F.struct("code").alias("stats"))).alias("reports"))
    path = scratch(spark, "structure")
    whole = F.create_map(F.col("p_brand"), F.struct("reports"), F.lit("Total"), F.struct("reports"))
    reports.select(F.concat_ws("-", "p_brand", "slice").alias("of"), F.to_json(whole).alias("value")).write.partitionBy("of").text(path)
    return read_structure(spark, path)


@query("$FACTS SELECT entity, count(DISTINCT author) AS n_authors, count(*) AS n_revs FROM facts GROUP BY entity ORDER BY n_authors DESC, n_revs DESC, entity LIMIT 25")
def envelope_source(spark: SparkSession, d: str) -> DataFrame:
    """A limited result as its envelope, written and read back."""
    path = scratch(spark, "envelope")
    spark.createDataFrame([(run("authors", order_history(spark, d), rows=25).json(),)], "value string").coalesce(1).write.text(path)
    return read_envelope(spark, path, lookup("authors").table(order_history(spark, d).limit(0)).schema)


@query("$FACTS SELECT entity, author, CAST(sum(loc_added) AS BIGINT) AS added, CAST(sum(loc_deleted) AS BIGINT) AS deleted FROM facts GROUP BY entity, author")
def stored_result(spark: SparkSession, d: str) -> DataFrame:
    """A result whose rows tasks write, read back."""
    path = scratch(spark, "result")
    store("entity-ownership", order_history(spark, d), path)
    return spark.read.parquet(f"{path}/rows")


@query("$FACTS SELECT entity, count(*) AS n_revs FROM facts GROUP BY entity ORDER BY count(DISTINCT author) DESC, n_revs DESC, entity LIMIT 25")
def fields_source(spark: SparkSession, d: str) -> DataFrame:
    """A limited result projected to two fields as JSON, written and read back."""
    path = scratch(spark, "fields")
    spark.createDataFrame([(run("authors", order_history(spark, d), rows=25).json("rows.entity,rows.n_revs"),)], "value string").coalesce(1).write.text(path)
    return read_envelope(spark, path, lookup("authors").table(order_history(spark, d).limit(0)).select("entity", "n_revs").schema)


query(
    f"""$FACTS, {coupling_sql(30, 5, 5, 30)} SELECT (SELECT count(*) FROM g) AS candidate_pairs, max(CAST(floor(deg) AS BIGINT)) AS max_degree, max(shared) AS max_shared_revs, max(CAST(floor(avg) AS BIGINT)) AS max_average_revs,
    concat_ws(',', CASE WHEN max(floor(avg)) < 5 THEN 'min-revs' END, CASE WHEN max(shared) < 5 THEN 'min-shared-revs' END, CASE WHEN max(floor(deg)) < 30 THEN 'min-coupling' END) AS blocking FROM g""",
    "coupling_all_filtered",
)(lambda spark, d: filtered_row(spark, all_filtered(order_history(spark, d))))


def filtered_row(spark: SparkSession, why: dict) -> DataFrame:
    """The numbers of the warning that no pair reached the thresholds."""
    seen = why["observed"]
    return spark.createDataFrame([(why["candidate_pairs"], seen["max_degree"], seen["max_shared_revs"], seen["max_average_revs"], ",".join(why["blocking"]))], "candidate_pairs long, max_degree long, max_shared_revs long, max_average_revs long, blocking string")


LAYER_FILE = "\n".join(f"{p} => {n}" for p, n in LAYERS)
query(f"$FACTS, {LAYERED} SELECT entity, count(DISTINCT rev) AS n_revs FROM grouped GROUP BY entity", "layers_file")(
    lambda spark, d: table("revisions", group_layers(order_history(spark, d), parse_layers(LAYER_FILE)))
)


@query(
    f"""$FACTS, {TEAMS}, regions AS (SELECT t.entity, r_name AS author, t.loc_added, t.loc_deleted, t.rev FROM teams t JOIN nation ON n_name = t.author JOIN region ON n_regionkey = r_regionkey)
    SELECT author, CAST(sum(loc_added) AS BIGINT) AS added, CAST(sum(loc_deleted) AS BIGINT) AS deleted, count(DISTINCT rev) AS commits FROM regions GROUP BY author"""
)
def teams_file(spark: SparkSession, d: str) -> DataFrame:
    """Nations as authors, and their regions as teams in a definition file: 25 lines at any size."""
    nations, regions = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    pairs = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()
    teams = parse_teams("\n".join(["Author, Team", *(f'"{a}",{t}' for a, t in pairs)]))
    return table("author-churn", map_teams(team_facts(spark, d), teams))


@query("$FACTS SELECT entity, author, CAST(sum(loc_added) AS BIGINT) AS added, CAST(sum(loc_deleted) AS BIGINT) AS deleted FROM facts GROUP BY entity, author")
def stream_ownership(spark: SparkSession, d: str) -> DataFrame:
    """The history as files that arrive, and sums kept as state; a batch writes the rows that it changes."""
    return ended(streams.ownership(arrived(spark, d)), "update", scratch(spark, "stream-result"), "entity", "author")


PARTS = "parts AS (SELECT 'part' || l_partkey AS entity, lower(hex(l_orderkey)) AS rev, strftime(o_orderdate, '%Y-%m-%d') || '-' || lpad(hex(l_orderkey), 16, '0') AS ord, l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(
    f"""WITH RECURSIVE {PARTS},
    n AS (SELECT count(*) AS n FROM part),
    renames AS (SELECT 'part' || min(l_partkey) AS old, 'part' || ((min(l_partkey) * 7 + 3) % any_value(n) + 1) AS new, ord AS place FROM parts, n WHERE l_orderkey % 3 = 0 GROUP BY ord),
    links AS (SELECT a.place, min(b.place) AS nxt FROM renames a LEFT JOIN renames b ON b.old = a.new AND b.place > a.place GROUP BY a.place),
    walks AS (SELECT place AS start, place AS here FROM renames UNION ALL SELECT start, nxt FROM walks JOIN links ON links.place = walks.here WHERE nxt IS NOT NULL),
    ends AS (SELECT start, arg_max(new, here) AS final FROM walks JOIN renames ON renames.place = walks.here GROUP BY start),
    met AS (SELECT p.entity AS path, p.rev, min(r.place) AS place FROM parts p LEFT JOIN renames r ON r.old = p.entity AND r.place >= p.ord GROUP BY p.entity, p.rev, p.ord)
    SELECT coalesce(final, path) AS entity, count(DISTINCT rev) AS n_revs, count(DISTINCT path) AS n_names FROM met LEFT JOIN ends ON ends.start = met.place GROUP BY 1"""
)
def renamed_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files; each third order gives its first part the name of another, so names end, come back and chain."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    at = F.concat_ws("-", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.hex("l_orderkey"), 16, "0"))
    facts = lines.select(F.concat(F.lit("part"), F.col("l_partkey")).alias("entity"), F.lower(F.hex("l_orderkey")).alias("rev"), at.alias("ord"))
    n = t("part").count()
    first = lines.where("l_orderkey % 3 = 0").groupBy(at.alias("at")).agg(F.min("l_partkey").alias("p"))
    changes = first.select(F.concat(F.lit("part"), F.col("p")).alias("old"), F.concat(F.lit("part"), (F.col("p") * 7 + 3) % n + 1).alias("new"), "at")
    return R.renamed(facts, changes).groupBy("entity").agg(F.countDistinct("rev").alias("n_revs"), F.countDistinct("path").alias("n_names"))


@query("$FACTS SELECT author, count(DISTINCT rev) AS commits, count(*) AS files, CAST(sum(loc_added) AS BIGINT) AS added FROM facts WHERE date >= '1996-01-01' AND date < '1997-01-01' GROUP BY author")
def log_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A year of the log, read by ranges of bytes: the dates are looked at in the entries' heads."""
    path = scratch(spark, "ranged-log")
    write_log(order_history(spark, d), path, order_commits(spark, d))
    register(spark)
    year = spark.read.format("gitlog").option("range_bytes", 1 << 20).load(path).where("date >= '1996-01-01' AND date < '1997-01-01'")
    return year.groupBy("author").agg(F.countDistinct("rev").alias("commits"), F.count("*").alias("files"), F.sum("loc_added").alias("added"))


@query("$FACTS SELECT entity, count(*) AS n_revs FROM facts GROUP BY entity ORDER BY count(DISTINCT author) DESC, n_revs DESC, entity LIMIT 200")
def emitted_fields(spark: SparkSession, d: str) -> DataFrame:
    """A limited and projected result whose rows tasks write and whose envelope the commit writes."""
    path = scratch(spark, "emitted")
    emit("authors", order_history(spark, d), path, rows=200, fields="rows.entity,rows.n_revs")
    return read_result(spark, path)


@query("$FACTS SELECT entity, author, count(*) AS author_revs, CAST(sum(count(*)) OVER (PARTITION BY entity) AS BIGINT) AS total_revs FROM facts GROUP BY entity, author")
def emitted_effort(spark: SparkSession, d: str) -> DataFrame:
    """A result of as many rows as entities and their people, written alike and read by the columns that its envelope names."""
    path = scratch(spark, "emitted")
    emit("entity-effort", order_history(spark, d), path)
    return read_result(spark, path)


# Of every analysis that counts: its table as (analysis, first key, second key, three numbers).
TALL = {
    "authors": ("entity", None, "n_authors", "n_revs", None),
    "revisions": ("entity", None, "n_revs", None, None),
    "summary": ("statistic", None, "value", None, None),
    "absolute-churn": ("date", None, "added", "deleted", "commits"),
    "author-churn": ("author", None, "added", "deleted", "commits"),
    "entity-churn": ("entity", None, "added", "deleted", "commits"),
    "entity-ownership": ("entity", "author", "added", "deleted", None),
    "main-developer": ("entity", "main_dev", "added", "total_added", "ownership"),
    "refactoring-main-developer": ("entity", "main_dev", "removed", "total_removed", "ownership"),
    "main-developer-by-revisions": ("entity", "main_dev", "added", "total_added", "ownership"),
    "entity-effort": ("entity", "author", "author_revs", "total_revs", None),
    "fragmentation": ("entity", None, "fractal_value", "total_revs", None),
}


def tall_sql() -> str:
    """One statement over the analyses' own SQL."""
    parts = []
    for name, columns in TALL.items():
        picked = ", ".join(f"CAST({c or 'NULL'} AS {'VARCHAR' if i < 2 else 'DOUBLE'}) AS {n}" for i, (c, n) in enumerate(zip(columns, ("k1", "k2", "x1", "x2", "x3"))))
        parts.append(f"SELECT '{name}' AS analysis, {picked} FROM ({ORACLE_SQL[name.replace('-', '_')]})")
    return " UNION ALL ".join(parts)


@query(tall_sql())
def batch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Twelve analyses from one lattice of counts, which shuffles the history twice, and its people once more by entity."""
    out = None
    for name, table_ in counted(order_history(spark, d)).items():
        picked = [(F.col(c) if c else F.lit(None)).cast("string" if i < 2 else "double").alias(n) for i, (c, n) in enumerate(zip(TALL[name], ("k1", "k2", "x1", "x2", "x3")))]
        rows = table_.select(F.lit(name).alias("analysis"), *picked)
        out = rows if out is None else out.unionByName(rows)
    return out


FILE_ROWS = 1_000_000
BATCHES = 4  # at least three files and batches; a batch's tasks share its files, so larger ones take no more memory, and each batch opens all of the state's parts


def arrived(spark: SparkSession, d: str) -> DataFrame:
    """The history as a stream of files, in no order: rows are dealt to them by a hash."""
    source = scratch(spark, "stream")
    facts = order_history(spark, d).withColumn("ord", F.xxhash64("ord"))
    files = max(3, -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // FILE_ROWS))
    facts.repartition(files, "ord").write.parquet(source)
    return streams.read_facts(spark, source, -(-files // BATCHES))


def ended(df: DataFrame, mode: str, out: str, *keys: str) -> DataFrame:
    """What a stream has written when all that is there has been read; in update mode the last row of each of ``keys``."""
    spark = df.sparkSession
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True)
    with streams.state_on_disk(spark):
        running = writer.format("parquet").start(out) if mode == "append" else writer.foreachBatch(streams.keep_batch(out)).start()
    running.awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(out)
    return streams.newest(spark.read.schema(df.schema.add("batch", "long")).parquet(out), *keys)


@query("$FACTS SELECT entity, count(DISTINCT author) AS n_authors, count(DISTINCT (date, rev, author, message, loc_added, loc_deleted, \"binary\")) AS n_revs FROM facts GROUP BY entity")
def stream_authors(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct counts over files that arrive in any order; rows that are alike in everything count once."""
    return ended(streams.authors(arrived(spark, d)), "update", scratch(spark, "stream-result"), "entity")


@query(f"$FACTS, {coupling_sql(4, 1, 2, 5)} SELECT * FROM coupling")
def stream_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Coupling over files that arrive in any order: commits grow over the limit of four after their pairs were counted."""
    changes = ended(streams.pair_changes(arrived(spark, d), 4), "append", scratch(spark, "stream-pairs"))
    return streams.coupled(changes, min_revs=1, min_shared_revs=2, min_coupling=5)


BY_PEOPLE = "people AS (SELECT f.* REPLACE ('home/' || lower(replace(author, '#', '/')) || '/' || regexp_replace(f.entity, '^src/', '') AS entity) FROM facts f)"


@query(
    f"""$FACTS, {BY_PEOPLE}, rules AS (SELECT c_custkey AS place, 'home/' || lower(replace(c_name, '#', '/')) AS folder, c_mktsegment AS name FROM customer WHERE c_custkey % 3 > 0
      UNION ALL SELECT 1000000000 + c_custkey, 'home/' || lower(replace(c_name, '#', '/')) || '/brand13', 'late' FROM customer WHERE c_custkey % 2 = 0),
    folders AS (SELECT entity, rev, array_to_string(parts[1:d], '/') AS folder FROM (SELECT entity, rev, parts, unnest(range(1, len(parts))) AS d FROM (SELECT entity, rev, string_split(entity, '/') AS parts FROM people))),
    hits AS (SELECT entity, rev, arg_min(name, place) AS layer FROM folders JOIN rules USING (folder) GROUP BY entity, rev)
    SELECT layer AS entity, count(DISTINCT rev) AS n_revs FROM hits GROUP BY layer"""
)
def group_many_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule for two of three people and one more for each second, as a table: their number grows with the people's."""
    facts = order_history(spark, d)
    home = lambda c: F.concat(F.lit("home/"), F.lower(F.replace(c, F.lit("#"), F.lit("/"))))
    people = facts.withColumn("entity", F.concat_ws("/", home(F.col("author")), F.regexp_replace("entity", "^src/", "")))
    customers = spark.read.parquet(f"{d}/customer.parquet")
    own = customers.where("c_custkey % 3 > 0").select(F.col("c_custkey").cast("long").alias("place"), home(F.col("c_name")).alias("folder"), F.col("c_mktsegment").alias("name"))
    late = customers.where("c_custkey % 2 = 0").select((F.col("c_custkey") + 1_000_000_000).cast("long").alias("place"), F.concat(home(F.col("c_name")), F.lit("/brand13")).alias("folder"), F.lit("late").alias("name"))
    return table("revisions", in_folders(people, own.unionByName(late)))


@query("$FACTS SELECT entity, count(DISTINCT rev) AS n_revs FROM facts WHERE regexp_matches(entity, '^src/brand2[^/]/part[^/]*$') OR regexp_matches(entity, '^src/brand55(/.*)?$') GROUP BY entity")
def filter_pushed(spark: SparkSession, d: str) -> DataFrame:
    """A stored history, sorted by path: the globs' plain starts reach the scan."""
    path = scratch(spark, "sorted-facts")
    order_history(spark, d).drop("ord").repartitionByRange("entity").sortWithinPartitions("entity").write.parquet(path)
    return table("revisions", filter_paths(spark.read.parquet(path), ["src/brand2?/part*", "src/brand55/**"]))


@query(
    f"""WITH {STRUCTURE}, nodes AS (SELECT path, depth, count(*) AS files, CAST(sum(loc) AS BIGINT) AS size FROM (SELECT CASE WHEN d = 0 THEN '' ELSE array_to_string(parts[1:d], '/') END AS path, d AS depth, loc
      FROM (SELECT string_split(entity, '/') AS parts, unnest(range(0, len(string_split(entity, '/')) + 1)) AS d, loc FROM structure)) GROUP BY path, depth),
    places AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN path = '' THEN [] ELSE string_split(path, '/') END) - 1 AS "left" FROM nodes),
    inside AS (SELECT above, count(*) AS n FROM (SELECT CASE WHEN d = 0 THEN '' ELSE array_to_string(string_split(path, '/')[1:d], '/') END AS above FROM (SELECT path, unnest(range(0, depth)) AS d FROM nodes)) GROUP BY above)
    SELECT path, depth, "left", "left" + coalesce(n, 0) AS "right", files, size FROM places LEFT JOIN inside ON above = path"""
)
def tree_intervals(spark: SparkSession, d: str) -> DataFrame:
    return S.intervals(structure(spark, d), "loc")


@query("$FACTS SELECT entity, author, count(*) AS author_revs, CAST(sum(count(*)) OVER (PARTITION BY entity) AS BIGINT) AS total_revs FROM facts GROUP BY entity, author")
def envelope_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A result as JSON envelopes of some ten thousand rows each, read by ranges of bytes without a schema."""
    path, facts = scratch(spark, "envelopes"), order_history(spark, d)
    head = encode({k: v for k, v in run("entity-effort", facts.limit(0)).envelope().items() if k not in ("rows", "row_count")})
    slices = max(1, spark.read.parquet(f"{d}/lineitem.parquet").count() // 10_000)
    dealt = table("entity-effort", facts).groupBy(F.pmod(F.xxhash64("entity", "author"), F.lit(slices)).alias("of")).agg(F.collect_list(F.struct("entity", "author", "author_revs", "total_revs")).alias("rows"))
    whole = F.concat(F.lit(head[:-1] + ',"row_count":'), F.size("rows").cast("string"), F.lit(',"rows":'), F.to_json("rows"), F.lit("}"))
    dealt.select("of", whole.alias("value")).write.partitionBy("of").text(path)
    return read_envelope(spark, path, ranges=4)


def outcome(spark: SparkSession, d: str, name: str, fn: Callable[[], Result | dict]) -> tuple:
    """(run, code, exit_code, row_count, total_count, record) of one run: what it says of itself, or the error it ends with."""
    try:
        r = fn()
        e = r if isinstance(r, dict) else r.envelope()
        record = ";".join([*(f"{k}={encode(v)}" for k, v in e.get("transforms", {}).items()), *(f"{k}={encode(v)}" for k, v in e.get("params", {}).items())])
        return name, "ok", 0, e["row_count"], e.get("total_count", e["row_count"]), record
    except SiltError as e:
        return name, e.code, e.exit_code, 0, 0, ""


@query(
    """$FACTS, n AS (SELECT count(DISTINCT entity) AS e, count(DISTINCT author) AS a FROM facts), m AS (SELECT count(*) AS e FROM (SELECT entity FROM facts WHERE entity LIKE 'src/brand1%' GROUP BY entity))
    SELECT run, code, CAST(exit_code AS INT) AS exit_code, CAST(row_count AS BIGINT) AS row_count, CAST(total_count AS BIGINT) AS total_count, record FROM n, m, LATERAL (VALUES
      ('all', 'ok', 0, n.e, n.e, ''), ('first ten', 'ok', 0, 10, n.e, ''), ('some', 'ok', 0, m.e, m.e, 'include=["src/brand1*/**"]'), ('layers and teams', 'ok', 0, 1, 1, 'group=true;team_map=true'),
      ('no rows', 'ok', 0, 0, 0, ''), ('no log', 'empty_log', 65, 0, 0, ''),
      ('no counts', 'missing_metrics', 65, 0, 0, ''), ('no subjects', 'missing_messages', 65, 0, 0, ''), ('no expression', 'missing_required_flag', 64, 0, 0, ''), ('bad expression', 'invalid_expression', 64, 0, 0, ''),
      ('bad glob', 'invalid_glob', 64, 0, 0, ''), ('bad rule', 'invalid_group', 64, 0, 0, ''), ('bad period', 'invalid_temporal_period', 64, 0, 0, ''), ('bad dates', 'invalid_temporal_date', 65, 0, 0, ''),
      ('bad day', 'invalid_time_now', 64, 0, 0, ''), ('bad field', 'invalid_field', 64, 0, 0, ''), ('bad name', 'unknown_command', 64, 0, 0, ''), ('bad flag', 'unknown_flag', 64, 0, 0, '')) AS v(run, code, exit_code, row_count, total_count, record)"""
)
def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Runs over the history and over broken forms of it: their codes, exit codes, counts and records of transforms.

    The history is written once and read again by the columns that each run needs.  Results of as many rows as entities are written by tasks, and what they say of themselves is read back.
    """
    facts = kept(order_history(spark, d).drop("ord"), "outcomes").withColumn("ord", order_key())
    blank = scratch(spark, "blank-log")
    facts.limit(0).select(F.lit("").alias("value")).write.text(blank)

    once = partial(run, keep=False)  # the facts lie in files

    def stored(*args) -> dict:
        path = scratch(spark, "outcome")
        store(args[0], args[1], path, *args[2:], keep=False)
        return json.loads(spark.read.text(f"{path}/envelope").first()[0])

    def fields() -> Result:
        r = once("authors", facts, rows=1)
        r.json("rows.nothing")
        return r

    cases: dict[str, Callable[[], Result]] = {
        "all": lambda: stored("revisions", facts),
        "first ten": lambda: once("authors", facts, rows=10),
        "some": lambda: stored("revisions", facts, Transforms(include=["src/brand1*/**"])),
        "layers and teams": lambda: once("revisions", facts, Transforms(layers=[layer("src", "all")], teams=nation_teams(spark, d))),
        "no rows": lambda: once("entity-churn", facts.limit(0)),
        "no log": lambda: once("authors", read_log(spark, blank)),
        "no counts": lambda: once("entity-churn", facts.withColumn("has_loc", F.lit(False))),
        "no subjects": lambda: once("messages", facts.withColumn("message", F.lit("-")), expression="x"),
        "no expression": lambda: once("messages", facts),
        "bad expression": lambda: once("messages", facts, expression="(?=x)"),
        "bad glob": lambda: once("authors", facts, Transforms(include=["src/{a"])),
        "bad rule": lambda: once("authors", facts, Transforms(layers=[layer("^(", "x")])),
        "bad period": lambda: once("authors", temporal_windows(facts, -1)),
        "bad dates": lambda: once("authors", facts.withColumn("date", F.replace("date", F.lit("-01-"), F.lit("-13-"))), Transforms(period=2)),
        "bad day": lambda: once("code-age", facts, time_now="2002-02-30"),
        "bad field": fields,
        "bad name": lambda: once("nothing", facts),
        "bad flag": lambda: once("authors", facts, nothing=1),
    }
    rows = [outcome(spark, d, name, fn) for name, fn in cases.items()]
    return spark.createDataFrame(rows, "run string, code string, exit_code int, row_count long, total_count long, record string")


def roles_sql() -> str:
    """Per analysis that ``batch_counts`` has: its columns' roles, stated here, and its rows, counted by its own SQL."""
    roles = {
        "authors": "dimension,additive,additive", "revisions": "dimension,additive", "summary": "dimension,additive", "absolute-churn": "dimension,additive,additive,additive", "author-churn": "dimension,additive,additive,additive",
        "entity-churn": "dimension,additive,additive,additive", "entity-ownership": "dimension,dimension,additive,additive", "main-developer": "dimension,dimension,additive,additive,intensive",
        "refactoring-main-developer": "dimension,dimension,additive,additive,intensive", "main-developer-by-revisions": "dimension,dimension,additive,additive,intensive", "entity-effort": "dimension,dimension,additive,additive",
        "fragmentation": "dimension,intensive,additive",
    }
    return " UNION ALL ".join(f"SELECT '{n}' AS analysis, '{r}' AS roles, count(*) AS n FROM ({ORACLE_SQL[n.replace('-', '_')]})" for n, r in roles.items())


@query(roles_sql())
def schema_roles(spark: SparkSession, d: str) -> DataFrame:
    """What the described schema says of results that were run: each column's role, from the columns' own metadata, and how many rows there are."""
    out = None
    for name, table_ in counted(order_history(spark, d)).items():
        declared = {c["name"]: command_list()["aggregation_roles"][c["semantic"]] for c in command_schema(name)["row_schema"]}
        found = roles_of(table_.schema)
        if found != declared:
            raise ValueError(f"{name} declares {declared} and gives {found}")
        rows = table_.agg(F.lit(name).alias("analysis"), F.lit(",".join(found.values())).alias("roles"), F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


# What each result is drawn as: library, template, channel=column.
DRAWN = {
    "authors": ("vegalite", "Scatter Plot", "x=n_revs y=n_authors"),
    "revisions": ("vegalite", "Bar Chart", "x=entity y=n_revs"),
    "summary": ("vegalite", "KPI Card", "metric=statistic value=value"),
    "absolute-churn": ("vegalite", "Stacked Bar Chart", "x=date y=added,deleted"),
    "author-churn": ("vegalite", "Bar Chart", "x=author y=added"),
    "entity-churn": ("vegalite", "Bar Chart", "x=entity y=added"),
    "entity-ownership": ("vegalite", "Bar Chart", "x=entity y=added color=author"),
    "main-developer": ("vegalite", "Bar Chart", "x=entity y=ownership color=main_dev"),
    "refactoring-main-developer": ("vegalite", "Bar Chart", "x=entity y=ownership color=main_dev"),
    "main-developer-by-revisions": ("vegalite", "Bar Chart", "x=entity y=ownership color=main_dev"),
    "entity-effort": ("vegalite", "Bar Chart", "x=entity y=author_revs color=author"),
    "fragmentation": ("vegalite", "Bar Chart", "x=entity y=fractal_value"),
}


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS analysis, '{l}' AS library, '{t}' AS template, '{c}' AS channels, count(*) AS marks FROM ({ORACLE_SQL[n.replace('-', '_')]})" for n, (l, t, c) in DRAWN.items()
    )
)
def chart_specs(spark: SparkSession, d: str) -> DataFrame:
    """The chart of each result, from its columns' meanings, and how many marks it has."""
    out = None
    for name, table_ in counted(order_history(spark, d)).items():
        spec = chart_spec(meanings_of(table_), name)
        channels = " ".join(f"{k}={','.join(v) if isinstance(v, list) else v}" for k, v in spec["channels"].items())
        rows = table_.agg(*[F.lit(x).alias(n) for n, x in (("analysis", name), ("library", spec["library"]), ("template", spec["template"]), ("channels", channels))], F.count("*").alias("marks"))
        out = rows if out is None else out.unionByName(rows)
    return out


DOCUMENT_TERMS = "t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}')) AS term FROM documents)"


def document_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Documents as commits: whole texts in the place of subjects."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("rev"), F.col("text").alias("message"), F.col("doc_id").alias("ord"))


query(f"WITH {DOCUMENT_TERMS} SELECT term, count(*) AS n FROM t WHERE term NOT IN ({STOP_SQL}) GROUP BY term ORDER BY n DESC, term LIMIT 200", "text_vocabulary")(
    lambda spark, d: S.vocabulary(document_subjects(spark, d), 200)
)
query(f"WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z''+-]+')) AS term FROM documents) SELECT term, count(*) AS n FROM t WHERE length(term) >= 3 AND term NOT IN ({STOP_SQL}) GROUP BY term", "text_cloud")(
    lambda spark, d: S.word_cloud(document_subjects(spark, d))
)
query(
    f"""$FACTS, {PAIRS}, {INVOLVED.format(a="entity", b="coupled", w="degree", s="coupling")}, best AS (SELECT k FROM inv ORDER BY t DESC, k LIMIT 40),
    ways AS (SELECT entity AS "row", coupled AS "column", entity AS a, coupled AS b, degree AS w FROM coupling UNION ALL SELECT coupled, entity, entity, coupled, degree FROM coupling),
    one AS (SELECT "row", "column", w, row_number() OVER (PARTITION BY "row", "column" ORDER BY a DESC, b DESC, w DESC) AS n FROM ways)
    SELECT "row", "column", CAST(w AS DOUBLE) AS weight FROM one WHERE n = 1 AND "row" IN (FROM best) AND "column" IN (FROM best)""",
    "pair_matrix_files",
)(lambda spark, d: S.pair_matrix(table("coupling", order_history(spark, d), **LOW), "entity", "coupled", "degree", 40))
