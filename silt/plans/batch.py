"""All analyses over one history, parsed once."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silt.functions.exprs import DAY, centi, centi_ratio
from silt.operators.counts import square
from silt.operators.transforms import filter_paths
from silt.registry import analyses, lookup
from silt.shared import kept, partitions

# Generated or vendored files that say nothing about people's work.
GENERATED = [
    "**/composer.lock", "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/Gemfile.lock", "**/poetry.lock", "**/go.sum", "**/vendor/**", "**/node_modules/**", "**/dist/**",
    "**/build/**", "**/generated/**", "**/*.min.js", "**/*.min.css", "**/*.postman_collection.json", "**/__snapshots__/**", "**/*.snap", "**/coverage/**", "**/storybook-static/**",
    "**/Migrations/**", "**/l10n/gen/**", "**/*.g.dart",
]
WHOLE = {"communication", "summary", "parse"}  # over generated files too
FULL_HISTORY = {"code-age"}


def trailing(facts: DataFrame, months: int = 12) -> DataFrame:
    """Commits after the day that lies ``months`` before the last one."""
    last = facts.agg(F.date_format(F.add_months(F.max(F.try_to_date("date", DAY)), -months), DAY).alias("__from"))
    return facts.join(F.broadcast(last), F.col("date") > F.col("__from")).drop("__from")  # last: one row


def run_all(facts: DataFrame, months: int = 12, exclude: list[str] = (), **options: dict) -> dict[str, DataFrame]:
    """A lazy sorted table for each analysis but ``messages``, which has no default expression; ``options`` has flags by analysis.

    The analyses that count come from one ``lattice`` of the history, which is written at once; the two histories are kept for the others; release them with ``unpersist``.
    """
    facts = facts.persist(StorageLevel.MEMORY_AND_DISK)
    recent = trailing(facts, months)
    authored, full = (filter_paths(x, exclude=[*GENERATED, *exclude]) for x in (recent, facts))
    out, tables = {}, counted(authored)
    for a in analyses():
        if a.name in tables and a.name not in WHOLE:
            out[a.name] = tables[a.name].orderBy(*a.order())
        elif a.name != "messages":
            source = recent if a.name in WHOLE else full if a.name in FULL_HISTORY else authored
            out[a.name] = a.run(source, **options.get(a.name.replace("-", "_"), {}))
    return out


# What the analyses below need of a history: for each set of keys the distinct combinations, with the rows, lines and commits of each.
LEVELS = [("entity", "author"), ("author", "date")]
STORED = 8 << 20  # bytes of stored input for each partition of what is dealt here


def lattice(facts: DataFrame) -> DataFrame:
    """(level, entity, author, date, n, added, deleted, commits, of_date, of_all), written: one row for each combination of keys in each of ``LEVELS``, numbered from 0.

    The facts are shuffled once, by commit.  There a commit's first row for each entity, person, day and for itself is marked, so distinct commits become sums of marks and need no
    name any more: ``commits`` summed over an entity's people (over a person's days), ``of_date`` over a day's people, ``of_all`` over all.  The first row of each (commit, person, day)
    carries the lines of all of them, so the second level gets a row a commit.  Both levels are grouped, with map-side sums, in the second and last shuffle of the history.
    Keys may be null; a commit that is counts as none, and its rows are dealt by entity.
    """
    lone = F.when(F.col("rev").isNull(), F.xxhash64("entity"))
    rows = facts.select("entity", "author", "rev", "date", "loc_added", "loc_deleted", lone.alias("lone")).repartition(partitions(facts, STORED), "rev", "lone")
    # One order serves commits, people and (person, day); entities and days have one each, so a task sorts its rows three times.
    within = lambda *by: Window.partitionBy("rev", "lone", *by).orderBy(*[c for c in ("author", "date", "entity") if c not in by])
    first = lambda *by: (F.col("rev").isNotNull() & (F.row_number().over(within(*by)) == 1)).cast("long")
    whole = within("author", "date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = rows.select(
        "entity", "author", "date", "loc_added", "loc_deleted", first("entity").alias("of_entity"), first("author").alias("of_author"), first("date").alias("of_date"), first().alias("of_all"),
        (F.row_number().over(within("author", "date")) == 1).alias("leads"), F.sum("loc_added").over(whole).alias("all_added"), F.sum("loc_deleted").over(whole).alias("all_deleted"),
    )
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    cell = lambda *values: F.struct(*[F.lit(v).alias(c) if isinstance(v, int) else v.alias(c) for c, v in zip(CELL, values)])
    owned = cell(0, F.col("entity"), F.col("author"), none, F.lit(1).cast("long"), F.col("loc_added"), F.col("loc_deleted"), F.col("of_entity"), zero, zero)
    dated = cell(1, none, F.col("author"), F.col("date"), zero, F.col("all_added"), F.col("all_deleted"), F.col("of_author"), F.col("of_date"), F.col("of_all"))
    spread = marked.select(F.explode(F.when(F.col("leads"), F.array(owned, dated)).otherwise(F.array(owned))).alias("k")).select("k.*")
    return kept(spread.groupBy(*CELL[:4]).agg(*[F.sum(c).alias(c) for c in CELL[4:]]), "lattice")


CELL = ["level", "entity", "author", "date", "n", "added", "deleted", "commits", "of_date", "of_all"]


def people_of(cells: DataFrame) -> DataFrame:
    """(entity, author, n, added, deleted) of the first level with its entity's totals, written: the rows are dealt by entity once, and every table of entities is a choice of them.

    ``place`` numbers an entity's people by name; ``by_added``, ``by_deleted`` and ``by_n`` mark the one who did most.
    """
    own = cells.where("level = 0").select("entity", "author", "n", "added", "deleted", "commits").repartition(partitions(cells, STORED), "entity")
    people = Window.partitionBy("entity").orderBy("author")
    every = people.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    measures = ("added", "deleted", "n")
    high = lambda c: F.coalesce(c, F.lit(2**63 - 1))  # as ``best_of``, where a null sum is smallest
    most = lambda c: (F.col("place") == F.min(F.when(high(c) == F.col(f"most_{c}"), F.col("place"))).over(every)).alias(f"by_{c}")
    totals = [F.sum(c).over(every).alias(f"total_{c}") for c in ("n", "added", "deleted", "commits")]
    own = own.select("entity", "author", "n", "added", "deleted", F.row_number().over(people).alias("place"), F.count("author").over(every).alias("n_authors"), *totals, *[F.max(high(c)).over(every).alias(f"most_{c}") for c in measures])
    # A window's sum goes through its rows in their order, so the last bit is that of ``squares``.
    return kept(own.select("*", F.sum(square(F.col("n"), F.col("total_n"))).over(every).alias("squares"), *map(most, measures)).drop(*[f"most_{c}" for c in measures]), "people")


def counted(facts: DataFrame) -> dict[str, DataFrame]:
    """The tables, unsorted, of the analyses that count rows, commits, people and lines, all from one ``lattice``; none of those of entities shuffles anything more."""
    cells = lattice(facts)
    owned, dated = people_of(cells), cells.where("level = 1")
    one = owned.where("place = 1")  # a row for each entity
    churn = lambda key, commits: dated.groupBy(key).agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.sum(commits).alias("commits"))
    # One row each: how many entities and rows, people, commits there are.
    whole = one.agg(F.count("entity").alias("e"), F.sum("total_n").alias("m")).crossJoin(dated.agg(F.countDistinct("author").alias("a"))).crossJoin(dated.agg(F.sum("of_all").alias("c")))
    best = lambda c, part, total: owned.where(f"by_{c}").select("entity", F.col("author").alias("main_dev"), F.col(c).alias(part), F.col(f"total_{c}").alias(total), centi_ratio(F.col(c), F.col(f"total_{c}")).alias("ownership"))
    tables = {
        "authors": one.select("entity", "n_authors", F.col("total_n").alias("n_revs")),
        "revisions": one.select("entity", F.col("total_commits").alias("n_revs")),
        "summary": whole.selectExpr("stack(4, 'number-of-commits', coalesce(c, 0), 'number-of-entities', e, 'number-of-entities-changed', coalesce(m, 0), 'number-of-authors', a) as (statistic, value)"),
        "absolute-churn": churn("date", "of_date"),
        "author-churn": churn("author", "commits"),
        "entity-churn": one.select("entity", F.col("total_added").alias("added"), F.col("total_deleted").alias("deleted"), F.col("total_commits").alias("commits")),
        "entity-ownership": owned,
        "main-developer": best("added", "added", "total_added"),
        "refactoring-main-developer": best("deleted", "removed", "total_removed"),
        "main-developer-by-revisions": best("n", "added", "total_added"),
        "entity-effort": owned.select("entity", "author", F.col("n").alias("author_revs"), F.col("total_n").alias("total_revs")),
        "fragmentation": one.select("entity", centi(F.lit(1.0) - F.col("squares")).alias("fractal_value"), F.col("total_n").alias("total_revs")),
    }
    return {n: t.select(*[F.col(c.name).cast(c.field().dataType).alias(c.name, metadata=c.field().metadata) for c in lookup(n).columns]) for n, t in tables.items()}
