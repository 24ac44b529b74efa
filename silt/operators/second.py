"""Second-stage operators over results: guarded sums, matrices, graphs, maps, digests and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silt.functions.exprs import base_name, first_segment, indentation, is_code, min_max
from silt.functions.places import placed
from silt.functions.patterns import linear_regex
from silt.schema import roles_of

# Words without meaning of their own in commit subjects.
STOP_WORDS = (
    "the a an and or to of in for on with by from at is be as it this that add added update updated fix fixed change changed remove removed new use using "
    "into out up down not no wip test tests merge branch pull request pr into feat feature chore refactor bump via but if then than can will"
).split()


class AggregationError(ValueError):
    """A sum that would mean nothing."""


def require_role(df: DataFrame, column: str, allowed: set[str]) -> None:
    """A column of known role must have an allowed one; unknown columns pass."""
    role = roles_of(df.schema).get(column)
    if role is not None and role not in allowed:
        raise AggregationError(f"{column} is {role}; it can't be summed here")


def sum_for_value(df: DataFrame, column: str) -> DataFrame:
    """The total of an additive column, in one row; missing values count 0."""
    require_role(df, column, {"additive"})
    return df.agg(F.coalesce(F.sum(column), F.lit(0)).alias(column))


def sum_for_rank(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(key, total): what each key's rows sum to, for ranking alone; a row counts for each of its keys, twice for a pair with itself."""
    require_role(df, column, {"additive", "intensive"})
    each = df.select(F.explode(F.array(*keys)).alias("key"), F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("v"))
    return each.groupBy("key").agg(F.sum("v").alias("total"))


def pair_matrix(df: DataFrame, a: str, b: str, weight: str, top: int) -> DataFrame:
    """(row, column, weight) among the ``top`` keys by total, ties by name, both ways; of repeated pairs the largest (a, b, weight) counts."""
    full = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(weight).isNotNull())
    best = sum_for_rank(full, weight, [a, b]).orderBy(F.desc("total"), "key").limit(top).select("key")
    cells = full.select(F.col(a).alias("x"), F.col(b).alias("y"), F.col(weight).cast("double").alias("w"))
    ways = cells.select(F.explode(F.array(F.struct(F.col("x").alias("row"), F.col("y").alias("column"), F.struct("x", "y", "w").alias("v")), F.struct(F.col("y").alias("row"), F.col("x").alias("column"), F.struct("x", "y", "w").alias("v")))).alias("c")).select("c.*")
    one = ways.groupBy("row", "column").agg(F.max("v").alias("v"))
    kept = one.join(best.withColumnRenamed("key", "row"), "row", "left_semi").join(best.withColumnRenamed("key", "column"), "column", "left_semi")
    return kept.select("row", "column", F.col("v.w").alias("weight"))


def coupling_graph(coupling: DataFrame, soc: DataFrame | None = None, min_degree: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): pairs of at least ``min_degree``, and their entities with the sum of coupling as size."""
    links = coupling.where(F.col("degree") >= min_degree).select(F.col("entity").alias("source"), F.col("coupled").alias("target"), F.col("degree").alias("value"))
    ids = links.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    size = F.lit(1)
    if soc is not None:
        ids = ids.join(soc.select(F.col("entity").alias("__e"), F.col("soc").alias("__s")), F.col("id") == F.col("__e"), "left")
        size = F.coalesce(F.col("__s"), F.lit(1))
    return ids.select("id", base_name(F.col("id")).alias("label"), first_segment(F.col("id")).alias("group"), size.cast("bigint").alias("val")), links


def people_network(communication: DataFrame, min_strength: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): pairs of at least ``min_strength``, and people with their total strength, in one decimal."""
    kept = communication.where(F.col("strength") >= min_strength)
    links = kept.select(F.col("author").alias("source"), F.col("peer").alias("target"), F.col("strength").alias("value"))
    return sum_for_rank(kept, "strength", ["author", "peer"]).select(F.col("key").alias("id"), F.round("total", 1).alias("val")), links


UNOWNED = "(unowned)"


def map_leaves(weights: DataFrame, column: str, structure: DataFrame | None = None, invert: bool = False) -> DataFrame:
    """(entity, size, weight): files with their lines and a weight between 0 and 1; without a structure, those of the weights by their value."""
    w = weights.select("entity", F.col(column).cast("double").alias("v"))
    limits = w.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    scaled = w.crossJoin(F.broadcast(limits)).select("entity", "v", min_max(F.col("v"), F.col("lo"), F.col("hi"), invert).alias("weight"))
    if structure is None:
        return scaled.select("entity", F.greatest("v", F.lit(1.0)).alias("size"), "weight")
    return structure.join(scaled, "entity", "left").select("entity", F.col("loc").cast("double").alias("size"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def category_leaves(weights: DataFrame, column: str, structure: DataFrame | None = None) -> DataFrame:
    """(entity, size, category): files with a category, such as an owner."""
    w = weights.select("entity", F.col(column).alias("category"))
    if structure is None:
        return w.select("entity", F.lit(1).cast("bigint").alias("size"), "category")
    return structure.join(w, "entity", "left").select("entity", F.col("loc").cast("bigint").alias("size"), F.coalesce("category", F.lit(UNOWNED)).alias("category"))


def domination(leaves: DataFrame, share: float = 0.1, top: int = 5) -> DataFrame:
    """(entity, size, percent): the largest files above a share of all lines."""
    total = leaves.agg(F.sum("size").alias("t"))  # one row
    over = leaves.crossJoin(F.broadcast(total)).where((F.col("t") > 0) & (F.col("size") > F.col("t") * share))
    return over.select("entity", "size", F.bround(F.col("size") / F.col("t") * 100).cast("bigint").alias("percent")).orderBy(F.desc("size"), "entity").limit(top)


def hierarchy(leaves: DataFrame, size: str = "size") -> DataFrame:
    """(path, depth, files, size): every folder and file of the leaves' paths, with sums; the root is ''."""
    parts = F.split("entity", "/")
    levels = leaves.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path")))).alias("x"), F.col(size).alias("s"))
    return levels.groupBy("x.path", "x.depth").agg(F.count("*").alias("files"), F.sum("s").alias("size"))


def intervals(leaves: DataFrame, size: str = "size") -> DataFrame:
    """(path, depth, left, right, files, size): every folder and file with the numbers of the first and last node inside it, itself the first, when all are counted folder before content, siblings by name.

    A node lies in a folder if its ``left`` is between the folder's ``left`` and ``right``: enclosure without paths, at any depth.
    """
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    nodes = hierarchy(leaves, size)
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    inside = nodes.where("path <> ''").select(F.explode(above).alias("path")).groupBy("path").agg(F.count("*").alias("inside"))
    whole = placed(nodes.join(inside, "path", "left").withColumn("parts", parts), "left", F.col("parts"))
    return whole.select("path", "depth", "left", (F.col("left") + F.coalesce("inside", F.lit(0))).alias("right"), "files", "size")


def nested(leaves: list[dict], root: str = "root") -> dict:
    """Collected leaves as one nested tree, children sorted by path: a driver-side shape for drawing."""
    top: dict = {"name": root, "children": []}
    folders = {"": top}

    def folder(path: str) -> dict:
        if path not in folders:
            above, _, name = path.rpartition("/")
            folders[path] = {"name": name, "children": []}
            folder(above)["children"].append(folders[path])
        return folders[path]

    for leaf in sorted(leaves, key=lambda x: x["entity"]):
        above, _, name = leaf["entity"].rpartition("/")
        folder(above)["children"].append({"name": name} | {k: v for k, v in leaf.items() if k != "entity"})
    return top


def author_shares(effort: DataFrame, top: int) -> DataFrame:
    """The rows of the ``top`` entities by changes, with each person's share."""
    best = effort.groupBy("entity").agg(F.max("total_revs").alias("__t")).orderBy(F.desc("__t"), "entity").limit(top).select("entity")
    return effort.join(best, "entity", "left_semi").select("entity", "author", "author_revs", "total_revs", (F.col("author_revs") / F.col("total_revs")).alias("share"))


# ---- the digest, a query for each part


def hotspots(revisions: DataFrame, code: int = 12, other: int = 6) -> DataFrame:
    """(kind, entity, n_revs): the most changed code files and the most changed others."""
    kinds = revisions.withColumn("kind", F.when(is_code(F.col("entity")), "code").otherwise("other"))
    top = lambda k, n: kinds.where(F.col("kind") == k).orderBy(F.desc("n_revs"), "entity").limit(n)
    return top("code", code).unionByName(top("other", other)).select("kind", "entity", "n_revs")


def strongest_coupling(coupling: DataFrame, top: int = 12) -> DataFrame:
    return coupling.orderBy(F.desc("degree"), F.desc("average_revs"), "entity", "coupled").limit(top)


def owners(main_developers: DataFrame, top: int = 8) -> DataFrame:
    """(main_dev, files, whole, of): people by code files they lead; ``whole`` counts code files with one owner of all, ``of`` all code files."""
    own = main_developers.where(is_code(F.col("entity")))
    total = own.agg(F.count(F.when(F.col("ownership") >= 0.999, 1)).alias("whole"), F.count("*").alias("of"))  # one row
    ranked = own.groupBy("main_dev").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "main_dev").limit(top)
    return ranked.crossJoin(F.broadcast(total)).select("main_dev", "files", "whole", "of")


def most_fragmented(fragmentation: DataFrame, top: int = 8) -> DataFrame:
    return fragmentation.where(is_code(F.col("entity"))).orderBy(F.desc("fractal_value"), F.desc("total_revs"), "entity").limit(top)


def age_statistics(ages: DataFrame) -> DataFrame:
    """(min, median, max): of code files; the median of an even number is the upper one.

    Ages are few distinct months, so the order statistic comes from counts of them, not from a sort of all files.
    """
    counts = ages.where(is_code(F.col("entity"))).groupBy("age_months").agg(F.count("*").alias("n"))
    w = Window.orderBy("age_months")
    placed = counts.withColumn("below", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    middle = F.floor(F.col("total") / 2)
    return placed.agg(F.min("age_months").alias("min"), F.max(F.when((F.col("below") <= middle) & (middle < F.col("below") + F.col("n")), F.col("age_months"))).alias("median"), F.max("age_months").alias("max")).where("min is not null")


def oldest(ages: DataFrame, top: int = 5) -> DataFrame:
    return ages.where(is_code(F.col("entity"))).orderBy(F.desc("age_months"), "entity").limit(top)


def churn_totals(churn: DataFrame) -> DataFrame:
    """(periods, added, deleted, ratio, spike_date): sums over dates; the spike has most lines, the first date of equals."""
    for c in ("added", "deleted"):
        require_role(churn, c, {"additive"})
    out = churn.agg(F.count("*").alias("periods"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.min(F.struct((-(F.col("added") + F.col("deleted"))).alias("v"), "date")).alias("s"))
    ratio = F.when(F.col("deleted") != 0, F.round(F.col("added") / F.col("deleted"), 2))
    return out.where("periods > 0").select("periods", "added", "deleted", ratio.alias("ratio"), F.col("s.date").alias("spike_date"))


def strongest_ties(communication: DataFrame, top: int = 8) -> DataFrame:
    """The strongest pairs, with the number of people in the network."""
    people = communication.select(F.explode(F.array("author", "peer")).alias("p")).agg(F.countDistinct("p").alias("people"))  # one row
    return communication.orderBy(F.desc("strength"), F.desc("author"), F.desc("peer")).limit(top).crossJoin(F.broadcast(people))


def subjects(facts: DataFrame) -> DataFrame:
    """(rev, message): one subject for each commit, that of its last row."""
    return facts.groupBy("rev").agg(F.max_by("message", "ord").alias("message"))


def vocabulary(facts: DataFrame, top: int = 20) -> DataFrame:
    """(term, n): occurrences of words of three letters or more in the commits' subjects."""
    words = subjects(facts).select(F.explode(F.regexp_extract_all(F.lower("message"), F.lit(r"[a-z][a-z0-9_-]{2,}"), F.lit(0))).alias("term"))
    return words.where(~F.col("term").isin(*dict.fromkeys(STOP_WORDS))).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)


def word_cloud(facts: DataFrame, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(term, n): every word of three characters or more, apostrophes, plus signs and hyphens among them, in the commits' subjects, but for ``stop``."""
    words = subjects(facts).select(F.explode(F.regexp_extract_all(F.lower("message"), F.lit(r"[a-z][a-z'+-]+"), F.lit(0))).alias("term"))
    kept = words.where((F.length("term") >= 3) & ~F.col("term").isin(*dict.fromkeys(w.lower() for w in stop)))
    return kept.groupBy("term").agg(F.count("*").alias("n"))


def monthly_momentum(churn: DataFrame) -> DataFrame:
    """(month, commits, added, deleted) from churn by date."""
    for c in ("commits", "added", "deleted"):
        require_role(churn, c, {"additive"})
    return churn.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.sum("commits").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def crisis_cadence(facts: DataFrame, expression: str) -> DataFrame:
    """(month, commits): commits of each month whose message matches, in any case."""
    hit = F.col("message").rlike("(?i)" + linear_regex(expression, "invalid_expression"))
    return facts.where(hit).groupBy(F.substring("date", 1, 7).alias("month")).agg(F.countDistinct("rev").alias("commits"))


def complexity_trend(versions: DataFrame, order: str, source: str) -> DataFrame:
    """(order, lines, complexity): lines that aren't blank and their indentation, in two decimals, of each version of a text."""
    x = indentation(F.split(F.coalesce(F.col(source), F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"))
    return versions.select(order, x.alias("x")).select(order, F.col("x.lines").alias("lines"), F.round("x.complexity", 2).alias("complexity"))


def active_window(preludes: DataFrame) -> DataFrame:
    """(first, last, days): dates of all commits, those without files too."""
    return preludes.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("date").alias("days"))


def hotspot_candidates(revisions: DataFrame, structure: DataFrame, top: int = 5) -> DataFrame:
    """Of the ``top`` most changed entities those that exist in the structure, most changed first."""
    best = revisions.orderBy(F.desc("n_revs"), "entity").limit(top)
    return best.join(structure.select("entity"), "entity", "left_semi").orderBy(F.desc("n_revs"), "entity")


# Charts of analyses whose best one isn't what the columns' roles suggest.
CHARTS = {
    "code-age": ("Histogram", {"x": "age_months"}),
    "summary": ("KPI Card", {"metric": "statistic", "value": "value"}),
    "authors": ("Scatter Plot", {"x": "n_revs", "y": "n_authors"}),
    "coupling": ("Network Graph", {"x": "entity", "y": "coupled", "size": "degree"}),
    "communication": ("Network Graph", {"x": "author", "y": "peer", "size": "strength"}),
    "absolute-churn": ("Stacked Bar Chart", {"x": "date", "y": ["added", "deleted"]}),
}


def chart(df: DataFrame, analysis: str = "") -> tuple[str, dict]:
    """(kind, channels) of the chart that suits a result: by name where ``CHARTS`` has one, else by its columns' meanings.

    Identifiers take no channel and a date is the first dimension.  One measure is drawn: a share rather than lines, lines rather than months, months rather than a count.
    """
    if analysis in CHARTS:
        return CHARTS[analysis]
    meaning = {f.name: f.metadata["semantic"] for f in df.schema if "semantic" in f.metadata}
    roles = roles_of(df.schema)
    weight = {"loc": 1, "duration_months": 2, "count": 3}
    dims = sorted((c for c in roles if roles[c] == "dimension"), key=lambda c: meaning[c] != "date")
    measures = sorted((c for c in roles if roles[c] in ("additive", "intensive")), key=lambda c: weight.get(meaning[c], 0))
    if len(dims) > 1 and meaning[dims[0]] == meaning[dims[1]]:
        return "Network Graph", {"x": dims[0], "y": dims[1]} | ({"size": measures[0]} if measures else {})
    if dims:
        return "Bar Chart", {"x": dims[0]} | ({"y": measures[0]} if measures else {}) | ({"color": dims[1]} if len(dims) > 1 else {})
    if not measures:
        raise ValueError("no column can be drawn")
    return ("Scatter Plot", {"x": measures[0], "y": measures[1]}) if len(measures) > 1 else ("Histogram", {"x": measures[0]})


def chart_columns(df: DataFrame) -> dict[str, list[str]]:
    """Columns by role, measures in declared order: what a chart's channels may take."""
    roles = roles_of(df.schema)
    return {r: [c for c in df.columns if roles.get(c) == r] for r in ("dimension", "additive", "intensive", "identifier")}


