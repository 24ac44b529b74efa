"""Ordered input transforms: paths, layers, sliding windows of days, teams."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silt.errors import SiltError
from silt.functions.exprs import DAY, day
from silt.functions.patterns import glob_to_regex, is_plain, linear_regex, literal_prefix

DAYS_BLOCK = 365  # days of an entity that a window's task looks at
TEAM_BROADCAST = 300  # teams up to this many are a literal map, more a join: a long literal costs more to plan than to look up
FEW_RULES = 16  # folders up to this many are conditions in turn
RULES = "place long, folder string, name string"


def filter_paths(facts: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Entities that an include glob matches, if there are any, and no exclude glob.

    Where each include glob starts with plain text, a condition on these starts comes first: a scan takes it, so a table sorted by entity leaves out what can't match.
    """
    starts = {literal_prefix(g) for g in include}
    if starts and "" not in starts:
        some = F.lit(False)
        for s in sorted(s for s in starts if not any(s != o and s.startswith(o) for o in starts)):
            some = some | F.col("entity").startswith(s)
        facts = facts.where(some)
    for globs, keep in ((include, True), (exclude, False)):
        if globs:
            # Each glob is anchored by itself, so any of them may match.
            hit = F.lit(False)
            for g in globs:
                hit = hit | F.col("entity").rlike(glob_to_regex(g))
            facts = facts.where(hit if keep else ~hit)
    return facts


@dataclass(frozen=True)
class Layer:
    """A rule that names the entities whose path matches ``regex``; ``folder``, where it is given, says the same: those inside it."""

    regex: str
    name: str
    folder: str | None = None


def layer(pattern: str, name: str) -> Layer:
    """A pattern is a path prefix, or, from ^ on, an expression."""
    if not pattern or not name:
        raise SiltError("invalid_group", "a rule needs a pattern and a name", {"pattern": pattern, "name": name})
    if len(pattern.encode()) > 1000:
        raise SiltError("invalid_group", "the pattern is longer than 1000 bytes", {"pattern_length": len(pattern.encode()), "max": 1000})
    return Layer(linear_regex(pattern if pattern.startswith("^") else f"^{pattern}/", "invalid_group"), name, pattern if is_plain(pattern) else None)


def group_layers(facts: DataFrame, layers: list[Layer]) -> DataFrame:
    """Entities renamed by the first rule that matches; others are dropped.  Rows stay rows: nothing is deduplicated.

    Few rules are conditions in turn.  Of more, those that name a folder are a table (``in_folders``), and only expressions are tried one by one.
    """
    if not layers:
        return facts
    many = sum(x.folder is not None for x in layers) > FEW_RULES
    ruled = [(i, x) for i, x in enumerate(layers) if not (many and x.folder is not None)]
    if not many:
        name = F.coalesce(*[F.when(F.col("entity").rlike(x.regex), F.lit(x.name)) for _, x in ruled])
        return facts.withColumn("entity", name).where(F.col("entity").isNotNull())
    rules = facts.sparkSession.createDataFrame([(i, x.folder, x.name) for i, x in enumerate(layers) if x.folder is not None], RULES)
    first = F.coalesce(*[F.when(F.col("entity").rlike(x.regex), F.struct(F.lit(i).cast("long").alias("place"), F.lit(x.name).alias("name"))) for i, x in ruled]) if ruled else None
    return in_folders(facts, rules, first)


def in_folders(facts: DataFrame, rules: DataFrame, first: Column | None = None) -> DataFrame:
    """Entities renamed by the rule with the least ``place`` among rules (place, folder, name) whose folder they lie in, at any depth; others are dropped.

    A path has one folder of each depth, so a look-up for each depth among the rules, an equi-join with unique keys, finds all rules that hold it: the time doesn't
    depend on how many there are.  ``first``, a struct of place and name, competes with what is found.
    """
    depth = F.size(F.split("folder", "/"))
    unique = rules.groupBy(depth.alias("depth"), "folder").agg(F.min(F.struct("place", "name")).alias("rule"))
    depths = sorted(r[0] for r in rules.select(depth).distinct().collect())  # folders' depths: few
    taken = {c.lower() for c in facts.columns}
    free = lambda stem: next(n for n in (stem + "_" * i for i in range(len(taken) + 1)) if n not in taken)
    own, found = facts, [first] if first is not None else []
    for d in depths:
        folder, rule = free(f"folder{d}"), free(f"rule{d}")
        inside = F.when(F.size(F.split("entity", "/", d + 1)) > d, F.substring_index("entity", "/", d))
        here = unique.where(F.col("depth") == d).select(F.col("folder").alias(folder), F.col("rule").alias(rule))
        own = own.withColumn(folder, inside).join(here, folder, "left").drop(folder)
        found.append(F.col(rule))
    best = (F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("struct<place:long,name:string>"))["name"]
    return own.select(*[best.alias(c) if c == "entity" else F.col(c) for c in facts.columns]).where(F.col("entity").isNotNull())


def temporal_windows(facts: DataFrame, days: int, check: bool = True, dense: bool = False) -> DataFrame:
    """Commits of any ``days`` days in a row as one change set, named after the last day.

    Windows move by a day between the history's first and last; incomplete ones are left out.  In a window each entity counts once: its earliest day, then log
    order.  Only the first record of a day can count, and it does in the windows that hold its day but not the entity's day before; so one shuffle by
    entity, in blocks of days lest one entity fill a task, finds both by looking one row back, and no record is copied before it is chosen.

    ``dense``: entities have many records a day, as layers do; then the first record of each entity and day is found by an aggregation, which combines
    before its shuffle, and what is sorted by entity and block of days has a row a day, not a record.

    With ``check``, one pass finds the history's limits and whether all dates are dates; else both are left to the query, and other dates are dropped.
    """
    if days < 0:
        raise SiltError("invalid_temporal_period", f"{days} isn't a positive number of days", {"period": days})
    if not days:
        return facts
    d = facts.withColumn("__d", F.unix_date(day(F.col("date"))))
    limits = d.agg(F.min("__d").alias("__lo"), F.max("__d").alias("__hi"), F.min(F.when(F.col("__d").isNull(), F.struct("date"))).alias("__bad"))
    if check:
        lo, hi, bad = limits.first()
        if bad is not None:
            raise SiltError("invalid_temporal_date", f"{bad[0]!r} isn't a date", {"date": bad[0]})
        d = d.withColumn("__lo", F.lit(lo).cast("int")).withColumn("__hi", F.lit(hi).cast("int"))
    else:
        d = d.where(F.col("__d").isNotNull()).crossJoin(F.broadcast(limits.select("__lo", "__hi")))  # limits: one row
    if dense:
        held = F.min_by(F.struct(*[F.col(c) for c in (*facts.columns, "__lo", "__hi")]), "ord")
        d = d.groupBy(F.col("entity").alias("__e"), F.col("__d").alias("__day")).agg(held.alias("__r")).select("__r.*", F.col("__day").alias("__d"))
    # A block's last days are also seen by the next block, which looks back on them.
    size = max(DAYS_BLOCK, days)
    block = F.floor(F.col("__d") / size).cast("int")
    near = F.pmod(F.col("__d"), F.lit(size)) >= size - days + 1
    dealt = d.withColumn("__own", block).withColumn("__b", F.explode(F.when(near, F.array(block, block + 1)).otherwise(F.array(block))))
    before = F.lag("__d").over(Window.partitionBy("entity", "__b").orderBy("__d", "ord"))
    chosen = dealt.withColumn("__p", before).where((F.col("__b") == F.col("__own")) & (F.col("__p").isNull() | (F.col("__p") < F.col("__d"))))
    first = F.greatest(F.col("__d"), F.col("__lo") + (days - 1), F.col("__p") + days)
    last = F.least(F.col("__d") + (days - 1), F.col("__hi"))
    kept = chosen.where(first <= last).withColumn("__w", F.explode(F.sequence(first, last)))
    # Order of the result: window, day, log order.
    return kept.withColumn("rev", F.date_format(F.date_from_unix_date("__w"), DAY)).select(
        *[F.struct(F.col("__w").alias("__w0"), F.col("__d").alias("d"), F.col("ord").alias("o")).alias("ord") if c == "ord" else F.col(c) for c in facts.columns]
    )


def map_teams(facts: DataFrame, teams: dict[str, str] | DataFrame) -> DataFrame:
    """Authors replaced by their teams; who has none stays.  A table has columns author and team; of several rows of an author, which have no order, the last team by name counts."""
    if isinstance(teams, dict):
        if not teams:
            return facts
        if len(teams) <= TEAM_BROADCAST:
            pairs = F.create_map(*[F.lit(x) for kv in teams.items() for x in kv])
            return facts.withColumn("author", F.coalesce(F.try_element_at(pairs, F.col("author")), F.col("author")))
        teams = facts.sparkSession.createDataFrame(list(teams.items()), "author string, team string")
    named = teams.groupBy(F.col("author").alias("__a")).agg(F.max("team").alias("__t"))
    out = facts.join(named, facts["author"] == F.col("__a"), "left").withColumn("author", F.coalesce("__t", "author"))
    return out.select(*facts.columns)


@dataclass(frozen=True)
class Transforms:
    """What is applied before an analysis, in this order; empty parts are skipped."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    layers: list[Layer] | None = None
    period: int = 0
    teams: dict[str, str] | DataFrame | None = None

    def apply(self, facts: DataFrame, check: bool = True) -> DataFrame:
        out = filter_paths(facts, self.include, self.exclude)
        out = group_layers(out, self.layers or [])
        if self.period > 0:
            out = temporal_windows(out, self.period, check, dense=bool(self.layers))
        return map_teams(out, self.teams if self.teams is not None else {})

    def record(self) -> dict:
        """What the result's envelope says of them; a definition counts when it is given, even if it is empty."""
        out: dict = {}
        if self.include:
            out["include"] = list(self.include)
        if self.exclude:
            out["exclude"] = list(self.exclude)
        if self.layers is not None:
            out["group"] = True
        if self.period:
            out["temporal_period"] = self.period
        if self.teams is not None:
            out["team_map"] = True
        return out


