"""Running an analysis, and its self-describing result: envelope, warnings, limit and projection."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from silt.errors import SiltError
from silt.operators.coupling import all_filtered
from silt.operators.messages import linear_regex
from silt.operators.transforms import Transforms
from silt.plans.encoding import encode
from silt.registry import Analysis, lookup
from silt.schema import ROLES

VERSION = 1
WILD = "*"


@dataclass
class Result:
    analysis: Analysis
    options: dict[str, Any]
    rows: list[dict[str, Any]]
    total: int
    semantics: dict[str, str]
    transforms: dict[str, Any]
    warnings: list[dict[str, Any]] = field(default_factory=list)

    def envelope(self) -> dict[str, Any]:
        """Keys in a fixed order; optional ones only where they say something."""
        out: dict[str, Any] = {"schema_version": VERSION, "ok": True, "analysis": self.analysis.name, "shape": self.analysis.shape, "semantics": dict(sorted(self.semantics.items()))}
        if self.transforms:
            out["transforms"] = dict(sorted(self.transforms.items()))
        if self.analysis.flags:
            out["params"] = {f.name: self.options[f.arg] for f in sorted(self.analysis.flags, key=lambda f: f.name)}
        out["row_count"] = len(self.rows)
        if len(self.rows) < self.total:
            out |= {"total_count": self.total, "truncated": True}
        return out | {"rows": self.rows}

    def json(self, fields: str = "") -> str:
        paths = checked_fields(fields, self.envelope(), [c.name for c in self.analysis.columns])
        return encode(projected(self.envelope(), paths) if paths else self.envelope())


def guard(a: Analysis, facts: DataFrame, options: dict[str, Any]) -> None:
    """Rows without the data that the analysis needs are an error; no rows at all aren't."""
    if a.needs == "loc":
        n, loc = facts.agg(F.count("*"), F.max("has_loc")).first()
        if n and not loc:
            raise SiltError("missing_metrics", f"{a.name} needs line counts")
    if a.needs == "messages":
        linear_regex(options["expression"], "invalid_expression")
        n, some = facts.agg(F.count("*"), F.max(F.col("message") != "-")).first()
        if n and not some:
            raise SiltError("missing_messages", f"{a.name} needs commit subjects")


def semantics_of(a: Analysis, options: dict[str, Any], transforms: Transforms) -> dict[str, str]:
    """Of the columns in this run; named layers are labels, no longer paths."""
    return {c.name: "label" if transforms.layers is not None and c.semantic == "filepath" else c.semantic for c in a.visible(options)}


def run(name: str, facts: DataFrame, transforms: Transforms | None = None, rows: int = 0, keep: bool = True, **given: Any) -> Result:
    """One analysis over a fact table, to the end: sorted, limited, collected.  The driver holds the rows; ``store`` is for results that it can't.

    The facts are kept while they are read more than once; ``keep=False`` is for those that lie in files, which are as cheap to read again.
    """
    a, transforms = lookup(name), transforms or Transforms()
    options = a.options(given)
    with _kept(transforms.apply(facts), keep) as facts:
        warnings = _checked(a, facts, options, transforms)
        if rows > 0:
            # The rows are counted on their way to the limit, so the facts aren't read again for the total.
            seen = Observation()
            table = a.table(facts, **given).observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*a.order()).limit(rows)
            got = [r.asDict() for r in table.select(*[c.name for c in a.visible(options)]).collect()]
            total = seen.get["n"]
        else:
            got = [r.asDict() for r in a.run(facts, **given).collect()]
            total = len(got)
        if a.name == "coupling" and not got and (why := all_filtered(facts, **options)):
            warnings.append(warning("coupling_all_filtered", "no pair reached the thresholds", why))
    return Result(a, options, [{k: v for k, v in r.items() if v is not None} for r in got], total, semantics_of(a, options, transforms), transforms.record(), warnings)


def store(name: str, facts: DataFrame, path: str, transforms: Transforms | None = None, fmt: str = "parquet", keep: bool = True, **given: Any) -> Result:
    """One analysis whose rows tasks write to ``path``/rows, sorted, and the envelope without rows to ``path``/envelope; none of the rows pass through the driver.  ``keep`` as in ``run``."""
    a, transforms = lookup(name), transforms or Transforms()
    options, spark = a.options(given), facts.sparkSession
    with _kept(transforms.apply(facts), keep) as facts:
        warnings = _checked(a, facts, options, transforms)
        seen = Observation()
        a.run(facts, **given).observe(seen, F.count(F.lit(1)).alias("n")).write.format(fmt).save(f"{path}/rows")
        out = Result(a, options, [], seen.get["n"], semantics_of(a, options, transforms), transforms.record(), warnings)
        if a.name == "coupling" and not out.total and (why := all_filtered(facts, **options)):
            out.warnings.append(warning("coupling_all_filtered", "no pair reached the thresholds", why))
    head = {k: v for k, v in out.envelope().items() if k not in ("rows", "truncated", "total_count")} | {"row_count": out.total}
    spark.createDataFrame([(encode(head),)], "value string").coalesce(1).write.text(f"{path}/envelope")
    return out


def emit(name: str, facts: DataFrame, path: str, transforms: Transforms | None = None, rows: int = 0, fields: str = "", **given: Any) -> Result:
    """``run`` with its limit and projection for results of any size: tasks write the rows, the commit of the write the envelope (``sources.emitted``)."""
    from silt.sources.emitted import register

    a, transforms = lookup(name), transforms or Transforms()
    options = a.options(given)
    register(facts.sparkSession)
    with _kept(transforms.apply(facts)) as facts:
        warnings = _checked(a, facts, options, transforms)
        seen = Observation()
        table = a.run(facts, rows, **given).observe(seen, F.count(F.lit(1)).alias("n"))
        total = a.table(facts, **given).count() if rows > 0 else 0
        out = Result(a, options, [], total, semantics_of(a, options, transforms), transforms.record(), warnings)
        head = {k: v for k, v in out.envelope().items() if k != "rows"}
        paths = checked_fields(fields, head | {"rows": []}, [c.name for c in a.columns])
        chosen = [p.removeprefix("rows.") for p in paths if p.startswith("rows.")]
        if paths:
            head = {k: v for k, v in projected(head | {"rows": []}, paths).items() if k != "rows"}
            if "rows" not in paths and WILD not in chosen:
                table = table.select(*[c for c in table.columns if c in chosen])
        table.write.format("siltresult").mode("overwrite").option("head", encode(head)).save(path)
        out.total = max(total, seen.get["n"])
        if a.name == "coupling" and not out.total and (why := all_filtered(facts, **options)):
            out.warnings.append(warning("coupling_all_filtered", "no pair reached the thresholds", why))
    return out


@contextmanager
def _kept(facts: DataFrame, keep: bool = True) -> Iterator[DataFrame]:
    """``facts`` kept while guards, result and totals read it, unless the caller keeps it already or asks for none."""
    own = keep and facts.storageLevel == StorageLevel.NONE
    try:
        yield facts.persist(StorageLevel.MEMORY_AND_DISK) if own else facts
    finally:
        if own:
            facts.unpersist()


def _checked(a: Analysis, facts: DataFrame, options: dict[str, Any], transforms: Transforms) -> list[dict[str, Any]]:
    """The warnings of a run; raises if the rows lack what it needs."""
    warnings = []
    if transforms.period > 0 and not a.change_sets:
        counted = [c.name for c in a.columns if ROLES[c.semantic] == "additive"]
        if counted:
            warnings.append(warning("temporal_period_recounts", "counts are of windows, not of commits", {"period_days": transforms.period, "affected_columns": counted, "analysis": a.name}))
    guard(a, facts, options)
    return warnings


def warning(code: str, message: str, details: dict[str, Any]) -> dict[str, Any]:
    return {"schema_version": VERSION, "level": "warning", "code": code, "message": message, "details": details}


def _paths(x: Any, at: str = "") -> set[str]:
    if isinstance(x, dict):
        return {p for k, v in x.items() for p in {f"{at}.{k}" if at else k} | _paths(v, f"{at}.{k}" if at else k)}
    return _paths(x[0], at) if isinstance(x, list) and x and isinstance(x[0], dict) else set()


def checked_fields(spec: str, envelope: dict[str, Any], columns: list[str]) -> list[str]:
    """The dotted paths of a comma-separated list; each must be in the envelope or among the declared columns."""
    if not spec.strip():
        return []
    valid = _paths(envelope) | {f"rows.{c}" for c in columns} | {f"{k}.{WILD}" for k in ("params", "semantics", "transforms") if k in envelope}
    out = [p.strip() for p in spec.split(",") if p.strip()]
    for p in out:
        head = p.rsplit(".", 1)
        if p not in valid and not (len(head) == 2 and head[1] == WILD and head[0] in valid):
            raise SiltError("invalid_field", f"{p!r} is no path of the result", {"field": p, "valid": sorted(valid)})
    return out


def projected(envelope: dict[str, Any], paths: list[str]) -> dict[str, Any]:
    """The envelope with the chosen paths and what makes it self-describing, keys in alphabetical order."""
    tree: dict[str, Any] = {"schema_version": None, "ok": None, "shape": None, "transforms": None}
    for p in paths:
        at, parts = tree, p.split(".")
        for part in parts[:-1]:
            at = at.setdefault(part, {})
            if at is None:
                break
        if at is not None:
            at[parts[-1]] = None

    def cut(x: Any, t: Any) -> Any:
        if t is None or not t:
            return x
        if isinstance(x, list):
            return [cut(v, t) for v in x]
        if isinstance(x, dict):
            return {k: cut(x[k], t.get(k, t.get(WILD))) for k in sorted(x) if k in t or WILD in t}
        return x

    out = cut(envelope, tree)
    of_rows = tree.get("rows", {})
    meanings = envelope["semantics"]
    out["semantics"] = meanings if of_rows is None or WILD in of_rows else {k: v for k, v in meanings.items() if k in of_rows}
    return dict(sorted(out.items()))
