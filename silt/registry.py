"""The analyses: each a function from the fact table to a table, with its declared columns, order and flags."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.errors import EXIT_CODES, SiltError
from silt.schema import Column

Fn = Callable[..., DataFrame]


@dataclass(frozen=True)
class Flag:
    name: str
    type: str
    default: Any
    desc: str
    required: bool = False

    @property
    def arg(self) -> str:
        return self.name.replace("-", "_")


@dataclass(frozen=True)
class Analysis:
    name: str
    summary: str
    fn: Fn
    columns: tuple[Column, ...]
    sort: tuple[str, ...]  # a leading minus: descending
    aliases: tuple[str, ...] = ()
    flags: tuple[Flag, ...] = ()
    errors: tuple[str, ...] = ("empty_log",)
    needs: str = ""  # "loc" or "messages"
    change_sets: bool = False
    shape: str = "table"
    exit_codes: tuple[int, ...] = field(default=tuple(EXIT_CODES))

    def options(self, given: dict[str, Any]) -> dict[str, Any]:
        """The value of each flag; unknown ones and missing required ones are errors."""
        known = {f.arg: f for f in self.flags}
        for k in given:
            if k not in known:
                raise SiltError("unknown_flag", f"{self.name} has no flag {k}")
        out = {k: given.get(k, f.default) for k, f in known.items()}
        for k, f in known.items():
            if f.required and out[k] is None:
                raise SiltError("missing_required_flag", f"{self.name} needs --{f.name}", {"flag": f.name})
        return out

    def visible(self, options: dict[str, Any]) -> list[Column]:
        return [c for c in self.columns if not c.gate or options.get(c.gate)]

    def order(self) -> list:
        return [F.desc(s[1:]) if s.startswith("-") else F.asc(s) for s in self.sort]

    def table(self, facts: DataFrame, **given: Any) -> DataFrame:
        """The result, lazy and unsorted, its columns typed and described."""
        options = self.options(given)
        out = self.fn(facts, **options)
        # Columns that no output shows may still be needed to sort by.
        kept = [c for c in self.visible(options)]
        extra = [s.lstrip("-") for s in self.sort if s.lstrip("-") not in {c.name for c in kept}]
        return out.select(*[F.col(c.name).cast(c.field().dataType).alias(c.name, metadata=c.field().metadata) for c in kept], *extra)

    def run(self, facts: DataFrame, rows: int = 0, **given: Any) -> DataFrame:
        """The sorted result, the first ``rows`` of it if that is positive."""
        out = self.table(facts, **given).orderBy(*self.order())
        if rows > 0:
            out = out.limit(rows)
        return out.select(*[c.name for c in self.visible(self.options(given))])


_ALL: dict[str, Analysis] = {}
_ALIASES: dict[str, str] = {}
MODULES = ["age", "churn", "counts", "coupling", "dump", "messages", "network", "ownership"]


def analysis(name: str, summary: str, columns: list[Column], sort: list[str], **more: Any) -> Callable[[Fn], Fn]:
    def add(fn: Fn) -> Fn:
        a = Analysis(name, summary, fn, tuple(columns), tuple(sort), **more)
        for n in (name, *a.aliases):
            if n in _ALL or n in _ALIASES:
                raise ValueError(f"{n} is registered twice")
        _ALL[name] = a
        _ALIASES.update(dict.fromkeys(a.aliases, name))
        return fn

    return add


@cache
def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"silt.operators.{m}")


def lookup(name: str) -> Analysis:
    _load()
    found = _ALL.get(_ALIASES.get(name, name))
    if found is None:
        raise SiltError("unknown_command", f"no analysis is called {name}", {"known": sorted(_ALL)})
    return found


def analyses() -> list[Analysis]:
    _load()
    return [_ALL[n] for n in sorted(_ALL)]
