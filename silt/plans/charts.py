"""Which chart a result asks for: library, template, and a column for each of the template's channels.

Nothing is drawn here.  A result is known by its columns' meanings; identifiers take no channel, one measure is drawn, and a channel that a template doesn't declare is an error,
since the library would drop it without a word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from silt.errors import SiltError
from silt.operators.second import CHARTS
from silt.schema import ROLES

# The channels of each template, by library; the first library that has a template is the one to use.
CHANNELS = {
    "vegalite": {
        "Bar Chart": ["x", "y", "color", "opacity", "column", "row"],
        "Stacked Bar Chart": ["x", "y", "color", "column", "row"],
        "Histogram": ["x", "color", "column", "row"],
        "Scatter Plot": ["x", "y", "color", "size", "shape", "opacity", "column", "row"],
        "KPI Card": ["metric", "value", "goal"],
        "Lollipop Chart": ["x", "y", "color", "column", "row"],
        "Heatmap": ["x", "y", "color", "column", "row"],
        "Line Chart": ["x", "y", "color", "strokeDash", "detail", "opacity", "column", "row"],
    },
    "echarts": {"Network Graph": ["x", "y", "size"], "Heatmap": ["x", "y", "color", "column", "row"]},
}
# What a column of each meaning is to the chart libraries.  A share of 0 to 1 says so; a percentage doesn't, or 1 would be drawn as 100 %.
KINDS = {
    "filepath": "Name",
    "person": "Name",
    "text": "Name",
    "label": "Category",
    "flag": "Boolean",
    "commit_id": "ID",
    "date": "Date",
    "count": "Count",
    "loc": {"semanticType": "Quantity", "unit": "lines"},
    "duration_months": {"semanticType": "Duration", "unit": "months"},
    "percentage": "Percentage",
    "ratio": {"semanticType": "Percentage", "intrinsicDomain": [0, 1]},
}
STRENGTH = {"loc": 1, "duration_months": 2, "count": 3}  # shares come before all of these


def meanings_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["semantic"] for f in df.schema if f.metadata.get("semantic") in ROLES}


def chart_spec(meanings: dict[str, str], analysis: str = "", template: str = "", library: str = "") -> dict:
    """{library, template, channels, kinds} for columns with ``meanings``; ``template`` and ``library`` choose others than the best."""
    if analysis == "parse":
        raise SiltError("invalid_value", "a dump of records isn't drawn")
    if unknown := sorted(set(meanings.values()) - set(ROLES)):
        raise SiltError("invalid_value", f"unknown meanings: {', '.join(unknown)}")
    dims = sorted((c for c, m in meanings.items() if ROLES[m] == "dimension"), key=lambda c: meanings[c] != "date")
    measures = sorted((c for c, m in meanings.items() if ROLES[m] in ("additive", "intensive")), key=lambda c: STRENGTH.get(meanings[c], 0))
    graph = len(dims) > 1 and meanings[dims[0]] == meanings[dims[1]]
    channels = None
    if not template and analysis in CHARTS and (not library or CHARTS[analysis][0] in CHANNELS[library]):
        template, channels = CHARTS[analysis]
    if not template:
        if library == "echarts" and not graph:
            raise SiltError("invalid_value", f"echarts has no chart of its own for this table; name one of {', '.join(CHANNELS['echarts'])}")
        template = ("Heatmap" if library == "vegalite" else "Network Graph") if graph else "Bar Chart" if dims or not measures else "Scatter Plot" if len(measures) > 1 else "Histogram"
    owner = next((n for n in ([library] if library else CHANNELS) if template in CHANNELS.get(n, {})), None)
    if owner is None:
        raise SiltError("invalid_value", f"no template is called {template}", {"known": {n: list(t) for n, t in CHANNELS.items() if not library or n == library}})
    declared = CHANNELS[owner][template]
    channels = _bound(declared, meanings, dims, measures, graph) if channels is None else channels
    if extra := sorted(set(channels) - set(declared)):
        raise SiltError("invalid_value", f"{template} has no channel {', '.join(extra)}", {"declared": declared})
    used = [c for v in channels.values() for c in (v if isinstance(v, list) else [v])]
    if missing := sorted(set(used) - set(meanings)):
        raise SiltError("invalid_value", f"the result has no column {', '.join(missing)}")
    return {"library": owner, "template": template, "channels": channels, "kinds": {c: KINDS[meanings[c]] for c in used}}


def _bound(declared: list[str], meanings: dict[str, str], dims: list[str], measures: list[str], graph: bool) -> dict[str, str]:
    """A column for each channel that is needed."""
    if "metric" in declared:
        if not dims or not measures:
            raise SiltError("invalid_value", "a card needs a dimension and a measure")
        return {"metric": dims[0], "value": measures[0]}
    if graph:
        return {"x": dims[0], "y": dims[1]} | ({"size" if "size" in declared else "color": measures[0]} if measures else {})
    if "y" not in declared:
        if not measures:
            raise SiltError("invalid_value", "a distribution needs a measure")
        return {"x": measures[0]}
    if not dims and not measures:
        raise SiltError("invalid_value", "no column can be drawn")
    axes = [*dims[:1], *measures[:1]] if dims else measures[:2]
    out = dict(zip(("x", "y"), axes)) if len(axes) > 1 else {"x": axes[0]}
    if len(dims) > 1 and "color" in declared:
        out["color"] = dims[1]
    lines = [m for m in measures if meanings[m] == "loc" and m not in out.values()]
    return out | ({"size": lines[0]} if "size" in declared and lines else {})
