"""Small definition files, read on the driver: layers and teams."""

from __future__ import annotations

import csv
import io
import json

from silt.errors import SiltError
from silt.operators.transforms import Layer, layer


def parse_layers(text: str, fmt: str = "text") -> list[Layer]:
    """Lines ``pattern => name``, or a JSON list of {pattern, name}; the first rule that matches counts."""
    if fmt in ("", "text"):
        out = []
        for i, line in enumerate(text.splitlines(), 1):
            if line.strip():
                pattern, mark, name = line.strip().partition("=>")
                if not mark:
                    raise SiltError("invalid_group", f"line {i} has no =>", {"line": i, "content": line.strip()})
                out.append(layer(pattern.strip(), name.strip()))
        return out
    if fmt == "json":
        try:
            rules = json.loads(text)
            return [layer(str(r.get("pattern", "")), str(r.get("name", ""))) for r in rules]
        except (ValueError, AttributeError, TypeError) as e:
            raise SiltError("invalid_group", f"not a list of rules: {e}") from e
    raise SiltError("invalid_group", f"unknown format {fmt}", {"format": fmt})


def parse_teams(text: str, fmt: str = "csv") -> dict[str, str]:
    """Rows ``author,team`` with or without a header, or a JSON object or list of {author, team}; the last of repeated authors counts."""
    if fmt in ("", "csv"):
        out: dict[str, str] = {}
        try:
            for i, row in enumerate((r for r in csv.reader(io.StringIO(text), skipinitialspace=True, strict=True) if r), 1):
                if len(row) != 2:
                    raise SiltError("invalid_team_map", f"row {i} has {len(row)} fields", {"row": i})
                author, team = (x.strip() for x in row)
                if i == 1 and (author.lower(), team.lower()) == ("author", "team"):
                    continue
                out[author] = team
        except csv.Error as e:
            raise SiltError("invalid_team_map", str(e)) from e
        return out
    if fmt == "json":
        try:
            x = json.loads(text)
        except ValueError as e:
            raise SiltError("invalid_team_map", str(e)) from e
        if isinstance(x, dict) and all(isinstance(v, str) for v in x.values()):
            return dict(x)
        if isinstance(x, list) and all(isinstance(v, dict) for v in x):
            return {str(v.get("author", "")): str(v.get("team", "")) for v in x}
        raise SiltError("invalid_team_map", "expected an object of names or a list of {author, team}")
    raise SiltError("invalid_team_map", f"unknown format {fmt}", {"format": fmt})


def read_text(path: str, flag: str) -> str:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except OSError as e:
        raise SiltError("input_file_open_failed", f"{path}: {e.strerror}", {"flag": flag, "path": path}) from e
