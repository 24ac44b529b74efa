"""The machine-readable contract: commands, flags, columns, roles and errors."""

from __future__ import annotations

from typing import Any

from silt.errors import CODES, COMMON, SiltError
from silt.registry import Analysis, Flag, analyses, lookup
from silt.schema import ROLES

META: dict[str, dict[str, Any]] = {
    "print-log-command": {
        "summary": "print the command that makes a log",
        "shape": "text",
        "flags": (Flag("after", "string", "", "only commits after this date"), Flag("all", "bool", False, "every ref")),
        "errors": ["invalid_after_date"],
    },
    "schema": {"summary": "describe the commands and what they give", "shape": "", "flags": (Flag("command", "string", "", "describe this one"),), "errors": ["unknown_schema_command"]},
}
META_EXITS = [0, 64]


def _flag(f: Flag) -> dict[str, Any]:
    out = {"name": f.name, "type": f.type, "desc": f.desc}
    if f.default is not None:
        out["default"] = f.default
    return out | ({"required": True} if f.required else {})


def command_list() -> dict[str, Any]:
    own = [{"name": a.name, "aliases": list(a.aliases), "summary": a.summary, "exit_codes": list(a.exit_codes)} for a in analyses()]
    meta = [{"name": n, "aliases": [], "summary": m["summary"], "exit_codes": META_EXITS} for n, m in META.items()]
    errors = [{"code": c, "exit_code": e, "hint": h} for c, (e, h) in sorted(CODES.items())]
    return {"schema_version": 1, "ok": True, "commands": sorted(own + meta, key=lambda x: x["name"]), "errors": errors, "aggregation_roles": dict(sorted(ROLES.items()))}


def command_schema(name: str) -> dict[str, Any]:
    if name in META:
        m = META[name]
        head = {"schema_version": 1, "ok": True, "command": name, "summary": m["summary"], "aliases": []} | ({"shape": m["shape"]} if m["shape"] else {})
        return head | {"flags": [_flag(f) for f in m["flags"]], "row_schema": [], "aggregation_roles": {}, "error_codes": m["errors"], "common_error_codes": COMMON, "exit_codes": META_EXITS}
    try:
        a: Analysis = lookup(name)
    except SiltError as e:
        raise SiltError("unknown_schema_command", f"no command is called {name}", {"command": name, "known": sorted([x.name for x in analyses()] + list(META))}) from e
    columns = [{"name": c.name, "type": c.type, "semantic": c.semantic, "desc": c.desc} | ({"flag_gated": c.gate} if c.gate else {}) for c in a.columns]
    return {
        "schema_version": 1, "ok": True, "command": a.name, "summary": a.summary, "aliases": list(a.aliases), "shape": a.shape, "flags": [_flag(f) for f in a.flags], "row_schema": columns,
        "aggregation_roles": {s: ROLES[s] for s in sorted({c.semantic for c in a.columns})}, "error_codes": list(a.errors), "common_error_codes": COMMON, "exit_codes": list(a.exit_codes),
    }
