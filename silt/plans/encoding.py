"""Compact JSON of results."""

from __future__ import annotations

import json
from typing import Any


def encode(x: Any) -> str:
    """Compact JSON: whole floats without a fraction; <, >, & and line separators escaped."""
    text = json.dumps(_plain(x), separators=(",", ":"), ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def _plain(x: Any) -> Any:
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e21:
        return int(x)
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x
