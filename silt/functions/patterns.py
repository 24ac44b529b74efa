"""Globs and linear-time regular expressions as the regular expressions that Spark runs."""

from __future__ import annotations

import re

from silt.errors import SiltError

MAX_BYTES = 1000


def glob_to_regex(glob: str) -> str:
    """A whole-path regular expression: ``**`` alone between slashes spans directories, ``*`` and ``?`` stop at them; ``[..]`` and ``{a,b}`` are classes and choices."""
    bad = lambda why: SiltError("invalid_glob", f"{glob!r}: {why}", {"glob": glob[:200]})
    if not glob:
        raise bad("it is empty")
    if len(glob.encode()) > MAX_BYTES:
        raise bad(f"it is longer than {MAX_BYTES} bytes")
    out, at, depth, n = [], 0, 0, len(glob)
    while at < n:
        c = glob[at]
        at += 1
        if c == "*":
            stars = 1
            while at < n and glob[at] == "*":
                stars, at = stars + 1, at + 1
            before, after = glob[: at - stars], glob[at:]
            alone = stars == 2 and (not before or before[-1] in "/{,") and (not after or after[0] in "/},")
            if not alone:
                out.append("[^/]*")
            elif after.startswith("/"):
                out.append("(?:.*/)?")
                at += 1
            elif out and out[-1] == "/":
                out[-1] = "(?:/.*)?"  # a/** holds a itself
            else:
                out.append(".*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = at + (glob[at : at + 1] in ("!", "^"))
            end = glob.find("]", end + 1)
            if end < 0:
                raise bad("a class has no end")
            body, at = glob[at:end], end + 1
            no = body[:1] in ("!", "^")
            body = body[no:]
            out.append(("[^/" if no else "[") + re.sub(r"([\[\]&~\\^])", r"\\\1", body.replace("\\", "")) + "]")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            if at == n:
                raise bad("it ends in a backslash")
            out.append(re.escape(glob[at]))
            at += 1
        else:
            out.append(re.escape(c) if c != "/" else "/")
    if depth:
        raise bad("a choice has no end")
    return "(?s)^(?:" + "".join(out) + r")\z"


def literal_prefix(glob: str) -> str:
    """What every path that a glob matches starts with."""
    at = re.search(r"[*?\[{\\]", glob)
    if at is None:
        return glob
    return glob[: at.start()].removesuffix("/") if glob[at.start() :].startswith("**") else glob[: at.start()]  # a/** holds a itself


def is_plain(pattern: str) -> bool:
    """Whether an expression matches nothing but its own text."""
    return not re.search(r"[\\.^$|?*+()\[\]{}]", pattern)


# What backtracking engines take and linear-time ones refuse, or read otherwise.
_REFUSED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\[kGXR]|[*+?}]\+|&&")
# POSIX classes.
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}


def linear_regex(pattern: str, code: str) -> str:
    """``pattern``, written for a linear-time engine, for Java's; what that engine would refuse is an error."""
    bad = lambda why: SiltError(code, f"{pattern[:200]!r}: {why}", {"pattern": pattern[:200]})
    if not pattern:
        raise bad("it is empty")
    if len(pattern.encode()) > MAX_BYTES:
        raise SiltError(code, f"the pattern is longer than {MAX_BYTES} bytes", {"pattern_length": len(pattern.encode()), "max": MAX_BYTES})
    plain = re.sub(r"\\\\", "", pattern)
    if _REFUSED.search(plain):
        raise bad("lookaround, backreferences and possessive repeats aren't supported")
    out = re.sub(r"\(\?P<", "(?<", pattern)
    out = re.sub(r"\[:(\^?)(\w+):\]", lambda m: _posix(m, bad), out)
    out = out.replace(r"\z", r"\z").replace(r"\Z", r"\z")
    # \s has no vertical tab there; $ without a flag is the very end.
    out = _mapped(out, pattern)
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", out.replace(r"\z", r"\Z").replace("(?d)", "")))
    except re.error as e:
        if not re.search(r"\\[pP]|\(\?[imsU-]+\)|\(\?[imsU-]+:", pattern):
            raise bad(str(e)) from e
    return "(?d)" + out


def _posix(m: re.Match, bad) -> str:
    if m[2] not in _POSIX:
        raise bad(f"no class is called {m[2]}")
    if m[1]:
        raise bad("negated POSIX classes aren't supported")
    return _POSIX[m[2]]


def _mapped(p: str, whole: str) -> str:
    lines = bool(re.search(r"\(\?[a-zA-Z]*m", whole))
    out, at, cls = [], 0, False
    while at < len(p):
        c = p[at]
        if c == "\\" and at + 1 < len(p):
            out.append((r"\t\n\f\r " if cls else r"[\t\n\f\r ]") if p[at + 1] == "s" else r"[^\t\n\f\r ]" if p[at + 1] == "S" and not cls else p[at : at + 2])
            at += 2
            continue
        if c == "[" and not cls:
            cls = True
            out.append(c)
            at += 1
            if at < len(p) and p[at] == "^":
                out.append("^")
                at += 1
            if at < len(p) and p[at] == "]":
                out.append(r"\]")
                at += 1
            continue
        if c == "[" and cls:
            out.append(r"\[")
        elif c == "]" and cls:
            cls = False
            out.append(c)
        elif c == "$" and not cls and not lines:
            out.append(r"\z")
        else:
            out.append(c)
        at += 1
    return "".join(out)
