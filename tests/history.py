"""The fixture history and a plain evaluator of the analyses, for comparison."""

from collections import defaultdict

LOG = """--c1a0001--2024-01-05--Ana Ruiz--Start engine
10\t0\tsrc/core/a.py
4\t0\tsrc/core/b.py
-\t-\tassets/logo.png

--c1a0002--2024-01-06--Ben Okoro--fix: a--b split
3\t2\tsrc/core/a.py
1\t1\tsrc/core/b.py

--c1a0003--2024-01-31--Ana Ruiz
5\t5\tsrc/ui/c.py

--c1a0004--2024-02-10--Chi Wen--WIP
--c1a0005--2024-02-10--Ben Okoro--Merge branch x
2\t0\tsrc/core/a.py
7\t3\tsrc/ui/c.py

--c1a0006--2024-02-29--Chi Wen--revert: bad fix
0\t4\tsrc/core/b.py
0\t6\tsrc/ui/c.py
1\t0\tdocs/guide.md

--c1a0007--2024-03-01--Dee Roy--Empty merge
"""
NAMES = {"a": "src/core/a.py", "b": "src/core/b.py", "c": "src/ui/c.py", "L": "assets/logo.png", "G": "docs/guide.md", "Ana": "Ana Ruiz", "Ben": "Ben Okoro", "Chi": "Chi Wen"}


def rows_of(text):
    """'b 3 3; c 3 3' as tuples, with short names spelled out and numbers parsed."""
    return [tuple(NAMES.get(w, float(w) if w.replace(".", "").isdigit() else w) for w in r.split()) for r in text.split(";") if r.strip()]


def sets(rows, cap):
    by = defaultdict(set)
    for r in rows:
        by[r[1]].add(r[0])
    return [s for s in by.values() if len(s) <= cap]


def coupling(rows, cap):
    """(a, b) -> (shared, commits of a, commits of b) by definition."""
    n, pairs = defaultdict(int), defaultdict(int)
    for s in sets(rows, cap):
        for a in s:
            n[a] += 1
            for b in s:
                if a < b:
                    pairs[a, b] += 1
    return {p: (k, n[p[0]], n[p[1]]) for p, k in pairs.items()}


def windows(rows, days):
    """(window, entity) -> record, by walking over days; rows are (entity, rev, date ordinal, ord)."""
    if not rows:
        return {}
    lo, hi = min(r[2] for r in rows), max(r[2] for r in rows)
    out = {}
    for end in range(lo + days - 1, hi + 1):
        for r in sorted((r for r in rows if end - days < r[2] <= end), key=lambda r: (r[2], r[3])):
            out.setdefault((end, r[0]), r)
    return out
