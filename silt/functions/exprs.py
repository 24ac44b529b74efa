"""Column expressions with exact rules of rounding and of dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = "yyyy-MM-dd"


def centi(v: Column) -> Column:
    """Two significant digits, correctly rounded, ties to even."""
    return F.call_function("format_number", v.cast("double"), F.lit("0.0E0")).cast("double")


def centi_ratio(part: Column, whole: Column) -> Column:
    """part / whole in two significant digits; a whole below one counts as one."""
    return centi(part.cast("double") / F.greatest(whole, F.lit(1)).cast("double"))


def average(a: Column, b: Column) -> Column:
    return (a + b) / F.lit(2.0)


def percentage(v: Column) -> Column:
    return v * F.lit(100.0)


def truncated(v: Column) -> Column:
    return v.cast("bigint")


def day(date: Column) -> Column:
    """A real day written YYYY-MM-DD, or null."""
    return F.try_to_date(date, DAY)


def months_between(now: Column, then: Column) -> Column:
    """Whole months; one that isn't over doesn't count, month ends included."""
    months = (F.year(now) - F.year(then)) * 12 + F.month(now) - F.month(then)
    return (months - F.when(F.dayofmonth(now) < F.dayofmonth(then), 1).otherwise(0)).cast("bigint")


def first_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^(?:\./)+", "")


def without_prefix(path: Column, prefix: str) -> Column:
    p = prefix.rstrip("/") + "/"
    return F.when(path.startswith(p), F.substring(path, len(p) + 1, 1 << 30)).otherwise(path)


# Names that are documentation, configuration or generated, not code.
NON_CODE = r"(?i)(\.md$|\.mdx$|\.ya?ml$|\.json$|\.env|\.gitignore|\.github/|Dockerfile|\.lock$|composer\.json|package\.json|\.txt$|\.toml$|\.ini$|\.neon$|LICENSE|README|CHANGELOG|\.editorconfig|\.xml$|\.dist$|\.example$)"


def is_code(path: Column) -> Column:
    return ~path.rlike(NON_CODE)


def min_max(v: Column, low: Column, high: Column, invert: bool = False) -> Column:
    """v between low and high as 0..1, in four decimals; equal limits give 0 (inverted: 1)."""
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    share = (v - low) / span
    return F.round(F.lit(1.0) - share if invert else share, 4)


def indentation(lines: Column, tab: int = 8) -> Column:
    """Struct (lines: not blank, complexity: the sum of their leading white space / 4) of an array of lines."""
    full = F.filter(lines, lambda x: F.length(F.trim(F.regexp_replace(x, r"\s", " "))) > 0)
    width = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, r"^(\s*)", 1), "\t", " " * tab))
    total = F.aggregate(F.transform(full, lambda x: width(x) / F.lit(4.0)), F.lit(0.0), lambda a, x: a + x)
    return F.struct(F.size(full).cast("bigint").alias("lines"), total.alias("complexity"))
