"""Scalar functions of results, labels and texts, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from crosslake.plans.guards import OPERATION_WORDS, QUERY_COMMENTS, QUERY_PATTERNS, SHARE_PATTERNS, STAGING_WORDS


def round_half_up(c: Column, digits: int = 2) -> Column:
    """Halves go up, for negative numbers too."""
    k = float(10**digits)
    return F.floor(c * k + 0.5) / k


def percent(part: Column, whole: Column) -> Column:
    return part * 100.0 / F.nullif(whole, F.lit(0))


def shorten(c: Column, most: int = 100) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def mask_key(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.concat(F.substring(c, 1, 12), F.lit("..."))).otherwise("")


def day_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def days_since(c: Column, now: Column) -> Column:
    """Whole days; 999 for never."""
    return F.coalesce(F.floor((millis(now) - millis(c)) / 86_400_000).cast("int"), F.lit(999))


def _fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def number_label(c: Column) -> Column:
    """1.5K, 2.0M, 3.1B; smaller numbers without decimals."""
    v = c.cast("double")
    return F.when(v >= 1e9, F.concat(_fixed(v / 1e9, 1), F.lit("B"))).when(v >= 1e6, F.concat(_fixed(v / 1e6, 1), F.lit("M"))).when(v >= 1e3, F.concat(_fixed(v / 1e3, 1), F.lit("K"))).when(v.isNotNull(), _fixed(v, 0))


def bytes_label(c: Column) -> Column:
    """0 B, 1.5 KB, 2 MB: two decimals at most, without final zeros."""
    v = c.cast("double")
    step = F.least(F.greatest(F.floor(F.log(v) / F.log(F.lit(1024.0)) + 1e-12), F.lit(0)), F.lit(3))
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), (step + 1).cast("int"))
    number = F.regexp_replace(_fixed(v / F.pow(F.lit(1024.0), step), 2), r"\.?0+$", "")
    return F.when(v > 0, F.concat(number, F.lit(" "), unit)).when(v.isNotNull(), "0 B")


def relative_time(c: Column, now: Column) -> Column:
    """Just now, 5m ago, 3h ago, 2d ago; Never for null."""
    minutes = F.floor((millis(now) - millis(c)) / 60_000)
    label = lambda n, u: F.concat(n.cast("bigint").cast("string"), F.lit(f"{u} ago"))
    return F.when(c.isNull(), "Never").when(minutes < 1, "Just now").when(minutes < 60, label(minutes, "m")).when(minutes < 1440, label(F.floor(minutes / 60), "h")).otherwise(label(F.floor(minutes / 1440), "d"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "_")


def table_name_of(name: str) -> str:
    """A staging table's name: lower case, other characters as underscores, no leading digit, at most 50 characters."""
    out = re.sub(r"[^a-z0-9_]", "_", name.lower())
    return (f"_{out}" if out[:1].isdigit() else out)[:50]


def table_name_column(c: Column) -> Column:
    out = F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_")
    return F.substring(F.when(out.rlike("^[0-9]"), F.concat(F.lit("_"), out)).otherwise(out), 1, 50)


def needs_quoting_column(c: Column) -> Column:
    return (c != F.lower(c)) | ~c.rlike(r"\A[a-z0-9_]+\z")


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def query_is_safe(c: Column) -> Column:
    """The guard of queries over a column of texts; null and empty texts do not pass."""
    comment = "|".join(re.escape(x) for x in QUERY_COMMENTS)
    return F.coalesce((c != "") & ~c.rlike(comment) & ~_any(c, QUERY_PATTERNS), F.lit(False))


def staging_query_is_safe(c: Column, schema: Column) -> Column:
    return F.coalesce(~_any(c, tuple(rf"\b{w}\s+" for w in STAGING_WORDS)) & F.contains(F.lower(c), F.lower(schema)), F.lit(False))


def share_query_is_safe(c: Column) -> Column:
    """The guard of shares: begins with SELECT, holds none of the patterns, at most one semicolon, at its end."""
    text, semicolons = F.regexp_replace(c, r"\A\s+|\s+\z", ""), F.regexp_count(c, F.lit(";"))
    return F.coalesce(F.lower(text).startswith("select") & ~_any(c, SHARE_PATTERNS) & ((semicolons == 0) | ((semicolons == 1) & text.endswith(";"))), F.lit(False))


def needs_quoting(name: str) -> bool:
    return name != name.lower() or not re.fullmatch(r"[a-z0-9_]+", name)


def tables_in_sql(c: Column) -> Column:
    """The tables after FROM, then after JOIN, each once, as an array."""
    found = lambda word: F.regexp_extract_all(c, F.lit(rf'(?i)\b{word}\s+([a-zA-Z0-9_."]+)'), F.lit(1))
    return F.array_distinct(F.transform(F.concat(found("FROM"), found("JOIN")), lambda t: F.replace(t, F.lit('"'), F.lit(""))))


def operations_in_sql(c: Column) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in OPERATION_WORDS]), lambda w: F.contains(F.upper(c), w))


def sanitize_sql(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"--[^\n]*", ""), r"/\*[\s\S]*?\*/", ""), r"\s+", " "))


def traffic_light(c: Column, good: float, fair: float) -> Column:
    return F.when(c < good, "good").when(c <= fair, "fair").when(c.isNotNull(), "poor")


def query_time_light(ms: Column) -> Column:
    return traffic_light(ms / 1000, 2, 5)


def failure_rate_light(percent_failed: Column) -> Column:
    return traffic_light(percent_failed, 5, 10)
