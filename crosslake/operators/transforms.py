"""Row rules of imports: mapping, conversion, calculated columns, validation, deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosslake.plans.guards import check_where


def map_columns(df: DataFrame, mapping: dict[str, str], keep_others: bool = False) -> DataFrame:
    """Source columns under their target names; others stay only with ``keep_others``."""
    if missing := [s for s in mapping if s not in df.columns]:
        raise ValueError(f"Source column not found: {missing[0]}")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in mapping] if keep_others else []
    return df.select(*[F.col(f"`{s}`").alias(t) for s, t in mapping.items()], *rest)


def convert(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns as Spark types; what does not fit is null."""
    return df.withColumns({c: F.col(f"`{c}`").cast("string").try_cast(t) for c, t in types.items()})


def calculate(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """New columns from SQL expressions, which pass the guard of raw conditions."""
    for text in columns.values():
        check_where(text)
    return df.withColumns({n: F.expr(text) for n, text in columns.items()})


def map_values(df: DataFrame, column: str, values: dict[str, str], default: str | None = None) -> DataFrame:
    c = F.col(f"`{column}`").cast("string")
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return df.withColumn(column, F.coalesce(table[c], F.lit(default) if default is not None else c))


def filter_rows(df: DataFrame, filters: list[dict]) -> DataFrame:
    """Conjunction of {column, operator, value}; operators are comparisons, contains, startsWith, endsWith, in, isNull, isNotNull."""

    def one(f: dict) -> Column:
        c, op, v = F.col(f"`{f['column']}`"), f["operator"], f.get("value")
        text = c.cast("string")
        typed = F.lit(None if v is None or isinstance(v, (list, tuple)) else str(v)).cast(df.schema[f["column"]].dataType)
        table = {
            "equals": lambda: c == typed, "notEquals": lambda: c != typed, "greaterThan": lambda: c > typed, "lessThan": lambda: c < typed, "contains": lambda: F.contains(text, F.lit(str(v))),
            "startsWith": lambda: text.startswith(str(v)), "endsWith": lambda: text.endswith(str(v)), "in": lambda: text.isin(*map(str, v)), "isNull": c.isNull, "isNotNull": c.isNotNull,
        }
        if op not in table:
            raise ValueError(f"Unknown operator: {op}")
        return table[op]()

    return df.where(reduce(lambda a, b: a & b, map(one, filters))) if filters else df


def validate_rows(df: DataFrame, rules: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows without errors, rows with errors and their array ``problems``, rows with warnings only).

    rules: {column, rule, severity (error), ...}: required; type (type); range (min, max);
    regex (pattern); unique. Null values pass all rules but required; unique counts a value
    through a window over its own rows.
    """
    problems = []
    for i, r in enumerate(rules):
        c, kind, level = F.col(f"`{r['column']}`"), r["rule"], r.get("severity", "error")
        text = c.cast("string")
        if kind == "required":
            bad = c.isNull() | (F.trim(text) == "")
        elif kind == "type":
            bad = c.isNotNull() & text.try_cast(r["type"]).isNull()
        elif kind == "range":
            v = text.try_cast("double")
            bad = F.lit(False)
            bad = bad | (v < r["min"]) if r.get("min") is not None else bad
            bad = bad | (v > r["max"]) if r.get("max") is not None else bad
        elif kind == "regex":
            bad = ~text.rlike(r["pattern"])
        elif kind == "unique":
            name = f"__u{i}"
            # equal values are counted by an aggregate, not gathered
            counts = df.groupBy(c.alias("__k")).agg(F.count(F.lit(1)).alias(name)).where(f"{name} > 1 and __k is not null")
            df = df.join(counts, c == F.col("__k"), "left").drop("__k")
            bad = F.col(name).isNotNull()
        else:
            raise ValueError(f"Unknown rule: {kind}")
        problems.append(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(r["column"]).alias("column"), F.lit(kind).alias("rule"), F.lit(level).alias("severity"))))
    judged = df.withColumn("problems", F.array_compact(F.array(*problems)) if problems else F.expr("cast(array() as array<struct<column:string,rule:string,severity:string>>)"))
    judged = judged.drop(*[c for c in judged.columns if c.startswith("__u")])
    is_error = F.exists("problems", lambda p: p["severity"] == "error")
    good = judged.where(~is_error)
    return good.drop("problems"), judged.where(is_error), good.where(F.size("problems") > 0)


def dedup(df: DataFrame, keys: list[str], order: list[Column], keep: str = "first") -> DataFrame:
    """One row for each key: the first or last by ``order``, which should be total. The limit works before the shuffle too."""
    if keep not in ("first", "last"):
        raise ValueError("keep must be first or last")
    if keep == "last":
        order = [_reverse(c) for c in order]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def _reverse(c: Column | str) -> Column:
    return F.desc_nulls_last(c) if isinstance(c, str) else c.desc_nulls_last()


def errors_by_type(errors: DataFrame) -> DataFrame:
    return errors.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
