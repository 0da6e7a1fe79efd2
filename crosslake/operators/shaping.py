"""Results shaped for charts, tables and reports.

Order of first appearance needs an order: every function takes the columns that define it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslake.functions.common import checkpointed, local_rows
from crosslake.sources.files import with_row_numbers

MOST_SERIES = 10_000
RANGE_ROWS = 100_000


def number(c: Column) -> Column:
    """A value as a number, 0 where it is none."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def series(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(x).cast("string").alias("x"), F.col(y).cast("string").try_cast("double").alias("y"))


def pivot_long(df: DataFrame, x: str, group: str, y: str, order: Column) -> DataFrame:
    """Every (x, group) with its value: the last one by ``order``, 0 where there is none; x_no and group_no give the order of first appearance.

    Each x gets a row for each group, of which there may be MOST_SERIES.
    """
    base = df.select(F.coalesce(F.col(x).cast("string"), F.lit("null")).alias("x"), F.coalesce(F.col(group).cast("string"), F.lit("null")).alias("grp"), F.col(y).cast("string").try_cast("double").alias("y"), order.alias("o"))
    cell = base.groupBy("x", "grp").agg(F.max_by(F.struct("y"), "o")["y"].alias("y"), F.min("o").alias("o"))
    xs = cell.groupBy("x").agg(F.min("o").alias("x_no"))
    gs = cell.groupBy("grp").agg(F.min("o").alias("group_no")).limit(MOST_SERIES + 1).collect()  # become a list in the plan
    if len(gs) > MOST_SERIES:
        raise ValueError(f"Over {MOST_SERIES} series")
    kind = cell.schema["o"].dataType.simpleString()
    every = local_rows(df.sparkSession, [([tuple(r) for r in gs],)], f"gs array<struct<grp:string,group_no:{kind}>>")
    grid = xs.join(F.broadcast(every)).select("x", "x_no", F.explode("gs").alias("g")).select("x", "x_no", "g.*")  # one row
    return grid.join(cell.select("x", "grp", "y"), ["x", "grp"], "left").select("x", "grp", F.coalesce(F.when(~F.isnan("y"), F.col("y")), F.lit(0.0)).alias("y"), "x_no", "group_no")


def pivot(df: DataFrame, x: str, group: str, y: str, order: Column, groups: list[str] | None = None) -> DataFrame:
    """One row for each x, one column for each group, in order of first appearance; give ``groups`` to save the pass that finds them."""
    base = df.select(F.col(x).cast("string").alias("x"), F.col(group).cast("string").alias("grp"), F.col(y).cast("string").try_cast("double").alias("y"), order.alias("o"))
    if groups is None:
        found = base.groupBy("grp").agg(F.min("o").alias("o")).orderBy("o").limit(MOST_SERIES + 1).collect()  # becomes columns
        if len(found) > MOST_SERIES:
            raise ValueError(f"Over {MOST_SERIES} series")
        groups = [r.grp for r in found]
    aggs = [F.coalesce(F.max_by("y", F.when(F.col("grp").eqNullSafe(F.lit(g)), F.col("o"))), F.lit(0.0)).alias(str(g)) for g in groups]
    return base.groupBy("x").agg(F.min("o").alias("x_no"), *aggs).orderBy("x_no").drop("x_no")


def name_value(df: DataFrame, name: str, value: str, descending: bool = False, drop_zero: bool = False) -> DataFrame:
    """Pairs with their share of the total, for pies and funnels."""
    base = df.select(F.col(name).cast("string").alias("name"), number(F.col(value)).alias("value"))
    if drop_zero:
        base = base.where("value > 0")
    total = base.agg(F.sum("value").alias("total"))  # one row
    out = base.crossJoin(F.broadcast(total)).select("name", "value", F.when(F.col("total") != 0, F.col("value") * 100.0 / F.col("total")).otherwise(0.0).alias("percent"))
    return out.orderBy(F.desc("value"), "name") if descending else out


def bucket_key(ts: Column, period: str) -> Column:
    """The key of a bucket, without leading zeros; weeks are those of the month, by day // 7."""
    y, m, d = F.year(ts).cast("string"), F.month(ts).cast("string"), F.dayofmonth(ts)
    month = F.concat(y, F.lit("-"), m)
    day = F.concat(month, F.lit("-"), d.cast("string"))
    keys = {"month": month, "day": day, "week": F.concat(month, F.lit(" Week "), F.floor(d / 7).cast("string")), "hour": F.concat(day, F.lit(" "), F.hour(ts).cast("string"), F.lit(":00"))}
    if period not in keys:
        raise ValueError(f"Unknown period: {period}")
    return keys[period]


def time_buckets(df: DataFrame, ts: str, value: str, period: str, order: Column | None = None) -> DataFrame:
    """Sums for each bucket; bucket_start sorts them in time, first_no by first appearance."""
    extra = [F.min(order).alias("first_no")] if order is not None else []
    return df.groupBy(bucket_key(F.col(ts), period).alias("bucket")).agg(F.sum(value).alias("value"), F.min(ts).alias("bucket_start"), *extra)


def moving_average(df: DataFrame, value: str, order: list[str], window: int, by: list[str] | None = None, out: str = "moving_avg") -> DataFrame:
    """The mean of the last ``window`` values, fewer at the start, within each group of ``by``.

    The rows, sorted by group and order, are cut into ranges, and each range gets the
    ``window - 1`` rows before it; so no task holds a whole series, however long one is.
    """
    by = by or []
    rows = with_row_numbers(checkpointed(df.orderBy(*by, *order)), 0, "__n")
    size = max(RANGE_ROWS, window)
    block = F.floor(F.col("__n") / size)
    both = rows.withColumn("__b", F.explode(F.when(F.col("__n") % size > size - window, F.array(block, block + 1)).otherwise(F.array(block))))
    w = Window.partitionBy("__b", *by).orderBy("__n").rowsBetween(-(window - 1), 0)
    return both.withColumn(out, F.avg(value).over(w)).where(F.col("__b") == block).drop("__b", "__n")


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(number(F.col(x)).alias("x"), number(F.col(y)).alias("y"))


def radar_axes(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """The indicators: all columns but the first, with their greatest number (times ``scale``)."""
    cols = df.columns[1:]
    if len(cols) < 2:
        raise ValueError("A radar needs at least three columns")
    one = df.agg(*[(F.max(number(F.col(f"`{c}`"))) * scale).alias(f"m{i}") for i, c in enumerate(cols)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"m{i}").alias("max")) for i, c in enumerate(cols)])).alias("r")).select("r.*")


def radar_series(df: DataFrame, order: list, rows: int = 3) -> DataFrame:
    """The first rows as series."""
    first, *cols = df.columns
    return df.orderBy(*order).limit(rows).select(F.col(f"`{first}`").cast("string").alias("name"), F.array(*[number(F.col(f"`{c}`")) for c in cols]).alias("values"))


def gauge(df: DataFrame, y: str, order: list) -> DataFrame:
    """The first row's value, between 0 and 100."""
    return df.orderBy(*order).limit(1).select(F.greatest(F.lit(0.0), F.least(F.lit(100.0), number(F.col(y)))).alias("value"))


def heatmap(df: DataFrame, value: str, order: list, side: int = 5) -> DataFrame:
    """The first side² rows on a grid, with the range of the colours."""
    n = side * side
    top = df.orderBy(*order).limit(n).select(number(F.col(value)).alias("value"), *order)
    i = F.row_number().over(Window.orderBy(*order)) - 1  # side² rows
    out = top.select((i % side).alias("x"), F.floor(i / side).cast("int").alias("y"), "value")
    everything = Window.partitionBy(F.lit(1))  # side² rows
    return out.withColumns({"min_value": F.min("value").over(everything), "max_value": F.max("value").over(everything)})


def pick_columns(df: DataFrame) -> tuple[str, str | None]:
    """(x, y): the first column, and the first numeric one or else the second."""
    names = df.columns
    numeric = [f.name for f in df.schema.fields[1:] if isinstance(f.dataType, T.NumericType)] or [f.name for f in df.schema.fields[:1] if isinstance(f.dataType, T.NumericType)]
    return names[0], numeric[0] if numeric else names[1] if len(names) > 1 else None


def progress_percent(processed: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(processed * 100.0 / total + 0.5)).otherwise(0)


def success_percent(total: Column, errors: Column) -> Column:
    return F.when(total > 0, F.format_string("%.1f", (total - errors) * 100.0 / total)).otherwise("0.0")


def checks_by_table(checks: DataFrame) -> DataFrame:
    return checks.groupBy(F.concat_ws(".", "schema_name", "table_name").alias("table")).agg(F.sort_array(F.collect_list("check_id")).alias("checks"))


def match_columns(source: list[str], target: list[str]) -> dict[str, str]:
    """Columns with the same name but for case; others are left out."""
    by = {t.lower(): t for t in reversed(target)}
    return {s: by[s.lower()] for s in source if s.lower() in by}


def combined_cells(cells: Column) -> Column:
    """combine_cells over a column of JSON texts: the SQL cells of each notebook in their order (without one, as 0; ties by place), joined to one text."""
    parsed = F.from_json(cells, "array<struct<type:string,content:string,order:int>>")
    sql = F.filter(F.transform(parsed, lambda c, i: F.struct(F.coalesce(c["order"], F.lit(0)).alias("order"), i.alias("i"), c["type"].alias("type"), F.regexp_replace(c["content"], r"\A\s+|\s+\z", "").alias("text"))), lambda c: (c["type"] == "sql") & (c["text"] != ""))
    return F.array_join(F.transform(F.array_sort(sql), lambda c: c["text"]), ";\n\n")


def combine_cells(cells: list[dict], selected: set[str] | None = None) -> str:
    """The SQL cells of a notebook in their order, joined to one text."""
    texts = [c["content"].strip() for c in sorted(cells, key=lambda c: c.get("order", 0)) if c.get("type") == "sql" and (selected is None or c["id"] in selected)]
    return ";\n\n".join(t for t in texts if t)
