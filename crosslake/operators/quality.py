"""Table profiles and quality checks; all checks of a table share one aggregate."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslake.functions.scalars import round_half_up
from crosslake.plans.binding import bind, frames_resolver
from crosslake.plans.guards import UnsafeSql, is_safe_query

CHECK_TYPES = ("not_null", "unique", "min_rows", "max_rows", "freshness", "custom_sql")
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def profile_table(df: DataFrame, sample_rows: int | None = None, max_columns: int = 200, exact: bool = True, typed_extremes: bool = False) -> DataFrame:
    """One row for each column: name, data_type, total_rows, null_count, null_percent, distinct_count, distinct_percent, min, max, avg, stddev.

    min and max are those of the texts; ``typed_extremes`` adds typed_min and typed_max.
    avg and stddev (of the sample) are for numbers, to two decimals. ``exact=False`` counts
    distinct values by sketches in the same scan; otherwise one more pass turns the columns
    into rows of (column, value), which are counted as groups, so neither the number of
    scans nor the width of a row grows with the columns. An empty table has counts and
    percents of 0.
    """
    if len(df.columns) > max_columns:
        raise ValueError(f"Table has {len(df.columns)} columns; profiling is capped at {max_columns}")
    if sample_rows:
        df = df.limit(sample_rows)
    fields = df.schema.fields
    aggs, recs = [F.count(F.lit(1)).alias("total")], []
    total, none = F.col("total"), F.lit(None)
    share = lambda n: F.when(total > 0, F.floor(n / total * 10000 + 0.5) / 100).otherwise(0.0)
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        text, number, nested = c.cast("string"), isinstance(f.dataType, T.NumericType), isinstance(f.dataType, _NESTED)
        aggs += [F.count(c).alias(f"n{i}"), F.min(text).alias(f"lo{i}"), F.max(text).alias(f"hi{i}")]
        if not exact:
            aggs.append(F.approx_count_distinct(_distinct_text(c, f.dataType)).alias(f"d{i}"))
        if number:
            aggs += [F.avg(c).alias(f"avg{i}"), F.stddev_samp(c).alias(f"sd{i}")]
        if typed_extremes and not nested:
            aggs += [F.min(c).cast("string").alias(f"tlo{i}"), F.max(c).cast("string").alias(f"thi{i}")]
        nulls = total - F.col(f"n{i}")
        recs.append(F.struct(
            F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("data_type"), total.alias("total_rows"), nulls.alias("null_count"), share(nulls).alias("null_percent"),
            (F.lit(0).cast("bigint") if exact else F.col(f"d{i}")).alias("distinct_count"), F.lit(0.0).alias("distinct_percent"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            (round_half_up(F.col(f"avg{i}").cast("double")) if number else none.cast("double")).alias("avg"), (round_half_up(F.col(f"sd{i}")) if number else none.cast("double")).alias("stddev"),
            *([(F.col(f"tlo{i}") if not nested else none.cast("string")).alias("typed_min"), (F.col(f"thi{i}") if not nested else none.cast("string")).alias("typed_max")] if typed_extremes else []),
            F.lit(i).alias("__i"),
        ))
    out = df.agg(*aggs).select(F.explode(F.array(*recs)).alias("p")).select("p.*")
    if exact:
        values = df.select(*[_distinct_text(F.col(f"`{f.name}`"), f.dataType).alias(str(i)) for i, f in enumerate(fields)]).unpivot([], [str(i) for i in range(len(fields))], "__c", "v")
        counts = values.where("v is not null").groupBy("__c", "v").agg(F.lit(1).alias("one")).groupBy("__c").agg(F.count(F.lit(1)).alias("__d"))
        out = out.join(F.broadcast(counts.limit(max_columns)), F.col("__i").cast("string") == F.col("__c"), "left").withColumn("distinct_count", F.coalesce("__d", F.lit(0))).drop("__c", "__d")  # a row for each column
    percent = F.when(F.col("total_rows") > 0, F.floor(F.col("distinct_count") / F.col("total_rows") * 10000 + 0.5) / 100).otherwise(0.0)
    return out.withColumn("distinct_percent", percent).drop("__i")


def _distinct_text(c: Column, t: T.DataType) -> Column:
    """A text that is equal for equal values only; zeros of either sign are equal."""
    if isinstance(t, _NESTED):
        return F.to_json(c)
    if isinstance(t, T.BinaryType):
        return F.hex(c)
    return (c + F.lit(0.0).cast(t)).cast("string") if isinstance(t, (T.DoubleType, T.FloatType)) else c.cast("string")


@dataclass
class QualityCheck:
    id: str
    type: str
    column: str | None = None
    config: dict = field(default_factory=dict)
    active: bool = True

    def __post_init__(self) -> None:
        if self.type not in CHECK_TYPES:
            raise ValueError(f"Unknown check type: {self.type}")
        if self.type in ("not_null", "unique", "freshness") and not self.column:
            raise ValueError(f"{self.type} needs a column")

    def value(self, now: Column) -> Column | None:
        """The measured number as an aggregate; custom SQL has none."""
        c, n = F.col(f"`{self.column}`") if self.column else None, F.count(F.lit(1))
        if self.type == "not_null":
            return (n - F.count(c)) * 100.0 / F.nullif(n, F.lit(0))
        if self.type == "unique":
            return F.count_distinct(c) * 100.0 / F.nullif(n, F.lit(0))
        if self.type in ("min_rows", "max_rows"):
            return n.cast("double")
        if self.type == "freshness":
            return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.max(c).cast("timestamp"))) / 3.6e9
        return None

    def passed(self, v: Column) -> Column:
        """The verdict; null when nothing was measured, which fails."""
        g = self.config.get
        if self.type == "not_null":
            return v <= float(g("maxNullPercent", 0))
        if self.type == "unique":
            return v >= float(g("minDistinctPercent", 100))
        if self.type == "min_rows":
            return v >= float(g("minRows", 0))
        if self.type == "max_rows":
            return v <= float(g("maxRows", float("inf")))
        if self.type == "freshness":
            return v <= float(g("maxAgeHours", 24))
        t = float(g("threshold", 0))
        ops = {"gt": v > t, "gte": v >= t, "lt": v < t, "lte": v <= t, "eq": v == t}
        return ops[g("operator", "gte")]

    def expected(self) -> str:
        g = self.config.get
        return {
            "not_null": f"null % <= {g('maxNullPercent', 0)}", "unique": f"distinct % >= {g('minDistinctPercent', 100)}", "min_rows": f"rows >= {g('minRows', 0)}", "max_rows": f"rows <= {g('maxRows', 'unlimited')}",
            "freshness": f"age <= {g('maxAgeHours', 24)} hours", "custom_sql": f"result {g('operator', 'gte')} {g('threshold', 0)}",
        }[self.type]


def check_suite(df: DataFrame, checks: list[QualityCheck], now: Column) -> DataFrame:
    """All but custom checks of one table by one scan: check_id, status (pass or fail), actual_value, expected_desc."""
    live = [c for c in checks if c.active and c.type != "custom_sql"]
    if not live:
        return df.sparkSession.createDataFrame([], "check_id string, status string, actual_value double, expected_desc string")
    one = df.agg(*[c.value(now).cast("double").alias(f"v{i}") for i, c in enumerate(live)])
    recs = [
        F.struct(F.lit(c.id).alias("check_id"), F.when(c.passed(F.col(f"v{i}")), "pass").otherwise("fail").alias("status"), F.col(f"v{i}").alias("actual_value"), F.lit(c.expected()).alias("expected_desc"))
        for i, c in enumerate(live)
    ]
    return one.select(F.explode(F.array(*recs)).alias("r")).select("r.*")


def custom_check(spark: SparkSession, check: QualityCheck, tables: dict[str, DataFrame], sql: str | None = None) -> DataFrame:
    """A custom check: the first cell of the first row of its SQL, as a number, against the threshold. The SQL reads ``tables`` only."""
    text = sql or check.config["sql"]
    if not is_safe_query(text):
        raise UnsafeSql("SQL query contains potentially dangerous patterns or commands")
    got = bind(spark, text, frames_resolver(tables)).limit(1)
    v = got.select(F.col(f"`{got.columns[0]}`").try_cast("double").alias("v")).agg(F.first("v").alias("v"))
    return v.select(F.lit(check.id).alias("check_id"), F.when(check.passed(F.col("v")), "pass").otherwise("fail").alias("status"), F.col("v").alias("actual_value"), F.lit(check.expected()).alias("expected_desc"))


@dataclass
class CheckRunner:
    """Runs checks and keeps their runs; a check that cannot run is an error of its own."""

    tables: dict[str, DataFrame]
    now: Column
    clock: object = datetime.now
    runs: list[dict] = field(default_factory=list)

    def run(self, table: str, checks: list[QualityCheck]) -> list[dict]:
        if stopped := [c.id for c in checks if not c.active]:
            raise ValueError(f"Check is not active: {stopped[0]}")
        df, out = self.tables[table], []
        fused = [c for c in checks if c.type != "custom_sql" and (c.column is None or c.column in df.columns)]
        for group in ([fused] if fused else []) + [[c] for c in checks if c not in fused]:
            began = time.time()
            try:
                got = check_suite(df, group, self.now) if group[0].type != "custom_sql" else custom_check(df.sparkSession, group[0], self.tables)
                rows = [r.asDict() | {"error_message": None} for r in got.collect()]  # one row for each check
            except Exception as e:  # noqa: BLE001 - the run records it
                rows = [{"check_id": c.id, "status": "error", "actual_value": None, "expected_desc": c.expected(), "error_message": str(e).splitlines()[0]} for c in group]
            ms = int((time.time() - began) * 1000)
            out += [r | {"duration_ms": ms, "ran_at": self.clock()} for r in rows]
        self.runs += out
        return out

    def last_runs(self, check_id: str, n: int = 50) -> list[dict]:
        return [r for r in reversed(self.runs) if r["check_id"] == check_id][:n]
