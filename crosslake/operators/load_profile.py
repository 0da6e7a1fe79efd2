"""Column profiles of loads, constraints against an agreed profile, and control limits.

The agreed profile is compiled into aggregates of one scan for each table. Their values are
states that merge: of partitions, of days, of a load that arrives in pieces. Counts, sums,
extremes and the counts around half and twice the agreed median are exact; distinct counts
are HyperLogLog sketches, and where a sketch is too near a limit the load is counted exactly.
Each column's values are also in a KLL sketch, exact below RANKS_K values: numbers as they
are, texts by a hash, times not at all. It gives the medians, and the distance between the
distributions of loads.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslake.functions.common import Scratch, local_rows, ship

SKETCH_LG_K = 12  # standard error 1.6 %
SKETCH_GUARD = 0.08  # five standard errors
RANKS_K = 4096  # rank error 0.13 % with 99 % probability
KLL_ERROR = 0.0013
SHIFT_POINTS = 512  # quantiles of either load where distributions are compared
MOST_PROFILED_COLUMNS = 20_000
NULL_RATE_POINTS, DISTINCT_FLOOR, DISTINCT_POINTS, PATTERN_PERCENT = 8.0, 90.0, 10.0, 2.0
_NUMBERS = ("integer", "int", "bigint", "smallint", "numeric", "decimal", "real", "double", "double precision", "float")


STATE = (
    "table_name string, load_no int, n bigint, column_name string, nulls bigint, low string, high string, total double, outside bigint, mismatches bigint, "
    "under bigint, under_max double, under_min double, over bigint, over_max double, over_min double, distinct binary, ranks binary"
)


@dataclass(frozen=True)
class Agreed:
    """One row of the agreed profile."""

    table_name: str
    column_name: str
    data_type: str
    null_percent: float | None
    distinct_percent: float | None
    min_value: str | None
    max_value: str | None
    median_value: float | None
    value_pattern: str | None


def agreed_profiles(table_profiles: DataFrame) -> list[Agreed]:
    """The agreed profile's rows: one for each column of each table, so few; more than MOST_PROFILED_COLUMNS is an error.

    Rows without table or column name nothing; a missing type is text, and a limit that is
    no number or time limits nothing.
    """
    names = list(Agreed.__dataclass_fields__)
    rows = table_profiles.select(*names).dropDuplicates(["table_name", "column_name"]).limit(MOST_PROFILED_COLUMNS + 1).collect()
    if len(rows) > MOST_PROFILED_COLUMNS:
        raise ValueError(f"over {MOST_PROFILED_COLUMNS} profiled columns")
    named = [r.asDict() | {"data_type": (r.data_type or "text").lower()} for r in rows if r.table_name is not None and r.column_name is not None]
    return [Agreed(**r) for r in sorted(named, key=lambda r: (r["table_name"], r["column_name"]))]


def all_columns(df: DataFrame, load_col: str, agreed: list[Agreed], table_name: str) -> list[Agreed]:
    """The agreed columns, then each other column of the table but the load number, without limits."""
    named = {load_col.lower(), *(a.column_name.lower() for a in agreed)}
    kind = lambda t: "numeric" if isinstance(t, T.NumericType) else "timestamp" if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else "date" if isinstance(t, T.DateType) else "text"
    return agreed + [Agreed(table_name, f.name, kind(f.dataType), *[None] * 6) for f in df.schema.fields if f.name.lower() not in named]


def _limit(text: str, data_type: str) -> Column:
    if data_type.startswith("timestamp") or data_type == "date":
        return F.lit(text.rstrip("Zz").replace("T", " ")).try_cast("timestamp_ntz")
    return F.lit(text).try_cast("double")


def column_states(df: DataFrame, load_col: str, agreed: list[Agreed], sketches: bool = True) -> DataFrame:
    """The mergeable state of every profiled column and load, by one scan of the table.

    Columns: table_name, load_no, column_name, n, nulls, low and high (extremes as text),
    total (sum of numbers), outside, mismatches, and around half and twice the agreed
    median: under, under_max, under_min, over, over_max, over_min; distinct and ranks (sketches).
    Agreed columns that the table lacks count as wholly null. A null load number is a load
    of its own.
    """
    if not agreed:
        return df.sparkSession.createDataFrame([], STATE)
    have = {c.lower(): c for c in df.columns}
    aggs, packed = [F.count(F.lit(1)).alias("n")], []
    for i, a in enumerate(agreed):
        numeric, timed = a.data_type in _NUMBERS, a.data_type.startswith("timestamp")
        raw = F.col(f"`{have[a.column_name.lower()]}`") if a.column_name.lower() in have else F.lit(None).cast("string")
        v = raw.cast("double") if numeric else raw.cast("timestamp_ntz") if timed else raw
        if isinstance(df.select(raw).schema[0].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            v = raw = F.to_json(raw)  # values without an order of their own
        outside = F.lit(False)
        if a.min_value is not None:
            outside = outside | F.coalesce(v < _limit(a.min_value, a.data_type), F.lit(False))
        if a.max_value is not None:
            outside = outside | F.coalesce(v > _limit(a.max_value, a.data_type), F.lit(False))
        none = F.lit(None).cast("double")
        half = twice = None
        if a.median_value is not None:
            half, twice = v < a.median_value / 2, v > a.median_value * 2
        states = {
            "nulls": F.count_if(raw.isNull()),
            "low": F.min(v).cast("string"),
            "high": F.max(v).cast("string"),
            "total": F.sum(v) if numeric else F.first(none),
            "outside": F.count_if(outside),
            "mismatches": F.count_if(~raw.cast("string").rlike(a.value_pattern)) if a.value_pattern else F.first(F.lit(0).cast("bigint")),
            "under": F.count_if(half) if half is not None else F.first(F.lit(0).cast("bigint")),
            "under_max": F.max(F.when(half, v)) if half is not None else F.first(none),
            "under_min": F.min(F.when(~half, v)) if half is not None else F.first(none),
            "over": F.count_if(twice) if twice is not None else F.first(F.lit(0).cast("bigint")),
            "over_max": F.max(F.when(~twice, v)) if twice is not None else F.first(none),
            "over_min": F.min(F.when(twice, v)) if twice is not None else F.first(none),
        }
        if sketches or (a.distinct_percent or 0) >= DISTINCT_FLOOR:
            states["distinct"] = F.hll_sketch_agg(raw.cast("string"), F.lit(SKETCH_LG_K))
        if sketches and not timed:  # times go on from load to load
            place = v if numeric else F.when(raw.isNotNull(), F.shiftrightunsigned(F.xxhash64(raw.cast("string")), 11) / float(1 << 53))
            states["ranks"] = F.kll_sketch_agg_double(place, F.lit(RANKS_K))
        aggs += [x.alias(f"{k}_{i}") for k, x in states.items()]
        fields = [F.lit(a.column_name).alias("column_name"), *[F.col(f"{k}_{i}").alias(k) for k in states if k not in ("distinct", "ranks")]]
        packed.append(F.struct(*fields, *[(F.col(f"{k}_{i}") if k in states else F.lit(None).cast("binary")).alias(k) for k in ("distinct", "ranks")]))
    name = agreed[0].table_name
    wide = df.groupBy(F.col(load_col).alias("load_no")).agg(*aggs)
    return wide.select(F.lit(name).alias("table_name"), "load_no", "n", F.explode(F.array(*packed)).alias("s")).select("table_name", "load_no", "n", "s.*")


def merge_states(states: DataFrame) -> DataFrame:
    """States of parts of the same loads (partitions, days, later deliveries) as one state for each load and column.

    ``low`` and ``high`` merge as numbers where they are numbers, else as text.
    """
    num = lambda c: F.expr(f"try_cast({c} as double)")
    return states.groupBy("table_name", "load_no", "column_name").agg(
        *[F.sum(c).alias(c) for c in ("n", "nulls")],
        F.min_by("low", F.struct(num("low"), "low")).alias("low"), F.max_by("high", F.struct(num("high"), "high")).alias("high"),
        *[F.sum(c).alias(c) for c in ("total", "outside", "mismatches", "under", "over")],
        *[F.max(c).alias(c) for c in ("under_max", "over_max")], *[F.min(c).alias(c) for c in ("under_min", "over_min")],
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"),
    )


def profiles(states: DataFrame) -> DataFrame:
    """The profile of every column and load as in the agreed one; distinct counts and medians (of numbers) within the sketches' errors.

    range_percent and pattern_percent are the violations in percent of the values that are not null.
    """
    filled = F.col("n") - F.col("nulls")
    est = F.least(F.hll_sketch_estimate("distinct"), filled)
    held = F.when(F.col("total").isNotNull(), F.kll_sketch_get_n_double("ranks"))  # NaN is in no sketch
    top = F.lit(bytes(states.sparkSession.range(1).agg(F.kll_sketch_agg_double(F.lit(float("inf")), F.lit(RANKS_K))).first()[0]))
    middle = [F.kll_sketch_get_quantile_double(s, F.lit(0.5)) for s in (F.col("ranks"), F.kll_sketch_merge_double("ranks", top))]  # one value more on top gives the upper of two middle ones
    rate = lambda c: F.when(filled > 0, F.col(c) * 100.0 / filled)
    return states.select(
        "table_name", "load_no", "column_name", F.col("n").alias("total_rows"), F.col("nulls").alias("null_count"), (F.col("nulls") * 100.0 / F.col("n")).alias("null_percent"),
        est.alias("distinct_count"), (est * 100.0 / F.col("n")).alias("distinct_percent"), F.col("low").alias("min_value"), F.col("high").alias("max_value"),
        F.when(held > 0, (middle[0] + middle[1]) / 2).alias("median_value"), F.when(filled > 0, F.col("total") / filled).alias("mean_value"), F.col("outside").alias("range_violations"), F.col("mismatches").alias("pattern_violations"),
        rate("outside").alias("range_percent"), rate("mismatches").alias("pattern_percent"),
    )


def _frame(states: DataFrame, agreed: list[Agreed]) -> DataFrame:
    spark = states.sparkSession
    rows = [(a.table_name, a.column_name, a.null_percent, a.distinct_percent, a.median_value) for a in agreed]
    return local_rows(spark, rows, "table_name string, column_name string, a_null double, a_distinct double, a_median double")


def departures(states: DataFrame, agreed: list[Agreed], tables: dict[str, DataFrame], load_col: str = "load_no") -> DataFrame:
    """Where loads depart from the agreed profile: table_name, load_no, column_name, issue.

    The issues are null_rate, distinct, range, pattern and shift. All but distinct are exact:
    the median is compared with its limits through counts of the values on either side. For
    distinct the sketch decides where it is more than SKETCH_GUARD, five standard errors,
    from the limit (wrong about once in a million), and the values in ``tables`` elsewhere.
    """
    s = states.join(F.broadcast(_frame(states, agreed)), ["table_name", "column_name"])  # at most MOST_PROFILED_COLUMNS rows
    m = F.col("n") - F.col("nulls")
    odd, k = m % 2 == 1, F.floor(m / 2)
    half, twice = F.col("a_median") / 2, F.col("a_median") * 2
    low = F.when(odd, F.col("under") > k).otherwise((F.col("under") > k) | ((F.col("under") == k) & ((F.col("under_max") + F.col("under_min")) / 2 < half)))
    high = F.when(odd, F.col("over") > k).otherwise((F.col("over") > k) | ((F.col("over") == k) & ((F.col("over_max") + F.col("over_min")) / 2 > twice)))
    shift = (m > 0) & F.col("a_median").isNotNull() & F.coalesce(low | high, F.lit(False))
    limit = (F.col("a_distinct") - DISTINCT_POINTS) * F.col("n") / 100
    est = F.hll_sketch_estimate("distinct")
    asked = F.coalesce(F.col("a_distinct") >= DISTINCT_FLOOR, F.lit(False))
    near = asked & (F.abs(est - limit) <= SKETCH_GUARD * F.greatest(est.cast("double"), limit)) & (m > 0)
    found = {
        "null_rate": F.coalesce(F.abs(F.col("nulls") * 100.0 / F.col("n") - F.col("a_null")) > NULL_RATE_POINTS, F.lit(False)),
        "distinct": asked & ~near & (F.when(m > 0, est).otherwise(0) < limit),
        "range": F.col("outside") > 0,
        "pattern": F.col("mismatches") * 100.0 > PATTERN_PERCENT * m,
        "shift": shift,
    }
    issues = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in found.items()]))
    scratch = Scratch(states.sparkSession, "profile")
    judged = scratch.write(s.select("table_name", "load_no", "column_name", issues.alias("issues"), F.when(near, limit).alias("limit")))
    out = judged.select("table_name", "load_no", "column_name", F.explode("issues").alias("issue"))
    near_limit = {(r.table_name, r.column_name) for r in judged.where("limit is not null").select("table_name", "column_name").distinct().collect()}  # profiled columns
    for a in agreed:
        have = {c.lower(): c for c in tables[a.table_name].columns}
        if (a.table_name, a.column_name) in near_limit and (a.distinct_percent or 0) >= DISTINCT_FLOOR and a.column_name.lower() in have:
            unsure = judged.where((F.col("table_name") == a.table_name) & (F.col("column_name") == a.column_name) & F.col("limit").isNotNull()).select(F.col("load_no").alias("l"), "limit")
            t = tables[a.table_name].select(F.col(load_col).alias("load_no"), F.col(f"`{have[a.column_name.lower()]}`").alias("x"))
            exact = t.join(unsure, F.expr("load_no <=> l")).groupBy("load_no").agg(F.countDistinct("x").alias("distinct"), F.first("limit").alias("limit")).where("distinct < limit")
            out = out.unionByName(exact.select(F.lit(a.table_name).alias("table_name"), "load_no", F.lit(a.column_name).alias("column_name"), F.lit("distinct").alias("issue")))
    return out


def control_limits(profile: DataFrame, history: int = 20, least: int = 8, sigmas: float = 3.0) -> DataFrame:
    """Metrics of loads outside mean ± ``sigmas`` standard deviations of the ``history`` loads before (at least ``least``).

    The metrics are the rates of nulls, distinct values, range and pattern violations, mean
    and median, as far as the profile has them. Result: table_name, load_no, column_name,
    metric, value, lower, upper. A value that differs from the mean by rounding only is
    within. Works on profiles, so its size follows loads and columns, not rows.
    """
    metrics = [m for m in ("null_percent", "distinct_percent", "mean_value", "median_value", "range_percent", "pattern_percent") if m in profile.columns]
    long = profile.select("table_name", "load_no", "column_name", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("table_name", "load_no", "column_name", "x.*")
    w = Window.partitionBy("table_name", "column_name", "metric").orderBy("load_no").rowsBetween(-history, -1)
    mean, sd, n = F.avg("value").over(w), F.stddev_samp("value").over(w), F.count("value").over(w)
    wide = F.greatest(sigmas * sd, 1e-9 * F.greatest(F.abs(mean), F.lit(1.0)))
    return long.withColumns({"lower": mean - wide, "upper": mean + wide, "n": n}).where((F.col("n") >= least) & ((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))).drop("n")


@F.pandas_udf(T.DoubleType())
def _distance(now: pd.Series, before: pd.Series) -> pd.Series:
    """The greatest distance between two distributions given by their quantiles at even steps; a row for each load and column."""

    def one(a: np.ndarray, b: np.ndarray) -> float:
        at = np.concatenate([a, b])
        return float(np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)).max())

    return pd.Series([one(a, b) for a, b in zip(now, before)])


def distribution_shifts(states: DataFrame, history: int = 20, least: int = 1, least_distance: float = 0.1, doubt: float = 1e-6) -> DataFrame:
    """Columns of loads whose values are distributed otherwise than in the ``history`` loads before together.

    The Kolmogorov–Smirnov distance between the two, from the sketches in the states: it sees
    changes that leave rates and means as they were, and changed shares of texts (by a hash)
    too. Reported where it is at least ``least_distance`` and above what chance gives with
    probability ``doubt`` for samples of these sizes, the sketches' errors included. Loads
    without values, or with fewer than ``least`` loads before, have no distance. Result:
    table_name, load_no, column_name, distance, bound, n_values, n_before.
    """
    ship(states.sparkSession)
    w = Window.partitionBy("table_name", "column_name").orderBy("load_no").rowsBetween(-history, -1)
    met = states.withColumns({"past": F.kll_merge_agg_double("ranks").over(w), "loads": F.count("ranks").over(w)}).where(F.col("loads") >= least)
    n, m = F.kll_sketch_get_n_double("ranks"), F.kll_sketch_get_n_double("past")
    met = met.withColumns({"n_values": n, "n_before": m}).where("n_values > 0 and n_before > 0")
    points = F.array(*[F.lit(i / SHIFT_POINTS) for i in range(SHIFT_POINTS + 1)])
    pair = [F.kll_sketch_get_quantile_double(s, points) for s in ("ranks", "past")]
    critical = math.sqrt(-math.log(doubt / 2) / 2)
    bound = F.greatest(F.lit(least_distance), critical * F.sqrt((F.col("n_values") + F.col("n_before")) / (F.col("n_values") * F.col("n_before"))) + 2 * KLL_ERROR + 1 / SHIFT_POINTS)
    out = met.withColumns({"distance": _distance(*pair), "bound": bound}).where("distance > bound")
    return out.select("table_name", "load_no", "column_name", "distance", "bound", "n_values", "n_before")
