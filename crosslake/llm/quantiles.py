"""Percentiles per group with a stated rank error, mergeable across loads, days and partitions.

The states are KLL sketches: a hierarchy of compactors, each of which sorts itself when full
and promotes alternate values, chosen by a random bit, to the level above. Two sketches merge
level by level. They are aggregated inside the JVM, partially before the shuffle, so a group
of any size costs one sketch for each input partition. Whole numbers have sketches of 64-bit
integers, all others of doubles; the type of ``least`` in a state tells which.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslake.functions.common import Scratch

SKETCH_K = 512
PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def rank_error(k: int = SKETCH_K) -> float:
    """The bound of the rank error of one percentile, as a share of the group's values, that holds with 99 % probability (published fit for KLL)."""
    return 2.296 / k**0.9723


def _value(df: DataFrame, value: str) -> Column:
    """The column as bigint or double, whichever holds each of its values; a type that neither holds is an error. NaN is no value."""
    c, t = F.col(value), df.schema[value].dataType
    if isinstance(t, T.IntegralType) or (isinstance(t, T.DecimalType) and t.scale == 0 and t.precision <= 18):
        return c.cast("bigint")
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(t, T.DecimalType) and t.precision <= 15:
        return c.cast("double")
    raise ValueError(f"No percentiles of {value}: neither bigint nor double holds all values of {t.simpleString()}")


def _kind(states: DataFrame) -> str:
    return "double" if isinstance(states.schema["least"].dataType, T.DoubleType) else "bigint"


def percentile_states(df: DataFrame, keys: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """One mergeable state for each combination of ``keys`` (which may be null): the keys, n_values, least, greatest, sketch.

    Null values and NaN do not count; a group without values has n_values 0 and a null
    sketch. Whole numbers, fractions, and decimals of up to 15 digits (18 without a scale)
    keep their values; other types are an error. An empty table has no groups.
    """
    v = _value(df, value)
    kind = "double" if isinstance(df.select(v.alias("v")).schema["v"].dataType, T.DoubleType) else "bigint"
    sketch = F.kll_sketch_agg_double if kind == "double" else F.kll_sketch_agg_bigint
    return df.groupBy(*keys).agg(F.count(v).alias("n_values"), F.min(v).alias("least"), F.max(v).alias("greatest"), sketch(v, k).alias("sketch")).withColumn("sketch", F.when(F.col("n_values") > 0, F.col("sketch")))


def merge_percentile_states(states: DataFrame, keys: list[str], k: int = SKETCH_K) -> DataFrame:
    """States of finer groups (single loads, days, partitions) combined into one for each combination of ``keys``."""
    merge = F.kll_merge_agg_double if _kind(states) == "double" else F.kll_merge_agg_bigint
    return states.groupBy(*keys).agg(F.sum("n_values").alias("n_values"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), merge("sketch", k).alias("sketch"))


def percentiles(states: DataFrame, percents: tuple[float, ...] = PERCENTILES, k: int = SKETCH_K) -> DataFrame:
    """The keys, n_values, and p50 ... for each percentile, with the bound ``rank_error``.

    A percentile is a value of the group whose rank is within the bound of the asked one;
    in groups of up to ``k`` values nothing was compacted and the bound is 0.
    """
    drop = ("least", "greatest", "sketch")
    get = F.kll_sketch_get_quantile_double if _kind(states) == "double" else F.kll_sketch_get_quantile_bigint
    asked = [F.when(F.col("n_values") > 0, get("sketch", F.lit(p))).alias(f"p{p * 100:g}") for p in percents]
    error = F.when(F.col("n_values") <= k, 0.0).otherwise(rank_error(k)).alias("rank_error")
    return states.select(*[c for c in states.columns if c not in drop], *asked, error)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, percents: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """The keys, n_values, and p50 ... without a rank error, for groups of any size: the value of rank ceil(percent * n_values), at least the first.

    Null values and NaN do not count; a group without values has n_values 0 and null
    percentiles. Equal values are counted together, then sorted by range over all groups, so
    a hot group is many tasks' work; each range of a group tells how many values lie before
    it, and only the ranges that hold an asked rank are numbered.
    """
    counts = df.select(*keys, _value(df, value).alias("__v")).groupBy(*keys, "__v").agg(F.count("__v").alias("__n"))  # none for null
    rows = Scratch(df.sparkSession, "ranks").write(counts.repartitionByRange(*keys, "__v").withColumn("__p", F.spark_partition_id()))
    group = Window.partitionBy(*keys)  # one row for each range of a group
    ranges = rows.groupBy("__p", *keys).agg(F.sum("__n").alias("__in"))
    ranges = ranges.withColumns({"n_values": F.sum("__in").over(group), "__before": F.sum("__in").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__in")})
    ranks = [F.greatest(F.lit(1), F.ceil(F.lit(Decimal(str(p))) * F.col("n_values"))).cast("bigint") for p in percents]
    asked = F.col("n_values") == 0
    for r in ranks:
        asked = asked | ((r > F.col("__before")) & (r <= F.col("__before") + F.col("__in")))
    mine = [F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]
    on = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__{i}"))
    near = rows.join(ranges.where(asked).select(F.col("__p").alias("__q"), *mine, "n_values", "__before"), on)
    to = F.col("__before") + F.sum("__n").over(Window.partitionBy("__p", *keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    numbered = near.withColumn("__to", to)
    at = [F.max(F.when((r <= F.col("__to")) & (r > F.col("__to") - F.col("__n")), F.col("__v"))).alias(f"p{p * 100:g}") for p, r in zip(percents, ranks)]
    return numbered.groupBy(*keys, "n_values").agg(*at)


def rank_check(values: DataFrame, found: DataFrame, keys: list[str], value: str, percents: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """Percentiles against exact ranks: the keys, percent, n_values, and off, the distance of the asked rank from the ranks the found value holds, as a share of the values.

    Of equal values every rank counts. Values are counted once for each group and value
    before they meet the percentiles, so a hot group costs its distinct values.
    """
    v = _value(values, value)
    mine = [F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]
    counts = values.where(v.isNotNull()).groupBy(*mine, v.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    long = found.where("n_values > 0").select(*keys, "n_values", F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"p{p * 100:g}").alias("at")) for p in percents])).alias("q")).select(*keys, "n_values", "q.*")
    wide = long.groupBy(*keys, "n_values").agg(F.collect_list(F.struct("percent", "at")).alias("qs"))  # as many as percents
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"__{i}"))
        on = same if on is None else on & same
    each = counts.join(wide, on).select(*keys, "n_values", "__v", "__n", F.explode("qs").alias("q"))
    per = each.groupBy(*keys, "n_values", F.col("q.percent").alias("percent")).agg(F.sum(F.when(F.col("__v") < F.col("q.at"), F.col("__n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("__v") <= F.col("q.at"), F.col("__n")).otherwise(0)).alias("to"))
    off = F.greatest(F.lit(0.0), F.col("below") / F.col("n_values") - F.col("percent"), F.col("percent") - F.col("to") / F.col("n_values"))
    return per.select(*keys, "percent", "n_values", off.alias("off"))
