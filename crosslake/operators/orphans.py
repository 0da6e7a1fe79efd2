"""References to records that do not exist, were deleted, or arrive later.

Ids become integers without loss: an id is a space (everything before its last digits, and
how many digits there are) and a number. Parent numbers are compressed into runs of
consecutive ones; each distinct reference number finds the run that starts before it, and
is an orphan beyond the run's end. Runs also carry the earliest and latest times of their
parents, so that only references which a run cannot clear are compared with single parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 16  # a run ends at multiples of 2^16, so no sort group has more than 2^17 rows
_TAIL = r"([0-9]{1,17})\z"


def key_of(scope: Column, ref: Column) -> list[Column]:
    """An id as (space, number); exact: two ids have the same pair only if they are equal."""
    digits = F.regexp_extract(ref, _TAIL, 1)
    prefix = F.substring(ref, F.lit(1), F.length(ref) - F.length(digits))
    return [F.concat_ws("\u001f", scope, F.length(digits).cast("string"), prefix).alias("space"), F.when(digits == "", 0).otherwise(digits).cast("bigint").alias("num")]


def parent_runs(parents: DataFrame) -> DataFrame:
    """Runs of consecutive parent numbers: space, bucket, start, end, first_created, last_created, first_deleted."""
    one = parents.groupBy("space", "num").agg(F.min("created_at").alias("c"), F.min("deleted_at").alias("d")).withColumn("bucket", F.shiftright("num", BUCKET_BITS))
    w = Window.partitionBy("space", "bucket").orderBy("num")
    return one.withColumn("island", F.col("num") - F.row_number().over(w)).groupBy("space", "bucket", "island").agg(F.min("num").alias("start"), F.max("num").alias("end"), F.max("c").alias("last_created"), F.min("d").alias("first_deleted")).drop("island")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Each faulty reference with its state: the columns of ``refs`` but space and num, and ``state``.

    refs: space, num (key_of), at (timestamp or null) and any columns to keep;
    parents: space, num, created_at, deleted_at (copies of a parent count once).
    state: ``missing`` (no such parent), ``late`` (created after ``at``) or ``deleted``
    (deleted at or before ``at``), the first that applies; a null time is never late or
    deleted. A hot key costs one row for each input partition until the last join, whose
    other side holds faulty keys only and which adaptive execution splits where skewed.
    """
    keys = refs.groupBy("space", "num").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    null = lambda t: F.lit(None).cast(t)
    at = refs.schema["at"].dataType
    runs = parent_runs(parents).select("space", "bucket", F.col("start").alias("num"), F.lit(0).alias("is_ref"), F.struct("end", "last_created", "first_deleted").alias("run"), null(at).alias("lo"), null(at).alias("hi"))
    asked = keys.select("space", F.shiftright("num", BUCKET_BITS).alias("bucket"), "num", F.lit(1).alias("is_ref"), null(runs.schema["run"].dataType).alias("run"), "lo", "hi")
    w = Window.partitionBy("space", "bucket").orderBy("num", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    met = runs.unionByName(asked).withColumn("run", F.last("run", ignorenulls=True).over(w)).where("is_ref = 1")
    there = F.coalesce(F.col("num") <= F.col("run.end"), F.lit(False))
    clear = there & F.coalesce(F.col("run.last_created") <= F.col("lo"), F.lit(True)) & F.coalesce(F.col("run.first_deleted") > F.col("hi"), F.lit(True))
    doubt = met.where(~clear).select("space", "num", there.alias("__there"))
    single = parents.where("created_at is not null or deleted_at is not null").groupBy("space", "num").agg(F.min("created_at").alias("__c"), F.min("deleted_at").alias("__d"))
    faulty = doubt.join(single, ["space", "num"], "left")
    state = F.when(~F.col("__there"), "missing").when(F.col("__c") > F.col("at"), "late").when(F.col("__d") <= F.col("at"), "deleted")
    return refs.join(faulty, ["space", "num"]).withColumn("state", state).where("state is not null").drop("space", "num", "__there", "__c", "__d")
