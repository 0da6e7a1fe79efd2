"""Streaming extensions: files into staging as they arrive, and windowed counts of event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from crosslake.functions.common import table


def read_files(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_batch: int = 1000, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).options(**options).load(path)


def read_table_files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a dataset directory as a stream, be it one file or a folder of files."""
    path = f"{sf_dir}/{name}.{{parquet}}"  # a pattern, since a stream takes no path of a single file
    return read_files(spark, path, table(spark, sf_dir, name).schema)


def ingest_stream(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Appends a stream to a table; each batch is written under its number once, so a repeated batch replaces itself.

    ``checkpoint`` must be a folder that all executors share.
    """

    def write(df: DataFrame, batch: int) -> None:
        out = (transform(df) if transform else df).withColumn("_batch", F.lit(batch))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(target)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed_counts(events: DataFrame, ts: str, by: list[str], window: str = "1 hour", late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums) in event-time windows; rows later than ``late`` after the newest are dropped once their window is out."""
    t = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    out = t.groupBy(F.window("__ts", window), *by).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", *(["total"] if value else []))


def first_deliveries(stream: DataFrame, id_col: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each id once within the lateness bound."""
    return stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark([id_col]).drop("__ts")
