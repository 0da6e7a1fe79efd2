"""Staging tables, database sinks, upserts and retention."""

from __future__ import annotations

import re
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from crosslake.functions.scalars import table_name_of
from crosslake.model import ColumnInfo
from crosslake.sources import embedded
from crosslake.sources.files import Parsed, _typed, error_records

SAMPLE_ROWS, MAX_ERRORS, DB_BATCH = 100, 1000, 100


def staging_schema(organization_id: str) -> str:
    return "staging_" + re.sub(r"[^a-z0-9_]", "_", organization_id.lower())


def staging_name(file_name: str, job_id: str) -> str:
    """The sanitised name and the first part of the job's id."""
    return f"{table_name_of(file_name)}_{job_id.split('-')[0]}"


def column_names(names: list[str], taken: tuple[str, ...] = ()) -> list[str]:
    """Names that a table takes: odd characters as underscores; a name that is taken already, in any case, gets a number."""
    seen, out = {t.lower() for t in taken}, []
    for c in names:
        base = c if re.fullmatch(r"[A-Za-z0-9_]+", c) else table_name_of(c)
        name, n = base, 1
        while name.lower() in seen:
            n += 1
            name = f"{base}_{n}"
        seen.add(name.lower())
        out.append(name)
    return out


def counted_write(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Runs ``write`` and returns the rows that it wrote, counted as they pass, not by a second run."""
    seen = Observation(f"written-{uuid.uuid4().hex}")
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return int(seen.get["n"])


_appends: dict[str, threading.Lock] = defaultdict(threading.Lock)


def stage(df: DataFrame, organization_id: str, name: str, job_id: str, id_col: str = "_staging_id") -> str:
    """Appends rows to a staging table, made on the first call; the full name."""
    return stage_counted(df, organization_id, name, job_id, id_col)[0]


def stage_counted(df: DataFrame, organization_id: str, name: str, job_id: str, id_col: str = "_staging_id") -> tuple[str, int]:
    """``stage``, with the number of rows appended.

    Each row gets a number that is unique in the table and grows from one append to the
    next; appends of this program to one table take turns for that.
    """
    spark = df.sparkSession
    schema, table = staging_schema(organization_id), staging_name(name, job_id)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    full = f"{schema}.{table}"
    clean = df.toDF(*column_names(df.columns, (id_col,)))
    with _appends[full]:
        base = 0
        if spark.catalog.tableExists(full):
            base = (spark.table(full).agg(F.max(id_col)).first()[0] or 0) + 1
        numbered = clean.select((F.monotonically_increasing_id() + F.lit(base + 1)).alias(id_col), "*")
        rows = counted_write(numbered, lambda d: d.write.mode("append").format("parquet").saveAsTable(full))
    return full, rows


def drop_staging(spark: SparkSession, full_name: str) -> None:
    schema = full_name.split(".")[0]
    if not schema.startswith("staging_"):
        raise ValueError(f"Not a staging table: {full_name}")
    spark.sql(f"DROP TABLE IF EXISTS {full_name}")


def staged_metadata(spark: SparkSession, full_name: str, organization_id: str, job_id: str) -> dict:
    """What is kept of a staged table: its schema, a sample, its row count."""
    df = spark.table(full_name)
    return {
        "organization_id": organization_id, "import_job_id": job_id, "table_name": full_name,
        "schema": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields], "data": [r.asDict() for r in df.limit(SAMPLE_ROWS).collect()], "row_count": df.count(),
    }


def import_parsed(p: Parsed, organization_id: str, name: str, job_id: str) -> dict:
    """Stages a parsed file: rows with an error stay out. Counters count rows, not error records."""
    full_errors = p.errors.unionByName(error_records(p.rows, p.row_col, p.types).where("severity = 'error'")).distinct() if p.types else p.errors  # parsing may have told of them already
    full_errors = full_errors.persist()
    try:
        bad = full_errors.where("severity = 'error'").select(F.col("row").alias(p.row_col)).distinct()
        good = p.rows.join(bad, p.row_col, "left_anti").drop(p.row_col)
        table, kept = stage_counted(_typed_table(good, p.types), organization_id, name, job_id)
        failed = bad.count()
        return {"table": table, "rows_processed": kept + failed, "rows_succeeded": kept, "rows_failed": failed, "errors": full_errors.orderBy("row", "column").limit(MAX_ERRORS).collect(), "status": "completed"}
    finally:
        full_errors.unpersist()


def _typed_table(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*[F.when(F.trim(f"`{c}`") != "", _typed(F.col(f"`{c}`"), types.get(c, "text"))).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def split_rejects(df: DataFrame, required: list[str] = (), unique: list[str] = (), row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows a table with these constraints takes, CONSTRAINT_VIOLATION records of the others).

    Of rows with the same unique key the first by ``row_col`` is taken.
    """
    why: Column = F.lit(None).cast("string")
    col: Column = F.lit(None).cast("string")
    for c in required:
        missing = F.col(f"`{c}`").isNull()
        why, col = F.coalesce(why, F.when(missing, f"null value in column {c}")), F.coalesce(col, F.when(missing, c))
    if unique:
        rn = F.row_number().over(Window.partitionBy(*unique).orderBy(row_col or unique[0]))
        df = df.withColumn("__rn", rn)
        key = ", ".join(unique)
        why, col = F.coalesce(why, F.when(F.col("__rn") > 1, f"duplicate key ({key})")), F.coalesce(col, F.when(F.col("__rn") > 1, key))
    judged = df.withColumns({"__why": why, "__col": col})
    good = judged.where("__why is null").drop("__why", "__col", "__rn")
    row = F.col(row_col).cast("bigint") if row_col else F.lit(None).cast("bigint")
    bad = judged.where("__why is not null").select(row.alias("row"), F.col("__col").alias("column"), F.lit(None).cast("string").alias("value"), F.col("__why").alias("error"), F.lit("CONSTRAINT_VIOLATION").alias("type"), F.lit("error").alias("severity"), F.lit("Remove or correct the row").alias("suggestion"))
    return good, bad


def insert_database(df: DataFrame, options: dict[str, str], table: str, batch: int = DB_BATCH, required: list[str] = (), unique: list[str] = ()) -> DataFrame:
    """Inserts through JDBC (the table is made if missing) what the constraints allow; the rejected rows' records."""
    good, bad = split_rejects(df, required, unique)
    if embedded.by_driver(df.sparkSession, options.get("url", "")):
        embedded.insert(good, options, table, batch)
        return bad
    good.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", batch).mode("append").save()
    return bad


def check_mapping(mapping: dict[str, str], source: list[str], target: list[ColumnInfo | str]) -> list[str]:
    """What is wrong with a column mapping: sources that the data lacks, targets that the table lacks."""
    have = {t.name if isinstance(t, ColumnInfo) else t for t in target}
    return [f"Source column not found: {s}" for s in mapping if s not in source] + [f"Target column not found: {t}" for t in mapping.values() if t not in have]


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the merged table, a row with inserted and updated counts). Of incoming rows with the same key the last by ``order`` counts; rows with a null key are inserted."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*order)
        incoming = incoming.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    old = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    merged = old.unionByName(incoming, allowMissingColumns=True)
    hit = incoming.join(existing.select(*keys).distinct().withColumn("__hit", F.lit(1)), keys, "left")
    counts = hit.agg(F.count_if(F.col("__hit").isNull()).alias("inserted"), F.count("__hit").alias("updated"))
    return merged, counts


def keep_recent(runs: DataFrame, cached: DataFrame, now: datetime, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(runs not older than ``days``, cached results whose run is kept or unknown to the runs)."""
    cut = F.lit(now - timedelta(days=days)).cast("timestamp_ntz")
    old = runs.where(F.col("started_at") < cut).select(F.col("id").alias("run_id"))
    return runs.where((F.col("started_at") >= cut) | F.col("started_at").isNull()), cached.join(old, "run_id", "left_anti")
