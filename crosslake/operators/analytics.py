"""Operational statistics over the engine's own records: queries, shares, transformations, connections.

Each is one grouped plan for all organizations or one of them; ``now`` is a parameter, so
results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosslake.functions.scalars import day_key, days_since, mask_key, percent, round_half_up, shorten, slug


def _since(c: str, now: Column, days: int) -> Column:
    return F.col(c) > now - F.make_dt_interval(F.lit(days))


def _iso(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def query_performance(history: DataFrame, now: Column, days: int = 7, by: list[str] | None = None) -> DataFrame:
    """Totals of the last ``days``: average time of successful queries, failures, their rate, timeouts."""
    recent = history.where(_since("executed_at", now, days))
    ok = (F.col("status") == "success") & (F.col("execution_time_ms") != 0)
    return recent.groupBy(*(by or [])).agg(
        F.coalesce(F.floor(F.avg(F.when(ok, F.col("execution_time_ms"))) + 0.5), F.lit(0)).cast("bigint").alias("avg_execution_time_ms"),
        F.count(F.lit(1)).alias("total_queries"), F.count_if(F.col("status") == "error").alias("failed_queries"),
        F.coalesce(round_half_up(percent(F.count_if(F.col("status") == "error"), F.count(F.lit(1))), 1), F.lit(0.0)).alias("failure_rate"),
        F.count_if(F.contains("error_message", F.lit("timeout"))).alias("timeout_queries"),
    )


def slowest_queries(history: DataFrame, now: Column, days: int = 7, n: int = 10) -> DataFrame:
    """The slowest successful queries; ties go to the later one, then the smaller id."""
    ok = _since("executed_at", now, days) & (F.col("status") == "success") & (F.col("execution_time_ms") != 0)
    top = history.where(ok).orderBy(F.desc("execution_time_ms"), F.desc("executed_at"), "id").limit(n)
    return top.select("id", shorten(F.col("sql_query")).alias("sql_query"), "execution_time_ms", "status", _iso("executed_at").alias("executed_at"))


def queries_by_day(history: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return history.where(_since("executed_at", now, days)).groupBy(day_key(F.col("executed_at")).alias("day")).agg(F.count(F.lit(1)).alias("queries"))


def share_stats(shares: DataFrame, now: Column) -> DataFrame:
    """Counts of active shares by access level, their accesses, and those of shares accessed today."""
    level = lambda x: F.count_if(F.col("access_level") == x)
    return shares.where("active").agg(
        F.count(F.lit(1)).alias("total_shared_datasets"), level("public").alias("public_shares"), level("organization").alias("organization_shares"), level("private").alias("private_shares"),
        F.coalesce(F.sum("access_count"), F.lit(0)).alias("total_api_calls"),
        F.coalesce(F.sum(F.when(F.col("last_accessed_at") >= F.date_trunc("day", now), F.col("access_count"))), F.lit(0)).alias("api_calls_today"),
    )


def most_accessed(shares: DataFrame, n: int = 10) -> DataFrame:
    key = mask_key(F.col("api_key")) if "api_key" in shares.columns else F.lit("")
    top = shares.where("active and access_count > 0").orderBy(F.desc("access_count"), "id").limit(n)
    return top.select("id", "name", "dataset_type", "access_count", F.coalesce(_iso("last_accessed_at"), F.lit("")).alias("last_accessed_at"), key.alias("api_key"))


def shares_by_day(shares: DataFrame) -> DataFrame:
    return shares.where("active and last_accessed_at is not null").groupBy(day_key(F.col("last_accessed_at")).alias("day")).agg(F.count(F.lit(1)).alias("shares"))


def stale_shares(shares: DataFrame, now: Column, days: int = 30, n: int | None = 10) -> DataFrame:
    """Shares not accessed for ``days``, or never; inactive ones too. Never accessed ones come first."""
    old = shares.where(F.col("last_accessed_at").isNull() | (F.col("last_accessed_at") < now - F.make_dt_interval(F.lit(days))))
    if n is not None:
        old = old.orderBy(F.col("last_accessed_at").asc_nulls_first(), "id").limit(n)
    return old.select("id", "name", F.col("dataset_type").alias("type"), days_since(F.col("last_accessed_at"), now).alias("days_since_last_access"), F.coalesce(_iso("last_accessed_at"), F.lit("Never")).alias("last_accessed_at"))


def failed_transformations(transformations: DataFrame, runs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Active transformations with failures in the window: the last error and the number of failures."""
    bad = runs.where(_since("started_at", now, days) & F.col("status").isin("failed", "timeout"))
    per = bad.groupBy("transformation_id").agg(F.count(F.lit(1)).alias("failures"), F.coalesce(F.max_by("error_message", "started_at"), F.lit("Unknown error")).alias("error_message"), F.max("started_at").alias("last_failure"))
    return transformations.where("status = 'active'").join(per, F.col("id") == F.col("transformation_id")).select("id", "name", F.coalesce(_iso("last_run_at"), F.lit("")).alias("last_run_at"), "error_message", "failures")


def freshness_stats(shares: DataFrame, transformations: DataFrame, runs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row: stale shares, transformations with failures, active transformations, success rate of the runs (100 without runs)."""
    recent = runs.where(_since("started_at", now, days))
    r = recent.agg(F.count_distinct(F.when(F.col("status").isin("failed", "timeout"), F.col("transformation_id"))).alias("failed_transformations"), F.coalesce(round_half_up(percent(F.count_if(F.col("status") == "success"), F.count(F.lit(1))), 1), F.lit(100.0)).alias("success_rate"))
    t = transformations.agg(F.count_if(F.col("status") == "active").alias("total_transformations"))
    s = shares.agg(F.count_if(F.col("last_accessed_at").isNull() | (F.col("last_accessed_at") < now - F.make_dt_interval(F.lit(days)))).alias("stale_datasets"))
    return s.crossJoin(r).crossJoin(t)  # one row each


def connection_health(connections: DataFrame, history: DataFrame, now: Column, days: int = 30, errors: int = 5) -> DataFrame:
    """Each connection with its queries and errors of the window and its status.

    untested without queries in the window, error above ``errors`` errors, online if the
    last query of all succeeded, else offline. The history is aggregated before it is joined.
    """
    recent = _since("executed_at", now, days)
    per = history.where("connection_id is not null").groupBy("connection_id").agg(
        F.count_if(recent).alias("query_count"), F.count_if(recent & (F.col("status") == "error")).alias("recent_errors"),
        F.max_by("status", F.struct("executed_at", "id")).alias("last_status"), F.max("executed_at").alias("last_used_at"),
    )
    n, bad = F.coalesce("query_count", F.lit(0)), F.coalesce("recent_errors", F.lit(0))
    status = F.when(n == 0, "untested").when(bad > errors, "error").when(F.col("last_status") == "success", "online").otherwise("offline")
    return connections.join(per, F.col("id") == F.col("connection_id"), "left").select("id", "name", "type", status.alias("status"), n.alias("query_count"), F.coalesce(_iso("last_used_at"), F.lit("")).alias("last_used_at"), bad.alias("recent_errors"))


def health_totals(health: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return health.agg(F.count(F.lit(1)).alias("total_connections"), is_("online").alias("online"), is_("offline").alias("offline"), is_("error").alias("error"), is_("untested").alias("idle"))


def health_by_type(health: DataFrame) -> DataFrame:
    """Connections of each type and how many of them are online."""
    return health.groupBy("type").agg(F.count(F.lit(1)).alias("connections"), F.count_if(F.col("status") == "online").alias("online"))


def dataset_catalog(staged: DataFrame, connections: DataFrame, transformations: DataFrame, cross_queries: DataFrame, shares: DataFrame) -> DataFrame:
    """All datasets in one list, each with its active share if it has one (of several, the one with the smallest id)."""
    dash, zero = F.lit("-"), F.lit(0)

    def part(df: DataFrame, no: int, kind: str, name: str, description: Column, table: Column, rows: Column, updated: Column, source: Column) -> DataFrame:
        return df.select(F.lit(no).alias("kind_no"), "id", F.col(name).alias("name"), description.alias("description"), F.lit(kind).alias("type"), table.alias("table_name"), rows.cast("bigint").alias("row_count"), _iso(updated).alias("last_updated"), source.alias("source"))

    every = (
        part(staged, 1, "staged", "table_name", F.lit("Staged data from import"), F.col("table_name"), F.coalesce("row_count", zero), F.col("created_at"), F.lit("Data Import"))
        .unionByName(part(connections, 2, "connection", "name", F.concat("type", F.lit(" connection")), dash, zero, F.col("created_at"), F.concat("type", F.lit(" Database"))))
        .unionByName(part(transformations.where("status = 'active'"), 3, "transformation", "name", F.col("description"), slug(F.col("name")), zero, F.coalesce("last_run_at", "created_at"), F.lit("Transformation Pipeline")))
        .unionByName(part(cross_queries, 4, "cross-query", "name", F.coalesce(F.nullif("description", F.lit("")), F.lit("Cross-database query")), dash, zero, F.coalesce("updated_at", "created_at"), F.lit("Cross-Database Query")))
    )
    shared = shares.where("active").groupBy("dataset_type", "dataset_id").agg(F.min(F.struct("id", "access_level")).alias("s"))
    on = (F.col("type") == F.col("dataset_type")) & (every["id"] == F.col("dataset_id"))
    return every.join(shared, on, "left").select(*[every[c] for c in every.columns], F.col("s").isNotNull().alias("is_shared"), F.coalesce("s.access_level", F.lit("private")).alias("access_level"), F.col("s.id").alias("share_id"))


def dashboard_totals(staged: DataFrame, connections: DataFrame, transformations: DataFrame, cross_queries: DataFrame, history: DataFrame, shares: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """One row of counts."""
    n = F.count(F.lit(1))
    today = F.col("executed_at") > F.date_trunc("day", now)
    has_key = F.col("api_key").isNotNull() if "api_key" in shares.columns else F.lit(False)
    parts = [
        staged.agg(n.alias("a")), connections.agg(n.alias("active_connections")), transformations.agg(F.count_if(F.col("status") == "active").alias("total_transformations")), cross_queries.agg(n.alias("d")),
        history.agg(F.count_if(today).alias("queries_today")), shares.agg(F.count_if(F.col("active") & has_key).alias("active_api_endpoints")), jobs.agg(F.count_if(F.col("status") == "failed").alias("failed_jobs")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    total = F.col("a") + F.col("active_connections") + F.col("total_transformations") + F.col("d")
    return out.select(total.alias("total_datasets"), "active_connections", "queries_today", "active_api_endpoints", "failed_jobs", "total_transformations")


def latest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group by ``order``."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
