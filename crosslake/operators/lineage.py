"""The lineage graph of an organization's records, and subgraphs of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosslake.functions.common import Scratch

MAX_DEPTH, DEFAULT_DEPTH, LATEST_JOBS = 10, 3, 500
SHARE_KINDS = {"staged": "staged_data", "connection": "connection", "transformation": "transformation", "cross-query": "cross_query"}


def _node(df: DataFrame, kind: str, label: str, **metadata: Column) -> DataFrame:
    meta = F.map_filter(F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    return df.select(F.concat(F.lit(f"{kind}-"), "id").alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"), meta.alias("metadata"))


def _edge(df: DataFrame, id_: Column, source: Column, target: Column, kind: str, label: str, **metadata: Column) -> DataFrame:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    meta = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.expr("cast(map() as map<string,string>)")
    return df.select(id_.alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit(label).alias("label"), meta.alias("metadata"))


def build_lineage(connections: DataFrame, jobs: DataFrame, staged: DataFrame, transformations: DataFrame, runs: DataFrame, cross_queries: DataFrame, shares: DataFrame, latest_jobs: int = LATEST_JOBS, strict_reference: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of connections, the latest import jobs, staged tables, transformations, cross queries and active shares.

    Edges whose ends are not both nodes are left out. cross_queries has query_definition as
    JSON text. A share refers to its dataset by kind and id; ``strict_reference`` takes the
    kind's own word as the node type, which never finds staged tables and cross queries.
    """
    c = F.col
    cat = lambda *x: F.concat(*[v if isinstance(v, Column) else F.lit(v) for v in x])
    jobs = jobs.orderBy(F.desc("created_at"), "id").limit(latest_jobs)
    shares = shares.where("active")
    nodes = [
        _node(connections, "connection", "name", connectionType=c("type"), createdAt=c("created_at")),
        _node(jobs, "import_job", "file_name", status=c("status"), rowCount=c("rows_succeeded"), sourceType=c("source_type"), createdAt=c("created_at")),
        _node(staged, "staged_data", "table_name", rowCount=c("row_count"), tableName=c("table_name"), createdAt=c("created_at")),
        _node(transformations, "transformation", "name", status=c("status"), lastRunAt=c("last_run_at"), createdAt=c("created_at")),
        _node(cross_queries, "cross_query", "name", createdAt=c("created_at")),
        _node(shares, "dataset_share", "name", datasetType=c("dataset_type"), rowCount=c("row_count"), createdAt=c("created_at")),
    ]
    newest = runs.groupBy("transformation_id").agg(F.max_by(F.struct("rows_processed", "execution_time_ms", "completed_at"), F.struct("started_at", "id")).alias("r"))
    with_run = transformations.join(newest, c("id") == c("transformation_id"), "left")
    uses = cross_queries.select("id", F.explode(F.array_distinct(F.array_compact(F.from_json("query_definition", "tables array<struct<connectionId:string>>")["tables"]["connectionId"]))).alias("conn")).where("conn <> ''")
    kind = c("dataset_type")
    if not strict_reference:
        kind = F.coalesce(F.create_map(*[F.lit(x) for kv in SHARE_KINDS.items() for x in kv])[c("dataset_type")], c("dataset_type"))
    edges = [
        _edge(jobs.where("source_connection_id is not null"), cat(c("source_connection_id"), "-importjob-", c("id")), cat("connection-", c("source_connection_id")), cat("import_job-", c("id")), "data_flow", "imports from", rowsProcessed=c("rows_succeeded"), lastExecutedAt=c("completed_at")),
        _edge(jobs.where("connection_id is not null and target_type = 'database'"), cat("importjob-", c("id"), "-", c("connection_id")), cat("import_job-", c("id")), cat("connection-", c("connection_id")), "data_flow", "loads to"),
        _edge(staged.where("import_job_id is not null"), cat("importjob-", c("import_job_id"), "-staged-", c("id")), cat("import_job-", c("import_job_id")), cat("staged_data-", c("id")), "data_flow", "creates", rowsProcessed=c("row_count")),
        _edge(with_run.where("source_connection_id is not null"), cat("conn-", c("source_connection_id"), "-transform-", c("id")), cat("connection-", c("source_connection_id")), cat("transformation-", c("id")), "derived_from", "transforms", rowsProcessed=c("r.rows_processed"), executionTimeMs=c("r.execution_time_ms"), lastExecutedAt=c("r.completed_at")),
        _edge(uses, cat("conn-", c("conn"), "-crossquery-", c("id")), cat("connection-", c("conn")), cat("cross_query-", c("id")), "derived_from", "queries"),
        _edge(shares, cat(c("dataset_type"), "-", c("dataset_id"), "-share-", c("id")), cat(kind, "-", c("dataset_id")), cat("dataset_share-", c("id")), "shared_as", "shared as"),
    ]
    every = reduce(DataFrame.unionByName, nodes)
    return every, connected(every, reduce(DataFrame.unionByName, edges))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes."""
    ids = nodes.select(F.col("id").alias("n"))
    return edges.join(ids, edges["source"] == ids["n"], "left_semi").join(ids, edges["target"] == ids["n"], "left_semi")


def of_types(nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where(F.col("type").isin(*types))
    return kept, connected(kept, edges)


def subgraph(nodes: DataFrame, edges: DataFrame, root: str, direction: str = "both", max_depth: int = DEFAULT_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(nodes within max_depth of the root with their depth, edges walked from nodes above that depth).

    direction: upstream, downstream or both. An unknown root gives nothing; 0 means the
    default depth. Each round joins the new frontier only; rounds are written tables.
    """
    if direction not in ("upstream", "downstream", "both"):
        raise ValueError(f"Unknown direction: {direction}")
    max_depth = max_depth or DEFAULT_DEPTH
    if not 1 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"max_depth must be between 1 and {MAX_DEPTH}")
    s = Scratch(nodes.sparkSession, "lineage")
    steps = []
    if direction != "upstream":
        steps.append(edges.select(F.col("source").alias("here"), F.col("target").alias("there"), F.col("id").alias("edge")))
    if direction != "downstream":
        steps.append(edges.select(F.col("target").alias("here"), F.col("source").alias("there"), F.col("id").alias("edge")))
    walk = reduce(DataFrame.unionByName, steps)
    seen = s.write(nodes.where(F.col("id") == root).select("id", F.lit(0).alias("depth")))
    frontier, walked = seen, []
    for depth in range(1, max_depth + 1):
        moves = s.write(frontier.join(walk, frontier["id"] == walk["here"]).select("edge", "there"))
        walked.append(moves.select("edge"))
        frontier, found_now = s.write_counted(moves.select(F.col("there").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if not found_now:
            break
        seen = seen.unionByName(frontier)
    found = nodes.join(seen, "id")
    return found, edges.join(reduce(DataFrame.unionByName, walked).distinct(), F.col("id") == F.col("edge"), "left_semi")
