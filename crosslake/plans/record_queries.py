"""Queries p1 to p5 over the tables of the domain, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslake.functions.common import Scratch, latest, same_id, table
from crosslake.functions.scalars import round_half_up
from crosslake.operators.bad_records import failing_records, sound_records
from crosslake.operators.hierarchy import descendants, hierarchies
from crosslake.operators.load_profile import agreed_profiles, all_columns, column_states, control_limits, departures, distribution_shifts, merge_states, profiles
from crosslake.operators.nested import flatten_nested
from crosslake.operators.orphans import key_of, orphan_references

LOADED = ("query_history", "quality_check_runs")
_SEP = "\u001f"


def pipelines(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Of each pipeline the row with the greatest updated_at."""
    return latest(table(spark, d, "pipelines").select("id", "updated_at", *columns), "id", F.col("updated_at").desc_nulls_last())


def nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "lineage_nodes").select("id", "created_at", *columns), "id", F.col("created_at").asc_nulls_last())


# --- 1


def _nested(spark: SparkSession, d: str, **how: object) -> DataFrame:
    a = flatten_nested(pipelines(spark, d, "definition"), "id", "definition", **how).withColumn("root_table", F.lit("pipelines"))
    b = flatten_nested(nodes(spark, d, "metadata"), "id", "metadata", **how).withColumn("root_table", F.lit("lineage_nodes"))
    return a.unionByName(b)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d, fields=False).select("root_table", "root_id", "parent_path", "node_path")


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """All flat tables in one: each object with its fields (as JSON text), its table and its links; roots too."""
    got = _nested(spark, d, include_root=True)
    return got.select("root_table", "root_id", "table_path", "parent_path", "node_path", "position", F.to_json("fields").alias("fields"))


def p1_steps(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of pipeline steps."""
    got = flatten_nested(pipelines(spark, d, "definition"), "id", "definition", tables=("steps[]",))
    f = lambda k: F.col("fields")[k]
    return got.select(F.col("root_id").alias("pipeline_id"), "node_path", "position", f("id").alias("step_id"), f("type").alias("type"), f("label").alias("label"), f("position.x").cast("double").alias("x"), f("position.y").cast("double").alias("y"))


# --- 2


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    got = failing_records(table(spark, d, "uploaded_files"), table(spark, d, "upload_schemas"))
    return got.where("reason <> 'unknown_schema'").select("file_id", "line_no", "reason")


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """Failing records with the first broken field and the text of the record."""
    return failing_records(table(spark, d, "uploaded_files"), table(spark, d, "upload_schemas"))


def _loaded(kind: str):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        return sound_records(table(spark, d, "uploaded_files"), table(spark, d, "upload_schemas"), kind)

    return run


# --- 3


def _definition_parts(spark: SparkSession, d: str, s: Scratch) -> DataFrame:
    """Steps and edges of the pipelines: pipeline_id, at, part, id, source, target."""
    who = F.concat_ws(_SEP, "id", F.col("updated_at").cast("string"))
    versions = pipelines(spark, d, "definition").select(who.alias("who"), "definition")
    got = flatten_nested(versions, "who", "definition", tables=("steps[]", "edges[]"))
    who = F.split("root_id", _SEP)
    return s.write(got.select(who[0].alias("pipeline_id"), F.get(who, F.lit(1)).try_cast("timestamp_ntz").alias("at"), F.col("table_path").alias("part"), *[F.col("fields")[c].alias(c) for c in ("id", "source", "target")]))


def _faulty(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark, "orphans")
    no_scope = F.lit("")
    books = latest(table(spark, d, "notebooks").select("id", "updated_at", "cells"), "id", F.col("updated_at").desc_nulls_last())
    cells = flatten_nested(books.select(F.concat_ws(_SEP, "id", F.col("updated_at").cast("string")).alias("who"), "cells"), "who", "cells", tables=("[]",))
    who, to = F.split("root_id", _SEP), F.col("fields")["connectionId"]
    cells = cells.where(F.trim(to) != "").select(
        F.lit("notebooks").alias("ref_table"), who[0].alias("row_id"), F.col("fields")["id"].alias("item_id"),
        F.get(who, F.lit(1)).try_cast("timestamp_ntz").alias("at"), *key_of(F.lit("connections"), same_id(to)),
    )
    edges = latest(table(spark, d, "lineage_edges").select("id", "source", "created_at"), "id", F.col("created_at").asc_nulls_last())
    edges = edges.where(F.trim("source") != "").select(
        F.lit("lineage_edges").alias("ref_table"), F.col("id").alias("row_id"), F.lit("source").alias("item_id"), F.col("created_at").alias("at"), *key_of(F.lit("lineage_nodes"), same_id("source"))
    )
    parts = _definition_parts(spark, d, s)
    in_pipeline = F.concat_ws(_SEP, F.lit("pipelines"), same_id("pipeline_id"))
    inner = parts.where((F.col("part") == "edges[]") & (F.trim("target") != "")).select(
        F.lit("pipelines").alias("ref_table"), F.col("pipeline_id").alias("row_id"), F.col("id").alias("item_id"), "at", *key_of(in_pipeline, same_id("target"))
    )
    never = F.lit(None).cast("timestamp_ntz")
    parents = table(spark, d, "connections").where("id is not null").select(*key_of(F.lit("connections"), same_id("id")), "created_at", "deleted_at")
    parents = parents.unionByName(table(spark, d, "lineage_nodes").where("id is not null").select(*key_of(F.lit("lineage_nodes"), same_id("id")), "created_at", never.alias("deleted_at")))
    steps = parts.where("part = 'steps[]' and id is not null").select(*key_of(in_pipeline, same_id("id")), never.alias("created_at"), never.alias("deleted_at"))
    refs = s.write(cells.unionByName(edges).unionByName(inner))
    return orphan_references(refs, parents.unionByName(steps))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _faulty(spark, d).select("ref_table", "row_id", "item_id", "state")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Faulty references for each table, state and month."""
    return _faulty(spark, d).groupBy("ref_table", "state", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_references"))


# --- 4


def _forest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = Scratch(spark, "forest")
    parts = _definition_parts(spark, d, s)
    line = F.lit("lineage")
    nodes = table(spark, d, "lineage_nodes").select(line.alias("scope"), same_id("id").alias("key"), line.alias("graph"), F.col("id").alias("node_id"))
    edges = table(spark, d, "lineage_edges").select(line.alias("scope"), same_id("source").alias("source"), same_id("target").alias("target"))
    scope = F.concat(F.lit("pipeline "), same_id("pipeline_id"))
    steps = parts.where("part = 'steps[]'").select(scope.alias("scope"), same_id("id").alias("key"), F.col("pipeline_id").alias("graph"), F.col("id").alias("node_id"))
    inner = parts.where("part = 'edges[]'").select(scope.alias("scope"), same_id("source").alias("source"), same_id("target").alias("target"))
    return nodes.unionByName(steps), edges.unionByName(inner)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchies(*_forest(spark, d)).select("graph", "node_id", "root_id", "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each node's full path, depth, root and number of descendants."""
    return hierarchies(*_forest(spark, d), paths=True).select("graph", "node_id", "parent_id", "root_id", "depth", "path", "n_descendants")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each node with each of its descendants."""
    tree = Scratch(spark, "tree").write(hierarchies(*_forest(spark, d)))
    return descendants(tree).select("graph", "node_id", "descendant_id", "distance")


# --- 5


def _states(spark: SparkSession, d: str, whole: bool):  # noqa: ANN202
    """``whole``: all columns with all sketches; else the agreed ones with what their limits need."""
    agreed = agreed_profiles(table(spark, d, "table_profiles"))
    tables = {name: table(spark, d, name) for name in LOADED}
    agreed = [a for a in agreed if a.table_name in tables]
    of = {name: [a for a in agreed if a.table_name == name] for name in LOADED}
    if whole:
        of = {name: all_columns(tables[name], "load_no", of[name], name) for name in LOADED}
    parts = [column_states(tables[name], "load_no", of[name], whole) for name in LOADED]
    return parts[0].unionByName(parts[1]), agreed, tables


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return departures(*_states(spark, d, False)).select("table_name", "load_no", "column_name", "issue")


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column of every load."""
    return profiles(_states(spark, d, True)[0])


_EXACT = ("table_name", "load_no", "column_name", "total_rows", "null_count", "null_percent", "range_violations", "pattern_violations")


def _exact(profile: DataFrame, *keys: str) -> DataFrame:
    """What is exact in a profile; extremes of numbers as numbers, means to three decimals."""
    number, text = (lambda c: F.when(F.col("mean_value").isNotNull(), F.col(c).cast("double"))), (lambda c: F.when(F.col("mean_value").isNull(), F.col(c)))
    return profile.select(*keys, *_EXACT[2:], number("min_value").alias("low"), number("max_value").alias("high"), text("min_value").alias("first_text"), text("max_value").alias("last_text"), round_half_up(F.col("mean_value"), 3).alias("mean_value"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """The exact parts of the profile of every column of every load."""
    return _exact(profiles(_states(spark, d, True)[0]), "table_name", "load_no")


def p5_overall(spark: SparkSession, d: str) -> DataFrame:
    """The exact parts of the profile of every column of each table, from the merged states of its loads; nothing is read again."""
    states = Scratch(spark, "states").write(_states(spark, d, True)[0])
    return _exact(profiles(merge_states(states.withColumn("load_no", F.lit(0)))), "table_name")


def p5_control(spark: SparkSession, d: str) -> DataFrame:
    """Control limits over the exact metrics alone."""
    exact = profiles(_states(spark, d, True)[0]).select("table_name", "load_no", "column_name", "null_percent", "mean_value", "range_percent", "pattern_percent")
    return control_limits(exact).select("table_name", "load_no", "column_name", "metric", round_half_up(F.col("value"), 3).alias("value"))


def p5_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Columns of loads whose values are distributed otherwise than in the loads before."""
    return distribution_shifts(_states(spark, d, True)[0])


def p5_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of loads outside the control limits of the loads before."""
    return control_limits(profiles(_states(spark, d, True)[0]))


QUERIES = {
    "p1_found": p1_found, "p1_rows": p1_rows, "p1_steps": p1_steps,
    "p2_found": p2_found, "p2_fields": p2_fields, "p2_loaded_meters": _loaded("meters"), "p2_loaded_shipments": _loaded("shipments"), "p2_loaded_tickets": _loaded("tickets"),
    "p3_found": p3_found, "p3_counts": p3_counts,
    "p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants,
    "p5_found": p5_found, "p5_profile": p5_profile, "p5_anomalies": p5_anomalies, "p5_counts": p5_counts, "p5_overall": p5_overall, "p5_control": p5_control, "p5_shifts": p5_shifts,
}

# --- the same in SQL, straight from the problem statements

_NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY {order} DESC NULLS LAST) AS rn FROM {table}) WHERE rn = 1"
_PIPES = _NEWEST.format(order="updated_at", table="pipelines")
_READABLE = f"SELECT id, updated_at, CASE WHEN json_valid(definition) THEN CAST(definition AS JSON) END AS d FROM ({_PIPES}) WHERE json_valid(definition)"
_WALK = f"""
WITH RECURSIVE docs AS (
  SELECT 'pipelines' AS root_table, id AS root_id, d AS node FROM ({_READABLE})
  UNION ALL SELECT 'lineage_nodes', id, CAST(metadata AS JSON) FROM ({_NEWEST.format(order="created_at", table="lineage_nodes")}) WHERE json_valid(metadata)),
walk AS (
  SELECT root_table, root_id, '' AS path, '$' AS enc, '$' AS parent_path, FALSE AS hit, node FROM docs
  UNION ALL
  SELECT root_table, root_id, path2, CASE WHEN is_arr AND json_type(v) = 'OBJECT' THEN path2 ELSE enc END, enc, is_arr AND json_type(v) = 'OBJECT',
    CASE WHEN kid.k = 'config' AND json_type(v) = 'VARCHAR' AND json_valid(v ->> '$') THEN CASE WHEN json_type(v ->> '$') = 'OBJECT' THEN CAST(v ->> '$' AS JSON) ELSE v END ELSE v END
  FROM (SELECT *, kid.v AS v, CASE WHEN is_arr THEN path || '[' || kid.i || ']' WHEN path = '' THEN kid.k ELSE path || '.' || kid.k END AS path2 FROM (
    SELECT root_table, root_id, path, enc, json_type(node) = 'ARRAY' AS is_arr, unnest(CASE json_type(node)
      WHEN 'OBJECT' THEN list_transform(json_keys(node), lambda k: {{'k': k, 'i': CAST(0 AS BIGINT), 'v': json_extract(node, '$."' || k || '"')}})
      WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(node) AS BIGINT)), lambda i: {{'k': '', 'i': i, 'v': json_extract(node, '$[' || i || ']')}}) END) AS kid
    FROM walk WHERE json_type(node) IN ('OBJECT', 'ARRAY'))))"""
_LIST = "CASE WHEN json_type(d, '$.{part}') = 'ARRAY' THEN CAST(json_extract(d, '$.{part}[*]') AS JSON[]) ELSE [] END"
_STEPS = f"SELECT id AS pipeline_id, updated_at, x ->> '$.id' AS step_id FROM (SELECT id, updated_at, unnest({_LIST.format(part='steps')}) AS x FROM ({_READABLE})) WHERE json_type(x) = 'OBJECT'"
_LINKS = f"SELECT id AS pipeline_id, updated_at, x ->> '$.id' AS edge_id, x ->> '$.source' AS source, x ->> '$.target' AS target FROM (SELECT id, updated_at, unnest({_LIST.format(part='edges')}) AS x FROM ({_READABLE})) WHERE json_type(x) = 'OBJECT'"
_ORPHANS = f"""
WITH conn AS (SELECT lower(trim(id)) AS k, min(created_at) AS c, min(deleted_at) AS x FROM connections GROUP BY 1), nodes AS (SELECT lower(trim(id)) AS k, min(created_at) AS c FROM lineage_nodes GROUP BY 1),
steps AS (SELECT DISTINCT lower(trim(pipeline_id)) AS p, lower(trim(step_id)) AS k FROM ({_STEPS})),
cells AS (SELECT id, updated_at, cell ->> '$.id' AS item_id, cell ->> '$.connectionId' AS ref FROM (SELECT id, updated_at, unnest(CAST(json_extract(CAST(cells AS JSON), '$[*]') AS JSON[])) AS cell FROM ({_NEWEST.format(order="updated_at", table="notebooks")}) WHERE json_valid(cells))),
r AS (
  SELECT 'notebooks' AS ref_table, id AS row_id, item_id, updated_at AS moment, CASE WHEN k IS NULL THEN 'missing' WHEN c > updated_at THEN 'late' WHEN x <= updated_at THEN 'deleted' END AS state FROM cells LEFT JOIN conn ON k = lower(trim(ref)) WHERE trim(ref) <> ''
  UNION ALL SELECT 'lineage_edges', id, 'source', created_at, CASE WHEN k IS NULL THEN 'missing' WHEN c > created_at THEN 'late' END FROM ({_NEWEST.format(order="created_at", table="lineage_edges")}) LEFT JOIN nodes ON k = lower(trim(source)) WHERE trim(source) <> ''
  UNION ALL SELECT 'pipelines', pipeline_id, edge_id, updated_at, CASE WHEN k IS NULL THEN 'missing' END FROM ({_LINKS}) LEFT JOIN steps ON k = lower(trim(target)) AND p = lower(trim(pipeline_id)) WHERE trim(target) <> '')"""
_TREE = f"""
WITH RECURSIVE n AS (
  SELECT 'lineage' AS scope, lower(trim(id)) AS k, 'lineage' AS graph, min(id) AS node_id FROM lineage_nodes GROUP BY 2
  UNION ALL SELECT 'p' || lower(trim(pipeline_id)), lower(trim(step_id)), min(pipeline_id), min(step_id) FROM ({_STEPS}) WHERE step_id IS NOT NULL GROUP BY 1, 2),
e AS (
  SELECT l.scope, l.t, min(l.s) AS s FROM (
    SELECT 'lineage' AS scope, lower(trim(source)) AS s, lower(trim(target)) AS t FROM lineage_edges
    UNION SELECT 'p' || lower(trim(pipeline_id)), lower(trim(source)), lower(trim(target)) FROM ({_LINKS})) l
  JOIN n a ON a.scope = l.scope AND a.k = l.s JOIN n b ON b.scope = l.scope AND b.k = l.t GROUP BY 1, 2),
w AS (
  SELECT n.scope, n.k, n.node_id AS root_id, 0 AS depth, n.node_id AS path, CAST(NULL AS VARCHAR) AS parent_id FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.scope = n.scope AND e.t = n.k)
  UNION ALL SELECT w.scope, e.t, w.root_id, w.depth + 1, w.path || ' / ' || m.node_id, p.node_id FROM w JOIN e ON e.scope = w.scope AND e.s = w.k JOIN n m ON m.scope = e.scope AND m.k = e.t JOIN n p ON p.scope = w.scope AND p.k = w.k)"""
_DESCENT = """, up AS (
  SELECT scope, t AS k, s AS anc, 1 AS distance FROM e WHERE EXISTS (SELECT 1 FROM w WHERE w.scope = e.scope AND w.k = e.t)
  UNION ALL SELECT up.scope, up.k, e.s, distance + 1 FROM up JOIN e ON e.scope = up.scope AND e.t = up.anc)"""


def _p5_sql() -> str:
    kinds = {
        "query_history": ("id", "connection_id", "organization_id", "executed_at", "execution_time_ms", "row_count", "status", "error_message"),
        "quality_check_runs": ("id", "status", "actual_value", "duration_ms", "error_message"),
    }
    parts = []
    for t, columns in kinds.items():
        for c in columns:
            numeric = c in ("execution_time_ms", "row_count", "actual_value", "duration_ms")
            to = "TIMESTAMP" if c == "executed_at" else "DOUBLE"
            outside = f"coalesce(bool_or(CAST({c} AS {to}) < CAST(rtrim(min_value, 'Z') AS {to}) OR CAST({c} AS {to}) > CAST(rtrim(max_value, 'Z') AS {to})), FALSE)" if numeric or c == "executed_at" else "FALSE"
            mid = f"median({c})" if numeric else "CAST(NULL AS DOUBLE)"
            parts.append(
                f"SELECT p.table_name, load_no, p.column_name, unnest([CASE WHEN abs((count(*) - count({c})) * 100.0 / count(*) - any_value(null_percent)) > 8 THEN 'null_rate' END, CASE WHEN any_value(distinct_percent) >= 90 AND count(DISTINCT {c}) * 100.0 / count(*) < any_value(distinct_percent) - 10 THEN 'distinct' END, "
                f"CASE WHEN {outside} THEN 'range' END, CASE WHEN count(*) FILTER (NOT regexp_matches(CAST({c} AS VARCHAR), value_pattern)) * 100.0 > 2 * count({c}) THEN 'pattern' END, CASE WHEN {mid} < any_value(median_value) / 2 OR {mid} > any_value(median_value) * 2 THEN 'shift' END]) AS issue "
                f"FROM {t} CROSS JOIN (SELECT * FROM table_profiles WHERE table_name = '{t}' AND column_name = '{c}') p GROUP BY 1, 2, 3"
            )
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE issue IS NOT NULL"


_PROFILED = {
    "query_history": ("id", "connection_id", "organization_id", "sql_query", "executed_at", "execution_time_ms", "row_count", "status", "error_message"),
    "quality_check_runs": ("id", "check_id", "organization_id", "status", "actual_value", "expected_desc", "error_message", "duration_ms", "ran_at"),
}
_NUMERIC, _TIMES = ("execution_time_ms", "row_count", "actual_value", "duration_ms"), ("executed_at", "ran_at")


def _exact_sql(by_load: bool) -> str:
    parts = []
    for t, columns in _PROFILED.items():
        for c in columns:
            number, to = c in _NUMERIC, "TIMESTAMP" if c in _TIMES else "DOUBLE"
            v = f"CAST({c} AS {to})"
            outside = f"count(*) FILTER ({v} < CAST(rtrim(min_value, 'Z') AS {to}) OR {v} > CAST(rtrim(max_value, 'Z') AS {to}))" if number or c in _TIMES else "CAST(0 AS BIGINT)"
            text = lambda f: "CAST(NULL AS VARCHAR)" if number else f"CAST({f}({c}) AS VARCHAR)"  # noqa: E731, B023
            num = lambda f: f"{f}({v})" if number else "CAST(NULL AS DOUBLE)"  # noqa: E731, B023
            parts.append(
                f"SELECT '{t}' AS table_name, {'load_no, ' if by_load else ''}'{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_count, (count(*) - count({c})) * 100e0 / count(*) AS null_percent, {outside} AS range_violations, "
                f"count(*) FILTER (NOT regexp_matches(CAST({c} AS VARCHAR), value_pattern)) AS pattern_violations, {num('min')} AS low, {num('max')} AS high, {text('min')} AS first_text, {text('max')} AS last_text, {f'avg({v})' if number else 'CAST(NULL AS DOUBLE)'} AS mean, count({c}) AS filled "
                f"FROM {t} LEFT JOIN (SELECT * FROM table_profiles WHERE table_name = '{t}' AND column_name = '{c}') p ON TRUE GROUP BY ALL"
            )
    return " UNION ALL ".join(parts)


_EXACT_COLUMNS = "column_name, total_rows, null_count, null_percent, range_violations, pattern_violations, low, high, first_text, last_text, floor(mean * 1000 + 0.5) / 1000 AS mean_value"
_CONTROL = f"""
WITH x AS ({_exact_sql(True)}), l AS (
  SELECT table_name, load_no, column_name, unnest(['null_percent', 'mean_value', 'range_percent', 'pattern_percent']) AS metric, unnest([null_percent, mean, range_violations * 100e0 / nullif(filled, 0), pattern_violations * 100e0 / nullif(filled, 0)]) AS value FROM x),
s AS (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd, count(value) OVER w AS n FROM l WINDOW w AS (PARTITION BY table_name, column_name, metric ORDER BY load_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


# records of uploaded files, without the engine's patterns: fields are split and each value is tried
_RECORDS = r"""
WITH raw AS (SELECT file_id, lower(trim(schema_kind)) AS kind, buffer, regexp_matches(lower(coalesce(mimetype, '')), 'iso[-_ ]?8859-1([^0-9]|$)') AS latin FROM uploaded_files WHERE octet_length(buffer) > 0),
txt AS (SELECT file_id, kind, regexp_replace(CASE WHEN latin THEN (SELECT string_agg(chr(CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER)), '' ORDER BY i) FROM (SELECT hex(buffer) AS h), unnest(range(octet_length(buffer))) u(i)) ELSE decode(buffer) END, '^(' || chr(65279) || '|' || chr(239) || chr(187) || chr(191) || ')', '') AS t FROM raw),
head AS (SELECT *, list_transform([',', ';', chr(9), '|'], lambda s: length(split_part(t, chr(10), 1)) - length(replace(split_part(t, chr(10), 1), s, ''))) AS n FROM txt),
sepd AS (SELECT file_id, kind, string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)) AS l, [',', ';', chr(9), '|'][list_position(n, list_max(n))] AS sep FROM head),
starts AS (SELECT *, list_filter(range(2, len(l) + 1), lambda i: regexp_matches(l[i], '^[0-9]+[' || sep || ']')) AS st FROM sepd),
rec AS (SELECT file_id, kind, sep, CAST(st[k] AS INTEGER) AS line_no, regexp_replace(array_to_string(l[st[k]:coalesce(st[k + 1], len(l) + 1) - 1], chr(10)), '(\n[ \t\v\f\r]*)+$', '') AS r FROM (SELECT *, unnest(range(1, len(st) + 1)) AS k FROM starts)),
cols AS (SELECT lower(trim(schema_kind)) AS kind, list({'t': data_type, 'need': required} ORDER BY position) AS cs FROM upload_schemas GROUP BY 1),
part AS (SELECT rec.*, cs, regexp_full_match(r, f || '([' || sep || ']' || f || ')*') AS quoted, list_transform(regexp_extract_all(r, '(^|[' || sep || '])' || f, 2), lambda p: regexp_replace(CASE WHEN starts_with(p, '"') THEN replace(p[2:-2], '""', '"') ELSE p END, '^\s+|\s+$', '', 'g')) AS v
  FROM (SELECT *, '("(?:[^"]|"")*"|[^"' || sep || ']*)' AS f FROM rec) rec JOIN cols USING (kind)),
judged AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(v) <> len(cs) THEN 'column_count' WHEN len(list_filter(range(1, len(cs) + 1), lambda i: NOT CASE WHEN v[i] = '' THEN NOT cs[i].need
    WHEN cs[i].t = 'integer' THEN regexp_full_match(v[i], '-?[0-9]+') WHEN cs[i].t = 'decimal' THEN regexp_full_match(v[i], '-?[0-9]+(\.[0-9]+)?') WHEN cs[i].t = 'boolean' THEN lower(v[i]) IN ('true', 'false', 'yes', 'no', '1', '0')
    WHEN cs[i].t = 'date' THEN regexp_full_match(v[i], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(v[i] AS DATE) IS NOT NULL AND v[i] >= '0001'
    WHEN cs[i].t = 'timestamp' THEN regexp_full_match(v[i], '[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') AND try_cast(v[i][1:10] AS DATE) IS NOT NULL AND v[i] >= '0001' ELSE TRUE END)) > 0 THEN 'invalid_value' END AS reason FROM part)"""


def _loaded_sql(kind: str, columns: str) -> str:
    to = {"integer": "BIGINT", "decimal": "DECIMAL(38,10)", "date": "DATE", "timestamp": "TIMESTAMP", "text": "VARCHAR"}
    out = []
    for i, spec in enumerate(columns.split(), 1):
        name, t = spec.split(":")
        v = f"nullif(v[{i}], '')"
        out.append((f"lower({v}) IN ('true', 'yes', '1')" if t == "boolean" else f"CAST({v} AS {to[t]})") + f' AS "{name}"')
    return f"{_RECORDS} SELECT file_id, line_no, {', '.join(out)}, CAST(NULL AS VARCHAR) AS unfit FROM judged WHERE kind = '{kind}' AND reason IS NULL"


SQL = {
    "p2_found": f"{_RECORDS} SELECT file_id, line_no, reason FROM judged WHERE reason IS NOT NULL",
    "p2_loaded_meters": _loaded_sql("meters", "seq:integer meter_code:text read_on:date reading:decimal estimated:boolean observation:text"),
    "p2_loaded_shipments": _loaded_sql("shipments", "seq:integer depot:text shipped_at:timestamp units:integer weight_kg:decimal fragile:boolean remark:text route:text"),
    "p2_loaded_tickets": _loaded_sql("tickets", "seq:integer opened_on:date queue:text priority:integer hours:decimal escalated:boolean note:text"),
    "p5_counts": f"SELECT table_name, load_no, {_EXACT_COLUMNS} FROM ({_exact_sql(True)})",
    "p5_overall": f"SELECT table_name, {_EXACT_COLUMNS} FROM ({_exact_sql(False)})",
    "p5_control": f"{_CONTROL} SELECT table_name, load_no, column_name, metric, floor(value * 1000 + 0.5) / 1000 AS value FROM s WHERE n >= 8 AND abs(value - m) > greatest(3 * sd, 1e-9 * greatest(abs(m), 1))",
    "p1_found": f"{_WALK} SELECT root_table, root_id, parent_path, path AS node_path FROM walk WHERE hit",
    "p1_steps": f"""SELECT pipeline_id, 'steps[' || i || ']' AS node_path, CAST(i AS INTEGER) AS position, x ->> '$.id' AS step_id, x ->> '$.type' AS type, x ->> '$.label' AS label, CAST(x ->> '$.position.x' AS DOUBLE) AS x, CAST(x ->> '$.position.y' AS DOUBLE) AS y
      FROM (SELECT id AS pipeline_id, i, json_extract(d, '$.steps[' || i || ']') AS x FROM (SELECT id, d, unnest(range(CAST(json_array_length(d, '$.steps') AS BIGINT))) AS i FROM ({_READABLE}))) WHERE json_type(x) = 'OBJECT'""",
    "p3_found": f"{_ORPHANS} SELECT ref_table, row_id, item_id, state FROM r WHERE state IS NOT NULL",
    "p3_counts": f"{_ORPHANS} SELECT ref_table, state, strftime(moment, '%Y-%m') AS month, count(*) AS n_references FROM r WHERE state IS NOT NULL GROUP BY 1, 2, 3",
    "p4_found": f"{_TREE} SELECT n.graph, n.node_id, coalesce(root_id, 'cycle') AS root_id, coalesce(depth, -1) AS depth FROM n LEFT JOIN w USING (scope, k)",
    "p4_paths": f"""{_TREE}{_DESCENT}, size AS (SELECT scope, anc AS k, count(*) AS below FROM up GROUP BY 1, 2),
      cyc AS (SELECT e.scope, e.t AS k, p.node_id AS pid FROM e JOIN n p ON p.scope = e.scope AND p.k = e.s)
      SELECT n.graph, n.node_id, coalesce(parent_id, pid) AS parent_id, coalesce(root_id, 'cycle') AS root_id, coalesce(depth, -1) AS depth, path, CASE WHEN depth >= 0 THEN coalesce(below, 0) END AS n_descendants FROM n LEFT JOIN w USING (scope, k) LEFT JOIN size USING (scope, k) LEFT JOIN cyc USING (scope, k)""",
    "p4_descendants": f"{_TREE}{_DESCENT} SELECT a.graph, a.node_id, b.node_id AS descendant_id, distance FROM up JOIN n a ON a.scope = up.scope AND a.k = up.anc JOIN n b ON b.scope = up.scope AND b.k = up.k",
    "p5_found": _p5_sql(),
}
