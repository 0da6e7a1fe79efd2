"""Queries of sources, sinks, services, guards and shapes, with their SQL over the same tables.

Sources that need a file or a database get one from small tables of a fixed size, or through
the engine's own sinks, and are read back through the engine.
"""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
import zipfile
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslake.functions import scalars
from crosslake.functions.common import Scratch, latest, ship, table
from crosslake.model import EngineConfig
from crosslake.operators import analytics, lineage, quality, shaping
from crosslake.operators.nested import flatten_nested
from crosslake.plans.engine_queries import _CHECK_SQL, _CHECKS, _GRAPH_SQL, SQL_NOW, _c, _f, _g, _graph, _j, _now, _o, _t
from crosslake.plans.pipeline import Notebook, PipelineRunner, Transformations, due_pipelines, missing_settings, phases_of_all
from crosslake.plans.query_def import QueryDefinition, compile_query, to_sql
from crosslake.plans.record_queries import _LINKS, _READABLE, _STEPS, _WALK, _definition_parts, _nested
from crosslake.plans.sharing import Shares
from crosslake.plans.sqlexec import QueryEngine
from crosslake.sources import documents, export, files, rest, staging
from crosslake.sources.registry import Connection, ConnectionRegistry, field_types, with_primary_keys

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _case(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A folder of the shared file system, for files that are written by the driver."""
    path = Scratch(spark, "source").root.removeprefix("file://").removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


def _engine(spark: SparkSession, d: str, **config: int) -> QueryEngine:
    r = ConnectionRegistry(spark)
    r.add(Connection("lake", "Lake", "parquet", options={"path": d}))
    return QueryEngine(spark, r, config=EngineConfig(**config))


def _small(spark: SparkSession, d: str, name: str) -> list[tuple]:
    """The rows of ``nation`` or ``region``, which have 25 and 5 at every size."""
    return sorted(map(tuple, table(spark, d, name).collect()))


def _database(spark: SparkSession, d: str) -> Connection:
    path = f"{_folder(spark)}/own.db"
    with sqlite3.connect(path) as c:
        c.execute("create table nation (n_nationkey integer primary key, n_name text not null, n_regionkey integer)")
        c.execute("create table region (r_regionkey integer primary key, r_name text not null)")
        c.executemany("insert into nation values (?, ?, ?)", _small(spark, d, "nation"))
        c.executemany("insert into region values (?, ?)", _small(spark, d, "region"))
    return Connection("own", "Own", "sqlite", options={"path": path})


def _kept(df: DataFrame, *drop: str) -> DataFrame:
    """The result written, so that staging tables behind it can go."""
    out = Scratch(df.sparkSession, "result").write(df)
    for name in drop:
        staging.drop_staging(df.sparkSession, name)
    return out


# --- sources

_NATIVE = "SELECT n_name, r_name, CAST(n_nationkey * 2 AS BIGINT) AS twice FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA' AND n_nationkey % 3 = 1"


@_case("src_sqlite", _NATIVE)
def _sqlite(spark: SparkSession, d: str) -> DataFrame:
    """A text in the database's own SQL."""
    e = _engine(spark, d)
    e.registry.add(_database(spark, d))
    return e.sql(_NATIVE, "own")


@_case("src_sqlite_columns", "SELECT column_name AS name, CASE WHEN column_name LIKE '%key' THEN 'INTEGER' ELSE 'TEXT' END AS type, column_name = 'n_nationkey' AS is_key FROM information_schema.columns WHERE table_name = 'nation'")
def _sqlite_columns(spark: SparkSession, d: str) -> DataFrame:
    r = ConnectionRegistry(spark)
    r.add(_database(spark, d))
    assert [t.name for t in r.tables("own")] == ["nation", "region"] and r.test("own")[0]
    return spark.createDataFrame([(c.name, c.type.upper(), c.is_primary_key) for c in r.columns("own", "nation")], "name string, type string, is_key boolean")


@_case("src_parquet_columns", "SELECT column_name AS name, CASE WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'numeric' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' ELSE 'text' END AS type FROM information_schema.columns WHERE table_name = 'orders'")
def _parquet_columns(spark: SparkSession, d: str) -> DataFrame:
    e = _engine(spark, d)
    assert "orders" in {t.name for t in e.registry.tables("lake")} and [c.name for c in e.registry.columns("lake", "orders")]
    return spark.createDataFrame([(f["name"], f["type"]) for f in field_types(e.registry.read("lake", "orders"))], "name string, type string")


def _derby(spark: SparkSession, df: DataFrame, **limits: list[str]) -> tuple[ConnectionRegistry, DataFrame]:
    opts = {"url": f"jdbc:derby:memory:q{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    bad = staging.insert_database(df, opts, "items", **limits)
    r = ConnectionRegistry(spark)
    r.add(Connection("db", "Database", "derby", options=opts | {"partitionColumn": "n_nationkey"}))
    return r, bad


def _odd_nations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.unionByName(n.where("n_nationkey < 7")).unionByName(n.where("n_nationkey > 20").withColumns({"n_nationkey": F.col("n_nationkey") + 100, "n_name": F.lit(None).cast("string")}))


@_case("src_jdbc", "SELECT n_regionkey AS region, count(*) AS n, max(n_name) AS last_name FROM nation GROUP BY 1")
def _jdbc(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the constraints allow, inserted and aggregated by the database in its own SQL."""
    r, _ = _derby(spark, _odd_nations(spark, d), required=["n_name"], unique=["n_nationkey"])
    text = 'SELECT "n_regionkey" AS "region", CAST(count(*) AS BIGINT) AS "n", max(CAST("n_name" AS VARCHAR(100))) AS "last_name" FROM items GROUP BY "n_regionkey"'
    return QueryEngine(spark, r).sql(text, "db")


@_case("src_jdbc_ranges", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 5")
def _jdbc_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A table read in ranges of its key, with the filter in the database; on a cluster the driver reads it whole before the filter."""
    r, _ = _derby(spark, table(spark, d, "nation"))
    return r.scan("db", "items", columns=["n_nationkey", "n_name"], where="n_nationkey >= 5")


@_case("snk_insert_rejects", """
SELECT 'duplicate key (n_nationkey)' AS error, count(*) AS n, 'n_nationkey' AS "column" FROM nation WHERE n_nationkey < 7 UNION ALL SELECT 'null value in column n_name', count(*), 'n_name' FROM nation WHERE n_nationkey > 20""")
def _rejects(spark: SparkSession, d: str) -> DataFrame:
    bad = staging.split_rejects(_odd_nations(spark, d), ["n_name"], ["n_nationkey"])[1]
    return bad.groupBy("error", "column").agg(F.count(F.lit(1)).alias("n"))


@_case("src_scan", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey > 100 AND o_orderstatus = 'F'")
def _scan(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).registry.scan("lake", "orders", columns=["o_orderkey", "o_orderdate"], where="o_custkey > 100 AND o_orderstatus = 'F'")


@_case("src_materialised", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def _materialised(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).registry.materialised("lake", "customer", limit=None).drop("c_acctbal")


@_case("src_staging_scan", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _staging_scan(spark: SparkSession, d: str) -> DataFrame:
    full = staging.stage(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "default", "orders", uuid.uuid4().hex)
    e = _engine(spark, d)
    got = e.staging(f"SELECT o_orderstatus, count(*) AS n FROM {full} GROUP BY o_orderstatus", full.split(".")[0])
    return _kept(got, full)


@_case("xq_cross_source", "SELECT n_name AS nation, o_orderstatus AS status, count(o_orderkey) AS orders FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE n_regionkey <> 2 GROUP BY ALL")
def _cross_source(spark: SparkSession, d: str) -> DataFrame:
    """A database, files and a staging table in one definition."""
    e = _engine(spark, d)
    e.registry.add(_database(spark, d))
    full = staging.stage(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "default", "orders", uuid.uuid4().hex)
    schema, name = full.split(".")
    got = e.cross_query({
        "tables": [{"alias": "n", "table": "nation", "connectionId": "own"}, {"alias": "c", "table": "customer", "connectionId": "lake"}, {"alias": "o", "table": name, "schema": schema, "connectionId": "staging"}],
        "joins": [_j("n", "c", "INNER", "n_nationkey = c_nationkey"), _j("c", "o", "INNER", "c_custkey = o_custkey")],
        "columns": _c("n.n_name nation", "o.o_orderstatus status", "o.o_orderkey:COUNT orders"), "filters": [_f("n.n_regionkey !=", "2")], "groupBy": _g("n.n_name", "o.o_orderstatus"),
    }, capped=False)
    return _kept(got, full)


@_case("src_csv", "SELECT c_custkey, nullif(trim(CASE WHEN c_custkey % 5 = 0 THEN '  ' WHEN c_custkey % 5 = 1 THEN 'a \"quoted\", name' WHEN c_custkey % 5 = 2 THEN 'two' || chr(10) || 'lines' ELSE c_name END), '') AS c_name, c_acctbal, c_custkey % 2 = 0 AS even FROM customer")
def _csv(spark: SparkSession, d: str) -> DataFrame:
    """Written by the CSV export, parsed back with inferred types."""
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, "  ").when(k == 1, 'a "quoted", name').when(k == 2, "two\nlines").otherwise(F.col("c_name"))
    df = table(spark, d, "customer").select("c_custkey", name.alias("c_name"), "c_acctbal", (F.col("c_custkey") % 2 == 0).alias("even"))
    path = f"{Scratch(spark, 'csv').root}/customers"
    export.write_csv(df, path)
    p = files.parse_file(spark, path, "csv")
    assert p.types == {"c_custkey": "integer", "c_name": "text", "c_acctbal": "numeric", "even": "boolean"}, p.types
    return p.table()


def _workbook(path: str, rows: list[tuple]) -> None:
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="first" sheetId="1" r:id="rId1"/><sheet name="nations" sheetId="2" r:id="rId2"/></sheets></workbook>')
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{kind}" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{kind}" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


@_case("src_excel", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def _excel(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark)}/nations.xlsx"
    _workbook(path, [("n_nationkey", "n_name", "n_regionkey"), *_small(spark, d, "nation")])
    return files.parse_file(spark, path, sheet="nations").table()


@_case("src_json", """SELECT r_name AS name, n AS nations, names, CASE WHEN r_regionkey <> 2 THEN CAST(r_regionkey AS BIGINT) END AS regionkey FROM (SELECT r_regionkey, any_value(r_name) AS r_name, count(*) AS n, '["' || string_agg(n_name, '","' ORDER BY n_nationkey) || '"]' AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)""")
def _json(spark: SparkSession, d: str) -> DataFrame:
    """A whole document with a root path, one level of nesting, arrays, missing and empty values."""
    nations = _small(spark, d, "nation")
    items = []
    for key, name in _small(spark, d, "region"):
        own = [n for _, n, r in nations if r == key]
        items.append({"name": name, "of": {"nations": len(own), "names": own}} | ({"key": key} if key != 2 else {"key": ""}))
    path = f"{_folder(spark)}/regions.json"
    with open(path, "w") as f:
        json.dump({"data": {"rows": items}}, f)
    got = files.parse_file(spark, path, root_path="data.rows").table()
    return got.select("name", F.col("`of.nations`").alias("nations"), F.col("`of.names`").alias("names"), F.col("key").alias("regionkey"))


@_case("src_json_lines", "SELECT event_id, event_type, CAST(value AS VARCHAR) AS value, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def _json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Written by the JSON export, one document a line, parsed back; nested objects by dotted names."""
    df = table(spark, d, "events").select("event_id", "event_type", F.col("value").cast("string").alias("value"), F.from_json("props", "k bigint").alias("p"))
    path = f"{Scratch(spark, 'jsonl').root}/events"
    export.json_lines(df).write.text(path)
    rows = files.parse_file(spark, path, "json lines").rows
    return rows.select(F.col("event_id").cast("bigint").alias("event_id"), "event_type", "value", F.col("`p.k`").alias("k"))


@_case("src_url", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def _url(spark: SparkSession, d: str) -> DataFrame:
    """A fetched file whose type the content type tells."""
    body = "n_nationkey;n_name\n" + "".join(f"{k};{n}\n" for k, n, _ in _small(spark, d, "nation"))
    fetch = lambda url, headers: (body.encode(), "text/csv") if headers == {"Authorization": "Bearer t"} else (b"", None)
    return files.parse_url(spark, "https://host/nations?x=1", {"type": "bearer", "token": "t"}, folder=_folder(spark), fetch=fetch, delimiter=";").table()


@_case("src_rest", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")
def _rest(spark: SparkSession, d: str) -> DataFrame:
    rows = [{"id": k, "name": n} for k, n, _ in _small(spark, d, "nation")]
    fetch = lambda url, p: ({"data": {"items": rows[p["offset"] : p["offset"] + p["limit"]]}}, {})
    return rest.read_rest(spark, "https://host/nations", {"type": "offset", "items": "data.items", "size": 7}, fetch, "id bigint, name string")


@_case("src_parquet", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _parquet(spark: SparkSession, d: str) -> DataFrame:
    return files.parse_file(spark, f"{d}/customer.parquet").rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@_case("doc_serialized", "SELECT file_id, base64(buffer) AS buffer, strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS uploaded_at FROM uploaded_files")
def _serialized(spark: SparkSession, d: str) -> DataFrame:
    return documents.serialized(table(spark, d, "uploaded_files").select("file_id", "buffer", "uploaded_at"))


@_case("doc_columns", "SELECT column_name AS name, CASE WHEN data_type = 'INTEGER' THEN 'number' ELSE 'string' END AS type FROM information_schema.columns WHERE table_name = 'nation'")
def _doc_columns(spark: SparkSession, d: str) -> DataFrame:
    lines = export.json_lines(table(spark, d, "nation"))
    return spark.createDataFrame([(c.name, c.type) for c in documents.sample_columns(lines)], "name string, type string")


@_case("cat_primary_keys", "SELECT schema_kind AS table_name, column_name, position = 0 AS is_primary_key FROM upload_schemas")
def _primary_keys(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a catalog with the primary keys that another of its tables names."""
    cols = table(spark, d, "upload_schemas").select(F.lit("public").alias("table_schema"), F.col("schema_kind").alias("table_name"), "column_name", "position")
    keys = cols.where("position = 0")
    return with_primary_keys(cols, keys.unionByName(keys)).select("table_name", "column_name", "is_primary_key")


@_case("doc_unwind", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey >= 2")
def _unwind(spark: SparkSession, d: str) -> DataFrame:
    """A text in JSON through the engine: lookup, unwind, projection of nested fields."""
    spec = {"collection": "region", "pipeline": [{"$match": {"r_regionkey": {"$gte": 2}}}, {"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "n"}}, {"$unwind": "$n"}, {"$project": {"r_name": 1, "n_name": "$n.n_name"}}]}
    return _engine(spark, d).sql(json.dumps(spec), "lake")


# --- definitions


_PREVIEW = {
    "tables": _t("part p", "lineitem l"), "joins": [_j("p", "l", "INNER", "p_partkey = l_partkey")], "columns": _c("p.p_brand brand", "l.l_orderkey:COUNT lines", "l.l_suppkey:COUNT_DISTINCT suppliers", "l.l_shipdate:MAX last_shipped"),
    "filters": [_f("p.p_size >", "10"), _f("p.p_name LIKE", "%ring"), _f("l.l_returnflag IN", "A, N"), _f("l.l_quantity IS NOT NULL")], "groupBy": _g("p.p_brand"), "orderBy": _o("p.p_brand DESC"), "limit": 12,
}


@_case("xq_preview", to_sql(QueryDefinition.from_dict(_PREVIEW)))
def _preview(spark: SparkSession, d: str) -> DataFrame:
    """The plan of a definition against its own SQL text in another engine."""
    return compile_query(QueryDefinition.from_dict(_PREVIEW), lambda ref: table(spark, d, ref.table))


@_case("xq_odd_names", """SELECT n_name AS "it's", r_name AS "a b" FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> 'O''HARE'""")
def _odd_names(spark: SparkSession, d: str) -> DataFrame:
    """Names with dots, blanks and quotes, and a literal with a quote."""
    frames = {"n.x": table(spark, d, "nation").toDF("the key", 'na"me', "r.key"), "r": table(spark, d, "region").toDF("r.key", "na`me")}
    definition = {"tables": [{"table": "n.x", "alias": "n x"}, {"table": "r", "alias": "r"}], "joins": [{"leftTable": "n x", "rightTable": "r", "conditions": [{"leftColumn": "r.key", "rightColumn": "r.key"}]}], "columns": [{"tableAlias": "n x", "column": 'na"me', "alias": "it's"}, {"tableAlias": "r", "column": "na`me", "alias": "a b"}], "filters": [{"tableAlias": "n x", "column": 'na"me', "operator": "!=", "value": "O'HARE"}]}
    return compile_query(QueryDefinition.from_dict(definition), lambda ref: frames[ref.table])


_EDITED = "SELECT nation.n_name, nation_1.n_name AS n_name_1 FROM nation JOIN nation nation_1 ON nation.n_regionkey = nation_1.n_regionkey"


@_case("xq_edited", _EDITED)
def _edited(spark: SparkSession, d: str) -> DataFrame:
    """A definition built by edits: tables under numbered aliases, a removed table, toggled columns."""
    q = QueryDefinition((), ()).add_table("nation").add_table("nation").add_table("region")
    q = q.add_join("nation", "nation_1", "INNER", "n_regionkey", "n_regionkey").add_join("nation", "region", "INNER", "n_regionkey", "r_regionkey")
    q = q.select_all("nation", ["n_name", "n_nationkey"]).select_all("region", ["r_name"]).toggle_column("nation", "n_nationkey").toggle_column("nation_1", "n_name").remove_table("region")
    return compile_query(q, lambda ref: table(spark, d, ref.table))


@_case("xq_source_query", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'F' WHERE c_nationkey <= 3")
def _left_in_source(spark: SparkSession, d: str) -> DataFrame:
    """A table given by a query of its own, joined from the left."""
    e = _engine(spark, d)
    open_orders = e.sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'", "lake")
    frames = {"customer": table(spark, d, "customer"), "o": open_orders}
    q = {"tables": _t("customer c", "o"), "joins": [_j("c", "o", "LEFT", "c_custkey = o_custkey")], "columns": _c("c.c_custkey", "o.o_orderkey"), "filters": [_f("c.c_nationkey <=", "3")]}
    return compile_query(QueryDefinition.from_dict(q), lambda ref: frames[ref.table])


# --- raw SQL


def _sql(name: str, spark_sql: str, sql: str | None = None) -> None:
    _case(name, sql or spark_sql)(lambda spark, d: _engine(spark, d).sql(spark_sql, "lake"))


_sql("sql_comma_join", "SELECT n.n_name, region.r_name FROM nation n, region WHERE n.n_regionkey = region.r_regionkey AND region.r_regionkey IN (SELECT r_regionkey FROM region WHERE r_name > 'AMERICA')")
_sql("sql_cube", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n, CAST(grouping(o_orderstatus) + 2 * grouping(o_orderpriority) AS INT) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n, CAST(grouping(o_orderstatus) + 2 * grouping(o_orderpriority) AS INTEGER) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("sql_grouping_sets", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
_sql("sql_lateral", "SELECT c.c_custkey, t.o_orderkey FROM customer c JOIN LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') t ON TRUE")
_sql("sql_using_natural", "SELECT a.n_name, b.n_name AS other FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey")
_sql("sql_interval_join", "SELECT a.event_id AS first_id, b.event_id AS next_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '2 hours'")
_sql(
    "sql_asof",
    # the last event of the user before each purchase, by one window over the union instead of a join of all pairs
    "SELECT event_id, prev_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type <> 'purchase' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_id FROM events) WHERE event_type = 'purchase' AND prev_id IS NOT NULL",
    "SELECT p.event_id, e.event_id AS prev_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type <> 'purchase') e ON p.user_id = e.user_id AND p.ts > e.ts",
)
_sql("sql_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
_sql("sql_functions", "SELECT o_orderkey, o_custkey, upper(substring(o_orderpriority, 3, 4)) AS word, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, coalesce(nullif(o_orderstatus, 'O'), '-') AS s, CAST(o_orderkey % 7 AS BIGINT) AS m, abs(o_custkey - 50) AS a FROM orders", "SELECT o_orderkey, o_custkey, upper(substring(o_orderpriority, 3, 4)) AS word, CAST(extract(YEAR FROM o_orderdate) AS INTEGER) AS y, coalesce(nullif(o_orderstatus, 'O'), '-') AS s, CAST(o_orderkey % 7 AS BIGINT) AS m, abs(o_custkey - 50) AS a FROM orders")


# --- the engine's services


@_case("eng_execute", "SELECT least(count(*), 100) AS returned, count(*) AS total, count(*) > 100 AS truncated FROM orders WHERE o_orderstatus = 'P'")
def _execute(spark: SparkSession, d: str) -> DataFrame:
    e = _engine(spark, d, max_rows_limit=100)
    rows, result = e.execute("SELECT * FROM orders WHERE o_orderstatus = 'P'", "lake", count_all=True)
    return spark.createDataFrame([(len(rows), result.row_count, result.truncated)], "returned bigint, total bigint, truncated boolean")


@_case("eng_cached", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _cached(spark: SparkSession, d: str) -> DataFrame:
    e = _engine(spark, d)
    e.execute("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment", "lake", cache=True)
    return e.cached(e.history[-1].id)


@_case("eng_history", "SELECT 'success' AS status, 2 AS queries, (SELECT count(*) FROM nation) + (SELECT least(count(*), 50) FROM customer) AS row_count UNION ALL SELECT 'error', 1, NULL")
def _history(spark: SparkSession, d: str) -> DataFrame:
    e = _engine(spark, d, max_rows_limit=50)
    for text in ("SELECT * FROM nation", "SELECT * FROM customer", "SELECT nope FROM nation"):
        try:
            e.execute(text, "lake")
        except Exception:  # noqa: BLE001, S112 - the history holds it
            continue
    newest, total = e.history_page(2, 0)
    assert total == 3 and newest[0].status == "error"
    return e.history_frame().groupBy("status").agg(F.count(F.lit(1)).cast("int").alias("queries"), F.sum("row_count").alias("row_count"))


@_case("eng_generated", "SELECT least(count(*), 200) AS n, 1 AS warnings FROM orders WHERE o_orderstatus = 'F'")
def _generated(spark: SparkSession, d: str) -> DataFrame:
    """A text without a limit gets one."""
    df, v = _engine(spark, d, max_rows_limit=200).generated("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'; ", "lake")
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("warnings", F.lit(len(v.warnings)))


@_case("eng_answers", """
SELECT id, load_no, CASE WHEN length(sql_query) % 2 = 0 THEN trim(sql_query) ELSE 'SELECT 1 FROM (' || trim(sql_query) || ') x' END AS text, CASE WHEN length(sql_query) % 2 = 0 THEN 'as asked' END AS why FROM query_history WHERE regexp_matches(sql_query, '^(SELECT|WITH)')""")
def _answers(spark: SparkSession, d: str) -> DataFrame:
    """SQL taken out of free texts, fenced or not, by batches of Arrow."""
    from crosslake.plans.guards import sql_from_answer

    ship(spark)
    q = table(spark, d, "query_history").where(F.col("sql_query").rlike("^(SELECT|WITH)"))
    answer = F.when(F.length("sql_query") % 2 == 0, F.concat(F.lit("Sure.\n```sql\n"), "sql_query", F.lit("\n```\nREASONING: as asked"))).otherwise(F.concat(F.lit("Try this: SELECT 1 FROM ("), F.trim("sql_query"), F.lit(") x")))

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for b in batches:
            got = [sql_from_answer(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.string())], names=["id", "load_no", "text", "why"])

    return q.select("id", "load_no", answer.alias("answer")).mapInArrow(run, "id string, load_no int, text string, why string")


@_case("nb_execute", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def _notebook(spark: SparkSession, d: str) -> DataFrame:
    """A notebook's cells saved as a transformation, run, and read from its cached result."""
    cells = [{"id": "b", "type": "sql", "order": 2, "content": " SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey ", "connectionId": "lake"}, {"id": "a", "type": "markdown", "order": 1, "content": "x"}, {"id": "c", "type": "sql", "order": 0, "content": "SELECT 1 AS one FROM nation"}]
    t = Transformations(_engine(spark, d))
    n = Notebook("n", "n", cells)
    assert n.execute(t.engine, "b").columns == ["c_nationkey", "n"]
    made = n.save_as_transformation(t, "both")
    return t.result(t.run(made.id).id)


@_case("share_query", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 20 OFFSET 5")
def _share_query(spark: SparkSession, d: str) -> DataFrame:
    shares = Shares(_engine(spark, d))
    s = shares.create("customers", "connection", "lake", "public", "customer")
    return shares.query(s.share_token, "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey", 20, 5)


@_case("share_data", "SELECT n_nationkey, n_name, n_regionkey, 'connection' AS kind FROM nation UNION ALL SELECT c_nationkey, c_mktsegment, count(*), 'transformation' FROM customer GROUP BY 1, 2")
def _share_data(spark: SparkSession, d: str) -> DataFrame:
    t = Transformations(_engine(spark, d))
    shares = Shares(t.engine, t)
    made = t.create("x", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment", connection_id="lake")
    t.run(made.id)
    a = shares.data(shares.create("n", "connection", "lake", table_name="nation").api_key).withColumn("kind", F.lit("connection"))
    b = shares.data(shares.create("t", "transformation", made.id).api_key).withColumn("kind", F.lit("transformation"))
    return a.select("n_nationkey", "n_name", F.col("n_regionkey").cast("bigint").alias("n_regionkey"), "kind").union(b)


@_case("pipe_run", """
SELECT 'in' AS step, 'success' AS status, count(*) AS row_count FROM customer UNION ALL SELECT 'sum', 'success', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'join', 'success', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'out', 'success', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'bad', 'failed', NULL UNION ALL SELECT 'after', 'pending', NULL UNION ALL SELECT 'written', 'success', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def _pipe_run(spark: SparkSession, d: str) -> DataFrame:
    """A pipeline of all step types, one of which fails: the results of its steps, and the rows of its export."""
    t = Transformations(_engine(spark, d))
    saved = t.engine.save_cross("x", {"tables": [{"alias": a, "table": a, "connectionId": "lake"} for a in ("customer", "nation")], "joins": [_j("customer", "nation", "INNER", "c_nationkey = n_nationkey")], "columns": _c("customer.c_custkey", "nation.n_name")})
    total = t.create("sum", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey", connection_id="lake")
    bad = t.create("bad", "SELECT nope FROM customer", connection_id="lake")
    path, job = f"{Scratch(spark, 'pipe').root}/out", uuid.uuid4().hex
    step = lambda i, k, **c: {"id": i, "type": k, "config": c}
    steps = [step("in", "ingest", sourceConnectionId="lake", sourceTable="customer", jobId=job), step("sum", "transform", transformationId=total.id), step("join", "cross-query", savedCrossQueryId=saved), step("out", "export", savedCrossQueryId=saved, path=path), step("bad", "transform", transformationId=bad.id), step("after", "transform", transformationId=total.id)]
    edges = [{"source": a, "target": b} for a, b in (("in", "sum"), ("sum", "join"), ("join", "out"), ("out", "bad"), ("bad", "after"))]
    run = PipelineRunner(t).run({"steps": steps, "edges": edges})
    assert run.status == "partial"
    staging.drop_staging(spark, f"{staging.staging_schema('default')}.{staging.staging_name('customer', job)}")
    rows = [(s, r.status, r.rows_processed) for s, r in run.step_results.items()] + [("written", "success", spark.read.parquet(path).count())]
    return spark.createDataFrame(rows, "step string, status string, row_count bigint")


@_case("pipe_phases", f"""
WITH RECURSIVE s AS (SELECT DISTINCT pipeline_id AS p, lower(trim(step_id, ' ')) AS k FROM ({_STEPS}) WHERE step_id IS NOT NULL), n AS (SELECT p, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT DISTINCT l.pipeline_id AS p, a.k AS a, b.k AS b FROM ({_LINKS}) l JOIN s a ON a.p = l.pipeline_id AND a.k = lower(trim(l.source, ' ')) JOIN s b ON b.p = l.pipeline_id AND b.k = lower(trim(l.target, ' '))),
w AS (SELECT p, k, 0 AS depth FROM s UNION SELECT w.p, e.b, depth + 1 FROM w JOIN e ON e.p = w.p AND e.a = w.k JOIN n ON n.p = w.p WHERE depth < n.n)
SELECT x.pipeline_id, x.step_id, CASE WHEN max(depth) < any_value(n) THEN CAST(max(depth) AS INTEGER) END AS phase FROM (SELECT DISTINCT pipeline_id, step_id FROM ({_STEPS}) WHERE step_id IS NOT NULL) x JOIN w ON w.p = x.pipeline_id AND w.k = lower(trim(x.step_id, ' ')) JOIN n ON n.p = x.pipeline_id GROUP BY 1, 2""")
def _phases(spark: SparkSession, d: str) -> DataFrame:
    """The phase of each step of each pipeline's definition; null where it waits for a cycle."""
    parts = _definition_parts(spark, d, Scratch(spark, "phases"))
    return phases_of_all(parts.where("part = 'steps[]'").select("pipeline_id", F.col("id").alias("step_id")), parts.where("part = 'edges[]'").select("pipeline_id", "source", "target"))


_NEED = {"transform": ("transformationId",), "cross-query": ("savedCrossQueryId",), "ingest": ("sourceConnectionId", "sourceTable"), "export": ("path",)}
_SETTING = "CASE WHEN json_type(x, '$.config') = 'VARCHAR' AND json_valid(x ->> '$.config') THEN json_extract_string(CAST(x ->> '$.config' AS JSON), '$.{k}') ELSE json_extract_string(x, '$.config.{k}') END"


@_case("pipe_step_checks", "WITH s AS (SELECT id AS pipeline_id, x ->> '$.id' AS step_id, x ->> '$.type' AS type, x FROM (SELECT id, unnest(CASE WHEN json_type(d, '$.steps') = 'ARRAY' THEN CAST(json_extract(d, '$.steps[*]') AS JSON[]) ELSE [] END) AS x FROM (" + _READABLE + ")) WHERE json_type(x) = 'OBJECT') SELECT pipeline_id, step_id, 'unknown type ' || coalesce(type, 'None') AS problem FROM s WHERE type IS NULL OR type NOT IN ('ingest', 'transform', 'cross-query', 'export')"
       + "".join(f" UNION ALL SELECT pipeline_id, step_id, '{k} is required' FROM s WHERE type = '{t}' AND coalesce({_SETTING.format(k=k)}, '') = ''" for t, ks in _NEED.items() for k in ks))
def _step_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is missing in the settings of all steps of all pipelines."""
    got = flatten_nested(latest(table(spark, d, "pipelines").select("id", "updated_at", "definition"), "id", F.col("updated_at").desc_nulls_last()), "id", "definition", tables=("steps[]",))
    inner = F.map_from_entries(F.transform(F.filter(F.map_entries("fields"), lambda e: e["key"].startswith("config.")), lambda e: F.struct(F.substring(e["key"], 8, 1 << 20), e["value"])))
    return missing_settings(got.select(F.col("root_id").alias("pipeline_id"), F.col("fields")["id"].alias("step_id"), F.col("fields")["type"].alias("type"), inner.alias("settings")))


@_case("pipe_due", """
SELECT id, schedule, h FROM (SELECT DISTINCT id, schedule, status FROM pipelines), unnest(range(24)) u(h) WHERE status = 'active' AND (string_split(schedule, ' ')[2] = '*' OR string_split(schedule, ' ')[2] = CAST(h AS VARCHAR) OR (contains(string_split(schedule, ' ')[2], '*/') AND h % CAST(substr(string_split(schedule, ' ')[2], 3) AS INTEGER) = 0))""")
def _due(spark: SparkSession, d: str) -> DataFrame:
    """Which active pipelines' schedules name some minute of each hour of a day."""
    p = table(spark, d, "pipelines").select("id", "schedule", "status").distinct().where("schedule is not null")
    hours = p.withColumn("h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(23).cast("bigint"))))
    any_minute = F.concat_ws(" ", F.lit("*"), F.substring_index("schedule", " ", -4))
    at = F.make_timestamp_ntz(F.lit(2026), F.lit(1), F.lit(5), F.col("h").cast("int"), F.lit(0), F.lit(0))
    return due_pipelines(hours.withColumns({"was": F.col("schedule"), "schedule": any_minute}), at).select("id", F.col("was").alias("schedule"), "h")


# --- sinks


@_case("export_json_lines", """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","segment":' || coalesce('"' || nullif(c_mktsegment, 'BUILDING') || '"', 'null') || '}' AS value FROM customer""")
def _json_out(spark: SparkSession, d: str) -> DataFrame:
    return export.json_lines(table(spark, d, "customer").select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")))


@_case("export_error_lines", """
SELECT concat_ws(',', '"' || epoch_us(created_at) || '"', '"last_login_at"', '"null"', '"Empty cell"', '"MISSING_VALUE"', '"warning"', '"Fill the cell, or let the column be empty"') AS value FROM users WHERE last_login_at IS NULL""")
def _error_lines(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "users").select(F.unix_micros(F.col("created_at").cast("timestamp")).alias("n"), "email", "last_login_at")
    return export.error_lines(files.error_records(u, "n"))


@_case("export_report", """
WITH r AS (SELECT r_name, count(*) AS n, row_number() OVER (ORDER BY r_name) AS i FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT 0 AS line_no, 'Dashboard Report,2026-01-01T00:00:00' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, 'Totals' UNION ALL SELECT 3, '"customers","' || (SELECT count(*) FROM customer) || '"' UNION ALL SELECT 4, '' UNION ALL SELECT 5, 'Regions' UNION ALL SELECT 6, '"region","nations"'
UNION ALL SELECT 6 + i, '"' || r_name || '","' || n || '"' FROM r UNION ALL SELECT 7 + max(i), '' FROM r""")
def _report(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").count().orderBy("r_name").collect()  # a row for each region
    text = export.dashboard_report({"Totals": {"customers": table(spark, d, "customer").count()}, "Regions": [{"region": r[0], "nations": r[1]} for r in per]}, datetime(2026, 1, 1))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no bigint, line string")


@_case("export_catalog", f"""
SELECT 'service' AS kind, count(*) AS n FROM (SELECT DISTINCT * FROM connections) UNION ALL SELECT 'table', count(*) FROM (SELECT DISTINCT table_name FROM table_profiles) UNION ALL SELECT 'pipeline', count(*) FROM (SELECT DISTINCT id, name FROM pipelines) UNION ALL SELECT 'edge', count(*) FROM (SELECT DISTINCT id FROM lineage_edges)
UNION ALL SELECT 'query', least(500, count(*)) FROM query_history WHERE executed_at > {SQL_NOW} - INTERVAL 7 DAY""")
def _catalog_out(spark: SparkSession, d: str) -> DataFrame:
    p = export.catalog_payload(table(spark, d, "connections").distinct(), table(spark, d, "table_profiles").select(F.col("table_name").alias("name")).distinct(), table(spark, d, "pipelines").select("id", "name").distinct(), table(spark, d, "lineage_edges").select("id").distinct(), table(spark, d, "query_history"), _now())
    return export.payload_counts(p)


@_case("export_catalog_changes", "SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'created' ELSE 'updated' END AS action FROM customer WHERE c_custkey % 3 <> 1")
def _catalog_changes(spark: SparkSession, d: str) -> DataFrame:
    """A third of the entries is new to the catalog, a third changed, a third as it was."""
    c = table(spark, d, "customer")
    pay = c.select(F.lit("table").alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("body"))
    known = c.where("c_custkey % 3 <> 0").select(F.lit("table").alias("kind"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).otherwise("old").alias("body"))
    return export.catalog_changes(pay.unionByName(pay), known).select("name", "action")


@_case("snk_retention", f"SELECT 'runs' AS kept, count(*) AS n FROM quality_check_runs WHERE ran_at >= {SQL_NOW} - INTERVAL 90 DAY OR ran_at IS NULL UNION ALL SELECT 'cached', count(*) FROM (SELECT DISTINCT id FROM quality_check_runs WHERE id NOT IN (SELECT id FROM quality_check_runs WHERE ran_at < {SQL_NOW} - INTERVAL 90 DAY))")
def _retention(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quality_check_runs")
    runs, cached = staging.keep_recent(q.select("id", F.col("ran_at").alias("started_at")), q.select(F.col("id").alias("run_id")).distinct(), datetime(2026, 1, 1))
    n = F.count(F.lit(1)).alias("n")
    return runs.agg(n).withColumn("kept", F.lit("runs")).unionByName(cached.agg(n).withColumn("kept", F.lit("cached")))


@_case("snk_upsert_counts", "SELECT count(*) FILTER (k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS inserted, count(*) FILTER (k IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS updated FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F')")
def _upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return staging.upsert(o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus <> 'F'"), ["o_orderkey"], [F.desc("o_custkey")])[1]


@_case("ing_import_rejects", "SELECT count(*) AS rows_processed, count(*) FILTER (c_custkey % 150 <> 7) AS rows_succeeded, count(*) FILTER (c_custkey % 150 = 7) AS rows_failed, CAST(sum(c_custkey) FILTER (c_custkey % 150 <> 7) AS BIGINT) AS key_sum FROM customer")
def _import(spark: SparkSession, d: str) -> DataFrame:
    """A parsed file with strays: rows with an error stay out of the staging table."""
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 150 == 7, "x1").otherwise(F.col("c_custkey").cast("string")).alias("key"), "c_name")
    path = f"{Scratch(spark, 'import').root}/customers"
    export.write_csv(c, path)
    got = staging.import_parsed(files.parse_file(spark, path, "csv"), "default", "customers", uuid.uuid4().hex)
    total = spark.table(got["table"]).agg(F.sum("key")).first()[0]
    staging.drop_staging(spark, got["table"])
    return spark.createDataFrame([(got["rows_processed"], got["rows_succeeded"], got["rows_failed"], total)], "rows_processed bigint, rows_succeeded bigint, rows_failed bigint, key_sum bigint")


@_case("ing_errors_by_type", "SELECT 'MISSING_VALUE' AS type, count(*) AS n FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'VALIDATION_ERROR', count(*) FROM customer WHERE c_custkey % 4 = 1")
def _errors_by_type(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    from crosslake.operators.transforms import errors_by_type

    c = table(spark, d, "customer").select("c_custkey", F.when(k == 0, "").when(k == 1, "x").otherwise("12").alias("v"))
    return errors_by_type(files.error_records(c, "c_custkey", {"v": "integer"}))


@_case("ing_blank_to_null", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE c_name END AS c_name FROM customer")
def _blank(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    return files.blank_to_null(table(spark, d, "customer").select("c_custkey", F.when(k == 0, "").when(k == 1, "   ").otherwise(F.col("c_name")).alias("c_name")))


@_case("ing_map_check", "SELECT 'Source column not found: c_nope' AS problem UNION ALL SELECT 'Target column not found: wrong'")
def _map_check(spark: SparkSession, d: str) -> DataFrame:
    got = staging.check_mapping({"c_name": "s_name", "c_nope": "s_suppkey", "c_custkey": "wrong"}, table(spark, d, "customer").columns, table(spark, d, "supplier").columns)
    return spark.createDataFrame([(x,) for x in got], "problem string")


@_case("ext_rules_all", """
WITH j AS (SELECT c_custkey, [c_mktsegment = 'BUILDING', TRY_CAST(c_name AS INTEGER) IS NULL AND c_custkey % 2 = 0, c_acctbal NOT BETWEEN 0 AND 5000, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1 AND c_custkey % 3 = 0] AS p FROM customer)
SELECT c_custkey, CASE WHEN p[3] THEN 'error' WHEN p[1] THEN 'error' WHEN p[4] THEN 'error' WHEN p[2] THEN 'warning' ELSE 'good' END AS state FROM j""")
def _rules_all(spark: SparkSession, d: str) -> DataFrame:
    """Required, type, range and unique rules, errors and warnings."""
    from crosslake.operators.transforms import validate_rows

    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("need"), F.when(k % 2 == 0, F.col("c_name")).otherwise("7").alias("whole"), "c_acctbal", F.when(k % 3 == 0, F.concat_ws("/", "c_nationkey", "c_mktsegment")).otherwise(F.concat(F.lit("own"), k)).alias("code"))
    # the code of every third customer is unique among all customers of its kind only if no other third one has it
    rules = [{"column": "need", "rule": "required"}, {"column": "whole", "rule": "type", "type": "int", "severity": "warning"}, {"column": "c_acctbal", "rule": "range", "min": 0, "max": 5000}, {"column": "code", "rule": "unique"}]
    good, bad, warned = validate_rows(c, rules)
    state = lambda df, s: df.select("c_custkey", F.lit(s).alias("state"))
    return state(bad, "error").unionByName(state(warned, "warning")).unionByName(state(good.join(warned.select("c_custkey"), "c_custkey", "left_anti"), "good"))


SQL["ext_rules_all"] = """
WITH t AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1, 2)
SELECT c_custkey, CASE WHEN c_acctbal NOT BETWEEN 0 AND 5000 OR c_mktsegment = 'BUILDING' OR (c_custkey % 3 = 0 AND n > 1) THEN 'error' WHEN c_custkey % 2 = 0 THEN 'warning' ELSE 'good' END AS state FROM customer LEFT JOIN t USING (c_nationkey, c_mktsegment)"""


# --- lineage


def _lineage_frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The engine's own records, by tables that have the same columns."""
    conns = latest(table(spark, d, "connections"), "id", F.col("created_at").asc_nulls_last())
    jobs = table(spark, d, "uploaded_files").select(F.col("file_id").cast("string").alias("id"), F.col("originalname").alias("file_name"), F.lit("completed").alias("status"), F.col("size_bytes").alias("rows_succeeded"), F.lit("csv").alias("source_type"), F.col("uploaded_at").alias("created_at"), F.lit(None).cast("string").alias("source_connection_id"), F.lit(None).cast("string").alias("connection_id"), F.lit("staging").alias("target_type"), F.col("uploaded_at").alias("completed_at"))
    staged = jobs.select(F.concat(F.lit("s"), "id").alias("id"), F.col("file_name").alias("table_name"), F.col("rows_succeeded").alias("row_count"), "created_at", F.col("id").alias("import_job_id"))
    books = latest(table(spark, d, "notebooks"), "id", F.col("updated_at").desc_nulls_last(), F.col("name"))
    trans = books.select("id", "name", F.lit("active").alias("status"), F.lit(None).cast("timestamp_ntz").alias("last_run_at"), "created_at", F.get_json_object("cells", "$[0].connectionId").alias("source_connection_id"))
    runs = table(spark, d, "quality_check_runs").select("id", F.col("check_id").alias("transformation_id"), F.lit(1).alias("rows_processed"), F.col("duration_ms").alias("execution_time_ms"), F.col("ran_at").alias("completed_at"), F.col("ran_at").alias("started_at"))
    cross = books.select(F.concat(F.lit("x"), "id").alias("id"), "name", "created_at", F.concat(F.lit('{"tables":'), F.when(F.try_parse_json("cells").isNotNull(), F.col("cells")).otherwise("[]"), F.lit("}")).alias("query_definition"))
    shares = latest(table(spark, d, "dataset_shares").where("active"), "id", F.col("name")).select("id", "name", "dataset_type", "dataset_id", "row_count", "created_at", "active")
    return {"connections": conns, "jobs": jobs, "staged": staged, "transformations": trans, "runs": runs, "cross_queries": cross, "shares": shares}


_LINEAGE_SQL = """
WITH c AS (SELECT id, lower(trim(id)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY created_at NULLS LAST) AS rn FROM connections) WHERE rn = 1),
j AS (SELECT CAST(file_id AS VARCHAR) AS id FROM (SELECT * FROM uploaded_files ORDER BY uploaded_at DESC, CAST(file_id AS VARCHAR) LIMIT 500)),
b AS (SELECT id, cells FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated_at DESC NULLS LAST, name) AS rn FROM notebooks) WHERE rn = 1),
s AS (SELECT id, dataset_type, dataset_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY name) AS rn FROM dataset_shares WHERE active) WHERE rn = 1),
n AS (SELECT 'connection' AS type, 'connection-' || id AS id FROM c UNION ALL SELECT 'import_job', 'import_job-' || id FROM j UNION ALL SELECT 'staged_data', 'staged_data-s' || file_id FROM uploaded_files UNION ALL SELECT 'transformation', 'transformation-' || id FROM b UNION ALL SELECT 'cross_query', 'cross_query-x' || id FROM b UNION ALL SELECT 'dataset_share', 'dataset_share-' || id FROM s)"""


@_case("lin_build_nodes", f"{_LINEAGE_SQL} SELECT type, id FROM n")
def _lin_nodes(spark: SparkSession, d: str) -> DataFrame:
    return lineage.build_lineage(**_lineage_frames(spark, d))[0].select("type", "id")


@_case("lin_build_edges", f"""{_LINEAGE_SQL},
cells AS (SELECT DISTINCT id, x ->> '$.connectionId' AS conn FROM (SELECT id, unnest(CASE WHEN json_valid(cells) AND json_type(CAST(cells AS JSON)) = 'ARRAY' THEN CAST(json_extract(CAST(cells AS JSON), '$[*]') AS JSON[]) ELSE [] END) AS x FROM b)),
e AS (SELECT 'creates' AS label, 'import_job-' || file_id AS source, 'staged_data-s' || file_id AS target FROM uploaded_files
  UNION ALL SELECT 'transforms', 'connection-' || json_extract_string(cells, '$[0].connectionId'), 'transformation-' || id FROM b WHERE json_valid(cells) AND json_extract_string(cells, '$[0].connectionId') IS NOT NULL
  UNION ALL SELECT 'queries', 'connection-' || conn, 'cross_query-x' || id FROM cells WHERE conn <> ''
  UNION ALL SELECT 'shared as', CASE dataset_type WHEN 'staged' THEN 'staged_data' WHEN 'cross-query' THEN 'cross_query' ELSE dataset_type END || '-' || dataset_id, 'dataset_share-' || id FROM s)
SELECT label, source, target FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)""")
def _lin_edges(spark: SparkSession, d: str) -> DataFrame:
    return lineage.build_lineage(**_lineage_frames(spark, d))[1].select("label", "source", "target")


@_case("lin_bfs_edges", f"WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({_GRAPH_SQL})), m AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), w AS (SELECT 'c7' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN m ON a = id WHERE depth < 2), f AS (SELECT id, min(depth) AS depth FROM w GROUP BY 1) SELECT DISTINCT source, target FROM e JOIN f ON (source = f.id OR target = f.id) AND depth < 2")
def _bfs_edges(spark: SparkSession, d: str) -> DataFrame:
    return lineage.subgraph(*_graph(spark, d), "c7", "both", 2)[1].select("source", "target")


# --- quality, statistics, shapes


@_case("dq_runner", f"SELECT check_id, status, actual_value FROM ({_CHECK_SQL}) UNION ALL SELECT 'c8', 'error', NULL UNION ALL SELECT 'c9', 'pass', CAST(count(*) AS DOUBLE) FROM query_history UNION ALL SELECT 'c10', 'fail', NULL")
def _runner(spark: SparkSession, d: str) -> DataFrame:
    """All checks of a table: fused ones by one scan, a column that is missing, custom SQL, a custom result that is null."""
    runner = quality.CheckRunner({"query_history": table(spark, d, "query_history")}, _now())
    more = [quality.QualityCheck("c8", "not_null", "nope"), quality.QualityCheck("c9", "custom_sql", None, {"sql": "SELECT count(*) FROM query_history", "operator": "gt", "threshold": 1}), quality.QualityCheck("c10", "custom_sql", None, {"sql": "SELECT max(row_count) FROM query_history WHERE id = ''"})]
    got = runner.run("query_history", [*_CHECKS, *more])
    assert [r["status"] for r in runner.last_runs("c8")] == ["error"]
    return spark.createDataFrame([(r["check_id"], r["status"], r["actual_value"]) for r in got], "check_id string, status string, actual_value double")


@_case("dq_profile_sampled", "SELECT 'l_returnflag' AS name, least(100000, count(*)) AS total_rows FROM lineitem UNION ALL SELECT 'l_comment', least(100000, count(*)) FROM lineitem")
def _sampled(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_returnflag", F.lit("x").alias("l_comment"))
    return quality.profile_table(df, sample_rows=100_000).select("name", "total_rows")


@_case("an_health_by_type", f"""
WITH h AS (SELECT connection_id, count(*) FILTER (executed_at > {SQL_NOW} - INTERVAL 30 DAY) AS n, count(*) FILTER (executed_at > {SQL_NOW} - INTERVAL 30 DAY AND status = 'error') AS bad, arg_max(status, (executed_at, id)) AS last_status FROM query_history WHERE connection_id IS NOT NULL GROUP BY 1)
SELECT type, count(*) AS connections, count(*) FILTER (coalesce(n, 0) > 0 AND bad <= 5 AND last_status = 'success') AS online FROM connections LEFT JOIN h ON h.connection_id = connections.id GROUP BY 1""")
def _by_type(spark: SparkSession, d: str) -> DataFrame:
    return analytics.health_by_type(analytics.connection_health(table(spark, d, "connections"), table(spark, d, "query_history"), _now()))


@_case("an_health_totals", f"""
WITH h AS (SELECT connection_id, count(*) FILTER (executed_at > {SQL_NOW} - INTERVAL 30 DAY) AS n, count(*) FILTER (executed_at > {SQL_NOW} - INTERVAL 30 DAY AND status = 'error') AS bad, arg_max(status, (executed_at, id)) AS last_status FROM query_history WHERE connection_id IS NOT NULL GROUP BY 1),
s AS (SELECT CASE WHEN coalesce(n, 0) = 0 THEN 'idle' WHEN bad > 5 THEN 'error' WHEN last_status = 'success' THEN 'online' ELSE 'offline' END AS s FROM connections LEFT JOIN h ON h.connection_id = connections.id)
SELECT count(*) AS total_connections, count(*) FILTER (s = 'online') AS online, count(*) FILTER (s = 'offline') AS offline, count(*) FILTER (s = 'error') AS error, count(*) FILTER (s = 'idle') AS idle FROM s""")
def _health_totals(spark: SparkSession, d: str) -> DataFrame:
    return analytics.health_totals(analytics.connection_health(table(spark, d, "connections"), table(spark, d, "query_history"), _now()))


@_case("an_lights", "SELECT id, CASE WHEN row_count IS NULL THEN NULL WHEN row_count < 5 THEN 'good' WHEN row_count <= 10 THEN 'fair' ELSE 'poor' END AS light FROM query_history")
def _lights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_history").select("id", scalars.failure_rate_light(F.col("row_count")).alias("light"))


@_case("shape_series", "SELECT CAST(user_id AS VARCHAR) AS x, TRY_CAST(CASE WHEN event_type = 'click' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS y FROM events")
def _series(spark: SparkSession, d: str) -> DataFrame:
    return shaping.series(table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "click", "n/a").otherwise(F.col("value").cast("string"))), "user_id", "v")


@_case("shape_radar_rows", "SELECT p_name AS name, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part ORDER BY p_partkey LIMIT 3")
def _radar_rows(spark: SparkSession, d: str) -> DataFrame:
    got = shaping.radar_series(table(spark, d, "part").orderBy("p_partkey").limit(3).select("p_name", "p_size", "p_retailprice"), ["p_retailprice"])
    return got.select("name", F.col("values")[0].alias("size"), F.col("values")[1].alias("price"))


@_case("shape_no_zero_slices", "SELECT s AS name, CAST(n AS DOUBLE) AS value, n * 100.0 / sum(n) OVER () AS percent FROM (SELECT 'open' AS s, count(*) FILTER (o_orderstatus = 'O') AS n FROM orders UNION ALL SELECT 'partly', count(*) FILTER (o_orderstatus = 'P') FROM orders UNION ALL SELECT 'lost', 0) WHERE n > 0")
def _slices(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    one = table(spark, d, "orders").agg(is_("O").alias("open"), is_("P").alias("partly"), is_("?").alias("lost"))
    return shaping.name_value(one.unpivot([], ["open", "partly", "lost"], "s", "n"), "s", "n", drop_zero=True)


@_case("shape_progress", "SELECT id, CASE WHEN row_count > 0 THEN CAST(floor(execution_time_ms * 100.0 / row_count + 0.5) AS BIGINT) ELSE 0 END AS progress, CASE WHEN row_count > 0 THEN printf('%.1f', floor((row_count - row_count % 7) * 1000.0e0 / row_count + 0.5) / 10) ELSE '0.0' END AS success FROM query_history WHERE row_count IS NOT NULL AND execution_time_ms BETWEEN 0 AND 100000000")
def _progress(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "query_history").where("row_count is not null and execution_time_ms between 0 and 100000000")
    return h.select("id", shaping.progress_percent(F.col("execution_time_ms"), F.col("row_count")).cast("bigint").alias("progress"), shaping.success_percent(F.col("row_count"), F.col("row_count") % 7).alias("success"))


@_case("shape_notebook_sql", r"""
SELECT id, updated_at, coalesce(string_agg(c, ';' || chr(10) || chr(10) ORDER BY o, i), '') AS text FROM (
  SELECT id, updated_at, i, coalesce(CAST(x ->> '$.order' AS INTEGER), 0) AS o, CASE WHEN x ->> '$.type' = 'sql' THEN nullif(regexp_replace(x ->> '$.content', '^\s+|\s+$', '', 'g'), '') END AS c
  FROM (SELECT id, updated_at, i, json_extract(cells, '$[' || i || ']') AS x FROM (SELECT *, unnest(range(CAST(json_array_length(cells) AS BIGINT))) AS i FROM (SELECT DISTINCT id, updated_at, cells FROM notebooks WHERE json_valid(cells))))) GROUP BY 1, 2""")
def _notebook_sql(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notebooks").select("id", "updated_at", "cells").distinct().where("json_array_length(cells) > 0")
    return n.select("id", "updated_at", shaping.combined_cells(F.col("cells")).alias("text"))


@_case("shape_checks_by_table", "SELECT 'public.' || table_name AS \"table\", string_agg(column_name, ',' ORDER BY column_name) AS checks FROM table_profiles GROUP BY 1")
def _checks_by_table(spark: SparkSession, d: str) -> DataFrame:
    got = shaping.checks_by_table(table(spark, d, "table_profiles").select(F.lit("public").alias("schema_name"), "table_name", F.col("column_name").alias("check_id")))
    return got.select("table", F.array_join("checks", ",").alias("checks"))


@_case("shape_columns", "SELECT 'x' AS role, 'o_orderkey' AS name UNION ALL SELECT 'y', 'o_custkey' UNION ALL SELECT 'map', 'N_NAME>n_name'")
def _columns(spark: SparkSession, d: str) -> DataFrame:
    x, y = shaping.pick_columns(table(spark, d, "orders"))
    return spark.createDataFrame([("x", x), ("y", y), *[("map", f"{a}>{b}") for a, b in shaping.match_columns(["N_NAME", "other"], table(spark, d, "nation").columns).items()]], "role string, name string")


# --- scalar functions

_ISO_TEXT = "CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 3 THEN strftime(ts, '%d.%m.%Y') WHEN 4 THEN '1899-01-01' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"


@_case("fn_iso_times", f"SELECT event_id, CASE WHEN event_id % 6 NOT IN (3, 4) THEN TRY_CAST(replace(v, 'Z', '') AS TIMESTAMP) END AS at FROM (SELECT event_id, {_ISO_TEXT} AS v FROM events)")
def _iso_times(spark: SparkSession, d: str) -> DataFrame:
    k, f = F.col("event_id") % 6, lambda p: F.date_format("ts", p)
    v = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("yyyy-MM-dd HH:mm")).when(k == 2, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 3, f("dd.MM.yyyy")).when(k == 4, "1899-01-01").otherwise(f("yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", files.as_time(v).alias("at"))


@_case("fn_bytes_label", r"""
SELECT id, CASE WHEN v > 0 THEN regexp_replace(printf('%.2f', floor(v / pow(1024, k) * 100 + 0.5) / 100), '\.?0+$', '') || ' ' || ['B', 'KB', 'MB', 'GB'][k + 1] WHEN v IS NOT NULL THEN '0 B' END AS label
FROM (SELECT id, v, CASE WHEN v > 0 THEN CAST(least(3, greatest(0, floor(ln(v) / ln(1024) + 1e-12))) AS INTEGER) END AS k FROM (SELECT id, CAST(row_count AS DOUBLE) * (1 + length(id) % 3) * execution_time_ms AS v FROM query_history))""")
def _bytes(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("row_count").cast("double") * (1 + F.length("id") % 3) * F.col("execution_time_ms")
    return table(spark, d, "query_history").select("id", scalars.bytes_label(v).alias("label"))


@_case("fn_names", """
SELECT file_id, substring(CASE WHEN regexp_matches(n, '^[0-9]') THEN '_' || n ELSE n END, 1, 50) AS table_name, NOT regexp_full_match(originalname, '[a-z0-9_]+') AS quoted FROM (SELECT file_id, originalname, regexp_replace(lower(originalname), '[^a-z0-9_]', '_', 'g') AS n FROM uploaded_files)""")
def _names(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("originalname")
    return table(spark, d, "uploaded_files").select("file_id", scalars.table_name_column(c).alias("table_name"), scalars.needs_quoting_column(c).alias("quoted"))


_COMMENTED = "'/* a' || chr(10) || ' b */ ' || replace(sql_query, ' ', '  ') || chr(10) || ' -- end'"


@_case("fn_sanitize", f"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace({_COMMENTED}, '--[^\\n]*', '', 'g'), '/\\*(.|\\n)*?\\*/', '', 'g'), '\\s+', ' ', 'g')) AS text FROM query_history")
def _sanitize(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("/* a\n b */ "), F.replace("sql_query", F.lit(" "), F.lit("  ")), F.lit("\n -- end"))
    return table(spark, d, "query_history").select("id", scalars.sanitize_sql(text).alias("text"))


_TEXTS = "SELECT id, load_no, CASE length(sql_query) % 8 WHEN 0 THEN sql_query || '; DROP TABLE x' WHEN 1 THEN sql_query || ' -- y' WHEN 2 THEN 'EXEC  (' || sql_query || ')' WHEN 3 THEN sql_query || ' /* z */' WHEN 4 THEN 'DELETE FROM staging_a.t' WHEN 5 THEN ' ' || sql_query || ';' WHEN 6 THEN 'SELECT updated_at FROM STAGING_A.t' ELSE sql_query END AS t FROM query_history"


@_case("guard_texts", f"""
SELECT id, load_no, t <> '' AND NOT contains(t, '--') AND NOT contains(t, '/*') AND NOT contains(t, '*/') AND NOT regexp_matches(t, '(?i);\\s*(drop|delete|truncate|alter|create|grant|revoke)\\s+|xp_cmdshell|sp_executesql|exec(\\s+|\\()|execute(\\s+|\\()|into\\s+outfile|into\\s+dumpfile|load_file') AS query_ok,
  NOT regexp_matches(t, '(?i)\\b(drop|delete|truncate|update|insert|alter|create|grant|revoke)\\s+') AND contains(lower(t), 'staging_a') AS staging_ok,
  starts_with(lower(trim(t)), 'select') AND NOT regexp_matches(t, '(?i);\\s*(drop|delete|insert|update|alter|create|truncate|grant|revoke)|--|/\\*|xp_cmdshell|exec\\s*\\(|execute\\s*\\(|script') AND (NOT contains(t, ';') OR (length(t) - length(replace(t, ';', '')) = 1 AND ends_with(trim(t), ';'))) AS share_ok
FROM ({_TEXTS})""")
def _guards(spark: SparkSession, d: str) -> DataFrame:
    """The guards over all texts of the history, most of them spoilt in some way."""
    q, k = F.col("sql_query"), F.length("sql_query") % 8
    t = F.when(k == 0, F.concat(q, F.lit("; DROP TABLE x"))).when(k == 1, F.concat(q, F.lit(" -- y"))).when(k == 2, F.concat(F.lit("EXEC  ("), q, F.lit(")"))).when(k == 3, F.concat(q, F.lit(" /* z */"))).when(k == 4, "DELETE FROM staging_a.t").when(k == 5, F.concat(F.lit(" "), q, F.lit(";"))).when(k == 6, "SELECT updated_at FROM STAGING_A.t").otherwise(q)
    return table(spark, d, "query_history").select("id", "load_no", scalars.query_is_safe(t).alias("query_ok"), scalars.staging_query_is_safe(t, F.lit("staging_a")).alias("staging_ok"), scalars.share_query_is_safe(t).alias("share_ok"))


# --- nested values and streams


@_case("p1_values", f"""
{_WALK} SELECT root_table, root_id, CASE WHEN enc = '$' THEN '$' ELSE enc END AS node_path, CASE WHEN enc = '$' THEN path WHEN substr(path, length(enc) + 1, 1) = '.' THEN substr(path, length(enc) + 2) ELSE substr(path, length(enc) + 1) END AS field, node ->> '$' AS value FROM walk WHERE json_type(node) NOT IN ('OBJECT', 'ARRAY', 'NULL') AND enc <> '$'""")
def _values(spark: SparkSession, d: str) -> DataFrame:
    """The fields of the flat tables' rows, one by one."""
    got = _nested(spark, d)
    return got.select("root_table", "root_id", "node_path", F.explode("fields").alias("field", "value")).where("value is not null")


@_case("stream_first_deliveries", "SELECT count(DISTINCT id) AS n FROM query_history WHERE executed_at IS NOT NULL AND id IS NOT NULL")
def _first(spark: SparkSession, d: str) -> DataFrame:
    """Each delivery once, of rows delivered in several loads; the lateness covers the whole span of the table."""
    from crosslake.streaming.ingest import first_deliveries, ingest_stream, read_table_files

    root = Scratch(spark, "stream").root
    stream = read_table_files(spark, d, "query_history").where("id is not null and executed_at is not null")
    ingest_stream(first_deliveries(stream, "id", "executed_at", "40000 days"), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table").agg(F.count(F.lit(1)).alias("n"))


@_case("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def _windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the windows that the watermark has closed."""
    from crosslake.streaming.ingest import read_table_files, windowed_counts

    root = Scratch(spark, "stream").root
    stream = read_table_files(spark, d, "events")
    q = windowed_counts(stream, "ts", ["event_type"]).writeStream.format("parquet").option("path", f"{root}/table").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/table").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
