"""Queries of the engine's own operators over the star schema, the events and the run records, with their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslake.functions import scalars
from crosslake.functions.common import table
from crosslake.operators import analytics, lineage, quality, shaping, transforms
from crosslake.plans.query_def import QueryDefinition, compile_query
from crosslake.plans.sqlexec import numbered_pages, page
from crosslake.sources import documents, export, files, staging

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SQL_NOW = "TIMESTAMP '2026-01-01 00:00:00'"


def _now() -> Column:
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


_MONEY = {"o_totalprice", "l_extendedprice", "c_acctbal"}


def _case(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- query definitions


def _resolver(spark: SparkSession, d: str) -> Callable:
    def read(ref) -> DataFrame:  # noqa: ANN001
        df = table(spark, d, ref.table)
        # money as decimals, so that sums do not depend on their order
        return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in df.columns if c in _MONEY})

    return read


def _define(name: str, definition: dict, sql: str, doubles: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = compile_query(QueryDefinition.from_dict(definition), _resolver(spark, d))
        return df.withColumns({c: F.col(c).cast("double") for c in doubles}) if doubles else df

    _case(name, sql)(run)


def _t(*names: str) -> list[dict]:
    return [{"table": n.split(" ")[0], "alias": n.split(" ")[-1]} for n in names]


def _j(left: str, right: str, kind: str = "INNER", *on: str) -> dict:
    return {"leftTable": left, "rightTable": right, "type": kind, "conditions": [dict(zip(("leftColumn", "operator", "rightColumn"), c.split(" "))) for c in on]}


def _c(*specs: str) -> list[dict]:
    """alias.column[:AGGREGATE][ name]"""
    out = []
    for s in specs:
        path, _, name = s.partition(" ")
        path, _, agg = path.partition(":")
        a, c = path.split(".")
        out.append({"tableAlias": a, "column": c} | ({"alias": name} if name else {}) | ({"aggregate": agg} if agg else {}))
    return out


def _f(spec: str, value: object = None) -> dict:
    path, op = spec.split(" ", 1)
    a, c = path.split(".")
    return {"tableAlias": a, "column": c, "operator": op, "value": value}


def _g(*paths: str) -> list[dict]:
    return [dict(zip(("tableAlias", "column"), p.split("."))) for p in paths]


def _o(*specs: str) -> list[dict]:
    return [dict(zip(("tableAlias", "column"), s.split(" ")[0].split("."))) | {"direction": s.split(" ")[1]} for s in specs]


_define(
    "xq_flagship",
    {
        "tables": _t("nation n", "customer c", "orders o"), "joins": [_j("n", "c", "INNER", "n_nationkey = c_nationkey"), _j("c", "o", "INNER", "c_custkey = o_custkey")],
        "columns": _c("n.n_name nation", "o.o_orderkey:COUNT orders", "c.c_custkey:COUNT_DISTINCT customers", "o.o_totalprice:SUM total"),
        "filters": [_f("o.o_orderstatus =", "F")], "groupBy": _g("n.n_name"), "orderBy": _o("n.n_name ASC"), "limit": 10,
    },
    "SELECT n_name AS nation, count(o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY n_name ORDER BY n_name LIMIT 10",
    ("total",),
)
for _kind in ("INNER", "LEFT", "RIGHT", "FULL"):
    _define(
        f"xq_{_kind.lower()}_join",
        {"tables": _t("supplier s", "customer c"), "joins": [_j("s", "c", _kind, "s_suppkey = c_custkey", "s_nationkey = c_nationkey")], "columns": _c("s.s_suppkey", "s.s_name", "c.c_custkey", "c.c_name")},
        f"SELECT s_suppkey, s_name, c_custkey, c_name FROM supplier {_kind} JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey",
    )
for _name, _kind, _op in (("xq_theta_text_lt", "INNER", "<"), ("xq_theta_full_gt", "FULL", ">"), ("xq_theta_text_ge", "LEFT", ">="), ("xq_theta_text_le", "INNER", "<="), ("xq_not_equal", "INNER", "!=")):
    _define(
        _name,
        {"tables": _t("nation a", "nation b"), "joins": [_j("a", "b", _kind, f"n_nationkey {_op} n_nationkey")], "columns": _c("a.n_name left_name", "b.n_name right_name")},
        f"SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a {_kind} JOIN nation b ON CAST(a.n_nationkey AS VARCHAR) {_op} CAST(b.n_nationkey AS VARCHAR)",
    )


@_case("xq_text_meets_number", "SELECT p_partkey, n_name FROM part JOIN nation ON lpad(CAST(p_size AS VARCHAR), 2, '0') = CAST(n_nationkey AS VARCHAR) UNION ALL SELECT p_partkey, n_name FROM part JOIN nation ON CAST(p_size AS VARCHAR) = CAST(n_nationkey AS VARCHAR)")
def _text_meets_number(spark: SparkSession, d: str) -> DataFrame:
    """A text column, with and without a leading zero, meets a number."""
    frames = {"padded": table(spark, d, "part").withColumn("size", F.lpad(F.col("p_size").cast("string"), 2, "0")), "plain": table(spark, d, "part").withColumn("size", F.col("p_size").cast("string")), "nation": table(spark, d, "nation")}
    one = lambda t: compile_query(QueryDefinition.from_dict({"tables": _t(f"{t} p", "nation n"), "joins": [_j("p", "n", "INNER", "size = n_nationkey")], "columns": _c("p.p_partkey", "n.n_name")}), lambda ref: frames[ref.table])
    return one("padded").unionByName(one("plain"))


_define(
    "xq_multi_condition",
    {"tables": _t("lineitem a", "lineitem b"), "joins": [_j("a", "b", "INNER", "l_orderkey = l_orderkey", "l_suppkey = l_suppkey", "l_linenumber != l_linenumber")], "columns": _c("a.l_orderkey k", "a.l_linenumber n1", "b.l_linenumber n2")},
    "SELECT a.l_orderkey AS k, a.l_linenumber AS n1, b.l_linenumber AS n2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber <> b.l_linenumber",
)
_define(
    "xq_four_way",
    {
        "tables": _t("region r", "nation n", "customer c", "orders o"), "joins": [_j("r", "n", "INNER", "r_regionkey = n_regionkey"), _j("n", "c", "INNER", "n_nationkey = c_nationkey"), _j("c", "o", "INNER", "c_custkey = o_custkey")],
        "columns": _c("r.r_name region", "o.o_orderpriority priority", "o.o_orderkey:COUNT orders", "o.o_totalprice:MAX biggest"), "groupBy": _g("r.r_name", "o.o_orderpriority"),
    },
    "SELECT r_name AS region, o_orderpriority AS priority, count(o_orderkey) AS orders, max(o_totalprice) AS biggest FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY ALL",
    ("biggest",),
)
_define(
    "xq_self_join",
    {"tables": _t("nation nation", "nation nation_1"), "joins": [_j("nation", "nation_1", "INNER", "n_regionkey = n_regionkey")], "columns": _c("nation.n_name a", "nation_1.n_name b")},
    "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey",
)
_define("xq_filter_cmp", {"tables": _t("part p"), "columns": _c("p.p_partkey", "p.p_size"), "filters": [_f("p.p_size >", "10"), _f("p.p_size <", "40"), _f("p.p_size !=", 20)]}, "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size < 40 AND p_size <> 20")
_define("xq_filter_range", {"tables": _t("orders o"), "columns": _c("o.o_orderkey", "o.o_orderdate"), "filters": [_f("o.o_orderdate >=", "1996-01-01"), _f("o.o_orderdate <=", "1996-06-30 00:00:00")]}, "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30'")
_define("xq_filter_like", {"tables": _t("part p"), "columns": _c("p.p_partkey", "p.p_name"), "filters": [_f("p.p_name LIKE", "%r%t"), _f("p.p_size LIKE", "1_")]}, "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%r%t' AND CAST(p_size AS VARCHAR) LIKE '1_'")
_define("xq_filter_in", {"tables": _t("orders o"), "columns": _c("o.o_orderkey", "o.o_orderstatus"), "filters": [_f("o.o_orderstatus IN", "F, P"), _f("o.o_custkey IN", [1, 2, 3, 5, 8, 13, 21, 34])]}, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34)")
_define(
    "xq_filter_null",
    {"tables": _t("supplier s", "customer c"), "joins": [_j("s", "c", "LEFT", "s_suppkey = c_custkey", "s_nationkey = c_nationkey")], "columns": _c("s.s_suppkey"), "filters": [_f("c.c_custkey IS NULL"), _f("s.s_name IS NOT NULL")]},
    "SELECT s_suppkey FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey WHERE c_custkey IS NULL AND s_name IS NOT NULL",
)
_define("xq_null_literal", {"tables": _t("nation n"), "columns": _c("n.n_name"), "filters": [_f("n.n_name =", None)]}, "SELECT n_name FROM nation WHERE n_name = NULL")
_define(
    "xq_aggregates",
    {"tables": _t("orders o"), "columns": _c("o.o_orderstatus status", "o.o_orderkey:COUNT n", "o.o_custkey:COUNT_DISTINCT customers", "o.o_totalprice:SUM total", "o.o_custkey:AVG mean_key", "o.o_totalprice:MIN least", "o.o_orderdate:MAX newest"), "groupBy": _g("o.o_orderstatus")},
    "SELECT o_orderstatus AS status, count(o_orderkey) AS n, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, avg(o_custkey) AS mean_key, min(o_totalprice) AS least, max(o_orderdate) AS newest FROM orders GROUP BY 1",
    ("total", "least"),
)
_define("xq_global_agg", {"tables": _t("orders o"), "columns": _c("o.o_orderkey:COUNT n", "o.o_orderstatus:MIN lo", "o.o_orderstatus:MAX hi")}, "SELECT count(o_orderkey) AS n, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders")
_define("xq_group_distinct", {"tables": _t("orders o"), "columns": _c("o.o_orderstatus", "o.o_orderpriority"), "groupBy": _g("o.o_orderstatus", "o.o_orderpriority")}, "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_define("xq_order_limit", {"tables": _t("orders o"), "columns": _c("o.o_orderkey", "o.o_totalprice"), "orderBy": _o("o.o_totalprice DESC", "o.o_orderkey ASC"), "limit": 25}, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", ("o_totalprice",))
_define(
    "xq_order_nulls",
    {"tables": _t("supplier s", "customer c"), "joins": [_j("s", "c", "LEFT", "s_suppkey = c_custkey", "s_nationkey = c_nationkey")], "columns": _c("s.s_suppkey", "c.c_name"), "orderBy": _o("c.c_name DESC", "s.s_suppkey ASC"), "limit": 40},
    "SELECT s_suppkey, c_name FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey ORDER BY c_name DESC NULLS FIRST, s_suppkey ASC NULLS LAST LIMIT 40",
)


# --- raw SQL


def _sql(name: str, spark_sql: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        from crosslake.plans.sqlexec import QueryEngine
        from crosslake.sources.registry import ConnectionRegistry

        r = ConnectionRegistry(spark)
        r.add_frames("data", lambda t: table(spark, d, t))
        return QueryEngine(spark, r).sql(spark_sql, "data")

    _case(name, sql or spark_sql)(run)


_sql("sql_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_sql("sql_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
_sql("sql_cte_union", "WITH a AS (SELECT n_name AS x FROM nation WHERE n_regionkey = 1), b AS (SELECT n_name AS x FROM nation WHERE n_regionkey = 2) SELECT x FROM a UNION ALL SELECT x FROM b UNION SELECT c_mktsegment AS x FROM customer")
_sql("sql_intersect_except", "SELECT n_regionkey AS k FROM nation INTERSECT SELECT r AS k FROM (SELECT n_nationkey AS r FROM nation) t EXCEPT SELECT 3 AS k")
_sql("sql_rollup", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("sql_date_trunc", "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' - INTERVAL '30 days' GROUP BY 1")
_sql("sql_window", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders")
_sql("sql_semi_anti", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")


@_case("sql_page_offset", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey, o_custkey LIMIT 50 OFFSET 100")
def _page(spark: SparkSession, d: str) -> DataFrame:
    return page(table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey", "o_custkey"), 50, 100)


# --- data quality


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    parts = []
    for c, t in columns.items():
        num = t in ("bigint", "int", "double")
        txt = f"CAST({c} AS VARCHAR)"
        parts.append(
            f"SELECT '{c}' AS name, '{t}' AS data_type, count(*) AS total_rows, count(*) - count({c}) AS null_count, floor((count(*) - count({c})) / count(*) * 10000 + 0.5) / 100 AS null_percent, count(DISTINCT {c}) AS distinct_count, "
            f"floor(count(DISTINCT {c}) / count(*) * 10000 + 0.5) / 100 AS distinct_percent, min({txt}) AS min, max({txt}) AS max, {f'floor(avg({c}) * 100 + 0.5) / 100' if num else 'CAST(NULL AS DOUBLE)'} AS avg, {f'floor(stddev_samp({c}) * 100 + 0.5) / 100' if num else 'CAST(NULL AS DOUBLE)'} AS stddev FROM {name}"
        )
    return " UNION ALL ".join(parts)


def _profile(name: str, columns: dict[str, str]) -> None:
    _case(f"dq_profile_{name}", _profile_sql(name, columns))(lambda spark, d: quality.profile_table(table(spark, d, name).select(*columns)))


_profile("orders", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"})
_profile("events", {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"})
_profile("query_history", {"id": "string", "connection_id": "string", "organization_id": "string", "sql_query": "string", "executed_at": "timestamp_ntz", "execution_time_ms": "int", "row_count": "int", "status": "string", "error_message": "string", "load_no": "int"})
_profile("quality_check_runs", {"id": "string", "check_id": "string", "organization_id": "string", "status": "string", "actual_value": "double", "expected_desc": "string", "error_message": "string", "duration_ms": "int", "ran_at": "timestamp_ntz", "load_no": "int"})

_CHECKS = [
    quality.QualityCheck("c1", "not_null", "connection_id", {"maxNullPercent": 5}),
    quality.QualityCheck("c2", "unique", "id"),
    quality.QualityCheck("c3", "unique", "id", {"minDistinctPercent": 95}),
    quality.QualityCheck("c4", "min_rows", None, {"minRows": 1000}),
    quality.QualityCheck("c5", "max_rows", None, {"maxRows": 10}),
    quality.QualityCheck("c6", "freshness", "executed_at", {"maxAgeHours": 24}),
    quality.QualityCheck("c7", "not_null", "status"),
]
_CHECK_SQL = f"""
WITH m AS (SELECT count(*) AS n, (count(*) - count(connection_id)) * 100.0 / count(*) AS a, count(DISTINCT id) * 100.0 / count(*) AS b, (epoch_us({SQL_NOW}) - epoch_us(max(executed_at))) / 3.6e9 AS f, (count(*) - count(status)) * 100.0 / count(*) AS s FROM query_history)
SELECT 'c1' AS check_id, CASE WHEN a <= 5 THEN 'pass' ELSE 'fail' END AS status, CAST(a AS DOUBLE) AS actual_value, 'null % <= 5' AS expected_desc FROM m
UNION ALL SELECT 'c2', CASE WHEN b >= 100 THEN 'pass' ELSE 'fail' END, CAST(b AS DOUBLE), 'distinct % >= 100' FROM m
UNION ALL SELECT 'c3', CASE WHEN b >= 95 THEN 'pass' ELSE 'fail' END, CAST(b AS DOUBLE), 'distinct % >= 95' FROM m
UNION ALL SELECT 'c4', CASE WHEN n >= 1000 THEN 'pass' ELSE 'fail' END, CAST(n AS DOUBLE), 'rows >= 1000' FROM m
UNION ALL SELECT 'c5', CASE WHEN n <= 10 THEN 'pass' ELSE 'fail' END, CAST(n AS DOUBLE), 'rows <= 10' FROM m
UNION ALL SELECT 'c6', CASE WHEN f <= 24 THEN 'pass' ELSE 'fail' END, CAST(f AS DOUBLE), 'age <= 24 hours' FROM m
UNION ALL SELECT 'c7', CASE WHEN s <= 0 THEN 'pass' ELSE 'fail' END, CAST(s AS DOUBLE), 'null % <= 0' FROM m"""


@_case("dq_suite", _CHECK_SQL)
def _suite(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_suite(table(spark, d, "query_history"), _CHECKS, _now())


@_case("dq_custom_sql", "SELECT 'c' AS check_id, CASE WHEN count(*) > 100 THEN 'pass' ELSE 'fail' END AS status, CAST(count(*) AS DOUBLE) AS actual_value, 'result gt 100' AS expected_desc FROM orders WHERE o_orderstatus = 'P'")
def _custom(spark: SparkSession, d: str) -> DataFrame:
    check = quality.QualityCheck("c", "custom_sql", None, {"sql": "SELECT count(*) FROM orders WHERE o_orderstatus = 'P'", "operator": "gt", "threshold": 100})
    return quality.custom_check(spark, check, {"orders": table(spark, d, "orders")})


# --- shaping


@_case(
    "shape_pivot",
    "WITH b AS (SELECT CAST(user_id % 50 AS VARCHAR) AS x, event_type AS grp, value, event_id FROM events), g AS (SELECT x, grp, arg_max(value, event_id) AS y FROM b GROUP BY 1, 2), xs AS (SELECT x, min(event_id) AS x_no FROM b GROUP BY 1), gs AS (SELECT grp, min(event_id) AS group_no FROM b GROUP BY 1) SELECT xs.x, gs.grp, coalesce(g.y, 0.0) AS y, x_no, group_no FROM xs CROSS JOIN gs LEFT JOIN g ON g.x = xs.x AND g.grp = gs.grp",
)
def _pivot(spark: SparkSession, d: str) -> DataFrame:
    return shaping.pivot_long(table(spark, d, "events").withColumn("u", F.col("user_id") % 50), "u", "event_type", "value", F.col("event_id"))


@_case(
    "shape_pivot_wide",
    "SELECT CAST(user_id AS VARCHAR) AS x, " + ", ".join(f"coalesce(arg_max(value, event_id) FILTER (event_type = '{e}'), 0.0) AS \"{e}\"" for e in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id",
)
def _pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    return shaping.pivot(table(spark, d, "events"), "user_id", "event_type", "value", F.col("event_id"), ["click", "error", "purchase", "signup", "view"])


_MONTH = "concat(year(ts), '-', month(ts))"
_KEYS = {"month": _MONTH, "day": f"concat({_MONTH}, '-', day(ts))", "week": f"concat({_MONTH}, ' Week ', day(ts) // 7)", "hour": f"concat({_MONTH}, '-', day(ts), ' ', hour(ts), ':00')"}
for _period, _key in _KEYS.items():
    _case(f"shape_time_{_period}", f"SELECT {_key} AS bucket, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, min(ts) AS bucket_start FROM events GROUP BY 1")(
        lambda spark, d, p=_period: shaping.time_buckets(table(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,2)")), "ts", "value", p).withColumn("value", F.col("value").cast("double"))
    )


@_case("shape_moving_avg", "SELECT event_id, floor(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) * 1000 + 0.5) / 1000 AS moving_avg FROM events")
def _moving(spark: SparkSession, d: str) -> DataFrame:
    got = shaping.moving_average(table(spark, d, "events").select("event_id", "ts", "value"), "value", ["ts", "event_id"], 7)
    return got.select("event_id", scalars.round_half_up(F.col("moving_avg"), 3).alias("moving_avg"))


@_case("shape_moving_avg_by_type", "SELECT event_id, floor(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) * 1000 + 0.5) / 1000 AS moving_avg FROM events")
def _moving_by(spark: SparkSession, d: str) -> DataFrame:
    got = shaping.moving_average(table(spark, d, "events").select("event_id", "event_type", "ts", "value"), "value", ["ts", "event_id"], 5, ["event_type"])
    return got.select("event_id", scalars.round_half_up(F.col("moving_avg"), 3).alias("moving_avg"))


@_case("shape_pie", "SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS value, count(*) * 100.0 / (SELECT count(*) FROM events) AS percent FROM events GROUP BY 1")
def _pie(spark: SparkSession, d: str) -> DataFrame:
    return shaping.name_value(table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_type", "n", descending=True)


@_case("shape_heatmap", "WITH t AS (SELECT value, event_id FROM events ORDER BY event_id LIMIT 25), n AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM t) SELECT CAST(i % 5 AS INTEGER) AS x, CAST(i // 5 AS INTEGER) AS y, value, min(value) OVER () AS min_value, max(value) OVER () AS max_value FROM n")
def _heat(spark: SparkSession, d: str) -> DataFrame:
    return shaping.heatmap(table(spark, d, "events"), "value", ["event_id"])


@_case("shape_radar", "SELECT 'p_size' AS name, max(p_size) * 1.2e0 AS max FROM part UNION ALL SELECT 'p_retailprice', max(p_retailprice) * 1.2e0 FROM part")
def _radar(spark: SparkSession, d: str) -> DataFrame:
    return shaping.radar_axes(table(spark, d, "part").select("p_name", "p_size", "p_retailprice"), 1.2)


@_case("shape_gauge", "SELECT greatest(0.0, least(100.0, value)) AS value FROM events ORDER BY event_id LIMIT 1")
def _gauge(spark: SparkSession, d: str) -> DataFrame:
    return shaping.gauge(table(spark, d, "events"), "value", ["event_id"])


@_case("shape_scatter", "SELECT CAST(user_id AS DOUBLE) AS x, coalesce(TRY_CAST(y AS DOUBLE), 0.0) AS y FROM (SELECT user_id, CASE event_type WHEN 'click' THEN props WHEN 'view' THEN CAST(value AS VARCHAR) WHEN 'error' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS y FROM events)")
def _scatter(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    y = F.when(kind == "click", F.col("props")).when(kind == "view", F.col("value").cast("string")).when(kind != "error", F.col("event_id").cast("string"))
    return shaping.scatter(table(spark, d, "events").withColumn("y", y), "user_id", "y")


@_case("shape_page", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_no, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS INTEGER) AS page_no FROM events")
def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return numbered_pages(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"]).drop("ts")


@_case(
    "shape_format_number",
    "SELECT o_orderkey, o_custkey, CASE WHEN v >= 1e9 THEN printf('%.1fB', v / 1e9) WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN v >= 1e3 THEN printf('%.1fK', v / 1e3) ELSE printf('%.0f', v) END AS label FROM (SELECT o_orderkey, o_custkey, CAST(o_orderkey * 512 AS DOUBLE) AS v FROM orders)",
)
def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", scalars.number_label(F.col("o_orderkey") * 512).alias("label"))


@_case("shape_labels", f"""
SELECT id, CASE WHEN length(sql_query) > 100 THEN substring(sql_query, 1, 100) || '...' ELSE sql_query END AS short_sql, strftime(executed_at, '%Y-%m-%d') AS day,
  CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS ago,
  CASE WHEN execution_time_ms / 1000 < 2 THEN 'good' WHEN execution_time_ms / 1000 <= 5 THEN 'fair' WHEN execution_time_ms IS NOT NULL THEN 'poor' END AS light
FROM (SELECT *, CAST(floor((epoch_ms({SQL_NOW}) - epoch_ms(executed_at)) / 60000) AS BIGINT) AS m FROM query_history WHERE executed_at < {SQL_NOW})""")
def _texts(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "query_history").where(F.col("executed_at") < _now())
    return h.select("id", scalars.shorten(F.col("sql_query")).alias("short_sql"), scalars.day_key(F.col("executed_at")).alias("day"), scalars.relative_time(F.col("executed_at"), _now()).alias("ago"), scalars.query_time_light(F.col("execution_time_ms")).alias("light"))


@_case("export_csv_lines", """
SELECT concat_ws(',', coalesce('"' || CAST(id AS VARCHAR) || '"', ''), coalesce('"' || replace(sql_query, '"', '""') || '"', ''), coalesce('"' || CAST(row_count AS VARCHAR) || '"', ''), coalesce('"' || replace(error_message, '"', '""') || '"', '')) AS value FROM query_history""")
def _csv(spark: SparkSession, d: str) -> DataFrame:
    return export.csv_lines(table(spark, d, "query_history").select("id", "sql_query", "row_count", "error_message"))


@_case("export_csv_sparse", """
SELECT concat_ws(',', id, CASE WHEN contains(sql_query, ',') OR contains(sql_query, '"') THEN '"' || replace(sql_query, '"', '""') || '"' ELSE sql_query END, coalesce(CAST(row_count AS VARCHAR), '')) AS value FROM query_history""")
def _csv_sparse(spark: SparkSession, d: str) -> DataFrame:
    return export.csv_lines(table(spark, d, "query_history").select("id", "sql_query", "row_count"), quote_all=False)


@_case("sql_text_tables", r"""
SELECT id, list_distinct_ordered AS tables, ops AS operations FROM (SELECT id,
  (SELECT string_agg(t, ',' ORDER BY p) FROM (SELECT t, min(i) AS p FROM (SELECT unnest(l) AS t, generate_subscripts(l, 1) AS i) GROUP BY t)) AS list_distinct_ordered,
  array_to_string(list_filter(['SELECT', 'WHERE', 'JOIN', 'GROUP BY', 'ORDER BY', 'LIMIT', 'HAVING'], lambda w: contains(upper(sql_query), w)), ',') AS ops
  FROM (SELECT id, sql_query, list_concat(regexp_extract_all(sql_query, '(?i)\bFROM\s+([a-zA-Z0-9_."]+)', 1), regexp_extract_all(sql_query, '(?i)\bJOIN\s+([a-zA-Z0-9_."]+)', 1)) AS l FROM query_history))""")
def _tables_of(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("sql_query")
    t = F.array_join(scalars.tables_in_sql(text), ",")
    return table(spark, d, "query_history").select("id", F.nullif(t, F.lit("")).alias("tables"), F.array_join(scalars.operations_in_sql(text), ",").alias("operations"))


# --- operational statistics


@_case("an_query_performance", f"""
SELECT coalesce(CAST(floor(avg(execution_time_ms) FILTER (status = 'success' AND execution_time_ms <> 0) + 0.5) AS BIGINT), 0) AS avg_execution_time_ms, count(*) AS total_queries, count(*) FILTER (status = 'error') AS failed_queries,
  floor(count(*) FILTER (status = 'error') * 100.0 / count(*) * 10 + 0.5) / 10 AS failure_rate, count(*) FILTER (contains(error_message, 'timeout')) AS timeout_queries
FROM query_history WHERE executed_at > {SQL_NOW} - INTERVAL 30 DAY""")
def _performance(spark: SparkSession, d: str) -> DataFrame:
    return analytics.query_performance(table(spark, d, "query_history"), _now(), 30)


@_case("an_slowest", f"""
SELECT id, CASE WHEN length(sql_query) > 100 THEN substring(sql_query, 1, 100) || '...' ELSE sql_query END AS sql_query, execution_time_ms, status, strftime(executed_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS executed_at
FROM (SELECT * FROM query_history WHERE executed_at > {SQL_NOW} - INTERVAL 7 DAY AND status = 'success' AND execution_time_ms <> 0 ORDER BY execution_time_ms DESC, executed_at DESC, id LIMIT 10)""")
def _slowest(spark: SparkSession, d: str) -> DataFrame:
    return analytics.slowest_queries(table(spark, d, "query_history"), _now(), 7)


@_case("an_queries_by_day", f"SELECT strftime(executed_at, '%Y-%m-%d') AS day, count(*) AS queries FROM query_history WHERE executed_at > {SQL_NOW} - INTERVAL 60 DAY GROUP BY 1")
def _by_day(spark: SparkSession, d: str) -> DataFrame:
    return analytics.queries_by_day(table(spark, d, "query_history"), _now(), 60)


@_case("an_connection_health", f"""
WITH h AS (SELECT connection_id, count(*) FILTER (executed_at > {SQL_NOW} - INTERVAL 30 DAY) AS n, count(*) FILTER (executed_at > {SQL_NOW} - INTERVAL 30 DAY AND status = 'error') AS bad, arg_max(status, (executed_at, id)) AS last_status, max(executed_at) AS last FROM query_history WHERE connection_id IS NOT NULL GROUP BY 1)
SELECT c.id, c.name, c.type, CASE WHEN coalesce(n, 0) = 0 THEN 'untested' WHEN bad > 5 THEN 'error' WHEN last_status = 'success' THEN 'online' ELSE 'offline' END AS status, coalesce(n, 0) AS query_count, coalesce(strftime(last, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '') AS last_used_at, coalesce(bad, 0) AS recent_errors
FROM connections c LEFT JOIN h ON h.connection_id = c.id""")
def _health(spark: SparkSession, d: str) -> DataFrame:
    return analytics.connection_health(table(spark, d, "connections"), table(spark, d, "query_history"), _now())


@_case("an_share_stats", f"""
SELECT count(*) AS total_shared_datasets, count(*) FILTER (access_level = 'public') AS public_shares, count(*) FILTER (access_level = 'organization') AS organization_shares, count(*) FILTER (access_level = 'private') AS private_shares,
  CAST(coalesce(sum(access_count), 0) AS BIGINT) AS total_api_calls, CAST(coalesce(sum(access_count) FILTER (last_accessed_at >= {SQL_NOW}), 0) AS BIGINT) AS api_calls_today FROM dataset_shares WHERE active""")
def _share_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.share_stats(table(spark, d, "dataset_shares"), _now())


@_case("an_most_accessed", "SELECT id, name, dataset_type, access_count, coalesce(strftime(last_accessed_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '') AS last_accessed_at, '' AS api_key FROM (SELECT DISTINCT * FROM dataset_shares) WHERE active AND access_count > 0 ORDER BY access_count DESC, id LIMIT 10")
def _accessed(spark: SparkSession, d: str) -> DataFrame:
    return analytics.most_accessed(table(spark, d, "dataset_shares").distinct())


@_case("an_shares_by_day", "SELECT strftime(last_accessed_at, '%Y-%m-%d') AS day, count(*) AS shares FROM dataset_shares WHERE active AND last_accessed_at IS NOT NULL GROUP BY 1")
def _shares_by_day(spark: SparkSession, d: str) -> DataFrame:
    return analytics.shares_by_day(table(spark, d, "dataset_shares"))


@_case("an_stale_shares", f"""
SELECT id, name, dataset_type AS type, coalesce(CAST(floor((epoch_ms({SQL_NOW}) - epoch_ms(last_accessed_at)) / 86400000) AS INTEGER), 999) AS days_since_last_access, coalesce(strftime(last_accessed_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', 'Never') AS last_accessed_at
FROM dataset_shares WHERE last_accessed_at IS NULL OR last_accessed_at < {SQL_NOW} - INTERVAL 30 DAY""")
def _stale(spark: SparkSession, d: str) -> DataFrame:
    return analytics.stale_shares(table(spark, d, "dataset_shares"), _now(), 30, None)


def _transformation_frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Transformations and their runs, by the pipelines and the check runs, which have the same columns."""
    t = table(spark, d, "quality_check_runs").select(F.col("check_id").alias("id")).distinct().select("id", F.concat(F.lit("check "), "id").alias("name"), F.lit("").alias("description"), F.lit("active").alias("status"), F.lit(None).cast("timestamp_ntz").alias("last_run_at"), F.lit(None).cast("string").alias("source_connection_id"), _now().alias("created_at"))
    status = F.when(F.col("status") == "pass", "success").when(F.col("status") == "fail", "failed").otherwise("timeout")
    r = table(spark, d, "quality_check_runs").select("id", F.col("check_id").alias("transformation_id"), status.alias("status"), F.col("ran_at").alias("started_at"), "error_message", F.col("duration_ms").alias("execution_time_ms"), F.lit(None).cast("bigint").alias("rows_processed"), F.col("ran_at").alias("completed_at"))
    return t, r


@_case("an_freshness", f"""
SELECT (SELECT count(*) FROM dataset_shares WHERE last_accessed_at IS NULL OR last_accessed_at < {SQL_NOW} - INTERVAL 30 DAY) AS stale_datasets,
  (SELECT count(DISTINCT check_id) FROM quality_check_runs WHERE status <> 'pass' AND ran_at > {SQL_NOW} - INTERVAL 30 DAY) AS failed_transformations,
  (SELECT floor(count(*) FILTER (status = 'pass') * 100.0 / count(*) * 10 + 0.5) / 10 FROM quality_check_runs WHERE ran_at > {SQL_NOW} - INTERVAL 30 DAY) AS success_rate, (SELECT count(DISTINCT check_id) FROM quality_check_runs) AS total_transformations""")
def _freshness(spark: SparkSession, d: str) -> DataFrame:
    return analytics.freshness_stats(table(spark, d, "dataset_shares"), *_transformation_frames(spark, d), _now())


@_case("an_failed_transformations", f"""
WITH b AS (SELECT check_id, count(*) AS failures FROM quality_check_runs WHERE status <> 'pass' AND ran_at > {SQL_NOW} - INTERVAL 30 DAY GROUP BY 1)
SELECT check_id AS id, 'check ' || check_id AS name, failures FROM b""")
def _failed(spark: SparkSession, d: str) -> DataFrame:
    return analytics.failed_transformations(*_transformation_frames(spark, d), _now()).select("id", "name", "failures")


@_case("latest_run", "SELECT * FROM (SELECT check_id, id, status, ran_at FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY ran_at DESC, id, load_no) AS rn FROM quality_check_runs) WHERE rn = 1)")
def _latest(spark: SparkSession, d: str) -> DataFrame:
    return analytics.latest_per(table(spark, d, "quality_check_runs"), ["check_id"], F.desc("ran_at"), F.col("id"), F.col("load_no")).select("check_id", "id", "status", "ran_at")


def _catalog_frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    staged = table(spark, d, "uploaded_files").select(F.col("file_id").cast("string").alias("id"), F.col("originalname").alias("table_name"), F.lit(0).alias("row_count"), F.col("uploaded_at").alias("created_at"), F.lit(None).cast("string").alias("import_job_id"))
    none = F.lit(None).cast("timestamp_ntz")
    return {
        "staged": staged, "connections": table(spark, d, "connections").distinct(),
        "transformations": table(spark, d, "notebooks").select("id", "name", "description", F.lit("active").alias("status"), none.alias("last_run_at"), "created_at").distinct(),
        "cross_queries": table(spark, d, "pipelines").select("id", "name", "description", "created_at", "updated_at").distinct(), "shares": table(spark, d, "dataset_shares"),
    }


@_case("an_catalog_union", """
WITH e AS (
  SELECT 1 AS kind_no, CAST(file_id AS VARCHAR) AS id, originalname AS name, 'Staged data from import' AS description, 'staged' AS type, originalname AS table_name, CAST(0 AS BIGINT) AS row_count, uploaded_at AS u, 'Data Import' AS source FROM uploaded_files
  UNION ALL SELECT 2, id, name, type || ' connection', 'connection', '-', 0, created_at, type || ' Database' FROM (SELECT DISTINCT * FROM connections)
  UNION ALL SELECT 3, id, name, description, 'transformation', regexp_replace(lower(name), '\\s+', '_', 'g'), 0, created_at, 'Transformation Pipeline' FROM (SELECT DISTINCT id, name, description, created_at FROM notebooks)
  UNION ALL SELECT 4, id, name, coalesce(nullif(description, ''), 'Cross-database query'), 'cross-query', '-', 0, coalesce(updated_at, created_at), 'Cross-Database Query' FROM (SELECT DISTINCT id, name, description, created_at, updated_at FROM pipelines)),
s AS (SELECT dataset_type, dataset_id, min(id) AS share_id, arg_min(access_level, (id, access_level)) AS access_level FROM dataset_shares WHERE active GROUP BY 1, 2)
SELECT kind_no, id, name, description, type, table_name, row_count, strftime(u, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS last_updated, source, share_id IS NOT NULL AS is_shared, coalesce(access_level, 'private') AS access_level, share_id
FROM e LEFT JOIN s ON e.type = s.dataset_type AND e.id = s.dataset_id""")
def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return analytics.dataset_catalog(**_catalog_frames(spark, d))


@_case("an_dashboard", f"""
SELECT (SELECT count(*) FROM uploaded_files) + (SELECT count(*) FROM (SELECT DISTINCT * FROM connections)) + (SELECT count(*) FROM (SELECT DISTINCT id, name, description, created_at FROM notebooks)) + (SELECT count(*) FROM (SELECT DISTINCT id, name, description, created_at, updated_at FROM pipelines)) AS total_datasets,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM connections)) AS active_connections, (SELECT count(*) FROM query_history WHERE executed_at > {SQL_NOW}) AS queries_today, CAST(0 AS BIGINT) AS active_api_endpoints, CAST(0 AS BIGINT) AS failed_jobs,
  (SELECT count(*) FROM (SELECT DISTINCT id, name, description, created_at FROM notebooks)) AS total_transformations""")
def _dashboard(spark: SparkSession, d: str) -> DataFrame:
    f = _catalog_frames(spark, d)
    jobs = table(spark, d, "uploaded_files").select(F.lit("completed").alias("status"))
    return analytics.dashboard_totals(f["staged"], f["connections"], f["transformations"], f["cross_queries"], table(spark, d, "query_history"), f["shares"], jobs, _now())


# --- ingestion


_TYPES = "CASE WHEN count(*) FILTER (NOT regexp_matches(v, '{n}')) = 0 THEN CASE WHEN count(*) FILTER (TRY_CAST(v AS DOUBLE) <> floor(TRY_CAST(v AS DOUBLE))) > 0 THEN 'numeric' ELSE 'integer' END WHEN count(*) FILTER (NOT lower(v) IN ('true', 'false', 'yes', 'no', '1', '0')) = 0 THEN 'boolean' WHEN count(*) FILTER (NOT regexp_matches(v, '{t}')) = 0 THEN 'timestamp' ELSE 'text' END".format(n=files.NUMBER, t=files.ISO_TIME)
_INFERRED = {"events": ("event_id", "ts", "user_id", "event_type", "value", "props"), "dataset_shares": ("id", "active", "row_count", "access_count", "created_at"), "lineitem": ("l_quantity", "l_discount", "l_linenumber", "l_shipdate")}


@_case("ing_infer_types", " UNION ALL ".join(f"SELECT '{t}.{c}' AS name, CASE WHEN count(v) = 0 THEN 'text' ELSE {_TYPES} END AS type FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {t} WHERE CAST({c} AS VARCHAR) <> '')" for t, cs in _INFERRED.items() for c in cs))
def _infer(spark: SparkSession, d: str) -> DataFrame:
    """The types of tables whose columns are all text, over all rows."""
    found = [(f"{t}.{c}", kind) for t, cs in _INFERRED.items() for c, kind in files.infer_types(table(spark, d, t).select(*[F.col(c).cast("string").alias(c) for c in cs])).items()]
    return spark.createDataFrame(found, "name string, type string")


@_case("ing_missing_errors", """
SELECT "row", "column", CAST(NULL AS VARCHAR) AS value, 'Empty cell' AS error, 'MISSING_VALUE' AS type, 'warning' AS severity, 'Fill the cell, or let the column be empty' AS suggestion FROM (
  SELECT CAST(epoch_us(executed_at) AS BIGINT) AS "row", unnest([CASE WHEN connection_id IS NULL THEN 'connection_id' END, CASE WHEN error_message IS NULL THEN 'error_message' END]) AS "column" FROM query_history) WHERE "column" IS NOT NULL""")
def _missing(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "query_history").select(F.unix_micros(F.col("executed_at").cast("timestamp")).alias("n"), "connection_id", "error_message")
    return files.error_records(h, "n")


@_case("ing_stage_append", "SELECT CAST(2 * count(*) AS BIGINT) AS n, CAST(2 * count(*) AS BIGINT) AS ids, count(DISTINCT event_type) AS kinds FROM events")
def _stage(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    job = uuid.uuid4().hex[:8]
    df = table(spark, d, "events")
    staging.stage(df, "bench", "Events 1.csv", job)
    full = staging.stage(df, "bench", "Events 1.csv", job)
    got = spark.table(full).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_staging_id").alias("ids"), F.count_distinct("event_type").alias("kinds")).collect()  # one row
    staging.drop_staging(spark, full)
    return spark.createDataFrame(got, "n bigint, ids bigint, kinds bigint")


@_case("ing_mongo_find", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND value >= 10 AND regexp_matches(props, '[02468]}') AND (user_id < 20 OR user_id % 7 = 3)")
def _find(spark: SparkSession, d: str) -> DataFrame:
    spec = {"collection": "events", "filter": {"event_type": {"$in": ["click", "view"]}, "value": {"$gte": 10}, "props": {"$regex": "[02468]}"}, "$or": [{"user_id": {"$lt": 20}}, {"user_id": {"$mod": [7, 3]}}]}, "projection": {"event_id": 1, "event_type": 1, "value": 1}, "limit": 10_000}
    return documents.mongo_query({"events": table(spark, d, "events")}, json.dumps(spec))


@_case("ing_mongo_stages", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND value >= 10 ORDER BY event_id LIMIT 500")
def _stages(spark: SparkSession, d: str) -> DataFrame:
    spec = {"collection": "events", "pipeline": [{"$match": {"event_type": {"$in": ["click", "view"]}, "value": {"$gte": 10}}}, {"$sort": {"event_id": 1}}, {"$limit": 500}, {"$project": {"event_id": 1, "event_type": 1, "value": 1}}]}
    return documents.mongo_query({"events": table(spark, d, "events")}, json.dumps(spec))


@_case("ing_mongo_group", "SELECT event_type AS _id, count(*) AS n, max(value) AS top FROM events GROUP BY 1")
def _group(spark: SparkSession, d: str) -> DataFrame:
    spec = {"collection": "events", "pipeline": [{"$group": {"_id": "$event_type", "n": {"$sum": 1}, "top": {"$max": "$value"}}}]}
    return documents.mongo_query({"events": table(spark, d, "events")}, json.dumps(spec))


@_case("ing_mongo_lookup", "SELECT r_regionkey, len(list(n_nationkey)) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _lookup(spark: SparkSession, d: str) -> DataFrame:
    spec = {"collection": "region", "pipeline": [{"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "nations"}}, {"$project": {"r_regionkey": 1, "n": {"$size": "$nations"}}}]}
    return documents.mongo_query({t: table(spark, d, t) for t in ("region", "nation")}, json.dumps(spec)).withColumn("n", F.col("n").cast("bigint"))


# --- lineage


@_case("lin_edges", """
WITH n AS (SELECT DISTINCT id FROM lineage_nodes) SELECT id, source, target FROM lineage_edges WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)""")
def _edges(spark: SparkSession, d: str) -> DataFrame:
    return lineage.connected(table(spark, d, "lineage_nodes"), table(spark, d, "lineage_edges")).select("id", "source", "target")


@_case("lin_type_filter", """
WITH n AS (SELECT DISTINCT id FROM lineage_nodes WHERE type IN ('import_job', 'transformation')) SELECT id, source, target FROM lineage_edges WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)""")
def _type_filter(spark: SparkSession, d: str) -> DataFrame:
    return lineage.of_types(table(spark, d, "lineage_nodes"), table(spark, d, "lineage_edges"), ["import_job", "transformation"])[1].select("id", "source", "target")


_GRAPH_SQL = "SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def link(name: str, a: str, x: str, b: str, y: str) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target")).withColumn("id", F.concat_ws(">", "source", "target"))

    e = link("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(link("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(link("orders", "c", "o_custkey", "o", "o_orderkey")).distinct()
    n = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    return n, e


@_case("lin_bfs_down", f"WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({_GRAPH_SQL})), w AS (SELECT 'r1' AS id, 0 AS depth UNION SELECT target, depth + 1 FROM w JOIN e ON source = id WHERE depth < 2) SELECT id, min(depth) AS depth FROM w GROUP BY 1")
def _down(spark: SparkSession, d: str) -> DataFrame:
    return lineage.subgraph(*_graph(spark, d), "r1", "downstream", 2)[0].select("id", "depth")


@_case("lin_bfs_both", f"WITH RECURSIVE e AS (SELECT source AS a, target AS b FROM ({_GRAPH_SQL}) UNION SELECT target, source FROM ({_GRAPH_SQL})), w AS (SELECT 'c7' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN e ON a = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY 1")
def _both(spark: SparkSession, d: str) -> DataFrame:
    return lineage.subgraph(*_graph(spark, d), "c7", "both", 3)[0].select("id", "depth")


# --- designed extras


@_case("ext_dedup_last", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1")
def _dedup(spark: SparkSession, d: str) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return transforms.dedup(table(spark, d, "lineitem").select(*cols), cols[:2], [F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey")], "last")


@_case("ext_upsert", """
WITH o AS (SELECT o_orderkey, min(o_custkey) AS o_custkey, 'old' AS origin FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), i AS (SELECT o_orderkey, max(o_custkey) AS o_custkey, 'new' AS origin FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM i) UNION ALL SELECT * FROM i""")
def _upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    old = o.where("o_orderstatus <> 'P'").groupBy("o_orderkey").agg(F.min("o_custkey").alias("o_custkey")).withColumn("origin", F.lit("old"))
    new = o.where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", F.lit("new").alias("origin"))
    return staging.upsert(old, new, ["o_orderkey"], [F.desc("o_custkey")])[0]


@_case("ext_validate_rules", """
SELECT id, len(list_filter([connection_id IS NULL, execution_time_ms NOT BETWEEN 1 AND 86400000, NOT regexp_matches(status, '^(success|error)$')], lambda x: x)) AS problems FROM query_history
WHERE connection_id IS NULL OR execution_time_ms NOT BETWEEN 1 AND 86400000 OR NOT regexp_matches(status, '^(success|error)$')""")
def _rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [{"column": "connection_id", "rule": "required"}, {"column": "execution_time_ms", "rule": "range", "min": 1, "max": 86_400_000}, {"column": "status", "rule": "regex", "pattern": "^(success|error)$"}]
    return transforms.validate_rows(table(spark, d, "query_history"), rules)[1].select("id", F.size("problems").cast("bigint").alias("problems"))


@_case("ext_map_convert", "SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS state, TRY_CAST(o_orderpriority AS INTEGER) AS priority, o_orderkey * 2 AS twice FROM orders WHERE contains(o_orderpriority, '-')")
def _mapped(spark: SparkSession, d: str) -> DataFrame:
    df = transforms.filter_rows(table(spark, d, "orders"), [{"column": "o_orderpriority", "operator": "contains", "value": "-"}])
    df = transforms.map_columns(df, {"o_orderkey": "order_id", "o_orderstatus": "state", "o_orderpriority": "priority"})
    df = transforms.map_values(df, "state", {"F": "filled", "O": "open"}, "other")
    return transforms.calculate(transforms.convert(df, {"priority": "int"}), {"twice": "order_id * 2"})


@_case("stream_ingest_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _stream(spark: SparkSession, d: str) -> DataFrame:
    from crosslake.functions.common import Scratch
    from crosslake.streaming.ingest import ingest_stream, read_table_files

    root = Scratch(spark, "stream").root
    q = ingest_stream(read_table_files(spark, d, "events"), f"{root}/table", f"{root}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/table").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


