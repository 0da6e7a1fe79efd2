"""Definitions, guards, connections, SQL execution, pipelines."""

import datetime as dt
import sqlite3
import subprocess
import sys
import textwrap
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from crosslake.model import EngineConfig
from crosslake.plans import guards
from crosslake.plans.pipeline import CycleError, Notebook, PipelineRunner, Transformations, check_steps, phases
from crosslake.plans.sharing import Shares, schema_context
from crosslake.plans.query_def import MAX_TABLES, QueryDefinition, compile_query, to_sql, validate
from crosslake.plans.sqlexec import QueryEngine, QueryTimeout, page_info, with_timeout
from crosslake.sources.registry import Connection, ConnectionRegistry, UnknownConnection, with_primary_keys
from tests.conftest import DATA, needs_data

USERS = [(1, "Alice Johnson", "alice@example.com"), (2, "Bob Smith", "bob@example.com"), (3, "Carol Williams", "carol@example.com")]
ORDERS = [(1, 1, "99.99", "completed"), (2, 1, "149.50", "completed"), (3, 2, "299.00", "pending"), (4, 3, "49.99", "completed")]


@pytest.fixture(scope="module")
def registry(spark):
    r = ConnectionRegistry(spark)
    r.add_frames("db1", {"users": spark.createDataFrame(USERS, "id int, name string, email string")})
    orders = spark.createDataFrame(ORDERS, "id int, user_id string, total string, status string").withColumn("total", F.col("total").cast("decimal(10,2)"))
    r.add_frames("db2", {"orders": orders})
    return r


def definition(**changes):
    d = {
        "tables": [{"alias": "u", "table": "users", "connectionId": "db1"}, {"alias": "o", "table": "orders", "connectionId": "db2"}],
        "joins": [{"leftTable": "u", "rightTable": "o", "type": "INNER", "conditions": [{"leftColumn": "id", "operator": "=", "rightColumn": "user_id"}]}],
        "columns": [{"tableAlias": "u", "column": "name"}, {"tableAlias": "u", "column": "email"}, {"tableAlias": "o", "column": "total"}, {"tableAlias": "o", "column": "status"}],
        "limit": 10,
    }
    return d | changes


def run(registry, d, **how):
    return compile_query(QueryDefinition.from_dict(d), registry.resolve, **how)


def test_cross_source_join(spark, registry):
    rows, result = QueryEngine(spark, registry).execute_cross(definition())
    assert len(rows) == result.row_count == 4
    assert [f["type"] for f in result.fields] == ["text", "text", "numeric", "text"]


def test_left_join_and_filter(spark, registry):
    more = registry.read("db1", "users").union(spark.createDataFrame([(4, "Dan", "d@example.com")], "id int, name string, email string"))
    registry.add_frames("db4", {"users": more})
    d = definition(columns=[{"tableAlias": "u", "column": "name"}, {"tableAlias": "o", "column": "total"}])
    d["tables"] = [{**d["tables"][0], "connectionId": "db4"}, d["tables"][1]]
    d["joins"] = [{**d["joins"][0], "type": "LEFT"}]
    assert {r.name for r in run(registry, d).where("total is null").collect()} == {"Dan"}
    f = definition(filters=[{"tableAlias": "o", "column": "status", "operator": "=", "value": "completed"}])
    assert run(registry, f).count() == 3


def test_filters_take_the_column_type(registry):
    d = definition(filters=[{"tableAlias": "u", "column": "id", "operator": ">=", "value": "2"}, {"tableAlias": "o", "column": "total", "operator": "<", "value": "100"}])
    got = run(registry, d)
    assert [r.name for r in got.collect()] == ["Carol Williams"]


@pytest.mark.parametrize(
    "change, message",
    [
        ({"columns": []}, "needs a column"),
        ({"tables": []}, "needs a table"),
        ({"joins": []}, "need joins"),
        ({"tables": [{"alias": "u", "table": "users"}] * 2}, "two tables"),
        ({"tables": [{"alias": f"t{i}", "table": "x"} for i in range(MAX_TABLES + 1)]}, "Over"),
        ({"joins": [{"leftTable": "u", "rightTable": "x", "conditions": [{"leftColumn": "id", "rightColumn": "id"}]}]}, "Unknown table alias in join"),
        ({"joins": [{"leftTable": "u", "rightTable": "o", "conditions": []}]}, "needs a condition"),
        ({"filters": [{"tableAlias": "z", "column": "a", "operator": "="}]}, "in filter"),
        ({"filters": [{"tableAlias": "u", "column": "a", "operator": "~"}]}, "filter operator"),
        ({"groupBy": [{"tableAlias": "z", "column": "a"}]}, "in group by"),
        ({"orderBy": [{"tableAlias": "z", "column": "a"}]}, "in order by"),
        ({"columns": [{"tableAlias": "u", "column": "id", "aggregate": "MEDIAN"}]}, "aggregate"),
        ({"limit": 60_000}, "limit"),
    ],
)
def test_bad_definitions(change, message):
    with pytest.raises(ValueError, match=message):
        validate(QueryDefinition.from_dict(definition(**change)))


def test_unknown_names(registry):
    with pytest.raises(UnknownConnection, match="nowhere"):
        run(registry, definition(tables=[{"alias": "u", "table": "users", "connectionId": "nowhere"}, definition()["tables"][1]]))
    with pytest.raises(ValueError, match="Unknown column"):
        run(registry, definition(columns=[{"tableAlias": "u", "column": "nope"}]))
    with pytest.raises(ValueError, match="grouped"):
        run(registry, definition(columns=[{"tableAlias": "u", "column": "id", "aggregate": "COUNT"}, {"tableAlias": "u", "column": "name"}]))


def test_pushdown_and_pruning(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id % 7 as int) as k", "cast(id as string) as name").write.parquet(f"{tmp_path}/t.parquet")
    r = ConnectionRegistry(spark)
    r.add(Connection("p", "p", "parquet", options={"path": str(tmp_path)}))
    d = QueryDefinition.from_dict({"tables": [{"alias": "t", "table": "t", "connectionId": "p"}], "columns": [{"tableAlias": "t", "column": "id"}], "filters": [{"tableAlias": "t", "column": "k", "operator": "=", "value": "3"}]})
    plan = compile_query(d, r.resolve)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan and "name" not in plan.split("ReadSchema")[1]
    assert [t.name for t in r.tables("p")] == ["t"] and r.test("p") == (True, None)
    assert [c.name for c in r.columns("p", "t")] == ["id", "k", "name"]
    assert r.scan("p", "t", columns=["id"], where="k = 3", limit=5).count() == 5
    with pytest.raises(guards.UnsafeSql):
        r.scan("p", "t", where="1=1; drop table t")
    assert dict(r.materialised("p", "t").dtypes) == {"id": "string", "k": "string", "name": "string"}


def test_equal_types_join_without_casts(spark):
    frames = {n: spark.range(5).withColumn("s", F.col("id").cast("string")) for n in "ab"}
    d = {"tables": [{"alias": n, "table": n} for n in "ab"], "columns": [{"tableAlias": "a", "column": "id"}], "joins": [{"leftTable": "a", "rightTable": "b", "conditions": [{"leftColumn": "id", "operator": "=", "rightColumn": "id"}]}]}
    plan = compile_query(QueryDefinition.from_dict(d), lambda t: frames[t.table])._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan.split("Join")[1].split("\n")[0]


def test_sql_preview_and_edits():
    d = QueryDefinition((), ()).add_table("users").add_table("users")
    assert [t.alias for t in d.tables] == ["users", "users_1"]
    d = d.add_join("users", "users_1").toggle_column("users", "na'me").select_all("users_1", ["id", "x"])
    with pytest.raises(ValueError):
        d.add_join("users_1", "users")
    text = to_sql(d)
    assert 'SELECT "users"."na\'me", "users_1"."id"' in text and "INNER JOIN" in text
    assert d.remove_table("users_1").joins == () and len(d.clear_columns("users_1").columns) == 1
    assert d.toggle_column("users", "na'me").columns[0].table_alias == "users_1"


@pytest.mark.parametrize("sql, ok", [("SELECT 1", True), ("UPDATE t SET a = 1", True), ("", False), (None, False), ("select 1 -- x", False), ("select /* x */ 1", False), ("select 1; DROP table t", False), ("exec (x)", False), ("EXECUTE x", False), ("select load_file('x')", False), ("select 1 into  outfile 'x'", False), ("select xp_cmdshell", False)])
def test_query_guard(sql, ok):
    assert guards.is_safe_query(sql) is ok


@pytest.mark.parametrize("sql, ok", [("select * from staging_a.t", True), ("delete from staging_a.t", False), ("select * from other.t", False), ("select updated_at from STAGING_A.t", True)])
def test_staging_guard(sql, ok):
    if ok:
        guards.check_staging_query(sql, "staging_a")
    else:
        with pytest.raises(guards.UnsafeSql):
            guards.check_staging_query(sql, "staging_a")


@pytest.mark.parametrize("sql, ok", [("select 1;", True), (" SELECT a", True), ("with a as (select 1) select 1", False), ("select 1; select 2", False), ("select description", False), ("select '<script>'", False), ("select 1 -- x", False), ("", False)])
def test_share_guard(sql, ok):
    if ok:
        guards.check_share_query(sql)
    else:
        with pytest.raises(guards.UnsafeSql):
            guards.check_share_query(sql)


def test_generated_guard():
    c = EngineConfig()
    v = guards.validate_generated("SELECT a FROM t", c)
    assert v.is_valid and "10000" in v.warnings[0]
    assert guards.validate_generated("WITH x AS (SELECT 1) SELECT * FROM x LIMIT 20000", c).warnings[0].startswith("LIMIT 20000 is above")
    for bad in ("DROP TABLE t", "DELETE FROM t", "SELECT 1; SELECT 2", "MERGE x", "SELECT 1 -- OR 1=1", "SELECT 1; DELETE FROM t", "GRANT a"):
        assert not guards.validate_generated(bad, c).is_valid, bad
    assert guards.validate_generated("DROP TABLE t", EngineConfig(sql_validation_enabled=False)).is_valid
    assert guards.add_limit("select 1;", 5) == "select 1 LIMIT 5;" and guards.add_limit("select 1 limit 3", 5) == "select 1 limit 3" and guards.add_limit("delete x", 5) == "delete x"
    assert guards.sanitize("select 1 -- x\n /* y */ +  2") == "select 1 + 2"
    assert guards.tables_in('select * from "A".b join c on 1=1 join a.b') == ["A.b", "c", "a.b"]
    assert guards.operations_in("select a from b where c group by d") == ["SELECT", "WHERE", "GROUP BY"]
    assert guards.sql_from_answer("Sure:\n```sql\nSELECT 1\n```\nREASONING: one") == ("SELECT 1", "one")
    assert guards.sql_from_answer("the query is SELECT 2") == ("SELECT 2", None)


def test_execute_history_cache(spark, registry):
    e = QueryEngine(spark, registry, config=EngineConfig(max_rows_limit=2))
    rows, result = e.execute("SELECT * FROM users ORDER BY id", "db1", cache=True, count_all=True)
    assert len(rows) == 2 and result.row_count == 3
    assert e.cached(e.history[0].id).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        e.execute("SELECT nope FROM users", "db1")
    assert [h.status for h in e.history] == ["success", "error"] and e.history_frame().count() == 2
    with pytest.raises(UnknownConnection):
        e.execute("SELECT 1", "nowhere")
    with pytest.raises(guards.UnsafeSql):
        e.sql("select 1; drop table x")
    assert e.shared("SELECT id FROM users ORDER BY id", "db1", 1, 1).first().id == 2
    assert e.history_page(1)[1] == 3
    df, v = e.generated("SELECT id FROM users", "db1")
    assert df.count() == 2 and v.is_valid
    assert page_info(250) == [(0, 0, 100), (1, 100, 200), (2, 200, 250)] and page_info(0) == []
    saved = e.save_cross("x", definition())
    assert e.run_saved(saved).count() == 4
    with pytest.raises(KeyError):
        QueryEngine(spark, registry, "other").run_saved(saved)


def test_texts_see_their_own_tables(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    r = ConnectionRegistry(spark)
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    r.add_frames("c1", {"secret": frame(1), "t": frame(10), "u": frame(7)}, "org1")
    r.add_frames("c2", {"t": frame(20, 21)}, "org2")
    one, two = QueryEngine(spark, r, "org1"), QueryEngine(spark, r, "org2")
    assert one.sql("SELECT x FROM secret", "c1").first().x == 1
    for text in ("SELECT * FROM secret", "WITH secret AS (SELECT 2 AS x) SELECT * FROM (SELECT * FROM t) a, (WITH b AS (SELECT 1) SELECT * FROM b) c, gone", "SELECT * FROM (WITH secret AS (SELECT 3 AS x) SELECT * FROM secret) a, secret", "SELECT * FROM t WHERE x IN (SELECT x FROM secret)"):
        with pytest.raises(ValueError, match="Unknown table"):
            two.sql(text, "c2")
    with pytest.raises(UnknownConnection):
        two.sql("SELECT 1", "c1")
    assert two.sql("WITH secret AS (SELECT 5 AS x) SELECT secret.x FROM secret JOIN t ON t.x > secret.x", "c2").count() == 2
    assert one.sql("SELECT t.x + u.x AS s FROM t, u WHERE EXISTS (SELECT 1 FROM secret s WHERE s.x < t.x) AND t.x > (SELECT max(secret.x) FROM secret)", "c1").first().s == 17
    assert one.sql("TABLE t", "c1").first().x == 10
    lazy = [(one.sql("SELECT sum(x) AS s FROM t", "c1"), two.sql("SELECT sum(x) AS s FROM t", "c2")) for _ in range(3)]
    with ThreadPoolExecutor(6) as pool:
        assert list(pool.map(lambda d: d.first().s, [x for p in lazy for x in p])) == [10, 41] * 3
        assert [x.x for x in pool.map(lambda e: e[0].sql("SELECT max(x) AS x FROM t", e[1]).first(), [(one, "c1"), (two, "c2")] * 5)] == [10, 21] * 5
    assert not any(t.name.startswith("bound_") for t in spark.catalog.listTables())
    for text in ("SELECT * FROM text.`/etc/hostname`", "DROP TABLE t", "INSERT INTO t SELECT 1", "SHOW TABLES", "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SELECT * FROM IDENTIFIER('t')"):
        with pytest.raises(ValueError):
            one.sql(text, "c1")
    with pytest.raises(UnknownConnection):
        two.cross_query({"tables": [{"alias": "t", "table": "t", "connectionId": "c1"}], "columns": [{"tableAlias": "t", "column": "x"}]})
    r.add(Connection("f", "f", "parquet", "org1", {"path": f"{tmp_path}/own"}))
    spark.range(3).write.parquet(f"{tmp_path}/other.parquet")
    for name in ("../other", "`../other`"):
        with pytest.raises(ValueError):
            one.sql(f"SELECT * FROM `{name.strip('`')}`", "f")


def test_staging_of_others(spark):
    from crosslake.sources.staging import drop_staging, stage

    r = ConnectionRegistry(spark)
    full = stage(spark.createDataFrame([(1, 2, 3)], "`a b` int, a_b int, _staging_id int"), "orgA", "t", "j1")
    name = full.split(".")[1]
    assert spark.table(full).columns == ["_staging_id", "a_b", "a_b_2", "_staging_id_2"]
    one, two = QueryEngine(spark, r, "orgA"), QueryEngine(spark, r, "orgB")
    assert one.sql(f"SELECT * FROM {name}").count() == one.staging(f"SELECT * FROM {full}", "staging_orga").count() == one.sql(f"SELECT * FROM {full}", "staging").count() == 1
    for text in (f"SELECT * FROM {name}", f"SELECT * FROM {full}"):
        with pytest.raises(ValueError):
            two.sql(text)
    with pytest.raises(guards.UnsafeSql):
        two.staging(f"SELECT * FROM {full}", "staging_orga")
    with pytest.raises(ValueError):
        two.cross_query({"tables": [{"alias": "t", "table": name, "schema": "staging_orga", "connectionId": "staging"}], "columns": [{"tableAlias": "t", "column": "a_b"}]})
    drop_staging(spark, full)


def test_truncated_results(spark, registry):
    e = QueryEngine(spark, registry, config=EngineConfig(max_rows_limit=2, cross_query_cap=3))
    assert [e.execute(f"SELECT id FROM users WHERE id <= {n}", "db1")[1].truncated for n in (2, 3)] == [False, True]
    rows, result = e.execute_cross(definition())
    assert (len(rows), result.row_count, result.truncated, result.df.count()) == (3, 3, True, 3)
    assert e.sql("SELECT id FROM users", "db1").count() == 3  # the way without a cap


def test_document_texts(spark, registry):
    e = QueryEngine(spark, registry)
    assert e.sql('{"collection": "users", "filter": {"id": {"$gt": 1}}, "projection": {"name": 1}}', "db1").columns == ["name"]
    with pytest.raises(ValueError, match="Unknown collection"):
        e.sql('{"collection": "orders"}', "db1")


def test_timeout_cancels(spark):
    began = time.time()
    with pytest.raises(QueryTimeout):
        with_timeout(spark, 1, lambda: spark.range(0, 10**13, 1, 4).selectExpr("sum(hash(id) % 7)").collect())
    assert time.time() - began < 20
    deadline = time.time() + 20
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < deadline:
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_phases():
    assert phases([], []) == []
    assert phases(["a"], []) == [["a"]]
    assert phases(list("abcd"), [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]) == [["a"], ["b", "c"], ["d"]]
    assert phases(list("ab"), [("x", "b"), ("b", "y")]) == [["a", "b"]]
    with pytest.raises(CycleError):
        phases(list("abc"), [("b", "c"), ("c", "b")])


def test_pipeline(spark, registry, tmp_path):
    t = Transformations(QueryEngine(spark, registry))
    good = t.create("names", "SELECT name FROM users WHERE id < 3", connection_id="db1")
    bad = t.create("bad", "SELECT nope FROM users", connection_id="db1")
    saved = t.engine.save_cross("x", definition())
    step = lambda i, k, **c: {"id": i, "type": k, "config": c}
    d = {
        "steps": [step("in", "ingest", sourceConnectionId="db1", sourceTable="users"), step("t", "transform", transformationId=good.id), step("x", "cross-query", savedCrossQueryId=saved), step("out", "export", savedCrossQueryId=saved, path=f"{tmp_path}/out")],
        "edges": [{"source": "in", "target": "t"}, {"source": "t", "target": "x"}, {"source": "x", "target": "out"}],
    }
    run_ = PipelineRunner(t).run(d)
    assert run_.status == "success" and [run_.step_results[s].rows_processed for s in ("in", "t", "x", "out")] == [3, 2, 4, 4]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    d["steps"][1] = step("t", "transform", transformationId=bad.id)
    run_ = PipelineRunner(t).run(d)
    assert run_.status == "partial" and run_.step_results["x"].status == "pending" and "nope" in run_.step_results["t"].error
    assert PipelineRunner(t).run(d, stop_on_error=False).step_results["out"].status == "success"
    assert check_steps({"steps": [step("a", "transform"), step("b", "dance")]}) == ["a: transformationId is required", "b: unknown type dance"]
    assert [r.status for r in t.run_page(bad.id)][0] == "failed" and t.list("active") == [good, bad]
    t.pause(good.id)
    with pytest.raises(ValueError, match="paused"):
        t.run(good.id)
    t.resume(good.id)
    assert t.result(t.run(good.id).id).count() == 2
    with pytest.raises(ValueError):
        t.create("x", "  ")
    t.delete(bad.id)
    with pytest.raises(KeyError):
        t.get(bad.id)


def test_steps_are_not_capped(spark, registry, tmp_path):
    t = Transformations(QueryEngine(spark, registry, config=EngineConfig(cross_query_cap=2, max_rows_limit=2)))
    saved = t.engine.save_cross("x", definition())
    cut, whole = (t.create(n, f"SELECT name FROM users WHERE id < {n}", connection_id="db1") for n in ("4", "3"))
    step = lambda i, k, **c: {"id": i, "type": k, "config": c}
    r = PipelineRunner(t).run({"steps": [step("x", "cross-query", savedCrossQueryId=saved), step("out", "export", savedCrossQueryId=saved, path=f"{tmp_path}/out"), step("cut", "transform", transformationId=cut.id), step("whole", "transform", transformationId=whole.id)]})
    assert {s: (x.rows_processed, x.truncated) for s, x in r.step_results.items()} == {"x": (4, False), "out": (4, False), "cut": (2, True), "whole": (2, False)}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4 and t.engine.run_saved(saved).count() == 2
    assert [x.truncated for x in t.run_page(cut.id)] == [True]


def test_notebook(spark, registry):
    n = Notebook("n", "n", [{"id": "b", "type": "sql", "content": "SELECT id FROM users ", "connectionId": "db1", "order": 2}, {"id": "a", "type": "markdown", "content": "x", "order": 0}, {"id": "c", "type": "sql", "content": "SELECT 1 AS one", "order": 1}])
    e = QueryEngine(spark, registry)
    assert n.execute(e, "b").count() == 3
    with pytest.raises(ValueError):
        n.execute(e, "a")
    t = Transformations(e)
    made = n.save_as_transformation(t, "both")
    assert made.sql_query == "SELECT 1 AS one;\n\nSELECT id FROM users"
    assert t.run(made.id).rows_processed == 3


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/s.db"
    with sqlite3.connect(path) as c:
        c.execute("create table t (id integer primary key, name text not null, v real default 1.5, b blob)")
        c.executemany("insert into t values (?, ?, ?, ?)", [(i, f"n{i}", None if i % 3 else i / 2, b"x") for i in range(100)])
        c.execute("insert into t values (1000, 'odd', 'text', null)")
        c.execute("create view w as select name from t")
    r = ConnectionRegistry(spark)
    r.add(Connection("s", "s", "sqlite", options={"path": path}))
    df = r.read("s", "t")
    assert df.count() == 101 and df.select("id").distinct().count() == 101 and df.rdd.getNumPartitions() > 1
    assert df.where("id = 1000").first().v is None
    assert r.read("s", "", query="select name, count(*) as n from t group by 1").count() == 101
    assert r.read("s", "w").count() == 101
    assert [(t.name, t.type) for t in r.tables("s")] == [("t", "table"), ("w", "view")]
    cols = r.columns("s", "t")
    assert cols[0].is_primary_key and not cols[1].nullable and cols[2].default == "1.5"
    assert r.test("s")[0] and not r.test("nowhere")[0]
    e = QueryEngine(spark, r)
    assert e.sql("SELECT name, ifnull(v, -1) AS v FROM t ORDER BY rowid DESC LIMIT 2 -- own words".split(" --")[0], "s").count() == 2
    assert e.sql("SELECT count(*) AS n FROM t", "s", native=False).first().n == 101
    with pytest.raises(guards.UnsafeSql):
        e.sql("DELETE FROM t", "s")


def test_jdbc(spark):
    from crosslake.sources.staging import insert_database

    opts = {"url": "jdbc:derby:memory:shop;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "d"), (3, "d")], "id int, name string")
    bad = insert_database(df, opts, "items", required=["name"], unique=["id"])
    assert sorted(r.error for r in bad.collect()) == ["duplicate key (id)", "null value in column name"]
    r = ConnectionRegistry(spark)
    r.add(Connection("d", "d", "derby", options=opts))
    assert r.read("d", "items").where("id > 1").count() == 1
    assert r.test("d") == (True, None)
    insert_database(spark.range(4, 400).selectExpr("cast(id as int) as id", "'n' as name"), opts, "items")
    r.add(Connection("p", "p", "derby", options=opts | {"partitionColumn": "id", "numPartitions": "4"}))
    assert r.read("p", "items").rdd.getNumPartitions() == 4 and r.read("p", "items").count() == r.read("d", "items").count() == 398
    assert QueryEngine(spark, r).sql("SELECT count(*) AS n FROM items FETCH FIRST 1 ROWS ONLY", "p").first()[0] == 398  # the database's own words


_CLUSTER = """
import datetime as dt
import decimal
import sys

from crosslake.plans import service_queries
from crosslake.session import get_session
from crosslake.sources import embedded, staging

tmp, data = sys.argv[1:]
spark = get_session("cluster", "local-cluster[2,1,1024]", **{"spark.checkpoint.dir": f"file://{tmp}/shared", "spark.sql.warehouse.dir": f"{tmp}/warehouse", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "3", "spark.driver.extraJavaOptions": f"-Dderby.system.home={tmp}"})
spark.sparkContext.setLogLevel("OFF")
"""


def _on_cluster(tmp_path, body: str) -> None:
    """Runs a text in a session whose executors are processes of their own."""
    out = subprocess.run([sys.executable, "-c", _CLUSTER + textwrap.dedent(body), str(tmp_path), DATA], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-3000:]


@needs_data
def test_embedded_database_on_a_cluster(tmp_path):
    _on_cluster(tmp_path, """
        got = service_queries.QUERIES["src_jdbc"](spark, data).collect()
        n = spark.read.parquet(f"{data}/nation.parquet")
        assert sorted(map(tuple, got)) == sorted(map(tuple, n.selectExpr("n_regionkey", "n_name").groupBy("n_regionkey").agg({"*": "count", "n_name": "max"}).select("n_regionkey", "count(1)", "max(n_name)").collect())), got
        embedded.CHUNK = 7
        rows = [(i, i * 2**40, None if i % 3 else "a'b", decimal.Decimal(i) / 4, i / 8, i % 2 == 0, dt.datetime(2024, 1, 1, 0, 0, i), dt.datetime(1999, 12, 31, 23, 59, i, 5000), dt.date(2024, 2, i + 1), b"x%d" % i) for i in range(25)]
        schema = "i int, l bigint, s string, d decimal(10,2), f double, b boolean, t timestamp, n timestamp_ntz, day date, x binary"
        opts = {"url": "jdbc:derby:memory:kinds;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
        df = spark.createDataFrame(rows, schema)
        staging.insert_database(df, opts, "kinds")
        staging.insert_database(df.limit(0), opts, "kinds")
        back = embedded.read(spark, opts, query="select * from kinds")
        assert sorted(map(tuple, back.withColumn("n", back["n"].cast("timestamp_ntz")).collect())) == rows
        assert embedded.read(spark, opts, query="select * from kinds where 1 = 0").collect() == []
        spark.stop()
    """)


@needs_data
def test_embedded_table_in_ranges_on_a_cluster(tmp_path):
    _on_cluster(tmp_path, """
        got = service_queries.QUERIES["src_jdbc_ranges"](spark, data).collect()
        n = spark.read.parquet(f"{data}/nation.parquet").where("n_nationkey >= 5").select("n_nationkey", "n_name")
        assert len(got) == 20 and sorted(map(tuple, got)) == sorted(map(tuple, n.collect())), got
        embedded.CHUNK = 100
        r, _ = service_queries._derby(spark, spark.range(1000).selectExpr("id AS n_nationkey", "if(id % 10 = 0, null, 'x' || id) AS n_name"))
        assert r.test("db") == (True, None)
        assert r.read("db", "items").agg({"n_nationkey": "sum", "n_name": "count", "*": "count"}).select("sum(n_nationkey)", "count(n_name)", "count(1)").first() == (499500, 900, 1000)
        spark.stop()
    """)


def test_primary_keys(spark):
    cols = spark.createDataFrame([("s", "t", "a"), ("s", "t", "b"), ("s", "u", "a")], "table_schema string, table_name string, column_name string")
    keys = spark.createDataFrame([("s", "t", "a"), ("s", "t", "a")], cols.schema)
    assert {(r.table_name, r.column_name): r.is_primary_key for r in with_primary_keys(cols, keys).collect()} == {("t", "a"): True, ("t", "b"): False, ("u", "a"): False}


def test_shares(spark, registry):
    e = QueryEngine(spark, registry)
    t = Transformations(e)
    made = t.create("x", "SELECT id FROM users", connection_id="db1")
    shares = Shares(e, t)
    c = shares.create("c", "connection", "db1", "public", "users")
    assert shares.data(c.api_key).count() == 3 and shares.data(c.share_token, 1, 2).count() == 1
    assert shares.query(c.api_key, "SELECT name FROM users ORDER BY name", 1).first().name == "Alice Johnson"
    assert c.access_count == 3 and c.last_accessed_at is not None
    with pytest.raises(guards.UnsafeSql):
        shares.query(c.api_key, "DELETE FROM users")
    x = shares.create("t", "transformation", made.id)
    with pytest.raises(LookupError):
        shares.data(x.api_key)
    t.run(made.id)
    assert shares.data(x.api_key).count() == 3
    with pytest.raises(ValueError, match="not supported"):
        shares.query(x.api_key, "SELECT 1")
    q = shares.create("q", "cross-query", e.save_cross("x", definition()))
    assert shares.data(q.api_key).count() == 4
    shares.revoke(c.id)
    for key in (c.api_key, "", None):
        with pytest.raises(PermissionError):
            shares.open(key)
    with pytest.raises(ValueError):
        shares.create("z", "dance", "1")
    assert schema_context(e, "db1") == "users(id int, name string, email string)"


def test_registry_scoping(spark):
    r = ConnectionRegistry(spark)
    r.add(Connection("a", "A", "postgresql", "org1", {"host": "h", "database": "d"}))
    assert r._jdbc(r.get("a"))["url"] == "jdbc:postgresql://h:5432/d"
    with pytest.raises(UnknownConnection):
        r.get("a", "org2")
    with pytest.raises(ValueError):
        r.add(Connection("b", "B", "oracle8"))
    assert len(r.list("org1")) == 1
    r.remove("a")
    assert r.list() == []


def test_ship_and_scratch(spark):
    from crosslake.functions.common import Scratch, ship

    ship(spark)
    ship(spark)
    assert sum("crosslake" in f for f in spark.sparkContext.listFiles) == 1
    s = Scratch(spark, "t")
    a, b = s.write(spark.range(5).toDF("id")), s.write(spark.range(3).toDF("id"))
    s.drop(a)
    assert b.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        a.count()


def test_clock_is_injectable(spark, registry):
    e = QueryEngine(spark, registry, clock=lambda: dt.datetime(2025, 1, 1))
    e.execute("SELECT 1 AS x")
    assert e.history[0].executed_at == dt.datetime(2025, 1, 1)


def test_schedules(spark):
    from crosslake.plans.pipeline import cron_numbers, is_due, next_run

    assert cron_numbers("*/20", 0, 59) == {0, 20, 40} and cron_numbers("1-3,7", 0, 59) == {1, 2, 3, 7} and cron_numbers("5/30", 0, 59) == {5, 35}
    for bad in ("61", "3-1", "*/0", "x"):
        with pytest.raises(ValueError):
            cron_numbers(bad, 0, 59)
    at = dt.datetime(2026, 1, 1, 10, 40, 30)  # a Thursday
    assert next_run("40 1 * * *", at) == dt.datetime(2026, 1, 2, 1, 40) and next_run("41 10 * * *", at) == dt.datetime(2026, 1, 1, 10, 41)
    assert next_run("0 0 31 2 *", at) is None and next_run("0 6 * * 0", at) == next_run("0 6 * * 7", at) == dt.datetime(2026, 1, 4, 6)
    assert next_run("0 0 13 * 5", at) == dt.datetime(2026, 1, 2)  # a day or a weekday
    texts = ["*/7 3-5 * * *", "0 6 * * 7", "0 0 13 * 5", "5/30 */6 1,15 * *", "* * * 2 1-3", None, "", "a b c d e", "1 2 3", "61 * * * *"]
    moments = [dt.datetime(2026, 2, day, h, m) for day in (1, 2, 13, 15) for h in (0, 4, 6, 12) for m in (0, 5, 7, 35)]
    df = spark.createDataFrame([(t, x) for t in texts for x in moments], "s string, at timestamp_ntz")
    got = {(r.s, r.at): r.due for r in df.select("s", "at", is_due(F.col("s"), F.col("at")).alias("due")).collect()}
    for t in texts[:5]:
        for x in moments:
            assert got[t, x] == (next_run(t, x - dt.timedelta(minutes=1)) == x), (t, x)
    assert not any(got[t, x] for t in texts[5:] for x in moments)


def test_phases_of_all(spark):
    from crosslake.plans.pipeline import phases_of_all

    steps = spark.createDataFrame([("p", "A "), ("p", "b"), ("p", "c"), ("q", "x"), ("q", "y"), ("q", "z"), ("r", None), (None, "s")], "pipeline_id string, step_id string")
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "a", "b"), ("p", "b", "C"), ("p", "gone", "a"), ("q", "x", "y"), ("q", "y", "x"), ("q", "y", "z")], "pipeline_id string, source string, target string")
    assert {(r.pipeline_id, r.step_id): r.phase for r in phases_of_all(steps, edges).collect()} == {("p", "A "): 0, ("p", "b"): 1, ("p", "c"): 2, ("q", "x"): None, ("q", "y"): None, ("q", "z"): None}
    assert phases_of_all(steps.limit(0), edges).count() == 0


def test_listings(spark, monkeypatch):
    r = ConnectionRegistry(spark)
    for c in (Connection("ch", "c", "clickhouse"), Connection("bq", "b", "bigquery", options={"dataset": "d"}), Connection("mo", "m", "mongodb", options={"collections": "a, b", "database": "x"})):
        r.add(c)
    asked = {}

    def read(id_, table, schema=None, query=None, organization_id=None):
        asked[id_] = query
        if query and "system.columns" in query:
            return spark.createDataFrame([("k", "Int64", "", 1), ("v", "Nullable(String)", "'x'", 0)], "name string, type string, default_expression string, is_in_primary_key int")
        if query and "system.tables" in query:
            return spark.createDataFrame([("d", "t", "MergeTree"), ("d", "v", "MaterializedView"), ("e", "u", "Log")], "database string, name string, engine string")
        return spark.createDataFrame([("t", "BASE TABLE"), ("w", "VIEW")], "table_name string, table_type string")

    monkeypatch.setattr(r, "read", read)
    assert [(t.name, t.type) for t in r.tables("ch", "d")] == [("t", "table"), ("v", "view")]
    assert [(c.name, c.nullable, c.default, c.is_primary_key) for c in r.columns("ch", "t")] == [("k", False, None, True), ("v", True, "'x'", False)]
    assert [(t.schema, t.name, t.type) for t in r.tables("bq")] == [("d", "t", "table"), ("d", "w", "view")] and "`d`.INFORMATION_SCHEMA" in asked["bq"]
    assert [t.name for t in r.tables("mo")] == ["a", "b"] and [c.type for c in r.columns("mo", "a")] == ["string", "string"]
    assert r.test("bq") == (True, None) and r.test("mo")[0]
    monkeypatch.undo()
    assert not r.test("bq")[0] and not r.test("mo")[0]  # no connector here
