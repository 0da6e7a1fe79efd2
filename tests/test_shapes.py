"""Profiles and checks, shaping, scalars, statistics, lineage, streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosslake.functions import scalars
from crosslake.operators import analytics, lineage, quality, shaping
from crosslake.plans import service_queries
from crosslake.streaming.ingest import first_deliveries, ingest_stream, read_files, windowed_counts



def now():
    return F.lit("2025-02-01 00:00:00").cast("timestamp_ntz")


def test_profile(spark):
    df = spark.createDataFrame([(1, "1000", [1]), (2, "9", None), (None, None, [1])], "n int, t string, a array<int>")
    p = {r.name: r for r in quality.profile_table(df, typed_extremes=True).collect()}
    assert (p["t"].min, p["t"].max, p["n"].null_percent, p["n"].avg, p["n"].stddev) == ("1000", "9", 33.33, 1.5, 0.71)
    assert p["a"].distinct_count == 1 and p["n"].typed_max == "2" and p["t"].avg is None
    e = quality.profile_table(df.limit(0)).collect()
    assert all(r.total_rows == 0 and r.null_percent == 0.0 for r in e)
    assert quality.profile_table(df, exact=False).count() == 3 and quality.profile_table(df, sample_rows=1).first().total_rows == 1
    wide = spark.range(3).select(*[F.col("id").alias(f"c{i}") for i in range(20)])
    assert quality.profile_table(wide).count() == 20
    with pytest.raises(ValueError):
        quality.profile_table(wide, max_columns=19)


def test_checks(spark):
    df = spark.createDataFrame([(1, dt.datetime(2025, 1, 31, 12)), (1, None), (None, None)], "id int, at timestamp_ntz")
    c = quality.QualityCheck
    runner = quality.CheckRunner({"t": df}, now())
    checks = [c("a", "not_null", "id", {"maxNullPercent": 40}), c("b", "unique", "id"), c("d", "min_rows", None, {"minRows": 4}), c("e", "freshness", "at"), c("f", "freshness", "at", {"maxAgeHours": 2}), c("g", "not_null", "nope")]
    got = {r["check_id"]: r for r in runner.run("t", checks)}
    assert {k: r["status"] for k, r in got.items()} == {"a": "pass", "b": "fail", "d": "fail", "e": "pass", "f": "fail", "g": "error"}
    assert got["e"]["actual_value"] == 12.0 and got["g"]["error_message"]
    tables = {"t_checks": df}
    op = lambda o, t: quality.custom_check(spark, c("x", "custom_sql", None, {"sql": "select count(*) from t_checks", "operator": o, "threshold": t}), tables).first().status
    assert [op("gt", 2), op("gte", 3), op("lt", 3), op("lte", 3), op("eq", 3)] == ["pass", "pass", "fail", "pass", "pass"]
    empty = quality.custom_check(spark, c("x", "custom_sql", None, {"sql": "select id from t_checks where id > 5"}), tables).first()
    assert empty.status == "fail" and empty.actual_value is None
    assert quality.check_suite(df.limit(0), checks[:2], now()).where("status = 'fail'").count() == 2
    with pytest.raises(ValueError):
        runner.run("t", [c("z", "not_null", "id", active=False)])
    with pytest.raises(ValueError):
        c("q", "what")
    assert len(runner.last_runs("a")) == 1


def test_pivot(spark):
    df = spark.createDataFrame([(1, "b", "g2", 1.0), (2, "a", "g1", 2.0), (3, "b", "g2", 5.0), (4, "a", None, None)], "o int, x string, g string, y double")
    long = {(r.x, r.grp): r.y for r in shaping.pivot_long(df, "x", "g", "y", F.col("o")).collect()}
    assert long == {("b", "g2"): 5.0, ("b", "g1"): 0.0, ("b", "null"): 0.0, ("a", "g2"): 0.0, ("a", "g1"): 2.0, ("a", "null"): 0.0}
    wide = shaping.pivot(df.where("g is not null"), "x", "g", "y", F.col("o"))
    assert wide.columns == ["x", "g2", "g1"] and [r.x for r in wide.collect()] == ["b", "a"]


def test_time_buckets(spark):
    days = [1, 6, 7, 28, 31]
    df = spark.createDataFrame([(dt.datetime(2025, 1, d, 3), 1.0) for d in days], "ts timestamp_ntz, v double")
    assert sorted((r.bucket, r.value) for r in shaping.time_buckets(df, "ts", "v", "week").collect()) == [("2025-1 Week 0", 2.0), ("2025-1 Week 1", 1.0), ("2025-1 Week 4", 2.0)]
    assert shaping.time_buckets(df, "ts", "v", "hour").first().bucket.endswith(" 3:00")
    with pytest.raises(ValueError):
        shaping.bucket_key(F.col("ts"), "year")


@pytest.mark.parametrize("window", [1, 3, 500])
def test_moving_average(spark, window):
    df = spark.range(100).select("id", (F.col("id") * 7 % 13).cast("double").alias("v")).repartition(5)
    got = {r.id: r.moving_avg for r in shaping.moving_average(df, "v", ["id"], window).collect()}
    v = [float(i * 7 % 13) for i in range(100)]
    assert got == pytest.approx({i: sum(v[max(0, i - window + 1) : i + 1]) / len(v[max(0, i - window + 1) : i + 1]) for i in range(100)})
    assert shaping.moving_average(df.limit(0), "v", ["id"], window).count() == 0


def test_moving_average_over_blocks(spark):
    df = spark.range(250_000).select("id", (F.col("id") % 11).cast("double").alias("v"))
    got = shaping.moving_average(df, "v", ["id"], 4)
    assert got.count() == 250_000
    near = {r.id: r.moving_avg for r in got.where("id between 99990 and 100010 or id between 199990 and 200010").collect()}
    assert near == pytest.approx({i: sum(j % 11 for j in range(i - 3, i + 1)) / 4 for i in near})


def test_small_shapes(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("b", 0, "5"), ("c", 1, None)], "n string, v int, t string")
    assert [r.name for r in shaping.name_value(df, "n", "v", True, True).collect()] == ["a", "c"]
    assert [tuple(r) for r in shaping.scatter(df, "v", "t").orderBy("x").collect()] == [(0.0, 5.0), (1.0, 0.0), (3.0, 0.0)]
    assert shaping.radar_series(df, ["n"], 1).first()["values"] == [3.0, 0.0] and shaping.gauge(df, "v", ["n"]).first().value == 3.0
    assert shaping.pick_columns(df) == ("n", "v") and shaping.pick_columns(df.select("n", "t")) == ("n", "t") and shaping.pick_columns(df.select("n")) == ("n", None)
    with pytest.raises(ValueError):
        shaping.radar_axes(df.select("n", "v"))
    assert shaping.match_columns(["A", "b", "z"], ["a", "B", "q"]) == {"A": "a", "b": "B"}
    one = spark.range(1).select(shaping.progress_percent(F.lit(1), F.lit(3)).alias("p"), shaping.success_percent(F.lit(3), F.lit(1)).alias("s"), shaping.progress_percent(F.lit(0), F.lit(0)).alias("z")).first()
    assert tuple(one) == (33, "66.7", 0)
    checks = spark.createDataFrame([("s", "t", "b"), ("s", "t", "a")], "schema_name string, table_name string, check_id string")
    assert shaping.checks_by_table(checks).first().checks == ["a", "b"]


def test_scalars(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    r = spark.range(1).select(
        *[scalars.number_label(F.lit(v)) for v in (999.4, 1500, 2e6, 3.14e9)], *[scalars.bytes_label(F.lit(v)) for v in (0, 512, 1536, 1048576)],
        *[scalars.relative_time(at(t), now()) for t in ("2025-01-31 23:59:30", "2025-01-31 23:55:00", "2025-01-31 20:00:00", "2025-01-20 00:00:00", None)],
        *[scalars.round_half_up(F.lit(v), 1) for v in (0.25, -0.25)], scalars.days_since(at("2025-01-30 12:00:00"), now()), scalars.days_since(at(None), now()), scalars.mask_key(F.lit("abcdefghijklmnop")), scalars.slug(F.lit("My  Name")),
        scalars.table_name_column(F.lit("9 Ä-b")), F.array_join(scalars.tables_in_sql(F.lit('select 1 from "a"."b" join c')), ","), scalars.sanitize_sql(F.lit("a -- b\n c")), scalars.failure_rate_light(F.lit(7)),
    ).first()
    assert list(r) == ["999", "1.5K", "2.0M", "3.1B", "0 B", "512 B", "1.5 KB", "1 MB", "Just now", "5m ago", "4h ago", "12d ago", "Never", 0.3, -0.2, 1, 999, "abcdefghijkl...", "my_name", "_9___b", "a.b,c", "a c", "fair"]
    assert scalars.table_name_of("2024 Sales!.csv") == "_2024_sales__csv" and scalars.needs_quoting("Ab") and not scalars.needs_quoting("a_1")


def test_statistics_of_nothing(spark):
    h = spark.createDataFrame([], "id string, connection_id string, sql_query string, executed_at timestamp_ntz, execution_time_ms int, status string, error_message string")
    r = analytics.query_performance(h, now()).first()
    assert (r.avg_execution_time_ms, r.total_queries, r.failure_rate) == (0, 0, 0.0)
    c = spark.createDataFrame([("c", "C", "mysql")], "id string, name string, type string")
    assert analytics.connection_health(c, h, now()).first().status == "untested"
    q = spark.createDataFrame([(str(i), "c", "q", dt.datetime(2025, 1, 20), 1, "error", "x") for i in range(6)], h.schema)
    assert analytics.connection_health(c, q, now()).first().status == "error"
    assert analytics.connection_health(c, q.limit(2), now()).first().status == "offline"
    assert analytics.health_totals(analytics.connection_health(c, q, now())).first().error == 1


def frames(spark):
    t, j = "timestamp_ntz", dt.datetime(2025, 1, 1)
    f = spark.createDataFrame
    return {
        "connections": f([("c1", "C", "mysql", j), ("c2", "D", "csv", j)], f"id string, name string, type string, created_at {t}"),
        "jobs": f([("j1", "f.csv", "completed", 5, "database", "database", "c2", "c1", j, j), ("j2", "g.csv", "failed", 0, "file", "staging", None, "gone", j, j)], f"id string, file_name string, status string, rows_succeeded int, source_type string, target_type string, connection_id string, source_connection_id string, created_at {t}, completed_at {t}"),
        "staged": f([("s1", "tab", 5, "j1", j), ("s2", "tab2", 1, "gone", j)], f"id string, table_name string, row_count int, import_job_id string, created_at {t}"),
        "transformations": f([("t1", "T", "active", "c1", j, j)], f"id string, name string, status string, source_connection_id string, last_run_at {t}, created_at {t}"),
        "runs": f([("r1", "t1", 3, 9, j, j), ("r2", "t1", 4, 8, j, j + dt.timedelta(1))], f"id string, transformation_id string, rows_processed int, execution_time_ms int, completed_at {t}, started_at {t}"),
        "cross_queries": f([("x1", "X", '{"tables":[{"connectionId":"c1"},{"connectionId":"c1"},{"connectionId":"zz"}]}', j), ("x2", "Y", "broken", j)], f"id string, name string, query_definition string, created_at {t}"),
        "shares": f([("h1", "H", "staged", "s1", 1, True, j), ("h2", "I", "connection", "c1", 1, True, j), ("h3", "J", "connection", "c1", 1, False, j)], f"id string, name string, dataset_type string, dataset_id string, row_count int, active boolean, created_at {t}"),
    }


def test_lineage(spark):
    nodes, edges = lineage.build_lineage(**frames(spark))
    assert nodes.count() == 2 + 2 + 2 + 1 + 2 + 2
    got = {(r.source, r.target, r.label) for r in edges.collect()}
    assert got == {
        ("connection-c1", "import_job-j1", "imports from"), ("import_job-j1", "connection-c2", "loads to"), ("import_job-j1", "staged_data-s1", "creates"), ("connection-c1", "transformation-t1", "transforms"),
        ("connection-c1", "cross_query-x1", "queries"), ("staged_data-s1", "dataset_share-h1", "shared as"), ("connection-c1", "dataset_share-h2", "shared as"),
    }
    assert edges.where("label = 'transforms'").first().metadata["rowsProcessed"] == "4"
    assert lineage.build_lineage(**frames(spark), strict_reference=True)[1].where("label = 'shared as'").count() == 1
    n, e = lineage.subgraph(nodes, edges, "import_job-j1", "downstream", 1)
    assert {r.id for r in n.collect()} == {"import_job-j1", "connection-c2", "staged_data-s1"} and e.count() == 2
    assert lineage.subgraph(nodes, edges, "import_job-j1", "upstream", 5)[0].count() == 2
    assert lineage.subgraph(nodes, edges, "nope")[0].count() == 0
    n, e = lineage.of_types(nodes, edges, ["import_job", "staged_data"])
    assert e.count() == 1
    for bad in ({"direction": "sideways"}, {"max_depth": 11}):
        with pytest.raises(ValueError):
            lineage.subgraph(nodes, edges, "x", **bad)


def test_bfs_depths(spark):
    chain = [(str(i), str(i + 1)) for i in range(5)] + [("5", "0")]
    e = spark.createDataFrame([(f"{a}{b}", a, b) for a, b in chain], "id string, source string, target string")
    n = spark.createDataFrame([(str(i),) for i in range(6)], "id string")
    assert {r.id: r.depth for r in lineage.subgraph(n, e, "0", "downstream", 2)[0].collect()} == {"0": 0, "1": 1, "2": 2}
    assert lineage.subgraph(n, e, "0", "downstream", 0)[0].count() == 4  # 0 means the default of 3
    both, edges = lineage.subgraph(n, e, "0", "both", 1)
    assert {r.id for r in both.collect()} == {"0", "1", "5"} and edges.count() == 2


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = [(i % 3, dt.datetime(2025, 1, 1, i // 60 % 24, i % 60), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, v double")
    df.write.parquet(src)
    schema = df.schema
    for _ in range(2):  # what was taken is not taken again
        ingest_stream(read_files(spark, src, schema), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 300
    df.limit(10).write.mode("append").parquet(src)
    ingest_stream(read_files(spark, src, schema), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 310
    q = windowed_counts(read_files(spark, src, schema), "ts", ["k"], value="v").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("wc").agg(F.sum("n")).first()[0] == 310
    q = first_deliveries(read_files(spark, src, schema), "v", "ts").writeStream.format("memory").queryName("fd").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fd").count() == 300


def test_streams_of_tables(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    rows = [(str(i % 40), at + dt.timedelta(days=i), 1 + i // 40) for i in range(100)] + [(None, at, 1), ("x", None, 1)]
    schema = "id string, executed_at timestamp_ntz, load_no int"
    run = service_queries.QUERIES["stream_first_deliveries"]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/folder/query_history.parquet")
    assert [tuple(r) for r in run(spark, f"{tmp_path}/folder").collect()] == [(40,)]
    spark.createDataFrame(rows[-2:], schema).coalesce(1).write.parquet(f"{tmp_path}/none/query_history.parquet")  # no row counts
    assert [tuple(r) for r in run(spark, f"{tmp_path}/none").collect()] == [(0,)]
    (tmp_path / "file").mkdir()
    part = next((tmp_path / "folder/query_history.parquet").glob("*.parquet"))
    (tmp_path / "file/query_history.parquet").write_bytes(part.read_bytes())
    n = spark.read.parquet(str(part)).where("id is not null and executed_at is not null").select("id").distinct().count()
    assert [tuple(r) for r in run(spark, f"{tmp_path}/file").collect()] == [(n,)]


def test_moving_average_cuts_series(spark, monkeypatch):
    monkeypatch.setattr(shaping, "RANGE_ROWS", 7)
    data = [(g, i, float(i * i % 11)) for g in ("a", "b", None) for i in range(40 if g == "a" else 5)]
    df = spark.createDataFrame(data, "g string, i int, v double").repartition(3)
    got = {(r.g, r.i): r.moving_avg for r in shaping.moving_average(df, "v", ["i"], 4, ["g"]).collect()}
    for g, i, _ in data:
        near = [v for h, k, v in data if h == g and i - 3 <= k <= i]
        assert got[g, i] == pytest.approx(sum(near) / len(near))
    assert len(got) == len(data)


def test_pivot_grid_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(shaping, "MOST_SERIES", 2)
    df = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 2.0, 2), (2, "a", 3.0, 3)], "x int, g string, y double, o int")
    assert sorted((r.x, r.grp, r.y) for r in shaping.pivot_long(df, "x", "g", "y", F.col("o")).collect()) == [("1", "a", 1.0), ("1", "b", 2.0), ("2", "a", 3.0), ("2", "b", 0.0)]
    with pytest.raises(ValueError):
        shaping.pivot_long(df.union(spark.createDataFrame([(1, "c", 1.0, 1)], df.schema)), "x", "g", "y", F.col("o"))
    assert shaping.pivot_long(df.limit(0), "x", "g", "y", F.col("o")).count() == 0


def test_distinct_counts_are_exact(spark):
    df = spark.createDataFrame([(0.0, b"\xff", [1], 1), (-0.0, b"\xfe", [1], 1), (None, None, None, None), (float("nan"), b"\xff", [2], 2)], "d double, b binary, a array<int>, i int")
    assert {r.name: r.distinct_count for r in quality.profile_table(df).collect()} == {"d": 2, "b": 2, "a": 2, "i": 2}
