"""The record operators against plain Python, on tables with everything that can be odd about them."""

import datetime as dt
import json
import random
import statistics

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crosslake.operators.bad_records import failing_records, sound_records
from crosslake.operators.hierarchy import descendants, hierarchies
from crosslake.operators.load_profile import agreed_profiles, all_columns, column_states, control_limits, departures, distribution_shifts, merge_states, profiles
from crosslake.operators.nested import flatten_nested, flatten_texts
from crosslake.operators.orphans import key_of, orphan_references
from crosslake.plans import record_queries
from tests import brute
from tests.conftest import DATA, needs_data

T0 = dt.datetime(2025, 1, 1)


def rows(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def found(spark, name):
    from crosslake.plans.record_queries import QUERIES

    return sorted((tuple(r) for r in QUERIES[name](spark, DATA).collect()), key=str)


# --- 1

ODD = [
    None, "", "{}", "[]", "[{}]", "3", "nul", "01", "-", "1.5e+3", '"x"', '{"a":1}x', '{"a":1,}', "[1,]", "[,1]", "[1 2]", '{"a" 1}', '{"a":tru}', '{"a":NaN}', "\\", '"\\', '"abc\\"', "[}", "{]", "[[]", "[]]", "][",
    '{"a":[{"b":[1,{"c":2}]},3,null,{"d":{}}]}', '{"a":"\\u00e9\\n\\"[{"}', '{"a":"\\x"}', '{"a":"\\u12g4"}', '{"a":[{"a":1}],"a":[{"b":[{}]}]}', "[[{}],[[{}]]]", '{"config":"{\\"x\\":[{\\"y\\":1}]}"}', '{"config":"[1]"}',
    '{"config":"oops"}', '{"config":"{\\"config\\":\\"{\\\\\\"k\\\\\\":[{}]}\\"}"}', '{"k\\"ey":[{}]}', ' \t{"a": [ {} ] }\r\n', '{"a":"x\ty"}', '{"":[{"":1}]}', '{"a.b":[{}]}', '{"é":["é",{"ü":[{}]}]}', '{"a":"\\ud800"}',
]


def flat(texts):
    t = flatten_texts(pa.array(texts, pa.string())).to_pydict()
    got = [[] for _ in texts]
    for r, p, n in zip(t["row"], t["parent_path"], t["node_path"]):
        if p is not None:
            got[r].append((p, n))
    return got, {r for r, p in zip(t["row"], t["parent_path"]) if p is None}


def check_flat(texts):
    got, readable = flat(texts)
    for i, s in enumerate(texts):
        ok = s is not None and (brute.parse(s) is not None or s.strip() == "null")
        assert ok == (i in readable), s
        assert sorted(got[i]) == sorted(brute.nested(s) if ok else []), s


def test_flatten_odd_texts():
    check_flat(ODD)
    check_flat(['"abc\\', '{"a":[{}]}', "\\", '"x"'])  # a broken text leaves its neighbour alone
    check_flat([])


def test_flatten_broken_texts():
    r = random.Random(3)
    base = [x for x in ODD if x]
    texts = []
    for _ in range(2000):
        s = list(r.choice(base) + r.choice(["", r.choice(base)]))
        for _ in range(r.randint(0, 3)):
            if s:
                s[r.randrange(len(s))] = r.choice('{}[],:"\\ a1')
        texts.append("".join(s))
    check_flat(texts)


_json = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["a", "b", "config", "ö", 'q"']), x, max_size=4), max_leaves=20)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_json, max_size=5))
def test_flatten_any_json(docs):
    check_flat([json.dumps(d) for d in docs])


def test_flatten_deep_and_long():
    check_flat(["[" * 400 + "{}" + "]" * 400, json.dumps([{"t": "x" * 300_000, "l": list(range(20_000))}] * 3), "[" * 1000])


def test_flatten_fields(spark):
    doc = '{"m":{"v":1},"s":[{"id":"a\\n","p":{"x":1.5},"t":["u",null],"c":[{"id":true}]}]}'
    df = spark.createDataFrame([("i", doc, "clash"), ("j", None, "x"), (None, doc, "y")], "id string, j string, node_path string")
    got = {r.node_path: r for r in flatten_nested(df, "id", "j", include_root=True).collect()}
    assert got["$"].fields == {"m.v": "1"}
    assert got["s[0]"].fields == {"id": "a\n", "p.x": "1.5", "t[0]": "u", "t[1]": None}
    assert (got["s[0].c[0]"].fields, got["s[0].c[0]"].parent_path, got["s[0].c[0]"].table_path) == ({"id": "true"}, "s[0]", "s[].c[]")
    assert len(got) == 3
    assert flatten_nested(df.limit(0), "id", "j").count() == 0
    assert [r.node_path for r in flatten_nested(df, "id", "j", tables=("s[].c[]",)).collect()] == ["s[0].c[0]"]


@needs_data
def test_p1_whole(spark):
    assert found(spark, "p1_found") == sorted(brute.p1(rows("pipelines"), rows("lineage_nodes")), key=str)


# --- 2

SCHEMA = [("k", 0, "seq", "integer", True), ("k", 1, "name", "text", True), ("k", 2, "day", "date", False), ("k", 3, "file_id", "decimal", False), ("k", 4, "ok", "boolean", False), ("k", 5, "at", "timestamp", False)]
SCHEMA_COLUMNS = "schema_kind string, position int, column_name string, data_type string, required boolean"
LINES = [
    "1;a;2024-02-29;1.5;yes;2024-01-01 10:00:00", "2;a;2023-02-29;1;no;", '3;"a;""b""";;-3;1;2024-01-01T23:59:59', "4;a;;;;;", "5;a;;;", '6;"a;;;;', '7;a"b;;;;', '8;"a" ;;;;', '9;"a\nmore\n\nlines";;;;', "10; ;;;;", '11;"";;;;',
    "12;x\ncontinued;;;;", "", "13;x;;1.;;", "14;x;;;;2024-01-01 24:00:00", '15;"x";"2024-01-01 ";" 2 ";" TRUE ";', "16;x;0000-01-01;;;", "17;x;1900-02-29;;;", "18;x;2000-02-29;;;", "   ", "19;" + "y" * 50_000 + ";;;;", '20;"' + '""' * 20_000 + '";;;;', "21;x;;;maybe;", "x;22", '23;"""";;;;',
]


def files_of(spark, bodies, mimes=None, kind="K "):
    return spark.createDataFrame([(i, f"f{i}", m, kind, bytearray(b) if b is not None else None, "extra") for i, (b, m) in enumerate(zip(bodies, mimes or [None] * len(bodies)))], "file_id long, originalname string, mimetype string, schema_kind string, buffer binary, reason string")


def as_rows(bodies, mimes=None):
    return [{"file_id": i, "mimetype": m, "schema_kind": "k", "buffer": b} for i, (b, m) in enumerate(zip(bodies, mimes or [None] * len(bodies)))]


def test_failing_records(spark):
    head = "seq;name;day;file_id;ok;at"
    text = "\n".join([head, "stray line", *LINES])
    bodies = [text.encode(), b"\xef\xbb\xbf" + text.replace("\n", "\r\n").encode(), None, b"", head.encode(), text.replace(";", "\t").encode(), (head + "\n1;café;;;;").encode("latin-1")]
    mimes = [None] * 6 + ["text/csv; charset=ISO-8859-1"]
    schema = spark.createDataFrame(SCHEMA, SCHEMA_COLUMNS)
    bad, good = brute.p2(as_rows(bodies, mimes), [dict(zip(("schema_kind", "position", "column_name", "data_type", "required"), s)) for s in SCHEMA])
    got = failing_records(files_of(spark, bodies, mimes), schema)
    assert {(r.file_id, r.line_no, r.reason) for r in got.collect()} == bad
    assert {r.field_no for r in got.where("reason = 'invalid_value' and record like '2;%'").collect()} == {2}
    sound = {(r.file_id, r.line_no): r for r in sound_records(files_of(spark, bodies, mimes), schema, "K").collect()}
    assert sound.keys() == good.keys()
    first = sound[0, 3]
    assert (first.seq, first.name, first.day, float(first._file_id), first.ok, first.at) == (1, "a", dt.date(2024, 2, 29), 1.5, True, dt.datetime(2024, 1, 1, 10))
    assert all(sound[k].name == v[1] for k, v in good.items())
    assert sound[6, 2].name == "café"
    assert failing_records(files_of(spark, [b"a;b\n1;2"], kind="other"), schema).first().reason == "unknown_schema"
    assert failing_records(files_of(spark, [None]).limit(0), schema).count() == 0
    assert sound_records(files_of(spark, bodies), schema, "other").columns == ["file_id", "line_no"] and sound_records(files_of(spark, bodies), schema.limit(0), "k").count() == 0
    odd = spark.createDataFrame([("k", None, "x", "text", True), ("k", 0, None, None, None), (None, 1, "y", "date", True)], SCHEMA_COLUMNS)
    assert failing_records(files_of(spark, [b"seq;b\n1;2\n"]), odd).first().reason == "column_count"


def test_records_that_no_type_holds(spark):
    schema = spark.createDataFrame([("k", 0, "seq", "integer", True), ("k", 1, "d", "decimal", False), ("k", 2, "unfit", "text", False)], SCHEMA_COLUMNS)
    big, fine, wide = "12345678901234567890", "0.12345678901", "9" * 29 + ".5"
    lines = [f"{big};1.5;a", f"2;{fine};b", f"3;{wide};c", "4;1.123456789000;d", "5;;e", f"{big};{fine};f"]
    got = {r._unfit: r for r in sound_records(files_of(spark, [("seq;d;unfit\n" + "\n".join(lines)).encode()]), schema, "k").collect()}
    assert {k: json.loads(r.unfit) if r.unfit else None for k, r in got.items()} == {"a": {"seq": big}, "b": {"d": fine}, "c": {"d": wide}, "d": None, "e": None, "f": {"seq": big, "d": fine}}
    assert got["a"].seq is None and float(got["a"].d) == 1.5 and got["b"].d is None and got["e"].d is None and float(got["d"].d) == 1.123456789


@needs_data
def test_p2_whole(spark):
    assert found(spark, "p2_found") == sorted(brute.p2(rows("uploaded_files"), rows("upload_schemas"))[0], key=str)


# --- 3


def test_orphans(spark):
    late = T0 + dt.timedelta(days=1)
    parents = [("a1", T0, None), ("A1 ", T0, None), ("a2", T0, late), ("a3", late, None), ("a07", T0, None), ("x", None, None), ("a99999999999999999999", T0, None)]
    refs = [("r1", "a1", T0), ("r2", " a2", late), ("r3", "A3", T0), ("r4", "a7", T0), ("r5", "a4", T0), ("r6", "x", T0), ("r7", "a3", None), ("r8", "", T0), ("r9", "a99999999999999999999", T0), ("r10", "a99999999999999999998", T0)] + [("hot", "gone", T0)] * 50
    p = spark.createDataFrame(parents, "id string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    r = spark.createDataFrame(refs, "row string, id string, at timestamp_ntz")
    scope = F.lit("s")
    p = p.select(*key_of(scope, F.lower(F.trim("id"))), "created_at", "deleted_at")
    r = r.select("row", "at", F.lit(1).alias("there"), F.lit(1).alias("c"), F.lit(1).alias("d"), *key_of(scope, F.lower(F.trim("id"))))
    got = sorted((x.row, x.state) for x in orphan_references(r, p).collect())
    assert got == sorted([("r2", "deleted"), ("r3", "late"), ("r4", "missing"), ("r5", "missing"), ("r8", "missing"), ("r10", "missing")] + [("hot", "missing")] * 50)
    assert orphan_references(r.limit(0), p).count() == 0
    assert orphan_references(r, p.limit(0)).count() == len(refs)


def test_orphans_runs(spark):
    parents = spark.range(0, 200_000).where("id % 1000 <> 7").select(*key_of(F.lit(""), F.concat(F.lit("n"), F.col("id").cast("string"))), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    refs = spark.range(0, 200_100).select(F.col("id").alias("ref"), F.lit(None).cast("timestamp_ntz").alias("at"), *key_of(F.lit(""), F.concat(F.lit("n"), F.col("id").cast("string"))))
    got = {r.ref for r in orphan_references(refs, parents).collect()}
    assert got == {i for i in range(200_100) if i % 1000 == 7 or i >= 200_000}


@needs_data
def test_p3_whole(spark):
    assert found(spark, "p3_found") == brute.p3(rows("notebooks"), rows("connections"), rows("lineage_edges"), rows("lineage_nodes"), rows("pipelines"))


# --- 4


def tree(spark, nodes, edges, **how):
    n = spark.createDataFrame([("g", k, "G", k.upper() if k else None, 1) for k in nodes], "scope string, key string, graph string, node_id string, depth int")
    e = spark.createDataFrame([("g", a, b) for a, b in edges], "scope string, source string, target string")
    return hierarchies(n.drop("depth"), e, **how)


def test_hierarchy(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(150)]
    nodes = ["a", "b", "c", "d", "lone", "x", "y", "z", "self", "under", None, *[f"c{i}" for i in range(151)], *[f"w{i}" for i in range(400)]]
    edges = [("a", "b"), ("a", "b"), ("b", "c"), ("a", "d"), ("x", "y"), ("y", "x"), ("y", "z"), ("self", "self"), ("self", "under"), ("ghost", "a"), ("a", "ghost"), (None, "a"), ("a", None), *chain, *[("d", f"w{i}") for i in range(400)]]
    got = {r.node_id: r for r in tree(spark, nodes * 2, edges, paths=True).collect()}
    want = brute.roots({k: k.upper() for k in nodes if k}, {(a, b) for a, b in edges if a and b})
    assert {k: (r.root_id, r.depth) for k, r in got.items()} == want
    assert got["C"].path == "A / B / C" and got["C150"].path.count(" / ") == 150
    assert got["A"].n_descendants == 403 and got["D"].n_descendants == 400 and got["C0"].n_descendants == 150
    inside = [r for r in got.values() if r.root_id == "A"]
    assert sorted(r.lft for r in inside) == list(range(404))
    d = got["D"]
    assert {r.node_id for r in inside if d.lft < r.lft <= d.rgt} == {f"W{i}" for i in range(400)}
    pairs = {(r.node_id, r.descendant_id): r.distance for r in descendants(tree(spark, nodes, edges)).collect()}
    brute_pairs = {}
    up = {b: a for a, b in edges if a in nodes and b in nodes and a and b}
    for k in nodes:
        if k and got[k.upper()].depth > 0:
            at, n = k, 0
            while at in up:
                at, n = up[at], n + 1
                brute_pairs[at.upper(), k.upper()] = n
    assert pairs == brute_pairs


def test_hierarchy_empty(spark):
    assert tree(spark, [], []).count() == 0
    assert [(r.root_id, r.depth, r.n_descendants) for r in tree(spark, ["a"], []).collect()] == [("A", 0, 0)]
    assert [(r.root_id, r.depth) for r in tree(spark, ["a", "b"], [("a", "b"), ("b", "a")]).collect()] == [("cycle", -1)] * 2


@needs_data
def test_p4_whole(spark):
    assert found(spark, "p4_found") == sorted(brute.p4(rows("lineage_nodes"), rows("lineage_edges"), rows("pipelines")), key=str)


# --- 5

PROFILE = [
    {"table_name": "t", "column_name": "id", "data_type": "text", "null_percent": 0.0, "distinct_percent": 100.0, "min_value": None, "max_value": None, "median_value": None, "value_pattern": "^[a-z]+[0-9]*$"},
    {"table_name": "t", "column_name": "v", "data_type": "integer", "null_percent": 10.0, "distinct_percent": 50.0, "min_value": "0", "max_value": "100", "median_value": 10.0, "value_pattern": None},
    {"table_name": "t", "column_name": "at", "data_type": "timestamp", "null_percent": 0.0, "distinct_percent": 50.0, "min_value": "2020-01-01T00:00:00Z", "max_value": "2030-01-01T00:00:00Z", "median_value": None, "value_pattern": None},
]
PROFILE_COLUMNS = "table_name string, column_name string, data_type string, null_percent double, distinct_percent double, min_value string, max_value string, median_value double, value_pattern string"


def test_departures(spark):
    r = random.Random(5)
    data = []
    for load in range(1, 60):
        n = r.choice([1, 2, 5, 40, 41, 300])
        share, middle = r.choice([1, 0.93, 0.9, 0.88, 0.5]), r.choice([1, 4, 5, 6, 10, 19, 20, 21, 90])
        for i in range(n):
            data.append((f"a{int(i * share)}" if r.random() > 0.02 else None if r.random() < 0.3 else "BAD", None if r.random() < 0.1 else max(-1, int(r.gauss(middle, 3))), T0 if r.random() > 0.002 else dt.datetime(2050, 1, 1), load, 7))
    data += [(None, None, None, 77, 1)] * 3 + [("x", 1, T0, None, 1)]
    df = spark.createDataFrame(data, "id string, v int, at timestamp_ntz, load_no int, n int")
    agreed = agreed_profiles(spark.createDataFrame([tuple(p.values()) for p in PROFILE], PROFILE_COLUMNS))
    states = column_states(df, "load_no", agreed)
    got = {tuple(x) for x in departures(states, agreed, {"t": df}).collect()}
    want = brute.p5({"t": [dict(zip(("id", "v", "at", "load_no"), x)) for x in data]}, PROFILE)
    assert got == want
    halves = column_states(df.where("v < 10"), "load_no", agreed).unionByName(column_states(df.where("v >= 10 or v is null"), "load_no", agreed))
    assert {tuple(x) for x in departures(merge_states(halves), agreed, {"t": df}).collect()} == want
    p = {(x.load_no, x.column_name): x for x in profiles(states).collect()}
    assert p[77, "v"].null_percent == 100.0 and p[77, "v"].mean_value is None and p[77, "id"].distinct_count == 0
    assert control_limits(profiles(states)).count() >= 0
    assert departures(column_states(df.limit(0), "load_no", agreed), agreed, {"t": df}).count() == 0
    assert departures(column_states(df, "load_no", []), [], {"t": df}).count() == 0 and profiles(column_states(df, "load_no", [])).count() == 0
    vague = agreed_profiles(spark.createDataFrame([("t", "v", None, None, None, "low", "2 days", None, None), (None, "v", *[None] * 7), ("t", None, *[None] * 7)], PROFILE_COLUMNS))
    assert len(vague) == 1 and departures(column_states(df, "load_no", vague), vague, {"t": df}).count() == 0
    assert column_states(df.drop("v"), "load_no", agreed).where("column_name = 'v' and nulls < n").count() == 0


def test_control_limits(spark):
    rows_ = [("t", i, "c", float(i % 2) if i != 15 else 50.0, 50.0, 1.0) for i in range(20)]
    p = spark.createDataFrame(rows_, "table_name string, load_no int, column_name string, null_percent double, distinct_percent double, mean_value double")
    assert [(r.load_no, r.metric) for r in control_limits(p).collect()] == [(15, "null_percent")]


def test_near_limit_in_another_case(spark):
    df = spark.range(1000).selectExpr("concat('a', least(id, 879)) id", "1 load_no")  # 88 % distinct, limit 90 %
    agreed = agreed_profiles(spark.createDataFrame([("t", "ID", "text", 0.0, 100.0, None, None, None, None)], PROFILE_COLUMNS))
    assert [tuple(r) for r in departures(column_states(df, "load_no", agreed), agreed, {"t": df}).collect()] == [("t", 1, "ID", "distinct")]


def test_profile_of_all_columns(spark):
    data = [(f"a{i}", float(i % 7) if i % 5 else None, [i], T0, i % 3, 5 * i) for i in range(200)] + [("BAD", None, None, T0, 9, 1)]
    df = spark.createDataFrame(data, "id string, v double, extra array<int>, at timestamp_ntz, load_no int, n int")
    agreed = agreed_profiles(spark.createDataFrame([tuple(p.values()) for p in PROFILE], PROFILE_COLUMNS))
    every = all_columns(df, "LOAD_NO", agreed, "t")
    assert [a.column_name for a in every] == ["at", "id", "v", "extra", "n"]
    states = column_states(df, "load_no", every)
    halves = merge_states(column_states(df.where("n < 400"), "load_no", every).unionByName(column_states(df.where("n >= 400"), "load_no", every)))
    for p in (profiles(states), profiles(halves)):
        got = {(x.load_no, x.column_name): x for x in p.collect()}
        for load in range(3):
            v = [r[1] for r in data if r[4] == load and r[1] is not None]
            assert got[load, "v"].median_value == statistics.median(v)
            assert got[load, "n"].median_value == statistics.median(r[5] for r in data if r[4] == load)
        assert got[9, "v"].median_value is None and got[0, "at"].median_value is None and got[0, "extra"].distinct_count == 67
        assert got[9, "id"].pattern_percent == 100.0 and got[0, "id"].pattern_percent == 0.0 and got[9, "v"].range_percent is None


def test_control_limits_of_all_metrics(spark):
    rows_ = [("t", i, "c", 1.0, 50.0 if i == 12 else 1.0, 9.0 if i == 15 else 0.0, 9.0 if i == 18 else 0.0) for i in range(20)]
    p = spark.createDataFrame(rows_, "table_name string, load_no int, column_name string, mean_value double, median_value double, range_percent double, pattern_percent double")
    assert {(r.load_no, r.metric) for r in control_limits(p).collect()} == {(12, "median_value"), (15, "range_percent"), (18, "pattern_percent")}


@needs_data
def test_p5_profile_columns(spark):
    got = {tuple(r) for r in record_queries.p5_profile(spark, DATA).select("table_name", "column_name").distinct().collect()}
    assert got == {(t, c) for t in record_queries.LOADED for c in spark.read.parquet(f"{DATA}/{t}.parquet").columns if c != "load_no"}


@needs_data
def test_p5_whole(spark):
    tables = {n: rows(n) for n in ("query_history", "quality_check_runs")}
    assert found(spark, "p5_found") == sorted(brute.p5(tables, rows("table_profiles")), key=str)


@pytest.mark.parametrize("bad", ["not json", "{"])
def test_unreadable(spark, bad):
    assert flatten_nested(spark.createDataFrame([("i", bad)], "id string, j string"), "id", "j", include_root=True).count() == 0


def test_many_kinds_in_parts(spark, monkeypatch):
    """More columns than one expression takes: the kinds are judged in parts, with the same result."""
    from crosslake.operators import bad_records

    kinds = [(f"k{k}", i, f"c{i}", t, True) for k in range(5) for i, t in enumerate(("integer", "date", "text")[: 1 + k % 3])]
    schemas = spark.createDataFrame(kinds, "schema_kind string, position int, column_name string, data_type string, required boolean")
    body = b"h\n1,2025-01-01,x\n2\n3,2025-01-01\n4,x\n"
    files = spark.createDataFrame([(i, "text/csv", f"k{i % 6}", b"a,b,c\n" + body[2:]) for i in range(12)], "file_id bigint, mimetype string, schema_kind string, buffer binary")
    whole = sorted(tuple(r) for r in failing_records(files, schemas).collect())
    monkeypatch.setattr(bad_records, "JUDGED_COLUMNS", 3)
    assert sorted(tuple(r) for r in failing_records(files, schemas).collect()) == whole != []
    assert {r[2] for r in whole} == {"column_count", "invalid_value", "unknown_schema"}


def test_distribution_shifts(spark):
    """The same mean and null rate, another distribution: for numbers and for texts."""
    r = random.Random(4)
    data = []
    for load in range(1, 13):
        for _ in range(400):
            v = r.gauss(100, 10) if load != 9 else 100.0 + r.choice([-10.0, 10.0])
            data.append((load, v, r.choice("aaab") if load != 10 else r.choice("ab"), "same", T0 + dt.timedelta(days=load)))
    df = spark.createDataFrame(data, "load_no int, v double, t string, c string, at timestamp_ntz").repartition(4)
    states = column_states(df, "load_no", all_columns(df, "load_no", [], "x"))
    got = {(x.load_no, x.column_name): x for x in distribution_shifts(states).collect()}
    assert set(got) == {(9, "v"), (10, "t")} and got[9, "v"].n_values == 400 and got[9, "v"].n_before == 3200
    assert abs(got[10, "t"].distance - 0.25) < 0.06
    assert distribution_shifts(states.limit(0)).count() == 0
    assert control_limits(profiles(states)).where("metric in ('mean_value', 'null_percent') and column_name in ('v', 't')").where("load_no in (9, 10)").count() == 0


def test_control_limits_of_constants(spark):
    """Means of equal fractions differ from them by rounding; that is no departure."""
    p = spark.createDataFrame([("t", i, "c", 0.1 + 0.2 if i < 12 else 5.0) for i in range(13)], "table_name string, load_no int, column_name string, mean_value double")
    assert [x.load_no for x in control_limits(p).collect()] == [12]


def test_wide_schema(spark):
    """Prefixes of a wide schema skip the fields that earlier ones have tested."""
    n = 45
    schemas = spark.createDataFrame([("w", i, f"c{i}", "integer" if i % 2 == 0 else "text", i % 4 != 1) for i in range(n)], "schema_kind string, position int, column_name string, data_type string, required boolean")
    good = [str(i) if i % 2 == 0 else f'"t, ""{i}"""' for i in range(n)]
    lines, want = [",".join(good)], {}
    for k in (0, 1, 15, 16, 17, 31, 32, 33, 44):
        for bad, reason in ((("x" if k % 2 == 0 else "" if k % 4 == 3 else 'a"b'), None), ('"x"y', "quoting")):
            if k == 0:
                continue
            row = list(good)
            row[k] = bad
            lines.append(",".join(row))
            want[len(lines) + 1] = (reason or ("quoting" if '"' in bad else "invalid_value"), k)
    lines.append(",".join(good[:20]))
    want[len(lines) + 1] = ("column_count", n)
    body = ",".join(f"c{i}" for i in range(n)) + "\n" + "\n".join(lines)
    files = spark.createDataFrame([(1, "text/csv", "w", body.encode())], "file_id bigint, mimetype string, schema_kind string, buffer binary")
    got = {r.line_no: (r.reason, r.field_no) for r in failing_records(files, schemas).collect()}
    assert got.keys() == want.keys()
    for line, (reason, field) in want.items():
        assert got[line][0] == reason and (reason == "column_count" or got[line][1] == field), (line, got[line], want[line])
