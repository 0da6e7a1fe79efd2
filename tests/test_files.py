"""Uploaded files, documents, staging, exports, row rules, REST."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from crosslake.operators import transforms
from crosslake.sources import documents, excel, export, files, staging
from crosslake.sources.rest import pages, read_rest

TYPES = "int,float,bool_word,bool_digit,iso_ts,text,blank\n1,1.5,yes,1,2024-01-02,a,\n-2,2,NO,0,2024-01-02 03:04:05,5x,\n+3,1e3,yes,1,2024-01-02T03:04:05Z,,\n"


def put(path, text):
    path.write_text(text)
    return str(path)


def test_types(spark, tmp_path):
    p = files.parse_file(spark, put(tmp_path / "types.csv", TYPES))
    assert p.types == {"int": "integer", "float": "numeric", "bool_word": "boolean", "bool_digit": "integer", "iso_ts": "timestamp", "text": "text", "blank": "text"}
    t = p.table().collect()
    assert t[0].iso_ts == dt.datetime(2024, 1, 2) and t[1].bool_word is False and t[2].float == 1000.0 and t[2].int == 3 and t[2].text is None
    assert p.total() == 3 and p.errors.where("column = 'blank'").count() == 3 and p.preview(2).count() == 2


def test_missing_and_rows(spark, tmp_path):
    p = files.parse_file(spark, put(tmp_path / "m.csv", "a,b\n1,\n2, \n,x\n"))
    assert sorted((r.row, r.column, r.type) for r in p.errors.collect()) == [(1, "b", "MISSING_VALUE"), (3, "a", "MISSING_VALUE")]
    assert [r.b for r in p.table().collect()] == [None, None, "x"]
    q = files.parse_file(spark, put(tmp_path / "n.csv", "1;x\n2;y\n"), delimiter=";", header=False)
    assert sorted(q.types) == ["0", "1"] and [r._row for r in q.rows.collect()] == [2, 3]
    quoted = files.parse_file(spark, put(tmp_path / "q.csv", 'a,b\n"x,1","say ""hi""\nthere"\n'))
    r = quoted.rows.first()
    assert (r.a, r.b) == ("x,1", 'say "hi"\nthere')
    e = files.parse_file(spark, put(tmp_path / "e.csv", "a,b\n 1 ,\n,\n"), trim=True, skip_empty=True)
    assert [r.a for r in e.rows.collect()] == ["1"]
    assert files.infer_types(spark.createDataFrame([], "a string")) == {"a": "text"}


def test_row_numbers(spark):
    df = spark.range(1000).repartition(7).sortWithinPartitions("id")
    got = [r._row for r in files.with_row_numbers(df).collect()]
    assert sorted(got) == list(range(1, 1001))
    assert files.with_row_numbers(df.limit(0)).count() == 0


def test_json(spark, tmp_path):
    doc = {"data": {"users": [{"id": 1, "address": {"city": "X"}, "tags": ["a", "b"], "nick": ""}, 7, {"id": 2, "more": None}]}}
    p = files.parse_file(spark, put(tmp_path / "n.json", json.dumps(doc)), root_path="data.users")
    rows = {r._row: r for r in p.rows.collect()}
    assert rows.keys() == {1, 3} and rows[1]["address.city"] == "X" and json.loads(rows[1]["tags"]) == ["a", "b"] and rows[1]["nick"] is None
    assert sorted((r.row, r.column, r.type) for r in p.errors.collect()) == [(1, "nick", "MISSING_VALUE"), (2, None, "VALIDATION_ERROR"), (3, "more", "MISSING_VALUE")] or sorted((r.row, r.column or "", r.type) for r in p.errors.collect()) == [(1, "nick", "MISSING_VALUE"), (2, "", "VALIDATION_ERROR"), (3, "more", "MISSING_VALUE")]
    assert p.types["id"] == "integer"
    assert files.parse_file(spark, put(tmp_path / "s.json", '{"a": 1}')).total() == 1
    with pytest.raises(ValueError):
        files.parse_file(spark, put(tmp_path / "x.json", "3"))
    with pytest.raises(ValueError):
        files.parse_file(spark, put(tmp_path / "y.json", "{}"), root_path="no.where")


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>Ann</t></r><r><t>a</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" s="1"><v>45292</v></c></row><row r="3"/></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>1.5</v></c></row></sheetData></worksheet>')
    return str(path)


def test_excel(spark, tmp_path):
    path = workbook(tmp_path / "two.xlsx")
    assert excel.sheet_names(path) == ["One", "Two"]
    p = files.parse_file(spark, path)
    r = p.rows.collect()
    assert len(r) == 1 and r[0]._row == 2 and (r[0].name, r[0].column_1, r[0].when) == ("Anna", "true", "2024-01-01T00:00:00")
    assert p.types["when"] == "timestamp"
    two = files.parse_file(spark, path, sheet="Two", header=False)
    assert [(x._row, x["0"]) for x in two.rows.collect()] == [(1, "1.5")]
    assert files.parse_file(spark, path, sheet="Missing").rows.first().name == "Anna"


def test_url(spark, tmp_path):
    seen = {}

    def fetch(url, headers):
        seen.update(headers)
        return b"a,b\n1,2\n", "text/csv; charset=utf-8"

    p = files.parse_url(spark, "https://x/data?y=1", {"type": "bearer", "token": "t"}, {"X": "1"}, str(tmp_path), fetch)
    assert p.types == {"a": "integer", "b": "integer"} and seen == {"X": "1", "Authorization": "Bearer t"}
    with pytest.raises(ValueError):
        files.parse_url(spark, "ftp://x")
    assert files.auth_headers({"type": "basic", "username": "a", "password": "b"}) == {"Authorization": "Basic YTpi"}
    assert files.auth_headers({"type": "api_key", "key": "k"}) == {"X-API-Key": "k"} and files.auth_headers(None) == {}
    with pytest.raises(ValueError):
        files.file_kind("x.exe")


def test_staging(spark, tmp_path):
    p = files.parse_file(spark, put(tmp_path / "s.csv", "id,when,name\n1,2024-01-01,a\n2,2024-01-02,\n" + "".join(f"{i},2024-01-03,n\n" for i in range(3, 120)) + "x,2024-01-04,late\n"))
    got = staging.import_parsed(p, "Org-1", "2024 Sales.csv", "12ab34cd-77")
    assert got["table"] == "staging_org_1._2024_sales_csv_12ab34cd"
    assert (got["rows_processed"], got["rows_succeeded"], got["rows_failed"]) == (120, 119, 1)
    t = spark.table(got["table"])
    assert dict(t.dtypes)["id"] == "bigint" and t.select("_staging_id").distinct().count() == 119 and t.agg(F.min("_staging_id")).first()[0] == 1
    assert staging.staged_metadata(spark, got["table"], "o", "j")["row_count"] == 119
    from crosslake.sources.registry import ConnectionRegistry

    r = ConnectionRegistry(spark)
    assert "staging_org_1" in r.schemas("staging") and [x.name for x in r.tables("staging", "staging_org_1")] and r.staging_sizes("staging_org_1").popitem()[1] > 0
    staging.drop_staging(spark, got["table"])
    assert not spark.catalog.tableExists(got["table"])
    with pytest.raises(ValueError):
        staging.drop_staging(spark, "other.t")


def test_types_of_all_rows(spark, tmp_path):
    n = 150
    late = lambda i, x, y: y if i >= 120 else x
    lines = [f"{late(i, i, 12.5)},{late(i, i, 'code')},{'?' if i == 140 else i},{late(i, '', '2024-01-01')}" for i in range(n)]
    p = files.parse_file(spark, put(tmp_path / "late.csv", "fraction,word,stray,time\n" + "\n".join(lines) + "\n"))
    assert p.types == {"fraction": "numeric", "word": "text", "stray": "integer", "time": "timestamp"}
    assert [(r.column, r.value, r.severity) for r in p.errors.where("type = 'VALIDATION_ERROR'").collect()] == [("stray", "?", "error")]
    t = p.table()
    assert t.where("fraction = 12.5 and word = 'code'").count() == 30 and t.where("stray is null").count() == 1
    got = staging.import_parsed(p, "Org-1", "late.csv", "77aa-1")
    assert (got["rows_succeeded"], got["rows_failed"]) == (149, 1) and sum(r.type == "VALIDATION_ERROR" for r in got["errors"]) == 1
    staging.drop_staging(spark, got["table"])
    j = files.parse_file(spark, put(tmp_path / "late.json", json.dumps([{"a": late(i, i, "x" if i == 130 else 0.5)} for i in range(n)])))
    assert j.types == {"a": "numeric"} and [(r.row, r.value) for r in j.errors.collect()] == [(131, "x")]
    every = spark.range(200).selectExpr("if(id = 199, 'x', cast(id as string)) a")
    assert files.infer_types(every) == {"a": "text"} and files.infer_types(every, strays=0.01) == {"a": "integer"}


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3), (2, None, 4)], "k int, v string, n int")
    good, bad = staging.split_rejects(df, ["v"], ["k"], "n")
    assert {r.n for r in good.collect()} == {1, 3} and {(r.row, r.type) for r in bad.collect()} == {(2, "CONSTRAINT_VIOLATION"), (4, "CONSTRAINT_VIOLATION")}
    assert staging.check_mapping({"a": "x", "b": "y"}, ["a"], ["x"]) == ["Source column not found: b", "Target column not found: y"]
    merged, counts = staging.upsert(df.where("n = 1"), df.where("n > 1"), ["k"], [F.desc("n")])
    assert sorted(r.n for r in merged.collect()) == [2, 3, 4] and tuple(counts.first()) == (2, 1)
    runs = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2025, 1, 1))], "id string, started_at timestamp_ntz")
    cached = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    kept, results = staging.keep_recent(runs, cached, dt.datetime(2025, 2, 1))
    assert [r.id for r in kept.collect()] == ["b"] and {r.run_id for r in results.collect()} == {"b", "c"}


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', None), (2, "x,y", ""), (3, None, "p")], "id int, t string, u string")
    assert sorted(r.value for r in export.csv_lines(df).collect()) == ['"1","a""b",', '"2","x,y",""', '"3",,"p"']
    assert sorted(r.value for r in export.csv_lines(df, False).collect()) == ['1,"a""b",', '2,"x,y",', "3,,p"]
    export.write_csv(df.coalesce(1), f"{tmp_path}/out")
    assert next(tmp_path.glob("out/part-*")).read_text().splitlines()[0] == '"id","t","u"'
    env = json.loads(export.json_envelope(df, dt.datetime(2025, 1, 1)))
    assert env["rowCount"] == 3 and env["rows"][0] == {"id": 1, "t": 'a"b', "u": None} and env["fields"][0] == {"name": "id", "type": "integer"}
    with pytest.raises(ValueError):
        export.json_envelope(df, dt.datetime(2025, 1, 1), 2)
    errs = files.error_records(spark.createDataFrame([(1, ""), (2, None)], "n int, c string"), "n")
    assert sorted(r.value for r in export.error_lines(errs).collect())[0].startswith('"1","c","""""","Empty cell"')
    assert "A" in export.dashboard_report({"A": {"x": 1}, "B": [{"y": None}]}, dt.datetime(2025, 1, 1))
    h = spark.createDataFrame([("q", dt.datetime(2025, 1, 1))], "id string, executed_at timestamp_ntz")
    now = F.lit("2025-01-03 00:00:00").cast("timestamp_ntz")
    pay = export.catalog_payload(df.select(F.col("t").alias("name")), df.select(F.col("t").alias("name")), df.select(F.col("t").alias("name")).limit(0), h.select("id"), h, now)
    assert {r.kind: r.n for r in export.payload_counts(pay).collect()} == {"service": 3, "table": 3, "edge": 1, "query": 1}


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a", 5, ["x"], None), (2, "b", None, ["x", "y"], "v"), (3, "A", 9, [], "w")], "_id int, s string, n int, tags array<string>, o string")
    q = lambda **spec: documents.mongo_query({"c": docs}, json.dumps({"collection": "c"} | spec))
    ids = lambda **f: sorted(r._id for r in q(filter=f).collect())
    assert ids(s="a") == [1] and ids(n=None) == [2] and ids(n={"$gte": 5, "$lt": 9}) == [1] and ids(n={"$ne": 5}) == [2, 3]
    assert ids(s={"$regex": "^a", "$options": "i"}) == [1, 3] and ids(o={"$exists": True}) == [2, 3] and ids(n={"$in": [5, None]}) == [1, 2] and ids(n={"$nin": [5]}) == [2, 3]
    assert ids(**{"$or": [{"s": "a"}, {"n": 9}]}) == [1, 3] and ids(**{"$nor": [{"s": "a"}]}) == [2, 3] and ids(tags={"$size": 2}) == [2] and ids(s={"$not": {"$eq": "a"}}) == [2, 3]
    assert q(projection={"s": 1}).columns == ["_id", "s"] and q(projection={"s": 0}).columns == ["_id", "n", "tags", "o"] and q(limit=2).count() == 2
    pipe = lambda *p: q(pipeline=list(p)).collect()
    assert sorted((r._id, r.n) for r in pipe({"$unwind": "$tags"}, {"$group": {"_id": "$tags", "n": {"$sum": 1}}})) == [("x", 2), ("y", 1)]
    assert len(pipe({"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True}})) == 4
    assert [r._id for r in pipe({"$sort": {"n": -1}}, {"$skip": 1}, {"$limit": 1})] == [1] and pipe({"$count": "all"})[0]["all"] == 3
    assert pipe({"$group": {"_id": None, "m": {"$avg": "$n"}, "s": {"$addToSet": "$s"}}})[0].m == 7.0
    assert pipe({"$addFields": {"d": {"$multiply": ["$n", 2]}}}, {"$match": {"d": 10}})[0]._id == 1
    for bad in ("nope", "[]", '{"collection": ""}', '{"collection": "z"}', '{"collection": "c", "filter": {"a": {"$what": 1}}}', '{"collection": "c", "pipeline": [{"$what": 1}]}'):
        with pytest.raises(ValueError):
            documents.mongo_query({"c": docs}, bad)
    lines = spark.createDataFrame([('{"_id": {"$oid": "x"}, "a": 1}',), ('{"a": "s", "b": [1], "c": null, "d": true, "e": {}}',)], "value string")
    assert [(c.name, c.type, c.is_primary_key) for c in documents.sample_columns(lines)] == [("_id", "objectid", True), ("a", "number", False), ("b", "array", False), ("c", "null", False), ("d", "boolean", False), ("e", "object", False)]
    out = documents.serialized(spark.createDataFrame([(bytearray(b"hi"), dt.datetime(2025, 1, 2))], "b binary, t timestamp_ntz")).first()
    assert tuple(out) == ("aGk=", "2025-01-02T00:00:00.000Z")
    assert documents.connection_uri("h", 1, "d", "u@", "p:") == "mongodb://u%40:p%3A@h:1/d" and documents.connection_uri("mongodb+srv://z") == "mongodb+srv://z"


def test_row_rules(spark):
    df = spark.createDataFrame([(1, "a@x", "5"), (2, "bad", "50"), (2, None, "x"), (None, "c@x", None)], "id int, mail string, n string")
    rules = [{"column": "id", "rule": "required"}, {"column": "id", "rule": "unique"}, {"column": "mail", "rule": "regex", "pattern": "@", "severity": "warning"}, {"column": "n", "rule": "type", "type": "int"}, {"column": "n", "rule": "range", "max": 60}]
    good, bad, warned = transforms.validate_rows(df, rules)
    assert good.count() == 1 and bad.count() == 3 and warned.count() == 0
    only = transforms.validate_rows(df, rules[2:3])
    assert only[0].count() == 4 and only[2].count() == 1
    assert transforms.validate_rows(df, [])[0].count() == 4
    last = transforms.dedup(df.where("id is not null"), ["id"], [F.col("n")], "last")
    assert {(r.id, r.n) for r in last.collect()} == {(1, "5"), (2, "x")}
    with pytest.raises(ValueError):
        transforms.map_columns(df, {"zz": "a"})
    assert transforms.map_columns(df, {"id": "key"}, True).columns == ["key", "mail", "n"]
    assert [r.n for r in transforms.convert(df, {"n": "int"}).collect()] == [5, 50, None, None]
    assert transforms.filter_rows(df, [{"column": "mail", "operator": "endsWith", "value": "@x"}, {"column": "id", "operator": "isNotNull"}]).count() == 1
    assert {r.type: r.n for r in transforms.errors_by_type(files.error_records(df, "id")).collect()} == {"MISSING_VALUE": 2}


def test_rest(spark):
    def offset(url, p):
        return {"items": [{"i": i} for i in range(5)][p["offset"] : p["offset"] + p["limit"]]}, {}

    assert [len(x) for x in pages("u", {"type": "offset", "items": "items", "size": 2}, offset)] == [2, 2, 1]
    cursor = lambda url, p: ({"d": [1], "next": None if p else "x"}, {})
    assert len(list(pages("u", {"type": "cursor", "items": "d"}, cursor))) == 2
    link = lambda url, p: ([1], {"next": "v"} if url == "u" else {})
    assert len(list(pages("u", {"type": "link"}, link))) == 2
    assert read_rest(spark, "u", {"type": "offset", "items": "items", "size": 2}, offset, "i int").agg(F.sum("i")).first()[0] == 10
    with pytest.raises(ValueError):
        list(pages("u", {"type": "link"}, lambda u, p: ([1], {"next": "u"}), 5))


def test_catalog_changes(spark):
    p = spark.createDataFrame([("table", "a", "1"), ("table", "a", "1"), ("table", "b", "2"), ("table", "c", "3"), ("edge", "a", None)], "kind string, name string, body string")
    known = spark.createDataFrame([("table", "a", "1"), ("table", "b", "1"), ("table", "z", "1")], p.schema)
    assert sorted((r.kind, r.name, r.action) for r in export.catalog_changes(p, known).collect()) == [("table", "b", "updated"), ("table", "c", "created")]
    assert export.catalog_changes(p.limit(0), known).count() == 0


def test_csv_splits_unless_quoted(spark, tmp_path):
    plain, quoted = f"{tmp_path}/plain.csv", f"{tmp_path}/quoted.csv"
    with open(plain, "w") as f:
        f.write("a,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(500)))
    with open(quoted, "w") as f:
        f.write('a,b\n1,"two\nlines"\n2,x\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        df = files.read_csv(spark, plain)
        assert df.rdd.getNumPartitions() > 1 and df.count() == 500 and df.where("a = '7'").first().b == 'x, "7"'
        assert [r.b for r in files.read_csv(spark, quoted).collect()] == ["two\nlines", "x"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_lines(spark, tmp_path):
    path = f"{tmp_path}/x.jsonl"
    with open(path, "w") as f:
        f.write('{"a": 1, "b": {"c": "x"}}\n\n[1]\n{"a": 2}\nbroken\n{"b": {"c": ""}}\n')
    p = files.parse_file(spark, path)
    assert sorted((r._row, r.a, r["b.c"]) for r in p.rows.collect()) == [(1, "1", "x"), (4, "2", None), (6, None, None)]
    assert {r.row for r in p.errors.where("severity = 'error'").collect()} == {3, 5} and p.types["a"] == "integer"


def test_types_from_first_values(spark):
    df = spark.createDataFrame([("", "1")] * 150 + [(str(i), "x") for i in range(150)], "a string, b string").coalesce(1)
    assert files.infer_types(df, sample=100) == {"a": "integer", "b": "integer"} and files.infer_types(df) == {"a": "integer", "b": "text"}
