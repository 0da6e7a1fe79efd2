"""Uploaded files: readers by type, type inference, error records, previews."""

from __future__ import annotations

import os
import tempfile
import urllib.request
from base64 import b64encode
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslake.functions.common import local_rows, shared_dir
from crosslake.model import ERROR_RECORD, SPARK_TYPES
from crosslake.sources import excel

SAMPLE_ROWS = 100  # of previews
STRAY_SHARE = 0.01  # of a column's values may not fit its type in an uploaded file
MAX_URL_BYTES, URL_TIMEOUT_S = 500 * 1024 * 1024, 60
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
WORDS = ("true", "false", "yes", "no", "1", "0")
ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def as_time(c: Column) -> Column:
    """An ISO time as a timestamp, null for anything else and for years up to 1900."""
    t = F.try_to_timestamp(F.when(F.trim(c).rlike(ISO_TIME), F.trim(c)))
    return F.when(F.year(t) > 1900, t.cast("timestamp_ntz"))


def infer_types(df: DataFrame, sample: int | None = None, json_words: bool = False, strays: float = 0.0) -> dict[str, str]:
    """integer, numeric, boolean, timestamp or text for each text column, in one pass over all rows, or from ``sample`` values of each column that are not empty.

    Empty cells do not count; a column without values is text. Numbers are tested before
    booleans, so a column of ones and zeros is an integer; one number with a fraction makes
    a column numeric. ``json_words`` takes only true and false as booleans. A share of
    ``strays`` of the values need not fit.
    """
    if not df.columns:
        return {}
    words = WORDS[:2] if json_words else WORDS
    aggs = []
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`").cast("string")
        v = F.when(v != "", v)
        whole = F.coalesce(v.try_cast("double") == F.rint(v.try_cast("double")), F.lit(False))
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(v.rlike(NUMBER)).alias(f"num{i}"), F.count_if(v.rlike(NUMBER) & ~whole).alias(f"fraction{i}")]
        aggs += [F.count_if(F.lower(v).isin(*words)).alias(f"bool{i}"), F.count_if(as_time(v).isNotNull()).alias(f"time{i}")]
    if sample is not None:
        one = [df.where(F.col(f"`{c}`").cast("string") != "").limit(sample).select(*[(F.col(f"`{c}`") if k == i else F.lit(None)).cast("string").alias(n) for k, n in enumerate(df.columns)]) for i, c in enumerate(df.columns)]
        df = reduce(DataFrame.unionByName, one)
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(df.columns):
        n = r[f"n{i}"]
        least = n - int(n * strays)
        if not n:
            out[c] = "text"
        elif r[f"num{i}"] >= least:
            out[c] = "numeric" if r[f"fraction{i}"] else "integer"
        else:
            out[c] = "boolean" if r[f"bool{i}"] >= least else "timestamp" if r[f"time{i}"] >= least else "text"
    return out


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns as the inferred types; a value that does not fit is null (error_records tells of it)."""
    return df.select(*[_typed(F.col(f"`{c}`"), types.get(c, "text")).alias(c) for c in df.columns])


def _typed(c: Column, kind: str) -> Column:
    v = F.trim(c.cast("string"))
    if kind == "integer":
        return F.coalesce(v.try_cast("bigint"), F.when(v.try_cast("double") == F.rint(v.try_cast("double")), v.try_cast("double").try_cast("bigint")))
    if kind == "boolean":
        return F.when(F.lower(v).isin("true", "yes", "1"), True).when(F.lower(v).isin("false", "no", "0"), False)
    return as_time(c) if kind == "timestamp" else v.try_cast("double") if kind == "numeric" else c


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.trim(f"`{f.name}`") != "", F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def error_records(df: DataFrame, row_col: str, types: dict[str, str] | None = None) -> DataFrame:
    """One record for each empty cell (a warning), and with ``types`` for each value that does not fit (an error).

    A cell of blanks only becomes null without a warning.
    """
    recs = []
    for f in df.schema.fields:
        if f.name == row_col:
            continue
        v = F.col(f"`{f.name}`").cast("string")
        row = F.col(f"`{row_col}`").cast("bigint").alias("row")
        rec = lambda error, kind, level, tip: F.struct(row, F.lit(f.name).alias("column"), v.alias("value"), F.lit(error).alias("error"), F.lit(kind).alias("type"), F.lit(level).alias("severity"), F.lit(tip).alias("suggestion"))  # noqa: E731, B023
        recs.append(F.when(v.isNull() | (v == ""), rec("Empty cell", "MISSING_VALUE", "warning", "Fill the cell, or let the column be empty")))
        kind = (types or {}).get(f.name, "text")
        if kind != "text":
            recs.append(F.when((F.trim(v) != "") & _typed(F.col(f"`{f.name}`"), kind).isNull(), rec(f"Value is not of type {kind}", "VALIDATION_ERROR", "error", f"Provide a value of type {kind}")))
    if not recs:
        return df.sparkSession.createDataFrame([], ERROR_RECORD)
    return df.select(F.explode(F.array_compact(F.array(*recs))).alias("e")).select("e.*")


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, multi_line: bool | None = None) -> DataFrame:
    """Text columns; without a header they are named 0, 1, 2 ... Quoted fields may hold separators, doubled quotes and line ends.

    Files are split among tasks unless a field holds a line end, which a pass over the lines
    finds (one with an odd number of quotes); ``multi_line`` spares that pass.
    """
    if multi_line is None:
        multi_line = not spark.read.text(path).where(F.regexp_count("value", F.lit('"')) % 2 == 1).isEmpty()
    df = spark.read.csv(path, sep=delimiter, header=header, multiLine=multi_line, quote='"', escape='"', inferSchema=False, enforceSchema=False, mode="PERMISSIVE", nullValue="\u0000", emptyValue="")
    return df if header else df.toDF(*map(str, range(len(df.columns))))


def with_row_numbers(df: DataFrame, first: int = 1, name: str = "_row") -> DataFrame:
    """Dense row numbers in the order of the partitions, which are counted first; each then numbers its own rows.

    Both passes must see the same partitions: files as they are read have them, anything
    behind a shuffle (a sort, say) must be checkpointed before.
    """
    indexed = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__id", 33))
    counts = sorted((r[0], r[1]) for r in indexed.groupBy("__p").count().collect())  # one row for each partition
    at, starts = first, []
    for p, n in counts:
        starts.append((p, at))
        at += n
    start = local_rows(df.sparkSession, starts, "__p bigint, __start bigint")
    return indexed.join(F.broadcast(start), "__p").withColumn(name, F.col("__start") + F.expr("__id & ((1L << 33) - 1)")).select(*[F.col(f"`{c}`") for c in df.columns], name)


def read_json(spark: SparkSession, path: str, root_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a whole JSON document.

    ``root_path`` leads by points to an array; one object is one row; anything else is an
    error, as is an element that is no object. Objects are flattened one level to dotted
    names, arrays become JSON text, empty texts null with a warning.
    """
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    at = "$" + "".join(f".{p}" for p in (root_path or "").split(".") if p)
    first = doc.select(F.schema_of_variant(F.try_variant_get("v", at, "variant")).alias("s")).first()
    kind = (first.s if first else None) or "VOID"
    if not kind.startswith(("ARRAY", "OBJECT")):
        raise ValueError(f"Root path {root_path!r} is no array or object" if root_path else "JSON must be an array or an object")
    doc = doc.select(F.try_variant_get("v", at, "variant").alias("v"))
    if kind.startswith("OBJECT"):
        rows = doc.select(F.lit(1).cast("bigint").alias("row"), F.col("v").alias("value"))
    else:
        rows = doc.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select((F.col("pos") + 1).cast("bigint").alias("row"), "value")
    return _json_rows(rows)


def _json_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    is_obj = F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False))
    bad = rows.where(~is_obj).select("row", F.lit(None).cast("string").alias("column"), F.col("value").cast("string").alias("value"), F.lit("Row is not an object").alias("error"), F.lit("VALIDATION_ERROR").alias("type"), F.lit("error").alias("severity"), F.lit("Provide an object").alias("suggestion"))
    good = rows.where(is_obj)
    keys = _object_keys(good)
    cols = {}
    for name, sub in keys:
        path = f"$['{name}']" + (f"['{sub}']" if sub else "")
        cols[f"{name}.{sub}" if sub else name] = F.try_variant_get("value", path, "string")
    flat = good.select("row", *[F.when(c != "", c).alias(n) for n, c in cols.items()])
    raw = good.select(F.col("row").alias("_row"), *[c.alias(n) for n, c in cols.items()])
    empty = _missing(good, raw, keys)
    return flat.withColumnRenamed("row", "_row"), bad.unionByName(empty)


def read_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a file with one JSON document a line, which splits among tasks; blank lines count as rows without an object."""
    lines = with_row_numbers(spark.read.text(path), 1, "row")
    return _json_rows(lines.select("row", F.try_parse_json("value").alias("value"), F.col("value").alias("text")).where(F.trim("text") != "").drop("text"))


def _object_keys(good: DataFrame) -> list[tuple[str, str | None]]:
    """(key, nested key) of the objects; the union over all rows, in order of first appearance by row."""
    tvf = good.sparkSession.tvf
    top = good.select("row", F.col("value").alias("v")).lateralJoin(tvf.variant_explode(F.col("v").outer())).select("row", F.col("pos").alias("p"), F.col("key").alias("k"), F.when(F.schema_of_variant("value").startswith("OBJECT"), F.col("value")).alias("w"))
    every = top.lateralJoin(tvf.variant_explode_outer(F.col("w").outer())).select("row", "p", "k", F.col("pos").alias("q"), F.col("key").alias("sub"))
    found = every.groupBy("k", "sub").agg(F.min("row").alias("at"), F.min("p").alias("p"), F.min("q").alias("q")).orderBy("at", "p", "q").collect()  # column names, not rows
    nested = {r.k for r in found if r.sub is not None}
    out = [(r.k, r.sub) for r in found if r.sub is not None or r.k not in nested]
    return out


def _missing(good: DataFrame, raw: DataFrame, keys: list[tuple[str, str | None]]) -> DataFrame:
    top = [k for k, sub in keys if sub is None]
    if not top:
        return good.sparkSession.createDataFrame([], ERROR_RECORD)
    here = error_records(raw.select("_row", *[F.col(f"`{k}`") for k in top]), "_row")
    # only keys that the object has; an absent key is no error
    has = good.select(F.col("row"), F.map_keys(F.from_json(F.to_json("value"), "map<string,string>")).alias("ks"))
    return here.join(has, "row").where(F.array_contains("ks", F.col("column"))).drop("ks")


@dataclass
class Parsed:
    """A file as rows of text with a row number, its inferred types, and its error records."""

    rows: DataFrame
    types: dict[str, str]
    errors: DataFrame
    row_col: str = "_row"

    def preview(self, n: int = SAMPLE_ROWS) -> DataFrame:
        return self.rows.orderBy(self.row_col).limit(n).drop(self.row_col)

    def table(self) -> DataFrame:
        return typed(blank_to_null(self.rows.drop(self.row_col)), self.types)

    def total(self) -> int:
        return self.rows.count()


def file_kind(name: str) -> str:
    """csv, excel, json, json lines, parquet or orc by the ending."""
    end = os.path.splitext(name.lower())[1].lstrip(".")
    kinds = {"csv": "csv", "tsv": "csv", "txt": "csv", "xlsx": "excel", "xls": "excel", "json": "json", "jsonl": "json lines", "ndjson": "json lines", "parquet": "parquet", "orc": "orc"}
    if end not in kinds:
        raise ValueError(f"Unsupported file type: {end or name}")
    return kinds[end]


def parse_file(spark: SparkSession, path: str, kind: str | None = None, delimiter: str = ",", header: bool = True, sheet: str | None = None, root_path: str | None = None, trim: bool = False, skip_empty: bool = False) -> Parsed:
    """Any supported file as Parsed. Row numbers start at 1 (CSV with header, JSON) or 2 (the line below a header otherwise)."""
    kind = kind or file_kind(path)
    if kind in ("json", "json lines"):
        rows, errors = read_json(spark, path, root_path) if kind == "json" else read_json_lines(spark, path)
        types = infer_types(rows.drop("_row"), json_words=True, strays=STRAY_SHARE)
        return Parsed(rows, types, errors.unionByName(error_records(rows, "_row", types).where("severity = 'error'")))
    if kind in ("parquet", "orc"):
        rows = with_row_numbers(spark.read.format(kind).load(path))
        return Parsed(rows, {}, spark.createDataFrame([], ERROR_RECORD))
    if kind == "excel":
        excel.register(spark)
        reader = spark.read.format("crosslake_excel").option("path", path).option("header", str(header).lower())
        rows = (reader.option("sheet", sheet) if sheet else reader).load()
    else:
        rows = with_row_numbers(read_csv(spark, path, delimiter, header), 1 if header else 2)
    data = [c for c in rows.columns if c != "_row"]
    if trim:
        rows = rows.select("_row", *[F.trim(f"`{c}`").alias(c) for c in data])
    if skip_empty:
        rows = rows.where(F.coalesce(*[F.when(F.trim(f"`{c}`") != "", F.lit(1)) for c in data]).isNotNull())
    types = infer_types(rows.select(*[F.col(f"`{c}`") for c in data]), strays=STRAY_SHARE)
    return Parsed(rows, types, error_records(rows, "_row", types))


def auth_headers(auth: dict | None) -> dict[str, str]:
    """Request headers of none, bearer, basic or api_key."""
    auth = auth or {"type": "none"}
    kind = auth.get("type", "none")
    if kind == "bearer":
        return {"Authorization": f"Bearer {auth['token']}"}
    if kind == "basic":
        return {"Authorization": "Basic " + b64encode(f"{auth['username']}:{auth['password']}".encode()).decode()}
    if kind == "api_key":
        return {auth.get("header", "X-API-Key"): auth["key"]}
    if kind != "none":
        raise ValueError(f"Unknown auth type: {kind}")
    return {}


def _fetch(url: str, headers: dict[str, str]) -> tuple[bytes, str | None]:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=URL_TIMEOUT_S) as r:
        return r.read(MAX_URL_BYTES + 1), r.headers.get("Content-Type")


def parse_url(spark: SparkSession, url: str, auth: dict | None = None, headers: dict | None = None, folder: str | None = None, fetch: Callable[[str, dict], tuple[bytes, str | None]] = _fetch, **how: object) -> Parsed:
    """A file behind http or https; the type comes from the content type, else from the ending.

    ``folder`` is where the fetched bytes are kept for the executors, by default a part of
    the shared folder, which must then be one that the driver can write as files.
    """
    if not url.startswith(("http://", "https://")):
        raise ValueError("Only http and https URLs are supported")
    data, content = fetch(url, (headers or {}) | auth_headers(auth))
    if len(data) > MAX_URL_BYTES:
        raise ValueError(f"File exceeds {MAX_URL_BYTES} bytes")
    words = {"csv": "csv", "json": "json", "spreadsheet": "excel", "excel": "excel", "parquet": "parquet"}
    kind = next((k for w, k in words.items() if w in (content or "").lower()), None) or file_kind(url.split("?")[0])
    if folder is None:
        folder = shared_dir(spark).removeprefix("file://")
        if "://" in folder:
            raise ValueError("Name a folder of the file system that all executors share")
        os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile(delete=False, dir=folder, suffix={"excel": ".xlsx"}.get(kind, f".{kind}")) as f:
        f.write(data)
    return parse_file(spark, f.name, kind, **how)


def spark_schema(types: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(c, SPARK_TYPES.get(t, T.StringType())) for c, t in types.items()])
