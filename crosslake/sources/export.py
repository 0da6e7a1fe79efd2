"""Exports: CSV in two quotings, JSON with its envelope, error lists, reports, catalog payloads.

CSV and JSON lines are built inside the plan and written in parallel; only reports of
counts are strings on the driver.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosslake.functions.common import ship
from crosslake.model import type_name
from crosslake.sources.registry import field_types

ERROR_COLUMNS = ("Row", "Column", "Value", "Error", "Type", "Severity", "Suggestion")


def _text(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType
    return F.to_json(F.col(f"`{c}`")) if type_name(t) == "json" else F.col(f"`{c}`").cast("string")


def _quoted(v: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(df: DataFrame, quote_all: bool = True) -> DataFrame:
    """The lines of a CSV file (column ``value``), without its header.

    ``quote_all`` quotes every value and leaves nulls empty; otherwise only values with a
    comma or a quote are quoted.
    """
    cells = []
    for c in df.columns:
        v = _text(df, c)
        cell = _quoted(v) if quote_all else F.when(F.contains(v, F.lit(",")) | F.contains(v, F.lit('"')), _quoted(v)).otherwise(v)
        cells.append(F.coalesce(cell, F.lit("")))
    return df.select(F.concat_ws(",", *cells).alias("value"))


def csv_header(df: DataFrame, quote_all: bool = True) -> str:
    return ",".join(f'"{c}"' if quote_all else c for c in df.columns)


def write_csv(df: DataFrame, path: str, quote_all: bool = True) -> None:
    """One header in each file, so that every part is a CSV file of its own."""
    ship(df.sparkSession)
    header = csv_header(df, quote_all)
    lines = csv_lines(df, quote_all)

    def headed(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": pa.array([header], pa.string())})
        for b in batches:
            yield pa.RecordBatch.from_pydict({"value": b.column(0).cast(pa.string())})

    lines.mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def write_excel_csv(df: DataFrame, path: str) -> None:
    """The spreadsheet export: CSV text, every value quoted."""
    write_csv(df, path, True)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def json_envelope(df: DataFrame, exported_at: datetime, most_rows: int = 10_000) -> str:
    """A whole result as one JSON document; more than ``most_rows`` is an error, json_lines has no bound."""
    rows = json_lines(df).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"Over {most_rows} rows; write json_lines instead")
    return json.dumps({"exportedAt": exported_at.isoformat(timespec="milliseconds") + "Z", "columnCount": len(df.columns), "rowCount": len(rows), "columns": df.columns, "fields": field_types(df), "rows": [json.loads(r.value) for r in rows]}, indent=2)


def error_lines(errors: DataFrame) -> DataFrame:
    """Error records as CSV lines, every value quoted; values are written as JSON."""
    as_json = F.coalesce(F.substring(F.to_json(F.array("value")), 2, 1 << 30), F.lit("null]"))
    value = F.expr("substring(v, 1, length(v) - 1)")
    e = errors.withColumn("v", as_json).withColumn("v", value)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("row", "column", "v", "error", "type", "severity", "suggestion")]
    return e.select(F.concat_ws(",", *[_quoted(c) for c in cells]).alias("value"))


def dashboard_report(sections: dict[str, dict | list[dict]], generated_at: datetime) -> str:
    """A sectioned CSV report of collected statistics."""
    out = [f"Dashboard Report,{generated_at.isoformat(timespec='seconds')}", ""]
    q = lambda v: '"' + str("" if v is None else v).replace('"', '""') + '"'
    for name, body in sections.items():
        out.append(name)
        if isinstance(body, dict):
            out += [f"{q(k)},{q(v)}" for k, v in body.items()]
        elif body:
            out.append(",".join(q(k) for k in body[0]))
            out += [",".join(q(v) for v in r.values()) for r in body]
        out.append("")
    return "\n".join(out)


def catalog_payload(services: DataFrame, tables: DataFrame, pipelines: DataFrame, edges: DataFrame, history: DataFrame, now: Column, days: int = 7, queries: int = 500) -> DataFrame:
    """What a metadata catalog is told: kind, name and JSON body of services, tables, pipelines, lineage edges, and the latest queries."""
    body = lambda df: F.to_json(F.struct(*df.columns))
    recent = history.where(F.col("executed_at") > now - F.make_dt_interval(F.lit(days))).orderBy(F.desc("executed_at"), "id").limit(queries)
    part = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), body(df).alias("body"))
    return part(services, "service", "name").unionByName(part(tables, "table", "name")).unionByName(part(pipelines, "pipeline", "name")).unionByName(part(edges, "edge", "id")).unionByName(part(recent, "query", "id"))


def catalog_changes(payload: DataFrame, known: DataFrame) -> DataFrame:
    """The payload against what a catalog knows (kind, name, body): the entries to send, each with ``action``, created or updated; equal ones are left out.

    Entries with the same kind and name count once, the one with the greatest body.
    """
    at = ["kind", "name"]
    new = payload.groupBy(*at).agg(F.max("body").alias("body"))
    old = known.groupBy(*at).agg(F.max("body").alias("known"))
    met = new.join(old, at, "left").where(~F.col("body").eqNullSafe(F.col("known")))
    return met.select(*at, "body", F.when(F.col("known").isNull(), "created").otherwise("updated").alias("action"))


def payload_counts(payload: DataFrame) -> DataFrame:
    return payload.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
