"""SQLite files as a Spark data source, with the standard library only.

Rows are read in ranges of rowid, one partition for each, and simple filters reach SQLite.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from crosslake.functions.common import ship
from crosslake.model import ColumnInfo, TableInfo

BATCH = 5_000


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str | None) -> T.DataType:
    """The type by SQLite's affinity of the declared type."""
    d = (declared or "").upper()
    if "INT" in d:
        return T.LongType()
    if any(w in d for w in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    if any(w in d for w in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.BooleanType() if "BOOL" in d else T.StringType()


def tables(path: str) -> list[TableInfo]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return [TableInfo("main", n, k) for n, k in c.execute("select name, type from sqlite_master where type in ('table', 'view') and name not like 'sqlite_%' order by name")]


def columns(path: str, table: str) -> list[ColumnInfo]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        return [ColumnInfo(n, t, not need, default, pk > 0) for _, n, t, need, default, pk in c.execute(f"pragma table_info({_quote(table)})")]


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


def _value(v: object, t: T.DataType) -> object:
    if v is None:
        return None
    if isinstance(t, T.StringType):
        return v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
    if isinstance(t, T.BinaryType):
        return v if isinstance(v, bytes) else str(v).encode()
    try:
        return bool(v) if isinstance(t, T.BooleanType) else int(v) if isinstance(t, T.LongType) else float(v)
    except (TypeError, ValueError):
        return None  # a column may hold values of other types than the declared one


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.o, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        n = int(self.o.get("numpartitions", "4"))
        if "table" not in self.o or n < 2:
            return [_Range(None, None)]
        try:
            with sqlite3.connect(f"file:{self.o['path']}?mode=ro", uri=True) as c:
                low, high = c.execute(f"select min(rowid), max(rowid) from {_quote(self.o['table'])}").fetchone()
        except sqlite3.OperationalError:  # views and tables without rowid
            return [_Range(None, None)]
        if low is None:
            return [_Range(None, None)]
        step = max(1, -(-(high - low + 1) // n))
        return [_Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fields = self.schema.fields
        names = ", ".join(_quote(f.name) for f in fields)
        source = _quote(self.o["table"]) if "table" in self.o else f"({self.o['query']})"
        sql = f"select {names} from {source}"
        if partition.low is not None:
            sql += f" where rowid between {partition.low} and {partition.high}"
        with sqlite3.connect(f"file:{self.o['path']}?mode=ro", uri=True) as c:
            cursor = c.execute(sql)
            while rows := cursor.fetchmany(BATCH):
                for r in rows:
                    yield tuple(_value(v, f.dataType) for v, f in zip(r, fields))


class SqliteSource(DataSource):
    """Options: path, and table or query; numPartitions (ranges of rowid, for tables)."""

    @classmethod
    def name(cls) -> str:
        return "crosslake_sqlite"

    def schema(self) -> T.StructType:
        if "table" in self.options:
            return T.StructType([T.StructField(c.name, spark_type(c.type)) for c in columns(self.options["path"], self.options["table"])])
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            cursor = c.execute(f"select * from ({self.options['query']}) limit 1")
            first = cursor.fetchone() or ()
            kinds = {int: T.LongType(), float: T.DoubleType(), bytes: T.BinaryType()}
            return T.StructType([T.StructField(d[0], kinds.get(type(first[i]) if i < len(first) else str, T.StringType())) for i, d in enumerate(cursor.description)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SqliteSource)
