"""Named connections, each a reader of tables; catalog listings; table scans."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslake.model import ColumnInfo, TableInfo, type_name
from crosslake.plans.guards import check_where
from crosslake.plans.query_def import TableRef
from crosslake.sources import embedded, sqlite
from crosslake.sources.documents import sample_columns

JDBC = {
    # type: (URL, driver class, default schema)
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", "public"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", None),
    "redshift": ("jdbc:redshift://{host}:{port}/{database}", "com.amazon.redshift.jdbc.Driver", "public"),
    "snowflake": ("jdbc:snowflake://{host}/?db={database}", "net.snowflake.client.jdbc.SnowflakeDriver", "PUBLIC"),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", "dbo"),
    "clickhouse": ("jdbc:clickhouse://{host}:{port}/{database}", "com.clickhouse.jdbc.ClickHouseDriver", None),
    "derby": ("jdbc:derby:{database}", "org.apache.derby.iapi.jdbc.AutoloadedDriver", None),
}
PORTS = {"postgresql": 5432, "mysql": 3306, "redshift": 5439, "sqlserver": 1433, "clickhouse": 8123}
FILE_TYPES = ("parquet", "csv", "json", "orc")
NATIVE = (*JDBC, "sqlite", "bigquery")  # take SQL of their own
JDBC_TASKS = 16
MATERIALISED_LIMIT = 10_000


@dataclass
class Connection:
    id: str
    name: str
    type: str
    organization_id: str = "default"
    options: dict[str, str] = field(default_factory=dict)


class UnknownConnection(KeyError):
    def __init__(self, id_: str) -> None:
        super().__init__(f"Connection not found: {id_}")


class ConnectionRegistry:
    """Connections of one session. ``read`` gives a table lazily; nothing is copied ahead of a query, but for embedded databases on a cluster."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._by_id, self._readers = spark, {}, {}

    def add(self, c: Connection) -> Connection:
        if c.type not in (*JDBC, *FILE_TYPES, "sqlite", "bigquery", "mongodb", "staging", "frames"):
            raise ValueError(f"Unsupported connection type: {c.type}")
        self._by_id[c.id] = c
        return c

    def add_frames(self, id_: str, frames: dict[str, DataFrame] | Callable[[str], DataFrame], organization_id: str = "default") -> Connection:
        """A connection over DataFrames that exist already."""
        self._readers[id_] = frames.__getitem__ if isinstance(frames, dict) else frames
        return self.add(Connection(id_, id_, "frames", organization_id, {"tables": ",".join(frames)} if isinstance(frames, dict) else {}))

    def get(self, id_: str, organization_id: str | None = None) -> Connection:
        c = self._by_id.get(id_)
        if c is None or (organization_id is not None and c.organization_id != organization_id):
            raise UnknownConnection(id_)
        return c

    def remove(self, id_: str) -> None:
        self.get(id_)
        del self._by_id[id_]

    def list(self, organization_id: str | None = None) -> list[Connection]:
        return [c for c in self._by_id.values() if organization_id in (None, c.organization_id)]

    # reading

    def _jdbc(self, c: Connection) -> dict[str, str]:
        url, driver, _ = JDBC[c.type]
        o = {"port": str(PORTS.get(c.type, "")), "host": "localhost", "database": ""} | c.options
        out = {"url": c.options.get("url") or url.format(**o), "driver": c.options.get("driver", driver)}
        if c.type == "redshift" and c.options.get("ssl", "true") != "false":
            out["ssl"] = "true"
        keep = ("user", "password", "fetchsize", "partitionColumn", "lowerBound", "upperBound", "numPartitions", "customSchema", "sessionInitStatement")
        return out | {k: v for k, v in c.options.items() if k in keep}

    def read(self, connection_id: str, table: str, schema: str | None = None, query: str | None = None, organization_id: str | None = None) -> DataFrame:
        """A table of a connection, or the result of ``query`` in the connection's own SQL."""
        if connection_id == "staging":
            return self.spark.table(f"{schema}.{table}" if schema else table)
        c = self.get(connection_id, organization_id)
        if c.type == "frames":
            try:
                return self._readers[c.id](table)
            except KeyError as e:
                raise ValueError(f"Unknown table: {table}") from e
        if c.type in FILE_TYPES:
            if not table or table.startswith(".") or any(x in table for x in "/\\:*?{}[]"):
                raise ValueError(f"Unknown table: {table}")  # a path, not a name
            reader = self.spark.read.format(c.type)
            if c.type == "csv":
                reader = reader.options(header=c.options.get("header", "true"), sep=c.options.get("sep", ","), escape='"')
            path = c.options["path"]
            for candidate in (f"{path}/{table}.{c.type}", f"{path}/{table}"):
                if "://" in path or os.path.exists(candidate):
                    return reader.load(candidate)
            raise ValueError(f"Unknown table: {table}")
        if c.type == "sqlite":
            sqlite.register(self.spark)
            reader = self.spark.read.format("crosslake_sqlite").option("path", c.options["path"])
            return (reader.option("query", query) if query else reader.option("table", table)).load()
        if c.type == "bigquery":
            reader = self.spark.read.format("bigquery").options(**c.options)  # needs the vendor's connector on the class path
            return reader.option("query", query).load() if query else reader.load(f"{schema}.{table}" if schema else table)
        if c.type == "mongodb":
            reader = self.spark.read.format("mongodb").options(**c.options)
            return reader.option("collection", table).load()
        default = JDBC[c.type][2]
        name = f"{schema or default}.{table}" if schema or default else table
        if c.type == "snowflake":
            name = name.upper()
        options = self._jdbc(c)
        whole = {k: v for k, v in options.items() if k not in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")}
        if embedded.by_driver(self.spark, options["url"]):
            return embedded.read(self.spark, whole, query=query) if query else embedded.read(self.spark, whole, table=name)
        if query:
            return self.spark.read.format("jdbc").options(**whole).option("query", query).load()
        return self.spark.read.format("jdbc").options(**self._divided(c, options, name, table, schema)).option("dbtable", name).load()

    def _divided(self, c: Connection, options: dict[str, str], name: str, table: str, schema: str | None) -> dict[str, str]:
        """Options that read a table in ranges of a numeric column, whose bounds are asked of the database.

        The column is ``partitionColumn`` of the connection (for several tables ``{table}.partitionColumn``),
        else a whole-number primary key where the catalog tells of one; a table without either is read by one task.
        """
        column = c.options.get(f"{table}.partitionColumn") or c.options.get("partitionColumn")
        if {"lowerBound", "upperBound"} <= options.keys():
            return options
        if not column and c.type in ("postgresql", "mysql", "sqlserver"):
            column = next((x.name for x in self.columns(c.id, table, schema) if x.is_primary_key and "int" in x.type.lower()), None)
        options = {k: v for k, v in options.items() if k not in ("partitionColumn", "lowerBound", "upperBound")}
        if not column:
            return options
        mark = "`" if c.type == "mysql" else '"'
        names = self.spark.read.format("jdbc").options(**options).option("dbtable", name).load().columns
        quoted = mark + next((x for x in names if x.lower() == column.lower()), column) + mark
        low, high = self.spark.read.format("jdbc").options(**options).option("query", f"select min({quoted}) as lo, max({quoted}) as hi from {name}").load().first()
        if low is None or low == high:
            return options
        return {"numPartitions": str(JDBC_TASKS)} | options | {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high)}

    def resolve(self, ref: TableRef, organization_id: str | None = None) -> DataFrame:
        """A table of a query definition."""
        return self.read(ref.connection_id, ref.table, ref.schema, ref.source_query, organization_id)

    def scan(self, connection_id: str, table: str, schema: str | None = None, columns: list[str] | None = None, where: str | None = None, limit: int | None = None, organization_id: str | None = None) -> DataFrame:
        """Part of a table for an import; a raw condition passes a guard first."""
        df = self.read(connection_id, table, schema, organization_id=organization_id)
        if where:
            check_where(where)
            df = df.where(where)
        if columns:
            df = df.select(*[F.col(f"`{c}`") for c in columns])
        return df.limit(limit) if limit else df

    def materialised(self, connection_id: str, table: str, schema: str | None = None, query: str | None = None, limit: int | None = MATERIALISED_LIMIT) -> DataFrame:
        """A source as text columns, as sources without a native scan are handed to cross-source queries; ``limit`` applies without a query."""
        df = self.read(connection_id, table, schema, query)
        df = df.limit(limit) if limit and not query else df
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])

    def test(self, connection_id: str) -> tuple[bool, str | None]:
        """(whether it answers, the error)."""
        try:
            c = self.get(connection_id)
            if c.type in JDBC:
                self.read(c.id, "", query="select 1 as one" + (" from sysibm.sysdummy1" if c.type == "derby" else "")).limit(1).collect()
            elif c.type == "bigquery":
                self.read(c.id, "", query="select 1 as one").limit(1).collect()
            elif c.type in ("mongodb", "frames"):
                for t in self.tables(c.id)[:1]:
                    self.read(c.id, t.name).limit(1).collect()
            elif c.type in FILE_TYPES or c.type == "sqlite":
                if not os.path.exists(c.options["path"]) and "://" not in c.options["path"]:
                    return False, f"No such path: {c.options['path']}"
                self.tables(c.id)
            return True, None
        except Exception as e:  # noqa: BLE001 - any failure is the answer
            return False, str(e).splitlines()[0]

    # catalogs

    def schemas(self, connection_id: str) -> list[str]:
        if connection_id == "staging":
            return [d.name for d in self.spark.catalog.listDatabases() if d.name.startswith("staging_")]
        c = self.get(connection_id)
        return ["main"] if c.type == "sqlite" else [JDBC[c.type][2] or "default"] if c.type in JDBC else ["default"]

    def tables(self, connection_id: str, schema: str | None = None) -> list[TableInfo]:
        if connection_id == "staging":
            return [TableInfo(schema, t.name, "view" if t.tableType == "VIEW" else "table") for t in self.spark.catalog.listTables(schema) if not t.isTemporary]
        c = self.get(connection_id)
        if c.type == "sqlite":
            return sqlite.tables(c.options["path"])
        if c.type in FILE_TYPES:
            end = f".{c.type}"
            return [TableInfo(None, n.removesuffix(end)) for n in sorted(os.listdir(c.options["path"])) if n.endswith(end)]
        if c.type == "frames":
            return [TableInfo(None, n) for n in c.options.get("tables", "").split(",") if n]
        if c.type in ("postgresql", "redshift", "mysql", "sqlserver", "snowflake"):
            rows = self.read(c.id, "", query="select table_schema as s, table_name as n, table_type as t from information_schema.tables").collect()  # a catalog
            return [TableInfo(r[0], r[1], "view" if "VIEW" in r[2].upper() else "table") for r in rows if schema in (None, r[0])]
        if c.type == "clickhouse":
            rows = self.read(c.id, "", query="select database, name, engine from system.tables").collect()  # a catalog
            return [TableInfo(r[0], r[1], "view" if "View" in r[2] else "table") for r in rows if schema in (None, r[0])]
        if c.type == "bigquery":
            of = schema or c.options.get("dataset")
            if not of:
                raise ValueError("Name the dataset whose tables are asked for")
            rows = self.read(c.id, "", query=f"select table_name, table_type from `{of}`.INFORMATION_SCHEMA.TABLES").collect()  # a catalog
            return [TableInfo(of, r[0], "view" if "VIEW" in r[1].upper() else "table") for r in rows]
        if c.type == "mongodb":
            # the connector lists none; a connection names its own
            return [TableInfo(c.options.get("database"), n.strip()) for n in c.options.get("collections", "").split(",") if n.strip()]
        raise ValueError(f"{c.type} has no listing of tables")

    def columns(self, connection_id: str, table: str, schema: str | None = None) -> list[ColumnInfo]:
        if connection_id != "staging" and self.get(connection_id).type == "sqlite":
            return sqlite.columns(self.get(connection_id).options["path"], table)
        if connection_id != "staging" and self.get(connection_id).type in ("postgresql", "mysql", "sqlserver"):
            where = f"table_name = '{table}'" + (f" and table_schema = '{schema}'" if schema else "")
            if "'" in table or "'" in (schema or ""):
                raise ValueError("Bad table name")
            listed = self.read(connection_id, "", query=f"select table_schema, table_name, column_name, data_type, is_nullable, column_default, ordinal_position from information_schema.columns where {where}")
            keys = self.read(connection_id, "", query=f"select k.table_schema, k.table_name, k.column_name from information_schema.table_constraints c join information_schema.key_column_usage k on c.constraint_name = k.constraint_name and c.table_schema = k.table_schema and c.table_name = k.table_name where c.constraint_type = 'PRIMARY KEY' and k.{where.replace(' and ', ' and k.')}")
            return [ColumnInfo(r.column_name, r.data_type, r.is_nullable == "YES", r.column_default, r.is_primary_key) for r in with_primary_keys(listed, keys).orderBy("ordinal_position").collect()]  # one table's columns
        if connection_id != "staging" and self.get(connection_id).type == "clickhouse":
            if "'" in table or "'" in (schema or ""):
                raise ValueError("Bad table name")
            where = f"table = '{table}'" + (f" and database = '{schema}'" if schema else "")
            rows = self.read(connection_id, "", query=f"select name, type, default_expression, is_in_primary_key from system.columns where {where} order by position").collect()  # one table's columns
            return [ColumnInfo(r[0], r[1], r[1].startswith("Nullable("), r[2] or None, bool(r[3])) for r in rows]
        if connection_id != "staging" and self.get(connection_id).type == "mongodb":
            lines = self.read(connection_id, table).select(F.to_json(F.struct("*")).alias("value"))
            return sample_columns(lines)
        return [ColumnInfo(f.name, f.dataType.simpleString(), f.nullable) for f in self.read(connection_id, table, schema).schema.fields]

    def staging_sizes(self, schema: str) -> dict[str, int]:
        """Bytes of each staging table, by the files' sizes."""
        out = {}
        for t in self.tables("staging", schema):
            stats = self.spark.table(f"{schema}.{t.name}")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
            out[t.name] = int(str(stats))
        return out


def with_primary_keys(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Columns of tables with is_primary_key; both sides have table_schema, table_name and column_name."""
    on = ["table_schema", "table_name", "column_name"]
    return columns.join(keys.select(*on).distinct().withColumn("__pk", F.lit(True)), on, "left").withColumn("is_primary_key", F.coalesce("__pk", F.lit(False))).drop("__pk")


def field_types(df: DataFrame) -> list[dict[str, str]]:
    return [{"name": f.name, "type": type_name(f.dataType)} for f in df.schema.fields]
