"""Guarded SQL over named connections: caps, paging, history, cached results, cancellable timeouts."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslake.functions.common import checkpointed, shared_dir
from crosslake.model import QUERY_HISTORY, EngineConfig, QueryResult
from crosslake.plans import guards
from crosslake.plans.binding import bind
from crosslake.plans.query_def import QueryDefinition, TableRef, compile_query, to_sql
from crosslake.sources.documents import Collections, mongo_query
from crosslake.sources.files import with_row_numbers
from crosslake.sources.registry import NATIVE, ConnectionRegistry
from crosslake.sources.staging import staging_schema


class QueryTimeout(TimeoutError):
    pass


def with_timeout(spark: SparkSession, seconds: float, run: Callable[[], Any], what: str = "Query") -> Any:
    """Runs actions in a thread with a job group of its own; at the deadline the group's jobs are cancelled."""
    group = f"crosslake-{uuid.uuid4().hex}"

    def work() -> Any:
        spark.sparkContext.setJobGroup(group, what, True)
        return run()

    pool = ThreadPoolExecutor(1)
    try:
        future = pool.submit(inheritable_thread_target(spark)(work))
        return future.result(timeout=seconds)
    except FutureTimeout as e:
        if future.done():
            raise
        spark.sparkContext.cancelJobGroup(group)
        raise QueryTimeout(f"{what} timeout after {seconds:g} s") from e
    finally:
        pool.shutdown(wait=False)


def page(df: DataFrame, limit: int | None = None, offset: int = 0, most: int = 10_000, default: int = 1000) -> DataFrame:
    """A page of at most ``most`` rows; the order is the DataFrame's own, so it should end in a unique key."""
    limit = min(limit or default, most)
    return (df.offset(offset) if offset else df).limit(limit)


def page_info(total: int, size: int = 100) -> list[tuple[int, int, int]]:
    """(page, first row, end) for a result of ``total`` rows."""
    return [(i, i * size, min((i + 1) * size, total)) for i in range(-(-total // size))]


def numbered_pages(df: DataFrame, order: list, size: int = 100) -> DataFrame:
    """Adds row_no and page_no in a total order.

    The rows are sorted by range over all tasks; each partition numbers its own, from the counts of those before.
    """
    got = with_row_numbers(checkpointed(df.orderBy(*order)), 0, "row_no")
    return got.withColumn("page_no", F.floor(F.col("row_no") / size).cast("int"))


@dataclass
class HistoryEntry:
    id: str
    connection_id: str | None
    organization_id: str
    sql_query: str
    executed_at: datetime
    execution_time_ms: int | None = None
    row_count: int | None = None
    status: str = "success"
    error_message: str | None = None


@dataclass
class QueryEngine:
    """One organization's queries over a registry of connections."""

    spark: SparkSession
    registry: ConnectionRegistry
    organization_id: str = "default"
    config: EngineConfig = field(default_factory=EngineConfig)
    history: list[HistoryEntry] = field(default_factory=list)
    saved: dict[str, dict] = field(default_factory=dict)
    clock: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None)

    def __post_init__(self) -> None:
        self._lock = threading.Lock()

    def _record(self, connection_id: str | None, sql: str, started: float, rows: int | None, error: str | None) -> HistoryEntry:
        e = HistoryEntry(uuid.uuid4().hex, connection_id, self.organization_id, sql, self.clock(), int((time.time() - started) * 1000), rows, "error" if error else "success", error)
        with self._lock:
            self.history.append(e)
        return e

    def history_frame(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(vars(e).values()) for e in self.history], QUERY_HISTORY)

    def history_page(self, limit: int = 50, offset: int = 0) -> tuple[list[HistoryEntry], int]:
        newest = sorted(self.history, key=lambda e: e.executed_at, reverse=True)
        return newest[offset : offset + limit], len(newest)

    def _table(self, connection_id: str | None) -> Callable[[tuple[str, ...]], DataFrame]:
        """Names of a text as tables of its connection; without one, as this organization's staging tables."""

        def find(parts: tuple[str, ...]) -> DataFrame:
            if len(parts) > 2:
                raise ValueError(f"Unknown table: {'.'.join(parts)}")
            schema = parts[0] if len(parts) == 2 else None
            if connection_id and connection_id != "staging":
                return self.registry.read(connection_id, parts[-1], schema, organization_id=self.organization_id)
            own = staging_schema(self.organization_id)
            if (schema or own).lower() != own or not self.spark.catalog.tableExists(f"`{own}`.`{parts[-1]}`"):
                raise ValueError(f"Unknown table: {'.'.join(parts)}")
            return self.registry.read("staging", parts[-1], own)

        return find

    def sql(self, text: str, connection_id: str | None = None, native: bool | None = None) -> DataFrame:
        """The plan of a guarded text over one connection's tables, of which it can name no others.

        Databases get the text as it is, in their own SQL, so that they join, aggregate and
        limit where the data lies (``native=False`` plans it here over their tables); document
        stores take a find or aggregate specification in JSON; everything else is planned here.
        """
        if connection_id and connection_id != "staging":
            c = self.registry.get(connection_id, self.organization_id)
            if c.type == "mongodb" or text.lstrip().startswith("{"):
                return mongo_query(Collections(lambda name: self.registry.read(c.id, name, organization_id=self.organization_id)), text)
        if not guards.is_safe_query(text):
            raise guards.UnsafeSql("SQL query contains potentially dangerous patterns or commands")
        if connection_id and connection_id != "staging" and (native if native is not None else c.type in NATIVE):
            if guards.operation_of(text) != "SELECT":
                raise guards.UnsafeSql("Only queries can be sent to a database")
            return self.registry.read(c.id, "", query=text.strip().rstrip(";"), organization_id=self.organization_id)
        return bind(self.spark, text, self._table(connection_id))

    def execute(self, text: str, connection_id: str | None = None, cache: bool = False, cap: int | None = None, count_all: bool = False) -> tuple[list, QueryResult]:
        """(rows up to the cap, result), which tells by ``truncated`` whether there are more.

        The cap is part of the plan; ``count_all`` also counts what lies beyond it. ``sql``
        gives the same result without a cap, for what is written or processed further.
        """
        started, cap = time.time(), cap or self.config.max_rows_limit
        try:
            df = self.sql(text, connection_id)
            rows, total = with_timeout(self.spark, self.config.query_timeout_s, lambda: (df.limit(cap + 1).collect(), df.count() if count_all else None))
            rows, cut, capped = rows[:cap], len(rows) > cap, df.limit(cap)
            total = total if count_all else len(rows)
            e = self._record(connection_id, text, started, total, None)
            if cache:
                self.cache_result(e.id, capped)
            return rows, QueryResult(capped, total, e.execution_time_ms, cut)
        except Exception as x:
            self._record(connection_id, text, started, None, str(x).splitlines()[0])
            raise

    def staged(self, name: str) -> DataFrame:
        """A staging table of this organization."""
        return self._table("staging")(tuple(name.split(".")))

    def staging(self, text: str, schema: str) -> DataFrame:
        guards.check_staging_query(text, schema)
        if schema.lower() != staging_schema(self.organization_id):
            raise guards.UnsafeSql(f"Not a staging schema of this organization: {schema}")
        return bind(self.spark, text, self._table("staging")).limit(self.config.max_rows_limit)

    def generated(self, text: str, connection_id: str | None = None) -> tuple[DataFrame, guards.Validation]:
        """SQL that another program wrote: validated, limited, planned."""
        v = guards.validate_generated(text, self.config)
        if not v.is_valid:
            raise guards.UnsafeSql("; ".join(v.errors))
        return self.sql(guards.add_limit(v.sanitized or text, self.config.max_rows_limit), connection_id), v

    def shared(self, text: str, connection_id: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        guards.check_share_query(text)
        return page(self.sql(text, connection_id), limit, offset)

    # cached results

    def _cache_path(self, id_: str) -> str:
        if not re.fullmatch(r"[\w-]+", id_):
            raise ValueError(f"Bad id: {id_}")
        return f"{shared_dir(self.spark)}/results/{self.organization_id}/{id_}"

    def cache_result(self, id_: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._cache_path(id_))

    def cached(self, id_: str) -> DataFrame:
        return self.spark.read.parquet(self._cache_path(id_))

    # cross-source definitions

    def cross_query(self, d: QueryDefinition | dict, typed_joins: bool = False, capped: bool = True) -> DataFrame:
        """The plan of a definition; the cap is for rows that a client gets, not for what is written or counted."""
        d = QueryDefinition.from_dict(d) if isinstance(d, dict) else d
        df = compile_query(d, self._resolve, typed_joins)
        return df.limit(self.config.cross_query_cap) if capped else df

    def _resolve(self, ref: TableRef) -> DataFrame:
        if ref.connection_id == "staging":
            return self._table("staging")((ref.schema, ref.table) if ref.schema else (ref.table,))
        return self.registry.resolve(ref, self.organization_id)

    def execute_cross(self, d: QueryDefinition | dict) -> tuple[list, QueryResult]:
        started, cap = time.time(), self.config.cross_query_cap
        df = self.cross_query(d, capped=False)
        rows = with_timeout(self.spark, self.config.cross_query_timeout_s, df.limit(cap + 1).collect, "Cross query")
        return rows[:cap], QueryResult(df.limit(cap), min(len(rows), cap), int((time.time() - started) * 1000), len(rows) > cap)

    def save_cross(self, name: str, d: dict, description: str | None = None, created_by: str = "") -> str:
        id_ = uuid.uuid4().hex
        now = self.clock()
        self.saved[id_] = {"id": id_, "name": name, "description": description, "query_definition": d, "generated_sql": to_sql(QueryDefinition.from_dict(d)), "organization_id": self.organization_id, "created_by": created_by, "created_at": now, "updated_at": now}
        return id_

    def run_saved(self, id_: str, capped: bool = True) -> DataFrame:
        s = self.saved.get(id_)
        if s is None or s["organization_id"] != self.organization_id:
            raise KeyError(f"Saved query not found: {id_}")
        return self.cross_query(s["query_definition"], capped=capped)
