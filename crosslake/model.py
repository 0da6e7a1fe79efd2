"""Records the engine exchanges: descriptors, results, run records, and their Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_s, _l, _i, _d, _t = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ERROR_RECORD = _struct(row=_l, column=_s, value=_s, error=_s, type=_s, severity=_s, suggestion=_s)
COLUMN_PROFILE = _struct(name=_s, data_type=_s, total_rows=_l, null_count=_l, null_percent=_d, distinct_count=_l, distinct_percent=_d, min=_s, max=_s, avg=_d, stddev=_d)
CHECK_RUN = _struct(check_id=_s, status=_s, actual_value=_d, expected_desc=_s, error_message=_s, duration_ms=_i, ran_at=_t)
STEP_RESULT = _struct(status=_s, started_at=_s, completed_at=_s, error=_s, rows_processed=_l)
LINEAGE_NODE = _struct(id=_s, type=_s, label=_s, metadata=T.MapType(_s, _s))
LINEAGE_EDGE = _struct(id=_s, source=_s, target=_s, type=_s, label=_s, metadata=T.MapType(_s, _s))
QUERY_HISTORY = _struct(id=_s, connection_id=_s, organization_id=_s, sql_query=_s, executed_at=_t, execution_time_ms=_i, row_count=_l, status=_s, error_message=_s)


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    is_primary_key: bool = False


@dataclass(frozen=True)
class TableInfo:
    schema: str | None
    name: str
    type: str = "table"


@dataclass
class QueryResult:
    """A result that is still distributed; ``row_count`` is the full count where the caller asked for it, ``truncated`` tells that a cap left rows out."""

    df: DataFrame
    row_count: int | None = None
    elapsed_ms: int | None = None
    truncated: bool = False

    @property
    def fields(self) -> list[dict[str, str]]:
        return [{"name": f.name, "type": type_name(f.dataType)} for f in self.df.schema.fields]


def type_name(t: T.DataType) -> str:
    """The file-and-result type word of a Spark type."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return "json"
    return "unknown" if isinstance(t, T.NullType) else "text"


SPARK_TYPES = {"integer": _l, "numeric": _d, "boolean": T.BooleanType(), "timestamp": _t, "text": _s}


@dataclass
class EngineConfig:
    """Limits of one organization."""

    sql_validation_enabled: bool = True
    allowed_sql_operations: tuple[str, ...] = ("SELECT",)
    max_rows_limit: int = 10_000
    query_timeout_s: float = 30
    cross_query_timeout_s: float = 180
    transformation_timeout_s: float = 300
    cross_query_cap: int = 50_000
    profile_sample_rows: int | None = None
    max_profile_columns: int = 200
    retention_days: int = 90
    extra: dict[str, Any] = field(default_factory=dict)
