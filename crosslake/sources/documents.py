"""Document collections: find and aggregate specifications compiled to DataFrame plans."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from operator import and_, or_
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslake.model import ColumnInfo

DEFAULT_LIMIT, MAX_LIMIT, SCHEMA_SAMPLE = 1000, 10_000, 20


def _field(name: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in name.split(".")))


def _lit(v: object) -> Column:
    return F.lit(v)


def _condition(c: Column, cond: object) -> Column:
    if not isinstance(cond, dict) or not any(k.startswith("$") for k in cond):
        return c.isNull() if cond is None else c == _lit(cond)
    ops = {
        "$eq": lambda v: c.isNull() if v is None else c == _lit(v), "$ne": lambda v: c.isNotNull() if v is None else (c != _lit(v)) | c.isNull(),
        "$gt": lambda v: c > _lit(v), "$gte": lambda v: c >= _lit(v), "$lt": lambda v: c < _lit(v), "$lte": lambda v: c <= _lit(v),
        "$in": lambda v: _in(c, v), "$nin": lambda v: ~F.coalesce(_in(c, v), F.lit(False)),
        "$exists": lambda v: c.isNotNull() if v else c.isNull(), "$not": lambda v: ~F.coalesce(_condition(c, v), F.lit(False)),
        "$regex": lambda v: c.rlike(("(?i)" if "i" in str(cond.get("$options", "")) else "") + v), "$options": lambda v: F.lit(True),
        "$size": lambda v: F.size(c) == v, "$all": lambda v: reduce(and_, [F.array_contains(c, x) for x in v]), "$mod": lambda v: c % v[0] == v[1],
    }
    bad = [k for k in cond if k not in ops]
    if bad:
        raise ValueError(f"Unknown filter operator: {bad[0]}")
    return reduce(and_, [ops[k](v) for k, v in cond.items()])


def _in(c: Column, values: list) -> Column:
    plain = [v for v in values if v is not None]
    out = c.isin(*plain) if plain else F.lit(False)
    return out | c.isNull() if len(plain) < len(values) else out


def filter_column(spec: dict) -> Column:
    """A filter document as a predicate: fields, $and, $or, $nor, and the comparison operators."""
    parts = []
    for k, v in spec.items():
        if k in ("$and", "$or", "$nor"):
            inner = reduce(and_ if k == "$and" else or_, [filter_column(x) for x in v])
            parts.append(~F.coalesce(inner, F.lit(False)) if k == "$nor" else inner)
        else:
            parts.append(_condition(_field(k), v))
    return reduce(and_, parts) if parts else F.lit(True)


def _expr(e: object) -> Column:
    """An aggregation expression: $field, a literal, or an operator."""
    if isinstance(e, str) and e.startswith("$"):
        return _field(e[1:])
    if isinstance(e, dict) and len(e) == 1:
        (op, v), args = next(iter(e.items())), None
        args = [_expr(x) for x in (v if isinstance(v, list) else [v])]
        table = {
            "$add": lambda: reduce(lambda a, b: a + b, args), "$subtract": lambda: args[0] - args[1], "$multiply": lambda: reduce(lambda a, b: a * b, args), "$divide": lambda: F.try_divide(args[0], args[1]),
            "$concat": lambda: F.concat(*args), "$toUpper": lambda: F.upper(args[0]), "$toLower": lambda: F.lower(args[0]), "$size": lambda: F.size(args[0]), "$abs": lambda: F.abs(args[0]),
            "$ifNull": lambda: F.coalesce(*args), "$eq": lambda: args[0] == args[1], "$gt": lambda: args[0] > args[1], "$lt": lambda: args[0] < args[1], "$literal": lambda: F.lit(v),
            "$year": lambda: F.year(args[0]), "$month": lambda: F.month(args[0]), "$dayOfMonth": lambda: F.dayofmonth(args[0]), "$cond": lambda: F.when(args[0], args[1]).otherwise(args[2]),
        }
        if op in table:
            return table[op]()
        raise ValueError(f"Unknown expression: {op}")
    return F.lit(e)


def _accumulator(spec: dict) -> Column:
    (op, v) = next(iter(spec.items()))
    if op == "$count" or (op == "$sum" and v == 1):
        return F.count(F.lit(1))
    table = {"$sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first, "$last": F.last, "$push": F.collect_list, "$addToSet": F.collect_set, "$stdDevSamp": F.stddev_samp}
    if op not in table:
        raise ValueError(f"Unknown accumulator: {op}")
    return table[op](_expr(v))


def _project(df: DataFrame, spec: dict) -> DataFrame:
    keep = {k: v for k, v in spec.items() if v not in (0, False)}
    if not keep or set(keep) == set():
        return df.drop(*[k for k, v in spec.items() if v in (0, False)])
    cols = ["_id"] if "_id" in df.columns and spec.get("_id", 1) not in (0, False) and "_id" not in keep else []
    return df.select(*[F.col(c) for c in cols], *[(_field(k) if v in (1, True) else _expr(v)).alias(k) for k, v in keep.items()])


def aggregate(df: DataFrame, pipeline: list[dict], limit: int, collections: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The stages in order; a pipeline without $limit gets one at its end."""
    if not any("$limit" in s for s in pipeline):
        pipeline = [*pipeline, {"$limit": limit}]
    for stage in pipeline:
        (op, v) = next(iter(stage.items()))
        if op == "$match":
            df = df.where(filter_column(v))
        elif op == "$project":
            df = _project(df, v)
        elif op in ("$addFields", "$set"):
            df = df.withColumns({k: _expr(e) for k, e in v.items()})
        elif op == "$group":
            key, accs = v.get("_id"), {k: a for k, a in v.items() if k != "_id"}
            if isinstance(key, dict) and not any(k.startswith("$") for k in key):
                id_col = F.struct(*[_expr(e).alias(k) for k, e in key.items()])
            else:
                id_col = F.lit(None).cast("string") if key is None else _expr(key)
            df = df.groupBy(id_col.alias("_id")).agg(*[_accumulator(a).alias(k) for k, a in accs.items()]) if accs else df.select(id_col.alias("_id")).distinct()
        elif op == "$sort":
            df = df.orderBy(*[_field(k).asc_nulls_first() if d > 0 else _field(k).desc_nulls_last() for k, d in v.items()])
        elif op == "$limit":
            df = df.limit(v)
        elif op == "$skip":
            df = df.offset(v)
        elif op == "$unwind":
            path, keep = (v, False) if isinstance(v, str) else (v["path"], v.get("preserveNullAndEmptyArrays", False))
            df = df.withColumn(path[1:], (F.explode_outer if keep else F.explode)(_field(path[1:])))
        elif op == "$count":
            df = df.agg(F.count(F.lit(1)).alias(v))
        elif op == "$lookup":
            other = (collections or {})[v["from"]]
            per = other.groupBy(_field(v["foreignField"]).alias("__k")).agg(F.collect_list(F.struct(*other.columns)).alias(v["as"]))
            df = df.join(per, _field(v["localField"]) == F.col("__k"), "left").drop("__k").withColumn(v["as"], F.coalesce(v["as"], F.array()))
        else:
            raise ValueError(f"Unknown stage: {op}")
    return df


class Collections(Mapping):
    """Collections read by name when a specification asks for them."""

    def __init__(self, read: Callable[[str], DataFrame]) -> None:
        self._read, self._got = read, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._got:
            try:
                self._got[name] = self._read(name)
            except ValueError as e:
                raise KeyError(name) from e
        return self._got[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._got)

    def __len__(self) -> int:
        return len(self._got)


def mongo_query(collections: Mapping[str, DataFrame], text: str) -> DataFrame:
    """A JSON text {collection, filter, projection, limit} or {collection, pipeline, limit}."""
    try:
        spec = json.loads(text)
    except ValueError as e:
        raise ValueError("Document queries must be valid JSON") from e
    if not isinstance(spec, dict) or not spec.get("collection"):
        raise ValueError('Query JSON must include a "collection" field')
    if spec["collection"] not in collections:
        raise ValueError(f"Unknown collection: {spec['collection']}")
    df, limit = collections[spec["collection"]], min(spec.get("limit") or DEFAULT_LIMIT, MAX_LIMIT)
    if spec.get("pipeline"):
        return aggregate(df, spec["pipeline"], limit, collections)
    if spec.get("filter"):
        df = df.where(filter_column(spec["filter"]))
    if spec.get("projection"):
        df = _project(df, spec["projection"])
    return df.limit(limit)


def sample_columns(lines: DataFrame, column: str = "value", rows: int = SCHEMA_SAMPLE) -> list[ColumnInfo]:
    """The columns of documents given as JSON texts: keys of the first ``rows`` in order of appearance, the first type seen; _id is the key."""
    kinds: dict[str, str] = {}
    for r in lines.select(column).limit(rows).collect():
        for k, v in (json.loads(r[0]) or {}).items():
            kinds.setdefault(k, document_type(k, v))
    return [ColumnInfo(k, t, True, None, k == "_id") for k, t in kinds.items()]


def document_type(name: str, v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, dict):
        return "objectid" if set(v) == {"$oid"} else "date" if set(v) == {"$date"} else "object"
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "array" if isinstance(v, list) else "string"


def serialized(df: DataFrame) -> DataFrame:
    """Values as they leave the engine: binary in base64, times in ISO form, nested values as they are."""

    def out(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            return F.regexp_replace(F.base64(c), "[\r\n]", "").alias(f.name)  # in one line
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(f.name)
        return c

    return df.select(*map(out, df.schema.fields))


def connection_uri(host: str, port: int = 27017, database: str = "", username: str | None = None, password: str | None = None) -> str:
    """The URI of a document server; a host that is a URI already stays as it is."""
    if host.startswith(("mongodb://", "mongodb+srv://")):
        return host
    login = f"{quote(username, safe='')}:{quote(password or '', safe='')}@" if username else ""
    return f"mongodb://{login}{host}:{port}/{database}"
