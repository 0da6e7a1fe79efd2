"""Declarative query definitions: validation, compilation to a DataFrame, and SQL preview.

A definition names tables (by connection), joins, columns with optional aggregates, filters,
grouping, ordering and a limit. It is compiled to one logical plan, so Catalyst prunes
columns, pushes filters into the scans and chooses the joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TABLES, MAX_JOINS, MAX_LIMIT = 10, 8, 50_000
JOIN_TYPES = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}
COMPARE = ("=", "!=", ">", "<", ">=", "<=")
FILTERS = (*COMPARE, "LIKE", "IN", "IS NULL", "IS NOT NULL")
AGGREGATES = ("COUNT", "COUNT_DISTINCT", "SUM", "AVG", "MIN", "MAX")


@dataclass(frozen=True)
class TableRef:
    alias: str
    table: str
    connection_id: str = "default"
    schema: str | None = None
    source_query: str | None = None


@dataclass(frozen=True)
class JoinCondition:
    left_column: str
    operator: str
    right_column: str


@dataclass(frozen=True)
class Join:
    left_table: str
    right_table: str
    type: str = "INNER"
    conditions: tuple[JoinCondition, ...] = ()


@dataclass(frozen=True)
class OutColumn:
    table_alias: str
    column: str
    alias: str | None = None
    aggregate: str | None = None

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        # the names a database gives to an unnamed aggregate
        return {None: self.column, "COUNT_DISTINCT": "count"}.get(self.aggregate, (self.aggregate or "").lower())


@dataclass(frozen=True)
class Filter:
    table_alias: str
    column: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Order:
    table_alias: str
    column: str
    direction: str = "ASC"


@dataclass(frozen=True)
class QueryDefinition:
    tables: tuple[TableRef, ...]
    columns: tuple[OutColumn, ...]
    joins: tuple[Join, ...] = ()
    filters: tuple[Filter, ...] = ()
    group_by: tuple[tuple[str, str], ...] = ()
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    extra: dict = field(default_factory=dict)

    @staticmethod
    def from_dict(d: dict) -> QueryDefinition:
        """Reads the JSON form (camelCase keys)."""
        cond = lambda c: JoinCondition(c["leftColumn"], c.get("operator", "="), c["rightColumn"])
        return QueryDefinition(
            tables=tuple(TableRef(t["alias"], t["table"], t.get("connectionId", "default"), t.get("schema"), t.get("sourceQuery")) for t in d.get("tables") or ()),
            joins=tuple(Join(j["leftTable"], j["rightTable"], j.get("type", "INNER"), tuple(map(cond, j.get("conditions") or ()))) for j in d.get("joins") or ()),
            columns=tuple(OutColumn(c["tableAlias"], c["column"], c.get("alias"), c.get("aggregate")) for c in d.get("columns") or ()),
            filters=tuple(Filter(f["tableAlias"], f["column"], f["operator"], f.get("value")) for f in d.get("filters") or ()),
            group_by=tuple((g["tableAlias"], g["column"]) for g in d.get("groupBy") or ()),
            order_by=tuple(Order(o["tableAlias"], o["column"], o.get("direction", "ASC")) for o in d.get("orderBy") or ()),
            limit=d.get("limit"),
        )

    def to_dict(self) -> dict:
        return asdict(self)

    # edits of a definition, as a builder offers them

    def add_table(self, table: str, connection_id: str = "default", schema: str | None = None) -> QueryDefinition:
        """The alias is the table's name, numbered where it is taken."""
        taken, alias, n = {t.alias for t in self.tables}, table, 0
        while alias in taken:
            n += 1
            alias = f"{table}_{n}"
        return replace(self, tables=(*self.tables, TableRef(alias, table, connection_id, schema)))

    def remove_table(self, alias: str) -> QueryDefinition:
        """Drops the table with its joins and columns; filters and ordering stay as they are."""
        return replace(self, tables=tuple(t for t in self.tables if t.alias != alias), joins=tuple(j for j in self.joins if alias not in (j.left_table, j.right_table)), columns=tuple(c for c in self.columns if c.table_alias != alias))

    def add_join(self, left: str, right: str, type: str = "INNER", left_column: str = "id", right_column: str = "id") -> QueryDefinition:
        if any({j.left_table, j.right_table} == {left, right} for j in self.joins):
            raise ValueError(f"{left} and {right} are already joined")
        return replace(self, joins=(*self.joins, Join(left, right, type, (JoinCondition(left_column, "=", right_column),))))

    def toggle_column(self, alias: str, column: str) -> QueryDefinition:
        kept = tuple(c for c in self.columns if (c.table_alias, c.column) != (alias, column))
        return replace(self, columns=kept if len(kept) < len(self.columns) else (*self.columns, OutColumn(alias, column)))

    def select_all(self, alias: str, columns: list[str]) -> QueryDefinition:
        have = {(c.table_alias, c.column) for c in self.columns}
        return replace(self, columns=(*self.columns, *(OutColumn(alias, c) for c in columns if (alias, c) not in have)))

    def clear_columns(self, alias: str) -> QueryDefinition:
        return replace(self, columns=tuple(c for c in self.columns if c.table_alias != alias))


def validate(d: QueryDefinition) -> None:
    """Raises ValueError for a definition that cannot run."""
    aliases = [t.alias for t in d.tables]
    known = set(aliases)
    if not aliases:
        raise ValueError("A definition needs a table")
    if len(aliases) > MAX_TABLES:
        raise ValueError(f"Over {MAX_TABLES} tables")
    if len(d.joins) > MAX_JOINS:
        raise ValueError(f"Over {MAX_JOINS} joins")
    if len(aliases) > 1 and not d.joins:
        raise ValueError("Several tables need joins")
    if not d.columns:
        raise ValueError("A definition needs a column")
    if len(known) != len(aliases):
        raise ValueError("An alias stands for two tables")
    for j in d.joins:
        for a in (j.left_table, j.right_table):
            if a not in known:
                raise ValueError(f"Unknown table alias in join: {a}")
        if j.type not in JOIN_TYPES:
            raise ValueError(f"Unknown join type: {j.type}")
        if not j.conditions:
            raise ValueError("A join needs a condition")
        for c in j.conditions:
            if c.operator not in COMPARE:
                raise ValueError(f"Unknown join operator: {c.operator}")
    for what, names in (("column", [c.table_alias for c in d.columns]), ("filter", [f.table_alias for f in d.filters]), ("group by", [a for a, _ in d.group_by]), ("order by", [o.table_alias for o in d.order_by])):
        for a in names:
            if a not in known:
                raise ValueError(f"Unknown table alias in {what}: {a}")
    for f in d.filters:
        if f.operator not in FILTERS:
            raise ValueError(f"Unknown filter operator: {f.operator}")
    for c in d.columns:
        if c.aggregate is not None and c.aggregate not in AGGREGATES:
            raise ValueError(f"Unknown aggregate: {c.aggregate}")
    for o in d.order_by:
        if o.direction not in ("ASC", "DESC"):
            raise ValueError(f"Unknown direction: {o.direction}")
    if d.limit is not None and not 0 <= d.limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a.__eq__, "!=": a.__ne__, ">": a.__gt__, "<": a.__lt__, ">=": a.__ge__, "<=": a.__le__}[op](b)


_EXACT_TEXT = (T.StringType, T.IntegralType, T.DateType, T.BooleanType)


def _join_on(left: Column, lt: T.DataType, op: str, right: Column, rt: T.DataType, typed: bool) -> Column:
    """Join conditions compare as text, so that a number meets the same number in a text column.

    Equal types whose equality is that of their texts are compared as they are, which keeps
    statistics, bucketing and pruning; ``typed`` compares everything as it is.
    """
    same = type(lt) is type(rt) and isinstance(lt, _EXACT_TEXT) and op in ("=", "!=")
    if typed or same or (isinstance(lt, T.StringType) and isinstance(rt, T.StringType)):
        return _compare(left, op, right)
    return _compare(left.cast("string"), op, right.cast("string"))


def _filter(c: Column, t: T.DataType, f: Filter) -> Column:
    if f.operator == "IS NULL":
        return c.isNull()
    if f.operator == "IS NOT NULL":
        return c.isNotNull()
    if f.operator == "IN":
        items = f.value if isinstance(f.value, (list, tuple, set)) else [x.strip() for x in str(f.value).split(",")] if f.value is not None else [None]
        return c.isin(*[F.lit(x if x is None else str(x)).cast(t) for x in items])
    if f.operator == "LIKE":
        return F.lit(None).cast("boolean") if f.value is None else c.cast("string").like(str(f.value))
    # the literal takes the column's type, never the reverse, so the comparison reaches the scan
    value = F.lit(None if f.value is None else str(f.value).lower() if isinstance(f.value, bool) else str(f.value)).cast(t)
    return _compare(c, f.operator, value)


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


_AGG: dict[str, Callable[[Column], Column]] = {"COUNT": F.count, "COUNT_DISTINCT": F.count_distinct, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def compile_query(d: QueryDefinition, resolve: Callable[[TableRef], DataFrame], typed_joins: bool = False) -> DataFrame:
    """The definition as a DataFrame; ``resolve`` gives each table.

    Tables are joined in listed order. Each source column is renamed to alias.column first,
    so that equal names in several tables, and one table under two aliases, cannot clash.
    Nulls sort last ascending and first descending.
    """
    validate(d)
    types: dict[tuple[str, str], T.DataType] = {}

    def load(ref: TableRef) -> DataFrame:
        df = resolve(ref)
        types.update({(ref.alias, f.name): f.dataType for f in df.schema.fields})
        return df.select(*[_named(c).alias(f"{ref.alias}.{c}") for c in df.columns])

    def col(alias: str, column: str) -> Column:
        if (alias, column) not in types:
            raise ValueError(f"Unknown column: {alias}.{column}")
        return _named(f"{alias}.{column}")

    frames = {t.alias: load(t) for t in d.tables}
    df = frames[d.tables[0].alias]
    inside = {d.tables[0].alias}
    for j in d.joins:
        new = j.right_table if j.right_table not in inside else j.left_table
        on = reduce(and_, [_join_on(col(j.left_table, c.left_column), types[j.left_table, c.left_column], c.operator, col(j.right_table, c.right_column), types[j.right_table, c.right_column], typed_joins) for c in j.conditions])
        if new in inside:  # both sides are there already: one more condition
            df = df.where(on)
            continue
        how = JOIN_TYPES[j.type]
        if new == j.left_table:  # the listed left side comes in from the right
            how = {"left": "right", "right": "left"}.get(how, how)
        df = df.join(frames[new], on, how)
        inside.add(new)
    if left_out := [t.alias for t in d.tables if t.alias not in inside]:
        raise ValueError(f"Tables that no join reaches: {', '.join(left_out)}")
    for f in d.filters:
        df = df.where(_filter(col(f.table_alias, f.column), types.get((f.table_alias, f.column), T.StringType()), f))
    names = _unique([c.name for c in d.columns])
    order = lambda c, o: c.asc_nulls_last() if o.direction == "ASC" else c.desc_nulls_first()
    if d.group_by or any(c.aggregate for c in d.columns):
        keys = [f"{a}.{c}" for a, c in d.group_by]
        for a, c in d.group_by:
            col(a, c)
        loose = [f"{c.table_alias}.{c.column}" for c in d.columns if not c.aggregate and f"{c.table_alias}.{c.column}" not in keys]
        if loose:
            raise ValueError(f"Columns must be grouped or aggregated: {', '.join(loose)}")
        aggs = [(i, _AGG[c.aggregate](col(c.table_alias, c.column)).alias(f"__a{i}")) for i, c in enumerate(d.columns) if c.aggregate]
        grouped = df.groupBy(*map(_named, keys))
        df = grouped.agg(*[a for _, a in aggs]) if aggs else df.select(*map(_named, keys)).distinct()
        if d.order_by:
            for o in d.order_by:
                if f"{o.table_alias}.{o.column}" not in keys:
                    raise ValueError(f"Order by must use grouped columns: {o.table_alias}.{o.column}")
            df = df.orderBy(*[order(_named(f"{o.table_alias}.{o.column}"), o) for o in d.order_by])
        out = [(F.col(f"__a{i}") if c.aggregate else _named(f"{c.table_alias}.{c.column}")).alias(n) for i, (c, n) in enumerate(zip(d.columns, names))]
    else:
        if d.order_by:
            df = df.orderBy(*[order(col(o.table_alias, o.column), o) for o in d.order_by])
        out = [col(c.table_alias, c.column).alias(n) for c, n in zip(d.columns, names)]
    df = df.select(*out)
    return df.limit(d.limit) if d.limit else df


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n] - 1}")
    return out


def to_sql(d: QueryDefinition, table_name: Callable[[TableRef], str] = lambda t: f'"{t.schema}"."{t.table}"' if t.schema else f'"{t.table}"') -> str:
    """The definition as SQL text, for display and for comparison with another engine."""
    validate(d)
    q = lambda x: '"' + x.replace('"', '""') + '"'
    c = lambda a, n: f"{q(a)}.{q(n)}"
    lit = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    out = []
    for x in d.columns:
        e = c(x.table_alias, x.column)
        e = f"COUNT(DISTINCT {e})" if x.aggregate == "COUNT_DISTINCT" else f"{x.aggregate}({e})" if x.aggregate else e
        out.append(e + (f" AS {q(x.alias)}" if x.alias else ""))
    tables = {t.alias: f"{table_name(t)} AS {q(t.alias)}" for t in d.tables}
    lines = ["SELECT " + ", ".join(out), "FROM " + tables[d.tables[0].alias]]
    inside = {d.tables[0].alias}
    for j in d.joins:
        new = j.right_table if j.right_table not in inside else j.left_table
        inside.add(new)
        on = " AND ".join(f"CAST({c(j.left_table, k.left_column)} AS VARCHAR) {k.operator} CAST({c(j.right_table, k.right_column)} AS VARCHAR)" for k in j.conditions)
        lines.append(f"{j.type} JOIN {tables[new]} ON {on}")
    wheres = []
    for f in d.filters:
        e = c(f.table_alias, f.column)
        if f.operator in ("IS NULL", "IS NOT NULL"):
            wheres.append(f"{e} {f.operator}")
        elif f.operator == "IN":
            items = f.value if isinstance(f.value, (list, tuple, set)) else [x.strip() for x in str(f.value).split(",")]
            wheres.append(f"{e} IN ({', '.join(map(lit, items))})")
        else:
            wheres.append(f"{e} {f.operator} {lit(f.value)}")
    if wheres:
        lines.append("WHERE " + " AND ".join(wheres))
    if d.group_by:
        lines.append("GROUP BY " + ", ".join(c(a, n) for a, n in d.group_by))
    if d.order_by:
        lines.append("ORDER BY " + ", ".join(f"{c(o.table_alias, o.column)} {o.direction} NULLS {'LAST' if o.direction == 'ASC' else 'FIRST'}" for o in d.order_by))
    if d.limit:
        lines.append(f"LIMIT {d.limit}")
    return "\n".join(lines)
