"""SQL texts bound to the tables they may read.

A text is parsed first; every relation it names (in joins, comma lists, subqueries and WITH
bodies) is resolved by the caller and stands in the text as a view of a name of its own,
which is dropped as soon as the text is analysed. So texts of different owners or threads
never see each other's tables, nor any table, view or path of the session.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from crosslake.plans.guards import UnsafeSql

Resolve = Callable[[tuple[str, ...]], DataFrame]
# fixed value: functions that call methods of the Java machine by name
_REFLECTION = re.compile(r"\b(?:reflect|try_reflect|java_method)\b\W*\(", re.IGNORECASE)


@dataclass(frozen=True)
class Relation:
    """A relation that a text names: its name, and where it stands (end exclusive)."""

    parts: tuple[str, ...]
    start: int
    end: int
    has_alias: bool


def _items(seq: Any) -> list:
    return [seq.apply(i) for i in range(seq.length())]


def relations(spark: SparkSession, text: str) -> tuple[str, list[Relation]]:
    """(the text as parsed, the relations in it that are no WITH names of their scope); anything but one query is refused."""
    jvm = spark._jvm
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    refused = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{c}") for c in ("Command", "ParsedStatement")]
    parsed, found = [text], {}

    def walk(node: Any, parent: str, scope: frozenset[str]) -> Iterator[Relation]:
        kind = node.getClass().getSimpleName()
        if kind == "PlanWithUnresolvedIdentifier" or any(c.isInstance(node) for c in refused):
            raise UnsafeSql("Only queries of plainly named tables can run here")
        if kind == "UnresolvedRelation":
            parts, at = tuple(_items(node.multipartIdentifier())), node.origin()
            if not (len(parts) == 1 and parts[0].lower() in scope):
                if at.sqlText().isDefined():
                    parsed[0] = at.sqlText().get()
                yield Relation(parts, at.startIndex().get(), at.stopIndex().get() + 1, parent in ("SubqueryAlias", "Sample"))
        if kind == "UnresolvedWith":
            for cte in _items(node.cteRelations()):
                name = cte._1().lower()
                yield from walk(cte._2(), kind, scope | {name} if node.allowRecursion() else scope)
                scope = scope | {name}
        else:
            for inner in _items(node.innerChildren()):
                yield from walk(inner, kind, scope)
        for child in _items(node.children()):
            yield from walk(child, kind, scope)

    for r in walk(plan, "", frozenset()):
        found[r.start] = r
    return parsed[0], [found[k] for k in sorted(found)]


def bind(spark: SparkSession, text: str, resolve: Resolve) -> DataFrame:
    """The plan of one query; ``resolve`` gives the table of each name or raises ValueError for a name that the owner lacks."""
    text = text.strip().rstrip(";")
    if _REFLECTION.search(text):
        raise UnsafeSql("Calls of Java methods are not allowed")
    text, named = relations(spark, text)
    views: dict[tuple[str, ...], str] = {}
    try:
        for r in named:
            if r.parts not in views:
                view = f"bound_{uuid.uuid4().hex}"
                resolve(r.parts).createTempView(view)
                views[r.parts] = view
        for r in reversed(named):
            name = r.parts[-1].replace("`", "``")
            bare = r.has_alias or re.search(r"\bTABLE\s*$", text[: r.start], re.IGNORECASE)
            text = text[: r.start] + views[r.parts] + ("" if bare else f" AS `{name}`") + text[r.end :]
        return spark.sql(text)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def frames_resolver(frames: dict[str, DataFrame]) -> Resolve:
    """Tables by their last name, without regard to case."""
    by = {k.lower(): v for k, v in frames.items()}

    def find(parts: tuple[str, ...]) -> DataFrame:
        if len(parts) > 1 or parts[0].lower() not in by:
            raise ValueError(f"Unknown table: {'.'.join(parts)}")
        return by[parts[0].lower()]

    return find
