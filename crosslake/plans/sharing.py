"""Shared datasets: access by key or token, counters, and what each kind may be asked."""

from __future__ import annotations

import secrets
import threading
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from crosslake.plans.pipeline import Transformations
from crosslake.plans.sqlexec import QueryEngine, page

KINDS = ("staged", "connection", "transformation", "cross-query")
LEVELS = ("public", "organization", "private")


@dataclass
class Share:
    id: str
    name: str
    dataset_type: str
    dataset_id: str
    organization_id: str
    access_level: str = "private"
    table_name: str | None = None
    description: str = ""
    share_token: str | None = None
    api_key: str | None = None
    active: bool = True
    row_count: int | None = None
    access_count: int = 0
    last_accessed_at: datetime | None = None


class Shares:
    """The shares of one engine's organization."""

    def __init__(self, engine: QueryEngine, transformations: Transformations | None = None) -> None:
        self.engine, self.transformations = engine, transformations
        self.items: dict[str, Share] = {}
        self._lock = threading.Lock()

    def create(self, name: str, dataset_type: str, dataset_id: str, access_level: str = "private", table_name: str | None = None, with_key: bool = True) -> Share:
        if dataset_type not in KINDS:
            raise ValueError(f"Unknown dataset type: {dataset_type}")
        if access_level not in LEVELS:
            raise ValueError(f"Unknown access level: {access_level}")
        key = f"ds_{secrets.token_hex(24)}" if with_key else None
        token = secrets.token_urlsafe(24) if access_level == "public" else None
        s = Share(uuid.uuid4().hex, name, dataset_type, dataset_id, self.engine.organization_id, access_level, table_name, share_token=token, api_key=key)
        self.items[s.id] = s
        return s

    def revoke(self, id_: str) -> None:
        self.items[id_].active = False

    def open(self, key: str) -> Share:
        """The active share of an API key or of a public token; counts the access."""
        s = next((s for s in self.items.values() if s.active and key and key in (s.api_key, s.share_token)), None)
        if s is None:
            raise PermissionError("Invalid or revoked key")
        with self._lock:
            s.access_count += 1
            s.last_accessed_at = self.engine.clock()
        return s

    def data(self, key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        """A page of the dataset. A transformation gives its own newest successful run."""
        s = self.open(key)
        if s.dataset_type == "connection":
            if not s.table_name:
                raise ValueError("The share names no table")
            df = self.engine.registry.read(s.dataset_id, s.table_name, organization_id=s.organization_id)
        elif s.dataset_type == "staged":
            df = self.engine.staged(s.table_name or s.dataset_id)
        elif s.dataset_type == "transformation":
            done = [r for r in (self.transformations.runs if self.transformations else []) if r.transformation_id == s.dataset_id and r.status == "success"]
            if not done:
                raise LookupError("No cached result")
            df = self.transformations.result(max(done, key=lambda r: (r.completed_at, r.started_at)).id)
        else:
            df = self.engine.run_saved(s.dataset_id)
        return page(df, limit, offset)

    def query(self, key: str, sql: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        """SQL over a shared connection; other kinds refuse it."""
        s = self.open(key)
        if s.dataset_type != "connection":
            raise ValueError(f"SQL is not supported on {s.dataset_type} shares")
        return self.engine.shared(sql, s.dataset_id, limit, offset)


def schema_context(engine: QueryEngine, connection_id: str, tables: int = 20, columns: int = 50) -> str:
    """The tables and columns of a connection as text for a generator of SQL, each within a bound."""
    out = []
    for t in engine.registry.tables(connection_id)[:tables]:
        cols = engine.registry.columns(connection_id, t.name, t.schema)[:columns]
        out.append(f"{t.name}({', '.join(f'{c.name} {c.type}' for c in cols)})")
    return "\n".join(out)
