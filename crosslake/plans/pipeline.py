"""Transformations, notebooks, and pipelines of dependent steps."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosslake.functions.common import same_id, ship
from crosslake.functions.scalars import table_name_of
from crosslake.operators.shaping import combine_cells
from crosslake.plans import guards
from crosslake.plans.sqlexec import QueryEngine, QueryTimeout, with_timeout
from crosslake.sources.staging import counted_write, stage_counted

STEP_TYPES = ("ingest", "transform", "cross-query", "export")
NEEDS = {"transform": ("transformationId",), "cross-query": ("savedCrossQueryId",), "ingest": ("sourceConnectionId", "sourceTable"), "export": ("path",)}


class CycleError(ValueError):
    pass


def phases(steps: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """The steps in phases: each depends on earlier phases only. Edges to unknown steps do not count; a cycle is an error."""
    known = list(dict.fromkeys(steps))
    level = levels(known, edges)
    if len(level) < len(known):
        raise CycleError(f"Steps in a cycle: {', '.join(s for s in known if s not in level)}")
    return [[s for s in known if level[s] == k] for k in range(max(level.values(), default=-1) + 1)]


def phases_of_all(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """``phases`` of many pipelines at once: pipeline_id, step_id, phase; null for steps that wait for a cycle.

    steps: pipeline_id, step_id; edges: pipeline_id, source, target. Ids are equal after
    trimming and lower-casing. Each pipeline's few steps are one task's work, taken by batches.
    """
    s = steps.where("pipeline_id is not null and step_id is not null").groupBy("pipeline_id").agg(F.collect_set("step_id").alias("steps"))  # one definition's steps
    e = edges.where("source is not null and target is not null").groupBy("pipeline_id").agg(F.collect_set(F.struct(same_id("source").alias("a"), same_id("target").alias("b"))).alias("edges"))
    ship(steps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for pid, ids, pairs in zip(*[c.to_pylist() for c in batch.columns]):
                names: dict[str, list[str]] = {}
                for x in ids:
                    names.setdefault(x.strip(" ").lower(), []).append(x)
                level = levels(list(names), [(p["a"], p["b"]) for p in pairs or []])
                out += [(pid, x, level.get(k)) for k, xs in names.items() for x in xs]
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32()))], names=["pipeline_id", "step_id", "phase"])

    return s.join(e, "pipeline_id", "left").select("pipeline_id", "steps", "edges").mapInArrow(run, "pipeline_id string, step_id string, phase int")


def levels(steps: list[str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """The phase of each step that is not behind a cycle: one more than the latest of the steps before it."""
    known, after, waits = set(steps), {}, dict.fromkeys(steps, 0)
    for a, b in set(edges):
        if a in known and b in known:
            after.setdefault(a, []).append(b)
            waits[b] += 1
    now, out, level = [s for s in steps if not waits[s]], {}, 0
    while now:
        out |= dict.fromkeys(now, level)
        nxt = []
        for s in now:
            for b in after.get(s, []):
                waits[b] -= 1
                if not waits[b]:
                    nxt.append(b)
        now, level = nxt, level + 1
    return out


def check_steps(definition: dict) -> list[str]:
    """What is missing in the steps' configurations."""
    out = []
    for s in definition.get("steps", []):
        kind, config = s.get("type"), s.get("config") or {}
        if kind not in STEP_TYPES:
            out.append(f"{s['id']}: unknown type {kind}")
            continue
        out += [f"{s['id']}: {k} is required" for k in NEEDS[kind] if not config.get(k)]
    return out


# fixed value: the fields of a schedule, with their least and greatest numbers
CRON_FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))


def cron_numbers(text: str, least: int, most: int) -> set[int]:
    """The numbers of one field: ``*``, numbers, ranges, lists and steps."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        low, _, high = (f"{least}-{most}" if span == "*" else span).partition("-")
        a, b = int(low), int(high or (most if step else low))
        if not (least <= a <= b <= most) or (step and int(step) < 1):
            raise ValueError(f"Bad schedule field: {text}")
        out.update(range(a, b + 1, int(step or 1)))
    return out


def is_due(schedule: Column, moment: Column) -> Column:
    """Whether a schedule of five fields names the minute of ``moment``; null and unreadable schedules name none.

    Each field is expanded inside the plan. With both a day and a weekday given, either is enough.
    """
    fields = F.split(F.trim(schedule), r"\s+")
    given = lambda i: F.get(fields, F.lit(i))
    now = (F.minute(moment), F.hour(moment), F.dayofmonth(moment), F.month(moment), F.dayofweek(moment) - 1)

    def hit(i: int) -> Column:
        _, least, most = CRON_FIELDS[i]

        def one(part: Column) -> Column:
            span, step = F.split(part, "/"), F.get(F.split(part, "/"), F.lit(1)).try_cast("int")
            ends = F.split(span[0], "-")
            low = F.when(span[0] == "*", least).otherwise(ends[0].try_cast("int"))
            high = F.when(span[0] == "*", most).otherwise(F.coalesce(F.get(ends, F.lit(1)).try_cast("int"), F.when(F.size(span) > 1, F.lit(most)).otherwise(low)))
            at = lambda n: (n >= low) & (n <= high) & (F.coalesce(F.try_mod(n - low, step), F.when(F.size(span) > 1, F.lit(None)).otherwise(0)) == 0)
            return F.coalesce(at(now[i]) | at(now[i] + 7), F.lit(False)) if i == 4 else F.coalesce(at(now[i]), F.lit(False))

        return F.exists(F.split(given(i), ","), one)

    day = F.when(F.startswith(given(2), F.lit("*")) | F.startswith(given(4), F.lit("*")), hit(2) & hit(4)).otherwise(hit(2) | hit(4))
    return F.coalesce((F.size(fields) == 5) & hit(0) & hit(1) & hit(3) & day, F.lit(False))


def due_pipelines(pipelines: DataFrame, moment: Column) -> DataFrame:
    """The active pipelines (id, schedule, status) whose schedule names the minute; one scan for all of them, whatever their number."""
    return pipelines.where((F.col("status") == "active") & is_due(F.col("schedule"), moment))


def next_run(schedule: str, after: datetime, most_days: int = 1500) -> datetime | None:
    """The first minute after ``after`` that a schedule names, None within ``most_days``."""
    parts = schedule.split()
    if len(parts) != len(CRON_FIELDS):
        raise ValueError(f"A schedule has five fields: {schedule}")
    minute, hour, day, month, weekday = (cron_numbers(p, low, high) for p, (_, low, high) in zip(parts, CRON_FIELDS))
    weekday = {w % 7 for w in weekday}
    start = (after + timedelta(minutes=1)).replace(second=0, microsecond=0)
    both = parts[2].startswith("*") or parts[4].startswith("*")
    for n in range(most_days):
        d = (start + timedelta(days=n)).date()
        on_day, on_week = d.day in day, (d.weekday() + 1) % 7 in weekday
        if d.month not in month or not (on_day and on_week if both else on_day or on_week):
            continue
        for h in sorted(hour):
            for m in sorted(minute):
                t = datetime(d.year, d.month, d.day, h, m)
                if t >= start:
                    return t
    return None


def missing_settings(steps: DataFrame) -> DataFrame:
    """check_steps over the steps of many pipelines: pipeline_id, step_id, problem.

    steps: pipeline_id, step_id, type and settings, a map from names to texts; a setting
    that is absent, null or empty is missing.
    """
    kind = F.col("type")
    lacks = lambda k: F.coalesce(F.col("settings")[k], F.lit("")) == ""
    problems = [F.when(~F.coalesce(kind.isin(*STEP_TYPES), F.lit(False)), F.concat(F.lit("unknown type "), F.coalesce(kind, F.lit("None"))))]
    problems += [F.when((kind == t) & lacks(k), f"{k} is required") for t, ks in NEEDS.items() for k in ks]
    return steps.select("pipeline_id", "step_id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


@dataclass
class Transformation:
    id: str
    name: str
    sql_query: str
    connection_id: str | None = None
    status: str = "active"
    description: str = ""
    max_rows: int | None = None
    last_run_at: datetime | None = None


@dataclass
class TransformationRun:
    id: str
    transformation_id: str
    trigger_type: str
    started_at: datetime
    status: str = "running"
    completed_at: datetime | None = None
    execution_time_ms: int | None = None
    rows_processed: int | None = None
    error_message: str | None = None
    truncated: bool = False  # the stored result was cut at the cap


@dataclass
class Transformations:
    """Named SQL of one organization; each run writes its capped result under its id and tells whether it was cut."""

    engine: QueryEngine
    items: dict[str, Transformation] = field(default_factory=dict)
    runs: list[TransformationRun] = field(default_factory=list)

    def create(self, name: str, sql: str, **more: Any) -> Transformation:
        if not sql or not sql.strip():
            raise ValueError("SQL query must not be empty")
        if not guards.is_safe_query(sql):
            raise guards.UnsafeSql("SQL query contains potentially dangerous patterns or commands")
        t = Transformation(more.pop("id", None) or uuid.uuid4().hex, name, sql, **more)
        self.items[t.id] = t
        return t

    def get(self, id_: str) -> Transformation:
        if id_ not in self.items:
            raise KeyError(f"Transformation not found: {id_}")
        return self.items[id_]

    def update(self, id_: str, **changes: Any) -> Transformation:
        t = self.get(id_)
        for k, v in changes.items():
            setattr(t, k, v)
        return t

    def list(self, status: str | None = None) -> list[Transformation]:
        return [t for t in self.items.values() if status in (None, t.status)]

    def delete(self, id_: str) -> None:
        self.get(id_)
        del self.items[id_]

    def pause(self, id_: str) -> None:
        self.get(id_).status = "paused"

    def resume(self, id_: str) -> None:
        self.get(id_).status = "active"

    def run(self, id_: str, trigger: str = "manual") -> TransformationRun:
        t, e = self.get(id_), self.engine
        if t.status == "paused":
            raise ValueError("Transformation is paused")
        run = TransformationRun(uuid.uuid4().hex, id_, trigger, e.clock())
        self.runs.append(run)
        began = time.time()
        try:

            def work() -> int:
                df: DataFrame | None = None
                for text in (s for s in t.sql_query.split(";") if s.strip()):  # a saved notebook holds several
                    df = e.sql(text, t.connection_id)
                cap = min(t.max_rows or e.config.max_rows_limit, 100_000)
                n = counted_write(df.limit(cap), lambda x: e.cache_result(run.id, x))
                run.truncated = n == cap and df.limit(cap + 1).count() > cap
                return n

            run.rows_processed = with_timeout(e.spark, e.config.transformation_timeout_s, work, "Transformation")
            run.status = "success"
        except QueryTimeout as x:
            run.status, run.error_message = "timeout", str(x)
        except Exception as x:  # noqa: BLE001 - the run records it
            run.status, run.error_message = "failed", str(x).splitlines()[0]
        run.completed_at, run.execution_time_ms = e.clock(), int((time.time() - began) * 1000)
        t.last_run_at = run.completed_at
        return run

    def result(self, run_id: str) -> DataFrame:
        return self.engine.cached(run_id)

    def run_page(self, id_: str, limit: int = 20, offset: int = 0) -> list[TransformationRun]:
        return sorted((r for r in self.runs if r.transformation_id == id_), key=lambda r: r.started_at, reverse=True)[offset : offset + limit]


@dataclass
class Notebook:
    id: str
    name: str
    cells: list[dict]

    def execute(self, engine: QueryEngine, cell_id: str) -> DataFrame:
        cell = next((c for c in self.cells if c["id"] == cell_id), None)
        if cell is None:
            raise KeyError(f"Cell not found: {cell_id}")
        if cell.get("type") != "sql":
            raise ValueError("Only SQL cells can be executed")
        return engine.sql(cell["content"], cell.get("connectionId"))

    def save_as_transformation(self, transformations: Transformations, name: str, selected: set[str] | None = None) -> Transformation:
        text = combine_cells(self.cells, selected)
        connection = next((c.get("connectionId") for c in self.cells if c.get("connectionId")), None)
        return transformations.create(name, text, connection_id=connection)


@dataclass
class StepResult:
    status: str = "pending"
    started_at: datetime | None = None
    completed_at: datetime | None = None
    error: str | None = None
    rows_processed: int | None = None
    truncated: bool = False


@dataclass
class PipelineRun:
    id: str
    status: str = "running"
    step_results: dict[str, StepResult] = field(default_factory=dict)


class PipelineRunner:
    """Runs definitions: phases in order, the steps of a phase at once; step types are the engine's own or added ones."""

    def __init__(self, transformations: Transformations, handlers: dict[str, Callable[[dict], int | tuple[int | None, bool] | None]] | None = None) -> None:
        self.t = transformations
        self.handlers = {"transform": self._transform, "cross-query": self._cross, "ingest": self._ingest, "export": self._export} | (handlers or {})
        self._lock = threading.Lock()

    def _transform(self, config: dict) -> tuple[int | None, bool]:
        run = self.t.run(config["transformationId"], "pipeline")
        if run.status != "success":
            raise RuntimeError(run.error_message)
        return run.rows_processed, run.truncated

    def _cross(self, config: dict) -> int:
        return self.t.engine.run_saved(config["savedCrossQueryId"], capped=False).count()

    def _ingest(self, config: dict) -> int:
        e = self.t.engine
        df = e.registry.scan(config["sourceConnectionId"], config["sourceTable"], config.get("sourceSchema"), organization_id=e.organization_id)
        return stage_counted(df, e.organization_id, config.get("targetStagingName") or table_name_of(config["sourceTable"]), config.get("jobId", "pipeline"))[1]

    def _export(self, config: dict) -> int:
        e = self.t.engine
        df = e.run_saved(config["savedCrossQueryId"], capped=False) if config.get("savedCrossQueryId") else e.sql(config["sql"], config.get("connectionId"))
        return counted_write(df, lambda x: x.write.mode(config.get("mode", "overwrite")).format(config.get("format", "parquet")).save(config["path"]))

    def _step(self, step: dict, result: StepResult) -> None:
        clock = self.t.engine.clock
        result.status, result.started_at = "running", clock()
        try:
            got = self.handlers[step["type"]](step.get("config") or {})
            result.rows_processed, result.truncated = got if isinstance(got, tuple) else (got, False)
            result.status = "success"
        except Exception as x:  # noqa: BLE001 - the result records it
            result.status, result.error = "failed", str(x).splitlines()[0] if str(x) else type(x).__name__
        result.completed_at = clock()

    def run(self, definition: dict, stop_on_error: bool = True) -> PipelineRun:
        """success, failed, or partial if some steps succeeded; steps after a failure stay pending with ``stop_on_error``."""
        if wrong := check_steps(definition):
            raise ValueError("; ".join(wrong))
        steps = {s["id"]: s for s in definition.get("steps", [])}
        order = phases(list(steps), [(e["source"], e["target"]) for e in definition.get("edges", [])])
        run = PipelineRun(uuid.uuid4().hex, step_results={s: StepResult() for s in steps})
        for phase in order:
            with ThreadPoolExecutor(max(1, len(phase))) as pool:
                for f in [pool.submit(inheritable_thread_target(self.t.engine.spark)(self._step), steps[s], run.step_results[s]) for s in phase]:
                    f.result()
            if stop_on_error and any(run.step_results[s].status == "failed" for s in phase):
                break
        states = [r.status for r in run.step_results.values()]
        failed, ok = "failed" in states, "success" in states
        run.status = "success" if not failed else "partial" if ok else "failed"
        return run
