"""Running one tenant's SQL: gate, admission, snapshot, pruning, deadline, row cap, metrics."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import schema as schemas
from ..operators import prune
from ..sources.store import Snapshot, Store
from . import gate
from .gate import TABLE, InvalidSql
from .scan import newest_limit, scans
from .tree import items, kind, nodes


class QueryError(RuntimeError):
    """A failed query; `code` is one of invalid_sql, timeout, busy, row_limit, storage, resources, execution."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Limits:
    timeout_s: float = 30.0
    max_rows: int = 10_000
    concurrent: int = 8
    partitions: int = 8


@dataclass
class Result:
    schema: T.StructType
    rows: list[tuple]
    shown: list[str | None]
    nullable: list[bool]
    metrics: dict = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession, limits: Limits = Limits()):
        self.spark, self.limits = spark, limits
        self.permits = threading.BoundedSemaphore(limits.concurrent)

    def session(self) -> SparkSession:
        """A session of its own for each query, so that no view leaks into another."""
        session = self.spark.newSession()
        for key, value in {"spark.sql.runSQLOnFiles": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.shuffle.partitions": str(self.limits.partitions)}.items():
            session.conf.set(key, value)
        return session

    def plan(self, session: SparkSession, snapshot: Snapshot, sql: str, fresh: DataFrame | None = None) -> tuple[DataFrame, list[dict]]:
        """The query over as few files as its filters or its limit to the newest rows allow, and those files. Rows that are in no file yet take part with the columns they have."""
        if fresh is not None:
            fresh = session_frame(session, fresh)
            schema = schemas.union([snapshot.schema, fresh.schema])

        def view(files: list[dict] | None = None) -> None:
            rows = snapshot.frame(files, session)
            if fresh is not None:
                rows = rows.unionByName(fresh, allowMissingColumns=True).select(*(f"`{n}`" for n in schema.names))
            rows.createOrReplaceTempView(TABLE)

        view()
        df = session.sql(sql)
        optimised = df._jdf.queryExecution().optimizedPlan()
        wanted = scans(optimised)
        files = snapshot.files
        if wanted:
            keep = {f["path"] for predicates in wanted for f in prune.prune(files, predicates)}
            files = [f for f in files if f["path"] in keep]
        if fresh is None and len(wanted) == 1 and not wanted[0] and (limit := newest_limit(optimised)) is not None:
            files = prune.newest(files, limit)
        if len(files) < len(snapshot.files):
            view(files)
            df = session.sql(sql)
        return df, files

    def frame(self, store: Store, sql: str) -> DataFrame:
        """The query's result as a frame of any size, through the gate and over the pruned files; the row cap and the deadline are query()'s."""
        try:
            gate.check(self.spark, sql)
        except InvalidSql as e:
            raise QueryError("invalid_sql", str(e)) from e
        with store.pin() as snapshot:
            return self.plan(self.session(), snapshot, sql)[0]

    def resources(self, tag: str) -> dict:
        """The largest execution memory of a task of the query's stages, and the bytes that they spilled to memory and disk."""
        context = self.spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(1_000)
        store, peak, spilled = context.statusStore(), 0, 0
        for job in context.statusTracker().getJobIdsForTag(tag):
            found = context.statusTracker().getJobInfo(job)
            for stage in found.get().stageIds() if found.isDefined() else ():
                try:
                    data = store.lastStageAttempt(stage)
                except Py4JJavaError:  # a stage that was skipped, or is no longer kept
                    continue
                peak, spilled = max(peak, data.peakExecutionMemory()), spilled + data.memoryBytesSpilled() + data.diskBytesSpilled()
        return {"memory_peak_bytes": peak, "spill_bytes": spilled}

    def query(self, store: Store, sql: str, timeout_s: float | None = None, max_rows: int | None = None, fresh: Callable[[int], DataFrame | None] | None = None) -> Result:
        """The query's whole result, or a QueryError; options only lower the limits. `fresh` gives the rows from a sequence on that are not published."""
        started = time.monotonic()
        limit = min(self.limits.timeout_s, self.limits.timeout_s if timeout_s is None else timeout_s)
        cap = min(self.limits.max_rows, self.limits.max_rows if max_rows is None else max_rows)
        deadline = started + limit

        def in_time() -> None:
            if time.monotonic() >= deadline:
                raise QueryError("timeout", "the query took too long")

        in_time()
        try:
            gate.check(self.spark, sql)
        except InvalidSql as e:
            raise QueryError("invalid_sql", str(e)) from e
        if not self.permits.acquire(timeout=max(0.0, deadline - time.monotonic())):
            raise QueryError("busy", "too many queries run")
        tag = f"query-{uuid.uuid4().hex}"
        context = self.spark.sparkContext
        timer = threading.Timer(max(0.0, deadline - time.monotonic()), lambda: context.cancelJobsWithTag(tag))
        timer.daemon = True
        try:
            admitted = time.monotonic()
            context.addJobTag(tag)
            timer.start()
            try:
                snapshot = store.pin()
                added = fresh(snapshot.next) if fresh is not None else None
            except Exception as e:
                raise QueryError("storage", "the store cannot be read") from e
            with snapshot:
                session = self.session()
                try:
                    df, files = self.plan(session, snapshot, sql, added)
                except AnalysisException as e:
                    raise QueryError("invalid_sql", "the query cannot be planned") from e
                in_time()
                planned = time.monotonic()
                shown, nullable = lineage(df, snapshot.schema)
                rows = [tuple(r) for r in df.limit(cap + 1).collect()]
                in_time()
                if len(rows) > cap:
                    raise QueryError("row_limit", f"more than {cap} rows")
                now = time.monotonic()
                metrics = {
                    "admission_wait_ns": int((admitted - started) * 1e9), "planning_ns": int((planned - admitted) * 1e9), "execution_ns": int((now - planned) * 1e9), "files_scanned": len(files),
                    "files_pruned": len(snapshot.files) - len(files), "row_groups_pruned": 0, "rows_returned": len(rows), "timed_out": False, "cancelled": False, **self.resources(tag),
                }
                return Result(df.schema, rows, shown, nullable, metrics)
        except QueryError:
            raise
        except Exception as e:
            if time.monotonic() >= deadline:
                raise QueryError("timeout", "the query took too long") from e
            text = str(e)
            if "OutOfMemory" in text or "UNABLE_TO_ACQUIRE_MEMORY" in text or "No space left" in text:
                raise QueryError("resources", "memory or disk ran out") from e
            if isinstance(e, PySparkException) or "Py4J" in type(e).__name__:
                raise QueryError("execution", "the query failed") from e
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)
            self.permits.release()


def session_frame(session: SparkSession, df: DataFrame) -> DataFrame:
    """The same rows as a frame of another session of this application."""
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().analyzed()), session)


def lineage(df: DataFrame, schema: T.StructType) -> tuple[list[str | None], list[bool]]:
    """For each result column the type name of the fixed column it is (under whatever name), else None; and whether it can be null."""
    plan = df._jdf.queryExecution().analyzed()
    origin: dict[int, str] = {}
    same: dict[int, int] = {}
    outer = False
    for node in nodes(plan):
        if kind(node) in ("LogicalRelation", "LogicalRDD", "LocalRelation"):
            origin |= {a.exprId().id(): a.name() for a in items(node.output()) if a.name() in schema.names}
        if kind(node) == "Join":
            outer = outer or "Outer" in node.joinType().toString()
        for e in items(node.expressions()):
            if kind(e) == "Alias" and kind(e.child()) == "AttributeReference":
                same[e.exprId().id()] = e.child().exprId().id()
    shown, nullable = [], []
    for a, f in zip(items(plan.output()), df.schema.fields, strict=True):
        at = a.exprId().id()
        while at in same and at not in origin:
            at = same[at]
        name = origin.get(at)
        shown.append(schemas.SHOWN.get(name) if name else None)
        fixed = name in schemas.SHOWN and not schemas.CORE[name].nullable
        nullable.append(f.nullable and not (fixed and not outer))
    return shown, nullable
