"""Queries whose rows go through a store: published, pruned, retired, read back, and asked by SQL through the engine. Plain SQL over the same rows gives their results."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import CORE
from ..functions.time import HOUR
from ..operators import prune
from ..sources.store import Store
from .engine import Engine

#: An event time in the middle of the tables' month.
MIDDLE = 1_705_276_800_000_000_000
#: Stores of all rows, published once a session, by application and input.
_stores: dict[tuple[str, str], Store] = {}


def folder(spark: SparkSession) -> str:
    """A fresh folder beside the session's checkpoints, which all executors see; a temporary one, for one machine only, where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared and not spark.sparkContext.master.startswith("local"):
        warnings.warn("spark.checkpoint.dir is not set: the store lies in a folder that other machines do not see", stacklevel=2)
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="siltstone-")


def received(time: Column) -> Column:
    """When a row came in: its event hour's end, and up to four times nine hours later, by the hour. So old rows may come late, and new ones early."""
    hour = time - time % HOUR
    return hour + HOUR + (hour / HOUR).cast("bigint") % 5 * (9 * HOUR)


RECEIVED_SQL = f"(event_time_unix_nano - event_time_unix_nano % {HOUR} + {HOUR} + event_time_unix_nano // {HOUR} % 5 * {9 * HOUR})"


def log_rows(logs: DataFrame) -> DataFrame:
    """The view's rows as whole log rows of one tenant; each sequence is a frame of one record."""
    core = {
        "schema_version": F.lit(1), "tenant_id": F.lit("tenant-a"), "record_index": F.lit(0).cast("bigint"), "time_unix_nano": F.col("event_time_unix_nano"), "observed_time_unix_nano": F.lit(None).cast("decimal(20,0)"),
        "received_time_unix_nano": received(F.col("event_time_unix_nano")), "severity_number": F.lit(None).cast("int"), "severity_text": F.lit(None).cast("string"), "trace_id": F.lit(None).cast("binary"),
        "span_id": F.lit(None).cast("binary"), "service_name": F.lit(None).cast("string"), "resource_attributes": F.lit("{}"), "scope_attributes": F.lit("{}"), "log_attributes": F.lit("{}"),
    }
    extra = [c for c in logs.columns if c.startswith("log_")]
    return logs.withColumns(core).select(*CORE.names, *extra)


def published(spark: SparkSession, logs: DataFrame) -> Store:
    """A store with two commits: the rows up to the middle sequence without the sparse column, then the rest with it."""
    rows = log_rows(logs)
    low, high, middle = rows.agg(F.min("wal_sequence"), F.max("wal_sequence"), F.expr("(min(wal_sequence) + max(wal_sequence)) div 2")).first()
    store = Store(spark, folder(spark), "tenant-a")
    if low is not None:
        store.publish(rows.filter(F.col("wal_sequence") <= middle).drop("log_sparse_i64"), low, middle + 1)
        if middle < high:
            store.publish(rows.filter(F.col("wal_sequence") > middle), middle + 1, high + 1)
    return store


def shared(spark: SparkSession, sf_dir: str, logs: DataFrame) -> Store:
    """The session's store of these rows, published once."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stores:
        _stores[key] = published(spark, logs)
    return _stores[key]


Reader = Callable[[SparkSession, Store], DataFrame]


def publish_then_scan_once(spark: SparkSession, store: Store) -> DataFrame:
    return store.pin().frame().select("wal_sequence", "event_time_unix_nano", "received_time_unix_nano", "body", "log_k_i64")


def schema_union_null_fill(spark: SparkSession, store: Store) -> DataFrame:
    """The first commit's rows get the sparse column as null, whatever they had."""
    return store.pin().frame().select("wal_sequence", "log_sparse_i64")


def file_pruned_equals_full(spark: SparkSession, store: Store) -> DataFrame:
    snapshot = store.pin()
    files = prune.prune(snapshot.files, [(">=", "event_time_unix_nano", MIDDLE), ("<", "log_k_i64", 30)])
    return snapshot.frame(files).filter((F.col("event_time_unix_nano") >= MIDDLE) & (F.col("log_k_i64") < 30)).select("wal_sequence", "log_k_i64")


def newest_prefix_equals_full(spark: SparkSession, store: Store) -> DataFrame:
    snapshot = store.pin()
    rows = snapshot.frame(prune.newest(snapshot.files, 25)).select("wal_sequence", "event_time_unix_nano", "body")
    return rows.orderBy(F.desc("event_time_unix_nano"), F.desc("wal_sequence")).limit(25)


def retire_hides_old_receive(spark: SparkSession, store: Store) -> DataFrame:
    """The rows of an hour are received at one time here, so that the cutoff parts whole files. Another reader of the store retires them; snapshots of the first still have them."""
    other = Store(spark, store.files.root, "tenant-a")
    other.retire_before(MIDDLE)
    return other.pin().frame().select("wal_sequence")


def store_scan_hours(spark: SparkSession, store: Store) -> DataFrame:
    return store.pin().scan(["wal_sequence", "body"], MIDDLE + 2 * HOUR, MIDDLE + 5 * HOUR)


QUERIES: dict[str, Reader] = {f.__name__: f for f in (publish_then_scan_once, schema_union_null_fill, file_pruned_equals_full, newest_prefix_equals_full, retire_hides_old_receive, store_scan_hours)}
ORACLES = {
    "publish_then_scan_once": f"SELECT wal_sequence, event_time_unix_nano, {RECEIVED_SQL} AS received_time_unix_nano, body, log_k_i64 FROM logs",
    "schema_union_null_fill": "SELECT wal_sequence, CASE WHEN wal_sequence > (SELECT (min(wal_sequence) + max(wal_sequence)) // 2 FROM logs) THEN log_sparse_i64 END AS log_sparse_i64 FROM logs",
    "file_pruned_equals_full": f"SELECT wal_sequence, log_k_i64 FROM logs WHERE event_time_unix_nano >= {MIDDLE} AND log_k_i64 < 30",
    "newest_prefix_equals_full": "SELECT wal_sequence, event_time_unix_nano, body FROM logs ORDER BY event_time_unix_nano DESC, wal_sequence DESC LIMIT 25",
    "retire_hides_old_receive": f"SELECT wal_sequence FROM logs WHERE {RECEIVED_SQL} >= {MIDDLE}",
    "store_scan_hours": f"SELECT wal_sequence, body FROM logs WHERE event_time_unix_nano >= {MIDDLE} + 2 * {HOUR} AND event_time_unix_nano < {MIDDLE} + 6 * {HOUR}",
}

#: SQL as users send it: gate, snapshot, pruned files. The sparse column is that of the store, which the first commit lacks.
ENGINE_SQL = {
    "engine_time_bound": (f"SELECT wal_sequence, body FROM logs WHERE event_time_unix_nano >= {MIDDLE} AND event_time_unix_nano < {MIDDLE + 36 * HOUR}", None),
    "engine_dynamic_column": ("SELECT wal_sequence, log_k_i64, log_value_f64 FROM logs WHERE log_k_i64 = 10", None),
    "engine_between": ("SELECT wal_sequence FROM logs WHERE log_user_id_i64 BETWEEN 3 AND 5", None),
    "engine_is_null": (
        "SELECT count(*) AS n FROM logs WHERE log_sparse_i64 IS NULL",
        "SELECT count(*) AS n FROM logs WHERE wal_sequence <= (SELECT (min(wal_sequence) + max(wal_sequence)) // 2 FROM logs) OR log_sparse_i64 IS NULL",
    ),
    "engine_try_cast": ("SELECT wal_sequence FROM logs WHERE TRY_CAST(body AS INT) IS NULL", None),
    "engine_narrow_cast": ("SELECT wal_sequence FROM logs WHERE CAST(log_value_f64 AS FLOAT) <= CAST(20.0 AS FLOAT) AND CAST(log_k_i64 AS DECIMAL(20, 0)) < 50", None),
    "engine_newest": ("SELECT wal_sequence, event_time_unix_nano, body FROM logs ORDER BY event_time_unix_nano DESC, wal_sequence DESC LIMIT 30", None),
    "engine_group_by": ("SELECT body, count(*) AS n, max(log_k_i64) AS high FROM logs GROUP BY body", None),
    "engine_cte_self_join": (
        f"WITH late AS (SELECT log_user_id_i64 AS u, count(*) AS n FROM logs WHERE event_time_unix_nano >= {MIDDLE} GROUP BY log_user_id_i64) SELECT l.wal_sequence, late.n FROM logs AS l JOIN late ON l.log_user_id_i64 = late.u WHERE l.log_k_i64 < 2",
        None,
    ),
    "engine_any_limit": ("SELECT count(*) AS n FROM (SELECT body FROM logs LIMIT 10) AS t", None),
}
for _name, (_sql, _oracle) in ENGINE_SQL.items():
    QUERIES[_name] = lambda spark, store, sql=_sql: Engine(spark).frame(store, sql)
    ORACLES[_name] = _oracle or _sql
