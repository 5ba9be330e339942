"""Frames to log rows.

Pass one finds the generation's dynamic columns: each frame's identities are
capped by name, then admitted in the order of arrival. Only the smallest (frame,
place in its frame) of each identity matters for that, so it is an aggregation by
identity, and the driver gets no more rows than there are columns to admit. Pass
two writes the rows in the admitted schema. Neither pass shuffles rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import dynamic
from ..functions.dynamic import Identity
from ..functions.schema import CORE, SCHEMA_VERSION
from ..functions.values import StringIndex, canonical, canonical_attributes
from ..sources import otlp

MAX_COLUMNS, MAX_DEPTH = 256, 4
SERVICE = "service.name"
LOGS = 1


def frame_rows(sequence: int, tenant: str, received: int, payload: bytes, max_depth: int) -> Iterator[tuple[dict, dict[Identity, object]]]:
    """The fixed columns and the dynamic leaves of a frame's records, in order."""
    index = 0
    for resource in otlp.decode(payload):
        resource_json = canonical_attributes(resource.attributes)
        resource_leaves = dynamic.flatten("resource", resource.attributes, max_depth)
        service = None
        for key, value in resource.attributes:
            if key == SERVICE:
                service = value if isinstance(value, str) else None
        for scope in resource.scopes:
            scope_json = canonical_attributes(scope.attributes)
            scope_leaves = dynamic.flatten("scope", scope.attributes, max_depth)
            for r in scope.records:
                core = {
                    "schema_version": SCHEMA_VERSION, "tenant_id": tenant, "wal_sequence": sequence, "record_index": index, "time_unix_nano": r.time or None, "observed_time_unix_nano": r.observed or None,
                    "received_time_unix_nano": received, "event_time_unix_nano": r.time or r.observed or received, "severity_number": r.severity or None, "severity_text": r.severity_text or None,
                    "body": body_text(r.body), "trace_id": whole_id(r.trace_id, 16), "span_id": whole_id(r.span_id, 8), "service_name": service,
                    "resource_attributes": resource_json, "scope_attributes": scope_json, "log_attributes": canonical_attributes(r.attributes),
                }
                if core["event_time_unix_nano"] >= 2**63:
                    raise ValueError("event time does not fit 63 bits")
                index += 1
                yield core, resource_leaves | scope_leaves | dynamic.flatten("log", r.attributes, max_depth)


def body_text(body) -> str | None:
    if body is None or isinstance(body, StringIndex):
        return None
    return body if isinstance(body, str) else canonical(body)


def whole_id(value: bytes, size: int) -> bytes | None:
    return value if len(value) == size and any(value) else None


def spelled(i: Identity) -> str:
    return json.dumps([i.source, list(i.path), i.kind])


def read_identity(text: str) -> Identity:
    source, path, kind = json.loads(text)
    return Identity(source, tuple(path), kind)


def log_frames(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("signal") == LOGS).select("wal_sequence", "tenant_id", "received_time_unix_nano", "payload")


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("wal_sequence", "tenant_id", "received_time_unix_nano", "payload")), strict=True)


def discover(frames: DataFrame, max_columns: int = MAX_COLUMNS, max_depth: int = MAX_DEPTH) -> list[Identity]:
    """The identities that the frames, taken as one generation, admit."""
    schema = pa.schema([("identity", pa.string()), ("wal_sequence", pa.int64()), ("place", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[Identity, tuple[int, int]] = {}
        for sequence, tenant, received, payload in each(batches):
            seen = {i for _, leaves in frame_rows(sequence, tenant, received, payload, max_depth) for i in leaves}
            for place, i in enumerate(dynamic.admitted_by_frame(seen, max_columns)):
                first[i] = min(first.get(i, (sequence, place)), (sequence, place))
        yield pa.RecordBatch.from_arrays([pa.array(map(spelled, first), pa.string()), pa.array([a for a, _ in first.values()], pa.int64()), pa.array([b for _, b in first.values()], pa.int32())], schema=schema)

    found = log_frames(frames).mapInArrow(find, "identity string, wal_sequence bigint, place int")
    first = found.groupBy("identity").agg(F.min(F.struct("wal_sequence", "place")).alias("at"))
    return [read_identity(r.identity) for r in first.orderBy("at").limit(max_columns).collect()]


def schema_of(identities: list[Identity]) -> T.StructType:
    named = dynamic.names(identities)
    return T.StructType([*CORE.fields, *sorted((dynamic.struct_field(i, n) for i, n in named.items()), key=lambda f: f.name)])


def project(frames: DataFrame, identities: list[Identity], max_depth: int = MAX_DEPTH) -> DataFrame:
    """The log rows of frames, with a column for each identity; other attributes stay in the JSON columns only."""
    schema = schema_of(identities)
    named = dynamic.names(identities)
    arrow = to_arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for sequence, tenant, received, payload in each(batches):
            for core, leaves in frame_rows(sequence, tenant, received, payload, max_depth):
                rows.append(core | {named[i]: v for i, v in leaves.items() if i in named})
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return log_frames(frames).mapInArrow(write, schema)
