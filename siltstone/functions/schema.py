"""The fixed columns of a log row and how a result names their types."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import types as T

SCHEMA_VERSION = 1
#: Name, Spark type, may be null, and the type name that results show.
COLUMNS = (
    ("schema_version", T.IntegerType(), False, "UInt16"),
    ("tenant_id", T.StringType(), False, "Utf8"),
    ("wal_sequence", T.LongType(), False, "UInt64"),
    ("record_index", T.LongType(), False, "UInt32"),
    ("time_unix_nano", T.LongType(), True, "UInt64"),
    ("observed_time_unix_nano", T.DecimalType(20, 0), True, "UInt64"),
    ("received_time_unix_nano", T.LongType(), False, "UInt64"),
    ("event_time_unix_nano", T.LongType(), False, "UInt64"),
    ("severity_number", T.IntegerType(), True, "Int32"),
    ("severity_text", T.StringType(), True, "Utf8"),
    ("body", T.StringType(), True, "Utf8"),
    ("trace_id", T.BinaryType(), True, "FixedSizeBinary(16)"),
    ("span_id", T.BinaryType(), True, "FixedSizeBinary(8)"),
    ("service_name", T.StringType(), True, "Utf8"),
    ("resource_attributes", T.StringType(), False, "Utf8"),
    ("scope_attributes", T.StringType(), False, "Utf8"),
    ("log_attributes", T.StringType(), False, "Utf8"),
)
CORE = T.StructType([T.StructField(n, t, null) for n, t, null, _ in COLUMNS])
SHOWN = {n: shown for n, _, _, shown in COLUMNS}
NAMES = tuple(CORE.names)


class Incompatible(ValueError):
    """Two generations give one column name different types."""


def union(schemas: list[T.StructType]) -> T.StructType:
    """The fixed columns in order, then all dynamic ones by name."""
    extra: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema.fields:
            if f.name in SHOWN:
                continue
            if f.name in extra and extra[f.name].dataType != f.dataType:
                raise Incompatible(f"{f.name} is {extra[f.name].dataType.simpleString()} and {f.dataType.simpleString()}")
            extra.setdefault(f.name, f)
    return T.StructType([*CORE.fields, *(extra[n] for n in sorted(extra))])


def fingerprint(schema: T.StructType) -> str:
    """A hash of names, types, nullability and metadata, whatever the order of the columns."""
    rows = sorted([f.name, f.dataType.simpleString(), f.nullable, sorted(f.metadata.items())] for f in schema.fields)
    return hashlib.sha256(json.dumps(rows, sort_keys=True).encode()).hexdigest()
