"""Query results as JSON: schema, rows, metrics."""

from __future__ import annotations

import base64
import datetime as dt
import json
import math
from decimal import Decimal

from pyspark.sql import types as T

SIMPLE = {
    T.BooleanType: "Boolean", T.ByteType: "Int8", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64", T.FloatType: "Float32", T.DoubleType: "Float64", T.StringType: "Utf8",
    T.BinaryType: "Binary", T.DateType: "Date32", T.TimestampType: 'Timestamp(Microsecond, Some("UTC"))', T.TimestampNTZType: "Timestamp(Microsecond, None)", T.NullType: "Null",
    T.YearMonthIntervalType: "Interval(YearMonth)", T.DayTimeIntervalType: "Duration(Microsecond)",
}
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
RESPONSE_BYTES = 16 << 20


class Unsupported(TypeError):
    """A result type that JSON rows cannot show."""

    def __init__(self, data_type: str):
        super().__init__(f"{data_type} cannot be encoded")
        self.data_type = data_type


class TooLarge(ValueError):
    """The response has more bytes than allowed."""


def type_name(t: T.DataType) -> str:
    if type(t) in SIMPLE:
        return SIMPLE[type(t)]
    if isinstance(t, T.DecimalType):
        return f"Decimal128({t.precision}, {t.scale})"
    if isinstance(t, T.ArrayType):
        return f"List<{'nullable ' if t.containsNull else ''}{type_name(t.elementType)}>"
    if isinstance(t, T.MapType):
        return f"Map<{type_name(t.keyType)}, {'nullable ' if t.valueContainsNull else ''}{type_name(t.valueType)}>"
    if isinstance(t, T.StructType):
        return "Struct<" + ", ".join(f"{f.name}: {'nullable ' if f.nullable else ''}{type_name(f.dataType)}" for f in t.fields) + ">"
    raise Unsupported(t.simpleString())


def value(x, t: T.DataType, shown: str | None = None):
    """A cell in JSON's terms. `shown` is the type name of a fixed column where it differs from the Spark type's."""
    if x is None:
        return None
    if isinstance(t, T.LongType):
        return x if shown in ("UInt32", "UInt16") else str(x)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return None if not math.isfinite(x) else int(x) if x == int(x) and abs(x) < 1e16 and (x or math.copysign(1, x) > 0) else x
    if isinstance(t, T.DecimalType):
        return format(x, "f") if isinstance(x, Decimal) else str(x)
    if isinstance(t, T.BinaryType):
        return base64.b64encode(bytes(x)).decode()
    if isinstance(t, T.DateType):
        return str((x - EPOCH.date()).days)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        moment = x.astimezone(dt.UTC) if isinstance(t, T.TimestampType) else x.replace(tzinfo=dt.UTC)
        return str((moment - EPOCH) // dt.timedelta(microseconds=1))
    if isinstance(t, T.DayTimeIntervalType):
        return str(x // dt.timedelta(microseconds=1))
    if isinstance(t, T.ArrayType):
        return [value(v, t.elementType) for v in x]
    if isinstance(t, T.MapType):
        return [{"key": value(k, t.keyType), "value": value(v, t.valueType)} for k, v in x.items()]
    if isinstance(t, T.StructType):
        return {f.name: value(v, f.dataType) for f, v in zip(t.fields, x, strict=True)}
    return x


def encode(schema: T.StructType, rows: list[tuple], shown: list[str | None] | None = None, nullable: list[bool] | None = None, metrics: dict | None = None, max_bytes: int = RESPONSE_BYTES) -> bytes:
    """The response body. Rows are objects by column name in the schema's order; of columns that share a name the last shows."""
    shown = shown or [None] * len(schema.fields)
    nullable = nullable or [f.nullable for f in schema.fields]
    head = [{"name": f.name, "type": s or type_name(f.dataType), "nullable": n} for f, s, n in zip(schema.fields, shown, nullable, strict=True)]
    size, body = 0, []
    for row in rows:
        text = json.dumps({f.name: value(x, f.dataType, s) for f, x, s in zip(schema.fields, row, shown, strict=True)}, ensure_ascii=False, separators=(",", ":"))
        size += len(text.encode()) + 1
        if size > max_bytes:
            raise TooLarge(f"more than {max_bytes} bytes")
        body.append(text)
    out = f'{{"schema":{json.dumps(head, ensure_ascii=False, separators=(",", ":"))},"rows":[{",".join(body)}],"metrics":{json.dumps(metrics or {}, separators=(",", ":"))}}}'.encode()
    if len(out) > max_bytes:
        raise TooLarge(f"more than {max_bytes} bytes")
    return out
