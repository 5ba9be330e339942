"""Event times are nanoseconds since 1970 in a bigint; an event hour is that of UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000_000
#: Bigints end at 2 ** 63 - 1.
LAST = 2**63 - 1


def nanos(timestamp: Column) -> Column:
    """A timestamp, with or without zone, as nanoseconds."""
    return F.unix_micros(timestamp.cast("timestamp")) * 1000


def event_hour(time: Column) -> Column:
    """The start of the hour that holds a time."""
    return time - time % F.lit(HOUR)


def partition_columns(time: Column) -> dict[str, Column]:
    """The date and hour that name a time's partition."""
    at = F.timestamp_micros((event_hour(time) / 1000).cast("bigint"))  # an hour's start, which a double holds exactly
    return {"date": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_format(at, "HH")}


def hour_of(time: int) -> int:
    return time - time % HOUR
