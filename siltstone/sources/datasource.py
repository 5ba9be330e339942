"""Frames as a Spark data source, for batches and streams: format("siltstone_frames"), option path.

A stream's offset is the next sequence; with the
option max_bytes a batch takes no more than one generation of frames. Partitions are runs of whole segments, so
that each segment file is read by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import frames

SCHEMA = "wal_sequence bigint, tenant_id string, received_time_unix_nano bigint, signal int, payload binary"


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


def ranges(path: str, start: int, end: int) -> list[Range]:
    """Sequences start to end, cut where segments begin."""
    cuts = sorted({start, end, *(s for s, _ in frames.segments(path) if start < s < end)})
    return [Range(a, z) for a, z in zip(cuts, cuts[1:], strict=False)]


def rows(path: str, part: Range) -> Iterator[tuple]:
    for f in frames.read_from(path, part.start, part.end):
        yield f.sequence, f.tenant, f.received, f.signal, f.payload


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siltstone_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FrameStream(self.options)


class FrameReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.start = options["path"], int(options.get("start", 0))
        self.end = int(options["end"]) if "end" in options else None

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.start, frames.next_sequence(self.path) if self.end is None else self.end) or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows(self.path, partition)


class FrameStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.start = options["path"], int(options.get("start", 0))
        self.at = self.start
        self.max_bytes = int(options["max_bytes"]) if "max_bytes" in options else None

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        """What there is, or with max_bytes one generation more than was planned last."""
        if self.max_bytes is None:
            return {"next": max(self.start, frames.next_sequence(self.path))}
        return {"next": frames.generation_end(self.path, self.at, self.max_bytes)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = max(self.at, end["next"])
        return ranges(self.path, start["next"], end["next"])

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows(self.path, partition)

    def commit(self, end: dict) -> None:
        """Segments go when their frames are published, not when a batch is planned."""
