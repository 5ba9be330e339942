"""From frames to published rows, by Structured Streaming.

Each micro-batch is one generation: its columns are found, its rows projected and
published as one commit that covers the batch's sequences. A batch that runs again
after a crash finds its range published and changes nothing; the checkpoint of the
frames, and with it the deletion of their segments, follows publication. Late
rows go to their own event hour, so there is no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import project
from ..sources import frames
from ..sources.datasource import SCHEMA, FrameSource
from ..sources.store import Store


#: Frames are published in generations of about so many bytes, so that columns are admitted and files written for a bounded run of frames.
GENERATION_BYTES = 64 << 20


class Behind(RuntimeError):
    """The store lacks rows whose frames the checkpoint has given up."""


class Ingest:
    def __init__(self, spark: SparkSession, directory: str, store: Store, max_columns: int = project.MAX_COLUMNS, max_depth: int = project.MAX_DEPTH, max_bytes: int = GENERATION_BYTES):
        self.spark, self.directory, self.store = spark, directory, store
        self.max_columns, self.max_depth, self.max_bytes = max_columns, max_depth, max_bytes
        self.checkpoint = frames.Checkpoint(directory)
        spark.dataSource.register(FrameSource)
        if self.checkpoint.load() > store.next:
            raise Behind("the store lies behind the checkpoint")

    def publish(self, batch: DataFrame, _: int | None = None) -> None:
        """Publishes a batch of frames from the store's next sequence on; frames before it are there already."""
        start = self.store.next
        fresh = batch.filter(F.col("wal_sequence") >= start)
        low, high = fresh.agg(F.min("wal_sequence"), F.max("wal_sequence")).first()
        if low is not None:
            identities = project.discover(fresh, self.max_columns, self.max_depth)
            self.store.publish(project.project(fresh, identities, self.max_depth), low, high + 1)
        self.done()

    def done(self) -> None:
        if self.store.next > self.checkpoint.load():
            self.checkpoint.commit(self.store.next)
            frames.retain(self.directory, self.store.next)

    def read(self, end: int | None = None) -> DataFrame:
        """The frames that are not published yet, up to `end`, as a batch."""
        return self.read_from(self.store.next, end)

    def read_from(self, start: int, end: int | None = None) -> DataFrame:
        reader = self.spark.read.format("siltstone_frames").option("path", self.directory).option("start", start)
        return (reader if end is None else reader.option("end", end)).load()

    def fresh(self, start: int) -> DataFrame | None:
        """The rows of the frames from `start` on that are not published, None if there are none.

        A generation of them at most is taken as it is now, which a publication meanwhile does not change; more, which the
        consumer is about to publish, are left to Spark to read.
        """
        if frames.next_sequence(self.directory) <= start:
            return None
        end = frames.generation_end(self.directory, start, self.max_bytes)
        if end < frames.next_sequence(self.directory):
            batch = self.read_from(start)
        else:
            found = list(frames.read_from(self.directory, start, end))
            if not found or found[0].sequence != start:
                raise Behind("frames were given up meanwhile")
            batch = self.spark.createDataFrame([(f.sequence, f.tenant, f.received, f.signal, f.payload) for f in found], SCHEMA)
        return project.project(batch, project.discover(batch, self.max_columns, self.max_depth), self.max_depth)

    def run_once(self) -> None:
        """Publishes what there is, generation by generation."""
        while (end := frames.generation_end(self.directory, self.store.next, self.max_bytes)) > self.store.next:
            self.publish(self.read(end))
        self.done()

    def start(self, state: str, interval_ms: int | None = None) -> StreamingQuery:
        """A stream that publishes every interval, or what there is and then stops. state is the stream's own checkpoint folder.

        With an interval a batch is one generation. A stream that stops plans its only batch when it starts, whatever its
        size, so that batch is published generation by generation.
        """
        stream = self.spark.readStream.format("siltstone_frames").option("path", self.directory).option("start", self.store.next)
        if interval_ms is None:
            writer = stream.load().writeStream.foreachBatch(self.publish_by_generation).trigger(availableNow=True)
        else:
            writer = stream.option("max_bytes", self.max_bytes).load().writeStream.foreachBatch(self.publish).trigger(processingTime=f"{interval_ms} milliseconds")
        return writer.option("checkpointLocation", state).start()

    def publish_by_generation(self, batch: DataFrame, _: int | None = None) -> None:
        last = batch.agg(F.max("wal_sequence")).first()[0]
        while last is not None and self.store.next <= last:
            end = min(frames.generation_end(self.directory, self.store.next, self.max_bytes), last + 1)
            self.publish(self.read(end))
        self.done()
