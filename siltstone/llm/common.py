"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import warnings
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as objects at once; one longer text makes a slice of its own.
SLICE_BYTES = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def trimmed() -> None:
    """Gives memory that is free back to the machine: workers live on from task to task, and what one task needed once would add to what the next needs."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of at most `limit` bytes of `column`, or of one row."""
    trimmed()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
    trimmed()


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def map_texts(df: DataFrame, id_col: str, text_col: str, rows: Callable[[list, list[str]], dict[str, list]], schema: str) -> DataFrame:
    """Maps (ids, texts) of slices to columns; only the two named columns are read, whatever others there are."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "t"):
            out = rows(part.column("i").to_pylist(), texts(part, "t"))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def map_rows(df: DataFrame, text_col: str, change: Callable[[list[str | None]], dict[str, pa.Array]], schema: str | None = None) -> DataFrame:
    """Maps whole rows: `change` gets the texts of a slice and returns columns that replace or extend the row's."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = schema or df.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, text_col):
            new = change(part.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else part.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir, or what the context was given. Only where both are unset, as in tests, a folder of our own, with a warning off a local master."""
    sc = spark.sparkContext
    if not (named := spark.conf.get("spark.checkpoint.dir", "")) and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            warnings.warn("spark.checkpoint.dir is not set: checkpoints lie in a folder that other machines do not see", stacklevel=2)
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder.

    The frame is made anew from the checkpoint's rows: as it comes it keeps its plan's size estimate and constraints,
    which loops of joins multiply until planning takes minutes.
    """
    spark = df.sparkSession
    shared_folder(spark)
    done = df.checkpoint()._jdf
    frame = DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)
    frame.checkpoint_file = done.queryExecution().logical().rdd().getCheckpointFile().get()
    return frame


def released(*frames: DataFrame) -> None:
    """Deletes the files of frames from checkpointed(), which nothing may read again."""
    for frame in frames:
        deleted(frame.sparkSession, frame.checkpoint_file)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(stem: str, taken: Iterable[str]) -> str:
    """A column name that clashes with none of `taken`, whatever their case."""
    used = {x.lower() for x in taken}
    return next(x for i in range(len(used) + 1) if (x := f"{stem}{i}").lower() not in used)
