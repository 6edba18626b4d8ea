"""Helpers that the text operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to numpy at once; a longer single text still goes whole.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set here only where the session names none, as in tests."""
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not set_to:
        sc.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
        set_to = sc.getCheckpointDir()
    return set_to


def settle(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage, survives lost executors.

    Shuffle files stay on disk until the driver's collector finds their owners
    gone; as the written table needs none of them, it is told to look now.  The
    table itself goes when the driver ends, if not before by :func:`drop_settled`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    schema = df.schema
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    del df
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(schema).parquet(path)
    out.count()  # until another job has run the session still holds the one that wrote
    gc.collect()
    spark._jvm.System.gc()
    return out


def drop_settled(*frames: DataFrame) -> None:
    """Delete what :func:`settle` wrote for ``frames``; only for tables nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            if folder.getName().startswith("tessera-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker hands free memory back: idle workers stay beside those of later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def lower_ascii(col):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(batch: pa.RecordBatch, text_at: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose texts hold about ``limit`` bytes; at least one row each."""
    import numpy as np

    col = batch.column(text_at)
    n = len(col)
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64) if n else np.zeros(0, np.int64)
    start, held = 0, 0
    for i in range(n):
        if i > start and held + sizes[i] > limit:
            yield start, i
            start, held = i, 0
        held += int(sizes[i])
    if start < n:
        yield start, n
