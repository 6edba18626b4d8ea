"""Tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        sc.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"


def spread_tasks(spark: SparkSession) -> int:
    """How many tasks costly rows are spread over, whatever their size."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: used by several stages, worked out once; the table goes when the driver ends."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)
