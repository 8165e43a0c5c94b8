"""Cutting lineage: tables written to the shared folder that the cluster names."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder in the shared place that spark.checkpoint.dir names.

    Where the setting is missing (tests, a single machine), a folder of this machine is set;
    a cluster without the setting is an error, since executors don't share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "/tmp/pointloom-checkpoints"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pointloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends here."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that ``written`` returned: nothing that is still to be computed may read it."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver notice which shuffles nothing refers to any more, so their files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
