"""The folder that all machines share: where jobs keep checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder below the one that the session names in spark.checkpoint.dir.

    Only a session on one machine may name none; it gets a temporary folder. On a cluster that is an error, as
    the machines would not see each other's files. What is written stays until clear(), so that results read later are whole.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="voxelframe-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    top = named.rstrip("/")
    return top if top.endswith(context.applicationId) else f"{top}/{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; this cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application has written; results that still read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
