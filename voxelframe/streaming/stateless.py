"""The stateless operators on streams: a stream of voxels against static tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelframe.operators.overlap import AT


def read_voxels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def colocated(stream: DataFrame, static: DataFrame) -> DataFrame:
    """Each arriving voxel with the columns of a static table at its place."""
    return stream.join(static, AT)


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Apply a batch operator to every micro-batch and append its rows; a batch that is tried again writes its own folder anew."""

    def run(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
