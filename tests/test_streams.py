"""Stateless operators on streams, and users' functions."""

from pyspark.sql import functions as F

from voxelframe.functions import callbacks
from voxelframe.operators import grid
from voxelframe.streaming import stateless


def test_each_batch_equals_the_batch_job(spark, tmp_path):
    rows = spark.range(60).select(F.lit("v").alias("volume_id"), *[F.expr(f"int(id div {k} % 4)").alias(c) for c, k in (("z", 16), ("y", 4), ("x", 1))], F.col("id").cast("int").alias("i"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = stateless.read_voxels(spark, f"{tmp_path}/in", "volume_id string, z int, y int, x int, i int")
    static = rows.select(*grid.AT, (F.col("i") % 2).alias("label"))
    stateless.each_batch(stateless.colocated(stream, static), lambda b: b.where("label = 1"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(r.i for r in out.collect()) == list(range(1, 60, 2))


def test_functions_per_slice(spark):
    rows = spark.createDataFrame([("v", 0, 0, 0, 1), ("v", 0, 0, 1, 5), ("v", 1, 0, 0, 7)], "volume_id string, z int, y int, x int, i int")
    top = callbacks.per_slice(rows, lambda f: f.nlargest(1, "i"), "volume_id string, z int, y int, x int, i int")
    assert sorted((r.z, r.i) for r in top.collect()) == [(0, 5), (1, 7)]
    assert callbacks.expanded(rows, lambda c: [c, -c], "i").count() == 6
