"""Queries: users' own functions over slices, slabs, tiles and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.functions import callbacks
from voxelframe.operators import grid
from voxelframe.operators.overlap import AT
from voxelframe.plans.registry import query

VOXELS = "volume_id string, z int, y int, x int"


@query("f1_per_slice", "SELECT z, y, x, round(i - avg(i) OVER (PARTITION BY z), 6) + 0.0 AS value FROM vox")
def f1(v):
    """Two functions of a slice, one after the other: the mean goes, then the rest is rounded."""
    even = callbacks.per_slice(v.vox(), lambda f: f.assign(value=f.i - f.i.mean())[[*AT, "value"]], f"{VOXELS}, value double")
    return even.select("z", "y", "x", (F.round("value", 6) + 0.0).alias("value"))


@query("f2_one_to_many", "SELECT z, y, x, unnest([i, 2 * i, 255 - i]) AS i FROM vox")
def f2(v):
    return callbacks.expanded(v.vox(), lambda i: [i, 2 * i, 255 - i], "i").select("z", "y", "x", "i")


F3_SQL = """
s AS (SELECT z, y, x, unnest(CASE WHEN z % 4 = 0 AND z > 0 THEN [z // 4 - 1, z // 4] ELSE [z // 4] END)::INT AS slab FROM vox WHERE i >= 128)
SELECT z, y, x, slab, CAST(dense_rank() OVER (PARTITION BY slab ORDER BY (y // 5) * 8 + x // 8) AS INT) AS label FROM s"""


@query("f3_per_slab", F3_SQL)
def f3(v):
    """A labelling function of a slab: its blocks are numbered."""

    def numbered(f):
        block = (f.y // 5) * 8 + f.x // 8
        return f.assign(label=block.rank(method="dense").astype("int32"))[[*AT, "slab", "label"]]

    cut = grid.slabs(v.vox().where("i >= 128").select(*AT), 5)
    return callbacks.per_slab(cut, numbered, f"{VOXELS}, slab int, label int").drop("volume_id")


@query("f4_per_tile", "SELECT z, y, x, i - min(i) OVER (PARTITION BY z, y // 5, x // 8) AS value FROM vox")
def f4(v):
    cut = v.vox().select(*AT, F.expr("int(y div 5)").alias("row"), F.expr("int(x div 8)").alias("col"), F.col("i").alias("value"))
    return callbacks.per_tile(cut, lambda f: f.assign(value=f.value - f.value.min()), cut.schema).select("z", "y", "x", "value")


@query("f5_filters", "SELECT z, y, x, i FROM vox WHERE i > 120 AND x % 2 = 0 AND z IN (SELECT z FROM vox GROUP BY 1 HAVING max(i) > 170)")
def f5(v):
    bright = lambda d: d.join(d.groupBy("z").agg(F.max("i").alias("top")).where("top > 170"), "z", "left_semi")
    return callbacks.filtered(v.vox(), [bright, lambda d: d.where("i > 120"), lambda d: d.where("x % 2 = 0")]).select("z", "y", "x", "i")


@query("f7_pair_metrics", "SELECT z, round(avg(abs((x + y) % 5)), 6) AS error, max((x + y) % 5) AS most, round(corr(i, i + (x + y) % 5), 6) AS correlation FROM vox GROUP BY 1")
def f7(v):
    pairs = v.vox().withColumn("other", F.col("i") + (F.col("x") + F.col("y")) % 5)
    metrics = {"error": lambda a, b: F.round(F.avg(F.abs(a - b)), 6), "most": lambda a, b: F.max(b - a), "correlation": lambda a, b: F.round(F.corr(a, b), 6)}
    return callbacks.per_pair(pairs, metrics, "i", "other", ["z"])
