"""Random flips and shifts of volumes, alike for an image and its truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.functions import draws


def _sized(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    return rows.join(sizes.select("volume_id", *[F.col(f"size_{c}").cast("int").alias(f"_{c}") for c in "zyx"]), "volume_id")


def flips(rows: DataFrame, sizes: DataFrame, seed: int, key: Sequence[str] = ("volume_id",), axis: str | None = None, probability: float = 1.0) -> DataFrame:
    """rows mirrored along one axis, drawn for each value of `key`, or the given one, with this probability.

    Places alone change, so an image and its truth with equal keys and seeds are turned alike, as are rows of any channels.
    """
    along = F.lit(axis) if axis else F.element_at(F.array(*[F.lit(c) for c in "zyx"]), draws.whole(F.lit(1), F.lit(3), seed, "axis", *key))
    turned = draws.unit(seed, "flip", *key) < probability
    moved = _sized(rows, sizes).withColumns({"_axis": along, "_turned": turned})
    return moved.withColumns({c: F.when(F.col("_turned") & (F.col("_axis") == c), F.col(f"_{c}") - 1 - F.col(c)).otherwise(F.col(c)) for c in "zyx"}).select(rows.columns)


def shifts(rows: DataFrame, sizes: DataFrame, between: tuple[int, int], seed: int, values: list[str], key: Sequence[str] = ("volume_id",), axes: str | None = None, probability: float = 1.0) -> DataFrame:
    """Dense rows moved by one whole number from `between` along the axes given, or each axis with a chance of one half.

    What leaves the volume is 0 where others came from: each place that has a row keeps one, with zeros in the columns `values` if nothing came there.
    What is moved to a place without a row goes. All columns but places and values say which image a row is of.
    """
    by = draws.whole(F.lit(between[0]), F.lit(between[1]), seed, "shift", *key)
    moves = draws.unit(seed, "shifted", *key) < probability
    chosen: dict[str, Column] = {c: F.lit(c in axes) if axes is not None else draws.unit(seed, f"along_{c}", *key) < 0.5 for c in "zyx"}
    step = rows.withColumn("_by", F.when(moves, by).otherwise(0))
    moved = step.withColumns({c: F.col(c) + F.when(chosen[c], F.col("_by")).otherwise(0) for c in "zyx"})
    of = [c for c in rows.columns if c not in values]
    both = moved.select(*of, *values, F.lit(False).alias("_place")).unionByName(rows.select(*of, *[F.lit(None).cast(rows.schema[v].dataType).alias(v) for v in values], F.lit(True).alias("_place")))
    met = both.groupBy(*of).agg(F.max("_place").alias("_place"), *[F.max(v).alias(v) for v in values])
    return met.where("_place").select(*[F.coalesce(c, F.lit(0)).cast(rows.schema[c].dataType).alias(c) if c in values else F.col(c) for c in rows.columns])
