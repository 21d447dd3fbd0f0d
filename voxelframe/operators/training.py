"""Shaping of training images and annotations; sinks of measured tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.operators import grid
from voxelframe.operators.overlap import AT


def without_blobs(rows: DataFrame, marker: int, image: str = "i", truth: str = "label") -> DataFrame:
    """Image and truth are 0 where the truth is the blob marker."""
    blob = F.col(truth) == marker
    return rows.withColumns({image: F.when(blob, 0).otherwise(F.col(image)), truth: F.when(blob, 0).otherwise(F.col(truth))})


def with_channels(labels: DataFrame, sizes: DataFrame, top: int = 255, known: DataFrame | None = None) -> DataFrame:
    """(volume_id, z, y, x, object, boundary): top where a label is, and where its boundary is; objects leave out boundaries.

    known: the voxels that there are, where that is not the whole volume.
    """
    edge = grid.label_edges(labels, sizes, known=known).withColumn("boundary", F.lit(top))
    both = labels.where("label > 0").select(*AT, F.lit(top).alias("object")).join(edge, AT, "full").na.fill(0, ["object", "boundary"])
    return both.withColumn("object", F.when(F.col("boundary") > 0, 0).otherwise(F.col("object")))


def three_classes(rows: DataFrame) -> DataFrame:
    """One-hot background, interior and boundary of with_channels() rows; a boundary wins."""
    edge, inner = F.col("boundary") > 0, (F.col("object") > 0) & (F.col("boundary") == 0)
    return rows.select(*AT, (~edge & ~inner).cast("int").alias("background"), inner.cast("int").alias("interior"), edge.cast("int").alias("edge"))


def normalised(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """A group's values divided by its largest, if they are just 0 and one value over 1."""
    span = rows.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.min(F.when(F.col(value) != 0, F.col(value))).alias("least"))
    two = (F.col("lo") == 0) & (F.col("hi") > 1) & (F.col("least") == F.col("hi"))
    return rows.join(span, by).withColumn(value, F.when(two, F.col(value) / F.col("hi")).otherwise(F.col(value))).drop("lo", "hi", "least")


def noisy(rows: DataFrame, value: str, scale: float, seed: int) -> DataFrame:
    """Normal noise that depends on the place and the seed alone, cut to 0..1."""
    unit = lambda k: (F.pmod(F.xxhash64(*AT, F.lit(seed + k)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    noise = F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * F.pi() * unit(1)) * scale
    return rows.withColumn(value, F.least(F.greatest(F.col(value) + noise, F.lit(0.0)), F.lit(1.0)))


def steps(files: DataFrame, channels: int) -> DataFrame:
    """Sum of pages - (channels - 1); a file with fewer pages than channels is an error."""
    own = F.when(F.col("pages") < channels, F.raise_error(F.lit("fewer pages than channels")).cast("long")).otherwise(F.col("pages") - (channels - 1))
    return files.agg(F.sum(own).alias("steps"))


def certain(rows: DataFrame, label: str, area: str) -> DataFrame:
    return rows.where((F.col(label) <= 1) & (F.col(area) >= 5))


def object_probability(inner: Column, boundary: Column) -> Column:
    return inner * (1 - boundary)


def annotated_slices(rows: DataFrame, annotation: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows of the slices from the first to the last annotated one, or of the middle slice."""
    box = annotation.where("value > 0").groupBy("volume_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    middle = F.expr("int(size_z div 2)")
    span = sizes.select("volume_id", "size_z").join(box, "volume_id", "left").select("volume_id", F.coalesce("lo", middle).alias("lo"), F.coalesce("hi", middle).alias("hi"))
    return rows.join(span, "volume_id").where("z BETWEEN lo AND hi").drop("lo", "hi")


def by_folder(rows: DataFrame, path: str, *columns: str, form: str = "parquet", **options: str) -> None:
    """Write rows under a folder for each value of the columns."""
    rows.write.partitionBy(*columns).options(**options).format(form).save(path)
