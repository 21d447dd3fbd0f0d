"""Matching of labels by shared voxels. Labels are sparse tables (volume_id, z, y, x, label); 0 or absent is background."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AT = ["volume_id", "z", "y", "x"]


def colocate(left: DataFrame, right: DataFrame) -> DataFrame:
    """Voxels of both tables, with the columns of both."""
    return left.join(right, AT)


def best_overlap(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(volume_id, label, match, pixels, fraction): for each left label the right label with most shared voxels.

    fraction: shared voxels of all the left label's voxels. Ties go to the pair whose first shared voxel comes first in
    raster order. `by`: columns of right that make matches of their own (such as a class name).
    """
    by = by or []
    keys = ["volume_id", *by, "label"]
    both = left.where("label > 0").join(right.where("label > 0").withColumnRenamed("label", "match"), AT)
    pairs = both.groupBy(*keys, "match").agg(F.count("*").alias("pixels"), F.min(F.struct("z", "y", "x")).alias("first"))
    order = F.struct((-F.col("pixels")).alias("n"), F.col("first"), "match")
    best = pairs.groupBy(*keys).agg(F.min(order).alias("best"))
    total = left.where("label > 0").groupBy("volume_id", "label").agg(F.count("*").alias("total"))
    chosen = best.join(total, ["volume_id", "label"])
    pixels = -F.col("best.n")
    return chosen.select(*keys, F.col("best.match").alias("match"), pixels.alias("pixels"), (pixels / F.col("total")).alias("fraction"))


def classes_from_areas(labels: DataFrame, areas: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """(volume_id, label, class, fraction, pixels) for every label: its best area's value if that covers enough, else 0.

    areas: (volume_id, z, y, x, value) with further columns named in `by`, whose values are known from areas.
    """
    by = by or []
    every = labels.where("label > 0").select("volume_id", "label").distinct()
    if by:
        every = every.join(areas.select("volume_id", *by).distinct(), "volume_id")
    found = best_overlap(labels, areas.withColumnRenamed("value", "label"), by)
    rows = every.join(found, ["volume_id", *by, "label"], "left")
    good = F.col("fraction") >= threshold
    return rows.select("volume_id", *by, "label", F.when(good, F.col("match")).otherwise(0).alias("class"), F.coalesce("fraction", F.lit(0.0)).alias("fraction"), F.coalesce("pixels", F.lit(0)).alias("pixels"))


def bounding_box(voxels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Smallest and largest z, y, x; no row for no voxels."""
    sides = [f(c).alias(f"{c}_{n}") for c in "zyx" for n, f in (("min", F.min), ("max", F.max))]
    return voxels.groupBy(*(by or ["volume_id"])).agg(*sides)


def has_gaps(voxels: DataFrame) -> DataFrame:
    """(volume_id, gaps): whether a slice inside the bounding box is empty."""
    return voxels.groupBy("volume_id").agg((F.count_distinct("z") < F.max("z") - F.min("z") + 1).alias("gaps"))


def classes_in_annotated_slices(labels: DataFrame, areas: DataFrame, sizes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """classes_from_areas() within the annotated range of z, or the middle slice where nothing is annotated.

    sizes: (volume_id, size_z).
    """
    box = areas.where("value > 0").groupBy("volume_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    middle = F.expr("int(size_z div 2)")
    span = sizes.select("volume_id", "size_z").join(box, "volume_id", "left").select("volume_id", F.coalesce("lo", middle).alias("lo"), F.coalesce("hi", middle).alias("hi"))
    inside = labels.join(span, "volume_id").where("z BETWEEN lo AND hi").drop("lo", "hi")
    return classes_from_areas(inside, areas.where("value > 0"), threshold)


def class_members(labels: DataFrame, masks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(volume_id, class_name, label) of the labels positive in each class's mask (value over 128)."""
    on = masks.where("value > 128").select(*AT, "class_name", F.lit(1).alias("label"))
    found = best_overlap(labels, on, ["class_name"])
    return found.where(F.col("fraction") >= threshold).select("volume_id", "class_name", "label")


def without_blob_labels(labels: DataFrame, blobs: DataFrame, blob: int, least: float) -> DataFrame:
    """labels without those whose best match in blobs is `blob` with at least that fraction."""
    gone = best_overlap(labels, blobs).where((F.col("match") == blob) & (F.col("fraction") >= least))
    return labels.join(gone.select("volume_id", "label"), ["volume_id", "label"], "left_anti").select(*AT, "label")


def without_area(image: DataFrame, area: DataFrame) -> DataFrame:
    return image.join(area, AT, "left_anti")


def one_to_one(labels: DataFrame, other: DataFrame, least: float) -> DataFrame:
    """(volume_id, label, match, iou): pairs whose intersection over union exceeds `least`; over 0.5 they are unique."""
    both = labels.join(other.withColumnRenamed("label", "match"), AT).groupBy("volume_id", "label", "match").agg(F.count("*").alias("n"))
    a = labels.groupBy("volume_id", "label").agg(F.count("*").alias("na"))
    b = other.groupBy("volume_id", F.col("label").alias("match")).agg(F.count("*").alias("nb"))
    iou = F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    return both.join(a, ["volume_id", "label"]).join(b, ["volume_id", "match"]).select("volume_id", "label", "match", iou.alias("iou")).where(F.col("iou") > least)


def disagreeing(labels: DataFrame, other: DataFrame) -> DataFrame:
    """(volume_id, side, label, fraction) of labels whose best match does not cover them wholly, either way."""
    one = best_overlap(labels, other).select("volume_id", F.lit("first").alias("side"), "label", "fraction")
    two = best_overlap(other, labels).select("volume_id", F.lit("second").alias("side"), "label", "fraction")
    return one.unionByName(two).where("fraction < 1")


def rank_order(df: DataFrame, by: list[str], *order: F.Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
