"""Cells by combinations of classes. members: (volume_id, class_name, label); cells: (volume_id, label, ...)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_group(cells: DataFrame, members: DataFrame) -> DataFrame:
    """cells with `classes`: the names of a cell's classes, sorted, or no_class."""
    names = members.groupBy("volume_id", "label").agg(F.array_join(F.array_sort(F.collect_set("class_name")), ", ").alias("classes"))
    return cells.drop("classes").join(names, ["volume_id", "label"], "left").withColumn("classes", F.coalesce("classes", F.lit("no_class")))


def class_cube(cells: DataFrame, members: DataFrame, names: list[str]) -> DataFrame:
    """(volume_id, classes, label): cells of all_cells, of no_class, and of every non-empty set of classes (in all of them).

    Groups overlap. Empty groups have one row with a null label for each volume. `names` are the classes; none is an error.
    """
    if not names:
        raise ValueError("no classes")
    subsets = [list(s) for n in range(1, len(names) + 1) for s in itertools.combinations(sorted(names), n)]
    sets = [(", ".join(c), c) for c in subsets] + [("all_cells", [])]
    own = members.where(F.col("class_name").isin(names)).groupBy("volume_id", "label").agg(F.collect_set("class_name").alias("own"))
    known = cells.select("volume_id", "label").distinct().join(own, ["volume_id", "label"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    # each cell names its own groups: at most 2^k for k classes, without a join
    held = [F.when(F.array_contains("own", c[0]) if len(c) == 1 else F.size(F.array_intersect(F.col("own"), F.array(*map(F.lit, c)))) == len(c), name) if c else F.lit(name) for name, c in sets]
    groups = F.when(F.size("own") == 0, F.array(F.lit("all_cells"), F.lit("no_class"))).otherwise(F.array_compact(F.array(*held)))
    rows = known.select("volume_id", F.explode(groups).alias("classes"), "label")
    every = known.select("volume_id").distinct().select("volume_id", F.explode(F.array(*[F.lit(n) for n, _ in sets], F.lit("no_class"))).alias("classes"))
    return every.join(rows, ["volume_id", "classes"], "left")


def volume_stats(voxels: DataFrame, members: DataFrame, names: list[str], sizes: DataFrame) -> DataFrame:
    """Counts, densities and volumes of each group of class_cube().

    voxels: labels; sizes: (volume_id, size_z, size_y, size_x, vz, vy, vx). Volumes are in the cube of the voxel size's unit.
    """
    cells = voxels.where("label > 0").groupBy("volume_id", "label").agg(F.count("*").alias("pixels"))
    groups = class_cube(cells, members, names).join(cells, ["volume_id", "label"], "left")
    per = groups.groupBy("volume_id", "classes").agg(F.count("label").alias("cell_count"), F.coalesce(F.sum("pixels"), F.lit(0)).alias("pixels"))
    everything = cells.groupBy("volume_id").agg(F.count("*").alias("all_count"))
    one = F.col("vz") * F.col("vy") * F.col("vx")
    whole = F.col("size_z") * F.col("size_y") * F.col("size_x") * one
    rows = per.join(sizes, "volume_id").join(everything, "volume_id")
    return rows.select(
        "volume_id", "classes", "cell_count", (F.col("cell_count") / whole).alias("density"), (F.col("pixels") * one / whole).alias("ratio_of_volume"),
        F.try_divide(F.col("cell_count").cast("double"), "all_count").alias("ratio_of_cells"), (F.col("pixels") * one).alias("class_volume"), whole.alias("sample_volume"),
    )


def aggregate_by_group(cells: DataFrame, features: list[str], kinds: list[str]) -> DataFrame:
    """mean, std (population) or median of features for each exact group, and for all_cells together."""
    known = {"mean": F.avg, "std": F.stddev_pop, "median": F.median}
    if unknown := set(kinds) - set(known):
        raise ValueError(f"unknown aggregation: {sorted(unknown)}")
    aggs = [known[k](f).alias(f"{k}_{f}") for f in features for k in kinds]
    return cells.groupingSets([["classes"], []], "classes").agg(*aggs, F.grouping("classes").alias("g")).withColumn("classes", F.when(F.col("g") == 1, "all_cells").otherwise(F.col("classes"))).drop("g")


def in_all(members: DataFrame, names: list[str]) -> DataFrame:
    """Labels that are in every one of the classes."""
    rows = members.where(F.col("class_name").isin(names)).groupBy("volume_id", "label").agg(F.count_distinct("class_name").alias("k"))
    return rows.where(F.col("k") == len(set(names))).select("volume_id", "label")


def in_none(cells: DataFrame, members: DataFrame) -> DataFrame:
    return cells.select("volume_id", "label").distinct().join(members, ["volume_id", "label"], "left_anti")


def cell_counts(labels: DataFrame, sizes: DataFrame, positive: DataFrame | None = None) -> DataFrame:
    """(volume_id, z, cells[, positive_cells]): distinct cells of each slice, and of all slices (z null); empty slices stay.

    positive: (volume_id, z, y, x, value); a cell counts where it has a value over 0.5.
    """
    aggs = [F.count_distinct("label").alias("cells")]
    rows = labels.where("label > 0")
    if positive is not None:
        rows = rows.join(positive, ["volume_id", "z", "y", "x"], "left")
        aggs.append(F.count_distinct(F.when(F.col("value") > 0.5, F.col("label"))).alias("positive_cells"))
    slices = sizes.select("volume_id", F.explode(F.sequence(F.lit(0), (F.col("size_z") - 1).cast("int"))).alias("z"))
    by_slice = slices.join(rows.groupBy("volume_id", "z").agg(*aggs), ["volume_id", "z"], "left").na.fill(0)
    return by_slice.unionByName(rows.groupBy("volume_id").agg(*aggs).withColumn("z", F.lit(None).cast("int")))
