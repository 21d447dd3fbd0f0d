"""Measurements of cells: cells(volume_id, z, y, x, label), intensity(volume_id, z, y, x, i)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions import cube, shape

KEY = ["volume_id", "label"]
PERCENTS = [10, 20, 30, 40, 50, 60, 70, 80, 90]


def intensity_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, std (population) and percentiles 10 to 90, interpolated, of each group."""
    q = F.percentile(value, F.array(*[F.lit(p / 100) for p in PERCENTS]))
    found = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), q.alias("q"))
    return found.select(*keys, "mean", "std", *[F.col("q")[k].alias(f"percentile_{p}") for k, p in enumerate(PERCENTS)])


def marker_frame(rows: DataFrame, keys: list[str], marker: str, value: str, markers: list[str]) -> DataFrame:
    """One row for each group, with <marker>_mean and <marker>_std for the named markers."""
    return rows.groupBy(*keys).pivot(marker, markers).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def robust_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median, p25, p75 and mad, the median distance from the median."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    quarter = rows.groupBy(*keys).agg(q.alias("q"))
    away = rows.join(quarter, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("q")[1])).alias("mad"))
    return quarter.join(away, keys).select(*keys, F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "mad")


def region_basics(cells: DataFrame) -> DataFrame:
    """area, centroid, bounding box and height of each cell."""
    sides = [f(c).alias(f"{c}_{n}") for c in "zyx" for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return cells.groupBy(*KEY).agg(F.count("*").alias("area"), *sides).withColumn("size_z", F.col("z_max") - F.col("z_min") + 1)


def morphology(cells: DataFrame, vz: float, vy: float, vx: float) -> DataFrame:
    """Volume, position and covariance eigenvalues (over n, in physical units) of each cell, with derived shapes.

    One pass: whole-number moments of a cell give all of it.
    """
    sums = [F.count("*").alias("n")] + [F.sum(F.col(a).cast("long")).alias(f"s{a}") for a in "zyx"] + [F.sum((F.col(a) * F.col(b)).cast("long")).alias(f"s{a}{b}") for a, b in ("zz", "yy", "xx", "zy", "zx", "yx")]
    m = cells.groupBy(*KEY).agg(*sums)
    size = {"z": vz, "y": vy, "x": vx}
    n = F.col("n").cast("double")

    def cov(a: str, b: str) -> F.Column:
        return (F.col(f"s{a}{b}") / n - (F.col(f"s{a}") / n) * (F.col(f"s{b}") / n)) * (size[a] * size[b])

    values = shape.eigenvalues(cov("x", "x"), cov("y", "y"), cov("z", "z"), cov("y", "x"), cov("z", "x"), cov("z", "y"))
    rows = m.withColumn("e", values)
    e1, e2, e3 = (F.greatest(F.col("e")[k], F.lit(0.0)) for k in range(3))
    volume = n * (vz * vy * vx)
    return rows.select(
        *KEY, volume.alias("volume"), *[(F.col(f"s{a}") / n * size[a]).alias(f"position_{a}") for a in "zyx"], e1.alias("eigenvalue_1"), e2.alias("eigenvalue_2"), e3.alias("eigenvalue_3"),
        shape.equivalent_diameter(volume).alias("equivalent_diameter"), shape.prolateness(e1, e3).alias("prolateness"), shape.oblateness(e1, e2, e3).alias("oblateness"),
        shape.axis_ratio(e2, e1).alias("second_ratio"), shape.axis_ratio(e3, e2).alias("first_ratio"), shape.axis_length(e3).alias("major_length"),
    )


def eigenvectors(cells: DataFrame, vz: float, vy: float, vx: float) -> DataFrame:
    """(volume_id, label, k, z, y, x): unit eigenvectors of each cell's covariance, largest component positive.

    The solver sees one row for each cell, not its voxels.
    """
    import numpy as np
    import pandas as pd

    sums = [F.count("*").alias("n")] + [F.sum(a).cast("double").alias(f"s{a}") for a in "zyx"] + [F.sum(F.col(a) * F.col(b)).cast("double").alias(f"s{a}{b}") for a, b in ("zz", "yy", "xx", "zy", "zx", "yx")]

    def solve(frames):
        for f in frames:
            n = f.n.to_numpy(float)
            out = []
            m = np.zeros((len(f), 3, 3))
            scale = {"z": vz, "y": vy, "x": vx}
            for p, a in enumerate("zyx"):
                for q, b in enumerate("zyx"):
                    s = f[f"s{a}{b}" if f"s{a}{b}" in f else f"s{b}{a}"].to_numpy()
                    m[:, p, q] = (s / n - f[f"s{a}"].to_numpy() / n * f[f"s{b}"].to_numpy() / n) * scale[a] * scale[b]
            _, v = np.linalg.eigh(m)
            for k in range(3):
                u = v[:, :, k]
                u = u * np.sign(u[np.arange(len(u)), np.abs(u).argmax(1)])[:, None]
                out.append(pd.DataFrame({"volume_id": f.volume_id, "label": f.label, "k": k + 1, "z": u[:, 0], "y": u[:, 1], "x": u[:, 2]}))
            yield pd.concat(out)

    return cells.groupBy(*KEY).agg(*sums).mapInPandas(solve, "volume_id string, label int, k int, z double, y double, x double")


def surface(cells: DataFrame, vz: float, vy: float, vx: float) -> DataFrame:
    """(volume_id, label, surface_area, mesh_volume, sphericity) of each cell, by the surface through the middles of voxel edges.

    A voxel sets one corner of the eight cubes around it; a cube's corners are a number from 1 to 255, for which area and content are
    known. The corners are summed before the shuffle, and cubes inside a cell have no surface. Sphericity is that of the
    mesh: the surface of a ball of its content over its own. Surfaces of two cells that touch are two.
    """
    table = cells.sparkSession.createDataFrame(cube.pieces(vz, vy, vx), "code int, area double, nz double, ny double, nx double, moment double")
    corners = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx"), F.lit(1 << (4 * a + 2 * b + c)).alias("bit")) for a, b, c in cube.CORNERS])
    spread = cells.select(*KEY, F.explode(corners).alias("s"), "z", "y", "x").select(*KEY, *[(F.col(c) - F.col(f"s.d{c}")).alias(c) for c in "zyx"], "s.bit")
    codes = spread.groupBy(*KEY, "z", "y", "x").agg(F.bit_or("bit").alias("code")).where("code < 255")
    met = codes.join(F.broadcast(table), "code")  # 256 rows
    place = F.col("z") * vz * F.col("nz") + F.col("y") * vy * F.col("ny") + F.col("x") * vx * F.col("nx")
    found = met.groupBy(*KEY).agg(F.sum("area").alias("surface_area"), (F.sum(place + F.col("moment")) / 3).alias("mesh_volume"))
    return found.withColumn("sphericity", F.cbrt(36 * math.pi * F.col("mesh_volume") * F.col("mesh_volume")) / F.col("surface_area"))


POWERS = [(p, q, r) for p in range(4) for q in range(4) for r in range(4) if p + q + r >= 2]


def central_moments(rows: DataFrame, weight: str) -> DataFrame:
    """Weighted centroid's distance from the plain one, also in equivalent diameters and major axes, and the 60 normalised
    weighted central moments with powers up to 3 and order 2 or more. Without weight, distances and moments are 0."""
    w = F.col(weight).cast("double")
    square = [F.sum((F.col(a) * F.col(b)).cast("long")).alias(f"s{a}{b}") for a, b in ("zz", "yy", "xx", "zy", "zx", "yx")]
    first = rows.groupBy(*KEY).agg(F.sum(w).alias("w"), F.count("*").alias("n"), *square, *[F.avg(c).alias(f"c{c}") for c in "zyx"], *[F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(f"w{c}") for c in "zyx"])
    cov = lambda a, b: F.col(f"s{a}{b}") / F.col("n") - F.col(f"c{a}") * F.col(f"c{b}")
    values = shape.eigenvalues(cov("x", "x"), cov("y", "y"), cov("z", "z"), cov("y", "x"), cov("z", "x"), cov("z", "y"))
    major = shape.axis_length(values[2], 1.0)
    away = F.sqrt(sum((F.coalesce(F.col(f"w{c}") - F.col(f"c{c}"), F.lit(0.0)) * F.coalesce(F.col(f"w{c}") - F.col(f"c{c}"), F.lit(0.0))) for c in "zyx"))
    first = first.select(*KEY, "w", "wz", "wy", "wx", away.alias("displacement"), (away / F.cbrt(6 * F.col("n") / F.lit(math.pi))).alias("displacement_in_diameters"), (away / F.when(major == 0, 1.0).otherwise(major)).alias("displacement_in_majors"))
    kept = ["w", "displacement", "displacement_in_diameters", "displacement_in_majors"]
    near = rows.join(first, KEY)
    for c in "zyx":
        near = near.withColumn(f"{c}1", F.col(c) - F.col(f"w{c}")).withColumn(f"{c}2", F.col(f"{c}1") * F.col(f"{c}1")).withColumn(f"{c}3", F.col(f"{c}2") * F.col(f"{c}1"))
    term = lambda powers: math.prod([w, *(F.col(f"{c}{k}") for c, k in zip("zyx", powers, strict=True) if k)][1:], start=w)
    sums = near.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in kept], *[F.sum(term(k)).alias("m{}{}{}".format(*k)) for k in POWERS])
    normal = lambda k: F.coalesce(F.try_divide(F.col("m{}{}{}".format(*k)), F.pow("w", F.lit(sum(k) / 3 + 1))), F.lit(0.0))
    return sums.select(*KEY, *kept[1:], *[normal(k).alias("moment_{}{}{}".format(*k)) for k in POWERS])


def all_features(cells: DataFrame, channels: dict[str, DataFrame], grey: int = 1) -> DataFrame:
    """Area and axis ratios of each cell, and for each channel(volume_id, z, y, x, i) its intensities, moments and texture.

    A channel's columns have its name in front. grey: by how much values are divided for texture. Cells that a channel has no voxel of
    keep nulls there. Every part is grouped by cell, so the joins share one partitioning.
    """
    shapes = morphology(cells, 1.0, 1.0, 1.0).select(*KEY, F.col("volume").cast("long").alias("area"), "second_ratio", "first_ratio")
    for name, rows in channels.items():
        lit = cells.join(rows.select("volume_id", "z", "y", "x", "i"), ["volume_id", "z", "y", "x"])
        parts = [intensity_stats(lit, KEY, "i"), robust_stats(lit, KEY, "i"), central_moments(lit, "i"), texture(lit.withColumn("g", F.floor(F.col("i") / grey)), "g")]
        for part in parts:
            shapes = shapes.join(part.select(*KEY, *[F.col(c).alias(f"{name}_{c}") for c in part.columns if c not in KEY]), KEY, "left")
    return shapes


def histogram(rows: DataFrame, value: str, bins: int = 256, by: list[str] | None = None) -> DataFrame:
    """(by..., bin, count, low, high): even bins over each group's range; the last one holds the maximum."""
    by = by or []
    ends = rows.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    joined = rows.join(ends, by) if by else rows.join(ends)  # without groups: one row
    place = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("low")) * bins / (F.col("high") - F.col("low")))))
    return joined.groupBy(*by, place.cast("int").alias("bin"), "low", "high").agg(F.count("*").alias("count"))


def fixed_histogram(rows: DataFrame, value: str, width: int, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, F.floor(F.col(value) / width).cast("int").alias("bin")).agg(F.count("*").alias("count"))


def otsu(counts: DataFrame, by: list[str], value: str = "value", count: str = "count") -> DataFrame:
    """(by..., threshold): the value up to which the lower class goes, of most variance between classes; ties: the smallest.

    counts: a row for each value of a group, so its windows are as long as a histogram.
    """
    order = Window.partitionBy(*by).orderBy(value)
    n, total = F.sum(count).over(order).cast("double"), F.sum(F.col(value) * F.col(count)).over(order).cast("double")
    whole = Window.partitionBy(*by)
    rows = counts.select(*by, value, n.alias("n"), total.alias("s"), F.sum(count).over(whole).cast("double").alias("nn"), F.sum(F.col(value) * F.col(count)).over(whole).cast("double").alias("ss"))
    rows = rows.where("n < nn").withColumn("between", F.col("n") * (F.col("nn") - F.col("n")) * F.pow(F.col("s") / F.col("n") - (F.col("ss") - F.col("s")) / (F.col("nn") - F.col("n")), F.lit(2)))
    return rows.groupBy(*by).agg(F.min_by(value, F.struct((-F.round("between", 3)).alias("b"), F.col(value))).alias("threshold"))


def four_levels(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """rows with `level` 0.1, 0.25, 0.75 or 0.9, by the Otsu threshold and those of each half."""
    counts = rows.groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("count"))
    middle = otsu(counts, by)
    halves = counts.join(middle, by).withColumn("upper", F.col("value") > F.col("threshold"))
    own = otsu(halves.drop("threshold"), [*by, "upper"]).withColumnRenamed("threshold", "own")
    marked = rows.join(middle, by).withColumn("upper", F.col(value) > F.col("threshold")).join(own, [*by, "upper"], "left")
    above = F.coalesce(F.col(value) > F.col("own"), F.lit(False))
    level = F.when(F.col("upper"), F.when(above, 0.9).otherwise(0.75)).otherwise(F.when(above, 0.25).otherwise(0.1))
    return marked.withColumn("level", level).drop("threshold", "own", "upper")


def chunk_means(rows: DataFrame, every: int = 3) -> DataFrame:
    """Sums over `every` consecutive slices divided by `every` and cut to whole numbers; a short last chunk too."""
    return rows.groupBy("volume_id", F.expr(f"int(z div {every})").alias("chunk"), "y", "x").agg(F.floor(F.sum("i") / every).cast("int").alias("i"))


def describe(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """n, min, max, mean, variance (n - 1), skewness and kurtosis of each column, a row for each."""
    long = rows.select(*by, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "value"))
    return long.groupBy(*by, "feature").agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"))


DIRECTIONS = [(dz, dy, dx) for dz in (0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dz, dy, dx) > (0, 0, 0)]


STATISTICS = ["energy", "contrast", "correlation", "variance", "homogeneity", "sum_average", "sum_variance", "sum_entropy", "entropy", "difference_variance", "difference_entropy", "information_1", "information_2"]


def texture(rows: DataFrame, value: str) -> DataFrame:
    """13 grey-level co-occurrence statistics of each cell, as mean and range over the 13 directions of space.

    rows: (volume_id, label, z, y, x, value), whole values; all voxels of a cell count, with 1 at least. A cell of one slice is
    taken twice, one slice above the other. Pairs count both ways; directions without pairs are left out, and a cell
    without any has zeros. A voxel meets at most 13 others of its cell, which bounds the join. All but the entropies come from
    sums of whole numbers, or sorted ones (homogeneity), so they don't depend on the order of rows.
    """
    own = rows.select(*KEY, "z", "y", "x", F.greatest(F.col(value), F.lit(1)).cast("long").alias("g"))
    flat = own.groupBy(*KEY).agg((F.min("z") == F.max("z")).alias("flat"))
    twice = own.join(flat, KEY).withColumn("z", F.explode(F.when(F.col("flat"), F.array(F.col("z"), F.col("z") + 1)).otherwise(F.array("z")))).drop("flat")
    steps = F.array(*[F.struct(F.lit(k).alias("d"), F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for k, (a, b, c) in enumerate(DIRECTIONS)])
    shifted = twice.select(*KEY, F.explode(steps).alias("s"), "z", "y", "x", F.col("g").alias("a"))
    shifted = shifted.select(*KEY, "s.d", *[(F.col(c) + F.col(f"s.d{c}")).alias(c) for c in "zyx"], "a")
    met = shifted.join(twice.withColumnRenamed("g", "b"), [*KEY, "z", "y", "x"])
    counts = met.groupBy(*KEY, "d", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    # of each unordered pair: both orders of the joint table, the sum, the difference, and both values of the margin
    kinds = [("joint", a * (1 << 31) + b, n * F.when(a == b, 2).otherwise(1)), ("joint", F.when(a != b, b * (1 << 31) + a), n), ("sum", a + b, 2 * n), ("difference", b - a, 2 * n), ("margin", a, n), ("margin", b, n)]
    tables = F.array(*[F.struct(F.lit(kind).alias("kind"), k.alias("k"), m.alias("n")) for kind, k, m in kinds])
    cells = counts.select(*KEY, "d", "a", "b", n.alias("pairs"), F.posexplode(tables).alias("at", "t")).where("t.k IS NOT NULL")
    first = F.col("at") == 0
    sums = {"aa": a * a + b * b, "ab": 2 * a * b, "a1": a + b, "d1": 2 * (b - a)}
    filled = cells.groupBy(*KEY, "d", "t.kind", "t.k").agg(F.sum("t.n").alias("n"), *[F.sum(F.when(first, F.col("pairs") * v).otherwise(0)).alias(c) for c, v in sums.items()])
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    log = n * F.log2(n.cast("double"))
    per = filled.groupBy(*KEY, "d").agg(
        of("joint", n).cast("double").alias("n"), of("joint", n * n).cast("double").alias("nn"), *[F.sum(c).cast("double").alias(c) for c in sums],
        F.aggregate(F.array_sort(F.collect_list(F.when(F.col("kind") == "difference", F.struct("k", "n")))), F.lit(0.0), lambda s, p: s + p["n"] / (1 + p["k"] * p["k"])).alias("near"), *[of(kind, log).alias(f"log_{kind}") for kind in ("joint", "sum", "difference", "margin")],
    )
    mean, square = F.col("a1") / n, F.col("aa") / n
    entropy = {kind: F.log2(n) - F.col(f"log_{kind}") / n for kind in ("joint", "sum", "difference", "margin")}
    spread = square - mean * mean
    contrast = 2 * (F.col("aa") - F.col("ab")) / n
    found = {
        "energy": F.col("nn") / (n * n), "contrast": contrast, "variance": spread, "homogeneity": F.col("near") / n, "entropy": entropy["joint"], "sum_entropy": entropy["sum"], "difference_entropy": entropy["difference"],
        "correlation": F.when(spread <= 0, 1.0).otherwise((F.col("ab") / n - mean * mean) / spread), "sum_average": 2 * mean, "sum_variance": 2 * (F.col("aa") + F.col("ab")) / n - 4 * mean * mean,
        "difference_variance": contrast - (F.col("d1") / n) * (F.col("d1") / n),
        "information_1": F.coalesce(F.try_divide(entropy["joint"] - 2 * entropy["margin"], entropy["margin"]), F.lit(0.0)),
        "information_2": F.sqrt(F.greatest(F.lit(0.0), 1 - F.exp(-2 * (2 * entropy["margin"] - entropy["joint"])))),
    }
    # n counts each pair twice, and the sums hold both of its orders
    stats = per.select(*KEY, *[found[c].alias(c) for c in STATISTICS])
    out = stats.groupBy(*KEY).agg(*[x for c in STATISTICS for x in (F.avg(c).alias(f"{c}_mean"), (F.max(c) - F.min(c)).alias(f"{c}_range"))])
    return flat.select(KEY).join(out, KEY, "left").na.fill(0.0)
