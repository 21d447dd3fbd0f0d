"""Distances in volumes and their distributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.shared import written


def _envelope(g: np.ndarray, size: float) -> np.ndarray:
    """For lines (rows of g): at each place the least of g plus the squared step, by the lower envelope of a line's parabolas.

    All lines are scanned side by side. Each place joins the envelope once and leaves it once at most, so work is linear in a line.
    Places without a value are infinite.
    """
    many, n = g.shape
    line = np.arange(many)
    apex = np.zeros((many, n), np.int64)  # of the envelope's parabolas, and from where each is the lowest
    begin = np.full((many, n + 1), np.inf)
    top = np.full(many, -1)
    for q in range(n):
        own = line[np.isfinite(g[:, q])]
        meet = np.full(len(own), -np.inf)
        open_ = np.flatnonzero(top[own] >= 0)
        while len(open_):
            k = own[open_]
            v = apex[k, top[k]]
            meet[open_] = (g[k, q] - g[k, v]) / (2 * size * size * (q - v)) + (q + v) / 2
            beaten = meet[open_] <= begin[k, top[k]]
            top[k[beaten]] -= 1
            open_ = open_[beaten]
            meet[open_[top[own[open_]] < 0]] = -np.inf
            open_ = open_[top[own[open_]] >= 0]
        top[own] += 1
        apex[own, top[own]], begin[own, top[own]], begin[own, top[own] + 1] = q, meet, np.inf
    out, at = np.full((many, n), np.inf), np.zeros(many, np.int64)
    there = line[top >= 0]
    for q in range(n):
        ahead = there
        while len(ahead := ahead[begin[ahead, at[ahead] + 1] <= q]):
            at[ahead] += 1
        v = apex[there, at[there]]
        out[there, q] = g[there, v] + ((q - v) * size) ** 2
    return out


def _lowered(batches: Iterator[pa.RecordBatch], size: float) -> Iterator[pa.RecordBatch]:
    """Batches whose last column holds dense lines of g, null where there is none: the same with the envelope's values."""
    for batch in batches:
        lines = batch.column(len(batch.schema) - 1)
        ends = lines.offsets.to_numpy()
        flat = lines.values.cast(pa.float64()).fill_null(np.inf).to_numpy(zero_copy_only=False).copy()
        lengths = np.diff(ends)
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            for part in np.array_split(rows, max(1, len(rows) * n // 1_000_000)):
                at = ends[:-1][part][:, None] + np.arange(n)
                flat[at] = _envelope(flat[at], size)
        values = pa.array(flat, mask=np.isinf(flat))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends - ends[0] if len(ends) else ends, pa.int32()), values.slice(int(ends[0]), int(ends[-1] - ends[0])))], batch.schema.names)


def empty_space_distance(mask: DataFrame, vz: float, vy: float, vx: float, sizes: DataFrame | None = None) -> DataFrame:
    """(volume_id, z, y, x, distance): from every voxel of a dense mask to the nearest one with `positive`, in physical units.

    Exact and separable: along x the nearest positive voxel of the line is found by windows; along y and then z a line is one array, and the
    lower envelope of its parabolas gives the least value plus squared step at each place. Work is linear in the voxels, and
    each is shuffled three times. Without a positive voxel the distance is null. With sizes, the mask may lack voxels: distances pass
    through their places, which get no rows.
    """
    from voxelframe.operators.grid import completed

    mask = mask.withColumn("_here", F.lit(True)) if sizes is None else completed(mask, sizes, {"positive": F.lit(False)})
    line = Window.partitionBy("volume_id", "z", "y").orderBy("x")
    here = F.when(F.col("positive"), F.col("x"))
    left = F.last(here, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(here, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    g = mask.select("volume_id", "z", "y", "x", "_here", F.least(F.col("x") - left, right - F.col("x")).alias("dx"))
    found = g.select("volume_id", "z", "y", "x", "_here", F.pow(F.col("dx") * vx, F.lit(2)).alias("g"))
    for axis, size in (("y", vy), ("z", vz)):
        other = [c for c in ("volume_id", "z", "y", "x") if c != axis]
        lines = found.groupBy(*other).agg(F.array_sort(F.collect_list(F.struct(axis, "_here", "g"))).alias("line"))
        lines = lines.select(*other, F.get("line", F.lit(0))[axis].alias("first"), F.transform("line", lambda p: p["_here"]).alias("_here"), F.transform("line", lambda p: p["g"]).alias("g"))
        schema = ", ".join(f"{c} {t}" for c, t in lines.dtypes)
        lowered = lines.mapInArrow(lambda batches, size=size: _lowered(batches, size), schema)
        out = lowered.select(*other, "first", F.posexplode(F.arrays_zip("_here", "g")).alias("k", "p"))
        found = out.select(*other, (F.col("first") + F.col("k")).cast("int").alias(axis), "p._here", "p.g")
    return found.where("_here").select("volume_id", "z", "y", "x", F.sqrt("g").alias("distance"))


def class_distances(labels: DataFrame, distances: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(volume_id, by..., label, distance): the least distance over each cell's voxels."""
    rows = labels.where("label > 0").join(distances, ["volume_id", "z", "y", "x"])
    return rows.groupBy("volume_id", *(by or []), "label").agg(F.min("distance").alias("distance"))


def running(counts: DataFrame, name: str, value: str) -> DataFrame:
    """counts(name, value, n) with `upto`, the running sum of n over a series' sorted values, and `total`.

    Rows are dealt by ranges of (name, value) and written, so that parts are even whatever the values' distribution. Only sums of
    parts meet in a window over a series, and only a part's rows in one over values. A null name is no series.
    """
    dealt = counts.where(F.col(name).isNotNull()).repartitionByRange(name, value).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "running")
    sums = dealt.groupBy(name, "_part").agg(F.sum("n").alias("_n"))
    of = Window.partitionBy(name)
    before = of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(name, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(of).alias("total"))
    inner = F.sum("n").over(Window.partitionBy(name, "_part").orderBy(value))
    return dealt.withColumn("_inner", inner).join(bases, [name, "_part"]).select(*counts.columns, (F.col("_base") + F.col("_inner")).alias("upto"), "total")


def empirical_cdf(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(name, value, cdf): share of a series' values up to each distinct one, counted per value first."""
    counts = rows.groupBy(name, value).agg(F.count("*").alias("n"))
    return running(counts, name, value).select(name, value, (F.col("upto") / F.col("total")).alias("cdf"))


def cdf_on_grid(rows: DataFrame, name: str, value: str, points: int = 500) -> DataFrame:
    """(name, k, at, cdf) on even points from 0 to the largest value of all series; each row is put in its bin before any window."""
    top = rows.agg(F.max(value).alias("top"))
    step = F.col("top") / (points - 1)
    bins = rows.join(top).select(name, F.when(F.col("top") == 0, 0).otherwise(F.least(F.lit(points - 1), F.ceil(F.round(F.col(value) / step, 9)))).cast("int").alias("k"))
    counts = bins.groupBy(name, "k").agg(F.count("*").alias("n"))
    grid = rows.select(name).distinct().join(top).select(name, "top", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    filled = grid.join(counts, [name, "k"], "left").na.fill(0, ["n"])
    upto = Window.partitionBy(name).orderBy("k")
    return filled.select(name, "k", (F.col("k") * step).alias("at"), (F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy(name))).alias("cdf"))


def every_nth(rows: DataFrame, name: str, value: str, most: int) -> DataFrame:
    """At most about `most` of a series' sorted values over 0: every 10^k-th, with the smallest k that suffices.

    Ranks come from counts of each distinct value, so a window sees distinct values only. No smoothing filter is applied; see down_sampled().
    """
    counts = rows.where(F.col(value) > 0).groupBy(name, value).agg(F.count("*").alias("n"))
    step = F.pow(F.lit(10), F.ceil(F.greatest(F.lit(0.0), F.log10(F.col("total") / most)))).cast("long")
    ranked = running(counts, name, value).withColumns({"before": F.col("upto") - F.col("n"), "step": step})
    first = F.expr("((before + step - 1) div step) * step")
    return ranked.withColumn("first", first).where("first < before + n").select(name, value, F.explode(F.expr("sequence(first, before + n - 1, step)")).alias("rank"))


def taps(q: int) -> list[float]:
    """Low-pass weights of 20 * q + 1 neighbouring ranks: a sinc of cut-off 1 / q under a Hamming window, with sum 1."""
    n = 20 * q
    line = [np.sinc((k - n / 2) / q) * (0.54 - 0.46 * np.cos(2 * np.pi * k / n)) for k in range(n + 1)]
    return [float(v / sum(line)) for v in line]


def decimated(rows: DataFrame, name: str, value: str, q: int = 10) -> DataFrame:
    """(name, value, rank): every q-th of a series' sorted values after smoothing over 10 * q ranks to both sides; zeros stand beyond the ends.

    Each value is sent to the outputs whose weights reach its ranks, about 20 of them whatever q is, and the weighted values are summed before the shuffle;
    rows with equal values go as one with a sum of weights. Neighbouring ranks across partitions need no window so.
    """
    weights = taps(q)
    half = len(weights) // 2
    sums = F.array(*[F.lit(v) for v in np.concatenate([[0.0], np.cumsum(weights)]).tolist()])
    counts = rows.where(F.col(value).isNotNull()).groupBy(name, value).agg(F.count("*").alias("n"))
    ranked = running(counts, name, value).withColumns({"_a": F.col("upto") - F.col("n"), "_b": F.col("upto") - 1})
    low, high = F.greatest(F.lit(0), F.ceil((F.col("_a") - half) / q)), F.least(F.ceil(F.col("total") / q) - 1, F.floor((F.col("_b") + half) / q))
    sent = ranked.where(low <= high).select(name, value, "_a", "_b", F.explode(F.sequence(low, high)).alias("rank"))
    # the weight of rank r in output k is that of tap half + q * k - r
    first, last = F.greatest(F.lit(0), half + q * F.col("rank") - F.col("_b")), F.least(F.lit(2 * half), half + q * F.col("rank") - F.col("_a"))
    weight = F.get(sums, (last + 1).cast("int")) - F.get(sums, first.cast("int"))
    return sent.groupBy(name, "rank").agg(F.sum(weight * F.col(value)).alias(value)).select(name, value, "rank")


def down_sampled(rows: DataFrame, name: str, value: str, most: int, q: int = 10) -> DataFrame:
    """(name, value): each series with at most `most` values, decimated by q again and again until it has; shorter ones stay as they are."""
    left, out = rows.where(F.col(name).isNotNull() & F.col(value).isNotNull()).select(name, F.col(value).cast("double").alias(value)), None
    while True:
        many = left.groupBy(name).agg(F.count("*").alias("_n"))
        long = many.where(F.col("_n") > most).select(name)
        done = left.join(long, name, "left_anti")
        out = done if out is None else out.unionByName(done)
        if long.isEmpty():
            return out
        left = written(decimated(left.join(long, name, "left_semi"), name, value, q).select(name, value), "decimated")
