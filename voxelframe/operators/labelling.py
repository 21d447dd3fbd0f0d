"""Connected components and labels of volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.shared import checkpointed

AT = ["volume_id", "z", "y", "x"]
FACES = [(0, 0, 1), (0, 1, 0), (1, 0, 0)]
ALL = [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]


def linked(links: DataFrame) -> DataFrame:
    """(node, component) of links(a, b): the smallest node reachable; nodes without links are absent.

    Large-star and small-star steps in turn, each a grouped minimum and a join; every round is checkpointed.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last: tuple = ()
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if not state[0] or state == last:
            break
        last = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = checkpointed(large.join(low, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Parts that are counted before anything is numbered over them.
PARTS = 4096


def upto(counts: DataFrame, part: str, n: str, by: list[str] | None = None) -> DataFrame:
    """counts(by..., part, n) with `before`, the sum of n over smaller parts; a row for each part."""
    order = Window.partitionBy(*(by or [])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(n).over(order), F.lit(0)))


def bases(sizes: DataFrame) -> DataFrame:
    """(volume_id, sy, sx, base): base + raster position is a number of its own for every voxel of all volumes.

    A base is the voxels of all volumes before, so numbers stay below the voxels' number. Volumes are summed in hashed parts first.
    """
    s = sizes.select("volume_id", *[F.col(f"size_{c}").cast("long").alias(f"s{c}") for c in "zyx"])
    s = s.select("volume_id", "sy", "sx", (F.col("sz") * F.col("sy") * F.col("sx")).alias("n"), F.pmod(F.xxhash64("volume_id"), F.lit(PARTS)).alias("part"))
    parts = upto(s.groupBy("part").agg(F.sum("n").alias("m")), "part", "m").select("part", "before")
    inner = Window.partitionBy("part").orderBy("volume_id").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(parts, "part").select("volume_id", "sy", "sx", (F.col("before") + F.col("inner")).alias("base"))


def place(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with `at`, the raster position in their volume, and `id`, a number of their own over all volumes."""
    at = (F.col("z") * F.col("sy") + F.col("y")) * F.col("sx") + F.col("x")
    return rows.join(bases(sizes), "volume_id").withColumn("at", at).withColumn("id", F.col("base") + F.col("at")).drop("sy", "sx", "base")


def numbered(rows: DataFrame, part: Column, order: str, name: str, first: int = 1) -> DataFrame:
    """rows(volume_id, ...) with `name`, their number in the volume by `order`, where `part` grows with it.

    Parts are counted first; no window holds more rows than a part, so a volume of many rows is many tasks.
    """
    keyed = rows.withColumn("_part", part)
    base = upto(keyed.groupBy("volume_id", "_part").agg(F.count("*").alias("_n")), "_part", "_n", ["volume_id"]).select("volume_id", "_part", "before")
    inner = F.row_number().over(Window.partitionBy("volume_id", "_part").orderBy(order)) - 1
    return keyed.withColumn("_inner", inner).join(base, ["volume_id", "_part"]).select(*rows.columns, (F.col("before") + F.col("_inner") + first).cast("int").alias(name))


def connected_components(rows: DataFrame, sizes: DataFrame, steps: list[tuple[int, int, int]] | None = None, least_size: int = 1, same: str | None = None) -> DataFrame:
    """(volume_id, z, y, x, label): touching voxels get one label, numbered by their first voxel in raster order from 1.

    steps: 3 face neighbours by default, or ALL for 26. same: a column whose values must be equal. Components smaller than
    least_size go. Runs along x are found by a window first, so only runs, not voxels, are linked.
    """
    keep = [same] if same else []
    line = Window.partitionBy("volume_id", "z", "y", *keep).orderBy("x")
    runs = rows.select(*AT, *keep).withColumn("run", F.col("x") - F.row_number().over(line))
    spans = runs.groupBy("volume_id", "z", "y", "run", *keep).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    spans = place(sizes, spans.withColumn("x", F.col("lo"))).drop("x", "at")
    steps = steps or FACES
    lines = sorted({(a, b, max(abs(c) for p, q, c in steps if (p, q) == (a, b))) for a, b, _ in steps if (a, b) != (0, 0)})
    near = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("reach")) for a, b, c in lines])
    left = spans.select("volume_id", *keep, F.explode(near).alias("s"), "z", "y", F.col("lo").alias("l0"), F.col("hi").alias("l1"), F.col("id").alias("a"))
    left = left.select("volume_id", *keep, (F.col("z") + F.col("s.dz")).alias("z"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("l0") - F.col("s.reach")).alias("l0"), (F.col("l1") + F.col("s.reach")).alias("l1"), "a")
    links = left.join(spans, ["volume_id", "z", "y", *keep]).where("lo <= l1 AND hi >= l0").select("a", F.col("id").alias("b"))
    found = linked(links)
    owner = spans.join(found, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id")).withColumn("n", F.col("hi") - F.col("lo") + 1)
    big = owner.groupBy("volume_id", "component").agg(F.sum("n").alias("size"), F.min("z").alias("top")).where(F.col("size") >= least_size)
    dense = numbered(big, F.col("top"), "component", "label")  # a component's first voxel lies in its first slice
    return owner.join(dense.select("volume_id", "component", "label"), ["volume_id", "component"]).select("volume_id", "z", "y", F.explode(F.sequence("lo", "hi")).alias("x"), "label")


def reconcile_slabs(rows: DataFrame) -> DataFrame:
    """One labelling from rows(volume_id, z, y, x, slab, label) of slabs that share slices, each labelled on its own.

    On the shared slice each label of the later slab joins the label of the earlier one that it shares most voxels with (ties: the earliest shared
    voxel). Then each label of the earlier slab joins the label that most of its shared voxels have by now, so labels that are one object
    in the later slab become one. Matches hold across slabs, all at once. A later slab wins on a shared slice. The result is (volume_id, z, y, x, label) with labels by (slab, label) from 1. Labels get
    numbers of their own by counted parts; voxels meet labels by value.
    """
    known = rows.where("label > 0").select(*AT, "slab", "label")
    own = ["volume_id", "slab", "label"]
    upper = known.select(*AT, (F.col("slab") - 1).alias("slab"), F.col("label").alias("other"))
    pairs = known.join(upper, [*AT, "slab"]).groupBy(*own, "other").agg(F.count("*").alias("n"), F.min(F.struct("z", "y", "x")).alias("first"))
    order, later = [F.desc("n"), "first"], ["volume_id", "slab", "other"]
    up = pairs.withColumn("k", F.row_number().over(Window.partitionBy(*later).orderBy(*order))).where("k = 1").select(*own, "other")
    joined = pairs.join(up.select(*later, F.col("label").alias("to")), later).groupBy(*own, "to").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    side = joined.withColumn("k", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).where("k = 1 AND to <> label").select(*own, "to")
    labels = known.groupBy(*own).agg(F.count("*").alias("n"))
    parts = labels.withColumn("part", F.pmod(F.xxhash64(*own), F.lit(PARTS)))
    before = upto(parts.groupBy("part").agg(F.count("*").alias("m")), "part", "m").select("part", "before")
    inner = F.row_number().over(Window.partitionBy("part").orderBy(*own))
    numbers = checkpointed(parts.withColumn("inner", inner).join(before, "part").select(*own, (F.col("before") + F.col("inner")).alias("id")))
    here = numbers.withColumnRenamed("id", "a")
    there = numbers.select("volume_id", (F.col("slab") - 1).alias("slab"), F.col("label").alias("other"), F.col("id").alias("b"))
    beside = numbers.select("volume_id", "slab", F.col("label").alias("to"), F.col("id").alias("b"))
    links = up.join(here, own).join(there, later).select("a", "b").unionByName(side.join(here, own).join(beside, ["volume_id", "slab", "to"]).select("a", "b"))
    merged = linked(links)
    owner = numbers.join(merged, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    names = owner.groupBy("volume_id", "component").agg(F.min(F.struct("slab", "label")).alias("first"))
    names = numbered(names, F.col("first.slab"), "first", "new")
    mapped = owner.join(names.select("volume_id", "component", "new"), ["volume_id", "component"]).select(*own, "new")
    return known.join(mapped, own).groupBy(*AT).agg(F.max_by("new", "slab").alias("label"))


def spaced(peaks: DataFrame, apart: tuple[int, int, int]) -> DataFrame:
    """peaks(volume_id, part, id, z, y, x, rank) with `seed`: the id of the seed that a peak belongs to, its own for a seed.

    Seeds are taken greedily by falling rank: a peak with a higher seed of its part within `apart` along z, y and x is none and belongs
    to the nearest such seed (ties: the higher). Each round decides all peaks without a higher undecided one near them, so a
    round is two joins on pairs of near peaks; these meet in cells as wide as `apart`.
    """
    reach = dict(zip("zyx", apart, strict=True))
    cell = lambda c, d=0: (F.floor(F.col(c) / max(1, reach[c])) + d).cast("int")
    far = peaks.select("volume_id", "part", F.col("id").alias("q"), F.col("rank").alias("q_rank"), *[F.col(c).alias(f"q{c}") for c in "zyx"], *[cell(c).alias(f"c{c}") for c in "zyx"])
    near = peaks.select("volume_id", "part", F.col("id").alias("p"), "rank", "z", "y", "x")
    for c in "zyx":
        near = near.withColumn(f"c{c}", F.explode(F.array(*[cell(c, d) for d in (-1, 0, 1)])))
    close = (F.col("q_rank") > F.col("rank")) & (F.abs(F.col("z") - F.col("qz")) <= apart[0]) & (F.abs(F.col("y") - F.col("qy")) <= apart[1]) & (F.abs(F.col("x") - F.col("qx")) <= apart[2])
    square = sum((F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in "zyx")
    pairs = checkpointed(near.join(far, ["volume_id", "part", "cz", "cy", "cx"]).where(close).select("p", "q", F.struct(square.alias("d"), (-F.col("q_rank.d")).alias("r"), (-F.col("q_rank.n")).alias("n")).alias("order")))
    state = checkpointed(peaks.select("id", F.lit(None).cast("boolean").alias("is_seed")))
    while not state.where("is_seed IS NULL").isEmpty():
        higher = state.select(F.col("id").alias("q"), F.col("is_seed").alias("q_seed"))
        told = pairs.join(higher, "q").groupBy("p").agg(F.max(F.coalesce("q_seed", F.lit(False))).alias("beaten"), F.max(F.col("q_seed").isNull()).alias("open"))
        met = state.join(told, F.col("id") == F.col("p"), "left")
        decided = F.when(F.col("is_seed").isNotNull(), F.col("is_seed")).when(F.col("beaten"), False).when(F.coalesce("open", F.lit(False)), F.lit(None)).otherwise(True)
        state = checkpointed(met.select("id", decided.alias("is_seed")))
    seeds = state.where("is_seed").select(F.col("id").alias("q"))
    owner = pairs.join(seeds, "q").groupBy("p").agg(F.min_by("q", "order").alias("owner"))
    of = state.join(owner, F.col("id") == F.col("p"), "left").select("id", F.when(F.col("is_seed"), F.col("id")).otherwise(F.col("owner")).alias("seed"))
    return peaks.join(of, "id")


def split_by_peaks(rows: DataFrame, distance: DataFrame, sizes: DataFrame, apart: tuple[int, int, int] = (1, 5, 5)) -> DataFrame:
    """Labels of foreground rows, split where they have several peaks of `distance` that lie more than `apart` from each other.

    A voxel climbs to the largest of the voxels around it in its component (ties: the first in raster order) until it comes to a
    peak; steps are links, so a voxel meets its 26 neighbours only. Peaks too near to a higher one go to it with all their
    voxels; see spaced(). Labels are numbered by their seeds' raster order from 1. Smooth the distance before, and dilate the labels
    after, as grid.gaussian_filter() and grid.dilate() do.
    """
    parts = connected_components(rows, sizes).withColumnRenamed("label", "part")
    d = checkpointed(place(sizes, parts.join(distance.select(*AT, "distance"), AT)).withColumn("rank", F.struct(F.round("distance", 6).alias("d"), (-F.col("id")).alias("n"))))
    around = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    seen = d.select("volume_id", "part", F.explode(around).alias("s"), "z", "y", "x", "rank").select("volume_id", "part", *[(F.col(c) + F.col(f"s.d{c}")).alias(c) for c in "zyx"], "rank")
    top = seen.groupBy("volume_id", "part", "z", "y", "x").agg(F.max("rank").alias("top"))
    steps = d.join(top, ["volume_id", "part", "z", "y", "x"]).withColumn("up", -F.col("top.n"))
    basins = linked(steps.select(F.col("id").alias("a"), F.col("up").alias("b")))
    owned = steps.join(basins, F.col("id") == F.col("node"), "left").withColumn("basin", F.coalesce("component", "id"))
    owned = checkpointed(owned.select(*AT, "part", "id", "up", "rank", "basin"))
    peaks = owned.where("id = up")
    kept = spaced(peaks.select("volume_id", "part", "id", "z", "y", "x", "rank"), apart).select("id", "seed")
    seeds = peaks.join(kept.where("id = seed").select("id"), "id").select("volume_id", F.col("id").alias("seed"), "z")
    labels = numbered(seeds, F.col("z"), "seed", "label").select("seed", "label")
    mapped = peaks.select("id", "basin").join(kept, "id").join(labels, "seed").select("basin", "label")
    return owned.join(mapped, "basin").select(*AT, "label")


def to_8bit(label: Column) -> Column:
    return (label % 256).cast("int")


def to_binary(label: Column) -> Column:
    return (label > 0).cast("int")


def separated(labels: DataFrame, sizes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """labels without the voxels on borders to another label or to the background; known: as for grid.label_edges()."""
    from voxelframe.operators.grid import label_edges

    return labels.where("label > 0").join(label_edges(labels, sizes, known=known), AT, "left_anti")


def remap(rows: DataFrame, mapping: DataFrame, value: str = "label", zero_unmapped: bool = False) -> DataFrame:
    """Values replaced by mapping(old, new); others stay, or become 0."""
    other = F.lit(0) if zero_unmapped else F.col(value)
    return rows.join(mapping, rows[value] == mapping["old"], "left").withColumn(value, F.coalesce("new", other).cast("int")).drop("old", "new")


def remap_run(rows: DataFrame, mapping: DataFrame, start: int) -> DataFrame:
    """Values replaced going up from slice `start`, for each value as far as it is in every slice."""
    there = rows.where(F.col("z") >= start).select("volume_id", "z", "label").distinct()
    order = Window.partitionBy("volume_id", "label").orderBy("z")
    run = there.withColumn("k", F.row_number().over(order)).where(F.col("z") - start + 1 == F.col("k")).join(mapping, F.col("label") == F.col("old")).select("volume_id", "z", "label", "new")
    return rows.join(run, ["volume_id", "z", "label"], "left").select(*AT, F.coalesce("new", "label").cast("int").alias("label"))


def painted(labels: DataFrame, values: DataFrame, rescale: bool = True) -> DataFrame:
    """(volume_id, z, y, x, value): each cell's value from values(volume_id, label, value) mapped to 2..255 and cut to a whole number.

    With rescale the values' range is stretched, unless all are equal or zero; else 0..1 is. Cells without a value are 0.
    """
    span = values.groupBy("volume_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    v = values.join(span, "volume_id")
    if rescale:
        unit = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("value"))
    else:
        unit = F.col("value")
    level = v.select("volume_id", "label", F.floor(2 + unit * 253).cast("int").alias("level"))
    return labels.join(level, ["volume_id", "label"], "left").select(*AT, F.coalesce("level", F.lit(0)).alias("value"))


def contour_palette(labels: DataFrame, target: int) -> DataFrame:
    """The target is 255, other ids are spread over 64..164 in their order; a missing target is an error."""
    ids = labels.where("label > 0").select("label").distinct()
    checked = ids.agg(F.count_if(F.col("label") == target).alias("there")).select(F.when(F.col("there") == 0, F.raise_error(F.lit(f"no label {target}")).cast("int")).otherwise(0).alias("ok"))
    others = ids.where(F.col("label") != target)
    part = F.floor(F.col("label") / 65536).alias("part")
    counts = others.groupBy(part).agg(F.count("*").alias("m"))  # a row for each 65,536 labels
    bases = counts.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("m").over(Window.partitionBy()).alias("n"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy("label")) - 1
    tone = others.select("label", part).withColumn("inner", inner).join(bases, "part").withColumn("k", F.col("base") + F.col("inner")).select("label", (64 + F.floor(F.col("k") * 100 / F.greatest(F.lit(1), F.col("n") - 1))).cast("int").alias("tone"))
    rows = labels.join(tone, "label", "left").join(checked)
    value: Column = F.when(F.col("label") == target, 255).otherwise(F.coalesce("tone", F.lit(0))) + F.col("ok")
    return rows.select(*AT, value.cast("int").alias("value"))
