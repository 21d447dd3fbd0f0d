"""Catalogs of volumes, planes, datasets and experiment logs; reading and writing them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def volume(spark: SparkSession, path: str, series: int = 0) -> DataFrame:
    """Voxels of one series of a Parquet volume table; other formats are an error."""
    if not path.rstrip("/").endswith(".parquet"):
        raise ValueError(f"no reader for {path}")
    rows = spark.read.parquet(path)
    return rows.where(F.col("series") == series) if "series" in rows.columns else rows


def series(rows: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    found = rows.select("series").distinct()
    return found if wanted is None else found.where(F.col("series").isin(wanted))


def sliced(rows: DataFrame, axis: str, places: list[int]) -> DataFrame:
    """Slices at `places` of the slices that rows still have, counted from 0; repeated slicing therefore composes.

    A place that isn't there is an error when the rows are read.
    """
    numbers = rows.select(axis).distinct().withColumn("k", F.row_number().over(Window.orderBy(axis)) - 1)  # a row for each slice
    count = numbers.agg(F.count("*").alias("n"))
    bad = F.raise_error(F.lit(f"no such {axis}")).cast("int")
    top = max(places, default=-1)
    chosen = numbers.join(count).where(F.when(F.col("n") <= top, bad).otherwise(1) == 1).where(F.col("k").isin(places))
    return rows.join(F.broadcast(chosen.select(axis)), axis, "left_semi")


def one_channel(rows: DataFrame, channels: list[int], value: str = "i") -> DataFrame:
    """Largest value over the channels at each voxel; a volume of one slice is an error."""
    checked = rows.groupBy("volume_id").agg(F.count_distinct("z").alias("n")).select("volume_id", F.when(F.col("n") < 2, F.raise_error(F.lit("single slice")).cast("int")).otherwise(0).alias("ok"))
    return rows.where(F.col("c").isin(channels)).groupBy("volume_id", "z", "y", "x").agg(F.max(value).alias(value)).join(checked.where("ok = 0").select("volume_id"), "volume_id", "left_semi")


def three_channels(rows: DataFrame, value: str = "i") -> DataFrame:
    """Channels 0, 1 and 2 of each voxel, 0 where missing; a fourth is an error."""
    at = ["volume_id", "z", "y", "x"]
    checked = rows.withColumn("c", F.when(F.col("c") > 2, F.raise_error(F.lit("more than three channels")).cast("int")).otherwise(F.col("c")))
    grid = rows.select(*at).distinct().withColumn("c", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    return grid.join(checked.select(*at, "c", value), [*at, "c"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def to_unit(rows: DataFrame, value: str, top: float) -> DataFrame:
    """Values divided by `top`, their type's largest, in volumes with a value over 1."""
    span = rows.groupBy("volume_id").agg(F.max(value).alias("largest"))
    return rows.join(span, "volume_id").withColumn(value, F.when(F.col("largest") > 1, F.col(value) / top).otherwise(F.col(value))).drop("largest")


def matching(planes: DataFrame, params: dict) -> DataFrame:
    """Planes where every named parameter has its value; an unknown parameter matches nothing."""
    tests = [F.col(k) == v if k in planes.columns else F.lit(False) for k, v in params.items()]
    return planes.where(functools.reduce(lambda a, b: a & b, tests, F.lit(True)))


def tile_path(path: Column, part: str) -> Column:
    """A number of a tile path like data/z3/c1/x0_y0.png; 0 where the level is left out."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(path, rf"(?:^|[/_]){part}(\d+)", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(0))


def paired(inputs: DataFrame, annotations: DataFrame, name: str = "name", by: str = "dataset", contained: bool = False) -> DataFrame:
    """(dataset, input, annotation): by sorted position; leftovers have a null annotation, and too many annotations are an error.

    contained: also an annotation whose name doesn't contain its input's name, without its ending, is an error.
    """
    number = lambda df, n: df.select(by, F.col(name).alias(n), F.row_number().over(Window.partitionBy(by).orderBy(name)).alias("k"))
    both = number(inputs, "input").join(number(annotations, "annotation"), [by, "k"], "full")
    found = both.select(by, F.when(F.col("input").isNull(), F.raise_error(F.lit("more annotations than inputs")).cast("string")).otherwise(F.col("input")).alias("input"), "annotation")
    if not contained:
        return found
    stem = F.regexp_replace("input", r"\.[^.]*$", "")
    other = F.raise_error(F.concat(F.lit("no annotation of "), F.col("input"), F.lit(": "), F.col("annotation"))).cast("string")
    return found.withColumn("annotation", F.when(F.col("annotation").isNull() | F.contains(F.col("annotation"), stem), F.col("annotation")).otherwise(other))


def merged_features(sets: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Feature sets of the same rows, each with its name before its columns. Sets whose keys differ are an error."""
    out = None
    for name, rows in sets.items():
        named = rows.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c not in keys], F.lit(True).alias(f"_in_{name}"))
        out = named if out is None else out.join(named, keys, "full")
    whole = functools.reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_in_{n}"), F.lit(False)) for n in sets])
    checked = F.when(whole, F.col(keys[0])).otherwise(F.raise_error(F.concat_ws(" ", F.lit("not in every feature set:"), *keys)).cast(out.schema[keys[0]].dataType))
    return out.withColumn(keys[0], checked).drop(*[f"_in_{n}" for n in sets])


def class_files(files: DataFrame, class_name: str) -> DataFrame:
    """Files named _<class>_, or where a folder has none, those with _<class> at a word's start."""
    exact = files.where(F.col("name").contains(f"_{class_name}_"))
    loose = files.where(F.col("name").contains(f"_{class_name}")).join(exact.select("folder").distinct(), "folder", "left_anti")
    return exact.unionByName(loose)


def datasets(spec: Column) -> Column:
    """Names of "a+b+c", one row each."""
    return F.explode(F.split(spec, r"\+"))


def pairs_of_view(paths: DataFrame, explicit: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """(fov, a, b): all pairs of a view's paths in order, or the explicit pairs where a view has any.

    A view's paths are dealt to blocks of about `block` paths, and each path meets each block, so a large view is many small joins.
    """
    own = paths if explicit is None else paths.join(explicit.select("fov").distinct(), "fov", "left_anti")
    many = own.groupBy("fov").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    counted = own.join(many, "fov")
    left = counted.select("fov", F.col("path").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = counted.select("fov", F.col("path").alias("b"), F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int").alias("block"))
    made = left.join(right, ["fov", "block"]).where("a < b").select("fov", "a", "b")
    return made if explicit is None else made.unionByName(explicit)


def count_pairs(paths: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(fov, pairs): how many pairs pairs_of_view() has of each view with any, from counts, without making them."""
    own = paths if explicit is None else paths.join(explicit.select("fov").distinct(), "fov", "left_anti")
    copies = own.where("fov IS NOT NULL AND path IS NOT NULL").groupBy("fov", "path").agg(F.count("*").alias("m"))
    made = copies.groupBy("fov").agg(F.expr("(sum(m) * sum(m) - sum(m * m)) div 2").alias("pairs")).where("pairs > 0")
    return made if explicit is None else made.unionByName(explicit.groupBy("fov").agg(F.count("*").alias("pairs")))


def common_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames with the columns that all have, sorted."""
    names = sorted(set.intersection(*[set(f.columns) for f in frames]))
    return functools.reduce(DataFrame.unionByName, [f.select(names) for f in frames])


def best_of_runs(logs: DataFrame, run: str, metric: str, largest: bool, *tie: str) -> DataFrame:
    order = Window.partitionBy(run).orderBy((F.desc if largest else F.asc)(metric), *tie)
    return logs.where(F.col(metric).isNotNull()).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def report(rows: DataFrame, columns: list[str], digits: int, by: str) -> DataFrame:
    """The named columns, rounded, by falling `by`; a missing column is an error."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    kinds = dict(rows.dtypes)
    return rows.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]).orderBy(F.desc(by))


def to_tsv(rows: DataFrame, path: str, index: list[str]) -> None:
    """Tab-separated files: the index columns, then the others in sorted order."""
    rows.select(*index, *sorted(set(rows.columns) - set(index))).write.option("header", True).csv(path, sep="\t")


def export_positions(cells: DataFrame) -> DataFrame:
    """Frame_number, Cell_number, Position_X, Position_Y of the cells whose class is 1."""
    return cells.where("class = 1").select(F.col("frame").alias("Frame_number"), F.col("cell").alias("Cell_number"), F.col("x").alias("Position_X"), F.col("y").alias("Position_Y"))


def sequence_numbers(pages: DataFrame, by: list[str]) -> DataFrame:
    """pages with `n` from 0 in the order of `by`: counts per first key give each its start, so no window spans all rows."""
    first = by[0]
    starts = pages.groupBy(first).agg(F.count("*").alias("c")).withColumn("start", F.coalesce(F.sum("c").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(first).orderBy(*by[1:]))
    return pages.withColumn("own", own).join(starts.select(first, "start"), first).withColumn("n", F.col("start") + F.col("own") - 1).drop("own", "start")


def depth_samples(rows: DataFrame, sizes: DataFrame, shares: list[float], length: int) -> DataFrame:
    """rows of `length` slices from each share of the depth on, with `sample`."""
    at = sizes.select("volume_id", F.explode(F.array(*[F.struct(F.lit(k).alias("sample"), F.lit(s).alias("share")) for k, s in enumerate(shares)])).alias("p"), "size_z")
    at = at.select("volume_id", "p.sample", F.floor(F.col("size_z") * F.col("p.share")).cast("int").alias("lo"))
    return rows.join(F.broadcast(at), "volume_id").where(F.col("z").between(F.col("lo"), F.col("lo") + length - 1)).drop("lo")


def batches(rows: DataFrame, by: list[str], order: list[str], size: int, whole_only: bool = False) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*by))
    out = rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("int"))
    return out.withColumn("n", n).where((F.col("batch") + 1) * size <= F.col("n")).drop("n") if whole_only else out


def split_name(name: Column, fields: int, by: str = "_") -> Column:
    """Parts of a name; another number of parts is an error."""
    parts = F.split(name, by)
    return F.when(F.size(parts) == fields, parts).otherwise(F.raise_error(F.concat(F.lit("cannot split "), name)).cast("array<string>"))


def rgb(code: Column) -> Column:
    """(r, g, b) of the lowest 24 bits of a whole number of any size; channels.rgba() takes those with alpha."""
    return F.struct(*[F.shiftright(code, bits).bitwiseAND(255).cast("int").alias(name) for name, bits in (("r", 16), ("g", 8), ("b", 0))])


def parameter(name: Column, key: str) -> Column:
    """The number that follows a key in a name like thresh_0.4_med_3_fill_True; True and False are 1 and 0."""
    text = F.regexp_extract(name, rf"(?:^|_){key}_([^_]+)", 1)
    return F.when(text == "True", 1.0).when(text == "False", 0.0).otherwise(F.nullif(text, F.lit("")).try_cast("double"))


def patient(name: Column) -> Column:
    """The number after the S in a name, such as 3 in "TestNewClasses S3"; a name without one is an error."""
    found = F.regexp_extract(name, r"S(\d+)", 1)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no patient in "), name)).cast("string")).otherwise(found)


def without_named(rows: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """rows whose name contains none of the labels."""
    for label in labels:
        rows = rows.where(~F.contains(F.col(name), F.lit(label)))
    return rows


# What goes from a frame's file name, in turn, as patterns.
FRAME_PARTS = [".tif", " 0.5um_dapi_stack", "1024 ", "2048"]


def frame_name(name: Column) -> Column:
    """A frame's file name without its ending, stack name and sizes. The parts are patterns, so a point is any character."""
    for part in FRAME_PARTS:
        name = F.regexp_replace(name, part, "")
    return name


def annotation_summary(rows: DataFrame, by: str) -> DataFrame:
    """(by, slices, listed, step): how many slices a set has, which ones in order, and the least step between two."""
    own = rows.select(by, "z").distinct()
    step = own.withColumn("step", F.col("z") - F.lag("z").over(Window.partitionBy(by).orderBy("z")))
    return step.groupBy(by).agg(F.count("*").alias("slices"), F.array_join(F.array_sort(F.collect_list("z")), ",").alias("listed"), F.min("step").alias("step"))


def of_one_size(rows: DataFrame, by: str, *sizes: str) -> DataFrame:
    """(by, consistent): whether a set has exactly one voxel size."""
    return rows.groupBy(by).agg((F.count_distinct(*sizes) == 1).alias("consistent"))


def feature_columns(columns: list[str], suffixes: list[str], channels: list[str] | None = None) -> list[str]:
    """Sorted columns with one of the suffixes, of the channels' prefixes if given; none is an error."""
    found = sorted(c for c in columns if any(c.endswith(s) for s in suffixes) and (channels is None or any(c.startswith(f"{p}_") for p in channels)))
    if not found:
        raise ValueError("no such features")
    return found


def ome_volumes(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """Name, sizes and voxel sizes from columns of OME-XML documents; what a document lacks is null."""
    one = lambda a: F.nullif(F.xpath_string(xml, F.lit(f"//*[local-name()='Pixels']/@{a}")), F.lit(""))
    sizes = [one(f"Size{c}").try_cast("int").alias(f"size_{c.lower()}") for c in "ZYXC"]
    steps = [one(f"PhysicalSize{c}").try_cast("double").alias(f"v{c.lower()}") for c in "ZYX"]
    return rows.select(*[c for c in rows.columns if c != xml], *sizes, *steps, F.xpath(xml, F.lit("//*[local-name()='Channel']/@Name")).alias("channels"))
