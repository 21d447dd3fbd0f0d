"""Channels of volumes: markers, averaging steps, colours, and summaries of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marker of a channel by its index % 4, the averaging steps of a denoising channel by its index div 4.
MARKERS = ["dapi", "pan-cytokeratin", "ki67", "cd3"]
AVERAGING_STEPS = [8, 4, 2, 1]


def _known(values: list, at: Column, what: str) -> Column:
    kind = "string" if isinstance(values[0], str) else "int"
    found = F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit(f"no {what} of channel group "), at.cast("string"))).cast(kind)).otherwise(found)


def denoising_meta(channel: Column) -> Column:
    """(marker, averaging_steps) of a channel index; an index beyond the known steps is an error."""
    return F.struct(_known(MARKERS, channel % len(MARKERS), "marker").alias("marker"), _known(AVERAGING_STEPS, F.floor(channel / len(MARKERS)), "averaging steps").alias("averaging_steps"))


def rgba(code: Column) -> Column:
    """(r, g, b) of a 32-bit number with red in its highest and alpha in its lowest byte."""
    wide = code.cast("long")
    return F.struct(*[F.shiftright(wide, n).bitwiseAND(F.lit(255)).cast("int").alias(c) for c, n in (("r", 24), ("g", 16), ("b", 8))])


def marker_of(index: Column, colour: Column, by_index: dict[int, str], by_colour: dict[tuple[int, int, int], str]) -> Column:
    """(marker, colour_marker, mismatch): the index decides; a colour that names another marker, or none, is flagged."""
    named = F.create_map(*[F.lit(x) for pair in by_index.items() for x in pair])[index.cast("int")]
    key = F.concat_ws(",", colour["r"], colour["g"], colour["b"])
    coloured = F.create_map(*[F.lit(x) for rgb, name in by_colour.items() for x in (",".join(map(str, rgb)), name)])[key]
    return F.struct(named.alias("marker"), coloured.alias("colour_marker"), (~named.eqNullSafe(coloured)).alias("mismatch"))


def series_summary(volumes: DataFrame, channels: DataFrame) -> DataFrame:
    """A row for each channel of each series: its name, the stack's resolution, voxel and sample sizes as text, colour and example slice.

    volumes(filename, series, name, size_z, size_y, size_x, vz, vy, vx); channels(filename, series, channel, colour). The example
    is the slice at a third of the depth. A series without channels has one row, with nulls for them.
    """
    n = {c: F.col(f"size_{c}") for c in "xyz"}
    size = {c: n[c] * F.col(f"v{c}") for c in "xyz"}
    text = F.format_string("%.2fx\n%.2fx\n%.2fum\n\n%.0fx\n%.0fx\n%.0fum", *[F.col(f"v{c}").cast("double") for c in "xyz"], *[F.bround(size[c].cast("double"), 0) for c in "xyz"])
    rows = volumes.select(
        "filename", "series", F.concat("name", F.lit(": S"), F.col("series").cast("string")).alias("series_name"), F.concat_ws("x", *[n[c].cast("string") for c in "xyz"]).alias("imaging_parameters"),
        text.alias("voxel_size"), *[size[c].alias(f"sample_size_{c}") for c in "xyz"], F.floor(n["z"] / 3).cast("int").alias("example_z"),
    )
    return rows.join(channels.select("filename", "series", "channel", rgba(F.col("colour")).alias("colour")), ["filename", "series"], "left")


def projector_export(features: DataFrame, labels: DataFrame, keys: tuple[str, str], folder: str, prefix: str = "") -> tuple[str, str]:
    """Write a matrix of features without header and a table of features and labels, as tab-separated files in the same order.

    keys: the two index columns, which come last in the metadata as `image` and `patch`. Both files come from one sorted
    table, dealt by ranges of the keys, so their rows match file by file; labels without features are left out.
    """
    values, more = [c for c in features.columns if c not in keys], [c for c in labels.columns if c not in keys]
    rows = features.join(labels, list(keys), "left").repartitionByRange(*keys).sortWithinPartitions(*keys)
    top = folder.rstrip("/")
    paths = f"{top}/{prefix}features.tsv", f"{top}/{prefix}metadata.tsv"
    rows.select(*values).write.csv(paths[0], sep="\t", header=False)
    rows.select(*values, *more, F.col(keys[0]).alias("image"), F.col(keys[1]).alias("patch")).write.csv(paths[1], sep="\t", header=True)
    return paths
