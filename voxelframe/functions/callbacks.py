"""Users' own functions over slices, slabs and tiles, as grouped Arrow jobs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_slice(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """function on the voxels of each slice of each volume; a slice is the group, so its size bounds a task's memory."""
    return rows.groupBy("volume_id", "z").applyInPandas(function, schema)


def per_slab(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A labelling function on each slab (see grid.slabs); its labels go on to labelling.reconcile_slabs."""
    return rows.groupBy("volume_id", "slab").applyInPandas(function, schema)


def per_tile(cut: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """function on each tile of each slice; a tile whose number of rows changes is an error."""

    def checked(tile: pd.DataFrame) -> pd.DataFrame:
        out = function(tile)
        if len(out) != len(tile):
            raise ValueError(f"a tile of {len(tile)} places became one of {len(out)}")
        return out

    return cut.groupBy("volume_id", "z", "row", "col").applyInPandas(checked, schema)


def expanded(rows: DataFrame, function: Callable[[Column], list[Column]], column: str) -> DataFrame:
    """One row for each of the columns that function makes of `column`; their number is the same for all rows."""
    return rows.withColumn(column, F.explode(F.array(*function(F.col(column)))))


def filtered(rows: DataFrame, filters: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for f in filters:
        rows = rows.transform(f)
    return rows


def per_pair(pairs: DataFrame, metrics: dict[str, Callable[[Column, Column], Column]], left: str, right: str, by: list[str]) -> DataFrame:
    """Each metric of each pair of images: pairs has a row for each place with both values; a metric makes an aggregate of two columns."""
    return pairs.groupBy(*by).agg(*[f(F.col(left), F.col(right)).alias(name) for name, f in metrics.items()])
