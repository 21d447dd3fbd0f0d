"""Random numbers that depend on a seed, a name and a key alone, so on no partitioning and no order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(seed: int, name: str, *key: Column | str) -> Column:
    """A number from 0 to below 1, with 52 bits."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(name), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)


def whole(low: Column, high: Column, seed: int, name: str, *key: Column | str) -> Column:
    """A whole number from low to high, both included."""
    return (low + F.floor(unit(seed, name, *key) * (high - low + 1))).cast("int")


def unit_sql(seed: int, name: str, key: str) -> str:
    """The same number of one key in SQL."""
    return f"(CAST('0x' || substr(md5('{seed}:{name}:' || {key}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"
