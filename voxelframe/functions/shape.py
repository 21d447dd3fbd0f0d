"""Scalars of shapes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def physical_volume(pixels: Column, vz: Column, vy: Column, vx: Column) -> Column:
    """Missing voxel sizes are an error."""
    known = vz.isNotNull() & vy.isNotNull() & vx.isNotNull()
    return F.when(known, pixels * vz * vy * vx).otherwise(F.raise_error(F.lit("voxel size is missing")).cast("double"))


def equivalent_diameter(volume: Column) -> Column:
    """(3 V / 4 pi)^(1/3), which is the radius of a sphere of that volume; kept under its usual name."""
    return F.pow(F.lit(0.75) * volume / F.pi(), F.lit(1.0 / 3.0))


def _root(value: Column) -> Column:
    small = F.when((value < 0) & (value > -1e-9), 0.0).otherwise(value)
    return F.when(small < 0, F.raise_error(F.lit("negative eigenvalue")).cast("double")).otherwise(F.sqrt(F.greatest(small, F.lit(0.0))))


def prolateness(l1: Column, l3: Column) -> Column:
    """(sqrt l3 - sqrt l1) / sqrt l3 of ascending eigenvalues."""
    return F.try_divide(_root(l3) - _root(l1), _root(l3))


def oblateness(l1: Column, l2: Column, l3: Column) -> Column:
    return F.try_divide(2 * (_root(l2) - _root(l1)), _root(l3) - _root(l1)) - 1


def axis_ratio(major: Column, minor: Column) -> Column:
    """sqrt(1 - minor / major), 0 where major is 0."""
    return F.when(major == 0, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide(minor, major))))


def axis_length(eigenvalue: Column, unit: float = 0.5) -> Column:
    return 4 * F.sqrt(F.greatest(eigenvalue, F.lit(0.0))) * unit


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """Ascending eigenvalues of a symmetric 3 x 3 matrix as array<double>, in closed form."""
    q = (xx + yy + zz) / 3
    p2 = (F.pow(xx - q, F.lit(2)) + F.pow(yy - q, F.lit(2)) + F.pow(zz - q, F.lit(2)) + 2 * (xy * xy + xz * xz + yz * yz)) / 6
    p = F.sqrt(p2)
    a, b, c = (F.try_divide(m - q, p) for m in (xx, yy, zz))
    d, e, f = (F.try_divide(m, p) for m in (xy, xz, yz))
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    angle = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3
    high = q + 2 * p * F.cos(angle)
    low = q + 2 * p * F.cos(angle + 2 * F.pi() / 3)
    found = F.array(low, 3 * q - high - low, high)
    return F.when(p2 == 0, F.array(q, q, q)).otherwise(found)
