"""Branch lengths: expected substitutions t and the stored form z = exp(-t / mean rate), clamped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of z, and the value to which branches are reset.
Z_MIN, Z_MAX, Z_DEFAULT = 1.0e-15, 1.0 - 1.0e-6, 0.9


def clamp(z: Column) -> Column:
    return F.greatest(F.lit(Z_MIN), F.least(F.lit(Z_MAX), z))


def length_to_z(t: Column, mean_rate: float | Column = 1.0) -> Column:
    return clamp(F.exp(-t / mean_rate))


def z_to_length(z: Column, mean_rate: float | Column = 1.0) -> Column:
    return -F.log(F.greatest(F.lit(Z_MIN), z)) * mean_rate


def rescale(z: Column, old_rate: float | Column, new_rate: float | Column) -> Column:
    """z with the same t after the mean rate changed."""
    return clamp(F.pow(z, F.lit(old_rate) / F.lit(new_rate)))
