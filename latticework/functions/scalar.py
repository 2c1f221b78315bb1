"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(values: Column) -> Column:
    """Greatest common divisor of an array of non-negative integers; 0 if all are 0."""
    # Euclid's steps shrink a number to below half every two, so 92 do for 64 bits.
    step = lambda a, b: F.aggregate(
        F.sequence(F.lit(1), F.lit(92)),
        F.struct(a.cast("long").alias("x"), b.cast("long").alias("y")),
        lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y"))),
        lambda s: s["x"],
    )
    return F.aggregate(values, F.lit(0).cast("long"), step)
