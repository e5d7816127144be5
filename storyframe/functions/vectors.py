"""Vectors as arrays, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """Divided by its length, 1e-12 at least."""
    # The pair makes the length once for a vector; named inside the lambda alone it would be made for every component.
    pair = F.array(F.struct(v.alias("v"), F.greatest(norm(v), F.lit(1e-12)).alias("n")))
    return F.get(F.transform(pair, lambda p: F.transform(p["v"], lambda x: x / p["n"])), F.lit(0))
