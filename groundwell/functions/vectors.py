"""Vector column functions over ARRAY columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column) -> Column:
    """Scale to length one; the zero vector stays as it is."""
    # The one-element array binds the length once instead of once per component.
    scaled = F.transform(
        F.array(norm(v)),
        lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: F.try_divide(x, n))),
    )
    return F.get(scaled, F.lit(0))


def blend(query: Column, mean: Column, weight: float | Column) -> Column:
    """unit(w·unit(query) + (1−w)·unit(mean)), w clamped to [0, 1]; the query itself where no mean."""
    w = F.greatest(F.least(F.lit(weight) if isinstance(weight, (int, float)) else weight, F.lit(1.0)), F.lit(0.0))
    mixed = F.zip_with(unit(query), unit(mean), lambda q, m: w * q + (F.lit(1.0) - w) * m)
    return F.when(mean.isNull(), query).otherwise(unit(mixed))
