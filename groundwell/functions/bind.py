"""Name a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once.

    Lambda bodies are evaluated per element and Spark does not share sub-expressions inside them,
    so a long value used there would be recomputed each time. Binding it through a one-element
    array avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def offset(df, keys, bucket, order, value, out):
    """Running total of `value` within `keys`, in two levels.

    Rows are summed inside (keys, bucket) first; only one row per bucket takes part in the window
    over the whole key. A key holding a large share of all rows is thus spread over its buckets.
    `order` must sort rows of one bucket before rows of the next.
    """
    from pyspark.sql import Window as W

    inner = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return before(df.withColumn("_within", F.sum(value).over(inner)), keys, bucket, value, "_within", out)


def before(df, keys, bucket, value, within, out):
    """The running total of `offset` where that inside each bucket, `within`, is known already; drops `within`."""
    from pyspark.sql import Window as W

    outer = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    base = (
        df.groupBy(*keys, bucket).agg(F.sum(value).alias("_in_bucket"))
        .select(*keys, bucket, F.coalesce(F.sum("_in_bucket").over(outer), F.lit(0)).alias("_before"))
    )
    # null keys and buckets are groups of their own here, as they are in the windows
    renamed = base.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, bucket)], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, bucket)]
    return (
        df.join(renamed, same)
        .withColumn(out, F.col("_before") + F.col(within))
        .drop("_before", within, *[f"_of_{c}" for c in (*keys, bucket)])
    )


def unroll(df, array, item, position=None):
    """One row per array element, with its position on request.

    The outer generator is used on purpose. For the inner one the optimizer infers a filter on the
    array's size and pushes it below the projection that builds the array, so a computed array
    would be worked out twice, nested ones many times over.
    """
    others = [c for c in df.columns if c != array]
    if position is None:
        out = df.select(*others, F.explode_outer(array).alias(item))
        return out.where(F.col(item).isNotNull())
    out = df.select(*others, F.posexplode_outer(array).alias(position, item))
    return out.where(F.col(position).isNotNull())
