"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of all rows. At most 1/share keys can be, which bounds the broadcast.
HOT_SHARE = 0.01


def skew_safe_join(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot_share: float = HOT_SHARE
) -> DataFrame:
    """Join many `rows` to a `lookup` holding one row per key.

    Keys above `hot_share` of the rows are looked up by broadcast and stay where they are; all
    others are joined by shuffle. The number of hot keys is bounded by arithmetic, not by the data.
    """
    total = rows.count()
    hot = (
        rows.groupBy(key).count()
        .where(F.col("count") > F.lit(max(1.0, total * hot_share)))
        .select(F.col(key).alias("_hot"))
    )
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    hot_rows = marked.where(F.col("_hot").isNotNull()).drop("_hot")
    hot_lookup = lookup.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left_semi")
    other = marked.where(F.col("_hot").isNull()).drop("_hot")
    return hot_rows.join(F.broadcast(hot_lookup), key, how).unionByName(other.join(lookup, key, how))
