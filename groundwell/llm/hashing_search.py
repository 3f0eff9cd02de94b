"""Exact nearest binary codes by multi-index hashing with growing radii.

A code is cut into segments, each with its own index. When every segment has been searched up to radius
r, every code within (segments x (r + 1)) - 1 bits has been met, since one of its segments must differ in
at most r bits. A query is finished once its k-th verified distance is within that bound; only
unfinished ones go on to radius r + 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import forget, stored
from .vectors import usable

BITS, SEGMENTS = 64, 4


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is 1 where part i of the vector is above zero; missing parts are 0. In a vector of more parts than `bits`, part i
    stands for the sum of parts i, i + bits, i + 2 bits and so on, so that every part counts."""
    def folded(v):
        zero = F.lit(0.0)
        return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.aggregate(F.filter(v, lambda _, at: at % bits == i), zero, lambda acc, x: acc + x))

    return F.aggregate(
        F.when(F.size(vector) > bits, folded(vector)).otherwise(vector), F.struct(F.lit(0).cast("long").alias("code"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(x > 0, acc["code"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), acc["at"]))).otherwise(acc["code"]).alias("code"),
            (acc["at"] + 1).alias("at"),
        ),
        lambda acc: acc["code"],
    )


def masks(width: int, radius: int) -> np.ndarray:
    """All numbers of `width` bits with exactly `radius` ones."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], dtype=np.int64)


def nearest(codes: DataFrame, k: int = 10, key: str = "vec_id", code: str = "code", every: int = 50, segments: int = SEGMENTS) -> DataFrame:
    """query_id, rank, key, distance: the k nearest rows by Hamming distance, exactly, for every row whose key is divisible by `every`.

    All rows are candidates, the query's own too. Ties go to the smaller key. `code` is a long of 64 bits.
    Rows with a null key or code take no part; repeated (key, code) rows count once. Equal codes are one index
    entry with its k smallest keys, so copies cost nothing. Other columns are ignored.
    """
    width = BITS // segments
    rows = stored(codes.select(F.col(key).cast("long").alias("id"), F.col(code).cast("long").alias("code")).where("id is not null and code is not null").distinct())
    # k smallest keys of each code, chosen inside each task first
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("_r") <= k)
    entries = stored(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    queries = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    open_ = stored(queries.select("q").distinct().withColumn("found", F.array().cast("array<struct<distance:int,id:long>>")))

    def cuts(value: str):
        return F.explode(F.array(*[
            F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned(F.col(value), width * s).bitwiseAND((1 << width) - 1).alias("part"))
            for s in range(segments)
        ]))

    # joins with stored tables name a shuffle: the size of compressed files says little about the size in memory
    index = stored(entries.select("code", "ids", cuts("code").alias("_s")).select("code", "ids", "_s.*"))
    done = None
    for radius in range(width + 1):
        flips = masks(width, radius)

        def probes(batches: Iterator[pa.RecordBatch], flips=flips) -> Iterator[pa.RecordBatch]:
            lot = max(1, (1 << 18) // len(flips))
            for batch in batches:
                for start in range(0, batch.num_rows, lot):
                    some = batch.slice(start, lot)
                    q, s, part = (some.column(i).to_numpy() for i in range(3))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(q, len(flips))), pa.array(np.repeat(s, len(flips))), pa.array((part[:, None] ^ flips[None, :]).ravel())],
                        ["q", "segment", "part"])

        asked = open_.select("q", cuts("q").alias("_s")).select("q", F.col("_s.segment").alias("segment"), F.col("_s.part").alias("part"))
        met = asked.mapInArrow(probes, "q long, segment int, part long").join(index.hint("shuffle_hash"), ["segment", "part"]).select(
            "q", "code", "ids", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance")
        )
        # the k best (distance, id) of each query: codes are ranked inside each task before they move
        near = met.withColumn("_r", F.rank().over(W.partitionBy("q").orderBy("distance"))).where(F.col("_r") <= k * segments)
        near = near.select("q", "distance", F.explode("ids").alias("id")).union(
            open_.select("q", F.explode("found").alias("_f")).select("q", "_f.distance", "_f.id")
        ).distinct()
        best = near.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))).where(F.col("_r") <= k)
        found = stored(best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("found"), F.max("distance").alias("_far")))
        covered = segments * (radius + 1) - 1
        proven = (F.size("found") >= k) & (F.col("_far") <= covered)
        if covered >= BITS - 1 + 1 or radius == width:
            proven = F.lit(True)
        ready = found.where(proven).select("q", "found")
        done = ready if done is None else done.union(ready)
        rest = stored(open_.select("q").join(found.where(proven).hint("shuffle_hash"), "q", "left_anti").join(found.select("q", "found").hint("shuffle_hash"), "q", "left").select(
            "q", F.coalesce("found", F.array().cast("array<struct<distance:int,id:long>>")).alias("found")
        ))
        forget(open_)
        open_ = rest
        if not open_.limit(1).count():
            break
    return queries.hint("shuffle_hash").join(done, "q").select("query_id", F.posexplode("found").alias("_at", "_f")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("_f.id").alias(key), F.col("_f.distance").alias("distance")
    )


def sign_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, code of every usable vector."""
    return usable(df, key, vector).select(F.col("id").alias(key), sign_code(F.col("v")).alias("code"))
