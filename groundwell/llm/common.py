"""Helpers the training-data operators share: intermediate tables and connected components."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.session import scratch_folder


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and continue from the files.

    Cuts the lineage: a lost executor costs a re-read. Column pruning and pushdown go on working.
    """
    path = f"{scratch_folder(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a `stored` table that no later plan reads."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole(text: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(text, F.lit(""))


def batch_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def gives_back(run: Callable) -> Callable:
    """`run` over the batches of a task, then the memory it freed goes back to the system: workers live on to later stages."""

    @functools.wraps(run)
    def whole_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
            trim(0)

    return whole_task


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group within these links); never more rows than nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contract(edges: DataFrame) -> DataFrame:
    """Replace the links of each Arrow batch by a spanning set of them. edges(a long, b long)."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = spanning_edges(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(reduce, "a long, b long")


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): (node, component), component the smallest node.

    Alternates two star steps: every larger neighbour of a node is hung under the smallest one
    (large star), then every smaller neighbour (small star), until nothing moves; the number of
    rounds grows with the logarithm of a component's size. Minima are aggregated map-side and
    joined back, so a hub's neighbours never meet in one task. Nodes without a link to another
    node do not appear; null ends and loops are ignored.
    """
    kept = stored(contract(edges.where("a is not null and b is not null and a != b")))
    seen = _summary(kept)
    while seen[0]:
        both = kept.select("a", "b").union(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(lower, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(lower.select("a", F.col("low").alias("b"))).where("a != b").distinct()
        )
        after = stored(small)
        forget(kept)
        kept, before = after, seen
        seen = _summary(kept)
        if seen == before:
            break
    return kept.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        kept.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def checked_broadcast(spark: SparkSession, value, size: int, most: int = 64 << 20):
    """A broadcast variable for a value whose size is proven to be bounded."""
    if size > most:
        raise ValueError(f"{size} bytes are too many to broadcast; the bound is {most}")
    return spark.sparkContext.broadcast(value)
