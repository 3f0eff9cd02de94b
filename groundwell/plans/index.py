"""Chunks to a stored index: passages with their vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.keys import embedding_key
from ..operators.chunking import contextual_text
from ..session import cut_lineage
from ..sources.memo import ExpiringTable

NULLABLE_STRINGS = ("specialty", "doc_version", "source_url")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def records(chunks: DataFrame, embed: Callable[[Column], Column], vectors: ExpiringTable | None = None, settings: Settings = Settings(),
            now_ms: int | None = None) -> DataFrame:
    """Chunks with their vector; NULL strings become empty so that stored types are stable.

    With a table of `vectors`, only texts it does not hold are embedded, each once, and kept there.
    """
    text = contextual_text(F.col("title"), F.col("section_path"), F.col("text"))
    filled = chunks.na.fill("", list(NULLABLE_STRINGS))
    if vectors is None:
        return filled.withColumn("vector", embed(text))
    key = embedding_key(settings.embed_model, settings.embed_dim, F.col("_whole"))
    made = vectors.read_through(
        filled.withColumn("_whole", text), key, "_whole", lambda missing: missing.select("key", embed(F.col("text")).cast("array<double>").alias("vector")), now_ms)
    return made.drop("_whole", "error")


def _content(chunks: DataFrame) -> Column:
    """Digest of all that a record is made of, so that any change of it is noticed."""
    names = sorted(c for c in chunks.columns if c not in ("ingested_at", "vector", "ord"))
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "true"}), 256)


def refresh(chunks: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of `held` that still stand, chunks that are new or changed). Vanished chunks are in neither."""
    given = chunks.na.fill("", [c for c in NULLABLE_STRINGS if c in chunks.columns])
    shared = [c for c in given.columns if c in held.columns and c != "ord"]
    now = given.select("chunk_id", _content(given.select(*shared)).alias("_digest"))
    then = held.select("chunk_id", _content(held.select(*shared)).alias("_digest"))
    same = now.join(then, ["chunk_id", "_digest"]).select("chunk_id").distinct()
    return held.join(same, "chunk_id", "left_semi"), chunks.join(same, "chunk_id", "left_anti")


def build(chunks: DataFrame, path: str, embed: Callable[[Column], Column], recreate: bool = False, vectors: ExpiringTable | None = None,
          settings: Settings = Settings(), now_ms: int | None = None) -> int:
    """Write the index and return how many rows were added or replaced. With `vectors`, texts embedded before are not embedded again.

    Without `recreate` only new and changed chunks are embedded: changed ones replace what the table held,
    vanished ones leave it, so running it again adds nothing. The new table is written beside the old one and
    takes its place when it is whole.
    """
    spark = chunks.sparkSession
    if recreate or not exists(spark, path):
        records(chunks, embed, vectors, settings, now_ms).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path).count()
    held = spark.read.parquet(path)
    kept, fresh = refresh(chunks, held)
    fresh = cut_lineage(records(fresh, embed, vectors, settings, now_ms).select(*held.columns))
    aside = f"{path.rstrip('/')}.next"
    kept.unionByName(fresh).write.mode("overwrite").parquet(aside)
    inserted = fresh.count()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(aside)
    place = old.getFileSystem(conf)
    place.delete(old, True)
    if not place.rename(new, old):
        raise OSError(f"{aside} holds the new index but could not take the place of {path}")
    spark.catalog.refreshByPath(path)
    return inserted
