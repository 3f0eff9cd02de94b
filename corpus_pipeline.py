"""From raw documents to packed sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm import compression_quality, grouped_packing, near_copies, ownership_secrets, radix_repeats, simhash_groups
from groundwell.llm.common import stored
from groundwell.llm.queries import quality_model, word_tokenizer


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`docs` with n_chars following the text, where there is such a column."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    return compression_quality.keep_good(docs, quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each SimHash group, of up to three differing bits as in op10, widened by exact near copies (Jaccard 0.8)."""
    return near_copies.keep_one(docs, bits=simhash_groups.MOST_BITS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that an earlier document has; a document that is all repetition stays, empty."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = radix_repeats.repeats(docs, carry=others)
    back = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    return _recounted(cut.select(*[back.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns]), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return _recounted(ownership_secrets.mask_secrets(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return grouped_packing.pack(docs, word_tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: The classifier, the digests and the tokenizer have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
