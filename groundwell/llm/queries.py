"""The registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    angular_negatives,
    byte_bpe,
    compression_quality,
    deleted_interpolation,
    grouped_packing,
    hashing_search,
    middle_rotation,
    ownership_secrets,
    projection_forest,
    radix_repeats,
    redirect_urls,
    simhash_groups,
    surrogate_pii,
)

#: Key of the surrogates; a deployment sets its own.
SURROGATE_KEY = "groundwell"


def _table(spark, sf: str, name: str, *columns: str):
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def op1_surrogate_pii(spark, sf):
    return surrogate_pii.replace(_table(spark, sf, "documents", "doc_id", "text"), SURROGATE_KEY)


def op2_redirect_urls(spark, sf):
    return redirect_urls.judge(_table(spark, sf, "pages", "page_id", "url", "html")).drop("alias_class")


def op3_radix_repeats(spark, sf):
    return radix_repeats.repeats(_table(spark, sf, "documents", "doc_id", "text"))


def op4_projection_forest(spark, sf):
    return projection_forest.nearest(_table(spark, sf, "embeddings", "vec_id", "embedding"))


def held_out(key):
    """The fold that learning leaves out."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def quality_model(docs, labels):
    return compression_quality.fit(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))


def op5_compression_quality(spark, sf):
    docs = _table(spark, sf, "documents", "doc_id", "text")
    model = quality_model(docs, _table(spark, sf, "labels", "doc_id", "quality"))
    return compression_quality.score(docs, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def word_tokenizer() -> str:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as lines:
        return lines.read()


def op6_grouped_packing(spark, sf):
    return grouped_packing.pack(_table(spark, sf, "documents", "doc_id", "text"), word_tokenizer())


def op7_hashing_search(spark, sf):
    return hashing_search.nearest(hashing_search.sign_codes(_table(spark, sf, "embeddings", "vec_id", "embedding")))


def op8_byte_bpe(spark, sf):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode_decode(_table(spark, sf, "documents", "doc_id", "text"), ranks, public_tokenizers.PATTERN)


def op9_ownership_secrets(spark, sf):
    return ownership_secrets.digest_columns(ownership_secrets.scan(_table(spark, sf, "documents", "doc_id", "text", "source", "lang")))


def op10_simhash_groups(spark, sf):
    return simhash_groups.groups(_table(spark, sf, "documents", "doc_id", "text"))


def op11_deleted_interpolation(spark, sf):
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = deleted_interpolation.score(
        _table(spark, sf, "documents", "doc_id", "text"), learn=digest % 7 != 2, deleted=F.floor(digest / 7) % 8 == 0)
    return found.withColumn("held_out", F.coalesce(digest % 7 == 2, F.lit(False)))


def op12_angular_negatives(spark, sf):
    return angular_negatives.mine(_table(spark, sf, "embeddings", "vec_id", "embedding", "label"))


def op13_middle_rotation(spark, sf):
    found = middle_rotation.restore(middle_rotation.transform(_table(spark, sf, "documents", "doc_id", "text")))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_surrogate_pii, op2_redirect_urls, op3_radix_repeats, op4_projection_forest, op5_compression_quality,
    op6_grouped_packing, op7_hashing_search, op8_byte_bpe, op9_ownership_secrets, op10_simhash_groups,
    op11_deleted_interpolation, op12_angular_negatives, op13_middle_rotation,
)}
