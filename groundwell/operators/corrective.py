"""One wider retry for questions whose best passage fell just short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import ranked
from .rerank import Scorer, overlap_scorer, score_pool


def merge_retry(
    first: DataFrame, retried: DataFrame, scorer: Scorer = overlap_scorer, item: str = "doc_id"
) -> DataFrame:
    """The union of both passes with every passage scored, ordered by score.

    `first` is a reranked pool (place, rerank_score); `retried` the wider retrieval of the same
    questions (rank), with question and text. A passage both passes found keeps its first score;
    only passages without one are scored. Nothing of the first pass is lost.
    """
    known = first.select("qid", item)
    fresh = score_pool(retried.join(known, ["qid", item], "left_anti"), scorer)
    unscored = first.where(F.col("rerank_score").isNull())
    scored = first.where(F.col("rerank_score").isNotNull())
    pool = (
        scored.withColumn("_pass", F.lit(0)).withColumn("_at", F.col("place"))
        .unionByName(score_pool(unscored, scorer).withColumn("_pass", F.lit(0)).withColumn("_at", F.col("place")), allowMissingColumns=True)
        .unionByName(fresh.withColumn("_pass", F.lit(1)).withColumn("_at", F.col("rank")), allowMissingColumns=True)
    )
    order = [F.desc_nulls_last("rerank_score"), F.asc("_pass"), F.asc("_at"), F.asc(item)]
    return ranked(pool.drop("place"), order, "place").withColumn("is_new", F.col("_pass") == 1).drop(
        "_pass", "_at"
    )


def retry_report(first: DataFrame, merged: DataFrame) -> DataFrame:
    """qid, new_candidates, pool, top_before, top_after, improved."""
    before = first.groupBy("qid").agg(F.coalesce(F.max("rerank_score"), F.lit(0.0)).alias("top_before"))
    after = merged.groupBy("qid").agg(
        F.count_if(F.col("is_new")).alias("new_candidates"), F.count("*").alias("pool"),
        F.coalesce(F.max("rerank_score"), F.lit(0.0)).alias("top_after"),
    )
    return after.join(before, "qid", "left").select(
        "qid", "new_candidates", "pool",
        F.coalesce("top_before", F.lit(0.0)).alias("top_before"), "top_after",
        (F.col("top_after") > F.coalesce("top_before", F.lit(0.0))).alias("improved"),
    )
