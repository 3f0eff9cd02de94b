"""Second gate: proceed, correct once, or refuse, on the best absolute score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from .lexical import best_per_question


def verdicts(
    pool: DataFrame,
    questions: DataFrame | None = None,
    settings: Settings = Settings(),
    allow_correction: bool = True,
) -> DataFrame:
    """qid, n_results, top_score, action, reason per question.

    `pool` holds (qid, rerank_score). Give `questions` to cover those that retrieved nothing.
    """
    bar, floor = settings.confidence_threshold, settings.corrective_threshold
    correcting = F.lit(allow_correction and settings.corrective_enabled)
    best = pool.groupBy("qid").agg(
        F.count("*").alias("n_results"), F.max("rerank_score").alias("top_score")
    )
    if questions is not None:
        best = questions.select("qid").join(best, "qid", "left").withColumn(
            "n_results", F.coalesce("n_results", F.lit(0).cast("bigint"))
        )
    top = F.col("top_score")
    in_band = (top < bar) & (top >= floor) & correcting
    action = (
        F.when(top.isNull(), "refuse").when(top >= bar, "proceed").when(in_band, "correct").otherwise("refuse")
    )
    reason = (
        F.when(F.col("n_results") == 0, "retrieval returned nothing")
        .when(top.isNull(), "reranker produced no scores; refusing rather than guessing")
        .when(top >= bar, F.format_string("top passage scored %.1f", top))
        .when(
            in_band,
            F.format_string(
                f"best passage scored %.1f, inside the corrective band [{floor:.1f}, {bar:.1f}) -- retrying retrieval",
                top,
            ),
        )
        .otherwise(F.format_string(f"best passage scored %.1f < {bar:.1f}", top))
    )
    return best.select("qid", "n_results", "top_score", action.alias("action"), reason.alias("reason"))


def kept_passages(pool: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The passages that ground an answer: at or above the bar, the first few, marked C1, C2, ...

    `pool` holds (qid, place, rerank_score, ...). A question below the bar keeps nothing, because
    none of its passages reaches the bar.
    """
    clear = pool.where(F.col("rerank_score") >= settings.confidence_threshold)
    kept = best_per_question(clear, settings.rerank_top_n, [F.asc("place")], rank="_n")
    return kept.withColumn("marker", F.concat(F.lit("C"), F.col("_n").cast("string"))).drop("_n")
