"""Rank fusion and hybrid retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from .lexical import best_per_question

FUSED_DIGITS = 12


def reciprocal_rank_fusion(
    rankings: list[DataFrame], k: int = 60, weights: list[float] | None = None, item: str = "doc_id"
) -> DataFrame:
    """qid, item, fused: the sum over rankings of weight / (k + rank), rank counted from 1.

    An item listed twice in one ranking counts twice. One shuffle, combined map-side.
    """
    weights = [1.0] * len(rankings) if weights is None else weights
    if len(weights) != len(rankings):
        raise ValueError(f"{len(rankings)} rankings but {len(weights)} weights")
    votes = [
        r.select("qid", item, (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("vote"))
        for r, w in zip(rankings, weights)
    ]
    return reduce(DataFrame.unionByName, votes).groupBy("qid", item).agg(
        F.round(F.sum("vote"), FUSED_DIGITS).alias("fused")
    )


def hybrid_topk(
    dense: DataFrame, lexical: DataFrame, k: int, rrf_k: int = Settings.rrf_k, item: str = "doc_id"
) -> DataFrame:
    """Fuse a dense and a lexical ranking: qid, item, distance, score, fused, rank.

    Both rankings meet in one grouping rather than a full outer join. Ties follow the dense order,
    then the lexical order.
    """
    none = F.lit(None)
    sides = dense.select(
        "qid", item, "distance", none.cast("double").alias("score"),
        F.col("rank").alias("_dense"), none.cast("int").alias("_lexical"),
    ).unionByName(
        lexical.select(
            "qid", item, none.cast("double").alias("distance"), "score",
            none.cast("int").alias("_dense"), F.col("rank").alias("_lexical"),
        )
    )
    vote = F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.coalesce("_dense", "_lexical")), F.lit(0.0))
    fused = sides.groupBy("qid", item).agg(
        F.max("distance").alias("distance"), F.max("score").alias("score"),
        F.round(F.sum(vote), FUSED_DIGITS).alias("fused"),
        F.min("_dense").alias("_dense"), F.min("_lexical").alias("_lexical"),
    )
    order = [F.desc("fused"), F.asc_nulls_last("_dense"), F.asc_nulls_last("_lexical"), F.asc(item)]
    return best_per_question(fused, k, order).drop("_dense", "_lexical")


def orphans(hits: DataFrame, known: DataFrame, item: str = "doc_id") -> DataFrame:
    """Hits whose item the local corpus does not hold."""
    return hits.join(known.select(item), item, "left_anti")
