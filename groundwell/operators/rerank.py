"""Absolute 0-10 scoring of retrieved passages, and the offline stand-in for the model that does it.

A scorer is a `(question words, passage words) -> Column` giving a score or NULL. The scale is
absolute: gate two refuses on the best score, so a relative ranking would be useless there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outcome import unwrap
from ..functions.text import overlap_share, words
from .lexical import ranked

Scorer = Callable[[Column, Column], Column]


def overlap_scorer(question: Column, passage: Column) -> Column:
    """Share of the question's words found in the passage, as a whole number from 0 to 10."""
    return F.floor(overlap_share(words(question), words(passage)) * 10 + 0.5).cast("double")


def score_pool(pool: DataFrame, scorer: Scorer = overlap_scorer) -> DataFrame:
    """Adds rerank_score to rows that carry `question` and `text`, and rerank_error: why a row has no score, if its call failed."""
    return unwrap(pool.withColumn("rerank_score", scorer(F.col("question"), F.col("text"))), "rerank_score", "rerank_error")


def rerank(pool: DataFrame, scorer: Scorer = overlap_scorer) -> DataFrame:
    """Scores a pool and orders it: scored before unscored, best first, fused order within ties."""
    order = [F.desc_nulls_last("rerank_score"), F.asc("rank")]
    return ranked(score_pool(pool, scorer), order, "place")
