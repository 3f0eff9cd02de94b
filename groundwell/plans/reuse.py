"""Answering a batch of questions once each, across batches: what an earlier run answered is not answered again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.keys import cache_key
from ..functions.text import squeeze
from ..operators.skew import skew_safe_join
from ..session import cut_lineage
from ..sources.memo import ExpiringTable


def response_key(query, settings: Settings, screen: bool):
    """Names a question but for case and spacing, under one configuration; an unscreened answer never stands for a screened one."""
    return cache_key(F.lit(settings.fingerprint), F.lower(squeeze(query)), F.lit(str(screen)))


def reuse(
    questions: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    table: ExpiringTable | None = None,
    settings: Settings = Settings(),
    screen: bool = True,
    now_ms: int | None = None,
) -> DataFrame:
    """One response per question (qid, query), under the asker's own wording.

    Questions alike but for case and spacing are one. Those with a live response in `table` take it, their trace
    marked; `compute` answers the rest, (qid, query) -> (response_key, response columns), and is written once. Responses in
    which a stage was degraded are given but not kept, so an outage lasts no longer than itself. Without a table
    nothing is read or kept.
    """
    keyed = cut_lineage(questions.select("qid", "query", response_key(F.col("query"), settings, screen).alias("response_key")))
    unique = keyed.groupBy("response_key").agg(F.min_by("query", "qid").alias("query"))
    if table is None:
        return skew_safe_join(keyed, cut_lineage(compute(cut_lineage(_asked(unique)))), "response_key").drop("response_key")
    held, open_ = table.split(cut_lineage(unique), "response_key", now_ms)
    made = cut_lineage(compute(cut_lineage(_asked(open_))))
    found = cut_lineage(
        held.drop("query").withColumn("trace", F.map_concat(F.map_filter("trace", lambda k, _: k != "cache"), F.create_map(F.lit("cache"), F.lit("hit"))))
        .unionByName(made)
    )
    table.put(made.where(F.size("degraded") == 0).withColumnRenamed("response_key", "key"), now_ms)
    return skew_safe_join(keyed, found, "response_key").drop("response_key")


def _asked(unique: DataFrame) -> DataFrame:
    return unique.select(F.col("response_key").alias("qid"), "query")
