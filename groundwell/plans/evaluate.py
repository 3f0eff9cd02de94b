"""Evaluation runs and threshold calibration over a whole case set at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.bind import unroll
from ..operators import evaluation
from ..operators.rerank import rerank
from ..operators.rewrite import rewrite
from ..session import cut_lineage
from .answer import Index, Providers, answer, retrieve


@dataclass(frozen=True)
class Evaluated:
    results: DataFrame
    metrics: DataFrame


def run_eval(
    cases: DataFrame, index: Index, providers: Providers = Providers(), settings: Settings = Settings()
) -> Evaluated:
    """Every case answered and judged: results per case, metrics per bucket and over all."""
    asked = cases.select(F.col("id").alias("qid"), "query")
    responses = cut_lineage(answer(asked, index, providers, settings))
    cited = unroll(responses.select(F.col("qid").alias("id"), "citations"), "citations", "c").select(
        "id", "c.chunk_id", "c.doc_id", "c.section"
    )
    hits = evaluation.retrieval_hits(cases, cited, index.passages)
    outcome = responses.select(
        F.col("qid").alias("id"), "answered", "refusal_reason", "top_score", F.size("citations").alias("n_citations")
    )
    judged = evaluation.judge(cases.join(outcome, "id").join(hits, "id", "left"))
    results = cut_lineage(judged)
    return Evaluated(results, evaluation.metrics(results))


def calibrate(
    cases: DataFrame, index: Index, providers: Providers = Providers(), settings: Settings = Settings()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """scores, grid, threshold. Stops after scoring: nothing is drafted."""
    asked = cut_lineage(
        cases.where(F.col("bucket").isin("answerable", "unanswerable")).select(
            F.col("id").alias("qid"), F.col("query").alias("question"),
            rewrite(F.col("query"))["rewritten"].alias("rewritten"), "bucket",
        )
    )
    first, _, _ = retrieve(asked.drop("bucket"), index, providers, settings)
    scores = cut_lineage(evaluation.top_scores(rerank(first, providers.scorer), asked))
    grid = evaluation.sweep_grid(scores)
    return scores, grid, evaluation.pick_threshold(grid)
