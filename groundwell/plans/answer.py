"""Answering many questions at once: gate, retrieve, score, gate, draft, gate.

Branches are filters on one table of questions, never Python control flow. The corpus is read
once for each retrieval half, at the depth the corrective retry needs: the first pass is the top
of the same ranking. What leaves retrieval is at most a few dozen rows per question.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.bind import let
from ..functions.keys import cache_key, embedding_key
from ..functions.outcome import unwrap
from ..functions.text import overlap_share, sentences, tokens, words
from ..functions.vectors import blend
from ..operators import confidence, corrective, lexical, output_gate, wording
from ..operators.dense import cosine_topk, mean_unit_vector
from ..operators.fusion import hybrid_topk, orphans
from ..operators.intent import classify
from ..operators.rerank import Scorer, overlap_scorer, rerank
from ..operators.rewrite import rewrite
from ..operators.skew import skew_safe_join
from ..schemas import CITATIONS, CLAIMS
from ..session import broadcast_if_small, cut_lineage
from ..sources.embeddings import hashing_embedder
from ..sources.memo import Memory
from .reuse import reuse


def extractive_drafts(kept: DataFrame) -> DataFrame:
    """Offline stand-in for the generator: each kept passage's sentence nearest the question.

    qid, answer, claims, insufficient_context from kept passages (question, marker, text).
    """
    def nearest(text: Column, question: Column) -> Column:
        return let(
            words(question),
            lambda qw: F.array_max(
                F.transform(
                    sentences(text),
                    lambda s, i: F.struct(overlap_share(qw, words(s)).alias("share"), (-i).alias("first"), s.alias("s")),
                )
            )["s"],
        )

    number = F.substr(F.col("marker"), F.lit(2)).cast("int")
    picked = kept.select("qid", number.alias("n"), "marker", nearest(F.col("text"), F.col("question")).alias("s"))
    listed = picked.where(F.col("s").isNotNull()).groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("n", "marker", "s"))).alias("parts")
    )
    prose = F.transform("parts", lambda p: F.concat(p["s"], F.lit(" ["), p["marker"], F.lit("]")))
    claims = F.transform("parts", lambda p: F.struct(p["s"].alias("text"), F.array(p["marker"]).alias("chunk_ids")))
    return listed.select(
        "qid", F.array_join(prose, " ").alias("answer"), claims.cast(CLAIMS).alias("claims"),
        F.lit(False).alias("insufficient_context"),
    )


@dataclass(frozen=True)
class Providers:
    """Everything a model would do. The defaults work offline and are stand-ins, not equals.

    A provider that may fail says so as data: `intent`, `scorer`, `support` and `framing` may give struct(value, error), as
    `functions.outcome.guarded` does, and the tables of `hypothetical` and `draft` may hold a column `error`.
    """

    embed: Callable[[Column], Column] = field(default_factory=hashing_embedder)
    intent: Callable[[Column], Column] | None = None
    hypothetical: Callable[[DataFrame], DataFrame] | None = None  # (qid, rewritten) -> (qid, passage)
    scorer: Scorer = overlap_scorer
    draft: Callable[[DataFrame], DataFrame] = extractive_drafts
    support: output_gate.SupportJudge = output_gate.overlap_support
    framing: output_gate.FramingJudge = output_gate.phrase_framing


@dataclass(frozen=True)
class Index:
    """Passages (chunk_id, doc_id, title, section_path, page_start, page_end, source_url, text),
    their lexical corpus and their vectors (chunk_id, vector). Vectors that also carry the passage
    columns stay citable where the local corpus has lost the passage."""

    passages: DataFrame
    corpus: lexical.Corpus
    vectors: DataFrame


def embedded(rows: DataFrame, text: str, providers: Providers, settings: Settings, memory: Memory | None = None, now_ms: int | None = None) -> DataFrame:
    """`rows` with the `vector` of a text column; with a memory, only texts it does not hold are embedded."""
    if memory is None:
        return rows.withColumn("vector", providers.embed(F.col(text)))
    key = embedding_key(settings.embed_model, settings.embed_dim, F.col(text))
    made = memory.vectors.read_through(
        rows, key, text, lambda missing: missing.select("key", providers.embed(F.col("text")).cast("array<double>").alias("vector")), now_ms)
    return made.drop("error")


def build_index(passages: DataFrame, providers: Providers = Providers(), settings: Settings = Settings(), memory: Memory | None = None,
                now_ms: int | None = None) -> Index:
    from ..operators.chunking import contextual_text, index_text

    parts = F.col("title"), F.col("section_path"), F.col("text")
    # Tokens and vectors are made in one pass and written: counting, scoring and the search of vectors, whose filter
    # for missing ones would call the provider a second time, only read them.
    of_tokens = getattr(providers.embed, "of_tokens", None)
    if memory is None and of_tokens is not None:  # both texts have the same tokens, but that the embedded one may be null
        cut = passages.select("chunk_id", tokens(contextual_text(*parts)).alias("_cut"), index_text(*parts).alias("_text"))
        whole = cut.select("chunk_id", F.coalesce("_cut", tokens(F.col("_text"))).alias("tokens"), of_tokens(F.col("_cut")).alias("vector"))
    else:
        whole = passages.select("chunk_id", tokens(index_text(*parts)).alias("tokens"), contextual_text(*parts).alias("_whole"))
        whole = embedded(whole, "_whole", providers, settings, memory, now_ms)
    made = cut_lineage(whole.select("chunk_id", "tokens", "vector"))
    corpus = lexical.token_corpus(made.select(F.col("chunk_id").alias("doc_id"), "tokens"))
    return Index(passages, corpus, made.select("chunk_id", "vector"))


def _drafted(asked: DataFrame, providers: Providers, settings: Settings, memory: Memory | None, now_ms: int | None) -> DataFrame:
    """qid, passages, error: what the provider wrote for each question; with a memory, only for questions it does not hold."""
    def write(missing: DataFrame) -> DataFrame:
        rows = providers.hypothetical(missing.select(F.col("key").alias("qid"), F.col("text").alias("rewritten")))
        error = F.max("error") if "error" in rows.columns else F.lit(None).cast("string")
        return rows.groupBy(F.col("qid").alias("key")).agg(F.sort_array(F.collect_list("passage")).alias("passages"), error.alias("error"))

    key = cache_key(F.lit(settings.blend_model or settings.guard_model), F.lit(settings.blend_version), F.lit(str(settings.blend_n)), F.col("rewritten"))
    if memory is None:
        distinct = asked.groupBy(key.alias("key")).agg(F.any_value("rewritten").alias("text"))
        return asked.select("qid", key.alias("key")).join(write(distinct), "key", "left").drop("key")
    # an empty result is no failure, and is not kept either
    def kept(missing: DataFrame) -> DataFrame:
        return write(missing).withColumn("error", F.when(F.size("passages") == 0, F.coalesce("error", F.lit(""))).otherwise(F.col("error")))

    made = memory.passages.read_through(asked.select("qid", "rewritten"), key, "rewritten", kept, now_ms)
    return made.select("qid", "passages", F.nullif("error", F.lit("")).alias("error"))


def question_vectors(asked: DataFrame, providers: Providers, settings: Settings, memory: Memory | None = None, now_ms: int | None = None) -> tuple[DataFrame, bool]:
    """qid, first, wide, blended, blend_error: the vectors of both passes; and whether they may differ.

    A question whose passages could not be drafted is searched by its own vector alone.
    """
    base = embedded(asked.select("qid", "rewritten"), "rewritten", providers, settings, memory, now_ms)
    if providers.hypothetical is None or not settings.blend_enabled or settings.blend_n < 1:
        alone = base.select("qid", F.col("vector").alias("first"), F.col("vector").alias("wide"))
        return alone.withColumn("blended", F.lit("disabled")).withColumn("blend_error", F.lit(None).cast("string")), False
    drafted = cut_lineage(_drafted(asked, providers, settings, memory, now_ms))
    parts = drafted.select("qid", F.explode("passages").alias("passage"))
    means = mean_unit_vector(embedded(parts, "passage", providers, settings, memory, now_ms).select("qid", "vector"), "qid")
    both = base.join(means, "qid", "left").join(drafted.select("qid", F.col("error").alias("blend_error")), "qid", "left")
    query, mean = F.col("vector").cast("array<double>"), F.col("mean")
    return both.select(
        "qid", blend(query, mean, settings.blend_weight).alias("first"),
        blend(query, mean, settings.corrective_blend_weight).alias("wide"),
        F.when(F.col("blend_error").isNotNull(), "failed").when(mean.isNull(), "no passage").otherwise("used").alias("blended"), "blend_error",
    ), True


def retrieve(
    asked: DataFrame, index: Index, providers: Providers, settings: Settings, vectors: tuple[DataFrame, bool] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First pass, wide pass (both with question and passage columns), and the orphan hits.

    `asked` (qid, question, rewritten) is read several times, so pass it with its lineage cut, and `vectors`, of
    `question_vectors`, too.
    Both passes of a question are two rows of one dense search, told apart by the first character of their id.
    """
    deep = max(settings.retrieve_k, settings.corrective_k)
    lexical_hits = cut_lineage(
        lexical.bm25_topk(index.corpus, asked.select("qid", "rewritten"), deep, text="rewritten")
        .withColumnRenamed("doc_id", "chunk_id")
    )
    if vectors is None:
        found, differ = question_vectors(asked, providers, settings)
        vectors = cut_lineage(found), differ
    vectors, differ = vectors
    sides = [("first", "0")] + ([("wide", "1")] if differ else [])
    tagged = reduce(
        DataFrame.unionByName,
        [vectors.select(F.concat(F.lit(n), "qid").alias("qid"), F.col(c).alias("vector")) for c, n in sides],
    )
    dense = cut_lineage(
        cosine_topk(tagged, index.vectors, deep, "chunk_id")
        .withColumn("wide", F.substring("qid", 1, 1).cast("int"))
        .withColumn("qid", F.substring(F.col("qid"), F.lit(2), F.length("qid")))
    )
    second = dense.where(F.col("wide") == (1 if differ else 0)).drop("wide")
    first = dense.where(F.col("wide") == 0).drop("wide")
    k, wide_k = settings.retrieve_k, settings.corrective_k
    near = hybrid_topk(
        first.where(F.col("rank") <= k), lexical_hits.where(F.col("rank") <= k), k, settings.rrf_k, "chunk_id"
    )
    far = hybrid_topk(
        second.where(F.col("rank") <= wide_k), lexical_hits.where(F.col("rank") <= wide_k), wide_k,
        settings.rrf_k, "chunk_id",
    )
    pool = cut_lineage(near.withColumn("wide", F.lit(False)).unionByName(far.withColumn("wide", F.lit(True))))
    wanted = broadcast_if_small(pool.select("chunk_id").distinct())
    local = cut_lineage(index.passages.join(wanted, "chunk_id", "left_semi"))
    lost = orphans(pool.where(~F.col("wide")).select("qid", "chunk_id"), local, "chunk_id")
    found, columns = local, index.passages.columns
    if set(columns) <= set(index.vectors.columns):
        stray = index.vectors.select(*columns).join(wanted, "chunk_id", "left_semi")
        found = local.unionByName(stray.join(local.select("chunk_id"), "chunk_id", "left_anti"))
    filled = cut_lineage(
        skew_safe_join(pool, found, "chunk_id").join(asked.select("qid", F.col("question")), "qid")
    )
    return filled.where(~F.col("wide")).drop("wide"), filled.where("wide").drop("wide"), lost


def answer(
    questions: DataFrame,
    index: Index,
    providers: Providers = Providers(),
    settings: Settings = Settings(),
    screen: bool = True,
    memory: Memory | None = None,
    now_ms: int | None = None,
) -> DataFrame:
    """One response per question (qid, query): every exit gives one, refusals included.

    Questions alike but for case and spacing are answered once, then joined back to each asker. With a memory, live
    responses, vectors and drafted passages of earlier runs are used, and new ones kept.
    """
    def compute(unique: DataFrame) -> DataFrame:
        return _run(unique, index, providers, settings, screen, memory, now_ms)

    return reuse(questions, compute, memory and memory.responses, settings, screen, now_ms)


def _run(unique: DataFrame, index: Index, providers: Providers, settings: Settings, screen: bool, memory: Memory | None, now_ms: int | None) -> DataFrame:
    """Responses to distinct questions (qid, query)."""
    model, asked = None, unique.withColumn("_model_error", F.lit(None).cast("string"))
    if providers.intent is not None and screen:
        asked = unwrap(unique.withColumn("_model", providers.intent(F.col("query"))), "_model", "_model_error")
        model = F.col("_model")
    screened = cut_lineage(
        asked.withColumn("intent", classify(F.col("query"), model, screen)).withColumn("rewrite", rewrite(F.col("query")))
        .select("qid", "query", "intent", "rewrite", F.when(F.col("intent.rule") == "fail-closed", F.coalesce("_model_error", F.lit("no label"))).alias("intent_error"))
    )
    live = screened.where(F.col("intent.intent") == "in_scope").select(
        "qid", F.col("query").alias("question"), F.col("rewrite.rewritten").alias("rewritten")
    )

    vectors, differ = question_vectors(live, providers, settings, memory, now_ms)
    vectors = cut_lineage(vectors)
    first, wide, lost = retrieve(live, index, providers, settings, (vectors, differ))
    scored = cut_lineage(rerank(first, providers.scorer))
    verdict = cut_lineage(confidence.verdicts(scored, live, settings))
    again = verdict.where(F.col("action") == "correct").select("qid")
    merged = cut_lineage(
        corrective.merge_retry(
            scored.join(again, "qid", "left_semi"), wide.join(again, "qid", "left_semi"),
            providers.scorer, "chunk_id",
        )
    )
    second = confidence.verdicts(merged, None, settings, allow_correction=False)
    final = (
        verdict.join(
            second.select("qid", *[F.col(c).alias(f"_{c}") for c in ("top_score", "action", "reason")]), "qid", "left"
        )
        .select(
            "qid", F.coalesce("_top_score", "top_score").alias("top_score"),
            F.coalesce("_action", "action").alias("action"),
            F.col("action").alias("first_action"), F.col("reason").alias("confidence_reason"),
            F.col("_reason").alias("corrected_reason"), "n_results",
        )
    )
    columns = [c for c in scored.columns]
    pool = scored.join(again, "qid", "left_anti").unionByName(merged.select(*columns))
    scores = F.transform(F.slice(F.sort_array(F.collect_list("rerank_score"), asc=False), 1, 5), lambda score: score.cast("string"))
    scoring = pool.groupBy("qid").agg(
        F.count("rerank_score").cast("string").alias("scored"), F.array_join(scores, ", ").alias("top_scores"), F.max("rerank_error").alias("rerank_error"))
    kept = cut_lineage(confidence.kept_passages(pool, settings))

    number = F.substr(F.col("marker"), F.lit(2)).cast("int")
    citation = F.struct(
        number.alias("n"), "marker", "chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "title",
        F.col("section_path").alias("section"),
        wording.page_label(F.col("page_start"), F.col("page_end")).alias("pages"), "source_url", "rerank_score",
    )
    context = kept.groupBy("qid").agg(
        F.sort_array(
            F.collect_list(F.struct(number.alias("n"), "chunk_id", "marker", "text"))
        ).alias("_passages"),
        F.sort_array(F.collect_list(citation)).alias("_citations"),
    ).select(
        "qid",
        F.transform("_passages", lambda p: F.struct(p["chunk_id"].alias("chunk_id"), p["marker"].alias("marker"), p["text"].alias("text"))).alias("passages"),
        F.transform("_citations", lambda c: c.dropFields("n")).cast(CITATIONS).alias("citations"),
    )
    drafted = providers.draft(kept)
    if "error" not in drafted.columns:
        drafted = drafted.withColumn("error", F.lit(None).cast("string"))
    drafts = (
        context.join(drafted.withColumnRenamed("error", "draft_error"), "qid", "left")
        .withColumn("insufficient_context", F.coalesce("insufficient_context", F.lit(True)))
        .join(screened.select("qid", "query"), "qid")
    )
    checked = output_gate.validate(drafts, providers.support, providers.framing).select(
        "qid", "citations", "passed", F.col("reason").alias("gate_reason"), F.col("detail").alias("gate_detail"),
        "final_answer", "final_claims", "invalid_citations", "unsupported_numbers", "unsupported_claims",
        "safety_flags", F.size("claims").cast("string").alias("n_claims"), F.col("insufficient_context").cast("string").alias("insufficient"),
        "draft_error", "support_error", "framing_error",
    )
    about = vectors.select("qid", "blended", "blend_error").join(scoring, "qid", "left")
    return respond(screened, final, checked, lost, about)


#: The stages whose failure is told in `degraded`, in the order they run, and the column that holds a failure of each.
STAGES = (
    ("intent_classifier", "intent_error"), ("blend", "blend_error"), ("reranker", "rerank_error"),
    ("generator", "draft_error"), ("support_judge", "support_error"), ("safety_classifier", "framing_error"),
)


def respond(screened: DataFrame, final: DataFrame, checked: DataFrame, lost: DataFrame, about: DataFrame) -> DataFrame:
    """Fold every exit into one response row: what was decided, the trace of each stage, and the stages that failed."""
    orphaned = lost.groupBy("qid").agg(F.count("*").alias("n_orphans"))
    rows = (
        screened.join(final, "qid", "left").join(checked, "qid", "left").join(orphaned, "qid", "left").join(about, "qid", "left")
        .withColumn("rerank_error", F.coalesce("rerank_error", F.when((F.col("n_results") > 0) & F.col("top_score").isNull(), "no scores")))
    )
    intent = F.col("intent.intent")
    reason = (
        F.when(intent != "in_scope", intent)
        .when(F.coalesce("action", F.lit("refuse")) != "proceed", "low_confidence")
        .otherwise(F.col("gate_reason"))
    )
    answered = F.col("refusal_reason").isNull()
    in_scope = intent == "in_scope"
    stages = F.array_join(F.filter(F.array(
        F.lit("intent"), *[F.when(in_scope, name) for name in ("retrieve", "rerank", "confidence")],
        F.when(F.col("first_action") == "correct", "corrective"), F.when(F.col("gate_detail").isNotNull(), "generate"),
        F.when(F.col("gate_detail").isNotNull(), "output_gate"),
    ), lambda s: s.isNotNull()), ",")
    checks = ("invalid_citations", "unsupported_numbers", "unsupported_claims", "safety_flags")
    listed = [x for name in checks for x in (F.lit(name), F.nullif(F.array_join(name, ", "), F.lit("")))]
    failures = [x for name, column in STAGES for x in (F.lit(f"{name}_error"), F.col(column))]
    trace = F.map_filter(
        F.create_map(
            F.lit("stages"), stages, F.lit("short_circuited"), F.when(~in_scope, "no retrieval performed"),
            F.lit("blend"), F.col("blended"), F.lit("scored"), F.col("scored"), F.lit("top_scores"), F.nullif("top_scores", F.lit("")),
            F.lit("claims"), F.col("n_claims"), F.lit("insufficient_context"), F.col("insufficient"), F.lit("passed"), F.col("passed").cast("string"),
            *listed, *failures,
            F.lit("intent"), intent, F.lit("intent_reason"), F.col("intent.reason"),
            F.lit("rule"), F.col("intent.rule"), F.lit("rewritten"), F.col("rewrite.rewritten"),
            F.lit("expansions"), F.array_join("rewrite.applied", "; "),
            F.lit("retrieved"), F.col("n_results").cast("string"),
            F.lit("orphans"), F.col("n_orphans").cast("string"),
            F.lit("action"), F.col("first_action"), F.lit("confidence"), F.col("confidence_reason"),
            F.lit("after_correction"), F.col("corrected_reason"), F.lit("output_gate"), F.col("gate_detail"),
        ),
        lambda _, v: v.isNotNull(),
    )
    degraded = F.filter(F.array(*[F.when(F.col(column).isNotNull(), name) for name, column in STAGES]), lambda d: d.isNotNull())
    return rows.withColumn("refusal_reason", reason).select(
        F.col("qid").alias("response_key"),
        answered.alias("answered"),
        F.when(answered, F.col("final_answer")).otherwise(wording.refusal_text(F.col("refusal_reason"))).alias("answer"),
        F.when(answered, F.col("final_claims")).otherwise(F.array().cast(CLAIMS)).alias("claims"),
        F.when(answered, F.col("citations")).otherwise(F.array().cast(CITATIONS)).alias("citations"),
        "refusal_reason", "top_score", F.lit(wording.DISCLAIMER).alias("disclaimer"),
        trace.alias("trace"), degraded.alias("degraded"),
    )
