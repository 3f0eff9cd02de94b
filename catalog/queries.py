"""Every registered query: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.config import Settings
from groundwell.functions import keys, text, vectors
from groundwell.functions.bind import unroll
from groundwell.functions.outcome import guarded
from groundwell.operators import (
    accounts,
    chunking,
    confidence,
    corrective,
    dense,
    evaluation,
    fusion,
    headings,
    lexical,
    manifest,
    output_gate,
    quota,
    sections_lines,
    sections_text,
    wording,
)
from groundwell.operators.intent import classify, rule_screen
from groundwell.operators.rerank import rerank
from groundwell.operators.rewrite import rewrite
from groundwell.plans import answer as answering
from groundwell.plans import index as indexing
from groundwell.plans import ingest as ingesting
from groundwell.plans.reuse import reuse
from groundwell.schemas import CITATIONS, CLAIMS, RESPONSE
from groundwell.session import broadcast_if_small, cut_lineage, scratch_folder
from groundwell.sources import versions
from groundwell.sources.memo import ExpiringTable
from groundwell.streaming import jobs

from .tables import documents, drafted_answers, questions, spread, table, turns, typeset_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SETTINGS = Settings()
K, WIDE_K = SETTINGS.retrieve_k, SETTINGS.corrective_k


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(array, sep="|"):
    return F.array_join(array, sep)


# --- text ---------------------------------------------------------------------------------------


@query
def token_stats(spark, sf):
    return lexical.token_stats(documents(spark, sf))


@query
def sentence_split(spark, sf):
    docs = documents(spark, sf).select("doc_id", text.sentences(F.col("text")).alias("s"))
    return unroll(docs, "s", "sentence", "pos")


@query
def number_extract(spark, sf):
    found = text.numbers(F.col("text"))
    return documents(spark, sf).select("doc_id", _joined(F.array_sort(found)).alias("numbers"))


@query
def marker_strip(spark, sf):
    marked = F.concat(
        F.lit("1. "), "text", F.lit(" [C"), (F.col("turn") + 1).cast("string"), F.lit(", C2]. 2) "), "role", F.lit(" [X1]")
    )
    talk = spread(table(spark, sf, "conversations"))
    return talk.select("conv_id", "turn", text.strip_markers(marked).alias("plain"))


@query
def recognised_clean(spark, sf):
    noisy = F.concat(
        F.replace("text", F.lit(","), F.lit(" ，")), F.lit(" ( grade 三 ) 丁 “x” ％")
    )
    return documents(spark, sf).select("doc_id", text.clean_recognised(noisy).alias("cleaned"))


@query
def question_tidy(spark, sf):
    talk = spread(table(spark, sf, "conversations"))
    return talk.select("conv_id", "turn", text.squeeze(F.col("text")).alias("tidy"))


@query
def cache_key(spark, sf):
    return documents(spark, sf, "doc_id", "text", "lang").select(
        "doc_id", keys.cache_key(F.col("lang"), F.col("text")).alias("key"),
        keys.embedding_key("text-embedding-3-large", 3072, F.col("text")).alias("embedding_key"),
    )


@query
def account_keys(spark, sf):
    raw = F.concat(F.lit(" "), F.regexp_replace("c_name", "[^A-Za-z0-9]", "."), F.lit("@"), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(".COM "))
    email = keys.normalise_email(raw)
    header = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" 10.0."), F.col("c_nationkey").cast("string"), F.lit(".1 , 10.9.9.9")))
    return table(spark, sf, "customer").select(
        "c_custkey", email.alias("email"), keys.valid_email(email).alias("valid"),
        keys.subject_digest(F.col("c_custkey").cast("string"), SETTINGS.fingerprint).alias("subject"),
        keys.client_address(header, F.lit(""), F.lit("127.0.0.1")).alias("address"),
    )


@query
def iso_round_trip(spark, sf):
    iso = keys.iso_millis(F.col("ts"))
    return table(spark, sf, "events", "event_id", "ts").select(
        "event_id", iso.alias("iso"), keys.epoch_millis(iso).alias("epoch_ms"),
        keys.window_index(F.unix_seconds(F.col("ts").cast("timestamp")), 3600).alias("window"),
    )


# --- structure ----------------------------------------------------------------------------------


@query
def heading_levels(spark, sf):
    return sections_text.heading_levels(documents(spark, sf))


@query
def text_sections(spark, sf):
    return sections_text.explode_sections(sections_text.parse_text(documents(spark, sf)))


@query
def text_layer(spark, sf):
    parsed = sections_text.parse_text(documents(spark, sf))
    return parsed.select(
        "doc_id", "n_pages", "n_chars", sections_text.has_text_layer().alias("readable")
    )


@query
def body_size(spark, sf):
    return sections_lines.body_size(typeset_lines(spark, sf))


@query
def furniture_lines(spark, sf):
    """Lines recurring over the pages of a source, each document being one page of it."""
    docs = documents(spark, sf, "doc_id", "source", "text")
    lines = unroll(docs.select("source", "doc_id", F.split("text", "\n").alias("_l")), "_l", "text")
    lines = lines.where(text.strip(F.col("text")) != "").select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), text.strip(F.col("text")).alias("text")
    )
    pages = table(spark, sf, "documents", "source").groupBy(F.col("source").alias("doc_id")).agg(
        F.count("*").alias("n_pages")
    )
    return sections_lines.furniture(lines, pages, share=0.05, least=2).select(
        F.col("doc_id").alias("source"), "furniture", F.col("n_on").alias("n_docs")
    )


@query
def typeset_headings(spark, sf):
    headed = sections_lines.headed_lines(typeset_lines(spark, sf))
    return headed.select("doc_id", "line_no", "is_heading", "resets", "on_cover", "section")


@query
def typeset_sections(spark, sf):
    raw = sections_lines.raw_sections(sections_lines.headed_lines(typeset_lines(spark, sf)))
    return raw.select("doc_id", "section", "path", "page_start", "page_end", "text", "heading_level", "front")


@query
def typeset_folded(spark, sf):
    return sections_lines.parse_lines(typeset_lines(spark, sf)).select(
        "doc_id", "seq", "path", "page_start", "page_end", "text"
    )


@query
def scan_titles(spark, sf):
    name = F.format_string("%s_part-%d.txt", "source", "doc_id")
    return documents(spark, sf, "doc_id", "text", "source").select(
        "doc_id", manifest.text_title(F.col("text"), name).alias("title"),
        text.slug(F.concat(F.lit("--The "), "source", F.lit(" / No. "), F.col("doc_id").cast("string"), F.lit("!"))).alias("slug"),
    )


def _typeset_files(spark, sf) -> DataFrame:
    """Documents as typeset files of eight lines a page, with the titles that programs store in them."""
    number = F.col("doc_id").cast("string")
    return table(spark, sf, "documents", "doc_id", "text", "source", "lang").select(
        "doc_id", F.concat("source", F.lit("_part-"), number, F.lit(".pdf")).alias("filename"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"),
        (F.floor((F.size(F.split(F.coalesce("text", F.lit("")), "\n")) - 1) / 8) + 1).cast("int").alias("n_pages"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Microsoft Word - "), number, F.lit(".docx")))
        .when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit(" collection "), "lang")).alias("stored_title"),
    )


@query
def cover_titles(spark, sf):
    return manifest.cover_titles(typeset_lines(spark, sf), _typeset_files(spark, sf))


@query
def typeset_ingest(spark, sf):
    """Typeset files through the gated job; of every thirteenth no line could be read."""
    files = _typeset_files(spark, sf)
    none = F.lit(None).cast("string")
    listed = files.select(
        "doc_id", "filename", "sha256", F.col("filename").alias("title"), F.lit("").alias("url"),
        F.lit("").alias("publisher"), none.alias("specialty"), none.alias("version"),
    )
    lines = typeset_lines(spark, sf).where(F.col("doc_id") % 13 != 0).join(files.select("doc_id", "filename"), "doc_id")
    texts = files.select("filename", "sha256", F.lit("").alias("text")).where("false")
    done = ingesting.ingest(listed, texts, lines, files=files)
    why = F.when(F.col("reason").startswith("no extractable"), "no text layer").when(F.col("reason").isNotNull(), "no chunks")
    return done.report.join(done.skipped, "doc_id", "full_outer").select("doc_id", "sections", "chunks", "tokens", why.alias("skipped"))


# --- chunks -------------------------------------------------------------------------------------


def _document_chunks(spark, sf) -> DataFrame:
    sections = sections_text.explode_sections(sections_text.parse_text(documents(spark, sf)))
    return chunking.chunk_sections(sections)


@query
def chunk_pack(spark, sf):
    """Whole documents as one section each."""
    whole = documents(spark, sf).select("doc_id", F.lit(0).alias("seq"), "text")
    return chunking.chunk_sections(whole).select("chunk_id", "doc_id", "n_tokens", "text")


@query
def chunk_sections(spark, sf):
    return _document_chunks(spark, sf).select(
        "chunk_id", "doc_id", "seq", "piece", "path", "n_tokens", "text"
    )


@query
def chunk_records(spark, sf):
    """Stored chunk rows with the provenance of their document, less the time stamp."""
    about = table(spark, sf, "documents", "doc_id", "source", "lang").select(
        "doc_id", F.initcap("source").alias("title"), F.concat(F.lit("file:/"), "source").alias("url"),
        F.lit("publisher").alias("publisher"), F.col("lang").alias("specialty"), F.lit(None).cast("string").alias("version"),
    )
    rows = chunking.as_chunk_records(_document_chunks(spark, sf), about)
    return rows.select(
        "chunk_id", "title", "source_url", "specialty", "section_path", "page_start", "n_tokens",
        "doc_version", "index_version",
        F.sha2(chunking.contextual_text(F.col("title"), F.col("section_path"), F.col("text")), 256).alias("embedded"),
    )


@query
def ingest_report(spark, sf):
    sections = sections_text.explode_sections(sections_text.parse_text(documents(spark, sf)))
    report = manifest.ingest_report(sections, chunking.chunk_sections(sections))
    return report.select("doc_id", "sections", "chunks", "tokens", F.round("mean_tokens", 6).alias("mean_tokens"))


@query
def ingest_skipped(spark, sf):
    """Documents that give no chunk."""
    docs = documents(spark, sf)
    sections = sections_text.explode_sections(sections_text.parse_text(docs))
    return manifest.skipped(table(spark, sf, "documents", "doc_id"), chunking.chunk_sections(sections))


@query
def index_refresh(spark, sf):
    """Documents as chunks of an index that is built again: some are new, some changed, some gone, the rest stand."""
    last = F.col("doc_id") % 10
    chunks = table(spark, sf, "documents", "doc_id", "text", "source").select(
        F.col("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("title"), F.lit("").alias("section_path"), "text",
        F.lit(None).cast("string").alias("specialty"), F.lit(None).cast("string").alias("doc_version"), F.lit(None).cast("string").alias("source_url"),
    )
    held = indexing.records(chunks.where(last != 3).drop("doc_id"), lambda text: F.array(F.length(text).cast("float")))
    now = chunks.where(last != 4).withColumn("text", F.when(last == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).drop("doc_id")
    kept, fresh = indexing.refresh(now, held)
    return kept.select("chunk_id", F.lit("kept").alias("status")).union(fresh.select("chunk_id", F.lit("embedded").alias("status")))


# --- retrieval ----------------------------------------------------------------------------------


@query
def corpus_idf(spark, sf):
    corpus = lexical.build_corpus(documents(spark, sf))
    return lexical.corpus_idf(corpus).select("term", "df", F.round("idf", 6).alias("idf"))


def _lexical(spark, sf, k) -> DataFrame:
    return lexical.bm25_topk(lexical.build_corpus(documents(spark, sf)), questions(spark, sf), k)


@query
def bm25_topk(spark, sf):
    return _lexical(spark, sf, K)


def _embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings", "vec_id", "embedding", "label")


@query
def vector_mean_by_label(spark, sf):
    means = dense.mean_unit_vector(_embeddings(spark, sf), "label", "embedding")
    return unroll(means, "mean", "x", "pos").select("label", "pos", (F.round("x", 6) + 0.0).alias("x"))


@query
def unit_vectors(spark, sf):
    units = _embeddings(spark, sf).select("vec_id", vectors.unit(vectors.as_double(F.col("embedding"))).alias("u"))
    return unroll(units, "u", "x", "pos").select("vec_id", "pos", (F.round("x", 6) + 0.0).alias("x"))


def _stored(spark, sf) -> DataFrame:
    return _embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


@query
def cosine_topk(spark, sf):
    """The mean direction of each label asked against all vectors."""
    asked = dense.mean_unit_vector(_embeddings(spark, sf), "label", "embedding").select(
        F.col("label").alias("qid"), F.col("mean").alias("vector")
    )
    return dense.cosine_topk(asked, _stored(spark, sf), K)


@query
def cosine_filtered(spark, sf):
    """The mean direction of each label asked against the vectors of later labels only; rows without a label never count."""
    asked = dense.mean_unit_vector(_embeddings(spark, sf), "label", "embedding").select(
        F.col("label").alias("qid"), F.col("mean").alias("vector")
    )
    stored = _embeddings(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    return dense.cosine_topk(asked, stored, K, where=F.col("label") >= 5)


@query
def blend_topk(spark, sf):
    """Each label's mean blended with the next label's, as a question with its hypothetical answer."""
    means = dense.mean_unit_vector(_embeddings(spark, sf), "label", "embedding")
    following = means.select((F.col("label") - 1).alias("label"), F.col("mean").alias("next"))
    asked = means.join(following, "label", "left").select(
        F.col("label").alias("qid"), vectors.blend(F.col("mean"), F.col("next"), 0.2).alias("vector")
    )
    return dense.cosine_topk(asked, _stored(spark, sf), K)


def _supplier_rankings(spark, sf) -> list[DataFrame]:
    per = (
        table(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
        .groupBy(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("doc_id"))
        .agg(F.sum("l_quantity").alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("p"))
    )
    return [
        lexical.best_per_question(per, K, [F.desc(c), F.asc("doc_id")]) for c in ("q", "p")
    ]


@query
def rrf_fuse(spark, sf):
    return fusion.reciprocal_rank_fusion(_supplier_rankings(spark, sf))


@query
def rrf_weighted(spark, sf):
    return fusion.reciprocal_rank_fusion(_supplier_rankings(spark, sf), k=10, weights=[1.0, 0.5])


def _dense(spark, sf, k) -> DataFrame:
    """Vectors paired with passages and documents by number."""
    asked = questions(spark, sf).select("qid").join(
        _stored(spark, sf).withColumnRenamed("doc_id", "qid"), "qid"
    )
    return dense.cosine_topk(asked, _stored(spark, sf), k)


def _hybrid(spark, sf, k) -> DataFrame:
    return fusion.hybrid_topk(_dense(spark, sf, k), _lexical(spark, sf, k), k)


@query
def hybrid_topk(spark, sf):
    return _hybrid(spark, sf, K)


@query
def orphans(spark, sf):
    """Dense hits that the labelled part of the corpus does not hold."""
    return fusion.orphans(_dense(spark, sf, K), table(spark, sf, "labels", "doc_id")).select("qid", "doc_id", "rank")


@query
def query_rewrite(spark, sf):
    talk = spread(table(spark, sf, "conversations"))
    return talk.select("conv_id", "turn", rewrite(F.concat(F.col("text"), F.lit("  TB in PHC, as hypertension HTN, tb"))).alias("r")).select(
        "conv_id", "turn", "r.rewritten", _joined("r.applied").alias("applied")
    )


# --- gates --------------------------------------------------------------------------------------


@query
def intent_rules(spark, sf):
    """Conversation turns put personally, urgently or neutrally, by turn length."""
    n = F.length("text") % 6
    lead = (
        F.when(n == 0, "Should I take ").when(n == 1, "I have chest pain and ").when(n == 2, "How much should I use ")
        .when(n == 3, "my blood test ").when(n == 4, "is this life-threatening: ").otherwise("what is ")
    )
    talk = spread(table(spark, sf, "conversations"))
    return talk.select("conv_id", "turn", rule_screen(F.concat(lead, "text")).alias("v")).select(
        "conv_id", "turn", "v.intent", "v.reason"
    )


def _pools(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Reranked first pass and the wider retrieval, both with question and passage."""
    hits = cut_lineage(_lexical(spark, sf, WIDE_K))
    asked = questions(spark, sf).select("qid", F.col("text").alias("question"))
    wanted = broadcast_if_small(hits.select("doc_id").distinct())
    passages = table(spark, sf, "documents", "doc_id", "text").join(wanted, "doc_id", "left_semi")
    wide = hits.join(passages, "doc_id").join(asked, "qid").select("qid", "doc_id", "rank", "question", "text")
    wide = cut_lineage(wide)
    return rerank(wide.where(F.col("rank") <= K)), wide


@query
def rerank_scores(spark, sf):
    first, _ = _pools(spark, sf)
    return first.select("qid", "doc_id", "rank", "rerank_score", "place")


@query
def confidence_gate(spark, sf):
    first, _ = _pools(spark, sf)
    return confidence.verdicts(first, questions(spark, sf))


@query
def kept_passages(spark, sf):
    first, _ = _pools(spark, sf)
    return confidence.kept_passages(first).select("qid", "doc_id", "marker", "rerank_score")


@query
def corrective_merge(spark, sf):
    first, wide = _pools(spark, sf)
    merged = corrective.merge_retry(first, wide)
    return merged.select("qid", "doc_id", "rerank_score", "place", "is_new")


@query
def corrective_report(spark, sf):
    first, wide = _pools(spark, sf)
    again = confidence.verdicts(first).where("action = 'correct'").select("qid")
    first, wide = first.join(again, "qid", "left_semi"), wide.join(again, "qid", "left_semi")
    return corrective.retry_report(first, corrective.merge_retry(first, wide))


@query
def prompt_context(spark, sf):
    first, _ = _pools(spark, sf)
    kept = confidence.kept_passages(first).join(
        table(spark, sf, "documents", "doc_id", "source", "n_chars"), "doc_id"
    ).select(
        "qid", "doc_id", "marker", "text", F.col("source").alias("title"), F.lit("Body").alias("section_path"),
        (F.col("n_chars") % 3).alias("page_start"), (F.col("n_chars") % 3 + F.col("n_chars") % 2).alias("page_end"),
    )
    return wording.render_context(kept)


@query
def citation_check(spark, sf):
    bad = output_gate.invalid_citations(F.col("claims"), F.col("passages"))
    return drafted_answers(spark, sf).select("conv_id", "turn", _joined(bad).alias("invalid"))


@query
def number_provenance(spark, sf):
    """Numbers a document states that neither the document after it nor its own id holds."""
    docs = documents(spark, sf)
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("cited"))
    cited = F.coalesce("cited", F.lit(""))  # the last document has none after it
    bad = output_gate.unsupported_numbers(F.col("text"), cited, F.col("doc_id").cast("string"))
    return docs.join(after, "doc_id", "left").select("doc_id", _joined(bad).alias("unsupported"))


@query
def answer_repair(spark, sf):
    bad = F.transform(
        F.filter("claims", lambda c: F.length(c["text"]) % 5 == 0), lambda c: c["text"]
    )
    rows = drafted_answers(spark, sf).withColumn("bad", bad)
    fixed = output_gate.repair(F.col("answer"), F.col("claims"), F.col("bad"))
    return rows.select("conv_id", "turn", fixed.alias("r")).select(
        "conv_id", "turn", F.col("r").isNotNull().alias("salvaged"), F.col("r.answer").alias("prose"),
        _joined(F.transform("r.claims", lambda c: c["text"])).alias("claims_left"),
    )


@query
def output_gate_verdicts(spark, sf):
    checked = output_gate.validate(drafted_answers(spark, sf))
    return checked.select(
        "conv_id", "turn", "passed", "reason", "detail",
        F.size("unsupported_claims").cast("bigint").alias("n_unsupported"),
    )


@query
def refusal_messages(spark, sf):
    checked = cut_lineage(output_gate.validate(drafted_answers(spark, sf)).select("reason"))
    return checked.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).select(
        "reason", "n", wording.refusal_text(F.col("reason")).alias("message")
    )


@query
def answer_responses(spark, sf):
    """The whole path over the chunked documents, every benchmark passage asked once."""
    chunks = _document_chunks(spark, sf).join(table(spark, sf, "documents", "doc_id", "source"), "doc_id")
    passages = cut_lineage(
        chunks.select(
            "chunk_id", "doc_id", F.col("source").alias("title"), F.col("path").alias("section_path"),
            "page_start", "page_end", F.lit("").alias("source_url"), "text",
        )
    )
    asked = questions(spark, sf).withColumnRenamed("text", "query")
    responses = answering.answer(asked, answering.build_index(passages))
    return responses.select(
        "qid", "answered", "refusal_reason", "top_score", "answer",
        _joined(F.transform("citations", lambda c: F.concat_ws("=", c["marker"], c["chunk_id"]))).alias("cited"),
        F.col("trace")["action"].alias("first_action"),
    )


def _user_turns(spark, sf) -> DataFrame:
    talk = spread(table(spark, sf, "conversations")).where("role = 'user'")
    return talk.select(F.format_string("%d::%d", "conv_id", "turn").alias("qid"), F.col("text").alias("query"))


@query
def response_reuse(spark, sf):
    """User turns asked in four runs: some at first, then all half a lifetime later, all unscreened, and all when the first have expired.

    Every answer names the run that made it. The model is down for questions of every fifth length; what it then gave is not kept.
    """
    lifetime = SETTINGS.response_ttl_s * 1000
    responses = ExpiringTable(spark, f"{scratch_folder(spark)}/responses-{uuid.uuid4().hex}", RESPONSE, SETTINGS.response_ttl_s)
    asked = cut_lineage(_user_turns(spark, sf))
    runs = ((1, 0, True, F.length("query") % 3 == 0), (2, lifetime // 2, True, F.lit(True)), (3, lifetime // 2, False, F.lit(True)), (4, lifetime + 1, True, F.lit(True)))
    out = None
    for run, now, screen, some in runs:

        def compute(unique, run=run):
            down = F.length(F.lower(text.squeeze(F.col("query")))) % 5 == 0
            intent = classify(F.col("query"))["intent"]
            return unique.select(
                F.col("qid").alias("response_key"), (intent == "in_scope").alias("answered"), F.lit(f"run {run}").alias("answer"), F.array().cast(CLAIMS).alias("claims"),
                F.array().cast(CITATIONS).alias("citations"), F.nullif(intent, F.lit("in_scope")).alias("refusal_reason"), F.lit(None).cast("double").alias("top_score"),
                F.lit(wording.DISCLAIMER).alias("disclaimer"), F.create_map(F.lit("intent"), intent).alias("trace"),
                F.when(down, F.array(F.lit("intent_classifier"))).otherwise(F.array().cast("array<string>")).alias("degraded"),
            )

        got = reuse(asked.where(some), compute, responses, SETTINGS, screen, now).select(
            F.lit(run).alias("run"), "qid", "answer", F.col("trace")["cache"].alias("cache"), _joined("degraded").alias("degraded"))
        out = got if out is None else out.unionByName(got)
    return out


@query
def answer_trace(spark, sf):
    """User turns asked of the benchmark passages, with providers that fail by the length of a question: each of the six stages alone, and together."""
    def failing(stage, every, give, n=len):
        def call(rows):
            for row in rows:
                if n(row[0]) % every == 0:
                    raise TimeoutError(stage)
            return [give] * len(rows)

        return call

    intent = guarded(failing("intent_classifier", 7, {"intent": "in_scope", "reason": "fine"}), "struct<intent:string,reason:string>")
    passage = guarded(failing("blend", 5, "the guidelines on the subject"), "string")
    draft = guarded(failing("generator", 3, "drafted"), "string")
    support = guarded(failing("support_judge", 11, [True]), "array<boolean>")
    framing = guarded(failing("safety_classifier", 13, [], lambda said: len(said) - len(" [C1]")), "array<string>")

    def hypothetical(rows):
        return rows.withColumn("o", passage(F.col("rewritten"))).select("qid", F.col("o.value").alias("passage"), F.col("o.error").alias("error"))

    def drafts(kept):
        first = kept.where("marker = 'C1'").withColumn("o", draft(F.col("question")))
        claim = F.struct(F.col("question").alias("text"), F.array("marker").alias("chunk_ids"))
        said = F.when(F.col("o.value").isNotNull(), F.concat("question", F.lit(" [C1]")))
        return first.select("qid", said.alias("answer"), F.array(claim).alias("claims"), F.col("o.value").isNull().alias("insufficient_context"), F.col("o.error").alias("error"))

    providers = answering.Providers(
        intent=intent, hypothetical=hypothetical, scorer=guarded(failing("reranker", 4, 9.0), "double"), draft=drafts,
        support=lambda claims, _: support(F.get(claims, F.lit(0))["text"]), framing=framing)
    passages = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("chunk_id"), F.col("item_id").cast("string").alias("doc_id"), F.lit("Passages").alias("title"), F.lit("Body").alias("section_path"),
        F.lit(0).alias("page_start"), F.lit(0).alias("page_end"), F.lit("").alias("source_url"), "text")
    out = answering.answer(_user_turns(spark, sf), answering.build_index(passages, providers), providers)
    return out.select(
        "qid", "answered", "refusal_reason", _joined("degraded").alias("degraded"), F.col("trace")["stages"].alias("stages"),
        F.col("trace")["short_circuited"].alias("short_circuited"), F.col("trace")["blend"].alias("blend"), F.col("trace")["passed"].alias("passed"))


# --- evaluation ---------------------------------------------------------------------------------


def _results(spark, sf) -> DataFrame:
    """Labelled documents as evaluation results, their outcome derived from their own columns."""
    docs = table(spark, sf, "documents", "doc_id", "source", "lang", "n_chars")
    bucket = (
        F.when(F.col("toxic") == 1, "emergency").when(F.col("lang") == "de", "personalized")
        .when(F.col("lang") == "es", "out_of_domain").when(F.col("quality") == 1, "answerable").otherwise("unanswerable")
    )
    answered = F.col("n_chars") % 5 < F.when(bucket == "answerable", 4).otherwise(1)
    reason = (
        F.when(F.col("n_chars") % 7 == 0, "low_confidence").when(bucket == "emergency", "emergency")
        .when(bucket == "personalized", "personalized_advice").when(bucket == "out_of_domain", "out_of_domain")
        .otherwise("model_declined")
    )
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), bucket.alias("bucket"), answered.alias("answered"),
        F.when(~answered, reason).alias("refusal_reason"), (F.col("n_chars") % 3).alias("n_citations"),
        F.when(F.col("n_chars") % 4 > 0, F.col("n_chars") % 4 > 1).alias("hit"),
        F.when(bucket == "unanswerable", F.col("n_chars") % 11 / 2).otherwise(F.col("n_chars") % 17 / 2 + 2).alias("score"),
    )


@query
def eval_judge(spark, sf):
    return evaluation.judge(_results(spark, sf)).select("id", "bucket", "correct", "detail")


@query
def eval_metrics(spark, sf):
    out = evaluation.metrics(evaluation.judge(_results(spark, sf)))
    return out.select("bucket", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query
def retrieval_hit(spark, sf):
    """Does a top hit hold the passage that was asked for? Cases assert a phrase, some a source."""
    cases = questions(spark, sf).select(
        F.col("qid").alias("id"),
        F.when(F.col("qid") % 4 == 0, F.concat(F.lit("SRC"), (F.col("qid") % 20).cast("string"))).alias("expect_source"),
        F.when(F.col("qid") % 4 > 0, F.col("text")).alias("expect_text"),
    )
    docs = table(spark, sf, "documents", "doc_id", "source", "text")
    hits = cut_lineage(_lexical(spark, sf, SETTINGS.rerank_top_n))
    cited = hits.join(docs.select("doc_id", "source"), "doc_id").select(
        F.col("qid").alias("id"), F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("section"),
    )
    return evaluation.retrieval_hits(cases, cited, docs.select(F.col("doc_id").alias("chunk_id"), "text"))


@query
def threshold_grid(spark, sf):
    grid = evaluation.sweep_grid(_results(spark, sf).select("bucket", "score"))
    return grid.withColumn("accuracy", F.round("accuracy", 6))


@query
def threshold_pick(spark, sf):
    return evaluation.pick_threshold(evaluation.sweep_grid(_results(spark, sf).select("bucket", "score")))


@query
def top_scores(spark, sf):
    first, _ = _pools(spark, sf)
    cases = questions(spark, sf).select(
        "qid", F.when(F.col("qid") % 3 == 0, "answerable").when(F.col("qid") % 3 == 1, "unanswerable").otherwise("emergency").alias("bucket")
    )
    return evaluation.top_scores(first, cases)


# --- accounts, history, quotas ------------------------------------------------------------------


def _users(spark, sf) -> DataFrame:
    """Customers as accounts created on a day of their own."""
    day = F.date_add(F.to_date(F.lit("2023-01-01")), (F.col("c_custkey") % 300).cast("int"))
    none = F.lit(None).cast("string")
    return table(spark, sf, "customer", "c_custkey", "c_name").select(
        F.col("c_custkey").alias("id"), F.lower("c_name").alias("email"), keys.iso_millis(day.cast("timestamp")).alias("created_at"),
        F.when(F.col("c_custkey") % 5 == 0, keys.iso_millis(day.cast("timestamp"))).otherwise(none).alias("verified_at"),
        none.alias("password_changed_at"),
    )


def _marks(spark, sf, kind) -> DataFrame:
    rows = table(spark, sf, "events", "user_id", "event_type", "ts")
    return rows.where(F.col("event_type") == kind).select("user_id", keys.iso_millis(F.col("ts")).alias("at"))


@query
def register_users(spark, sf):
    """Suppliers and customers signing up where half of the customers have accounts already."""
    address = F.concat(F.lit(" User"), F.col("n").cast("string"), F.lit("@Example.org "))
    signups = (
        table(spark, sf, "customer").select((F.col("c_custkey") % 700).alias("n"), F.col("c_custkey").cast("string").alias("id"))
        .unionByName(table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("n"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")))
        .select("id", address.alias("email"), F.format_string("2024-01-%02d", (F.col("n") % 28 + 1)).alias("created_at"))
    )
    users = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
        F.concat(F.lit("user"), F.col("n_nationkey").cast("string"), F.lit("@example.org")).alias("email"),
        F.lit("2023-01-01").alias("created_at"), F.lit(None).cast("string").alias("verified_at"),
        F.lit(None).cast("string").alias("password_changed_at"),
    )
    return accounts.register(users, signups).select("id", "email", "created_at")


@query
def first_verified(spark, sf):
    return accounts.first_verified(_users(spark, sf), _marks(spark, sf, "signup")).select("id", "email", "verified_at")


@query
def latest_password(spark, sf):
    return accounts.latest_password(_users(spark, sf), _marks(spark, sf, "error")).select("id", "password_changed_at")


@query
def session_valid(spark, sf):
    """Clicks as sessions issued at that moment, held against the latest password change."""
    users = accounts.latest_password(_users(spark, sf), _marks(spark, sf, "error"))
    sessions = table(spark, sf, "events", "event_id", "user_id", "event_type", "ts").where("event_type = 'click'").select(
        "event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("issued_at_ms")
    )
    return accounts.valid_sessions(sessions, users).select("event_id", "user_id", "issued_at_ms")


@query
def cascade_delete(spark, sf):
    """Customers in debt are removed with their orders; what is left is counted per customer."""
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    owned = table(spark, sf, "orders", "o_orderkey", "o_custkey").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("turn")
    )
    left, turns_left = accounts.delete_users(users, owned, users.where("c_acctbal < 0"))
    return left.join(
        turns_left.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n")), "id", "left"
    ).select("id", F.coalesce("n", F.lit(0)).alias("n_turns"))


@query
def history_prune(spark, sf):
    return accounts.prune(turns(spark, sf), 50)


@query
def history_page(spark, sf):
    """The second page of twenty for every user."""
    rows = turns(spark, sf)
    first = accounts.history_page(rows, 20)
    return accounts.history_page(rows, 20, accounts.next_cursors(first, 20))


@query
def history_delete(spark, sf):
    """Views of a user are deleted, and everything of users whose number ends in 7."""
    rows = turns(spark, sf)
    views = table(spark, sf, "events").where("event_type = 'view'").select(
        "user_id", F.format_string("%012d", "event_id").alias("id")
    )
    owners = rows.select("user_id").distinct().where(F.col("user_id") % 10 == 7)
    return accounts.clear_history(accounts.delete_turns(rows, views), owners).select("user_id", "id")


@query
def history_get(spark, sf):
    """Turns asked for by number, some under another user's name."""
    rows = turns(spark, sf)
    wanted = rows.select(
        (F.col("user_id") + F.when(F.col("id").cast("bigint") % 3 == 0, 1).otherwise(0)).alias("user_id"), "id"
    )
    return accounts.scoped(rows, wanted)


@query
def stored_citations(spark, sf):
    """Citation text read back; every other row cannot be read and gives none."""
    stored = F.when(
        F.col("event_id") % 2 == 0,
        F.format_string('[{"marker":"C1","chunk_id":"%d","rerank_score":%d}]', "event_id", F.col("user_id") % 11),
    ).otherwise(F.concat("props", F.lit("]")))
    found = accounts.read_citations(F.col("stored"))
    return table(spark, sf, "events", "event_id", "user_id", "props").withColumn("stored", stored).select(
        "event_id", F.size(found).cast("bigint").alias("n"), F.get(found, F.lit(0))["chunk_id"].alias("chunk_id"),
        F.get(found, F.lit(0))["rerank_score"].alias("rerank_score"),
    )


@query
def users_list(spark, sf):
    return accounts.users_by_age(_users(spark, sf)).select("id", "email", "created_at")


@query
def rate_limit(spark, sf):
    """Requests per user and day against a quota of two."""
    rows = table(spark, sf, "events", "event_id", "user_id", "ts")
    return quota.quota(rows, 2, 86400, "user_id", "ts", "event_id").select(
        "event_id", "user_id", "window", "allowed", F.col("remaining").cast("bigint").alias("remaining"), "retry_after_s"
    )


@query
def history_migrated(spark, sf):
    """Accounts written under three schema versions, read in the newest one, before and after they are migrated."""
    base = "id bigint, email string, created_at string"
    users = table(spark, sf, "events", "user_id", "ts").groupBy(F.col("user_id").alias("id")).agg(
        keys.iso_millis(F.min("ts")).alias("created_at"), keys.iso_millis(F.max("ts")).alias("_last")
    ).select(
        "id", F.format_string("u%d@example.org", "id").alias("email"), "created_at",
        F.when(F.col("id") % 2 == 0, F.col("_last")).alias("verified_at"),
        F.when(F.col("id") % 5 == 0, F.col("_last")).alias("password_changed_at"),
    )
    users, steps = cut_lineage(users), versions.account_steps()
    old, new = (f"{scratch_folder(spark).rstrip('/')}/accounts-{uuid.uuid4().hex}" for _ in range(2))
    for version in (1, 2, 3):
        versions.write_version(users.where(F.col("id") % 3 == version - 1), old, version, steps, ["id", "email", "created_at"])
    versions.migrate(spark, old, new, steps, base)
    both = [
        versions.read_migrated(spark, folder, steps, base).withColumn("stage", F.lit(stage))
        for folder, stage in ((old, "mixed"), (new, "migrated"))
    ]
    return both[0].union(both[1])


@query
def window_counts(spark, sf):
    return quota.window_counts(table(spark, sf, "events", "user_id", "ts"), 5, 3600, "user_id")


@query
def failure_runs(spark, sf):
    calls = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type").withColumn(
        "failed", F.col("event_type").isin("error", "view")
    )
    return quota.failure_runs(calls, "failed", "user_id", "ts", "event_id").select(
        "user_id", keys.iso_millis(F.col("run_start")).alias("run_start"),
        keys.iso_millis(F.col("run_end")).alias("run_end"), "failures", "trips",
    )


@query
def cache_entries(spark, sf):
    """Latest live entry per user, entries living five days before the newest event's end."""
    rows = table(spark, sf, "events", "event_id", "user_id", "ts").withColumn("stored_at", F.col("ts").cast("timestamp"))
    now = rows.agg(F.max("stored_at")).scalar()
    fresh = quota.fresh_entries(rows.select("user_id", "event_id", "stored_at"), now, 5 * 86400, "user_id")
    return fresh.select("user_id", "event_id")


# --- manifests ----------------------------------------------------------------------------------


def _manifest(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Labelled documents and all benchmark passages are listed; toxic ones with a stale digest."""
    docs = documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha256"))
    name = F.format_string("doc-%d.txt", "doc_id")
    listed = docs.join(table(spark, sf, "labels", "doc_id", "toxic"), "doc_id").select(
        name.alias("filename"), F.when(F.col("toxic") == 1, F.lit("stale")).otherwise(F.col("sha256")).alias("sha256")
    ).unionByName(
        table(spark, sf, "benchmark").select(
            F.format_string("item-%d.txt", "item_id").alias("filename"), F.sha2("text", 256).alias("sha256")
        )
    )
    return listed, docs.select(name.alias("filename"), "sha256")


@query
def manifest_diff(spark, sf):
    return manifest.diff(*_manifest(spark, sf))


@query
def manifest_summary(spark, sf):
    return manifest.diff_summary(manifest.diff(*_manifest(spark, sf)))


@query
def index_manifest(spark, sf):
    """Listed documents with whether they contributed chunks; a chunk here is a labelled document."""
    docs, chunks = table(spark, sf, "documents", "doc_id", "source"), table(spark, sf, "labels", "doc_id")
    both = manifest.indexed(docs, chunks).withColumn("state", F.lit("indexed")).unionByName(
        manifest.skipped(docs, chunks).withColumn("state", F.lit("skipped"))
    )
    return both.groupBy("source", "state").agg(F.count("*").alias("n"))


@query
def embeddings_missing(spark, sf):
    """Distinct texts not yet embedded, where the labelled documents' texts are."""
    docs = documents(spark, sf).withColumn("key", keys.embedding_key("m", 64, F.col("text")))
    known = docs.join(table(spark, sf, "labels", "doc_id"), "doc_id", "left_semi").select("key").distinct()
    return docs.groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(known, "key", "left_anti")


@query
def question_dedupe(spark, sf):
    """Turns that are one question but for case and spacing, under one response key."""
    talk = spread(table(spark, sf, "conversations"))
    key = keys.cache_key(F.lower(text.squeeze(F.col("text"))), F.lit("True"))
    return talk.groupBy(key.alias("response_key")).agg(F.count("*").alias("n"))


# --- streams ------------------------------------------------------------------------------------


def _event_stream(spark, sf) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return stream.option("maxBytesPerTrigger", 8 << 30).parquet(sf)


def _drained(spark, stream, key, mode="append") -> DataFrame:
    """Run a stream over what is there, through a table in the shared folder."""
    folder = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.write_batches(stream, f"{folder}/table", f"{folder}/state", mode).awaitTermination()
    return jobs.latest_rows(spark, f"{folder}/table", key)


@query
def stream_window_counts(spark, sf):
    counts = jobs.quota_counts(_event_stream(spark, sf), 3600, subject="user_id")
    return _drained(spark, counts, ["user_id", "window"], "update")


@query
def stream_first_requests(spark, sf):
    """Events of one user, type and hour are repeats of one request."""
    events = _event_stream(spark, sf).withColumn(
        "request", F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_trunc("hour", "ts").cast("string"))
    )
    kept = jobs.first_requests(events, "request", "40 days").select("request")
    return _drained(spark, kept, ["request"])


@query
def stream_breaker(spark, sf):
    """Events as calls of their user, those of a high value failing."""
    calls = _event_stream(spark, sf).withColumn("failed", F.col("value") > 20)
    return _drained(spark, jobs.breaker(calls, "user_id", "ts", "failed", "event_id"), ["user_id", "event_id"])


@query
def stream_pruned_turns(spark, sf):
    rows = _event_stream(spark, sf).select(
        "user_id", F.format_string("%012d", "event_id").alias("id"), keys.iso_millis(F.col("ts")).alias("created_at")
    )
    return _drained(spark, jobs.pruned_turns(rows, 50), ["user_id", "id"])
