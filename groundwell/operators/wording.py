"""Fixed texts and labels shown to people, and passage rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The messages of each refusal.
DISCLAIMER = (
    "This assistant provides information from official government health "
    "guidelines only and does not give personalized medical advice. "
    "Consult a qualified clinician for anything concerning your own health."
)
NOT_ENOUGH = "I don't have enough information in the guidelines to answer this."
REFUSALS = {
    "emergency": (
        "This sounds like it may be a medical emergency. I can't help with urgent "
        "or personal medical situations.\n\n"
        "**Please contact emergency services now — dial 112 (national emergency) "
        "or 108 (ambulance) in India, or go to the nearest emergency department.**\n\n"
        "For mental health crisis support in India, Tele-MANAS is available "
        "24x7 at 14416."
    ),
    "personalized_advice": (
        "I can't give personalized medical advice, diagnose a condition, or "
        "recommend a treatment or dose for a specific person — that requires a "
        "qualified clinician who can examine you.\n\n"
        "I can tell you what the official guidelines say on a topic in general "
        "terms. Try asking something like \"what do the guidelines say about "
        "how tuberculosis is diagnosed?\" instead."
    ),
    "out_of_domain": (
        "I only answer questions about the official government health "
        "guidelines in my knowledge base. That question falls outside them."
    ),
    "low_confidence": NOT_ENOUGH,
    "model_declined": NOT_ENOUGH,
    "ungrounded_output": NOT_ENOUGH,
    "unsafe_output": (
        "I can't answer that in a way that stays within my boundaries — the "
        "response would have read as personalized medical advice rather than a "
        "summary of what the guidelines say."
    ),
}


def refusal_text(reason: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in REFUSALS.items() for x in pair])
    return F.try_element_at(table, reason)


def page_label(start: Column, end: Column) -> Column:
    """Pages of a citation; 0 means the source shows no pages."""
    return (
        F.when(F.coalesce(start, F.lit(0)) == 0, "n/a")
        .when(start == end, start.cast("string"))
        .otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))
    )


def cite_label(marker: Column, doc_id: Column, title: Column, path: Column, start: Column, end: Column) -> Column:
    pages = (
        F.when(F.coalesce(start, F.lit(0)) == 0, "page n/a")
        .when(start == end, F.concat(F.lit("p."), start.cast("string")))
        .otherwise(F.concat(F.lit("pp."), start.cast("string"), F.lit("-"), end.cast("string")))
    )
    return F.concat(
        F.lit("["), F.concat_ws(" | ", marker, doc_id, title, F.concat(F.lit("§"), path), pages), F.lit("]")
    )


def render_context(kept: DataFrame) -> DataFrame:
    """qid, context: the kept passages of a question under their labels, in marker order.

    At most a handful of rows per question reach this, so the list stays small.
    """
    block = F.concat(
        cite_label(
            F.col("marker"), F.col("doc_id").cast("string"), F.col("title"), F.col("section_path"),
            F.col("page_start"), F.col("page_end"),
        ),
        F.lit("\n"), F.col("text"),
    )
    number = F.substr(F.col("marker"), F.lit(2)).cast("int")
    return (
        kept.groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct(number.alias("n"), block.alias("b")))).alias("_blocks"))
        .select("qid", F.array_join(F.transform("_blocks", lambda x: x["b"]), "\n\n").alias("context"))
    )


def user_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Passages:\n\n"), context, F.lit("\n\nQuestion: "), question)
