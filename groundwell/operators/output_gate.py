"""Third gate: is the drafted answer traceable to what it cites?

Each check is a column over one answer row: `claims` (text, chunk_ids) and `passages` (chunk_id,
marker, text). Passages are the few kept by the second gate, so the arrays are small by
construction. Free proofs come before judgements, and the first failure decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.outcome import unwrap
from ..functions.text import numbers, overlap_share, prose_sentences, strip, strip_markers, words
from ..schemas import CLAIMS

# The shares and sizes that decide whether an answer can be salvaged.
MAX_UNSUPPORTED = 0.4
CARRIES = 0.6
MIN_PROSE_WORDS = 12

#: (claims, passages) -> array<boolean>, one verdict per claim; a missing verdict counts as no.
SupportJudge = Callable[[Column, Column], Column]
#: answer text -> array<string> of boundary violations.
FramingJudge = Callable[[Column], Column]

_NO_STRINGS = "array<string>"
#: The flag of an answer whose framing nobody judged.
UNJUDGED = "safety classifier unavailable"


def cited_ids(claims: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(claims, lambda c: c["chunk_ids"])))


def invalid_citations(claims: Column, passages: Column) -> Column:
    """Cited ids that name no retrieved passage, by id or by marker; sorted, distinct."""
    known = F.concat(
        F.transform(passages, lambda p: p["chunk_id"]),
        F.filter(F.transform(passages, lambda p: p["marker"]), lambda m: m != ""),
    )
    return F.array_sort(F.array_except(cited_ids(claims), known))


def cited_text(claims: Column, passages: Column) -> Column:
    """Text of every cited passage, in passage order."""
    return let(
        cited_ids(claims),
        lambda ids: F.array_join(
            F.transform(
                F.filter(
                    passages,
                    lambda p: F.array_contains(ids, p["chunk_id"])
                    | ((p["marker"] != "") & F.array_contains(ids, p["marker"])),
                ),
                lambda p: p["text"],
            ),
            "\n",
        ),
    )


def unsupported_numbers(answer: Column, cited: Column, query: Column) -> Column:
    """Numbers in the answer found neither in the cited text nor in the question; sorted as text."""
    allowed = F.array_union(numbers(cited), numbers(query))
    return F.array_sort(F.array_except(numbers(strip_markers(answer)), allowed))


def overlap_support(claims: Column, passages: Column) -> Column:
    """Offline stand-in for the support judge: a cited passage holds most of the claim's words."""
    def supported(claim):
        cited = F.filter(
            passages,
            lambda p: F.array_contains(claim["chunk_ids"], p["chunk_id"])
            | ((p["marker"] != "") & F.array_contains(claim["chunk_ids"], p["marker"])),
        )
        return let(
            words(claim["text"]),
            lambda cw: F.exists(cited, lambda p: overlap_share(cw, words(p["text"])) >= CARRIES),
        )

    return F.transform(claims, supported)


# The stand-in's own phrases; a plugged-in judge replaces them.
FRAMING_PHRASES = (
    ("personalized_advice", r"(?i)\byou should\b|\byour (dose|symptoms?|child|doctor)\b"),
    ("diagnostic", r"(?i)\byou (have|are suffering from)\b"),
    ("imperative_dosing", r"(?im)(^|[.!?]\s+)(take|inject|swallow|apply)\b"),
    ("emergency_instruction", r"(?i)\b(call|dial) (112|108|an ambulance)\b|\bgo to (the )?hospital\b"),
)


def phrase_framing(answer: Column) -> Column:
    """Offline stand-in for the framing judge: phrases that address the reader as a patient."""
    flags = [F.when(answer.rlike(p), F.lit(name)) for name, p in FRAMING_PHRASES]
    return F.filter(F.array(*flags), lambda f: f.isNotNull())


def _carried(claim_words: Column, sentence_words: Column) -> Column:
    return F.exists(sentence_words, lambda sw: overlap_share(claim_words, sw) >= CARRIES)


def repair(answer: Column, claims: Column, unsupported: Column) -> Column:
    """struct(answer, claims) without what could not be verified, or NULL where too little is left.

    Dropped are the unsupported claims, the sentences carrying one of them, and the claims found
    only in dropped sentences.
    """
    remaining = F.filter(claims, lambda c: ~F.array_contains(unsupported, c["text"]))
    split = F.transform(prose_sentences(answer), lambda s: F.struct(s.alias("s"), words(s).alias("w")))

    def judge(bad):
        marked = F.transform(
            F.filter(split, lambda x: F.size(x["w"]) > 0),
            lambda x: F.struct(
                x["s"].alias("s"), x["w"].alias("w"),
                F.exists(bad, lambda b: overlap_share(b, x["w"]) >= CARRIES).alias("drop"),
            ),
        )
        return let(marked, assemble)

    def assemble(marked):
        kept = F.filter(marked, lambda x: ~x["drop"])
        dropped_words = F.transform(F.filter(marked, lambda x: x["drop"]), lambda x: x["w"])
        kept_words = F.transform(kept, lambda x: x["w"])
        prose = strip(F.array_join(F.transform(kept, lambda x: x["s"]), " "))
        traceable = F.filter(
            remaining,
            lambda c: let(
                words(c["text"]),
                lambda cw: _carried(cw, kept_words) | ~_carried(cw, dropped_words),
            ),
        )
        return let(
            F.struct(prose.alias("answer"), traceable.alias("claims")),
            lambda r: F.when(
                (F.size(remaining) > 0) & (r["answer"] != "") & (F.size(words(r["answer"])) >= MIN_PROSE_WORDS)
                & (F.size(r["claims"]) > 0),
                r,
            ),
        )

    return let(F.transform(unsupported, words), judge)


def validate(
    answers: DataFrame,
    support: SupportJudge = overlap_support,
    framing: FramingJudge = phrase_framing,
) -> DataFrame:
    """Adds the verdict to rows of (answer, claims, insufficient_context, passages, query).

    New columns: passed, reason, detail, invalid_citations, unsupported_numbers,
    unsupported_claims, safety_flags, final_answer, final_claims, support_error, framing_error: why a judge gave
    nothing, if its call failed. A judge that gives nothing counts against the answer.
    """
    none = F.array().cast(_NO_STRINGS)
    declined = F.coalesce("insufficient_context", F.lit(False)) | (strip(F.coalesce("answer", F.lit(""))) == "")
    step = answers.withColumn("_declined", declined).withColumn(
        "claims", F.coalesce("claims", F.array().cast(CLAIMS))
    )
    live = ~F.col("_declined") & (F.size("claims") > 0)
    step = step.withColumn(
        "invalid_citations", F.when(live, invalid_citations(F.col("claims"), F.col("passages"))).otherwise(none)
    )
    live = live & (F.size("invalid_citations") == 0)
    step = step.withColumn(
        "unsupported_numbers",
        F.when(
            live, unsupported_numbers(F.col("answer"), cited_text(F.col("claims"), F.col("passages")), F.col("query"))
        ).otherwise(none),
    )
    live = live & (F.size("unsupported_numbers") == 0)
    step = unwrap(step.withColumn("_support", support(F.when(live, F.col("claims")), F.col("passages"))), "_support", "support_error")
    judged = F.zip_with(
        F.col("claims"), F.coalesce("_support", F.array().cast("array<boolean>")),
        lambda c, ok: F.struct(c["text"].alias("text"), F.coalesce(ok, F.lit(False)).alias("ok")),
    )
    step = step.withColumn(
        "unsupported_claims",
        F.when(live, F.transform(F.filter(judged, lambda j: ~j["ok"]), lambda j: j["text"])).otherwise(none),
    )
    n_bad, n_claims = F.size("unsupported_claims"), F.size("claims")
    step = step.withColumn(
        "_repaired",
        F.when(
            live & (n_bad > 0) & (n_bad / F.greatest(n_claims, F.lit(1)) <= MAX_UNSUPPORTED),
            repair(F.col("answer"), F.col("claims"), F.col("unsupported_claims")),
        ),
    )
    grounded = live & ((n_bad == 0) | F.col("_repaired").isNotNull())
    step = step.withColumn("final_answer", F.coalesce("_repaired.answer", "answer")).withColumn(
        "final_claims", F.coalesce("_repaired.claims", "claims")
    )
    step = unwrap(step.withColumn("_framing", framing(F.when(grounded, F.col("final_answer")))), "_framing", "framing_error")
    step = step.withColumn("safety_flags", F.when(grounded, F.coalesce("_framing", F.array(F.lit(UNJUDGED)))).otherwise(none))

    def listed(name):
        return F.array_join(name, ", ")

    cases = [
        (F.col("_declined"), "model_declined", F.lit("model reported insufficient context")),
        (n_claims == 0, "ungrounded_output", F.lit("answer carried no claims to verify")),
        (
            F.size("invalid_citations") > 0, "ungrounded_output",
            F.concat(F.lit("cited passages that were not retrieved: "), listed("invalid_citations")),
        ),
        (
            F.size("unsupported_numbers") > 0, "unsafe_output",
            F.concat(F.lit("answer contains numbers absent from cited passages: "), listed("unsupported_numbers")),
        ),
        (
            (n_bad > 0) & F.col("_repaired").isNull(), "ungrounded_output",
            F.format_string("%d/%d claim(s) unsupported; answer could not be salvaged", n_bad, n_claims),
        ),
        (
            F.size("safety_flags") > 0, "unsafe_output",
            F.concat(F.lit("framing violations: "), listed("safety_flags")),
        ),
    ]
    reason = detail = F
    for test, name, text in cases:
        reason, detail = reason.when(test, F.lit(name)), detail.when(test, text)
    detail = detail.when(
        n_bad > 0, F.format_string("passed after stripping %d unsupported claim(s)", n_bad)
    ).otherwise(F.lit("all output checks passed"))
    return (
        step.withColumn("reason", reason)
        .withColumn("detail", detail)
        .withColumn("passed", F.col("reason").isNull())
        .drop("_declined", "_repaired", "_support", "_framing")
    )
