"""First gate: refuse personal and urgent questions before anything is retrieved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules, in the order they are tried. Emergencies come first.
FIRST_PERSON = r"(?:\bi\b|\bmy\b|\bme\b|\bmine\b|i'm|i've|im\b)"
EMERGENCY_RULES = (
    (FIRST_PERSON + r"[^.?!]{0,40}\b(chest pain|can'?t breathe|cannot breathe|"
     r"trouble breathing|unconscious|passed out|severe bleeding|bleeding heavily|"
     r"overdosed?|poisoned)\b", "first-person acute symptom"),
    (r"\b(kill myself|suicidal|suicide|end my life|harm myself|self[- ]harm)\b", "self-harm"),
    (r"\b(emergency|urgent|right now|immediately)\b[^.?!]{0,30}\b(help|what do i do|"
     r"what should i do)\b", "explicit urgency"),
    (r"\b(is|are)\s+(this|these|it|my)\b[^.?!]{0,30}\b(life[- ]threatening|"
     r"an emergency|dangerous)\b", "asks if own situation is an emergency"),
)
ADVICE_RULES = (
    (r"\bshould i\b", "asks what the user should do"),
    (r"\bcan i (take|use|stop|start|have)\b", "asks permission for own action"),
    (r"\b(do|does) (i|my \w+) have\b", "asks for a diagnosis"),
    (r"\bwhat('?s| is) wrong with me\b", "asks for a diagnosis"),
    (r"\bdiagnos(e|is) me\b", "asks for a diagnosis"),
    (r"\bhow (much|many)\b[^.?!]{0,30}\b(should|do)\s+" + FIRST_PERSON, "asks own dose"),
    (FIRST_PERSON + r"\s+(have|had|has|feel|felt|am feeling|experience)\b[^.?!]{0,40}"
     r"\b(symptom|pain|fever|rash|cough|lump|bleeding)\b", "describes own symptoms"),
    (r"\bis it safe for me\b", "asks personal safety"),
    (r"\bwhat should i (take|do|use)\b", "asks what the user should do"),
    (r"\bmy (test|blood|lab|scan|report|result)s?\b", "asks to interpret own results"),
)
RULE_LABEL_LENGTH = 60


def rule_screen(query: Column) -> Column:
    """struct(intent, reason, rule) of the first matching rule, NULL where none matches.

    Rules only refuse. A question no rule catches is undecided, never cleared.
    """
    verdict = None
    for intent, rules in (("emergency", EMERGENCY_RULES), ("personalized_advice", ADVICE_RULES)):
        for pattern, why in rules:
            outcome = F.struct(
                F.lit(intent).alias("intent"), F.lit(why).alias("reason"),
                F.lit(pattern[:RULE_LABEL_LENGTH]).alias("rule"),
            )
            hit = query.rlike("(?i)" + pattern)
            verdict = F.when(hit, outcome) if verdict is None else verdict.when(hit, outcome)
    return verdict


def classify(query: Column, model: Column | None = None, screen: bool = True) -> Column:
    """struct(intent, reason, rule): rules, then the model's label, then closed.

    `model` holds struct(intent, reason) or NULL where the model gave nothing; such a question is
    refused. With `screen` off, or no model plugged in at all, rules alone decide.
    """
    none = F.lit(None).cast("string").alias("rule")
    if model is None or not screen:
        rest = F.struct(
            F.lit("in_scope").alias("intent"), F.lit("rules only; not screened by model").alias("reason"), none
        )
    else:
        closed = F.struct(
            F.lit("out_of_domain").alias("intent"),
            F.lit("intent classifier unavailable; refusing rather than assuming safe").alias("reason"),
            F.lit("fail-closed").alias("rule"),
        )
        rest = F.when(
            model["intent"].isNotNull(), F.struct(model["intent"].alias("intent"), model["reason"].alias("reason"), none)
        ).otherwise(closed)
    return F.coalesce(rule_screen(query), rest)
