import pytest
from pyspark.sql import functions as F

from groundwell.config import Settings
from groundwell.operators import confidence, corrective, output_gate, wording
from groundwell.operators.intent import classify, rule_screen
from groundwell.operators.rerank import rerank
from groundwell.operators.rewrite import GLOSSARY, rewrite
from groundwell.schemas import CLAIMS, PASSAGES


@pytest.mark.parametrize("query,intent", [
    ("I have chest pain right now", "emergency"), ("my brother can't breathe", "emergency"),
    ("I want to kill myself", "emergency"), ("urgent! help", None), ("this is urgent please help", "emergency"),
    ("is this life-threatening", "emergency"), ("Should I take aspirin?", "personalized_advice"),
    ("can i stop metformin", "personalized_advice"), ("do I have malaria", "personalized_advice"),
    ("does my son have it", "personalized_advice"), ("what's wrong with me", "personalized_advice"),
    ("diagnose me", "personalized_advice"), ("how much paracetamol should I have", "personalized_advice"),
    ("I had a rash", "personalized_advice"), ("is it safe for me", "personalized_advice"),
    ("what should i do", "personalized_advice"), ("my reports", "personalized_advice"),
    ("chest pain management", None), ("what is the dose of quinine for a child", None), ("", None),
])
def test_rules_need_a_personal_framing(one, query, intent):
    verdict = one(rule_screen, query)
    assert (verdict["intent"] if verdict else None) == intent


def test_emergency_wins_over_advice_and_model_fails_closed(spark, one):
    assert one(rule_screen, "should i go, I have chest pain")["intent"] == "emergency"
    label = lambda x: F.struct(F.lit(x).cast("string").alias("intent"), F.lit("m").alias("reason"))
    ask = lambda q, m, screen=True: one(lambda c: classify(c, m, screen), q)["intent"]
    assert ask("what is tb", label("in_scope")) == "in_scope"
    assert ask("should i", label("in_scope")) == "personalized_advice"
    assert ask("what is tb", label(None)) == "out_of_domain"
    assert ask("what is tb", label(None), screen=False) == "in_scope"
    assert ask("what is tb", None) == "in_scope"


def test_rewriting_adds_and_never_replaces(one):
    out = one(rewrite, "  TB in\n PHC,   tb and MI ")
    assert out["rewritten"] == "TB in PHC, tb and MI tuberculosis primary health centre"
    assert out["applied"] == ["TB -> tuberculosis", "PHC -> primary health centre"]
    assert one(rewrite, "HTN means hypertension")["applied"] == []
    assert one(rewrite, "mdr-TB")["rewritten"] == "mdr-TB multidrug resistant tuberculosis"
    assert one(rewrite, "plain words")["rewritten"] == "plain words"
    assert len(GLOSSARY) == 37


def pool(spark, *scores, qid="q"):
    rows = [(qid, f"d{i}", i + 1, i + 1, s) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "qid string, doc_id string, rank int, place int, rerank_score double")


@pytest.mark.parametrize("scores,action", [
    ([9.0, 3.0], "proceed"), ([7.5], "proceed"), ([7.49], "correct"), ([6.0, None], "correct"), ([5.99], "refuse"),
    ([None, None], "refuse"),
])
def test_band_edges(spark, scores, action):
    assert confidence.verdicts(pool(spark, *scores)).first()["action"] == action


def test_second_look_and_switched_off_correction_are_binary(spark):
    p = pool(spark, 7.0)
    assert confidence.verdicts(p, allow_correction=False).first()["action"] == "refuse"
    assert confidence.verdicts(p, settings=Settings(corrective_enabled=False)).first()["action"] == "refuse"


def test_questions_without_results_and_kept_order(spark):
    asked = spark.createDataFrame([("q",), ("none",)], "qid string")
    p = pool(spark, 8.0, 7.4, None, 9.0, 8.0, 8.0, 8.0, 8.0, 8.0)
    out = {r.qid: (r.action, r.reason) for r in confidence.verdicts(p, asked).collect()}
    assert out["none"] == ("refuse", "retrieval returned nothing") and out["q"] == ("proceed", "top passage scored 9.0")
    kept = confidence.kept_passages(p).orderBy("place").collect()
    assert [(r.doc_id, r.marker) for r in kept] == [("d0", "C1"), ("d3", "C2"), ("d4", "C3"), ("d5", "C4"), ("d6", "C5"), ("d7", "C6")]


def candidates(spark, rows):
    return spark.createDataFrame(rows, "qid string, doc_id string, rank int, question string, text string")


def test_rerank_orders_scored_first_then_by_fused_rank(spark):
    table = candidates(spark, [("q", "a", 1, "one two", "two"), ("q", "b", 2, "one two", "one two"), ("q", "c", 3, "one two", "one"), ("q", "d", 4, "", "x")])
    out = [(r.doc_id, r.rerank_score) for r in rerank(table).orderBy("place").collect()]
    assert out == [("b", 10.0), ("a", 5.0), ("c", 5.0), ("d", 0.0)]
    gone = rerank(table, lambda q, p: F.when(p == "two", F.lit(3.0)))
    assert [r.doc_id for r in gone.orderBy("place").collect()] == ["a", "b", "c", "d"]


def test_retry_keeps_first_scores_and_scores_only_what_is_new(spark):
    first = rerank(candidates(spark, [("q", "a", 1, "x y", "x"), ("q", "b", 2, "x y", "z")]), lambda q, p: F.lit(4.0))
    wide = candidates(spark, [("q", "b", 1, "x y", "x y"), ("q", "c", 2, "x y", "x y"), ("q", "d", 3, "x y", "x")])
    merged = corrective.merge_retry(first, wide)
    out = [(r.doc_id, r.rerank_score, r.is_new) for r in merged.orderBy("place").collect()]
    assert out == [("c", 10.0, True), ("d", 5.0, True), ("a", 4.0, False), ("b", 4.0, False)]
    report = corrective.retry_report(first, merged).first()
    assert (report.new_candidates, report.pool, report.top_before, report.top_after, report.improved) == (2, 4, 4.0, 10.0, True)


def answers(spark, answer, claims, passages, query="", declined=False):
    return spark.createDataFrame([(answer, claims, passages, query, declined)],
        f"answer string, claims {CLAIMS}, passages {PASSAGES}, query string, insufficient_context boolean")


P1 = ("d::0000::00", "C1", "Quinine is infused at 10,000 units over 4 hours in adults with severe malaria under observation.")
P2 = ("d::0001::00", "C2", "Referral is advised when 2.5 ml is not tolerated.")
GOOD = "Quinine is infused at 10000 units over 4 hours in adults with severe malaria under observation [C1]."


def check(spark, answer, claims, passages=(P1, P2), **more):
    return output_gate.validate(answers(spark, answer, claims, list(passages), **more)).first()


def test_passes_by_marker_or_id_and_reads_grouped_numbers(spark):
    for cited in ("C1", "d::0000::00"):
        row = check(spark, GOOD, [(GOOD[:-6], [cited])])
        assert row.passed and row.detail == "all output checks passed" and row.final_answer == GOOD


@pytest.mark.parametrize("answer,claims,more,reason,part", [
    (GOOD, [(GOOD, ["C1"])], {"declined": True}, "model_declined", "insufficient"),
    ("  ", [(GOOD, ["C1"])], {}, "model_declined", "insufficient"),
    (GOOD, [], {}, "ungrounded_output", "no claims"),
    (GOOD, [(GOOD, ["C1", "C9", "zz", "C9"])], {}, "ungrounded_output", "C9, zz"),
    ("Give 25 mg [C1].", [("Give 25 mg", ["C1"])], {}, "unsafe_output", "25"),
    ("The limit is 2.5 ml [C1].", [("limit", ["C1"])], {}, "unsafe_output", "2.5"),
    (GOOD, [("wholly other words stand here", ["C1"])], {}, "ungrounded_output", "1/1 claim(s)"),
    ("You should take it. " + GOOD, [(GOOD[:-6], ["C1"])], {}, "unsafe_output", "personalized_advice"),
])
def test_first_failure_decides(spark, answer, claims, more, reason, part):
    row = check(spark, answer, claims, **more)
    assert not row.passed and row.reason == reason and part in row.detail


def test_numbers_of_the_question_and_markers_are_allowed(spark):
    row = check(spark, "1. In 2019 the rule stood [C2].\n2. " + GOOD, [(GOOD[:-6], ["C1"])], query="since 2019?")
    assert row.unsupported_numbers == []


def fix(spark, answer, claims, bad):
    rows = answers(spark, answer, [(c, ["C1"]) for c in claims], [])
    return rows.select(output_gate.repair(F.col("answer"), F.col("claims"), F.array(*map(F.lit, bad))).alias("r")).first()["r"]


LONG = "Alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike."
BAD = "Zulu yankee xray whiskey."


def test_repair_drops_the_claim_its_sentence_and_claims_that_went_with_it(spark):
    out = fix(spark, f"{LONG} {BAD}", ["Alpha bravo charlie", "zulu yankee xray whiskey", "whiskey xray"], ["zulu yankee xray whiskey"])
    assert out["answer"] == LONG and [c["text"] for c in out["claims"]] == ["Alpha bravo charlie"]


def test_repair_keeps_what_it_cannot_place_and_gives_up_on_too_little(spark):
    out = fix(spark, f"{LONG} {BAD}", ["november oscar papa", "zulu yankee xray whiskey"], ["zulu yankee xray whiskey"])
    assert [c["text"] for c in out["claims"]] == ["november oscar papa"]
    assert fix(spark, f"Too short. {BAD}", ["too short", "zulu yankee xray whiskey"], ["zulu yankee xray whiskey"]) is None
    assert fix(spark, LONG, ["alpha"], ["alpha"]) is None
    eleven = " ".join(LONG.split()[:11]) + "."
    assert fix(spark, f"{eleven} {BAD}", ["alpha", "zulu yankee xray whiskey"], ["zulu yankee xray whiskey"]) is None


def test_minor_unsupported_share_is_stripped_and_majority_refused(spark):
    text = P1[2] + " Wholly different words arrive."
    claims = [("Quinine is infused", ["C1"]), ("severe malaria under observation", ["C1"]), ("wholly different words arrive", ["C1"])]
    row = check(spark, text, claims)
    assert row.passed and "stripping 1" in row.detail and row.final_answer == P1[2] and len(row.final_claims) == 2
    assert check(spark, text, claims[1:]).reason == "ungrounded_output"


def test_labels_and_messages(spark, one):
    row = spark.createDataFrame([(0, 0), (3, 3), (3, 5)], "a int, b int")
    out = [(r.l, r.c) for r in row.select(
        wording.page_label(F.col("a"), F.col("b")).alias("l"),
        wording.cite_label(F.lit("C1"), F.lit("d"), F.lit("T"), F.lit("S"), F.col("a"), F.col("b")).alias("c")).collect()]
    assert out == [("n/a", "[C1 | d | T | §S | page n/a]"), ("3", "[C1 | d | T | §S | p.3]"), ("3-5", "[C1 | d | T | §S | pp.3-5]")]
    assert "112" in one(wording.refusal_text, "emergency") and one(wording.refusal_text, "other") is None
    assert len(wording.REFUSALS) == 7
