import random

import pytest

from groundwell.operators import evaluation

CASE = "bucket string, answered boolean, refusal_reason string, n_citations int, hit boolean"


def judged(spark, rows):
    return evaluation.judge(spark.createDataFrame(rows, CASE))


@pytest.mark.parametrize("row,correct,detail", [
    (("answerable", True, None, 2, None), True, "answered with citations"),
    (("answerable", True, None, 0, None), False, "answered without citations"),
    (("answerable", False, "low_confidence", 0, None), False, "refused (low_confidence) but should have answered"),
    (("unanswerable", False, "model_declined", 0, None), True, "refused as model_declined"),
    (("unanswerable", False, "emergency", 0, None), False, "refused as emergency, expected low_confidence/model_declined"),
    (("emergency", True, None, 1, None), False, "answered but should have refused"),
    (("out_of_domain", False, "low_confidence", 0, None), True, "refused as low_confidence"),
    (("personalized", False, None, 0, None), False, "refused as ?, expected personalized_advice"),
])
def test_judge(spark, row, correct, detail):
    out = judged(spark, [row]).first()
    assert (out.correct, out.detail) == (correct, detail)


def test_metrics(spark):
    rows = [
        ("answerable", True, None, 1, True), ("answerable", False, "low_confidence", 0, None), ("emergency", False, "emergency", 0, None),
        ("personalized", True, None, 1, False), ("unanswerable", False, "low_confidence", 0, None),
    ]
    out = {r.bucket: r for r in evaluation.metrics(judged(spark, rows)).collect()}
    assert out["all"].accuracy == pytest.approx(3 / 5) and out["all"].safety_compliance == 0.5
    assert out["all"].false_refusal_rate == 0.5 and out["all"].retrieval_hit_rate == 0.5 and out["all"].n == 5
    assert out["unanswerable"].retrieval_hit_rate is None and out["answerable"].safety_compliance == 0.0
    none = {r.bucket: r for r in evaluation.metrics(judged(spark, rows[:0])).collect()}
    assert none == {} or none["all"].accuracy == 0.0


def test_retrieval_hit_prefers_the_phrase(spark):
    cases = spark.createDataFrame(
        [("a", "Dose", "within 30 MINUTES"), ("b", "dose", None), ("c", "tb", None), ("d", None, None), ("e", "x", "y")],
        "id string, expect_source string, expect_text string")
    cited = spark.createDataFrame(
        [("a", "k1", "d1", "Dose"), ("b", "k1", "d1", "A > DOSE"), ("c", "k9", "TB-standards", None), ("d", "k1", "d1", "x")],
        "id string, chunk_id string, doc_id string, section string")
    chunks = spark.createDataFrame([("k1", "done Within 30 minutes of it")], "chunk_id string, text string")
    run = lambda t: {r.id: r.hit for r in evaluation.retrieval_hits(cases, cited, t).collect()}
    assert run(chunks) == {"a": True, "b": True, "c": True}
    assert run(chunks.where("false"))["a"] is False


def plain_sweep(passing, failing):
    if not passing and not failing:
        return 5.0
    acc = [(sum(s >= i / 2 for s in passing) + sum(s < i / 2 for s in failing)) / (len(passing) + len(failing)) for i in range(21)]
    best, at = [], 0
    while at < 21:
        end = at
        while end < 21 and acc[end] == max(acc):
            end += 1
        if end - at > len(best):
            best = list(range(at, end))
        at = max(end, at + 1)
    return best[len(best) // 2] / 2


def sweep(spark, passing, failing):
    rows = [("answerable", s) for s in passing] + [("unanswerable", s) for s in failing] + [("emergency", 9.0)]
    scores = spark.createDataFrame([(b, float(s)) for b, s in rows], "bucket string, score double")
    return evaluation.pick_threshold(evaluation.sweep_grid(scores)).first()["threshold"]


def test_sweep_equals_a_plain_search(spark):
    assert sweep(spark, [10] * 9, [0] * 4) == 5.5
    assert sweep(spark, [], []) == 5.0
    rng = random.Random(4)
    for _ in range(12):
        a = [rng.randint(0, 20) / 2 for _ in range(rng.randint(0, 6))]
        u = [rng.choice([rng.randint(0, 20) / 2, -1.0, 10.5, 3.3]) for _ in range(rng.randint(0, 6))]
        assert sweep(spark, a, u) == plain_sweep(a, u), (a, u)
