import pytest
from pyspark.sql import functions as F

from groundwell.config import Settings
from groundwell.plans import answer as answering

TEXTS = {
    "m1": "Malaria is confirmed by microscopy of a blood film. Quinine must not exceed 5 mg per hour in adults with severe malaria disease.",
    "m2": "Referral of severe malaria follows shock or bleeding. A unit with intensive care should receive such cases early.",
    "s1": "Snake bite victims are kept still. Antivenom is given for bleeding or paralysis after snake bite in any age group.",
    "d1": "Oral rehydration solution is the mainstay for acute diarrhoea in children of all ages at home.",
}


@pytest.fixture(scope="module")
def index(spark):
    rows = [(k, k[0], "Guide", "Body", 0, 0, "", t) for k, t in TEXTS.items()]
    passages = spark.createDataFrame(rows,
        "chunk_id string, doc_id string, title string, section_path string, page_start int, page_end int, source_url string, text string")
    return answering.build_index(passages)


def ask(spark, index, *queries, **more):
    rows = spark.createDataFrame(list(enumerate(queries)), "qid int, query string")
    return {r.qid: r for r in answering.answer(rows, index, **more).collect()}


def test_the_index_is_embedded_and_tokenised_once(spark, index):
    found = index.vectors.where(F.col("vector").isNotNull())._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in found and "regexp_extract_all" not in index.corpus.tokens._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.doc_id: r.tokens for r in index.corpus.tokens.collect()}
    assert rows["d1"][:4] == ["guide", "body", "oral", "rehydration"] and index.vectors.count() == len(TEXTS) == index.corpus.n_docs


def test_every_exit_gives_a_response(spark, index):
    out = ask(
        spark, index,
        "Quinine must not exceed 5 mg per hour in adults with severe malaria",
        "should I take quinine", "I have chest pain", "bipolar disorder maintenance therapy",
        "  QUININE must not exceed 5 mg per hour\nin adults with severe MALARIA ",
    )
    assert len(out) == 5
    good = out[0]
    assert good.answered and good.refusal_reason is None and good.citations[0].chunk_id == "m1"
    assert good.citations[0].marker == "C1" and "[C1]" in good.answer and good.trace["action"] == "proceed"
    assert out[1].refusal_reason == "personalized_advice" and out[1].citations == [] and "action" not in out[1].trace
    assert out[2].refusal_reason == "emergency" and "112" in out[2].answer
    assert out[3].refusal_reason == "low_confidence" and not out[3].answered
    # The same question in other case and spacing shares the answer, under the asker's own wording.
    assert out[4].answer == good.answer and out[4].query.startswith("  QUININE")


def test_middle_band_retries_once_and_the_bar_stays(spark, index):
    question = "Quinine per hour zebras giraffes unknown origin alpha beta"
    out = ask(spark, index, question, settings=Settings(corrective_threshold=2.0))
    assert out[0].refusal_reason == "low_confidence" and out[0].trace["action"] == "correct"
    assert "after_correction" in out[0].trace


def test_retry_finds_what_the_first_pass_was_too_shallow_for(spark, index):
    settings = Settings(retrieve_k=1, corrective_k=4, corrective_threshold=0.0)
    only_m1 = lambda q, p: F.when(F.contains(p, F.lit("microscopy")), F.lit(9.0)).otherwise(F.lit(2.0))
    providers = answering.Providers(scorer=only_m1)
    out = ask(spark, index, "snake bite antivenom paralysis", settings=settings, providers=providers)
    assert out[0].trace["action"] == "correct" and out[0].top_score == 9.0
    assert [c.chunk_id for c in out[0].citations] == ["m1"]


def test_a_hypothetical_passage_moves_the_dense_half_only(spark, index):
    def hypothetical(rows):
        return rows.select("qid", F.lit(TEXTS["d1"]).alias("passage"))

    from groundwell.plans.answer import Providers, retrieve

    asked = spark.createDataFrame([("q", "zzz", "zzz")], "qid string, question string, rewritten string")
    plain, _, _ = retrieve(asked, index, Providers(), Settings())
    moved, wide, _ = retrieve(asked, index, Providers(hypothetical=hypothetical), Settings())
    first = lambda df: df.orderBy("rank").first()
    assert first(plain).chunk_id != "d1"
    assert first(moved).chunk_id == "d1" and first(wide).chunk_id == "d1" and first(wide).distance < first(moved).distance
    assert first(moved).score is None


def test_unscored_pool_refuses_and_is_marked_degraded(spark, index):
    providers = answering.Providers(scorer=lambda q, p: F.lit(None).cast("double"))
    out = ask(spark, index, "quinine per hour", providers=providers)
    assert out[0].refusal_reason == "low_confidence" and out[0].degraded == ["reranker"]


def test_model_label_refuses_and_missing_label_fails_closed(spark, index):
    labels = lambda q: F.struct(F.when(F.contains(q, F.lit("cricket")), "out_of_domain").alias("intent"), F.lit("m").alias("reason"))
    out = ask(spark, index, "who won the cricket", "quinine per hour", providers=answering.Providers(intent=labels))
    assert out[0].refusal_reason == "out_of_domain" and out[0].degraded == []
    assert out[1].refusal_reason == "out_of_domain" and out[1].degraded == ["intent_classifier"]


def test_vectors_without_a_local_passage_are_reported(spark, index):
    from groundwell.plans.answer import Index, Providers, retrieve

    stray = index.vectors.where("chunk_id = 'm1'").withColumn("chunk_id", F.lit("ghost"))
    drifted = Index(index.passages, index.corpus, index.vectors.unionByName(stray))
    asked = spark.createDataFrame([("q", "malaria microscopy", "malaria microscopy")], "qid string, question string, rewritten string")
    first, _, lost = retrieve(asked, drifted, Providers(), Settings())
    assert [r.chunk_id for r in lost.collect()] == ["ghost"] and "ghost" not in {r.chunk_id for r in first.collect()}
    # Stored records that carry the passage itself stay citable, and are still reported.
    full = drifted.vectors.join(index.passages.drop("chunk_id").where("doc_id = 'm'").limit(1))
    first, _, lost = retrieve(asked, Index(index.passages, index.corpus, full), Providers(), Settings())
    assert [r.chunk_id for r in lost.collect()] == ["ghost"] and "ghost" in {r.chunk_id for r in first.collect()}
