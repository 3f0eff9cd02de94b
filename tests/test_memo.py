"""What jobs remember between runs, and what a failed stage leaves behind."""

import pytest
from pyspark.sql import functions as F

from groundwell.config import Settings
from groundwell.functions.outcome import guarded
from groundwell.plans import answer as answering
from groundwell.plans import index as indexing
from groundwell.sources.embeddings import hashing_embedder
from groundwell.sources.memo import ExpiringTable, Memory

TEXTS = {
    "m1": "Malaria is confirmed by microscopy of a blood film. Quinine must not exceed 5 mg per hour in adults with severe malaria disease.",
    "s1": "Snake bite victims are kept still. Antivenom is given for bleeding or paralysis after snake bite in any age group.",
    "d1": "Oral rehydration solution is the mainstay for acute diarrhoea in children of all ages at home.",
}
SOLID = "Quinine must not exceed 5 mg per hour in adults with severe malaria"
COLUMNS = "chunk_id string, doc_id string, title string, section_path string, page_start int, page_end int, source_url string, text string"


def passages(spark):
    return spark.createDataFrame([(k, k[0], "Guide", "Body", 0, 0, "", t) for k, t in TEXTS.items()], COLUMNS)


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid int, query string")


def counted(path, answer, kind="string"):
    """A provider that leaves one line per row it is asked about."""
    def call(rows):
        with open(path, "a") as log:
            log.writelines("call\n" for _ in rows)
        return [answer(*row) for row in rows]

    return guarded(call, kind)


def calls(path):
    return path.read_text().count("call") if path.exists() else 0


def embedder(path):
    inner = hashing_embedder()
    mark = counted(path, lambda text: text)
    return lambda text: inner(mark(text)["value"])


def test_rows_expire_and_the_newest_counts(spark, tmp_path):
    table = ExpiringTable(spark, str(tmp_path / "t"), "v int", 10)
    frame = lambda *rows: spark.createDataFrame(rows, "key string, v int")
    read = lambda now: {r.key: r.v for r in table.live(now).collect()}
    assert read(0) == {}
    table.put(frame(("a", 1), ("b", 2), ("b", 2), (None, 9)), 1_000)
    table.put(frame(("a", 3)), 5_000)
    table.put(frame(("c", 4)).withColumn("expires_at", F.lit(6_000)), 5_000)
    assert read(5_500) == {"a": 3, "b": 2, "c": 4}
    assert read(6_000) == {"a": 3, "b": 2} and read(11_000) == {"a": 3} and read(15_000) == {}
    table.put(frame(), 9_000)
    assert len(list((tmp_path / "t").iterdir())) == 3
    hits, misses = table.split(spark.createDataFrame([("a", "x"), ("a", "y"), ("z", "z"), (None, "n")], "key string, w string"), "key", 11_000)
    assert sorted((r.w, r.v) for r in hits.collect()) == [("x", 3), ("y", 3)] and sorted(r.w for r in misses.collect()) == ["n", "z"]
    table.compact(11_000)
    assert len(list((tmp_path / "t").iterdir())) == 1 and read(11_000) == {"a": 3} and read(15_000) == {}


def test_a_folder_that_was_not_finished_is_not_read(spark, tmp_path):
    table = ExpiringTable(spark, str(tmp_path / "t"), "v int", 10)
    table.put(spark.createDataFrame([("a", 1)], "key string, v int"), 0)
    (run,) = (tmp_path / "t").iterdir()
    (run / "_SUCCESS").unlink()
    assert table.live(1).count() == 0


def test_read_through_computes_each_missing_text_once(spark, tmp_path):
    table, log = ExpiringTable(spark, str(tmp_path / "t"), "n int", 10), tmp_path / "log"
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "ab", "abc", "bad", None])], "id int, text string")

    def once(text):
        if text == "bad":
            raise RuntimeError("refused")
        return len(text)

    measure = counted(log, once, "int")

    def compute(missing):
        return missing.withColumn("o", measure(F.col("text"))).select("key", F.col("o.value").alias("n"), F.col("o.error").alias("error"))

    read = lambda now: {r.id: (r.n, r.error) for r in table.read_through(rows, F.md5("text"), "text", compute, now).collect()}
    want = {0: (2, None), 1: (2, None), 2: (3, None), 3: (None, "RuntimeError: refused"), 4: (None, None)}
    assert read(0) == want
    first = calls(log)
    assert table.live(1).count() == 2
    assert read(1) == want and calls(log) - first <= 2  # the failed text alone is tried again
    first = calls(log)
    read(10_000)
    assert calls(log) - first > 2  # all have expired


def test_second_index_build_and_answer_call_no_provider(spark, tmp_path):
    memory = Memory.at(spark, str(tmp_path / "memory"))
    embeds, drafts, scores = tmp_path / "embeds", tmp_path / "drafts", tmp_path / "scores"
    write = counted(drafts, lambda q: f"A passage about {q}")
    score = counted(scores, lambda q, p: 9.0 if "Quinine" in p else 1.0, "double")
    providers = answering.Providers(
        embed=embedder(embeds), scorer=score,
        hypothetical=lambda rows: rows.withColumn("o", write(F.col("rewritten"))).select("qid", F.col("o.value").alias("passage"), F.col("o.error").alias("error")))
    index = answering.build_index(passages(spark), providers, memory=memory, now_ms=0)
    ask = lambda now, **more: {r.qid: r for r in answering.answer(asked(spark, SOLID, "snake bite"), index, providers, memory=memory, now_ms=now, **more).collect()}
    first = ask(1)
    before = [calls(p) for p in (embeds, drafts, scores)]
    assert all(before) and "cache" not in first[0].trace and first[0].answered and first[0].trace["blend"] == "used"
    again = ask(2)
    assert [calls(p) for p in (embeds, drafts, scores)] == before
    assert again[0].trace["cache"] == "hit" and again[0].answer == first[0].answer and again[1].refusal_reason == first[1].refusal_reason
    # another index of the same texts, and the same question unscreened: vectors and passages are known, the answer is not
    index = answering.build_index(passages(spark), providers, memory=memory, now_ms=3)
    other = ask(4, screen=False)
    assert "cache" not in other[0].trace and [calls(p) for p in (embeds, drafts)] == before[:2] and calls(scores) > before[2]
    # a day later the responses have expired, the vectors have not
    late = ask(2 + Settings().response_ttl_s * 1000)
    assert "cache" not in late[0].trace and [calls(p) for p in (embeds, drafts)] == before[:2]
    chunks = passages(spark).select("chunk_id", "title", "section_path", "text", *[F.lit("").alias(c) for c in indexing.NULLABLE_STRINGS])
    assert indexing.build(chunks, str(tmp_path / "index"), providers.embed, vectors=memory.vectors, now_ms=5) == 3
    assert indexing.build(chunks, str(tmp_path / "index"), providers.embed, recreate=True, vectors=memory.vectors, now_ms=6) == 3
    assert calls(embeds) == before[0]


def test_an_outage_is_not_remembered(spark, tmp_path):
    memory = Memory.at(spark, str(tmp_path / "memory"))
    index = answering.build_index(passages(spark))

    def fails(rows):
        raise ConnectionError("no route")

    down = answering.Providers(scorer=guarded(fails, "double"))
    (bad,) = answering.answer(asked(spark, SOLID), index, down, memory=memory, now_ms=1).collect()
    assert bad.refusal_reason == "low_confidence" and bad.degraded == ["reranker"] and "no route" in bad.trace["reranker_error"]
    assert memory.responses.live(2).count() == 0
    (good,) = answering.answer(asked(spark, SOLID), index, memory=memory, now_ms=2).collect()
    assert good.answered and memory.responses.live(3).count() == 1


STRUCTS = {"support": "array<boolean>", "framing": "array<string>"}


@pytest.mark.parametrize("stage", ["intent_classifier", "blend", "reranker", "generator", "support_judge", "safety_classifier"])
def test_each_stage_fails_alone_and_closed(spark, stage):
    index = answering.build_index(passages(spark))
    fail = lambda name, value: (lambda rows: (_ for _ in ()).throw(TimeoutError(name))) if stage == name else (lambda rows: [value] * len(rows))
    intent = guarded(fail("intent_classifier", {"intent": "in_scope", "reason": "fine"}), "struct<intent:string,reason:string>")
    blend = guarded(fail("blend", "about quinine"), "string")
    draft = guarded(fail("generator", "Quinine is limited [C1]."), "string")
    support, framing = guarded(fail("support_judge", [True]), "array<boolean>"), guarded(fail("safety_classifier", []), "array<string>")

    def drafts(kept):
        one = kept.where("marker = 'C1'").withColumn("o", draft(F.col("question")))
        claim = F.array(F.struct(F.lit("Quinine is limited").alias("text"), F.array("marker").alias("chunk_ids")))
        return one.select("qid", F.col("o.value").alias("answer"), claim.alias("claims"), F.col("o.value").isNull().alias("insufficient_context"), F.col("o.error").alias("error"))

    providers = answering.Providers(
        intent=lambda q: intent(q),
        hypothetical=lambda rows: rows.withColumn("o", blend(F.col("rewritten"))).select("qid", F.col("o.value").alias("passage"), F.col("o.error").alias("error")),
        scorer=guarded(fail("reranker", 9.0), "double"), draft=drafts,
        support=lambda claims, _: support(F.to_json(claims)), framing=lambda text: framing(text))
    (out,) = answering.answer(asked(spark, SOLID), index, providers).collect()
    assert out.degraded == [stage] and out.trace[f"{stage}_error"] == f"TimeoutError: {stage}"
    reason = {"intent_classifier": "out_of_domain", "blend": None, "reranker": "low_confidence", "generator": "model_declined",
              "support_judge": "ungrounded_output", "safety_classifier": "unsafe_output"}[stage]
    assert out.refusal_reason == reason and out.answered == (reason is None)
    ran = {"intent_classifier": "intent", "reranker": "intent,retrieve,rerank,confidence"}.get(stage, "intent,retrieve,rerank,confidence,generate,output_gate")
    assert out.trace["stages"] == ran and (out.trace.get("short_circuited") is not None) == (stage == "intent_classifier")


def test_one_bad_row_fails_no_other(spark):
    def call(rows):
        if any(x == "bad" for x, in rows):
            raise KeyError("bad")
        return [len(x) for x, in rows]

    rows = spark.createDataFrame([("a",), ("bad",), ("ccc",), (None,)], "t string").coalesce(1)
    got = {r.t: (r.o.value, r.o.error) for r in rows.withColumn("o", guarded(call, "int")(F.col("t"))).collect()}
    assert got == {"a": (1, None), "bad": (None, "KeyError: 'bad'"), "ccc": (3, None), None: (None, None)}
