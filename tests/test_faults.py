"""Inputs that once lost or mixed up rows."""

from pyspark.sql import functions as F

from groundwell.operators import lexical, quota
from groundwell.plans import answer as answering
from groundwell.plans import index as indexing

CHUNK = "chunk_id string, title string, section_path string, text string, specialty string, doc_version string, source_url string"


def chunk(spark, *rows):
    return spark.createDataFrame([(i, "t", "s", text, None, None, None) for i, text in rows], CHUNK)


def test_index_takes_changed_text_and_drops_vanished_chunks(spark, tmp_path):
    path = str(tmp_path / "index")
    embed = lambda text: F.array(F.length(text).cast("float"))
    assert indexing.build(chunk(spark, ("a", "one"), ("b", "two"), ("c", "three")), path, embed) == 3
    assert indexing.build(chunk(spark, ("a", "one"), ("b", "new text"), ("d", "four")), path, embed) == 2
    assert {r.chunk_id: r.text for r in spark.read.parquet(path).collect()} == {"a": "one", "b": "new text", "d": "four"}
    assert indexing.build(chunk(spark, ("a", "one"), ("b", "new text"), ("d", "four")), path, embed) == 0


def test_quota_tells_repeated_ids_apart(spark):
    rows = spark.createDataFrame([(1, "x", 10), (1, "y", 11), (2, "x", 12), (2, "x", 12)], "id int, subject string, at int")
    out = quota.quota(rows.withColumn("ts", F.timestamp_seconds("at")), 2, 60).collect()
    assert sorted((r.subject, r.id, r.allowed) for r in out) == [("x", 1, True), ("x", 2, False), ("x", 2, True), ("y", 1, True)]


def test_failure_runs_keep_calls_without_a_time(spark):
    rows = spark.createDataFrame([(1, "x", None, True), (2, "x", 10, True), (3, "x", 20, True)], "id int, subject string, at int, failed boolean")
    out = quota.failure_runs(rows.withColumn("ts", F.timestamp_seconds("at"))).collect()
    assert [(r.failures, r.trips) for r in out] == [(3, 1)]


def test_question_ids_may_hold_any_character(spark):
    passages = spark.createDataFrame(
        [(f"c{i}", "d", "T", "S", 1, 1, "u", text) for i, text in enumerate(["rye bread oven heat", "walnut cake", "ski wax snow"])],
        "chunk_id string, doc_id string, title string, section_path string, page_start int, page_end int, source_url string, text string",
    )
    index = answering.build_index(passages)
    ask = lambda qid: spark.createDataFrame([(qid, "rye bread heat", "rye bread heat")], "qid string, question string, rewritten string")
    found = [
        sorted((r.qid, r.chunk_id) for r in answering.retrieve(ask(q), index, answering.Providers(), answering.Settings())[0].collect())
        for q in ("q", "q#1")
    ]
    assert [c for _, c in found[0]] == [c for _, c in found[1]] and {q for q, _ in found[1]} == {"q#1"} and len(found[1]) == 3


def test_bm25_in_blocks_equals_one_block(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3} w{i % 3}") for i in range(200)] + [(500, None), (501, "")], "doc_id int, text string").repartition(5)
    asked = spark.createDataFrame([(q, f"w{q % 7} w{q % 5} w{q}") for q in range(12)], "qid int, text string")
    corpus = lexical.build_corpus(docs)
    one, many = (sorted(map(tuple, lexical.bm25_topk(corpus, asked, 6, max_block_terms=n).collect())) for n in (1000, 9))
    assert one == many and len(one) == 72
