import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwell.functions import vectors
from groundwell.operators import dense, fusion, lexical
from groundwell.operators.best import RunningBest


def corpus_rows(seed=5, n=60):
    rng = random.Random(seed)
    vocab = ["the"] * 12 + [f"t{i}" for i in range(40)] + ["co-trim", "b12"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))) for i in range(n)]
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, "")]


def plain_bm25(rows, query, k):
    docs = [(d, re.findall(r"[a-z0-9]+(?:-[a-z0-9]+)*", t.lower())) for d, t in rows]
    n, mean = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = Counter(w for _, t in docs for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = []
    for d, t in docs:
        tf = Counter(t)
        s = sum(
            idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean))
            for w in re.findall(r"[a-z0-9]+(?:-[a-z0-9]+)*", query.lower())
        )
        out.append((-round(s, 6), d))
    return [(d, -s) for s, d in sorted(out)[:k] if -s > 0]


QUERIES = [(1, "the t1 t2 t2 CO-TRIM"), (2, "the the"), (3, "nothing known"), (4, "t5 t6 t7 b12 t9"), (5, "")]


@pytest.mark.parametrize("block", [1_000_000, 3])
def test_bm25_equals_brute_force_also_in_blocks(spark, block):
    rows = corpus_rows()
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    asked = spark.createDataFrame(QUERIES, "qid int, text string")
    corpus = lexical.build_corpus(docs)
    got = {}
    for r in lexical.bm25_topk(corpus, asked, 7, max_block_terms=block).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.doc_id, pytest.approx(r.score, abs=1e-6)))
    want = {q: plain_bm25(rows, t, 7) for q, t in QUERIES}
    assert got == {q: w for q, w in want.items() if w}


@pytest.mark.parametrize("cells", [1, 40])
def test_bm25_scores_in_lots_of_bounded_work(spark, cells, monkeypatch):
    rows = corpus_rows(seed=6, n=90)
    asked = [(i, " ".join(f"t{(i * 7 + j) % 40}" for j in range(4)) + " the") for i in range(60)]
    held = []
    cut = lexical._lots

    def lots(doc, work):
        for lot in cut(doc, work):
            held.append((int(work[lot].sum()), int(work[doc == doc[lot][0]].sum()), len(set(doc[lot]))))
            yield lot

    monkeypatch.setattr(lexical, "LOT_CELLS", cells)
    # a plain call of the lots first: whole documents, bounded work, nothing left out
    doc = np.repeat(np.arange(9), [3, 1, 4, 1, 5, 9, 2, 6, 5])
    work = np.arange(len(doc)) % 7 + 1
    covered = [i for lot in lots(doc, work) for i in range(lot.start, lot.stop)]
    most = max(work[doc == d].sum() for d in set(doc))
    assert covered == list(range(len(doc))) and all(total <= cells + most for total, _, _ in held)
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {}
    for r in lexical.bm25_topk(lexical.build_corpus(docs), spark.createDataFrame(asked, "qid int, text string"), 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.doc_id, pytest.approx(r.score, abs=1e-6)))
    want = {q: plain_bm25(rows, t, 5) for q, t in asked}
    assert got == {q: w for q, w in want.items() if w}


def test_bm25_of_an_empty_corpus_and_missing_text(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id int, text string")
    asked = spark.createDataFrame(QUERIES, "qid int, text string")
    assert lexical.bm25_topk(lexical.build_corpus(docs), asked, 5).count() == 0
    assert lexical.bm25_topk(lexical.build_corpus(docs.where("false")), asked, 5).count() == 0


def test_bm25_plan_moves_no_text_and_prunes_before_the_only_exchange(spark):
    docs = spark.createDataFrame(corpus_rows(), "doc_id int, text string")
    asked = spark.createDataFrame(QUERIES, "qid int, text string")
    plan = lexical.bm25_topk(lexical.build_corpus(docs), asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SortMergeJoin" not in plan
    assert "Partial" in plan and "hashpartitioning(doc_id" not in plan and plan.count("Exchange") == 1


def vectors_table(spark, n=300, dim=6, seed=2):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).round(3)
    m[7], m[8] = m[3], m[3]
    m[9] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return m, spark.createDataFrame(rows, "doc_id int, vector array<float>")


def plain_cosine(q, m, k):
    length = lambda v: math.sqrt((v * v).sum()) or 1e-9
    d = [(round(1 - float(q @ v) / (length(q) * length(v)), 6) + 0.0, i) for i, v in enumerate(m.astype(np.float32).astype(float))]
    return sorted(d)[:k]


@pytest.mark.parametrize("max_bytes", [1 << 20, 3 * 6 * 8])
def test_cosine_equals_brute_force_by_broadcast_and_by_grid(spark, max_bytes, monkeypatch):
    monkeypatch.setattr(dense, "CELL_ROWS", 70)
    m, stored = vectors_table(spark)
    qs = [(i, [float(x) for x in m[i]]) for i in (0, 3, 9, 50, 299)] + [(1000, None)]
    asked = spark.createDataFrame(qs, "qid int, vector array<float>")
    got = {}
    for r in dense.cosine_topk(asked, stored, 5, max_bytes=max_bytes).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.distance, r.doc_id))
    assert set(got) == {0, 3, 9, 50, 299}
    for q, rows in got.items():
        want = plain_cosine(m[q].astype(np.float32).astype(float), m, 5)
        assert [i for _, i in rows] == [i for _, i in want]
        assert [d for d, _ in rows] == pytest.approx([d for d, _ in want], abs=2e-6)


def test_running_best_equals_a_sort_and_holds_k_rows_a_question():
    rng = np.random.default_rng(8)
    shown, best = [], RunningBest(7, 3)
    for step in range(40):
        n = int(rng.integers(0, 30))
        ids = pa.array([f"d{int(x):03d}" for x in rng.permutation(200)[:25]])
        q, v, at = rng.integers(0, 6, n), rng.integers(0, 8, n) / 4, rng.integers(0, len(ids), n)
        best.add(q, v, at, ids)
        shown += [(a, b, f"{ids[int(c)]}") for a, b, c in zip(q.tolist(), v.tolist(), at)]
        assert len(best.question) <= 7 * 3
    want = [r for x in range(7) for r in sorted(s for s in shown if s[0] == x)[:3]]
    assert list(zip(best.question.tolist(), best.value.tolist(), best.ids.to_pylist())) == want
    assert best.bar[6] == np.inf and all(best.bar[x] == [r for r in want if r[0] == x][-1][1] for x in range(6))


@pytest.mark.parametrize("max_bytes", [1 << 20, 3 * 6 * 8])
def test_cosine_takes_the_predicate_before_the_search(spark, max_bytes, tmp_path):
    m, stored = vectors_table(spark)
    stored.withColumn("kind", (F.col("doc_id") % 10).cast("int")).write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    asked = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in (0, 3, 9, 50, 299)], "qid int, vector array<float>")
    some = [i for i in range(len(m)) if i % 10 == 3]
    found = dense.cosine_topk(asked, stored, 5, max_bytes=max_bytes, where="kind = 3")
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.doc_id)
    for q, ids in got.items():
        assert ids == [some[i] for _, i in plain_cosine(m[q].astype(np.float32).astype(float), m[some], 5)]
    assert set(got) == {0, 3, 9, 50, 299}
    assert "EqualTo(kind,3)" in found._jdf.queryExecution().executedPlan().toString()
    assert dense.cosine_topk(asked, stored, 5, max_bytes=max_bytes, where="kind = 77").count() == 0


def test_no_more_than_k_rows_a_question_leave_a_task(spark, monkeypatch):
    m, stored = vectors_table(spark)
    asked = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(20)], "qid int, vector array<float>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(dense, "best_per_question", lambda near, k, order: near)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert dense.cosine_topk(asked, stored.repartition(3), 5).count() == 3 * 20 * 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_unit_mean_and_blend_exactly(spark):
    rows = spark.createDataFrame([(1, [3.0, 0.0, 0.0]), (1, [0.0, 5.0, 0.0]), (2, [0.0, 0.0, 0.0])], "k int, v array<double>")
    means = {r.k: r["mean"] for r in dense.mean_unit_vector(rows, "k", "v").collect()}
    assert means[1] == [0.5, 0.5, 0.0] and means[2] == [0.0, 0.0, 0.0]
    q, h = F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(9.0))
    row = spark.range(1).select(
        vectors.blend(q, h, 0.5).alias("half"), vectors.blend(q, h, 7.0).alias("all"), vectors.blend(q, h, -1.0).alias("none"),
        vectors.blend(q, F.lit(None).cast("array<double>"), 0.5).alias("raw"),
    ).first()
    assert row.half == pytest.approx([1 / math.sqrt(2)] * 2) and row["all"] == [1.0, 0.0] and row.none == [0.0, 1.0] and row.raw == [2.0, 0.0]


def ranking(spark, *ids, qid=1):
    return spark.createDataFrame([(qid, d, i + 1) for i, d in enumerate(ids)], "qid int, doc_id string, rank int")


def test_fusion_rewards_agreement_counts_repeats_and_checks_weights(spark):
    one, two = ranking(spark, "a", "b", "c"), ranking(spark, "c", "a", "d", "d")
    got = {r.doc_id: r.fused for r in fusion.reciprocal_rank_fusion([one, two]).collect()}
    assert got["a"] == pytest.approx(1 / 61 + 1 / 62) and got["d"] == pytest.approx(1 / 63 + 1 / 64)
    assert max(got, key=got.get) == "a"
    half = {r.doc_id: r.fused for r in fusion.reciprocal_rank_fusion([one, two], weights=[1.0, 0.0]).collect()}
    assert half["d"] == 0.0
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion([one], weights=[1.0, 1.0])


def test_hybrid_ties_follow_dense_then_lexical_order(spark):
    near = ranking(spark, "x", "y").withColumn("distance", F.col("rank") / 10.0)
    hits = ranking(spark, "p", "q").withColumn("score", F.lit(9.0) - F.col("rank"))
    out = [(r.doc_id, r.distance, r.score) for r in fusion.hybrid_topk(near, hits, 3).orderBy("rank").collect()]
    assert out == [("x", 0.1, None), ("p", None, 8.0), ("y", 0.2, None)]


def test_orphans(spark):
    known = spark.createDataFrame([("a",)], "doc_id string")
    assert [r.doc_id for r in fusion.orphans(ranking(spark, "a", "z"), known).collect()] == ["z"]


def test_results_of_many_questions_are_bounded_by_cells(spark, monkeypatch):
    """A task holds k results of each of its questions, so many questions go by cells however short their vectors."""
    rng = np.random.default_rng(4)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 3)))], "qid long, vector array<double>")
    stored = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 3)))], "doc_id long, vector array<double>")
    want = dense.cosine_topk(asked, stored, 5).orderBy("qid", "rank").collect()
    grid, by_grid = dense._by_grid, []
    monkeypatch.setattr(dense, "RESULT_ROWS", 50)
    monkeypatch.setattr(dense, "BLOCK_PAIRS", 60)
    monkeypatch.setattr(dense, "_by_grid", lambda *a: by_grid.append(a[-1]) or grid(*a))
    assert dense.cosine_topk(asked, stored, 5).orderBy("qid", "rank").collect() == want and len(want) == 200
    assert by_grid == [10]
