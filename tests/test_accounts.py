import datetime as dt

from pyspark.sql import functions as F

from groundwell.operators import accounts, quota
from groundwell.operators.skew import skew_safe_join
from groundwell.schemas import USER


def users(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], USER)


def test_one_account_per_address(spark):
    have = users(spark, ("u1", "a@b.org", "2024"))
    signups = spark.createDataFrame(
        [("u2", " A@B.org", "2024-02"), ("u3", "c@d.org", "2024-03"), ("u4", "C@d.ORG ", "2024-02"), ("u5", "nope", "2024-01")],
        "id string, email string, created_at string")
    assert {(r.id, r.email) for r in accounts.register(have, signups).collect()} == {("u1", "a@b.org"), ("u4", "c@d.org")}


def test_first_confirmation_wins_and_latest_password_counts(spark):
    have = users(spark, ("u1", "a", "1", None, "2024-05"), ("u2", "b", "1", "2024-01"), ("u3", "c", "1"))
    marks = spark.createDataFrame([("u1", "2024-03"), ("u1", "2024-02"), ("u2", "2024-02"), ("u9", "2024")], "user_id string, at string")
    assert {r.id: r.verified_at for r in accounts.first_verified(have, marks).collect()} == {"u1": "2024-02", "u2": "2024-01", "u3": None}
    assert {r.id: r.password_changed_at for r in accounts.latest_password(have, marks).collect()} == {"u1": "2024-05", "u2": "2024-02", "u3": None}


def test_sessions_end_with_a_password_change(spark):
    have = users(spark, ("u1", "a", "1", None, "2024-01-01T00:00:01.500+00:00"), ("u2", "b", "1"))
    at = 1704067201500
    rows = spark.createDataFrame([("u1", at - 1), ("u1", at), ("u2", 5), ("gone", at)], "user_id string, issued_at_ms long")
    assert {(r.user_id, r.issued_at_ms) for r in accounts.valid_sessions(rows, have).collect()} == {("u1", at), ("u2", 5)}


def turns(spark):
    rows = [("u1", f"{i:02d}", f"2024-01-01T00:00:0{i // 2}.000+00:00") for i in range(10)] + [("u2", "x", "2024")]
    return spark.createDataFrame(rows, "user_id string, id string, created_at string")


def test_prune_page_and_cursor(spark):
    t = turns(spark)
    assert {r.id for r in accounts.prune(t, 3).collect()} == {"09", "08", "07", "x"}
    assert accounts.prune(t, 0).count() == 11
    page = accounts.history_page(t, 3)
    assert [r.id for r in page.where("user_id = 'u1'").orderBy("place").collect()] == ["09", "08", "07"]
    cursors = accounts.next_cursors(page, 3)
    assert [tuple(r) for r in cursors.collect()] == [("u1", "2024-01-01T00:00:03.000+00:00")]
    # 06 shares the instant of the boundary row and is skipped, as the keyset rule does.
    assert [r.id for r in accounts.history_page(t, 3, cursors).orderBy("place").collect()] == ["05", "04", "03"]
    assert accounts.history_page(t, 0).where("user_id = 'u1'").count() == 1
    assert accounts.history_page(t, 1000).count() == 11


def test_deletes_are_scoped_to_the_owner(spark):
    t = turns(spark)
    wanted = spark.createDataFrame([("u1", "x"), ("u2", "x"), ("u1", "00")], "user_id string, id string")
    assert {(r.user_id, r.id) for r in accounts.scoped(t, wanted).collect()} == {("u2", "x"), ("u1", "00")}
    assert accounts.delete_turns(t, wanted).count() == 9
    have = users(spark, ("u1", "a", "1"), ("u2", "b", "1"))
    left, history = accounts.delete_users(have, t, have.where("id = 'u1'"))
    assert [r.id for r in left.collect()] == ["u2"] and [r.id for r in history.collect()] == ["x"]
    assert accounts.clear_history(t, wanted.where("id = '00'")).count() == 1


def test_saved_turns_read_back_and_broken_citations_give_none(spark):
    answer = spark.createDataFrame(
        [(1, "u", "q", "a", True, None, 9.0, [("C1", "k", "d", "t", "s", "1", "", 9.0)], dt.datetime(2024, 1, 1))],
        "qid int, user_id string, query string, answer string, answered boolean, refusal_reason string, top_score double, "
        "citations array<struct<marker:string,chunk_id:string,doc_id:string,title:string,section:string,pages:string,source_url:string,rerank_score:double>>, at timestamp")
    saved = accounts.as_turns(answer)
    row = saved.select("created_at", accounts.read_citations(F.col("citations")).alias("c")).first()
    assert row.created_at == "2024-01-01T00:00:00.000+00:00" and row.c[0].chunk_id == "k"
    bad = spark.createDataFrame([("{",), ('{"a":1}',), (None,), ("[]",)], "s string").select(accounts.read_citations(F.col("s")).alias("c"))
    assert [r.c for r in bad.collect()] == [[], [], [], []]


def test_quota_per_fixed_window_and_subject(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)
    rows = [("a", i, at(3590 + i)) for i in range(15)] + [("b", 100, at(3599))]
    requests = spark.createDataFrame(rows, "subject string, id int, ts timestamp")
    out = {r.id: (r.allowed, r.remaining, r.retry_after_s) for r in quota.quota(requests, 3, 3600).collect()}
    assert [out[i][0] for i in range(15)] == [True] * 3 + [False] * 7 + [True] * 3 + [False] * 2
    assert out[0] == (True, 2, 10) and out[2] == (True, 0, 8) and out[9] == (False, 0, 1) and out[10] == (True, 2, 3600)
    assert out[100] == (True, 2, 1)
    assert {(r.allowed, r.remaining) for r in quota.quota(requests, 0, 3600).collect()} == {(True, -1)}
    counts = {(r.subject, r.n, r.refused) for r in quota.window_counts(requests, 3, 3600).collect()}
    assert counts == {("a", 10, 7), ("a", 5, 2), ("b", 1, 0)}


def test_failure_runs_cross_days(spark):
    flags = [True, True, False, True, True, True, True, False, False, True]
    rows = [("s", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), f) for i, f in enumerate(flags)]
    calls = spark.createDataFrame(rows, "subject string, id int, ts timestamp, failed boolean")
    out = sorted((r.run_start, r.failures, r.trips) for r in quota.failure_runs(calls).collect())
    assert [(n, t) for _, n, t in out] == [(2, 0), (4, 1), (1, 0)]


def test_entries_expire(spark):
    rows = [("k", 1, dt.datetime(2024, 1, 1)), ("k", 2, dt.datetime(2024, 1, 2)), ("old", 3, dt.datetime(2023, 1, 1))]
    entries = spark.createDataFrame(rows, "key string, v int, stored_at timestamp")
    out = quota.fresh_entries(entries, F.lit(dt.datetime(2024, 1, 2)), 2 * 86400)
    assert [(r.key, r.v) for r in out.collect()] == [("k", 2)]


def test_skew_safe_join_equals_a_join(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"))
    lookup = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = sorted((r.id, r.k, r.v if r.v is not None else -1) for r in skew_safe_join(rows, lookup, "k", how).collect())
        want = sorted((r.id, r.k, r.v if r.v is not None else -1) for r in rows.join(lookup, "k", how).collect())
        assert got == want
