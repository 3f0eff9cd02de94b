import datetime as dt
import random

from groundwell.streaming import jobs

SCHEMA = "subject string, id int, ts timestamp, failed boolean"


def source(spark, folder, batches, schema=SCHEMA):
    """A stream taking one file per micro-batch, in order."""
    import os

    stamp = 1_700_000_000
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{n}")
        for root, _, names in os.walk(f"{folder}/in/{n}"):
            for name in names:
                os.utime(f"{root}/{name}", (stamp + n, stamp + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def run(spark, folder, stream, mode="append"):
    jobs.write_batches(stream, f"{folder}/out", f"{folder}/state", mode).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_breaker_over_several_batches_equals_a_walk(spark, tmp_path):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    calls = [("s%d" % (i % 3), i, start + dt.timedelta(seconds=9 * i), rng.random() < 0.6) for i in range(90)]
    stream = source(spark, tmp_path, [calls[:30], calls[30:50], calls[50:]])
    got = {r.id: (r.attempted, r.opened) for r in run(spark, tmp_path, jobs.breaker(stream)).collect()}
    held, want = {}, {}
    for subject, number, at, failed in calls:
        row, until = held.get(subject, (0, start))
        attempted = at >= until
        opened = attempted and failed and row == 2
        if attempted:
            row = 0 if opened or not failed else row + 1
            until = at + dt.timedelta(seconds=60) if opened else until
        held[subject] = (row, until)
        want[number] = (attempted, opened)
    assert got == want and any(o for _, o in want.values())


def test_history_cap_drops_exactly_what_a_prune_would(spark, tmp_path):
    rows = [(f"u{i % 2}", f"{i:03d}", f"2024-01-{1 + i // 4:02d}") for i in range(40)]
    stream = source(spark, tmp_path, [rows[:25], rows[25:]], "user_id string, id string, created_at string")
    dropped = {r.id for r in run(spark, tmp_path, jobs.pruned_turns(stream, 5)).collect()}
    assert {r[1] for r in rows} - dropped == {f"{i:03d}" for i in range(30, 40)}


def test_quota_counts_update_and_latest_rows(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    one = [("a", i, at(i), False) for i in range(5)]
    two = [("a", 9, at(50), False), ("b", 10, at(3700), False)]
    stream = source(spark, tmp_path, [one, two])
    run(spark, tmp_path, jobs.quota_counts(stream, 3600), "update")
    latest = jobs.latest_rows(spark, f"{tmp_path}/out", ["subject", "window"])
    base = 1704067200 // 3600
    assert {(r.subject, r.window - base, r.n) for r in latest.collect()} == {("a", 0, 6), ("b", 1, 1)}


def test_repeats_within_the_lateness_are_dropped(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    stream = source(spark, tmp_path, [[("a", 1, at(0), False), ("b", 1, at(5), False)], [("c", 1, at(8), False), ("d", 2, at(9), False)]])
    out = run(spark, tmp_path, jobs.first_requests(stream, "id", "1 hour"))
    assert sorted(r.id for r in out.collect()) == [1, 2]


def test_growing_corpus_is_chunked_as_it_arrives(spark, tmp_path):
    text = "Sentence with exactly seven tokens here. " * 20
    stream = source(spark, tmp_path, [[("d1", "old " + text), ("d2", text)], [("d1", "new " + text)]], "doc_id string, text string")
    jobs.ingest_stream(stream, f"{tmp_path}/chunks", f"{tmp_path}/ck").awaitTermination()
    latest = jobs.latest_rows(spark, f"{tmp_path}/chunks", ["doc_id"])
    assert {(r.chunk_id, r.text[:3]) for r in latest.collect()} == {("d1::0000::00", "new"), ("d2::0000::00", "Sen")}
