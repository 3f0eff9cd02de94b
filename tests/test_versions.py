import pytest

from groundwell.sources import versions

BASE = "id bigint, email string, created_at string"
FIRST = ["id", "email", "created_at"]
STEPS = versions.account_steps()
ROW = "id bigint, email string, created_at string, verified_at string, password_changed_at string"


def write(spark, folder, version, *rows):
    versions.write_version(spark.createDataFrame(list(rows), ROW), folder, version, STEPS, FIRST)


def read(spark, folder):
    return {r.id: (r.verified_at, r.password_changed_at) for r in versions.read_migrated(spark, folder, STEPS, BASE).collect()}


def test_only_rows_older_than_a_column_are_filled(spark, tmp_path):
    folder = f"{tmp_path}/accounts"
    write(spark, folder, 1, (1, "a", "d1", "lost", "lost"))
    assert read(spark, folder) == {1: ("d1", None)}
    write(spark, folder, 2, (2, "b", "d2", None, "lost"), (3, "c", "d3", "d9", None))
    write(spark, folder, 3, (4, "d", "d4", None, "d8"))
    want = {1: ("d1", None), 2: (None, None), 3: ("d9", None), 4: (None, "d8")}
    assert read(spark, folder) == want

    moved = f"{tmp_path}/moved"
    for _ in range(2):  # again after a run that was cut off
        versions.migrate(spark, folder, moved, STEPS, BASE)
        assert read(spark, moved) == want
    write(spark, moved, 3, (5, "e", "d5", None, None))
    assert read(spark, moved)[5] == (None, None)


def test_a_later_fill_sees_an_earlier_step_and_filters_reach_the_scan(spark, tmp_path):
    steps = (*STEPS, versions.Step(4, "seen_at", "string", "coalesce(verified_at, 'never')"))
    folder = f"{tmp_path}/accounts"
    for version in (1, 2):
        write(spark, folder, version, (version, "a", "d1", None, None))
    rows = versions.read_migrated(spark, folder, steps, BASE)
    assert {r.id: r.seen_at for r in rows.collect()} == {1: "d1", 2: "never"}
    plan = rows.where("id = 2").select("seen_at")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,2)" in plan and "email" not in plan


def test_rows_of_an_unknown_version_are_refused(spark, tmp_path):
    folder = f"{tmp_path}/accounts"
    write(spark, folder, 9, (1, "a", "d1", None, None))
    with pytest.raises(Exception, match="newer schema version: 9"):
        read(spark, folder)
