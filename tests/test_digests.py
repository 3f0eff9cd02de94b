import hashlib

import pytest
from pyspark.sql import functions as F

from groundwell.operators import manifest
from groundwell.sources import digests, files


@pytest.fixture
def folder(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "large.txt").write_bytes(b"# A title of this file\n" + bytes(range(256)) * 4096)
    (raw / "empty.txt").write_bytes(b"")
    for i in range(9):
        (raw / f"part {i}.pdf").write_bytes(b"x" * (1000 * i))
    (raw / "skip.md").write_text("not read")
    (raw / "_part.txt").write_text("not read")
    (raw / "inner.txt").mkdir()
    return raw


def test_digests_equal_those_of_whole_files_whatever_the_blocks(spark, folder):
    want = {
        p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest(), p.read_bytes()[:50])
        for p in folder.iterdir() if p.is_file() and p.suffix in (".pdf", ".txt") and not p.name.startswith("_")
    }
    for options in ({}, {"blockBytes": 7777, "partitionBytes": 5000}, {"blockBytes": 13, "suffixes": ".pdf"}):
        found = digests.read_digests(spark, str(folder), headBytes=50, **options)
        got = {r.filename: (r.n_bytes, r.sha256, bytes(r["head"])) for r in found.collect()}
        assert got == {n: v for n, v in want.items() if n.endswith(options.get("suffixes", ""))}
    assert {r.suffix for r in found.collect()} == {".pdf"}


def test_a_file_larger_than_a_row_may_be_is_hashed(spark, folder):
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100000")
    try:
        with pytest.raises(Exception, match="larger|exceed|max|LENGTH"):
            files.read_folder(spark, str(folder)).agg(F.max("sha256")).collect()
        rows = {r.filename: r for r in files.scan_folder(spark, str(folder)).collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert rows["large.txt"].sha256 == hashlib.sha256((folder / "large.txt").read_bytes()).hexdigest()
    assert rows["large.txt"].title == "A title of this file"


def test_files_are_dealt_by_bytes():
    sizes = [(f"f{i}", i * 100) for i in range(30)] + [("huge", 10**9)]
    groups = digests.dealt(sizes, 5000)
    of = dict(sizes)
    assert sorted(p for g in groups for p in g) == sorted(of) and ["huge"] in groups
    assert all(sum(of[p] for p in g) <= 5000 or len(g) == 1 for g in groups) and len(groups) < 20
    assert digests.dealt([], 10) == []


def test_partitions_follow_the_bytes_and_an_empty_folder_has_no_rows(spark, folder, tmp_path):
    assert digests.read_digests(spark, str(folder), partitionBytes=8000).rdd.getNumPartitions() >= 5
    assert digests.read_digests(spark, f"file://{folder}").count() == 11
    (tmp_path / "none").mkdir()
    assert digests.read_digests(spark, str(tmp_path / "none")).count() == 0


def test_diff_needs_no_file_in_a_row(spark, folder):
    listed = files.scan_folder(spark, str(folder))
    again = digests.read_digests(spark, str(folder))
    assert {r.status for r in manifest.diff(listed, again).collect()} == {"ok"}


def test_equal_ids_are_refused(spark, folder):
    for end in ("one", "two"):
        (folder / ("a long name " * 8 + end + ".txt")).write_text("words")
    with pytest.raises(ValueError, match="a-long-name"):
        files.scan_folder(spark, str(folder))
