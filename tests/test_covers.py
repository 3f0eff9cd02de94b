from groundwell.operators.manifest import cover_titles
from groundwell.plans.ingest import ingest

LINE = "doc_id string, line_no bigint, page int, size double, text string"


def titles(spark, lines, files):
    got = cover_titles(spark.createDataFrame(lines, LINE), spark.createDataFrame(files, "doc_id string, filename string, stored_title string"))
    return {r.doc_id: r.title for r in got.collect()}


def test_cover_lines_are_joined_in_reading_order_on_the_first_page_that_has_a_title(spark):
    lines = [
        ("a", 3, 1, 20.0, "FOR  BAKERS"), ("a", 1, 1, 19.5, "OVEN HANDBOOK"), ("a", 2, 1, 12.0, "small print here"), ("a", 0, 1, 20.04, "Page 1"),
        ("b", 0, 1, 30.0, "CONTENTS"), ("b", 1, 1, 12.0, "not large enough words"), ("b", 9, 2, 14.0, "Flour and Water"), ("b", 12, 3, 40.0, "A later title"),
        ("c", 0, 4, 30.0, "On the fourth page"), ("d", 0, 1, 30.0, "x" * 70), ("d", 1, 1, 30.0, "y" * 70), ("e", 0, 1, 30.0, "one12345"), ("e", 1, 1, 10.0, "two words here"),
    ]
    files = [
        ("a", "a.pdf", None), ("b", "b.pdf", "Stored"), ("c", "c_d-e.v2.pdf", None), ("d", "d.pdf", " Kept title "),
        ("e", "long_name.pdf", "Microsoft Word - x.docx"), ("f", "scan-of_rye.pdf", "abc"), ("g", "g.pdf", "Untitled"),
    ]
    assert titles(spark, lines, files) == {
        "a": "Oven Handbook For Bakers", "b": "Flour and Water", "c": "C D E.V2", "d": "Kept title", "e": "Long Name", "f": "Scan Of Rye", "g": "G",
    }
    assert titles(spark, [], files[:1]) == {"a": "A"} and titles(spark, lines, []) == {}


def test_typeset_files_without_lines_count(spark):
    body = "Dough rests while the oven warms, and nothing is hurried because the crumb would suffer for it. " * 4
    lines = spark.createDataFrame(
        [("read.pdf", 0, 1, 10.0, False, 3, body), ("thin.pdf", 0, 1, 10.0, False, 3, body)],
        "filename string, line_no bigint, page int, size double, bold boolean, block_lines int, text string")
    files = spark.createDataFrame([("read.pdf", "1", 2), ("thin.pdf", "2", 90), ("scan.pdf", "3", 7)], "filename string, sha256 string, n_pages int")
    listed = spark.createDataFrame(
        [(n, n, s, n, "", "", None, None) for n, s in (("read.pdf", "1"), ("thin.pdf", "2"), ("scan.pdf", "3"))],
        "doc_id string, filename string, sha256 string, title string, url string, publisher string, specialty string, version string")
    texts = spark.createDataFrame([], "filename string, sha256 string, text string")
    done = ingest(listed, texts, lines, files=files)
    assert {r.doc_id for r in done.chunks.collect()} == {"read.pdf"}
    skipped = {r.doc_id: r.reason for r in done.skipped.collect()}
    assert set(skipped) == {"thin.pdf", "scan.pdf"} and "(0 chars/page over 7 pages)" in skipped["scan.pdf"] and "over 90 pages" in skipped["thin.pdf"]
