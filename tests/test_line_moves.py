"""How often the text of typeset lines is shuffled."""

import pytest

from groundwell.operators import sections_lines
from groundwell.plans import ingest as ingesting
from groundwell.session import cut_lineage


def text_moves(df):
    """Exchanges whose rows hold a text."""
    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        held = node.output()
        texts = [a for a in map(held.apply, range(held.size())) if a.dataType().simpleString() == "string" and a.name() in ("text", "furniture")]
        below = node.children()
        return (node.nodeName() == "Exchange" and bool(texts)) + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def lines(spark):
    rows = [
        (d, i, t, i // 4 + 1, 14.0 if t.startswith("Part") else 10.0, False, 3)
        for d in (1, 2)
        for i, t in enumerate(x for p in range(6) for x in ("Running  HEAD " if p % 2 else "running  head", f"Part {d}{p}", f"body of {p} " * (30 if p % 3 else 1), str(p)))
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield cut_lineage(spark.createDataFrame(rows, "doc_id long, line_no long, text string, page int, size double, bold boolean, block_lines int"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_meet_what_is_known_of_their_document_in_one_move(lines):
    found = sections_lines._content(lines, sections_lines.page_counts(lines))
    assert text_moves(found) == 1
    assert {r.text.split()[0] for r in found.collect()} == {"Part", "body"}


def test_marked_lines_move_once_more(lines):
    assert text_moves(sections_lines.headed_lines(lines)) == 1


def test_folding_moves_sections_once_before_it_gathers_them(lines):
    raw = cut_lineage(sections_lines.raw_sections(sections_lines.headed_lines(lines)))
    assert text_moves(sections_lines.fold_short(raw)) == 1


def test_ingest_joins_lines_with_the_manifest_once(spark, lines, monkeypatch):
    given = []
    parse = ingesting.parse_lines
    monkeypatch.setattr(ingesting, "parse_lines", lambda own, pages: given.append((own, pages)) or parse(own, pages))
    none = None
    manifest = spark.createDataFrame([(d, f"{d}.pdf", "x", "t", "", "", none, none) for d in (1, 2, 3)], "doc_id long, filename string, sha256 string, title string, url string, publisher string, specialty string, version string")
    files = manifest.select("filename", "sha256").selectExpr("*", "if(filename = '2.pdf', 10000, 6) as n_pages")
    named = lines.selectExpr("*", "concat(doc_id, '.pdf') as filename")
    texts = spark.createDataFrame([], "filename string, sha256 string, text string")
    done = ingesting.ingest(manifest, texts, named, files=files)
    own, pages = given[0]
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
    assert [r.doc_id for r in pages.collect()] == [1]  # a document without a text layer is not parsed
    assert {r.doc_id for r in done.report.collect()} == {1} and {r.doc_id: r.reason.split()[0] for r in done.skipped.collect()} == {2: "no", 3: "no"}
