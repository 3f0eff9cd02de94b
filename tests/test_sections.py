import pytest
from pyspark.sql import functions as F

from groundwell.operators import headings, sections_lines, sections_text

DOC = "docs"


def parse(spark, value):
    docs = spark.createDataFrame([("d", value)], "doc_id string, text string")
    parsed = sections_text.parse_text(docs)
    rows = sections_text.explode_sections(parsed).orderBy("seq").collect()
    return rows, parsed.first()


@pytest.mark.parametrize("line,prev,nxt,level", [
    ("# Title", False, False, 1), ("### Deep ###", False, False, 3), ("1. Alpha beta", False, False, 1),
    ("2.3 Dosing rules", False, False, 2), ("1.2.3.4.5.6.7 Deep title", False, False, 6),
    ("11 countries of the region are endemic for it and more besides", False, False, 0),
    ("1991 are shown in Figure. One more", False, False, 0), ("3. Ends with stop.", False, False, 0),
    ("CASE DEFINITION", False, False, 1), ("V +", False, False, 0), ("12 A n 18 80Ng t", False, False, 0),
    ("Standing alone", True, True, 2), ("Standing alone", True, False, 0), ("Ends like this:", True, True, 0),
    ("lower case", True, True, 0), ("x" * 111, True, True, 0), ("", True, True, 0),
])
def test_text_levels(spark, line, prev, nxt, level):
    row = spark.createDataFrame([(line, prev, nxt)], "t string, p boolean, n boolean")
    assert row.select(headings.text_level(F.col("t"), F.col("p"), F.col("n")).alias("l")).first()["l"] == level


def test_numbered_sections_nest_and_carry_pages(spark):
    rows, doc = parse(spark, "1. Alpha\nbody one\n1.1 Beta thing\nbeta body\fmore beta\n2. Gamma Ray\ngamma text")
    assert [(r.path, r.page_start, r.page_end) for r in rows] == [
        ("1. Alpha", 1, 1), ("1. Alpha > 1.1 Beta thing", 1, 2), ("2. Gamma Ray", 2, 2),
    ]
    assert rows[1].text == "beta body\nmore beta" and doc.n_pages == 2


def test_marker_moves_the_rest_of_its_page_only(spark):
    rows, _ = parse(spark, "1. Alpha beta\na\n[[page 9]]\nb\fc")
    assert (rows[0].page_start, rows[0].page_end) == (1, 2)
    rows, _ = parse(spark, "a\f<page 40>\nb")
    assert (rows[0].page_start, rows[0].page_end) == (1, 40)


def test_marker_without_form_feed_gives_no_page(spark):
    rows, doc = parse(spark, "page 7\n1. Alpha beta\nbody")
    assert [(r.path, r.page_start, r.page_end) for r in rows] == [("1. Alpha beta", 0, 0)]
    assert doc.n_pages == 1 and doc.n_chars == 100


def test_text_before_any_heading_and_front_matter(spark):
    rows, _ = parse(spark, "opening words\nREFERENCES\none two\nTREATMENT\ngive it\n## Dose:\nfive")
    assert [(r.seq, r.path, r.text) for r in rows] == [
        (0, "Body", "opening words"), (1, "TREATMENT", "give it"), (2, "TREATMENT > Dose:", "five"),
    ]


def test_empty_and_missing_documents(spark):
    docs = spark.createDataFrame([("a", ""), ("b", None), ("c", "\n \f\n")], "doc_id string, text string")
    out = {r.doc_id: (r.n_pages, r.n_chars, len(r.sections)) for r in sections_text.parse_text(docs).collect()}
    assert out == {"a": (1, 0, 0), "c": (2, 0, 0)}


def test_paths_keep_the_last_four_levels(spark):
    text = "\n".join(f"{'#' * i} L{i} name\nbody{i}" for i in range(1, 7))
    rows, _ = parse(spark, text)
    assert rows[-1].path == "L3 name > L4 name > L5 name > L6 name" and rows[-1].heading_level == 6
    assert rows[1].path == "L1 name > L2 name"


def lines(spark, rows):
    full = [("d", i, *r, *([1] if len(r) == 4 else [])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id string, line_no long, text string, page int, size double, bold boolean, block_lines int")


def test_body_size_is_weighted_by_characters_and_first_seen_wins(spark):
    rows = [("ab", 1, 12.0, False), ("cd", 1, 9.0, False), ("x" * 3, 1, 30.0, False)]
    assert sections_lines.body_size(lines(spark, rows)).first()["body"] == 30.0
    assert sections_lines.body_size(lines(spark, rows[:2])).first()["body"] == 12.0


def test_furniture_needs_three_pages(spark):
    three = lines(spark, [("Running Head ", p, 10.0, False) for p in (1, 2, 3)] + [("once", 1, 10.0, False)])
    assert [r.furniture for r in sections_lines.furniture(three, sections_lines.page_counts(three)).collect()] == ["running head"]
    two = lines(spark, [("Running Head", p, 10.0, False) for p in (1, 2, 2)])
    assert sections_lines.furniture(two, sections_lines.page_counts(two)).count() == 0


BODY = "This is a sentence of body text that carries most of the characters of the page, plain and long enough."


def test_nesting_page_numbers_and_own_block_rule(spark):
    rows = [
        ("Disease", 1, 18.0, True), (BODY, 1, 10.0, False), ("Diagnosis", 1, 13.0, True), (BODY * 3, 1, 10.0, False),
        ("drug name", 1, 10.0, True, 4), ("Page 1 of 3", 1, 10.0, False), ("Tests:", 1, 11.5, False),
        (BODY * 3, 1, 10.0, False), ("Treatment", 2, 13.0, True), (BODY * 3, 2, 10.0, False),
    ]
    out = [(r.path, r.page_start, r.page_end) for r in sections_lines.parse_lines(lines(spark, rows)).orderBy("seq").collect()]
    assert out == [
        ("Disease", 1, 1), ("Disease > Diagnosis", 1, 1), ("Disease > Diagnosis > Tests", 1, 1), ("Treatment", 2, 2),
    ]


def test_prominent_heading_opening_a_page_starts_a_chapter(spark):
    rows = [
        ("Fever", 1, 18.0, True), (BODY * 3, 1, 10.0, False),
        ("Empyema", 2, 16.0, True), (BODY * 3, 2, 10.0, False), ("Hernia", 2, 16.0, True), (BODY * 3, 2, 10.0, False),
    ]
    out = [r.path for r in sections_lines.parse_lines(lines(spark, rows)).orderBy("seq").collect()]
    assert out == ["Fever", "Empyema", "Hernia"]


def test_cover_page_of_a_long_document_is_not_structure(spark):
    rows = [("BIG TITLE", 1, 40.0, True), ("Topic", 2, 18.0, True), (BODY, 2, 10.0, False)] + [
        (BODY + str(p), p, 10.0, False) for p in (3, 4, 5)
    ]
    out = [(r.path, r.text[:9]) for r in sections_lines.parse_lines(lines(spark, rows)).orderBy("seq").collect()]
    assert out == [("Front cover", "BIG TITLE"), ("Topic", BODY[:9])]
    short = [r for r in rows if r[1] <= 4]
    assert [r.path for r in sections_lines.parse_lines(lines(spark, short)).orderBy("seq").collect()] == ["Topic"]


def test_short_siblings_fold_and_the_path_climbs(spark):
    long = "w" * 250
    sections = spark.createDataFrame(
        [
            ("d", 1, "A > B > C", 1, 1, long, 3, False), ("d", 2, "A > B > D", 2, 3, "short", 3, False),
            ("d", 3, "A > B > E", 3, 3, "short too", 3, False), ("d", 4, "A > F", 4, 4, "tiny", 2, False),
            ("d", 5, "G", 5, 5, "alone", 1, False), ("d", 6, "Contents", 5, 5, "front", 1, True),
        ],
        "doc_id string, section long, path string, page_start int, page_end int, text string, heading_level int, front boolean",
    )
    out = [(r.seq, r.path, r.page_end, r.text[-24:]) for r in sections_lines.fold_short(sections).orderBy("seq").collect()]
    # D joins C and lifts the path to A > B. E's parent is A > B, the group's now A, so E stays; F's
    # parent is A while E's is A > B, so F stays too.
    assert [(s, p, e) for s, p, e, _ in out] == [(0, "A > B", 3), (1, "A > B > E", 3), (2, "A > F", 4), (3, "G", 5)]
    assert out[0][3].endswith("D: short")


def test_matches_a_plain_walk_over_random_lines(spark):
    """Headings, resets and stack against a straightforward loop."""
    import random

    rng = random.Random(3)
    rows = []
    for page in range(1, 4):
        for _ in range(25):
            size = rng.choice([10.0, 10.0, 10.0, 12.0, 14.0, 18.0])
            rows.append((rng.choice(["Alpha", "Beta", "Gamma", "Delta"]) + str(rng.random())[2:6] if size > 10 else BODY + str(rng.random()), page, size, False))
    headed = sections_lines.headed_lines(lines(spark, rows))
    got = {(r.section): r.path for r in sections_lines.raw_sections(headed).collect()}
    stack, number, want, seen_page, has_body = [], 0, {}, set(), set()
    for text, page, size, _ in rows:
        leads = page not in seen_page
        seen_page.add(page)
        if size >= 11.2:
            number += 1
            if leads and size >= 11.5:
                stack = []
            stack = [e for e in stack if e[0] > size] + [(size, text)]
            want[number] = " > ".join(t for _, t in stack[-4:])
        else:
            has_body.add(number)
    assert got == {n: want.get(n, "Preamble") for n in has_body}


def test_lone_letters_are_told_as_by_the_plain_pattern(spark):
    import random

    rng = random.Random(5)
    signs = ["a", "B", "é", "\U00010400", "\U0001D400", " ", "\u3000", "\xa0", "1", ".", "\u4e00", "\U0001F600", "e\u0301"]
    rows = spark.createDataFrame([("".join(rng.choice(signs) for _ in range(rng.randint(0, 14))),) for _ in range(3000)], "x string")
    plain = F.regexp_count("x", F.lit(rf"(?<!{headings.VISIBLE})\p{{L}}(?!{headings.VISIBLE})"))
    assert rows.where(plain >= 2).count() > 100
    assert rows.where(plain != F.regexp_count("x", F.lit(headings.LONE_LETTER))).count() == 0


def test_page_markers_of_every_kind_move_the_page(spark):
    text = "first line\n[[ page 7 ]]\nsecond line\n\fPAGE 99999999999\nthird line\npage x\n< page 12 >\nfourth line"
    lines = sections_text.text_lines(spark.createDataFrame([("d", text)], "doc_id string, text string")).first().lines
    assert [(x.text, x.page) for x in lines] == [
        ("first line", 1), ("second line", 7), ("third line", 2), ("page x", 2), ("fourth line", 12)]
