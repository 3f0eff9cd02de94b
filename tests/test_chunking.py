import random
import re

from pyspark.sql import functions as F

from groundwell.config import Settings
from groundwell.operators import chunking


def size(text):
    return len(re.findall(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]", text))


def plain_pack(sents, target, overlap):
    packs, run = [], []
    for s in sents:
        if not run and size(s) > target:
            packs.append([s])
            continue
        if run and sum(map(size, run)) + size(s) > target:
            packs.append(run)
            keep = len(run)
            while keep > 0 and sum(map(size, run[keep - 1:])) <= overlap:
                keep -= 1
            run = run[keep:]
        run = run + [s]
    return packs + [run] if run else packs


def random_text(rng):
    sents = []
    for _ in range(rng.randint(0, 40)):
        n = rng.choice([1, 3, 8, 20, 60, 400])
        sents.append("W" + " ".join(rng.choice("abcdef") * 3 for _ in range(n)) + ".")
    return " ".join(sents)


def test_packing_equals_a_plain_loop_and_loses_no_sentence(spark):
    rng = random.Random(1)
    texts = [random_text(rng) for _ in range(120)] + [""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for target, overlap in ((320, 48), (50, 10), (20, 0)):
        got = {r.id: r.p for r in rows.select("id", chunking.pack_sentences(F.col("text"), target, overlap).alias("p")).collect()}
        for i, text in enumerate(texts):
            sents = [s for s in re.split(r"(?<=[.!?:])\s+(?=[A-Z(])|\n+", text) if s.strip()]
            packs = plain_pack(sents, target, overlap)
            assert got[i] == [" ".join(p) for p in packs]
            assert {s for p in packs for s in p} == set(sents)


def test_short_tail_joins_and_tiny_piece_leaves_a_gap(spark):
    body = " ".join(["Sentence with exactly seven tokens here."] * 60) + " Tail end."
    sections = spark.createDataFrame(
        [("d", 0, "P", 1, 2, body, 1), ("d", 1, "Q", 2, 2, "Too small.", 1)],
        "doc_id string, seq int, path string, page_start int, page_end int, text string, heading_level int",
    )
    out = chunking.chunk_sections(sections).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in out] == ["d::0000::00", "d::0000::01"]
    assert out[-1].text.endswith("Tail end.") and all(r.n_tokens == size(r.text) for r in out)


def test_another_counter_can_be_plugged_in(spark):
    sections = spark.createDataFrame([("d", 0, "P", 0, 0, "One two. Three four. Five six.", 1)],
        "doc_id string, seq int, path string, page_start int, page_end int, text string, heading_level int")
    settings = Settings(chunk_target_tokens=12, chunk_overlap_tokens=0, chunk_min_tokens=0, chunk_drop_below_tokens=0)
    out = chunking.chunk_sections(sections, settings, counter=F.length)
    assert [r.text for r in out.orderBy("piece").collect()] == ["One two.", "Three four.", "Five six."]


def test_chunk_records_carry_provenance(spark):
    sections = spark.createDataFrame([("d", 3, "A > B", 4, 5, "word " * 30, 2)],
        "doc_id string, seq int, path string, page_start int, page_end int, text string, heading_level int")
    manifest = spark.createDataFrame(
        [("d", "T", "d.txt", "u", "p", None, "v2", None, "l", "x")],
        "doc_id string, title string, filename string, url string, publisher string, specialty string, version string, published string, license string, sha256 string",
    )
    row = chunking.as_chunk_records(chunking.chunk_sections(sections), manifest).first()
    assert (row.chunk_id, row.title, row.source_url, row.doc_version, row.section_path) == ("d::0003::00", "T", "u", "v2", "A > B")
    assert len(row) == 14


def test_packing_time_follows_the_number_of_sentences():
    import time

    rng = random.Random(3)
    took = {}
    for n in (8_000, 32_000):
        sizes = [rng.choice([1, 3, 8, 20, 60, 400]) for _ in range(n)]
        best = []
        for _ in range(5):
            start = time.perf_counter()
            spans = chunking.packed_spans(sizes, 320, 48)
            best.append(time.perf_counter() - start)
        took[n] = min(best)
        assert {i for a, b in spans for i in range(a, b)} == set(range(n))
    assert took[32_000] <= 5 * took[8_000]


def test_sections_are_split_into_sentences_once(spark):
    sections = spark.createDataFrame([("d", 0, "One. Two.")], "doc_id string, seq int, text string")
    plan = chunking.chunk_sections(sections)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.!?:])") == 1
