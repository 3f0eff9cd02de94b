import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.config import Settings, write_calibration
from groundwell.operators import manifest
from groundwell.plans.ingest import CorpusNotClean, ingest
from groundwell.sources import files, vector_service
from groundwell.sources.embeddings import EmbeddingTable, hashing_embedder

SENT = "The regimen lasts six months and is supervised by a trained worker at the clinic. "


@pytest.fixture
def folder(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "TB_guide.txt").write_text("TUBERCULOSIS STANDARD CARE\n1. Diagnosis basics\n" + SENT * 30 + "\n2. Treatment basics\n" + SENT * 5)
    (raw / "tiny note.txt").write_bytes(b"# Short note here\nonly few \xff words")
    (raw / "skip.md").write_text("not read")
    return raw


def test_scan_lists_files_with_digest_and_title(spark, folder):
    rows = {r.filename: r for r in files.scan_folder(spark, str(folder)).collect()}
    assert set(rows) == {"TB_guide.txt", "tiny note.txt"}
    tb = rows["TB_guide.txt"]
    assert tb.doc_id == "tb-guide" and tb.title == "Tuberculosis Standard Care" and tb.url == "" and tb.specialty is None
    assert tb.sha256 == hashlib.sha256((folder / "TB_guide.txt").read_bytes()).hexdigest()
    assert rows["tiny note.txt"].title == "Short note here"


def test_title_falls_back_to_the_file_name(spark):
    row = spark.createDataFrame([("1\n22\n", "my_big-file.txt")], "t string, f string")
    assert row.select(manifest.text_title(F.col("t"), F.col("f")).alias("x")).first()["x"] == "My Big File"


def test_manifest_round_trip_and_diff(spark, folder, tmp_path):
    listed = files.scan_folder(spark, str(folder))
    path = tmp_path / "manifest.yaml"
    files.write_manifest(listed, str(path), source="test")
    again = files.read_manifest(spark, str(path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, listed.collect()))
    (folder / "TB_guide.txt").write_text("changed")
    (folder / "new.txt").write_text("new")
    (folder / "tiny note.txt").rename(folder / "renamed.txt")
    status = {r.filename: r.status for r in manifest.diff(again, files.read_folder(spark, str(folder))).collect()}
    assert status == {"TB_guide.txt": "changed", "new.txt": "unlisted", "renamed.txt": "unlisted", "tiny note.txt": "missing"}


def test_ingest_is_gated_and_reports_what_it_skipped(spark, folder, tmp_path):
    listed = files.scan_folder(spark, str(folder))
    texts = files.read_texts(spark, str(folder))
    done = ingest(listed, texts)
    chunks = done.chunks.orderBy("chunk_id").collect()
    assert {c.doc_id for c in chunks} == {"tb-guide"} and chunks[0].chunk_id == "tb-guide::0000::00"
    assert chunks[0].section_path == "TUBERCULOSIS STANDARD CARE > 1. Diagnosis basics" or chunks[0].section_path == "1. Diagnosis basics"
    assert {r.doc_id: r.reason for r in done.skipped.collect()} == {"tiny-note": "parsed but produced no chunks"}
    assert done.report.first().chunks == len(chunks)
    (folder / "extra.txt").write_text("extra")
    with pytest.raises(CorpusNotClean):
        ingest(listed, files.read_texts(spark, str(folder)))
    assert ingest(listed, files.read_texts(spark, str(folder)), strict=False).chunks.count() == len(chunks)

    out = str(tmp_path / "chunks")
    files.write_chunks(done.chunks, out)
    back = files.read_chunks(spark, out).orderBy("ord")
    assert [r.chunk_id for r in back.collect()] == [c.chunk_id for c in chunks]
    record = files.write_index_record(str(tmp_path / "index.json"), listed, back, len(chunks), "m", 8)
    assert record["counts"] == {"chunks": len(chunks), "inserted": len(chunks), "documents": 1, "skipped_documents": 1}
    assert json.loads((tmp_path / "index.json").read_text()) == record


def test_ingest_of_typeset_lines(spark):
    listed = spark.createDataFrame([("d", "T", "d.pdf", "", "", None, None, None, "", "h"), ("e", "E", "e.pdf", "", "", None, None, None, "", "h")],
        "doc_id string, title string, filename string, url string, publisher string, specialty string, version string, published string, license string, sha256 string")
    rows = [("d.pdf", "h", 0, "Dose", 1, 14.0, True, 1), ("d.pdf", "h", 1, SENT * 3, 1, 10.0, False, 1), ("e.pdf", "h", 0, "scan", 1, 10.0, False, 1)]
    lines = spark.createDataFrame(rows, "filename string, sha256 string, line_no long, text string, page int, size double, bold boolean, block_lines int")
    texts = spark.createDataFrame([], "filename string, sha256 string, text string")
    done = ingest(listed, texts, lines)
    assert [(c.doc_id, c.section_path, c.page_start) for c in done.chunks.collect()] == [("d", "Dose", 1)]
    assert done.skipped.first().reason.startswith("no extractable text layer (4 chars/page over 1 pages)")


def test_eval_cases(spark, tmp_path):
    path = tmp_path / "cases.yaml"
    files.write_starter_cases(str(path))
    rows = files.read_eval_cases(spark, str(path)).collect()
    assert {r.bucket for r in rows} == {"answerable", "unanswerable", "personalized", "emergency", "out_of_domain"}
    assert rows[0].expect_source == "Baking" and rows[0].note


def test_embedding_table_calls_the_provider_once_per_missing_text(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def provider(texts):
        calls.add(len(texts))
        assert len(texts) <= 128
        return np.array([[len(t), 1.0] for t in texts])

    table = EmbeddingTable(spark, str(tmp_path / "vectors"), "m", 2)
    rows = spark.createDataFrame([(i, "copy" if i % 2 else f"text {i}") for i in range(300)], "id int, text string")
    out = {r.id: list(r.vector) for r in table.embed(rows, provider).collect()}
    assert out[1] == [4.0, 1.0] and out[0] == [6.0, 1.0] and len(out) == 300 and calls.value == 151
    more = rows.unionByName(spark.createDataFrame([(900, "fresh")], "id int, text string"))
    assert table.embed(more, provider).count() == 301 and calls.value == 152


def test_hashing_embedder_depends_on_tokens_only(spark):
    embed = hashing_embedder(16)
    rows = spark.createDataFrame([("Alpha beta",), ("beta, ALPHA!",), ("",)], "t string").select(embed(F.col("t")).alias("v")).collect()
    assert list(rows[0].v) == list(rows[1].v) and sum(map(abs, rows[2].v)) == 0 and len(rows[2].v) == 16


def test_hashing_embedder_equals_a_plain_loop(spark):
    texts = ["one two two three", None, "", "x", " ".join(f"w{i % 37}" for i in range(500))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    embed = hashing_embedder(16)
    both = rows.select("i", embed(F.col("t")).alias("v"), embed.of_tokens(F.split("t", " ")).alias("w"))
    for r in both.collect():
        want = [0.0] * 16
        for word in (texts[r.i] or "").split():
            slot = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
            want[slot % 16] += 1.0 if slot // 16 % 2 == 0 else -1.0
        assert (r.v is None) == (texts[r.i] is None) and (r.v is None or list(r.v) == want)
        assert not texts[r.i] or list(r.w) == want


def test_vector_service_batches_and_halves(spark):
    assert vector_service.batch_size(3072) == 14 and vector_service.batch_size(10**9) == 1
    sizes = []

    def transport(method, url, payload, headers):
        n = len(payload["records"])
        sizes.append(n)
        return (413, {}) if n > 4 else (200, {})

    records = [{"vector": [0.0] * 3072, "n": i} for i in range(20)]
    assert vector_service.send(records, "u", {}, transport) == 20
    assert sizes == [14, 7, 3, 4, 7, 3, 4, 6, 3, 3]
    with pytest.raises(vector_service.ServiceError):
        vector_service.send(records, "u", {}, lambda *a: (500, {}))


def test_vector_service_from_tasks(spark):
    def transport(method, url, payload, headers):
        if url.endswith("/search"):
            return 200, {"results": [{"chunk_id": f"k{int(payload['vector'][0])}", "_distance": 0.5}] * payload["limit"]}
        if url.endswith("/tables"):
            return 200, {"tables": ["t"]}
        if url.endswith("/insert"):
            assert all(r["s"] == "" for r in payload["records"]) and headers["x-api-key"] == "key"
        return 200, {"count": 3}

    rows = spark.range(10).select("id", F.lit(None).cast("string").alias("s"), F.array(F.lit(1.0)).alias("vector"))
    assert vector_service.write_vectors(rows, "http://x/", "t", "key", transport) == 10
    service = vector_service.VectorService("http://x", "t", "key", transport)
    assert service.exists() and service.count() == 3
    asked = spark.createDataFrame([(1, [2.0]), (2, [5.0])], "qid int, vector array<double>")
    assert sorted((r.qid, r.chunk_id, r["rank"]) for r in service.search(asked, 2).collect()) == [(1, "k2", 1), (1, "k2", 2), (2, "k5", 1), (2, "k5", 2)]


def test_settings_fingerprint_and_calibration(tmp_path):
    base = Settings()
    assert len(base.fingerprint) == 16 and base.fingerprint == Settings().fingerprint
    assert Settings(retrieve_k=21).fingerprint != base.fingerprint and Settings(history_max_items=1).fingerprint == base.fingerprint
    path = tmp_path / "c.json"
    assert base.calibrated(path) == base
    write_calibration(path, 5.5, 4.0, {"answerable": [1.0]})
    tuned = base.calibrated(path)
    assert (tuned.confidence_threshold, tuned.corrective_threshold) == (5.5, 4.0)
