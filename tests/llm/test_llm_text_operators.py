"""Byte BPE, the quality classifier, packing, and repeated passages beside brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundwell.llm import byte_bpe, compression_quality, grouped_packing, queries, radix_repeats

ODD = [(1, None), (2, ""), (3, "plain text here"), (3, "plain text here"), (None, "no key"), (4, "é" * 3000), (5, "a" * 30_000), (6, " \n\t  ")]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("score", F.lit("x")).withColumn("key", F.lit(None).cast("string")).withColumn("fp", F.lit(1)) if extra else df


@pytest.fixture(scope="module")
def coder():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.TreeBpe(ranks, public_tokenizers.PATTERN), known


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300) | st.text(alphabet="ab =é\n", max_size=600))
def test_tree_encoding_equals_the_library(coder, text):
    ours, known = coder
    ids = memoryview(ours.encode(text)).cast("I")
    assert list(ids) == known.encode_ordinary(text) and ours.decode(ids).decode() == text


@pytest.mark.parametrize("text", ["=" * 5000, "ab" * 4000, " " * 4001, "日本" * 2000])
def test_tree_encoding_of_long_matches(coder, text):
    assert list(memoryview(coder[0].encode(text)).cast("I")) == coder[1].encode_ordinary(text)


def test_encode_decode_rows(spark, coder):
    ours = byte_bpe.encode_decode(frame(spark, ODD), coder[0].ranks, public_tokenizers.PATTERN)
    got = sorted(map(tuple, ours.collect()), key=repr)
    want = []
    for key, text in ODD:
        ids = np.array(coder[1].encode_ordinary(text or ""), "<u4")
        want.append((key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert byte_bpe.encode_decode(frame(spark, []), coder[0].ranks, public_tokenizers.PATTERN).count() == 0


def junk(rng):
    return " ".join(f"{rng.choice(['ZQ', 'XK', 'VV'])}{rng.randrange(90)}!!" for _ in range(60))


def prose(rng):
    return " ".join(rng.choice("the of and house river walks slowly under green old trees with her".split()) for _ in range(60))


def test_quality_scores_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, (prose if i % 3 else junk)(rng)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(7, None), (None, 1)], "doc_id long, quality int")
    docs = frame(spark, rows + [(1000, None), (1001, ""), (None, "x"), (5, rows[5][1])])
    model = queries.quality_model(docs, labels)
    got = {(r.doc_id, r.score) for r in compression_quality.score(docs, model).collect()}
    held = {i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [(score >= 0.3) == (key % 3 > 0) for key, score in got if key in held]
    assert len(right) == len(held) and sum(right) / len(right) >= 0.95 and all(0 <= s <= 1 for _, s in got)
    kept = compression_quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (1000, 1001)").count() == 2
    bare = compression_quality.fit(docs, labels.limit(0))
    assert compression_quality.score(docs, bare).count() == docs.count() and compression_quality.score(docs.limit(0), bare).count() == 0


def test_held_out_labels_never_matter(spark):
    rng = random.Random(2)
    docs = frame(spark, [(i, (prose if i % 2 else junk)(rng)) for i in range(80)])
    one = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    other = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    assert queries.quality_model(docs, one) == queries.quality_model(docs, other)


@pytest.fixture(scope="module")
def definition():
    return queries.word_tokenizer()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=120) | st.text(alphabet="aB'sé½_-. \n1İ", max_size=120))
def test_word_tokenizer_equals_the_library(definition, text):
    known = Tokenizer.from_str(definition)
    assert list(memoryview(grouped_packing.WordTokenizer(definition).encode([text])[0]).cast("I")) == known.encode(text, add_special_tokens=False).ids


def test_packing_places_every_piece_once(spark, definition):
    rng = random.Random(3)
    rows = ODD + [(100 + i, " ".join(rng.choice(["tree", "house", "x9", "über"]) for _ in range(rng.choice([3, 40, 900, 2500, 4095, 4096, 9000])))) for i in range(60)]
    got = grouped_packing.pack(frame(spark, rows), definition).collect()
    known, end = Tokenizer.from_str(definition), np.array([1], "<u4")
    want = []
    for key, text in rows:
        ids = np.append(np.array(known.encode(text or "", add_special_tokens=False).ids, "<u4"), end).astype("<u4")
        want += [(key, p, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) <= -(-sum(r.length for r in got) // 4096) + 2
    assert grouped_packing.pack(frame(spark, []), definition).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_fits_and_is_near_best_fit(counts):
    runs = grouped_packing.plan(counts, 64)
    filled, placed = {}, {}
    for length, first, number, sequence, offset in runs.tolist():
        for i in range(number):
            filled.setdefault(sequence + i, []).append((offset, length))
            placed.setdefault(length, set()).add(first + i)
    assert {n: len(x) for n, x in placed.items()} == counts
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    rooms = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=rooms.__getitem__)] -= n
        else:
            rooms.append(64 - n)
    assert len(filled) <= 1.1 * len(rooms) + 2


def brute_repeats(rows, width=50):
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - width + 1 if key is not None else 0):
            first[data[i:i + width]] = min(key, first.get(data[i:i + width], key))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data) + 1)
        for i in range(len(data) - width + 1 if key is not None else 0):
            if first[data[i:i + width]] < key:
                gone[i:i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for i in range(len(data)) if gone[i] and not (i and gone[i - 1]))
        out.append((key, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab cdé") for _ in range(400)) for _ in range(3)]
    rows = ODD + [(7, "a" * 49), (8, "a" * 50), (9, "a" * 200), (10, "ab" * 100), (-5, base[0]), (11, base[0]), (12, base[0])]
    for i in range(60):
        a, b = rng.randrange(300), rng.randrange(300)
        rows.append((20 + 3 * i, rng.choice(base)[a:a + rng.choice([30, 49, 50, 51, 80, 150])] + "x" * rng.choice([0, 1, 5, 60]) + rng.choice(base)[b:b + rng.choice([40, 50, 60, 100])]))
    got = radix_repeats.repeats(frame(spark, rows).repartition(4)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_repeats(rows), key=repr)


def test_repeats_move_the_texts_once(spark):
    rows = [(i, f"text {i} " + "the same long passage stands in all of these documents, word by word " * (i % 3), "en") for i in range(30)]
    docs = spark.createDataFrame([*rows, (None, "x" * 200, "en"), (31, None, None)], "doc_id long, text string, lang string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for carry in (None, ("lang",)):
            out = radix_repeats.repeats(docs, carry=carry)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("REPARTITION_BY_COL") == 2 and plan.count("ReusedExchange") == 1  # one exchange, named by both readers
            assert out.count() == 32 and out.where("doc_id is null").first().n_removed == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_repeats_of_nothing(spark):
    assert radix_repeats.repeats(frame(spark, [])).count() == 0
    assert [r.n_removed for r in radix_repeats.repeats(frame(spark, [(1, None)])).collect()] == [0]
