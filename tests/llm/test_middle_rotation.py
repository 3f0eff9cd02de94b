"""Fill-in-middle by block rotation beside plain slicing of the units."""

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwell.llm import middle_rotation as mr
from groundwell.llm.queries import op13_middle_rotation


def sliced(key, text, seed=1, plain=10, spm=20):
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z<>PSM\né漢\U0001f600"), max_size=40), st.integers(0, 5000))
def test_arranged_equals_sliced_and_goes_back(text, key):
    n, form, prefix, middle, out = mr.arrange(text.encode(), mr.draws(key, 1), 10, 20)
    assert (n, form, prefix, middle, out.decode()) == sliced(key, text)
    assert mr.rebuild(bytes(out), form).decode() == text


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 200_001])
def test_rotation_in_place(size, monkeypatch):
    monkeypatch.setattr(mr, "SWAP_BYTES", 1000)
    data = bytearray(i * 7 % 251 for i in range(size))
    for cut in {0, size // 3, size // 2, size}:
        turned = bytearray(data)
        mr.rotate(turned, 0, cut, size)
        assert turned == data[cut:] + data[:cut]


def test_frames_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "no key at all"), (4, "has <M> inside"), (5, "x" * 300_000 + " é" * 100_000)]
    rows += [(i, f"words of number {i}, é漢") for i in range(10, 300)]
    docs = spark.createDataFrame([(k, t, "f", "o") for k, t in rows], "doc_id long, text string, form string, output string")
    got = mr.restore(mr.transform(docs)).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == Counter(
        (k, *sliced(k, t or ""), t or "") for k, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert mr.restore(mr.transform(docs.limit(0))).count() == 0
    other = {r.doc_id: r.output for r in mr.transform(docs, seed=2, plain_share=0, spm_share=100).collect()}
    assert other[10] == sliced(10, rows[7][1], 2, 0, 100)[4]
    with pytest.raises(ValueError):
        mr.restore(mr.transform(docs), restored="form")


def test_query_digests(spark, tmp_path):
    texts = {i: f"Doc {i}: some words,\nand more" * (i % 4) for i in range(200)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op13_middle_rotation(spark, str(tmp_path)).collect():
        n, form, prefix, middle, out = sliced(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
