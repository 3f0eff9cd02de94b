"""Block-wise compression by dictionaries of one size, and scores of the gap between them alone."""

import random

import numpy as np

from groundwell.llm import compression_quality as quality


def texts(seed, words, lengths):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(n)).encode() for n in lengths]


def vocabulary(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(n)]


def test_dictionaries_of_one_size():
    good, bad = texts(1, vocabulary(1, 3000), [150] * 600), texts(2, vocabulary(2, 200), [60] * 60)
    for model in (quality.fit_texts(good, bad), quality.fit_texts(good, bad[:1]), quality.fit_texts(good, [])):
        assert len(model.good) == len(model.bad) >= 8


def test_a_dictionary_helps_all_along_a_text():
    words = vocabulary(3, 3000)
    ours = " ".join(words).encode()
    text = texts(4, words, [20_000])[0]
    start, last = text[:quality.BLOCK_BYTES], text[-quality.BLOCK_BYTES:]
    saved = [quality.sizes([t], b"-" * 4096) - quality.sizes([t], ours) for t in (start, text)]
    blocks = len(text) / quality.BLOCK_BYTES
    assert saved[0] > 0 and saved[1] > 0.7 * blocks * saved[0] and quality.sizes([last], ours) < quality.sizes([last], b"-" * 4096)
    assert quality.sizes([b"", b"a"], ours).shape == (2,) and np.isfinite(quality.features([b"", text], ours, ours)).all()


def test_scores_rest_on_the_gap_alone():
    """Beside sizes from one frame a block, and a curve by grid search, written out plainly."""
    import math

    import zstandard

    good, bad = texts(5, vocabulary(5, 400), [90] * 80), texts(6, vocabulary(6, 400), [90] * 60)
    model = quality.fit_texts(good, bad)

    def size(text, content):
        total = 0
        for i in range(0, max(1, len(text)), quality.BLOCK_BYTES):
            made = zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
                                            dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            total += len(made.compress(text[i:i + quality.BLOCK_BYTES]))
        return total

    def gap(text):
        return (size(text, model.bad) - size(text, model.good)) / (len(text) + quality.FRAME_BYTES)

    others = texts(7, vocabulary(5, 400), [5, 90, 3000]) + texts(8, vocabulary(6, 400), [5, 90, 3000])
    slope, base = model.curve
    got = quality.scores(others, model)
    assert np.allclose(got, [1 / (1 + math.exp(-max(-30, min(30, slope * gap(t) + base)))) for t in others])
    assert (got[:3] > 0.5).all() and (got[3:] < 0.5).all() and quality.scores([b""], model)[0] == model.empty

    assert quality.fit_texts(good, []).curve[0] == 0 and quality.fit_texts(good, bad[:1]).curve[0] == 0
