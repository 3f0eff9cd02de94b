"""Scores by deleted interpolation beside a plain model of dictionaries and loops."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.llm import deleted_interpolation as di
from groundwell.llm.queries import op11_deleted_interpolation

END = ""


def tokens(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\r\x0b\x0c":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out + ([word] if word else []) + [END]


def bucket(n):
    return n.bit_length() if n else 0


def plain(rows, rounds=di.ROUNDS):
    """rows: (key, text, learn, deleted). (key, tokens, known, N, base, score) of each."""
    one, two, kept_one, kept_two, events = Counter(), Counter(), Counter(), Counter(), []
    for _, text, learn, deleted in rows:
        seen = tokens(text)
        pairs = list(zip([END, *seen], seen))
        if learn:
            one.update(seen), two.update(pairs)
            if deleted:
                events += pairs
            else:
                kept_one.update(seen), kept_two.update(pairs)
    n, v, kn, kv = sum(one.values()), len(one), sum(kept_one.values()), len(kept_one)
    weights = defaultdict(lambda: di.START)
    weights[0] = di.UNSEEN
    first = True
    for _ in range(rounds):
        sums = defaultdict(lambda: [0.0] * 3)
        for h, w in events:
            c = kept_one[h]
            p = [1 / (kv + 1), kept_one[w] / max(kn, 1), kept_two[h, w] / max(c, 1)]
            parts = [a * b for a, b in zip(weights[bucket(c)], p)]
            for i in range(3):
                sums[bucket(c)][i] += parts[i] / sum(parts)
        after = {}
        for b, s in sums.items():
            s = [s[0] + 1, s[1] + 1, s[2] + 1 if b else 0.0]
            after[b] = tuple(x / sum(s) for x in s)
        moved = max((abs(x - y) for b in after for x, y in zip(after[b], di.START if first else weights[b])), default=0)
        weights.update(after)
        first = False
        if moved < di.SETTLED:
            break
    table = [weights[0] if 0 in weights else di.UNSEEN]
    learned = {b for b in weights if b and events and b in after}
    for b in range(1, 66):
        table.append(weights[b] if b in learned else (table[b - 1] if b > 1 else di.START))
    if not n:
        table = [(1.0, 0.0, 0.0)] * 66
    out = []
    for key, text, _, _ in rows:
        seen = tokens(text)
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in seen)
        total = 0.0
        for h, w in zip([END, *seen], seen):
            mix = table[bucket(one[h])]
            total += math.log10(mix[0] / (v + 1) + mix[1] * one[w] / max(n, 1) + mix[2] * two[h, w] / max(one[h], 1))
        out.append((key, len(seen), sum(one[w] > 0 for w in seen), n, base, total))
    return out


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["The", "é", "漢", " x"]
    out = []
    for i in range(n):
        at, text = rng.randrange(80), []
        for _ in range(rng.randrange(0, 40)):
            at = (at * 7 + rng.choice([1, 2, 3])) % 84
            text.append(words[at])
        out.append((i, rng.choice([" ", "\n", "\t "]).join(text), i % 7 != 2, i % 5 == 0))
    return out


def same(got, want):
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)


def scored(spark, rows):
    docs = spark.createDataFrame([(k, t, a, b, "n", 1) for k, t, a, b in rows], "doc_id long, text string, learn boolean, gone boolean, tokens string, lot int")
    found = di.score(docs, F.col("learn"), F.col("gone"))
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_equals_the_plain_model(spark, monkeypatch, small):
    if small:  # many lots and shards
        monkeypatch.setattr(di, "LOT_BYTES", 300)
        monkeypatch.setattr(di, "SHARD_BYTES", 1500)
    rows = corpus(200) + [(300, None, True, True), (301, "", True, False), (302, "Unknown words only", False, False), (None, "w1 w2", True, None), (3, "w1 w1", True, True)]
    rows += [(400 + i, "same text here again", i % 2 == 0, False) for i in range(9)] + [(500, "long " * 30_000, None, False)]
    want = plain([(k, t, bool(a), bool(b)) for k, t, a, b in rows])
    same(scored(spark, rows), sorted(want, key=repr))


def test_nothing_to_learn_nothing_deleted_and_empty(spark):
    rows = [(1, "a b", False, False), (2, None, False, True)]
    got = scored(spark, rows)
    same(got, plain(rows))
    assert all(g[4] == 0 and g[5] == 0 for g in got)
    rows = [(1, "a b a", True, False), (2, "b a", True, False), (3, "c", False, False)]
    same(scored(spark, rows), plain(rows))
    assert scored(spark, []) == []


def test_estimates_after_a_context_sum_to_one(spark):
    rows = corpus(120, 4)
    one = Counter(w for _, t, a, _ in rows if a for w in tokens(t))
    asked = [("w1", w) for w in [*one, "never"]]
    # log10 P(w | w1) is what one more token adds to a text of w1
    texts = [(1000, "w1", False, False)] + [(1001 + i, f"w1 {w}" if w != END else "w1", False, False) for i, (_, w) in enumerate(asked)]
    got = {g[0]: g[5] for g in scored(spark, rows + texts)}
    model = {r[0]: r[5] for r in plain(rows + texts)}
    assert all(math.isclose(got[k], model[k], rel_tol=1e-9) for k in got)


def test_mixture_beats_its_parts_on_held_out_text(spark, tmp_path):
    rows = [(i, t) for i, t, _, _ in corpus(400, 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_deleted_interpolation(spark, str(tmp_path)).collect()
    marks = {k: zlib.crc32(str(k).encode()) for k, _ in rows}
    want = {w[0]: w for w in plain([(k, t, marks[k] % 7 != 2, marks[k] // 7 % 8 == 0) for k, t in rows])}
    assert sorted(r.doc_id for r in found) == sorted(want)
    for r in found:
        assert r.held_out == (marks[r.doc_id] % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][1:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9) and math.isclose(r.score, want[r.doc_id][5], rel_tol=1e-9)
    left = [r for r in found if r.held_out]
    assert sum(r.score for r in left) > sum(r.base_score for r in left)
