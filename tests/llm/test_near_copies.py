"""Near copies beside brute-force Jaccard similarity."""

import random
from fractions import Fraction

import corpus_pipeline
from groundwell.llm import near_copies, simhash_groups


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_the_stage_equals_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "one two", "ONE  two"]
    for n in (12, 40, 120, 400):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(base))
            for share in (0.005, 0.01, 0.02, 0.03, 0.05):  # similarities from nearly one to below the bound
                copy = list(base)
                for at in rng.sample(range(n), max(1, int(share * n))):
                    copy[at] = rng.choice(words)
                texts.append(" ".join(copy))
    chain = [rng.choice(words) for _ in range(100)]  # a chain whose ends are not similar
    for i in range(8):
        texts.append(" ".join(chain[3 * i:] + [f"c{j}" for j in range(3 * i)]))
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    near = 0
    for a in range(len(texts)):
        for b in range(a):
            either = len(sets[a] | sets[b])
            if not either or Fraction(len(sets[a] & sets[b]), either) >= Fraction(4, 5):
                near += 1
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert near > 50 and {r.doc_id: r.component_id for r in near_copies.groups(df).collect()} == dict(enumerate(group))
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group)) and kept.columns == df.columns
    assert near_copies.groups(df.limit(0)).count() == 0


def test_short_texts_nulls_repeats_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", 40)
    rng = random.Random(2)
    rows = []
    for i in range(60):  # nine words and the first eight of them: a similarity of exactly 4/5, whatever their fingerprints
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words[:8]))]
    base = [f"b{i}" for i in range(60)]
    for i in range(80):  # many members of the same bands, most of them below the bound with each other
        copy = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3])):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((5000 + i, " ".join(copy)))
    rows += [(None, rows[0][1]), (None, "no key " * 9), (7, rows[2][1]), (7, rows[2][1]), (8, "long " * 50_000), (9, "long " * 50_001)]
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            either = len(sets[a] | sets[b])
            if Fraction(len(sets[a] & sets[b]), either) >= Fraction(4, 5):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    low = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    df = spark.createDataFrame([(k, t, 1, "n") for k, t in rows], "doc_id long, text string, node int, bands string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_copies.groups(df).collect())
    assert got == sorted((str(k), str(low[g])) for (k, _), g in zip(rows, group))
    assert len({g for g in group if rows[g][0] is not None and rows[g][0] >= 5000}) > 3


def test_the_stage_links_by_simhash_too(spark):
    """Texts within three bits are one group whatever their similarity, and a group goes on from SimHash links to similar sets."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(40):  # four words apart from one another: unlike by the bound, some of them within three bits
            copy = list(base)
            for at in rng.sample(range(120), 3):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    prints = [simhash_groups.fingerprint(t.encode()) for t in texts]
    sets = [shingles(t) for t in texts]
    group, only = list(range(len(texts))), 0
    for a in range(len(texts)):
        for b in range(a):
            near = (prints[a] ^ prints[b]).bit_count() <= 3
            alike = Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(4, 5)
            only += near and not alike and group[a] != group[b]
            if near or alike:
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    assert only
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_copies.groups(df, bits=3).collect()} == dict(enumerate(group))
    plain = {r.component_id for r in near_copies.groups(df).collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert kept == set(group) and kept < plain


def test_links_are_stored_before_they_are_contracted(spark, monkeypatch):
    """Comparing cells and contracting links in one task would hold two Python workers for each core."""
    given = []
    for module in (near_copies, simhash_groups):
        monkeypatch.setattr(module, "components", lambda edges, found=module.components: given.append(edges) or found(edges))
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h")], "doc_id long, text string")
    assert simhash_groups.groups(df).count() == near_copies.groups(df, bits=3).count() == 3
    for edges in (given[0], given[1]):
        assert "MapInArrow" not in edges._jdf.queryExecution().executedPlan().toString()
