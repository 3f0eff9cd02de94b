"""Groups, urls, secrets, surrogates, searches and the pipeline beside brute force."""

import hashlib
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from groundwell.llm import (
    common,
    hashing_search,
    near_copies,
    ownership_secrets,
    projection_forest,
    redirect_urls,
    simhash_groups,
    surrogate_pii,
)
from groundwell.llm.oracle import SQL
from groundwell.llm.queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")


def closed(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(1, 80)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (-3, 2000), (2000, -3)]
    links += [(rng.randrange(6000, 6100), rng.randrange(6000, 6100)) for _ in range(70)]
    df = spark.createDataFrame([*links, (None, 1)], "a long, b long").repartition(5)
    got = {r.node: r.component for r in common.components(df).collect()}
    want = closed(links, {n for link in links for n in link})
    assert all(got.get(n, n) == c for n, c in want.items())
    assert common.components(df.limit(0)).count() == 0


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(300)]
    rows = [(1, None), (2, ""), (3, "One"), (4, "one two"), (5, "ONE\x0btwo\xa0x"), (None, ""), (3, "One")]
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.choice([3, 40, 400]))]
        rows += [(10 * i + 10, " ".join(text)), (10 * i + 11, "  ".join(text)), (10 * i + 12, " ".join([*text[:-1], "changed"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("component", F.lit(1))
    got = simhash_groups.groups(df.repartition(3)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    group = closed([(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 3], set(prints))
    low = {}
    for (key, _), p in zip(rows, prints):
        if key is not None:
            low[group[p]] = min(key, low.get(group[p], key))
    assert sorted(map(tuple, got), key=repr) == sorted([(k, f"{p:016x}", low[group[p]]) for (k, _), p in zip(rows, prints)], key=repr)
    kept = simhash_groups.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values())) and kept.columns == df.columns
    assert simhash_groups.groups(df.limit(0)).count() == 0


def test_near_links_of_a_crowded_cell(spark):
    rng = random.Random(6)
    base = rng.getrandbits(63)
    prints = {base ^ sum(1 << b for b in rng.sample(range(63), rng.choice([1, 2, 3, 6]))) for _ in range(700)} | {rng.getrandbits(63) for _ in range(300)}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = closed([(r.a, r.b) for r in simhash_groups.near_links(df).collect()], prints)
    listed = sorted(prints)
    assert got == closed([(a, b) for i, a in enumerate(listed) for b in listed[i + 1:] if (a ^ b).bit_count() <= 3], prints)


def test_urls_and_aliases(spark):
    rows = [
        (1, "http://a.example.net/en/x", None), (2, "https://a.net/q", '<link rel="canonical" href="https://b.org/y">'), (3, "http://b.org/y#top", ""),
        (4, "http://c.org/z", "<LINK rel=canonical href='/w'>"), (5, "http://c.org/w", '<meta http-equiv="refresh" content="0; url=http://x.example.com/de/1">'),
        (6, "http://c.org/fr/1", '<link rel="canonical" href="http://d.org/k">'), (7, "http://d.org/k", '<link href="http://bad.net/" rel="canonical">'),
        (8, None, "x"), (9, "no host", None), (9, "no host", None), (None, "HTTP://EN.Example.NET/en/", ""), (10, "http://net", ""), (11, "http://notnet.org/?a=http://b.net/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(0)).withColumn("a", F.lit(0))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in redirect_urls.judge(df).collect()}
    assert got == {
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "a.net", "/q", "net/", "block"), (3, "b.org", "/y", None, "block"),
        (4, "c.org", "/z", None, "block"), (5, "c.org", "/w", None, "block"), (6, "c.org", "/fr/1", "org/fr/", "allow"), (7, "d.org", "/k", None, "allow"),
        (8, "", "", None, "allow"), (9, "", "", None, "allow"), (None, "en.example.net", "/en/", "example.net/en/", "allow"),
        (10, "net", "", None, "allow"), (11, "notnet.org", "/", None, "allow"),
    }
    assert redirect_urls.judge(df).count() == len(rows) and redirect_urls.judge(df.limit(0)).count() == 0


BASE = [
    ("assign", re.compile("(?:" + "|".join(("[pP][aA][sS][sS][wW][oO][rR][dD]", "[pP][aA][sS][sS][wW][dD]", "[sS][eE][cC][rR][eE][tT]", "[tT][oO][kK][eE][nN]", "[aA][pP][iI]_?[kK][eE][yY]"))
     + """)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def test_secrets_and_owners(spark):
    copied, own = "Zz9" * 10, "Qw7" * 9
    rows = [(i, f"see {copied} here", f"s{i}", "en") for i in range(5)]
    rows += [(10, f"é token = \"{'ab' * 20}\" x {own} PASSWD:short Api_Key='abcdefghijkl'", "s1", "en"), (11, "AKIA1234567890ABCD AKIAX deadbeefdeadbeef0", None, None),
             (12, None, "s", "en"), (13, "", "s", "en"), (None, "token: \"no\" : \"abcdefghijklmnop\"", "s", "en"), (11, "AKIA1234567890ABCD AKIAX deadbeefdeadbeef0", None, None),
             (14, "deadbeef" * 3000 + " token=" + "x" * 20_000, "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("kind", F.lit(1)).withColumn("found", F.lit(1))
    got = {r.doc_id: r for r in ownership_secrets.digest_columns(ownership_secrets.scan(df)).collect()}
    for key, text, *_ in rows:
        spans = [(m.start(), o, f"{k}:{m.start()}:{m.end()}") for o, (k, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= n]
        listed = [s for *_, s in sorted(spans)]
        assert got[key].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [s for s in got[key].spans.split(",") if s and not s.startswith("owned")] == listed
    assert "owned" in got[10].spans and "owned" not in got[0].spans
    masked = {r.doc_id: r.text for r in ownership_secrets.mask_secrets(df).collect()}
    assert masked[10] == "é [SECRET]\" x [SECRET] PASSWD:short [SECRET]'" and masked[0] == rows[0][1] and masked[12] is None
    assert ownership_secrets.scan(df.limit(0)).count() == 0 and ownership_secrets.mask_secrets(df).count() == len(rows)


def test_surrogates_keep_people_apart_and_the_same(spark):
    rows = [(i, f"call +1 (476) 555-{1000 + i} or 476-555-{1000 + i}; u{i}@a.co U{i}@A.CO Mrs Anna Berg{chr(97 + i % 26)} ip 10.0.0.{i % 200 + 1}") for i in range(150)]
    rows += [(500, None), (501, ""), (None, "4111 1111 1111 1111"), (502, "Mr Bergb and FRAU Mr BERGB, г-жа Иванова"), (502, "plain 12:30 1.2.3 2024-01-02")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(1)).withColumn("plain", F.lit(1))
    got = {(r.doc_id, r.n_entities): r.text for r in surrogate_pii.replace(df, "k").collect()}
    assert len(got) == len(rows)
    shape = lambda t: re.sub(r"\d", "9", t)
    mails, phones = set(), set()
    for i in range(150):
        text = next(t for (k, _), t in got.items() if k == i)
        first, second = re.search(r"call \+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3}-\d{3}-\d{4});", text), re.findall(r"\S+@\S+", text)
        assert first[1] + "-" + first[2] == first[3] and second[0].upper() == second[1] and f"555-{1000 + i}" not in text and "Anna" not in text
        assert re.search(r"Mrs [A-Z][a-z]+a [A-Z][a-z]+", text) and shape(text)[:22] == shape(rows[i][1])[:22]
        mails.add(second[0])
        phones.add(first[3])
    assert len(mails) == len(phones) == 150
    assert got[502, 0] == rows[-1][1] and re.fullmatch(r"Mr (\w+) and FRAU Mr (\w+), г-жа [А-Яа-я]+", next(t for (k, n), t in got.items() if k == 502 and n))
    assert re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", got[None, 1])
    assert surrogate_pii.replace(df, "k").exceptAll(surrogate_pii.replace(df, "k")).count() == 0
    assert surrogate_pii.replace(df.limit(0), "k").count() == 0


def test_surrogates_of_a_crowded_format_stay_distinct(spark):
    letters = [chr(97 + i) for i in range(26)]
    df = spark.createDataFrame([("email", f"{a}@{b}.co") for a in letters for b in letters], "kind string, plain string")
    got = surrogate_pii.surrogates(df, "k").collect()
    assert len(got) == 676 and len({r.surrogate for r in got}) == 676


VECTORS = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [float("inf")] * 16)]


def vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16)).round(3)
    x[5:40] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows, spark.createDataFrame(rows + VECTORS + [rows[3], (None, rows[1][1])], "vec_id long, embedding array<float>").withColumn("leaf", F.lit(1)).withColumn("id", F.lit(2))


def test_forest_recall_and_order(spark):
    rows, df = vectors(spark, 800, 7)
    got = {}
    for r in projection_forest.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x, hits = np.array([v for _, v in rows], dtype=np.float32).astype(float), 0
    assert set(got) == set(range(0, 800, 20))
    for q, found in got.items():
        found.sort()
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:20]
        hits += len(set(best) & {v for _, v, _ in found})
        assert [r for r, *_ in found] == list(range(1, 21)) and all(abs(score[v] - s) < 1e-9 for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    assert hits / (20 * len(got)) >= 0.9
    few = {r.query_id: r for r in projection_forest.nearest(df.where("vec_id < 3")).collect()}
    assert set(few) == {0} and projection_forest.nearest(df.limit(0)).count() == 0


def test_forest_recall_on_the_given_vectors(spark):
    if not FOLDER.exists():
        pytest.skip("needs the generated tables")
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    got = {}
    for r in QUERIES["op4_projection_forest"](spark, str(FOLDER)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        hits += len(got[ids[i]] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_forest_recall_and_rows_told_at_20000_vectors(spark):
    rng = np.random.default_rng(17)
    x = rng.standard_normal((20_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1:2_000] = x[0]  # a tenth of all rows are one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in projection_forest.nearest(df, every=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    x, hits = x.astype(float), 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score.round(12)))[:20].tolist()
        if q < 2_000:
            assert [v for _, v in sorted(found)] == best
        hits += len({v for _, v in found} & set(best))
    assert len(got) == 100 and hits / 2_000 >= 0.9


def test_hashing_search_is_exact(spark):
    rng = random.Random(8)
    codes = {i: rng.getrandbits(63) for i in range(400)} | {i: 12345 for i in range(400, 460)} | {500: -1, 501: 0}
    df = spark.createDataFrame([*codes.items(), (3, codes[3]), (None, 7), (600, None)], "vec_id long, code long").withColumn("q", F.lit(1)).withColumn("segment", F.lit(1))
    got = {}
    for r in hashing_search.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.distance))
    for q in range(0, 502, 50):
        if q in codes:
            best = sorted(((codes[q] ^ c) & (2**64 - 1)).bit_count() * 10**6 + i for i, c in codes.items())[:10]
            assert sorted(got[q]) == [(n, b % 10**6, b // 10**6) for n, b in enumerate(best, 1)]
    assert hashing_search.nearest(df.limit(0)).count() == 0
    assert len(hashing_search.nearest(df.where("vec_id in (50, 51)")).collect()) == 2


@pytest.mark.skipif(not FOLDER.exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    answer = con.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in answer.fetchall())


@pytest.fixture(scope="module")
def odd_docs(spark):
    """The smallest documents with a null text, an empty one, a repeated row and columns whose names operators use themselves."""
    if not FOLDER.exists():
        pytest.skip("needs the generated tables")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.union(docs.limit(1)).union(docs.limit(1).select(F.lit(10**6).cast("long"), F.lit(None).cast("string"), "lang", "source", F.lit(0).cast("long")))
    docs = docs.union(docs.limit(1).select(F.lit(10**6 + 1).cast("long"), F.lit(""), "lang", "source", F.lit(0).cast("long")))
    return common.stored(docs.withColumn("rest", F.lit("r")).withColumn("kept", F.lit(1)).withColumn("node", F.lit(1)))


def test_pipeline_quality(spark, odd_docs):
    good = corpus_pipeline.quality(spark, odd_docs, str(FOLDER))
    bad = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 0").join(odd_docs, "doc_id").select("doc_id").collect()
    left = {r.doc_id for r in good.collect()}
    assert good.columns == odd_docs.columns and sum(r.doc_id in left for r in bad) <= len(bad) / 2 and len(left) >= 0.75 * odd_docs.count()


def test_pipeline_near_duplicates(spark, odd_docs):
    one = corpus_pipeline.near_duplicates(spark, odd_docs, str(FOLDER))
    groups = {r.doc_id: r.component_id for r in near_copies.groups(odd_docs).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(groups.values())) and one.columns == odd_docs.columns
    assert groups[10**6] == groups[10**6 + 1] and len(set(groups.values())) < odd_docs.count()


def test_pipeline_repeats(spark, odd_docs):
    whole = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    cut = corpus_pipeline.repeated_passages(spark, odd_docs, str(FOLDER))
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    assert all(r.n_chars == len(r.text or "") <= len(whole[r.doc_id]) for r in cut.collect())


def test_pipeline_secrets(spark, odd_docs):
    safe = corpus_pipeline.secrets(spark, odd_docs, str(FOLDER))
    assert safe.count() == odd_docs.count() and not any(re.search("[0-9a-f]{16}", r.text or "") for r in safe.collect())


def test_pipeline_packing(spark, odd_docs):
    assert {r.doc_id for r in corpus_pipeline.packing(spark, odd_docs, str(FOLDER)).collect()} == {r.doc_id for r in odd_docs.collect()}


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_an_empty_table(spark, odd_docs, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, odd_docs.limit(0), str(FOLDER)).count() == 0


def test_every_part_of_a_long_vector_counts(spark):
    rows = [(0, [1.0] * 64), (1, [1.0] * 64 + [-2.0] * 64), (2, [1.0] * 64 + [-0.5] * 64), (3, [-1.0] * 64 + [0.0] * 63 + [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.code for r in hashing_search.sign_codes(df).collect()}
    assert got == {0: -1, 1: 0, 2: -1, 3: -(2**63)}
