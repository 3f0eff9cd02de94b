"""Near copies: SimHash groups, widened by texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

On request the groups of `simhash_groups` come first: fingerprints that differ in so many bits link, as there, whatever
else holds. Fingerprints of texts of a similarity of 0.8 differ in some ten bits of 64. No part of the popcount grid is
selective at that radius, so links beyond it are looked for where one of `BANDS` digests of `ROWS` least hashes each is
equal (a pair of similarity 0.8 is missed with a chance of (1 - 0.8^4)^24, 3 in a million). Among these candidates the
SimHash says which to try first; every such link is checked by its exact similarity, and no pair of candidates is left
out for its bits.

Tables hold a few numbers per text. Only texts that share a band with another one have their shingles made again, from the
text. Each text is first compared with the nearest of its bands' first and then last members, so that a large group
becomes one component by as many pairs as it has texts. What is left, members of a band in different components, is
compared in blocks of bounded size, each text once per block and not once per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_texts, components, forget, gives_back, spanning_edges, stored
from .simhash_groups import SEED, fingerprint, keep_heads, near_links

SHINGLE, BANDS, ROWS = 5, 24, 4
#: Shingle hashes of one Arrow batch, and hashes that are multiplied at once.
BATCH_HASHES, LOT = 1 << 19, 4096
#: Shingles of one side of a block of comparisons.
BLOCK_SHINGLES = 1 << 20
_RANDOM = np.random.default_rng(SEED)
_FLIP, _TIMES = (_RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Hashes of a UTF-8 text's word shingles, letters A-Z lower-cased, words parted by ASCII white space; fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    first, last = [0, *ends[:-1].tolist()], (ends - 1).tolist()
    return np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(first, last[SHINGLE - 1:])], dtype=np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """A digest of each band's least hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), LOT):
        least = np.minimum(least, ((hashes[None, i:i + LOT] ^ _FLIP) * _TIMES).min(axis=1))
    return [xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))]


def digest(hashes: np.ndarray) -> np.int64:
    """Names a set of shingles."""
    return np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, node (digest of the set of shingles), fp (SimHash), n (size of the set), bands of each whole text. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch_texts(batch.column(1)):
                every = shingles(text)
                distinct = np.unique(every)
                fp = np.uint64(fingerprint(text)).view(np.int64)
                met = np.array(bands(distinct) if len(every) else [], dtype=np.uint64).view(np.int64)
                rows.append((digest(distinct), fp, len(distinct), met))
            if rows:
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "node", "fp", "n", "bands"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, node long, fp long, n int, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """node, shingles (the set, sorted) of the wanted nodes (node, low), made again from the text of the row whose key is `low`.

    A key may have several texts; only one that gives the node counts. Nodes without a key come from the rows without one.
    """
    by_key = docs.select(F.col(key).alias("low"), F.col(text).alias("text")).join(wanted.hint("shuffle_hash"), "low").select("node", "text")
    without = docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("node"), F.col(text).alias("text"))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found, held = [], [], 0
            for node, text in zip(batch.column(0).to_pylist(), batch_texts(batch.column(1))):
                distinct = np.unique(shingles(text))
                if node is None or node == digest(distinct):
                    nodes.append(digest(distinct))
                    found.append(distinct.view(np.int64))
                    held += len(distinct)
                if held >= BATCH_HASHES:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])
                    nodes, found, held = [], [], 0
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    return by_key.union(without).mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _may(a: Column, b: Column) -> Column:
    """Whether two members of a band, (node, fp, n), may be similar: sets of like size."""
    return F.least(a["n"], b["n"]) * 5 >= F.greatest(a["n"], b["n"]) * 4


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_of_a")).hint("merge")
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_of_b")).hint("merge")
    common = F.size(F.array_intersect("_of_a", "_of_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(common * 9 >= (F.size("_of_a") + F.size("_of_b")) * 4).select("a", "b")


def similar_between(some: list[np.ndarray], others: list[np.ndarray], apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the sets some[i] and others[j] with a similarity of 0.8 or more, where apart[i, j]."""
    _, flat = np.unique(np.concatenate([*some, *others]), return_inverse=True)
    cut = sum(map(len, some))
    sizes = np.array([len(x) for x in others])
    begins, right = np.cumsum(sizes) - sizes, flat[cut:]
    marks, at, rows, columns = np.zeros(int(flat.max()) + 1, dtype=np.int64), 0, [], []
    for i, one in enumerate(some):
        own = flat[at:at + len(one)]
        at += len(one)
        marks[own] = 1
        common = np.add.reduceat(marks[right], begins)
        marks[own] = 0
        near = np.flatnonzero((common * 9 >= (len(one) + sizes) * 4) & apart[i])
        rows.append(np.full(len(near), i))
        columns.append(near)
    return np.concatenate(rows), np.concatenate(columns)


def between(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of components that hold similar members of a cell. placed(cell, node, n, c, outside): outside members against all.

    A block gives a spanning set of its links between components, which are named by nodes of theirs. Either side of a cell is dealt over blocks of bounded size and every block of one side meets every one of the other.
    """
    sums = placed.groupBy("cell").agg(
        F.ceil(F.sum(F.when(F.col("outside"), F.col("n"))) / BLOCK_SHINGLES).cast("int").alias("left"), F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("right")
    ).where("left is not null")
    # an empty set has no other member in its cell, so that each side has a block at least
    full = placed.join(sums.hint("shuffle_hash"), "cell").join(sets.hint("merge"), "node")
    block = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    few = full.where("outside").select("cell", block("left").alias("i"), every("right").alias("j"), "c", "shingles")
    all_ = full.select("cell", every("left").alias("i"), block("right").alias("j"), *[F.col(x).alias(x) for x in ("c", "shingles")])

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        ca, cb = (t.column("c").to_numpy() for t in (left, right))
        some, others = ([x.values.to_numpy() for x in t.column("shingles")] for t in (left, right))
        i, j = similar_between(some, others, ca[:, None] != cb[None, :])
        low, high = spanning_edges(ca[i], cb[j])
        return pa.table({"a": pa.array(low), "b": pa.array(high)})

    few = few.select(*[F.col(x).alias(x) for x in few.columns])
    return few.groupBy("cell", "i", "j").cogroup(all_.groupBy("cell", "i", "j")).applyInArrow(run, "a long, b long").distinct()


def simhash_links(marked: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that span the nodes of each SimHash group: one fingerprint, or some that differ in at most `bits` bits. marked(node, fp)."""
    prints = stored(marked.select("node", "fp").distinct())
    belongs = components(stored(near_links(prints.select("fp").distinct(), bits)))
    placed = prints.join(belongs.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("component", "fp").alias("c"))
    heads = placed.groupBy("c").agg(F.min("node").alias("a"))
    return placed.join(heads, "c").where("node != a").select("a", F.col("node").alias("b"))


def links(nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that span every group of nodes (node, low, fp, n, bands): `known` ones, similar sets, or components with similar members. `fetch` makes the sets of (node, low)."""
    every = nodes.select(F.explode("bands").alias("cell"), F.struct("node", "fp", "n").alias("m"))
    shared = every.groupBy("cell").agg(F.min("m").alias("first"), F.max("m").alias("last")).where("first.node != last.node")
    met = stored(every.join(shared.hint("shuffle_hash"), "cell").select("cell", "m", "first", "last"))
    members = met.select(F.col("m.node").alias("node")).distinct()
    sets = stored(fetch(nodes.select("node", "low").join(members.hint("shuffle_hash"), "node", "left_semi")))
    tried, found, label = None, known, None if known is None else stored(components(known))
    for lead in ("first", "last"):
        near = met.where(F.col("m.node") != F.col(f"{lead}.node")).where(_may(F.col("m"), F.col(lead)))
        near = near.select(F.col("m.node").alias("x"), F.col(f"{lead}.node").alias("y"), F.bit_count(F.col("m.fp").bitwiseXOR(F.col(f"{lead}.fp"))).alias("bits"))
        nearest = near.groupBy("x").agg(F.min(F.struct("bits", "y")).alias("y"))
        pairs = nearest.select(F.least("x", "y.y").alias("a"), F.greatest("x", "y.y").alias("b")).distinct()
        if label is not None:
            pairs = _between(pairs, label)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        good = stored(similar(pairs, sets))
        tried, found = (pairs if tried is None else tried.union(pairs)), (good if found is None else found.union(good))
        label = stored(components(found))
    # what is left: members outside the component of their band's first, with all members of the band
    of = label.select(F.col("node").alias("_n"), "component").hint("shuffle_hash")
    placed = met.join(of, F.col("m.node") == F.col("_n"), "left").select("cell", "m", F.col("first.node").alias("_f"), F.coalesce("component", "m.node").alias("c"))
    main = label.select(F.col("node").alias("_f"), F.col("component").alias("main")).hint("shuffle_hash")
    placed = placed.join(main, "_f", "left").select("cell", "m.node", "m.n", "c", (F.col("c") != F.coalesce("main", "_f")).alias("outside"))
    placed = stored(placed)
    out = stored(found.union(between(placed, sets)))
    for table in (met, sets, placed):
        forget(table)
    return out


def _between(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(label.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end, "left")
    return pairs.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """key, component_id (smallest key reachable over links), one row per row of `docs`. With `bits`, SimHash groups link as well.

    Texts with equal sets are one node whatever the number of copies; null and empty texts are one of them. Rows
    without a key belong to their group, whose id is the smallest key that is not null (null if there is none). Repeated
    rows repeat; a key with several texts belongs to several groups; other columns are ignored; an empty table gives an
    empty result. A text is held whole.
    """
    marked = stored(described(docs, key, text))
    # equal sets have equal bands and sizes
    nodes = stored(marked.groupBy("node").agg(F.min(key).alias("low"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.any_value("bands").alias("bands")))
    known = None if bits is None else stored(simhash_links(marked, bits))
    belongs = components(links(nodes, lambda wanted: sets_of(docs, wanted, key, text), known))
    node = nodes.join(belongs, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    lowest = node.groupBy("component").agg(F.min("low").alias("component_id"))
    named = node.join(lowest, "component").select("node", "component_id")
    return marked.select(key, "node").join(named, "node").select(key, "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """One row of each group with all its columns, as `simhash_groups.keep_one` chooses it."""
    return keep_heads(docs, groups(docs, key, text, bits), key)
