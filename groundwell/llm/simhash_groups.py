"""Near-duplicate groups by SimHash: equal or nearly equal 64-bit fingerprints.

Fingerprints are embedded as bit counts of sixteen 4-bit segments. The Manhattan distance of two
such vectors never exceeds the Hamming distance of the fingerprints, so fingerprints that differ
in at most 3 bits lie within 3 in the grid, and one half of the vector within 1. Each fingerprint
therefore lives in one grid cell per half and visits that cell and its upper neighbours; whatever
meets there is verified exactly. Links of a cell leave it as a spanning set only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_texts, components, gives_back, spanning_edges, stored

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: Fingerprints of one cell that one task takes as residents; visitors of fuller cells are dealt over several tasks.
CELL_ROWS = 8192
#: Fingerprints on either side of one block of comparisons: the pairs of a block exist at once, all of them in a group of near copies.
BLOCK = 256
_LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    out, starts = np.zeros((8, 8), dtype=np.int64), np.arange(0, len(hashes), 255)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        out[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """SimHash of word shingles of a UTF-8 text, letters A-Z lower-cased, words parted by ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    last = (ends - 1).tolist()
    first = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(line, SEED)]
    else:
        hashes = [digest(line[a:b], SEED) for a, b in zip(first, last[width - 1:])]
    over = bit_counts(np.array(hashes, dtype=np.uint64)) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """key, fp (long, the 64 bits) of each whole text. Null text is empty, with fingerprint zero. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch_texts(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the sixteen 4-bit segments, as the 4-bit digits of one 64-bit number."""
    x = fps.view(np.uint64)
    x = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, visitor, fp): a resident of the own cell, a visitor of it and of each upper neighbour, per half."""
    for batch in batches:
        fps = batch.column(0).to_numpy()
        counts = segment_counts(fps)
        cells, visitor, who = [], [], []
        for half in (0, 1):
            own = ((counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            base = own | (half << 32)
            cells += [base, base]
            visitor += [np.zeros(len(fps), bool), np.ones(len(fps), bool)]
            who += [fps, fps]
            for digit in range(8):
                up = ((own >> (4 * digit)) & 15) < 4
                cells.append(base[up] + (1 << (4 * digit)))
                visitor.append(np.ones(int(up.sum()), bool))
                who.append(fps[up])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (cells, visitor, who)], ["cell", "visitor", "fp"])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; counted unsigned, as a signed count would be that of the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def cell_links(homes: np.ndarray, guests: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among residents and visitors of one cell, compared block by block."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for i in range(0, len(guests), BLOCK):
        for j in range(0, len(homes), BLOCK):
            some, others = guests[i:i + BLOCK], homes[j:j + BLOCK]
            g, h = np.nonzero(apart(some[:, None], others[None, :]) <= most)
            if len(g):
                a, b = spanning_edges(np.concatenate([a, some[g]]), np.concatenate([b, others[h]]))
    return a, b


def _meet(most: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input sorted by cell; a cell may run over several batches."""
        left = None

        def links(cell, visitor, fp):
            order = np.flatnonzero(np.diff(cell)) + 1
            starts, ends = np.concatenate([[0], order]), np.concatenate([order, [len(cell)]])
            guests = np.add.reduceat(visitor.astype(np.int64), starts) if len(cell) else np.empty(0, np.int64)
            homes = (ends - starts) - guests
            out_a, out_b = [], []
            work = homes * guests
            # small cells together: every resident-visitor pair of each, in bounded lots
            small = np.flatnonzero((homes > 0) & (guests > 0) & (ends - starts > 2) & (work <= 4096))
            lots = np.split(small, np.searchsorted(np.cumsum(work[small]), np.arange(BLOCK ** 2, work[small].sum() + 1, BLOCK ** 2)))
            for lot in lots:
                if not len(lot):
                    continue
                h, g = homes[lot], guests[lot]
                n = h * g
                of = np.repeat(np.arange(len(lot)), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                a = fp[starts[lot][of] + k // g[of]]
                b = fp[starts[lot][of] + h[of] + k % g[of]]
                near = (apart(a, b) <= most) & (a != b)
                out_a.append(a[near])
                out_b.append(b[near])
            for c in np.flatnonzero((homes > 0) & (guests > 0) & (work > 4096)):
                a, b = cell_links(fp[starts[c]:starts[c] + homes[c]], fp[starts[c] + homes[c]:ends[c]], most)
                out_a.append(a)
                out_b.append(b)
            if not out_a:
                return None
            a, b = spanning_edges(np.concatenate(out_a), np.concatenate(out_b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if left is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(left, columns)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last cell may go on
            left = [c[cut:] for c in columns]
            out = links(*[c[:cut] for c in columns])
            if out is not None:
                yield out
        if left is not None:
            out = links(*left)
            if out is not None:
                yield out

    return run


def near_links(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column fp) that span every group linked at `most` bits (up to 3)."""
    if not 0 <= most <= 3:
        raise ValueError("the grid covers up to 3 differing bits")
    visits = fps.select("fp").mapInArrow(_visits, "cell long, visitor boolean, fp long")
    # A full cell is dealt over several tasks: each gets all its residents in turn and a share of the visitors.
    full = (
        visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS)
        .select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts"))
    )
    dealt = visits.join(full, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    share = F.when(F.col("visitor"), F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.col("parts") - 1)
    )
    spread = dealt.select("visitor", "fp", "cell", F.explode(share).alias("part"))
    placed = spread.select((F.col("cell") + F.col("part").cast("long") * (1 << 34)).alias("cell"), "visitor", "fp")
    sorted_cells = placed.repartition("cell").sortWithinPartitions("cell", "visitor")
    return sorted_cells.mapInArrow(_meet(most), "a long, b long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (smallest key reachable over links), one row per row of `docs`.

    Equal fingerprints are one node whatever the number of copies. Null and empty texts have fingerprint zero
    and link like any other. Rows without a key belong to their group, whose id is the smallest key that is
    not null (null if there is none). Repeated rows repeat; other columns are ignored.
    """
    marked = stored(fingerprints(docs, key, text, width))
    nodes = stored(marked.groupBy("fp").agg(F.min(key).alias("low")))
    # stored first: a task that compares and contracts at once holds two Python workers
    belongs = components(stored(near_links(nodes, most)))
    node = nodes.join(belongs.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component")
    )
    lowest = node.groupBy("component").agg(F.min("low").alias("component_id"))
    named = node.join(lowest, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """One row of each group with all its columns: the one of the smallest key. A group without keys keeps its rows.

    Rows that repeat a key are one document.
    """
    return keep_heads(docs, groups(docs, key, text, width, most), key)


def keep_heads(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows of `docs` that `keep_one` keeps of groups found (key, component_id)."""
    grouped = stored(found)
    heads = grouped.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(F.col(key).alias("_head")).agg(F.count(F.lit(1)).alias("_copies"))
    single, several = (heads.where(c).select("_head").hint("shuffle_hash") for c in ("_head is null or _copies = 1", "_head is not null and _copies > 1"))
    return docs.join(single, docs[key].eqNullSafe(F.col("_head")), "left_semi").union(
        docs.join(several, docs[key] == F.col("_head"), "left_semi").dropDuplicates([key])
    )
