"""Hard negatives by exact integer scores, most pairs kept from scoring by angles.

Each vector's angles to a few reference directions and its norm are stored. By the triangle inequality of angles the
angle between two vectors lies between the difference and the sum of their angles to any one direction; the
narrowest of these intervals, as cosines times both norms, rounded outwards, bounds their inner product. Rows that lie
close to each other share a block, and runs of a block's rows sorted by angle a window. A pair of anchor and block, and
then of anchor and window, whose score interval misses all that the anchor asks for is never scored.

An anchor asks twice: first for its best rows of the same label, then for the best rows of another label inside
each positive's score range. Either time it visits first the block of each label group where its own direction lies;
the k-th score found there is a bar that the bounds of all later blocks and windows must reach. Rows under the bar
cannot be among the k best, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import gives_back, stored

#: Reference directions, and rows of the sample they are fitted on.
DIRECTIONS, SAMPLE_ROWS = 16, 4096
#: Labels are dealt over so many groups; a block holds rows of one group.
LABEL_GROUPS = 16
#: Rows of a block, rows of a window, anchors of a lot, and block summaries that a lot of anchors is held against at once.
BLOCK_ROWS, WINDOW_ROWS, LOT_ANCHORS, CHUNK_BLOCKS = 8192, 128, 1024, 4096
#: Factor of the components, and the squared norm below which all products and hundredfold scores fit 64 bits.
SCALE, MOST_SQUARE = 256, 2.0**56
#: Slack of an angle: the arc cosine of a rounded cosine is off by about the root of the rounding error.
SLACK = 1e-6
_EXACT = 2.0**53
_LOW, _HIGH = -(1 << 62), 1 << 62


def integer_rows(df: DataFrame, key: str, vector: str, label: str, shifted: int = 7, labels: int = 10) -> DataFrame:
    """(id long, label, v array<long>): one row per key, components floor(SCALE * x), labels of every `shifted`-th key moved on by one.

    Rows with a null key, label or vector or a null or non-finite component take no part, nor do rows whose integer vector
    is so long that products would leave 64 bits. Of rows that share a key, the one with the least (label, vector) counts.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("x"))
    x = F.col("x")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
    near = F.aggregate(scaled, F.lit(0.0), lambda acc, c: acc + c * c) < MOST_SQUARE
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite & near)
    moved = F.when(F.col("id") % shifted == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = rows.select("id", moved.alias("label"), F.transform(scaled, lambda c: c.cast("long")).alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as a matrix of integers; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.asarray(column.flatten(), dtype=np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def directions(sample: np.ndarray, number: int) -> np.ndarray:
    """Unit directions: each the sample row farthest from those before it, then moved to the middle of its rows."""
    length = np.linalg.norm(sample, axis=1)
    rows = sample[length > 0] / length[length > 0, None]
    if not len(rows):
        return np.eye(1, sample.shape[1] if sample.ndim == 2 and sample.shape[1] else 1)
    chosen = [rows[0]]
    nearest = rows @ chosen[0]
    while len(chosen) < min(number, len(rows)):
        chosen.append(rows[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, rows @ chosen[-1])
    out = np.array(chosen)
    for _ in range(4):
        own = np.argmax(rows @ out.T, axis=1)
        middle = np.zeros_like(out)
        np.add.at(middle, own, rows)
        size = np.linalg.norm(middle, axis=1)
        out[size > 0] = middle[size > 0] / size[size > 0, None]
    return out


def angles(rows: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norm of each row, and its angle to each direction; a zero row has angle zero to all, its norm makes every bound zero."""
    norm = np.sqrt(np.einsum("ij,ij->i", rows.astype(float), rows.astype(float)))
    cosine = (rows @ to.T) / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.where(norm[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)


def score_bounds(angle: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible inner products of anchors (their angles and norms) with sets of rows.

    A set is given by the least and greatest angle of its rows to each direction and by their least and
    greatest norm. Both results have one row per anchor and one column per set and err outwards.
    """
    least = np.zeros((len(angle), len(low)))
    most = np.full((len(angle), len(low)), np.pi)
    for d in range(angle.shape[1]):
        own, lo, hi = angle[:, d, None], low[None, :, d], high[None, :, d]
        np.maximum(least, np.maximum(own - hi, lo - own), out=least)
        # the sum of two angles beyond a half turn leaves a smaller angle again
        np.minimum(most, np.where(own + hi <= np.pi, own + hi, np.where(own + lo >= np.pi, 2 * np.pi - own - lo, np.pi)), out=most)
    up, down = np.cos(np.clip(least - SLACK, 0, np.pi)), np.cos(np.clip(most + SLACK, 0, np.pi))
    top = norm[:, None] * np.where(up >= 0, long, short) * up
    bottom = norm[:, None] * np.where(down >= 0, short, long) * down
    return bottom - 1 - np.abs(bottom) * 1e-9, top + 1 + np.abs(top) * 1e-9


def products(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """Inner products of integer rows, exactly: in floating point where every partial sum is an integer below 2^53."""
    if reach < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def best(anchors: dict, rows: dict, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor number, slot, row id, score) of the k best rows of a block for every range an anchor asks for, and pairs scored.

    `anchors` holds id, label, v, norm, angle, and per slot low, high (score ranges, both inclusive, low the bar if it is
    higher); `rows` holds id, label, v, norm, angle. Ties go to the smaller id. The rows are sorted by nearest direction
    and angle, cut into windows, and each window is scored for the anchors whose ranges its bounds overlap.
    """
    near = np.argmin(rows["angle"], axis=1)
    order = np.lexsort((rows["angle"][np.arange(len(near)), near], near))
    rows = {name: column[order] for name, column in rows.items()}
    cuts = np.arange(0, len(order), WINDOW_ROWS)
    low, high = np.minimum.reduceat(rows["angle"], cuts), np.maximum.reduceat(rows["angle"], cuts)
    short, long = np.minimum.reduceat(rows["norm"], cuts), np.maximum.reduceat(rows["norm"], cuts)
    bottom, top = score_bounds(anchors["angle"], anchors["norm"], low, high, short, long)
    slots = anchors["low"].shape[1]
    bar = anchors["low"].copy()
    found = [[np.empty(0, np.int64)] * 3 for _ in range(slots)]
    scored = 0
    # windows that may hold the best rows first, so that the bars rise early
    for w in np.argsort(-top.max(axis=0), kind="stable"):
        asks = (top[:, w, None] >= bar) & (bottom[:, w, None] <= anchors["high"])
        who = np.flatnonzero(asks.any(axis=1))
        if not len(who):
            continue
        part = slice(cuts[w], cuts[w] + WINDOW_ROWS)
        score = products(anchors["v"][who], rows["v"][part], float(anchors["norm"][who].max() * long[w]))
        scored += score.size
        alike = anchors["label"][who, None] == rows["label"][None, part]
        fits = alike & (anchors["id"][who, None] != rows["id"][None, part]) if same else ~alike
        for slot in range(slots):
            inside = fits & (score >= bar[who, slot, None]) & (score <= anchors["high"][who, slot, None])
            if score.shape[1] > k:  # nothing under the window's own k-th score
                kth = np.partition(np.where(inside, score, _LOW), -k, axis=1)[:, -k]
                inside &= score >= kth[:, None]
            a, r = np.nonzero(inside)
            if not len(a):
                continue
            a_all = np.concatenate([found[slot][0], who[a]])
            id_all = np.concatenate([found[slot][1], rows["id"][part][r]])
            s_all = np.concatenate([found[slot][2], score[a, r]])
            ranked = np.lexsort((id_all, -s_all, a_all))
            a_all, id_all, s_all = a_all[ranked], id_all[ranked], s_all[ranked]
            begins = np.flatnonzero(np.r_[True, a_all[1:] != a_all[:-1]])
            rank = np.arange(len(a_all)) - np.repeat(begins, np.diff(np.r_[begins, len(a_all)]))
            keep = rank < k
            found[slot] = [a_all[keep], id_all[keep], s_all[keep]]
            last = rank == k - 1
            bar[a_all[last], slot] = np.maximum(bar[a_all[last], slot], s_all[last])
    slot_of = np.repeat(np.arange(slots), [len(f[0]) for f in found])
    who, ids, scores = (np.concatenate([f[i] for f in found]) for i in range(3))
    return who, slot_of, ids, scores, scored


def _deal(counts: dict[tuple[int, int], int], size: int) -> tuple[dict[tuple[int, int], tuple[int, int]], int]:
    """Number cells (group, direction) so that a number stands for some `size` rows of one group: cell -> (first number, how many)."""
    out, number, held, group = {}, -1, 0, None
    for cell in sorted(counts):
        n = counts[cell]
        parts = -(-n // size)
        if parts > 1:
            out[cell] = (number + 1, parts)
            number, held, group = number + parts, size, cell[0]
            continue
        if group != cell[0] or held + n > size:
            number, held, group = number + 1, 0, cell[0]
        out[cell] = (number, 1)
        held += n
    return out, number + 1


def _filled(dealt: dict[tuple[int, int], tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """`dealt` with an entry for the cells that no row lies in: a number of their group."""
    some = {cell[0]: (first, 1) for cell, (first, _) in dealt.items()}
    return {(g, d): dealt.get((g, d), some[g]) for g in some for d in range(DIRECTIONS)}


def _number(dealt: dict[tuple[int, int], tuple[int, int]], group: Column, direction: Column, key: Column) -> Column:
    """The number that `_deal` gave a cell; rows of a cell with several numbers are spread by their key. Null for an unknown cell.

    The table has at most LABEL_GROUPS x DIRECTIONS entries, whatever the data.
    """
    first = F.create_map(*[F.lit(x) for c, (n, _) in dealt.items() for x in (c[0] * DIRECTIONS + c[1], n)])
    parts = F.create_map(*[F.lit(x) for c, (_, n) in dealt.items() for x in (c[0] * DIRECTIONS + c[1], n)])
    at = (group * DIRECTIONS + direction).cast("int")
    return F.try_element_at(first, at) + F.pmod(F.xxhash64(key), F.try_element_at(parts, at)).cast("int")


def _columns(table: pa.Table, width: int) -> dict:
    pick = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
    lists = lambda name: np.stack(table.column(name).combine_chunks().to_numpy(zero_copy_only=False))
    return {"id": pick("id"), "label": pick("label"), "v": padded(table.column("v"), width), "norm": pick("norm"), "angle": lists("angle")}


def _asked(table: pa.Table, width: int) -> dict:
    lists = lambda name: np.stack(table.column(name).combine_chunks().to_numpy(zero_copy_only=False))
    return {**_columns(table, width), "low": lists("low"), "high": lists("high")}


def _visit(visits: DataFrame, rows: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, id, score): the k best of each visited block. `visits` are anchors with their block; a lot of anchors meets a block at a time."""
    lots = visits.select("block", "lot").distinct().groupBy("block").agg(F.collect_set("lot").alias("lots"))
    homes = rows.join(lots.hint("shuffle_hash"), "block").select("block", F.explode("lots").alias("lot"), *[F.col(c).alias(c) for c in ("id", "label", "v", "norm", "angle")])

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_id", "slot", "id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        anchors = _asked(left, width)
        a, slot, row, score, _ = best(anchors, _columns(right, width), k, same)
        return pa.table([pa.array(x, pa.int64()) for x in (anchors["id"][a], slot, row, score)], names=names)

    visits = visits.select("block", "lot", "id", "label", "v", "norm", "angle", "low", "high")
    return visits.groupBy("block", "lot").cogroup(homes.groupBy("block", "lot")).applyInArrow(run, "anchor_id long, slot long, id long, score long")


def _later(asking: DataFrame, summaries: DataFrame, lots: int, blocks: int) -> DataFrame:
    """Anchors with each further block whose score bounds overlap a range they ask for: lots of anchors against chunks of summaries."""
    chunks = -(-blocks // CHUNK_BLOCKS)
    left = asking.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = summaries.select(*[F.col(c).alias(c) for c in summaries.columns], (F.col("block") / CHUNK_BLOCKS).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    schema = asking.schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def _taken(some: pa.Table, rows, block) -> pa.Table:
        columns = [c.combine_chunks() for c in some.select(schema.names).take(pa.array(rows, pa.int64())).columns]
        columns = [pa.ListArray.from_arrays(c.offsets, c.values) if pa.types.is_list(c.type) else c for c in columns]
        columns[schema.names.index("block")] = pa.array(block, pa.int32())
        return pa.table(columns, names=schema.names)

    def run(_, some: pa.Table, sets: pa.Table) -> pa.Table:
        if not some.num_rows or not sets.num_rows:
            return _taken(some, [], [])
        stack = lambda t, name: np.stack(t.column(name).combine_chunks().to_numpy(zero_copy_only=False))
        flat = lambda t, name: t.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        bottom, top = score_bounds(stack(some, "angle"), flat(some, "norm"), stack(sets, "lows"), stack(sets, "highs"), flat(sets, "short"), flat(sets, "long"))
        low, high = stack(some, "low"), stack(some, "high")
        meets = np.zeros(top.shape, dtype=bool)
        for slot in range(low.shape[1]):
            meets |= (top >= low[:, slot, None]) & (bottom <= high[:, slot, None])
        # blocks of other label groups hold no row of the same label; blocks of that one label alone hold no other
        same_group = flat(some, "grp")[:, None] == flat(sets, "grp")[None, :]
        only = (flat(sets, "label_low") == flat(sets, "label_high"))[None, :] & (flat(some, "label")[:, None] == flat(sets, "label_low")[None, :])
        meets &= np.where(flat(some, "same")[:, None], same_group, ~only)
        for a, seen in enumerate(some.column("seen").to_pylist()):
            meets[a] &= ~np.isin(flat(sets, "block"), np.array(seen, dtype=np.int64))
        a, b = np.nonzero(meets)
        return _taken(some, a, flat(sets, "block")[b])

    return left.groupBy("lot", "chunk").cogroup(right.groupBy("lot", "chunk")).applyInArrow(run, out)


def _rank(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(asking: DataFrame, first: Column, rows: DataFrame, summaries: DataFrame, lots: int, blocks: int, width: int, k: int, same: bool,
            one_each: bool) -> DataFrame:
    """The k best rows for every range asked for, over all blocks. `first` is an array of the blocks to visit first, one of each
    group that matters; with `one_each`, no group has a further block."""
    asking = asking.withColumn("same", F.lit(same)).withColumn("seen", F.array_compact(F.array_distinct(first))).withColumn("block", F.lit(None).cast("int"))
    near = _rank(_visit(asking.withColumn("block", F.explode("seen")), rows, width, k, same), k)
    if one_each:
        return near
    near = stored(near)
    bars = near.where(F.col("rank") == k).groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("bars"))
    raised = asking.join(bars.hint("shuffle_hash"), "id", "left").withColumn(
        "low", F.transform("low", lambda low, at: F.greatest(low, F.try_element_at("bars", at.cast("long"))))
    ).drop("bars")
    more = _visit(_later(raised.select(asking.columns), summaries, lots, blocks), rows, width, k, same)
    return _rank(near.drop("rank").unionByName(more), k)


def mine(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5,
         negatives: int = 5, least: int = 80, most: int = 100, shifted: int = 7, labels: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of every anchor's positives.

    Rows and labels are as `integer_rows` states. Anchors are the rows whose key is divisible by `every`; an anchor's
    positives are the first `positives` other rows of its label by integer inner product, then smaller key. A pair's
    negatives are the first `negatives` rows of other labels whose score is from `least` to `most` percent of the
    positive's. Pairs without any have no row. A zero vector takes part, with all scores zero; shorter vectors are filled
    up with zeros. Scores are exact. Other columns are ignored; an empty table gives an empty result.

    Rows are dealt over blocks of bounded size by label group and nearest direction, cells with more rows over several
    blocks by key, so a label or a direction that holds most rows is spread. How many pairs the angles spare depends on the
    data: clusters leave few, vectors spread evenly over many dimensions nearly all.
    """
    spark = df.sparkSession
    plain = stored(integer_rows(df, key, vector, label, shifted, labels))
    width = plain.agg(F.max(F.size("v"))).first()[0] or 1
    sample = [r.v for r in plain.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()]
    to = directions(padded(pa.array(sample, pa.list_(pa.int64())), width).astype(float), DIRECTIONS)

    @gives_back
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, angle = angles(padded(batch.column(1), width), to)
            offsets = np.arange(0, angle.size + 1, angle.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(angle.ravel()))
            nearest = angle.argmin(axis=1) if len(angle) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm), lists, pa.array(nearest, pa.int32())], ["id", "v", "label", "norm", "angle", "dir"])

    rows = plain.select("id", "v", "label").mapInArrow(describe, "id long, v array<long>, label long, norm double, angle array<double>, dir int")
    rows = stored(rows.withColumn("grp", F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int")))
    is_anchor = F.col("id") % every == 0
    counted = rows.groupBy("grp", "dir").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("a")).collect()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not any(r.a for r in counted):
        return spark.createDataFrame([], schema)
    dealt, blocks = _deal({(r.grp, r.dir): r.n for r in counted}, BLOCK_ROWS)
    dealt_lots, lots = _deal({(0, r.dir): sum(s.a for s in counted if s.dir == r.dir) for r in counted}, LOT_ANCHORS)
    one_each = blocks == len({g for g, _ in dealt})
    dealt = _filled(dealt)
    rows = rows.withColumn("block", _number(dealt, F.col("grp"), F.col("dir"), F.col("id")))
    d = len(to)
    summaries = rows.groupBy("block", "grp").agg(
        F.array(*[F.min(F.col("angle")[i]) for i in range(d)]).alias("lows"), F.array(*[F.max(F.col("angle")[i]) for i in range(d)]).alias("highs"),
        F.min("norm").alias("short"), F.max("norm").alias("long"), F.min("label").alias("label_low"), F.max("label").alias("label_high"),
    )
    anchors = rows.where(is_anchor).withColumn("lot", _number(dealt_lots, F.lit(0), F.col("dir"), F.col("id"))).drop("block")
    asking = anchors.select("id", "label", "v", "norm", "angle", "grp", "dir", "lot", F.array(F.lit(_LOW)).alias("low"), F.array(F.lit(_HIGH)).alias("high"))
    good = _search(asking, F.array(_number(dealt, F.col("grp"), F.col("dir"), F.col("id"))), rows, summaries, lots, blocks, width, positives, True, one_each)
    good = stored(good.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).cast("long").alias("slot")))
    # a negative's range needs a positive score of zero or more; the least score is `least` percent, rounded up
    ranges = good.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(
            "slot", F.expr(f"(positive_score * {least} + 99) div 100").alias("low"), F.expr(f"(positive_score * {most}) div 100").alias("high")
        ))).alias("r"))
    # every anchor asks with the same number of slots; the unused ones with an empty range
    filled = ranges.select("id", *[
        F.array(*[F.coalesce(F.get(f"r.{end}", F.lit(i)), F.lit(empty)) for i in range(positives)]).alias(end) for end, empty in (("low", _HIGH), ("high", _LOW))
    ])
    asking = stored(anchors.select("id", "label", "v", "norm", "angle", "grp", "dir", "lot").join(filled.hint("shuffle_hash"), "id").select(*asking.columns))
    every_group = F.array(*[_number(dealt, F.lit(g), F.col("dir"), F.col("id")) for g in range(LABEL_GROUPS)])
    bad = _search(asking, every_group, rows, summaries, lots, blocks, width, negatives, False, one_each)
    bad = bad.select("anchor_id", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return good.hint("shuffle_hash").join(bad, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
