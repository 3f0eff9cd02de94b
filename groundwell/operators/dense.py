"""Exact cosine search: every question vector against every stored vector.

The corpus is read once and never shuffled. Question vectors whose number is proven small are
broadcast as one matrix; each Arrow batch of the corpus is multiplied with it, and a task keeps the k best
of each question over all its batches, which are all that leaves it. A predicate on the stored rows
comes before the search, so that it reaches the scan. A larger question set goes through a grid of bounded cells instead,
so that no task holds more than one block of each side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_double, unit
from ..session import BROADCAST_MAX_BYTES
from .best import RunningBest
from .lexical import DIGITS, best_per_question

ZERO_NORM = 1e-9  # fixed value: stands in for the length of a zero vector
QUESTION_BLOCK = 256
#: Distances that exist at once, and results that one task may hold: both grow with the questions of a cell.
BLOCK_PAIRS, RESULT_ROWS = 1 << 20, 1 << 19
CELL_ROWS = 50_000


def _rows(vectors: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(vectors, pd.Series):
        return np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _scaled(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length == 0.0, ZERO_NORM, length)


def _nearest(questions: np.ndarray, stored: np.ndarray, ids: np.ndarray, k: int):
    """(question row, stored row, distance) of the k nearest, ties by id. Both sides scaled."""
    id_rank = np.empty(len(ids), dtype=np.int64)
    id_rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    keep = min(k, len(ids))
    block = max(1, min(QUESTION_BLOCK, BLOCK_PAIRS // max(1, len(ids))))
    for start in range(0, len(questions), block):
        distance = np.round(1.0 - questions[start : start + block] @ stored.T, DIGITS) + 0.0
        order = np.rint(distance * 10**DIGITS).astype(np.int64) * len(ids) + id_rank
        chosen = (
            np.argpartition(order, keep - 1, axis=1)[:, :keep]
            if keep < len(ids)
            else np.tile(np.arange(len(ids)), (len(order), 1))
        )
        yield (
            np.repeat(np.arange(start, start + len(order)), keep),
            chosen.ravel(),
            np.take_along_axis(distance, chosen, axis=1).ravel(),
        )


def cosine_topk(
    questions: DataFrame,
    stored: DataFrame,
    k: int,
    stored_id: str = "doc_id",
    max_bytes: int = BROADCAST_MAX_BYTES,
    where: Column | str | None = None,
) -> DataFrame:
    """qid, <stored_id>, distance, rank from questions(qid, vector) and stored(<stored_id>, vector).

    `where` is a predicate on any columns of `stored`: only rows for which it is true take part, so a
    question gets k of them wherever there are so many.
    """
    stored = stored if where is None else stored.where(where)
    asked = questions.where(F.col("vector").isNotNull()).select("qid", as_double(F.col("vector")).alias("vector"))
    kept = stored.where(F.col("vector").isNotNull()).select(stored_id, "vector")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 1
    schema = T.StructType([
        T.StructField("qid", asked.schema["qid"].dataType),
        T.StructField(stored_id, stored.schema[stored_id].dataType),
        T.StructField("distance", T.DoubleType()),
    ])
    # a task holds the vectors of its questions and k results of each
    together = max(1, min(max_bytes // (dim * 8), RESULT_ROWS // max(1, k)))
    near = (
        _by_broadcast(asked, kept, k, stored_id, schema)
        if n <= together
        else _by_grid(asked, kept, k, stored_id, schema, n, together)
    )
    return best_per_question(near, k, [F.asc("distance"), F.asc(stored_id)])


def _by_broadcast(asked, kept, k, stored_id, schema) -> DataFrame:
    table = asked.toArrow()
    qids = table.column("qid").combine_chunks()
    matrix = _scaled(_rows(table.column("vector").combine_chunks())) if len(qids) else np.zeros((0, 1))
    shared = asked.sparkSession.sparkContext.broadcast((qids, matrix))
    types = [pa.field("qid", qids.type)]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_ids, asked_matrix = shared.value
        best, kind = RunningBest(len(asked_ids), k), None
        for batch in batches:
            if not batch.num_rows or not len(asked_ids):
                continue
            ids, kind = batch.column(0), batch.column(0).type
            for q, s, d in _nearest(asked_matrix, _scaled(_rows(batch.column(1))), ids.to_numpy(zero_copy_only=False), k):
                best.add(q, d, s, ids)
        if best.ids is not None:
            yield pa.RecordBatch.from_arrays(
                [asked_ids.take(pa.array(best.question)), best.ids, pa.array(best.value)],
                schema=pa.schema([*types, pa.field(stored_id, kind), pa.field("distance", pa.float64())]),
            )

    return kept.mapInArrow(near, schema)


def _by_grid(asked, kept, k, stored_id, schema, n_asked, cell_asked) -> DataFrame:
    asked_cells = -(-n_asked // cell_asked)
    stored_cells = max(1, -(-kept.count() // CELL_ROWS))
    cell = F.pmod(F.xxhash64("qid"), F.lit(asked_cells)).cast("int")
    left = asked.select(
        "qid", "vector", cell.alias("q_cell"), F.explode(F.sequence(F.lit(0), F.lit(stored_cells - 1))).alias("s_cell")
    )
    cell = F.pmod(F.xxhash64(stored_id), F.lit(stored_cells)).cast("int")
    right = kept.select(
        stored_id, as_double(F.col("vector")).alias("vector"), cell.alias("s_cell"),
        F.explode(F.sequence(F.lit(0), F.lit(asked_cells - 1))).alias("q_cell"),
    )

    def near(qs: pd.DataFrame, ss: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or ss.empty:
            return pd.DataFrame({"qid": [], stored_id: [], "distance": []})
        parts = [
            pd.DataFrame({
                "qid": qs["qid"].to_numpy()[q], stored_id: ss[stored_id].to_numpy()[s], "distance": d,
            })
            for q, s, d in _nearest(
                _scaled(_rows(qs["vector"])), _scaled(_rows(ss["vector"])), ss[stored_id].to_numpy(), k
            )
        ]
        return pd.concat(parts, ignore_index=True)

    keys = ("q_cell", "s_cell")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(near, schema)


def mean_unit_vector(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """key, mean: the component-wise mean of the unit vectors of each key.

    Summed per component with partial aggregation, so a key holding a large share of the rows
    costs one partial sum per task and component.
    """
    parts = rows.select(key, F.posexplode_outer(unit(as_double(F.col(vector)))).alias("pos", "x"))
    return (
        parts.where(F.col("pos").isNotNull())
        .groupBy(key, "pos").agg(F.avg("x").alias("x"))
        .groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("_parts"))
        .select(key, F.transform("_parts", lambda p: p["x"]).alias("mean"))
    )
