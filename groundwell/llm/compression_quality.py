"""Text quality from how well good and bad examples help to compress a text.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text that the
good one shortens more than the bad one resembles the good texts. The difference of the two sizes,
divided by the text's own, is all that a score is made of: a logistic curve, fitted on labelled texts under
dictionaries without them, turns it into a probability. Both dictionaries have the same size and take a piece of each
of many texts, and texts are compressed in blocks, so that a dictionary helps all along a text: within one frame it
would be forgotten after the first part of a long one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_texts, checked_broadcast, gives_back, whole

#: Labelled rows of each class that fitting may take, and bytes of text of each class.
FIT_ROWS, FIT_BYTES = 1_500, 8 << 20
#: Bytes of each dictionary, of the piece it takes of a text at least, of the blocks into which a text is cut, and the
#: compression level. Chosen by a fifth of the learning rows that the others were fitted without.
DICTIONARY_BYTES, PIECE_BYTES, BLOCK_BYTES, LEVEL = 96 << 10, 512, 4 << 10, 12
#: Added to a text's bytes under the gap, for the fixed cost of a frame.
FRAME_BYTES = 64


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    curve: tuple[float, ...]
    empty: float


def sizes(texts: list[bytes], dictionary: bytes) -> np.ndarray:
    """Compressed bytes of each whole text, block by block, with the dictionary."""
    pressed = zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return np.array([sum(len(pressed.compress(t[i:i + BLOCK_BYTES])) for i in range(0, len(t) or 1, BLOCK_BYTES)) for t in texts], dtype=float)


def features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Per text the gap, (size by the bad dictionary - size by the good one) / size of the text, and a one."""
    n = np.array([len(t) for t in texts], dtype=float)
    return np.column_stack([(sizes(texts, bad) - sizes(texts, good)) / (n + FRAME_BYTES), np.ones(len(texts))])


def probability(values: np.ndarray, curve) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(values @ np.asarray(curve), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Coefficients of greatest likelihood, with a slight pull to zero, by damped Newton steps. Last column: ones."""
    middle, scale = x[:, :-1].mean(axis=0), x[:, :-1].std(axis=0)
    scale[scale == 0] = 1.0
    design = np.column_stack([(x[:, :-1] - middle) / scale, x[:, -1]])
    pull, w = np.append(np.full(len(scale), 1e-1), 1e-6), np.zeros(x.shape[1])

    def loss(v):
        z = design @ v
        return np.logaddexp(0, z).sum() - y @ z + pull @ (v * v) / 2

    for _ in range(100):
        p = probability(design, w)
        bend = (design.T * (p * (1 - p) + 1e-9)) @ design + np.diag(pull)
        step, size = np.linalg.solve(bend, design.T @ (y - p) - pull * w), 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if size * np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / scale
    return (*map(float, slopes), float(w[-1] - slopes @ middle))


def dictionary(texts: list[bytes], size: int) -> bytes:
    """The start of each text, as many as there is room for; of few texts more each, an even share of the room."""
    piece = max(PIECE_BYTES, -(-size // max(1, len(texts))))
    return b"\n".join(t[:piece] for t in texts)[:size].ljust(8, b"\n")


def dictionaries(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """A dictionary of either class, both of one size."""
    room = min(len(dictionary(texts, DICTIONARY_BYTES)) for texts in (good, bad))
    by_good, by_bad = (dictionary(texts, room) for texts in (good, bad))
    size = min(len(by_good), len(by_bad))
    return by_good[:size], by_bad[:size]


def fit_texts(good: list[bytes], bad: list[bytes]) -> Model:
    """A model of labelled texts. The curve is fitted on the gaps of each half by the dictionaries of the other half."""
    share = (len(good) + 0.5) / (len(good) + len(bad) + 1)
    model = Model(*dictionaries(good, bad), (0.0, math.log(share / (1 - share))), share)
    halves = [(good[i::2], bad[i::2]) for i in (0, 1)]
    if not all(halves[1]):
        return model
    gaps = [features([*rest[0], *rest[1]], *dictionaries(*other)) for rest, other in zip(halves, halves[::-1])]
    labels = np.concatenate([np.repeat([1.0, 0.0], [len(x) for x in rest]) for rest in halves])
    return replace(model, curve=_logistic(np.concatenate(gaps), labels))


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    """Probability of each text being good; an empty one has the share of good labels."""
    values = probability(features(texts, model.good, model.bad), model.curve)
    return np.where(np.array([not t for t in texts], dtype=bool), model.empty, values)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """Fit on a bounded sample of labelled rows: per class the `rows` first by a digest of the key,
    as far as their whole texts fit in `size` bytes. Empty and null texts and labels other than 0 and 1 are not used."""
    marked = labels.select(F.col(key).alias("_k"), F.col(label).alias("_y")).where("_y in (0, 1)").distinct()
    found = []
    for y in (1, 0):
        rows_of = docs.select(F.col(key).alias("_k"), whole(F.col(text)).alias("_t")).where("_t != ''")
        # only keys meet the labels; the texts of the chosen few are then read by key, so no text is shuffled
        first = rows_of.select("_k").join(marked.where(F.col("_y") == y), "_k", "left_semi").distinct()
        keys = [r["_k"] for r in first.orderBy(F.xxhash64("_k"), "_k").limit(rows).collect()]
        chosen = rows_of.where(F.col("_k").isin(keys)) if keys else rows_of.limit(0)
        sized = chosen.select("_k", F.octet_length("_t").alias("_n")).orderBy(F.xxhash64("_k"), "_k", "_n").collect()
        taken, total = [], 0
        for row in sized:
            if total + row["_n"] <= size:
                taken.append(row["_k"])
                total += row["_n"]
        texts = rows_of.where(F.col("_k").isin(taken)) if taken else rows_of.limit(0)
        picked = sorted({(r["_k"], r["_t"]) for r in texts.collect()})
        found.append([t.encode() for _, t in picked])
    return fit_texts(*found)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1, higher is better) of each whole text; one row per row, no shuffle.

    Null and empty texts get the share of good labels in the sample. Null keys stay, repeated rows
    repeat, other columns are ignored, an empty table gives an empty result.
    """
    shared = checked_broadcast(docs.sparkSession, model, len(model.good) + len(model.bad))
    kind = docs.schema[key].dataType.simpleString()

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(texts, m), pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores at least `least`. No shuffle."""
    shared = checked_broadcast(docs.sparkSession, model, len(model.good) + len(model.bad))
    at = docs.columns.index(text)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch_texts(batch.column(at)), shared.value) >= least))

    return docs.mapInArrow(run, docs.schema)
