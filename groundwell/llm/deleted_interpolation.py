"""Text scores by a bigram model whose estimates are mixed by deleted interpolation.

P(w | h) = l0 / (V + 1) + l1 c(w) / N + l2 c(h w) / c(h): the uniform, unigram and bigram maximum-likelihood estimates.
The weights l depend on the bucket of the context, the power of two its count lies in. They are learned by
expectation-maximisation: a part of the learning texts is deleted from the counts, and the tokens of that part, with
estimates from the rest, are the held-out events. Texts are then scored with the counts of all learning texts.

Counts are too many for one task or a broadcast, so texts ask for them. Texts are gathered in lots of bounded size. A lot
reduces its texts to the numbers of its own words and asks for each word and each pair of words once, dealt by digest over
shards whose number follows the input; a shard adds up what all lots counted and answers each. A word in every text
is one question per lot. Words are compared as strings, so their counts are exact; pairs are known by 64-bit digests, so
that two pairs of n share their counts with a chance of n^2 / 2^65.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_texts, forget, gives_back, stored

#: Bytes of text of a lot and of a shard's share of the questions.
LOT_BYTES, SHARD_BYTES = 6 << 20, 6 << 20
#: Rounds of expectation-maximisation at most, and the change of all weights at which it ends before.
ROUNDS, SETTLED = 12, 0.002
#: The end of a text is a token, and what comes before its first word. No word can equal it.
END = b""
#: Weights before the first round; after a context never seen there is no bigram estimate.
START, UNSEEN = (1 / 3, 1 / 3, 1 / 3), (1 / 2, 1 / 2, 0.0)
_COLUMNS = ("keys", "ends", "learn", "deleted", "words", "tokens")


def tokens(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, letters A-Z lower-cased, parted by ASCII white space."""
    return text.lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits as compressed byte planes: the planes that are zero throughout cost nothing."""
    planes = np.ascontiguousarray(numbers.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expanded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel().view(np.int64)


def joined(words: list[bytes]) -> bytes:
    """Words, which hold no white space, as one compressed text."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def parted(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def _shard(digest: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of digests, so that sorted digests lie shard by shard."""
    return ((digest >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


class Lot:
    """Texts as numbers of their words. A text's tokens end with number 0, the end, which is also the context of the next one's first word."""

    def __init__(self, words: list[bytes], numbers: np.ndarray, ends: np.ndarray, learn: np.ndarray, deleted: np.ndarray, shards: int = 0):
        self.words, self.numbers, self.ends = words, numbers, ends
        sizes = np.diff(ends, prepend=0)
        self.learn, self.deleted = np.repeat(learn, sizes), np.repeat(deleted & learn, sizes)
        self.pairs, self.pair_of = np.unique(np.r_[0, numbers[:-1]] * len(words) + numbers, return_inverse=True)
        if not shards:
            return
        digest = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
        with np.errstate(over="ignore"):
            pair = _mixed(_mixed(digest)[self.pairs // len(words)] + digest[self.pairs % len(words)])
        # an order by digest, so that the answers can be put back in their places
        self.word_order, self.pair_order = np.argsort(digest, kind="stable"), np.argsort(pair, kind="stable")
        self.digests = pair[self.pair_order]
        bounds = np.arange(shards + 1)
        self.word_cuts, self.pair_cuts = (np.searchsorted(_shard(d, shards).astype(np.int64), bounds) for d in (digest[self.word_order], self.digests))

    def counts(self) -> list[np.ndarray]:
        """How often each word and each pair occurs in learning texts and in the deleted ones of them."""
        out = []
        for which, size in ((self.numbers, len(self.words)), (self.pair_of, len(self.pairs))):
            out += [np.bincount(which[chosen], minlength=size).astype(np.int32) for chosen in (self.learn, self.deleted)]
        return out


def lots(docs: DataFrame, key: str, text: str, learn: Column, deleted: Column) -> DataFrame:
    """One row per lot: its number, its tokens to learn from, those of them not deleted, the keys of its texts, where they end, whether they are
    learned from and deleted, words, tokens."""
    kind = docs.schema[key].dataType.simpleString()

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        keys, flags, numbers, sizes, held, index = [], [], [], [], 0, None

        def row():
            learned, gone = np.array(flags).T
            size = np.array(sizes)
            parts = [pa.concat_arrays(keys), pa.array(np.cumsum(size)), pa.array(learned), pa.array(gone)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), p) for p in parts]
            sums = [pa.array([int(size[which].sum())]) for which in (learned, learned & ~gone)]
            columns = [pa.array([first + number]), *sums, *lists, pa.array([joined(list(index))]), pa.array([squeezed(np.concatenate(numbers))])]
            return pa.RecordBatch.from_arrays(columns, ["lot", "n", "n_kept", *_COLUMNS])

        for batch in batches:
            learned, gone = (batch.column(i).to_pylist() for i in (2, 3))
            for at, raw in enumerate(batch_texts(batch.column(1))):
                if index is None:
                    index = defaultdict(count().__next__)
                    index[END]
                found = tokens(raw)
                ids = np.fromiter(map(index.__getitem__, found), dtype=np.int64, count=len(found))
                numbers.append(np.r_[ids, 0])
                sizes.append(len(ids) + 1)
                keys.append(batch.column(0).slice(at, 1))
                flags.append((bool(learned[at]), bool(gone[at])))
                held += len(raw)
                if held >= LOT_BYTES:
                    yield row()
                    number += 1
                    keys, flags, numbers, sizes, held, index = [], [], [], [], 0, None
        if index is not None:
            yield row()

    picked = docs.select(key, text, F.coalesce(learn, F.lit(False)).alias("_learn"), F.coalesce(deleted, F.lit(False)).alias("_deleted"))
    return picked.mapInArrow(run, f"lot long, n long, n_kept long, keys array<{kind}>, ends array<long>, learn array<boolean>, deleted array<boolean>, words binary, tokens binary")


def _read(batch: pa.RecordBatch | pa.Table, row: int, shards: int) -> Lot:
    cell = lambda name: batch.column(name)[row].values.to_numpy(zero_copy_only=False)
    return Lot(parted(batch.column("words")[row].as_py()), expanded(batch.column("tokens")[row].as_py()), cell("ends"), cell("learn").astype(bool), cell("deleted").astype(bool), shards)


def questions(found: DataFrame, shards: int) -> DataFrame:
    """One row per lot and shard: the words and pairs of the lot that fall to the shard, and how often the lot counted them.

    `counts` holds the counts of the words, of the words in deleted texts, of the pairs and of the pairs in deleted texts;
    the digests of the pairs are sorted and told as differences.
    """

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lot = _read(batch, row, shards)
                word, word_deleted, pair, pair_deleted = lot.counts()
                words = [lot.words[i] for i in lot.word_order]
                placed = [word[lot.word_order], word_deleted[lot.word_order], pair[lot.pair_order], pair_deleted[lot.pair_order]]
                rows = []
                for shard in range(shards):
                    (a, b), (c, d) = lot.word_cuts[shard:shard + 2], lot.pair_cuts[shard:shard + 2]
                    if b > a or d > c:
                        counts = np.concatenate([placed[0][a:b], placed[1][a:b], placed[2][c:d], placed[3][c:d]])
                        rows.append((shard, int(b - a), joined(words[a:b]), squeezed(np.diff(lot.digests[c:d], prepend=np.uint64(0))), squeezed(counts)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(
                    [columns[0], pa.array(np.full(len(rows), batch.column("lot")[row].as_py())), *columns[1:]],
                    ["shard", "lot", "n_words", "words", "pairs", "counts"])

    asked = found.select("lot", *[c for c in _COLUMNS if c != "keys"])
    return asked.mapInArrow(run, "shard int, lot long, n_words int, words binary, pairs binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """Per lot and shard, in the order of the questions, the counts of all lots: words, those deleted, pairs, those deleted.

    A row without a lot tells how many words of the shard occur in learning texts, and in those that are not deleted.
    """

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n_words").to_pylist()
        words = [w for blob, n in zip(table.column("words").to_pylist(), sizes) if n for w in parted(blob)]
        with np.errstate(over="ignore"):
            pairs = [np.cumsum(expanded(blob).view(np.uint64), dtype=np.uint64) for blob in table.column("pairs").to_pylist()]
        counts = [expanded(blob) for blob in table.column("counts").to_pylist()]
        word = pa.array(words, pa.binary()).dictionary_encode()
        _, pair = np.unique(np.concatenate(pairs), return_inverse=True)
        parts = [np.split(c, [n, 2 * n, 2 * n + len(p)]) for c, n, p in zip(counts, sizes, pairs)]
        told, totals = [], []
        for i, which, distinct in ((0, word.indices.to_numpy(), len(word.dictionary)), (1, word.indices.to_numpy(), len(word.dictionary)),
                                   (2, pair, int(pair.max(initial=-1)) + 1), (3, pair, int(pair.max(initial=-1)) + 1)):
            total = np.bincount(which, weights=np.concatenate([p[i] for p in parts]), minlength=distinct).astype(np.int64)
            totals.append(total)
            told.append(np.split(total[which], np.cumsum([len(p[i]) for p in parts])[:-1]))
        blobs = [squeezed(np.concatenate(row)) for row in zip(*told)]
        shard, n = table.column("shard").to_pylist()[0], table.num_rows
        v = [int(np.count_nonzero(totals[0])), int(np.count_nonzero(totals[0] - totals[1]))]
        columns = [[shard] * n + [shard], table.column("lot").to_pylist() + [None], [*sizes, None], [*blobs, None], [None] * n + v[:1], [None] * n + v[1:]]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "lot", "n_words", "counts", "v", "v_kept"])

    return asked.groupBy("shard").applyInArrow(run, "shard int, lot long, n_words int, counts binary, v long, v_kept long")


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else one more than the power of two its count lies in."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), 0)


def _events(lot: Lot, word: np.ndarray, word_deleted: np.ndarray, pair: np.ndarray, pair_deleted: np.ndarray, kept_tokens: int):
    """Bucket, unigram and bigram estimate of each kind of deleted token, from what is not deleted, and how many there are."""
    which, often = np.unique(lot.pair_of[lot.deleted], return_counts=True)
    kept, context = word - word_deleted, lot.pairs[which] // len(lot.words)
    above = kept[context]
    one = kept[lot.pairs[which] % len(lot.words)] / max(kept_tokens, 1)
    two = (pair - pair_deleted)[which] / np.maximum(above, 1)
    events, at = np.unique(np.column_stack([bucket(above), one, two]), axis=0, return_inverse=True)
    return events, np.bincount(at.ravel(), weights=often, minlength=len(events))


def answered(found: DataFrame, told: DataFrame, shards: int, kept_tokens: int) -> DataFrame:
    """Each lot with the counts of its words and then of its pairs, and the events of its deleted texts."""
    schema = {f.name: f.dataType.simpleString() for f in found.schema}
    out = ", ".join(f"{n} {t}" for n, t in schema.items()) + ", counts binary, eb array<double>, e1 array<double>, e2 array<double>, en array<double>"

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        lot = _read(left, 0, shards)
        right = right.sort_by("shard")
        parts = [[] for _ in range(4)]
        for n, blob in zip(right.column("n_words").to_pylist(), right.column("counts").to_pylist()):
            counts = expanded(blob)
            for part, some in zip(parts, np.split(counts, [n, 2 * n, (len(counts) + 2 * n) // 2])):
                part.append(some)
        placed = []
        for part, order in zip(parts, (lot.word_order, lot.word_order, lot.pair_order, lot.pair_order)):
            values = np.empty(len(order), dtype=np.int64)
            values[order] = np.concatenate(part)
            placed.append(values)
        events, often = _events(lot, *placed, kept_tokens)
        more = [pa.array([squeezed(np.concatenate([placed[0], placed[2]]))])]
        more += [pa.array([x], pa.list_(pa.float64())) for x in (events[:, 0], events[:, 1], events[:, 2], often)]
        return pa.table([*left.columns, *more], names=[*left.schema.names, "counts", "eb", "e1", "e2", "en"])

    told = told.where("lot is not null").select("shard", "lot", "n_words", "counts")
    return found.groupBy("lot").cogroup(told.groupBy("lot")).applyInArrow(run, out)


def weights_of(ready: DataFrame, vocabulary: int, rounds: int = ROUNDS) -> dict[int, tuple[float, float, float]]:
    """The mixture weights of each bucket by expectation-maximisation over all events; one pass of sums a round, bounded by the buckets."""
    events = ready.select("eb", "e1", "e2", "en")
    weights: dict[int, tuple[float, float, float]] = {}
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], weights=dict(weights)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b, one, two, often = (batch.column(i).flatten().to_numpy() for i in range(4))
                b = b.astype(np.int64)
                table = np.array([weights.get(i, START if i else UNSEEN) for i in range(66)])
                parts = table[b] * np.column_stack([np.full(len(b), 1 / (vocabulary + 1)), one, two])
                share = parts / parts.sum(axis=1, keepdims=True) * often[:, None]
                sums = [np.bincount(b, weights=share[:, i], minlength=66).astype(float) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(66)), *map(pa.array, sums)], ["b", "r0", "r1", "r2"])

        sums = events.mapInArrow(expect, "b long, r0 double, r1 double, r2 double").groupBy("b").agg(*[F.sum(f"r{i}").alias(f"r{i}") for i in range(3)])
        after = {}
        for r in sums.where("r0 + r1 + r2 > 0").collect():
            # one more event for each part, so that none is ruled out
            parts = np.array([r.r0 + 1, r.r1 + 1, r.r2 + 1 if r.b else 0.0])
            after[r.b] = tuple(parts / parts.sum())
        moved = max((abs(x - y) for b in after for x, y in zip(after[b], weights.get(b, START))), default=0.0)
        weights = after
        if moved < SETTLED:
            break
    return weights


def nearest_weights(weights: dict[int, tuple[float, float, float]]) -> np.ndarray:
    """A row for every bucket; one without events takes the weights of the nearest below, or the start's."""
    table = np.empty((66, 3))
    table[0] = weights.get(0, UNSEEN)
    for b in range(1, 66):
        table[b] = weights.get(b, table[b - 1] if b > 1 else START)
    return table


def score(docs: DataFrame, learn: Column, deleted: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score: one row per row of `docs`.

    `learn` marks the texts to learn from, `deleted` those of them that are held out while the weights are learned. base_score
    is the sum over tokens of log10((c + 1) / (N + V + 1)), score the log10 probability under the mixture; n_known counts
    tokens met in learning texts. A null text is empty and has one token, its end; null keys stay null; repeated rows
    count and are scored each; a null mark is false; other columns are ignored; an empty table gives an empty result. With
    nothing to learn from, every token has the uniform estimate. Nothing is capped: a text larger than a lot is one
    itself, as a text is held whole.
    """
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    found = stored(lots(docs, key, text, learn, deleted))
    told = stored(answers(questions(found, shards)))
    v, v_kept = told.where("lot is null").agg(F.sum("v"), F.sum("v_kept")).first()
    n, n_kept = found.agg(F.sum("n"), F.sum("n_kept")).first()
    n, n_kept, v, v_kept = n or 0, n_kept or 0, v or 0, v_kept or 0
    ready = stored(answered(found, told, shards, n_kept))
    forget(told)
    forget(found)
    table = nearest_weights(weights_of(ready, v_kept)) if n else np.tile([1.0, 0.0, 0.0], (66, 1))
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lot = _read(batch, row, 0)
                word, pair = np.split(expanded(batch.column("counts")[row].as_py()), [len(lot.words)])
                starts = np.r_[0, lot.ends[:-1]]
                context = word[lot.pairs // len(lot.words)]
                mix = table[bucket(context)]
                likely = mix[:, 0] / (v + 1) + mix[:, 1] * word[lot.pairs % len(lot.words)] / max(n, 1) + mix[:, 2] * pair / np.maximum(context, 1)
                base = np.log10((word + 1) / (n + v + 1))
                sums = [np.add.reduceat(x, starts) for x in ((word > 0).astype(np.int64)[lot.numbers], base[lot.numbers], np.log10(likely)[lot.pair_of])]
                yield pa.RecordBatch.from_arrays([
                    batch.column("keys")[row].values, pa.array(lot.ends - starts), pa.array(sums[0]), pa.array(np.full(len(starts), n)), pa.array(sums[1]), pa.array(sums[2])
                ], names)

    return ready.select(*_COLUMNS, "counts").mapInArrow(run, f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
