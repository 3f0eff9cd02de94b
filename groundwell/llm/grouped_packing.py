"""Pack documents into sequences of fixed length by linear grouping and best fit.

Lengths are whole numbers up to the capacity, so their counts are a table of bounded size whatever
the number of documents. The plan is made from these counts alone: large lengths are sorted and cut into
groups of equal cardinality, each length is rounded up to the longest of its group, the few sizes are
packed by configurations (column generation over a linear programme), the actual lengths then take
the places of the rounded ones, and everything left is packed by best fit, longest first. The plan
consists of runs, "the next n documents of this length go to n sequences in a row, at this offset",
and documents find their place by their rank among documents of their length.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from .common import batch_texts, checked_broadcast, gives_back, stored

CAPACITY, END_ID = 4096, 1
#: Large lengths are those above this share of the capacity; they are cut into so many groups. A smaller share
#: leaves too few small documents to fill what rounding wastes.
LARGE_SHARE, GROUPS = 1 / 3, 48
#: Words a worker remembers, give or take those of one lot, and the characters encoded in one lot: a word that comes
#: often in a lot is looked up once.
REMEMBERED, LOT_CHARS = 300_000, 6_000_000


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose words do not influence each other, each distinct word encoded once a lot.

    Latin-1 texts without control characters are split at white space and each distinct piece into words; other texts,
    and those that may hold a special token, go through the tokenizer as they are.
    """

    _usual = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
    # The tokenizer's own word pattern, spelt for these characters.
    _words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        size = self.tokenizer.get_vocab_size()
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        # ids of pieces and words: those met last, and those met before them
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _usual_text(self, text: str) -> bool:
        try:
            odd = text.encode("latin-1").translate(None, self._usual)
        except UnicodeEncodeError:
            return False
        return not odd and "<|" not in text

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Encode words side by side; each ends with the token that closes a word."""
        learnt = {}
        lots = [words[i:i + 256] for i in range(0, len(words), 256)]  # short ones cost the tokenizer least a word
        for some, found in zip(lots, self.tokenizer.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(some):
                data = ids.tobytes()
                learnt.update((w, data[4 * start:4 * end]) for w, start, end in zip(some, [0, *ends], ends))
            else:
                learnt.update((w, self._plain(w)) for w in some)
        return learnt

    def _known(self, found: list[str]) -> list[bytes]:
        """Ids of each of these distinct pieces of texts."""
        if len(self.young) >= REMEMBERED // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        ids = list(map(young.get, found))
        alone, joined = [], {}
        for at in [at for at, have in enumerate(ids) if have is None]:
            piece = found[at]
            have = old.get(piece)
            if have is not None:
                ids[at] = young[piece] = have
            elif piece.isalpha():
                alone.append(at)
            else:
                joined[at] = tuple(self._words.findall(piece))
        words = {w for ws in joined.values() for w in ws}
        here = {w: have for w in words if (have := young.get(w) or old.get(w))}
        here.update(self._learn(list(words.difference(here).union(map(found.__getitem__, alone)))))
        young.update(here)
        for at in alone:
            ids[at] = here[found[at]]
        for at, ws in joined.items():
            ids[at] = young[found[at]] = here[ws[0]] if len(ws) == 1 else b"".join([here[w] for w in ws])
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        usual = [self._usual_text(t) for t in texts]
        split = pc.ascii_split_whitespace(pc.utf8_lower(pa.array([t if u else "" for t, u in zip(texts, usual)], pa.large_string())))
        coded = split.values.dictionary_encode()
        ids = pa.array(self._known(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        starts = np.frombuffer(ids.buffers()[1], dtype=np.int64, count=len(ids) + 1)
        ends = starts[split.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[lo:hi]) if u else self._plain(t) for t, u, lo, hi in zip(texts, usual, ends, ends[1:])]


def pieces(docs: DataFrame, definition: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, and its rank among pieces of its length in its task."""
    shared = checked_broadcast(docs.sparkSession, definition, len(definition))
    kind = docs.schema[key].dataType.simpleString()

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        coder, task, end = WordTokenizer(shared.value), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            texts = [t.decode() for t in batch_texts(batch.column(1))]
            rows = []
            ends = np.cumsum([len(t) for t in texts]) // LOT_CHARS
            for lot in np.unique(ends):
                first, last = np.searchsorted(ends, [lot, lot + 1]).tolist()
                for at, ids in enumerate(coder.encode(texts[first:last]), first):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start:4 * (start + capacity)]
                        length = len(part) // 4
                        rows.append((at, piece, start, length, zlib.crc32(part), seen[length]))
                        seen[length] += 1
            table = np.array(rows, dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *[pa.array(table[:, i]) for i in (2, 3, 4, 5)],
                 pa.array(np.full(len(table), task, dtype=np.int64))],
                [key, "piece", "start", "length", "ids_crc32", "_nth", "_task"],
            )

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, _nth long, _task long"
    return docs.select(key, text).mapInArrow(run, schema)


def _configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Column generation: configurations (how many of each size) and how often each is used, as fractions."""
    k = len(sizes)
    rank = np.argsort(sizes)
    ordered = np.array(sizes)[rank]
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(40 * k + 200):
        use = np.linalg.solve(basis, demand)
        price = np.linalg.solve(basis.T, np.ones(k))
        # unbounded knapsack over the capacity: the configuration of greatest total price
        best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(ordered[0], capacity + 1):
            fit = np.searchsorted(ordered, room, side="right")
            values = best[room - ordered[:fit]] + price[rank[:fit]]
            i = int(values.argmax())
            if values[i] > best[room - 1] + 1e-12:
                best[room], chosen[room] = values[i], rank[i]
            else:
                best[room] = best[room - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if chosen[room] < 0:
                room -= 1
            else:
                column[chosen[room]] += 1
                room -= sizes[chosen[room]]
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = column
    use = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(basis[:, i].astype(int), use[i]) for i in range(k) if use[i] > 1e-9]


def plan(counts: dict[int, int], capacity: int = CAPACITY, large_share: float = LARGE_SHARE, groups: int = GROUPS) -> np.ndarray:
    """Runs (length, first rank, number, first sequence, offset) that place every document of the counts.

    Documents of one length are ranked from 0. Memory and time depend on the capacity, not on the counts.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    ranked = {n: 0 for n in left}  # documents of a length placed so far
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    free: dict[int, list[tuple[int, int]]] = {}  # room -> intervals (first sequence, number)

    def place(length, number, first, offset):
        runs.append((length, ranked[length], number, first, offset))
        ranked[length] += number
        left[length] -= number

    def leave(room, first, number):
        if room:
            free.setdefault(room, []).append((first, number))

    if left.get(capacity):
        place(capacity, left[capacity], 0, 0)
        sequences = ranked[capacity]
    large = sorted((n for n in left if n > capacity * large_share and left[n]), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        # groups of equal cardinality, longest first; a length may fall into several
        share, members, at = -(-total // groups), [], 0
        for n in large:
            rest = left[n]
            while rest:
                if not members or at == share:
                    members.append([])
                    at = 0
                take = min(rest, share - at)
                members[-1].append([n, take])
                at += take
                rest -= take
        sizes, merged = [], []
        for group in members:  # groups rounded to the same length are one size
            if sizes and sizes[-1] == group[0][0]:
                merged[-1] += group
            else:
                sizes.append(group[0][0])
                merged.append(list(group))
        demand = np.array([sum(c for _, c in g) for g in merged], dtype=float)
        for config, times in _configurations(sizes, demand, capacity):
            times = int(times + 1e-6)
            for i, slots in enumerate(config):
                times = min(times, sum(c for _, c in merged[i]) // slots) if slots else times
            if not times:
                continue
            filled = [(sequences, times, 0)]  # intervals of these sequences with their fill so far
            sequences += times
            for i, slots in enumerate(config):
                for _ in range(slots):
                    filled, todo = [], filled
                    for first, number, fill in todo:
                        while number:
                            n, have = merged[i][0]
                            take = min(number, have)
                            place(n, take, first, fill)
                            filled.append((first, take, fill + n))
                            first, number = first + take, number - take
                            if take == have:
                                merged[i].pop(0)
                            else:
                                merged[i][0][1] -= take
            for first, number, fill in filled:
                leave(capacity - fill, first, number)
    # best fit, longest first, of whatever is left
    rooms = sorted(free)
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                each = capacity // n
                full, rest = divmod(left[n], each)
                for depth, number in [(each, full), (rest, 1 if rest else 0)]:
                    if number:
                        for d in range(depth):
                            place(n, number, sequences, d * n)
                        room = capacity - depth * n
                        if room:
                            if room not in free:
                                bisect.insort(rooms, room)
                            leave(room, sequences, number)
                        sequences += number
                continue
            room = rooms[i]
            first, number = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(i)
            depth = min(room // n, max(1, left[n] // number))  # so many of this length go into each
            take = min(number, left[n])
            for d in range(depth):
                place(n, take, first, capacity - room + d * n)
            if take < number:
                if room not in free:
                    bisect.insort(rooms, room)
                leave(room, first + take, number - take)
            rest = room - depth * n
            if rest:
                if rest not in free:
                    bisect.insort(rooms, rest)
                leave(rest, first, take)
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, definition: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID) -> DataFrame:
    """Place of every piece of every whole text: key, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids are followed by `end_id`; more than `capacity` of them are cut. Null and empty texts give
    one piece of the end id alone. Null keys stay, repeated rows are packed each, other columns are ignored,
    an empty table gives an empty result. No text is shuffled; the driver sees one count per length.
    """
    cut = stored(pieces(docs, definition, key, text, capacity, end_id))
    held = cut.groupBy("length", "_task").agg((F.max("_nth") + 1).alias("_n"))
    before = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    bases = stored(held.select("length", "_task", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = plan(counts, capacity)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    shared = checked_broadcast(docs.sparkSession, runs, runs.nbytes)
    kind = docs.schema[key].dataType.simpleString()

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                mine = length == n
                lo, hi = starts[n], starts[n + 1]
                at[mine] = lo + np.searchsorted(table[lo:hi, 1], rank[mine], side="right") - 1
            found = table[at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (key, "piece", "start", "length", "ids_crc32")],
                 pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])],
                [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cut.join(bases.drop("_n"), ["length", "_task"]).select(
        key, "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_nth")).alias("_rank")
    )
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
