"""Byte-level BPE as a reduction over a tree of text halves.

Encoding forms a monoid under `join`: the ids of two neighbouring byte strings are joined by
encoding a window around the seam anew. The window grows until the pairs of tokens at its edges are
stable, that is until both tokens, put together and encoded, come out as themselves. A sequence
whose every adjacent pair is stable is the encoding of its bytes, so nothing outside can change.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch_texts, checked_broadcast, gives_back

#: Bytes encoded directly at a leaf of the tree.
LEAF = 12
#: Distinct matches a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Bytes from which a window is encoded with a queue; rank of a pair that is no token.
LONG, NONE = 256, 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file, read on the driver; tens of thousands of lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class TreeBpe:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.stable: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Encode a short string: join the adjacent pair of lowest rank, leftmost first, until none is left."""
        if len(data) > LONG:
            return self.merge_long(data)
        parts = [data[i:i + 1] for i in range(len(data))]
        rank = self.ranks.get
        pairs = [rank(data[i:i + 2], NONE) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], NONE)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], NONE)
        return [self.ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """The same for a long string, with a queue of pairs: in proportion to length times its logarithm."""
        n, rank = len(data), self.ranks.get
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i:i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue  # one of the two has been joined otherwise since
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                r = rank(data[i:end[stop]])
                if r is not None:
                    heapq.heappush(queue, (r, i, end[stop]))
            if before[i] >= 0:
                r = rank(data[before[i]:stop])
                if r is not None:
                    heapq.heappush(queue, (r, before[i], stop))
        return [self.ranks[data[i:end[i]]] for i in range(n) if alive[i]]

    def holds(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens stay as they are when encoded together."""
        key = (left, right)
        out = self.stable.get(key)
        if out is None:
            if len(self.stable) >= REMEMBERED:
                self.stable.clear()
            out = self.stable[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the joined strings, from the ids of each."""
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        a, b = 1, 1  # tokens of either side inside the window
        while True:
            inside = left[len(left) - a:] + right[:b]
            window = self.merge(self.decode(inside))
            fits_left = a == len(left) or self.holds(left[-a - 1], window[0])
            fits_right = b == len(right) or self.holds(window[-1], right[b])
            if fits_left and fits_right:
                return left[:len(left) - a] + window + right[b:]
            a = a if fits_left else min(len(left), 2 * a)
            b = b if fits_right else min(len(right), 2 * b)

    def encode_tree(self, data: bytes) -> list[int]:
        """Encode halves, then join them."""
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode_tree(data[:half]), self.encode_tree(data[half:]))

    def match_ids(self, match: str) -> bytes:
        """Ids of one match of the pattern as little-endian 32-bit integers."""
        out = self.known.get(match)
        if out is None:
            data = match.encode()
            whole = self.ranks.get(data)
            ids = [whole] if whole is not None else self.encode_tree(data)
            out = b"".join(i.to_bytes(4, "little") for i in ids)
            if len(match) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[match] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, each match of the pattern separately."""
        known, slow = self.known.get, self.match_ids
        return b"".join([known(m) or slow(m) for m in self.pattern.findall(text)])

    def decode(self, ids) -> bytes:
        """Bytes of ids, halves concatenated up the tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text",
                  keep_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode the ids again; one row per row of `docs`, no shuffle.

    Returns key, n_tokens, ids_sha256, decoded_sha256, and with `keep_ids` the ids as binary
    (little-endian 32-bit). Null text is empty: no tokens, digests of nothing. A null key stays null,
    repeated rows give repeated results, other columns of `docs` are ignored, an empty table gives
    an empty result. The rank table is broadcast; its size is checked.
    """
    shared = checked_broadcast(docs.sparkSession, (ranks, pattern), sum(map(len, ranks)) + 64 * len(ranks))
    kind = docs.schema[key].dataType.simpleString()

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TreeBpe(*shared.value)
        for batch in batches:
            counts, ids_digest, text_digest, kept = [], [], [], []
            for data in batch_texts(batch.column(1)):
                ids = coder.encode(data.decode())
                counts.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                text_digest.append(hashlib.sha256(coder.decode(memoryview(ids).cast("I"))).hexdigest())
                kept.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = columns + [pa.array(kept, pa.binary())], names + ["ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(key, text).mapInArrow(run, schema)
