"""Repeated byte strings of a threshold length, by a depth-limited radix order of suffixes.

Suffixes are ordered by digits, most significant first, and only through the threshold; a group that
one document alone holds leaves after the digit that shows it. The first digit is the window's anchor, the
string of `ANCHOR` bytes with the least hash in it: equal windows have equal anchors at equal places, and
neighbouring suffixes mostly share theirs, so one row stands for many suffixes. The second digit is
everything the anchor's suffixes read through the threshold, as one string. Where both agree, all those windows are
repeated. Only where the first digit agrees and the second does not are the suffixes taken one by one, with the
whole window as the last digit. Digits are compared as hashes: 38 bits or more for the first, which only has to
part groups, 48 more for the second, 64 for the last beside its bucket.

Rows of a pass are sorted runs of digits, one per Arrow batch and leading digit bits. A string that
very many documents hold is one row per document in such a run, spread over the batches; a
bucket holds a bounded stretch of the hash range, and the number of buckets grows with the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_texts, gives_back, stored, whole

THRESHOLD, ANCHOR = 50, 24
#: Bytes of text whose digits one bucket takes, and bytes that are hashed at once.
BUCKET_BYTES, LOT_BYTES = 8 << 20, 1 << 19
_U = np.uint64
_RANDOM = np.random.default_rng(20240517)
#: Random values of the 256 bytes, for two independent hashes; base and its inverse modulo 2^64.
_BYTE = _RANDOM.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_power: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a base and of its inverse."""
    have = _power.get(which)
    if have is None or len(have[0]) <= n:
        inverse = pow(_BASE[which], -1, 1 << 64)
        up, down = np.full(n + 1, _U(_BASE[which])), np.full(n + 1, _U(inverse))
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if n <= 2 * LOT_BYTES:
            _power[which] = have
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(29))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


class Hashes:
    """Hashes of any stretch of a byte string."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _powers(which, len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[which][data] * up[:len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        """Of each stretch of `width` bytes."""
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of each `width` neighbours."""
    reach = 1
    while 2 * reach <= width:
        x = pick(x[:-reach], x[reach:])
        reach *= 2
    return pick(x[:len(x) - (width - reach)], x[width - reach:]) if reach < width else x


def anchors(data: np.ndarray, ends: np.ndarray, hashes: Hashes, threshold: int, anchor: int):
    """Anchors of all windows of documents laid end to end: place, hash, first and last byte read by its windows."""
    none = np.empty(0, np.int64)
    n, width = len(data), threshold - anchor + 1
    if n < threshold:
        return none, none.astype(np.uint64), none, none
    digit = hashes.every(anchor)
    low = _sliding(digit, width, np.minimum)  # by window start
    starts = np.concatenate([[0], ends[:-1]])
    for end in ends[:-1]:  # windows that cross into the next document
        low[max(0, end - threshold + 1):end] = 0
    high = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(len(digit) - len(low), np.uint64)]), width, np.maximum)
    place = np.flatnonzero((high == digit) & (digit > 0))
    of = np.searchsorted(ends, place, side="right")
    return place, digit[place], np.maximum(place - width + 1, starts[of]), np.minimum(place + threshold, ends[of])


def _lots(texts: list[bytes], keys: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents in lots: bytes end to end, ends, keys. Documents without a key are left out."""
    lot, names, size = [], [], 0
    for text, key in zip(texts, keys):
        if key is None or not text:
            continue
        lot.append(text)
        names.append(key)
        size += len(text)
        if size >= LOT_BYTES:
            yield np.frombuffer(b"".join(lot), np.uint8), np.cumsum([len(x) for x in lot]), np.array(names, np.int64)
            lot, names, size = [], [], 0
    if lot:
        yield np.frombuffer(b"".join(lot), np.uint8), np.cumsum([len(x) for x in lot]), np.array(names, np.int64)


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(key.view(np.uint64)) % _U(shards)).astype(np.int64)


def _runs(bucket: np.ndarray, columns: list[np.ndarray], key: np.ndarray, widths: tuple[int, ...] = (8,)) -> pa.RecordBatch:
    """Rows of a pass, one per bucket: numbers in so many bytes each, and the documents' places in a short list of keys."""
    order = np.argsort(bucket, kind="stable")
    heads, starts = np.unique(bucket[order], return_index=True)
    names, who, packed = [], [], [[], []]
    for part in np.split(order, starts[1:]) if len(heads) else []:
        own, at = np.unique(key[part], return_inverse=True)
        names.append(np.diff(own, prepend=0).astype("<i8").tobytes())  # steps: small, so they compress well
        who.append(at.astype("<u2" if len(own) < 1 << 16 else "<u4").tobytes())
        for i, out in enumerate(packed):
            out.append(columns[i][part].astype("<u8").view("u1").reshape(-1, 8)[:, :widths[i]].tobytes() if i < len(columns) else b"")
    arrays = [pa.array(heads.astype(np.int64)), *[pa.array(x, pa.binary()) for x in (names, who, *packed)]]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "names", "who", "one", "two"])


def _unpack(table: pa.Table, widths: tuple[int, ...]) -> list[np.ndarray]:
    """The columns of all runs of a bucket, then the keys."""
    out = []
    for name, width in zip(("one", "two"), widths):
        data = np.frombuffer(b"".join(table.column(name).to_pylist()), "u1").reshape(-1, width)
        wide = np.zeros((len(data), 8), "u1")
        wide[:, :width] = data
        out.append(wide.view("<u8")[:, 0])
    keys = [np.empty(0, np.int64)]
    for names, who in zip(table.column("names").to_pylist(), table.column("who").to_pylist()):
        own = np.cumsum(np.frombuffer(names, "<i8"))
        keys.append(own[np.frombuffer(who, "<u2" if len(own) < 1 << 16 else "<u4")])
    return [*out, np.concatenate(keys)]


def _by_key(key: np.ndarray, columns: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Numbers of each document packed into one row; columns maps a name to (which rows, numbers)."""
    names = np.unique(key)
    out = {"key": pa.array(names, pa.int64())}
    for name, (rows, values) in columns.items():
        rows = rows[np.argsort(key[rows], kind="stable")]
        own, data = key[rows], values[rows].astype("<u8").tobytes()
        cuts = np.searchsorted(own, names).tolist(), np.searchsorted(own, names, side="right").tolist()
        out[name] = pa.array([data[8 * a:8 * b] for a, b in zip(*cuts)], pa.binary())
    return pa.table(out)


def _first_of(change: np.ndarray) -> np.ndarray:
    """For sorted rows, the row that starts each row's group; change marks the starts."""
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))


def removed_bytes(data: np.ndarray, settled: np.ndarray, single: np.ndarray, threshold: int, anchor: int) -> np.ndarray:
    """Which bytes of one document go, from the digests of its repeated anchor strings and repeated single windows."""
    hashes = Hashes(data)
    place, _, first, last = anchors(data, np.array([len(data)]), hashes, threshold, anchor)
    depth = np.zeros(len(data) + 1, dtype=np.int64)
    gone = np.isin(_strings(hashes, place, first, last), settled)
    np.add.at(depth, first[gone], 1)
    np.add.at(depth, last[gone], -1)
    if len(single):
        at = np.flatnonzero(np.isin(hashes.every(threshold), single))
        np.add.at(depth, at, 1)
        np.add.at(depth, at + threshold, -1)
    return np.cumsum(depth[:-1]) > 0


def _strings(hashes: Hashes, place, first, last) -> np.ndarray:
    """48-bit digests of all that an anchor's windows read, with the anchor's place in it."""
    return _mix(hashes.of(first, last) ^ ((place - first).astype(np.uint64) << _U(20)) ^ ((last - first).astype(np.uint64) << _U(40))) >> _U(16)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, anchor: int = ANCHOR,
            carry: tuple[str, ...] | None = None) -> DataFrame:
    """Bytes of each whole text that strings of `threshold` bytes cover which also start in a document of smaller key.

    Returns key, n_bytes, n_removed, n_spans, kept_sha256, one row per row of `docs`. With `carry` the remaining
    text follows as `kept` (a character of which only some bytes remain is left out), and the named columns
    of `docs` as the fields of `rest`. Keys are whole numbers. Null text is empty; texts shorter than the
    threshold, and rows without a key, keep everything and remove nothing. Rows of one key are one document. Other
    columns are ignored; an empty table gives an empty result.
    """
    if not 0 < anchor <= threshold:
        raise ValueError("an anchor is no longer than the threshold")
    rows = docs.select(F.col(key).cast("long").alias("key"), whole(F.col(text)).alias("text"), *(
        [] if carry is None else [F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("rest")]
    ))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))

    @gives_back
    def first_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[], [], []]
            for data, ends, keys in _lots(batch_texts(batch.column(1)), batch.column(0).to_pylist()):
                hashes = Hashes(data)
                place, digit, first, last = anchors(data, ends, hashes, threshold, anchor)
                for out, x in zip(found, (digit, _strings(hashes, place, first, last), keys[np.searchsorted(ends, place, side="right")])):
                    out.append(x)
            if not found[0]:
                continue
            digit, string, keys = (np.concatenate(x) for x in found)
            made = _runs((digit % _U(buckets)).astype(np.int64), [digit >> _U(32), string], keys, (4, 6))
            yield made

    def settle(table: pa.Table) -> pa.Table:
        digit, string, key = _unpack(table, (4, 6))
        order = np.lexsort((key, string, digit))
        digit, string, key = digit[order], string[order], key[order]
        new_digit = np.concatenate([[True], digit[1:] != digit[:-1]])
        new_string = new_digit | np.concatenate([[True], string[1:] != string[:-1]])
        least = key[_first_of(new_string)]  # keys are sorted within a string
        group = np.cumsum(new_digit) - 1
        strings = np.bincount(group, weights=new_string)
        heads = np.flatnonzero(new_digit)
        several = np.minimum.reduceat(key, heads) != np.maximum.reduceat(key, heads)
        fresh = np.concatenate([[True], (string[1:] != string[:-1]) | (key[1:] != key[:-1])])
        whole_gone = (least < key) & fresh
        unclear = (least == key) & fresh & (strings > 1)[group] & several[group]
        told = np.flatnonzero(whole_gone | unclear)
        return pa.Table.from_batches([_runs(_shard(key[told], buckets), [string[told], whole_gone[told].astype(np.uint64)], key[told], (6, 1))])

    def strings_by_key(table: pa.Table) -> pa.Table:
        string, gone, key = _unpack(table, (6, 1))
        return _by_key(key, {"settled": (np.flatnonzero(gone == 1), string), "unclear": (np.flatnonzero(gone == 0), string)})

    packed = "bucket long, names binary, who binary, one binary, two binary"
    # what is known of a string goes to its document in two steps: packed by shard of documents, then by document
    signs = rows.select("key", "text").mapInArrow(first_digit, packed).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: settle(t), packed)
    told = stored(signs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: strings_by_key(t), "key long, settled binary, unclear binary"))

    @gives_back
    def last_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[], []]
            for data, name, parts in zip(batch_texts(batch.column(1)), batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                wanted = np.frombuffer(parts or b"", "<u8")
                if not len(wanted) or len(data) < threshold:
                    continue
                data = np.frombuffer(data, np.uint8)
                hashes = Hashes(data)
                place, _, first, last = anchors(data, np.array([len(data)]), hashes, threshold, anchor)
                mine = np.isin(_strings(hashes, place, first, last), wanted)
                cover = np.zeros(len(data) + 1, dtype=np.int64)  # starts of the windows of these anchors
                np.add.at(cover, first[mine], 1)
                np.add.at(cover, np.minimum(place, last - threshold)[mine] + 1, -1)
                at = np.flatnonzero(np.cumsum(cover)[:len(data) - threshold + 1] > 0)
                for out, x in zip(found, (hashes.of(at, at + threshold), np.full(len(at), name))):
                    out.append(x)
            if not found[0]:
                continue
            window, names = (np.concatenate(x) for x in found)
            made = _runs((window % _U(buckets)).astype(np.int64), [window], names)
            yield made

    def settle_windows(table: pa.Table) -> pa.Table:
        window, key = _unpack(table, (8,))
        order = np.lexsort((key, window))
        window, key = window[order], key[order]
        fresh = np.concatenate([[True], window[1:] != window[:-1]])
        gone = np.flatnonzero((key[_first_of(fresh)] < key) & (fresh | np.concatenate([[True], key[1:] != key[:-1]])))
        return pa.Table.from_batches([_runs(_shard(key[gone], buckets), [window[gone]], key[gone])])

    def windows_by_key(table: pa.Table) -> pa.Table:
        window, key = _unpack(table, (8,))
        return _by_key(key, {"single": (np.arange(len(key)), window)})

    # The texts move once, by key: both joins below read the same exchange. For that they must ask the same of it, so
    # this one is no inner join, whose keys may not be null, and reads what is carried too.
    dealt = rows.repartition("key")
    asked = told.where(F.octet_length("unclear") > 0).select("key", "unclear")
    last = dealt.join(asked.hint("shuffle_hash"), "key", "left").select(
        "key", F.when(F.col("unclear").isNotNull(), F.col("text")).alias("text"), "unclear", *rows.columns[2:]
    ).mapInArrow(last_digit, packed)
    singles = last.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: settle_windows(t), packed)
    singles = singles.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: windows_by_key(t), "key long, single binary")

    @gives_back
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for raw, settled, single in zip(batch_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                kept, spans = raw, 0
                settled, single = np.frombuffer(settled or b"", "<u8"), np.frombuffer(single or b"", "<u8")
                if len(settled) or len(single):
                    data = np.frombuffer(raw, np.uint8)
                    gone = removed_bytes(data, settled, single, threshold, anchor)
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = data[~gone].tobytes()
                for column, x in zip(out, (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(x)
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())]
            names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if carry is not None:
                texts = [x.decode(errors="ignore") for x in out[4]]
                columns, names = columns + [pa.array(texts, pa.string()), batch.column(4)], names + ["kept", "rest"]
            yield pa.RecordBatch.from_arrays(columns, names)

    together = dealt.join(told.select("key", "settled").hint("shuffle_hash"), "key", "left").join(singles.hint("shuffle_hash"), "key", "left")
    schema = f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if carry is None:
        return together.select("key", "text", "settled", "single").mapInArrow(finish, schema)
    schema += f", kept string, rest {rows.schema['rest'].dataType.simpleString()}"
    return together.select("key", "text", "settled", "single", "rest").mapInArrow(finish, schema)
