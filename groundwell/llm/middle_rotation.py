"""Fill-in-middle texts by rotating blocks in place, and back.

A text is scanned once for its two cuts, sentinels are inserted between its parts in one bytearray, and two
neighbouring blocks of that bytearray exchange places by three reversals: each block is reversed, then both
together. Restoring finds the sentinels, applies the inverse rotation (the same three reversals, with the
blocks' sizes exchanged) and takes the sentinels out.

No sentinel is the beginning of a text that another's end could complete, and a text that holds one stays
plain, so each sentinel occurs exactly once in an output and the way back is unambiguous.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batch_texts, gives_back

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that are exchanged at once while a block is reversed, and bytes of output in one Arrow batch.
SWAP_BYTES, BATCH_BYTES = 1 << 16, 8 << 20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def reverse(block: np.ndarray) -> None:
    """Reverse bytes in place, with a buffer of bounded size."""
    low, high = 0, len(block)
    while high - low > 1:
        step = min(SWAP_BYTES, (high - low) // 2)
        left = block[low:low + step].copy()
        block[low:low + step] = block[high - step:high][::-1]
        block[high - step:high] = left[::-1]
        low, high = low + step, high - step


def rotate(data: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange data[start:middle] and data[middle:end] in place, by three reversals."""
    view = np.frombuffer(data, dtype=np.uint8)
    reverse(view[start:middle])
    reverse(view[middle:end])
    reverse(view[start:end])


def unit_starts(text: bytes) -> np.ndarray:
    """Where the units of a UTF-8 text begin: runs of the letters A-Z and a-z, and every other code point."""
    data = np.frombuffer(text, dtype=np.uint8)
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def characters(text: bytes | bytearray, start: int, end: int) -> int:
    """Code points of a part of a UTF-8 text."""
    return int(np.count_nonzero((np.frombuffer(text, dtype=np.uint8)[start:end] & 0xC0) != 0x80))


def draws(key, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on the key alone; a null key counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def arrange(text: bytes, drawn: tuple[int, int, int, int], plain_share: int, spm_share: int) -> tuple[int, str, int | None, int | None, bytearray]:
    """Units, form, code points of prefix and middle, and the output of one text."""
    starts = unit_starts(text)
    n = len(starts)
    out = bytearray(text)
    if not n or drawn[2] % 100 >= 100 - plain_share or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, out
    low, high = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    first, second = (int(starts[u]) if u < n else len(text) for u in (low, high))
    sizes = characters(text, 0, first), characters(text, first, second)
    out[second:second] = SUFFIX  # the later place first, so that the earlier ones stay valid
    out[first:first] = MIDDLE
    out[0:0] = PREFIX
    middle_at, suffix_at = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    form = "spm" if drawn[3] % 100 < spm_share else "psm"
    rotate(out, 0 if form == "spm" else middle_at, suffix_at, len(out))
    return n, form, *sizes, out


def rebuild(output: bytes, form: str) -> bytearray:
    """The text from which `arrange` made this output."""
    out = bytearray(output)
    if form == "plain":
        return out
    middle_at, suffix_at = out.index(MIDDLE), out.index(SUFFIX)
    if form == "psm":  # <P>prefix <S>suffix <M>middle
        rotate(out, suffix_at, middle_at, len(out))
        middle_at, suffix_at = suffix_at, suffix_at + len(out) - middle_at
    else:  # <S>suffix <P>prefix <M>middle
        cut = out.index(PREFIX)
        rotate(out, 0, cut, len(out))
        middle_at, suffix_at = middle_at - cut, len(out) - cut
    for at, sentinel in ((suffix_at, SUFFIX), (middle_at, MIDDLE), (0, PREFIX)):
        if out[at:at + len(sentinel)] != sentinel:
            raise ValueError(f"{form}: no {sentinel.decode()} at byte {at}")
        del out[at:at + len(sentinel)]
    return out


def _in_lots(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold some `BATCH_BYTES` together, one text at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for at, size in enumerate(sizes):
        held += int(size)
        if held >= BATCH_BYTES or at == len(sizes) - 1:
            yield batch.slice(start, at + 1 - start)
            start, held = at + 1, 0


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars, output, one row per row of `docs`. No shuffle.

    Both cuts and the form follow from the key and `seed` by SHA-256, so reruns and retries agree. `plain_share`
    percent of the texts stay as they are, `spm_share` percent of the others put the suffix first. An empty
    or null text and one that holds a sentinel is plain; a null key counts as an empty one; repeated rows give
    repeated results; other columns of `docs` are ignored; an empty table gives an empty result. A text is held
    whole, in one bytearray; everything else beside it is bounded.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in _in_lots(batch, 1):
                rows = [
                    arrange(t, draws(k, seed), plain_share, spm_share)
                    for k, t in zip(lot.column(0).to_pylist(), batch_texts(lot.column(1)))
                ]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([lot.column(0), *columns], names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """All columns of `outputs` and `restored`, the exact text, from output and form alone. No shuffle.

    A null output counts as an empty one, a null form as plain. An output that does not hold its form's sentinels
    in their places is an error. A column that is named like `restored` already is an error too.
    """
    if restored in outputs.columns:
        raise ValueError(f"there is a column {restored} already")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema)
    at, of = outputs.columns.index(output), outputs.columns.index(form)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in _in_lots(batch, at):
                texts = [rebuild(t, f or "plain") for t, f in zip(batch_texts(lot.column(at)), lot.column(of).to_pylist())]
                yield pa.RecordBatch.from_arrays([*lot.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*lot.schema.names, restored])

    return outputs.mapInArrow(run, f"{fields}, `{restored}` string")
