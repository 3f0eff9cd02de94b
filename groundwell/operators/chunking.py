"""Sections to token-bounded chunks, one row at a time and without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.bind import let, unroll
from ..functions.text import TokenCounter, count_tokens, sentences

_SPAN = "array<struct<start:int,stop:int>>"


def packed_spans(sizes: Sequence[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy packing as index spans [start, stop) over sentence sizes, in one pass.

    A pack is a contiguous run of sentences. When the next sentence would overflow it, it is closed and the longest tail of at
    most `overlap` tokens opens the next one. An oversized sentence that meets an empty run stands alone. Only the open
    run is carried: where it starts, and how many tokens it has.
    """
    spans, start, held = [], 0, 0
    for i, size in enumerate(sizes):
        if start < i and held + size > target:
            spans.append((start, i))
            start, held = i, 0
            while start > spans[-1][0] and held + sizes[start - 1] <= overlap:
                start -= 1
                held += sizes[start]
        if start == i and size > target:
            spans.append((i, i + 1))
            start, held = i + 1, 0
        else:
            held += size
    if start < len(sizes):
        spans.append((start, len(sizes)))
    return spans


def sentence_spans(sizes: Column, target: int, overlap: int) -> Column:
    """`packed_spans` of an array column. Only the sizes leave the JVM, in Arrow batches; time and memory follow their number."""

    @F.pandas_udf(_SPAN)
    def spans(lists: pd.Series) -> pd.Series:
        return pd.Series([
            None if one is None else [{"start": a, "stop": b} for a, b in packed_spans(one.tolist(), target, overlap)] for one in lists
        ], dtype=object)

    return spans(sizes)


def merge_short_tail(pieces: Column, minimum: int, counter: TokenCounter = count_tokens) -> Column:
    """Append a last piece under `minimum` tokens to the one before it."""
    def merged(ps):
        n = F.size(ps)
        joined = F.concat_ws(" ", F.get(ps, n - 2), F.get(ps, n - 1))
        return F.when(
            (n > 1) & (counter(F.get(ps, n - 1)) < minimum),
            F.concat(F.slice(ps, F.lit(1), n - 2), F.array(joined)),
        ).otherwise(ps)

    return let(pieces, merged)


def pack_sentences(
    text: Column, target: int, overlap: int, counter: TokenCounter = count_tokens
) -> Column:
    """The packed pieces of a text, as an array of strings."""
    return pack_split(sentences(text), target, overlap, counter)


def pack_split(sents: Column, target: int, overlap: int, counter: TokenCounter = count_tokens) -> Column:
    """`pack_sentences` of the sentences of a text; `sents` is worked out twice unless it is a column."""
    sizes = F.transform(sents, lambda s: counter(s).cast("int"))
    both = F.struct(sents.alias("sents"), sentence_spans(sizes, target, overlap).alias("spans"))
    return let(both, lambda x: F.transform(
        x["spans"], lambda p: F.array_join(F.slice(x["sents"], p["start"] + 1, p["stop"] - p["start"]), " ")))


def chunk_sections(
    sections: DataFrame,
    settings: Settings = Settings(),
    counter: TokenCounter = count_tokens,
) -> DataFrame:
    """Chunks of every section: adds chunk_id, piece, text and n_tokens to the section's columns.

    A chunk never spans two sections. The piece number is given before tiny pieces are dropped,
    so gaps in it are normal.
    """
    packed = merge_short_tail(
        pack_split(
            F.col("_sents"), settings.chunk_target_tokens, settings.chunk_overlap_tokens, counter
        ),
        settings.chunk_min_tokens,
        counter,
    )
    # Counted before the rows are dealt out: a filter on a computed column would count twice.
    counted = F.transform(
        packed, lambda p: F.struct(p.alias("text"), counter(p).cast("int").alias("n_tokens"))
    )
    kept = [c for c in sections.columns if c not in ("text", "heading_level")]
    split = sections.select(*kept, sentences(F.col("text")).alias("_sents"))
    rows = unroll(split.select(*kept, counted.alias("_pieces")), "_pieces", "_p", "piece")
    return rows.where(F.col("_p.n_tokens") >= settings.chunk_drop_below_tokens).select(
        *kept, "piece", "_p.text", "_p.n_tokens",
        F.format_string("%s::%04d::%02d", F.col("doc_id").cast("string"), "seq", "piece").alias("chunk_id"),
    )


def contextual_text(title: Column, section_path: Column, body: Column) -> Column:
    """What is embedded: the body under its title and section path."""
    return F.concat(title, F.lit(" — "), section_path, F.lit("\n\n"), body)


def index_text(title: Column, section_path: Column, body: Column) -> Column:
    """What is indexed lexically: title, section path and body."""
    return F.concat_ws(" ", title, section_path, body)


def as_chunk_records(
    chunks: DataFrame, manifest: DataFrame, settings: Settings = Settings(), stamp: Column | None = None
) -> DataFrame:
    """Chunks with the provenance of their document, in the stored column order."""
    when = stamp if stamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    about = manifest.select(
        "doc_id", "title", F.col("url").alias("source_url"), "publisher", "specialty",
        F.col("version").alias("doc_version"),
    )
    return chunks.join(about, "doc_id").select(
        "chunk_id", "doc_id", "title", "source_url", "publisher", "specialty",
        F.col("path").alias("section_path"), "page_start", "page_end", "text", "n_tokens",
        "doc_version", F.lit(settings.index_version).alias("index_version"), when.alias("ingested_at"),
    )
