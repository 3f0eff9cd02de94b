"""Manifest-gated ingestion: files to sections to chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import TokenCounter, count_tokens
from ..operators import manifest as m
from ..operators.chunking import as_chunk_records, chunk_sections
from ..operators.sections_lines import document_sizes, page_counts, parse_lines
from ..operators.sections_text import explode_sections, has_text_layer, parse_text
from ..session import cut_lineage


class CorpusNotClean(RuntimeError):
    """The folder and the manifest disagree."""


@dataclass(frozen=True)
class Ingested:
    chunks: DataFrame
    report: DataFrame
    skipped: DataFrame


def _refuse_unclean(statuses: DataFrame) -> None:
    counts = m.diff_summary(statuses).first()
    if not counts["clean"]:
        raise CorpusNotClean(
            f"{counts['unlisted']} unlisted, {counts['changed']} changed and {counts['missing']} missing "
            "file(s); rescan the folder, or ingest without strictness to take only what matches"
        )


def ingest(
    manifest: DataFrame,
    texts: DataFrame,
    lines: DataFrame | None = None,
    strict: bool = True,
    settings: Settings = Settings(),
    counter: TokenCounter = count_tokens,
    files: DataFrame | None = None,
) -> Ingested:
    """Chunks of every listed document whose file matches its recorded digest.

    texts: (filename, sha256, text); lines: typeset lines with (filename, sha256) in place of
    doc_id. files: the typeset files (filename, sha256, n_pages) beside their lines, which then need no digest; a file of
    which no line could be read, as of scanned pages, is there as well and its pages count. Documents without a
    text layer, and those giving no chunks, are named in `skipped`.
    """
    found = texts.select("filename", "sha256")
    if files is not None:
        found = found.unionByName(files.select("filename", "sha256"))
    elif lines is not None:
        found = found.unionByName(lines.select("filename", "sha256").distinct())
    statuses = cut_lineage(m.diff(manifest, found))
    if strict:
        _refuse_unclean(statuses)
    allowed = manifest.join(statuses.where(F.col("status") == "ok"), "filename", "left_semi")
    names = allowed.select("filename", "doc_id")

    parsed = parse_text(texts.drop("doc_id").join(names, "filename"))
    layered = has_text_layer()
    sections = explode_sections(parsed.where(layered))
    sizes = parsed.select("doc_id", "n_pages", "n_chars")
    if lines is not None:
        own = cut_lineage(lines.drop("doc_id").join(names, "filename").drop("filename", "sha256"))
        pages = files.select("filename", "n_pages").join(names, "filename").select("doc_id", "n_pages") if files is not None else None
        line_sizes = document_sizes(own, pages)
        line_sizes = cut_lineage(line_sizes)
        # only lines of documents whose pages are given are parsed
        readable = line_sizes.where(layered).select("doc_id").distinct()
        known = (page_counts(own) if pages is None else pages).join(readable, "doc_id", "left_semi")
        sections = sections.unionByName(parse_lines(own, known).withColumn("seq", F.col("seq").cast("int")))
        sizes = sizes.unionByName(line_sizes.select("doc_id", "n_pages", "n_chars"))

    sections = cut_lineage(sections)
    chunks = cut_lineage(as_chunk_records(chunk_sections(sections, settings, counter), allowed, settings))
    why = F.when(
        ~layered,
        F.format_string(
            "no extractable text layer (%.0f chars/page over %d pages) - scanned images, needs OCR",
            F.coalesce(F.try_divide(F.col("n_chars"), F.col("n_pages")), F.lit(0.0)), F.col("n_pages"),
        ),
    ).otherwise("parsed but produced no chunks")
    skipped = m.skipped(sizes, chunks).select("doc_id", why.alias("reason"))
    return Ingested(chunks, m.ingest_report(sections, chunks), skipped)
