"""Typeset lines (text, page, size, bold, block_lines) to sections.

Lines stay rows. Sums over a document are taken per page first, so that a document holding a
large share of all lines is worked on page by page. Only its headings and the sizes of its
sections, never its text, are gathered to walk the heading stack and to fold short sections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bind import before, unroll
from ..functions.text import strip
from ..session import cut_lineage
from .headings import (
    CHAPTER_RATIO,
    PATH_SEPARATOR,
    heading_paths,
    is_front_matter,
    is_page_number,
    leaf_title,
    parent_path,
    typeset_heading,
    typeset_title,
)

# Defaults and limits of the line parser.
DEFAULT_BODY_SIZE = 10.0
FURNITURE_SHARE, FURNITURE_PAGES = 0.4, 3
COVER_FROM_PAGES = 4
SHORT_SECTION = 200


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body: the font size carrying most characters; the first seen wins a tie."""
    return (
        lines.groupBy("doc_id", "size")
        .agg(F.sum(F.length("text")).alias("_chars"), F.min("line_no").alias("_first"))
        .groupBy("doc_id")
        .agg(F.max_by("size", F.struct(F.col("_chars"), -F.col("_first"))).alias("body"))
    )


def page_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.max("page").alias("n_pages"))


def _furniture_text() -> Column:
    return F.lower(strip(F.col("text")))


def _digest() -> Column:
    """Stands for a line's text, so that finding furniture moves no text."""
    return F.unhex(F.md5(_furniture_text().cast("binary")))


def furniture(
    lines: DataFrame, pages: DataFrame, share: float = FURNITURE_SHARE, least: int = FURNITURE_PAGES,
    named: Callable[[], Column] = _furniture_text,
) -> DataFrame:
    """doc_id, furniture, n_on: running headers and footers, found by the pages they recur on."""
    recurring = (
        lines.select("doc_id", named().alias("furniture"), "page").distinct()
        .groupBy("doc_id", "furniture").agg(F.count("*").alias("n_on"))
        .where(F.col("n_on") >= least)
    )
    threshold = F.greatest(F.lit(least), F.floor(F.col("n_pages") * share))
    return (
        recurring.join(pages, "doc_id")
        .where((F.col("n_pages") >= 3) & (F.col("n_on") >= threshold))
        .select("doc_id", "furniture", "n_on")
    )


def _content(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines without page numbers and furniture, with the document's body size and page count.

    Furniture stands on a share of the pages, so a document has a few pages' worth of it at most: its digests are one
    array, and the lines' text moves once, to meet all that is known of their document.
    """
    running = furniture(lines, pages, named=_digest).groupBy("doc_id").agg(F.collect_list("furniture").alias("_furniture"))
    about = body_size(lines).join(pages, "doc_id").join(running, "doc_id", "left")
    kept = lines.where(~is_page_number(F.col("text"))).join(about, "doc_id")
    return kept.where(~F.coalesce(F.array_contains("_furniture", _digest()), F.lit(False))).drop("_furniture")


def headed_lines(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Content lines with `is_heading`, `resets` (opens a chapter), `on_cover` and `section`."""
    pages = page_counts(lines) if pages is None else pages
    on_page = W.partitionBy("doc_id", "page").orderBy("line_no")
    so_far = on_page.rowsBetween(W.unboundedPreceding, 0)
    marked = (
        _content(lines, pages)
        .withColumn("on_cover", (F.col("n_pages") > COVER_FROM_PAGES) & (F.col("page") <= 1))
        .withColumn("_leads", F.row_number().over(on_page) == 1)
        .withColumn(
            "is_heading",
            ~F.col("on_cover")
            & typeset_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("block_lines"), F.col("body")),
        )
        .withColumn("resets", F.col("is_heading") & F.col("_leads") & (F.col("size") >= F.col("body") * CHAPTER_RATIO))
        .withColumn("_one", F.col("is_heading").cast("long"))
        # the running total of a page, while its lines are together
        .withColumn("_within", F.sum("_one").over(so_far))
        .drop("_leads")
    )
    return before(cut_lineage(marked), ["doc_id"], "page", "_one", "_within", "section").drop("_one")


def raw_sections(headed: DataFrame) -> DataFrame:
    """doc_id, section, path, page_start, page_end, text, heading_level, front; empty ones dropped."""
    heads = (
        headed.where("is_heading")
        .groupBy("doc_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "section", F.col("size").alias("rank"), typeset_title(F.col("text")).alias("title"),
                        "resets", "page",
                    )
                )
            ).alias("heads")
        )
        .withColumn(
            "paths", heading_paths(F.col("heads"), lambda opened, new: opened > new, reset_field="resets")
        )
        .select("doc_id", F.arrays_zip("heads", "paths").alias("both"))
    )
    titled = unroll(heads, "both", "b").select(
        "doc_id", "b.heads.section", "b.paths.path", F.col("b.heads.page").alias("_head_page"),
        F.col("b.paths.depth").alias("heading_level"), is_front_matter(F.col("b.heads.title")).alias("front"),
    )
    bodies = headed.where(~F.col("is_heading")).groupBy("doc_id", "section").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("_lines"),
        F.min("page").alias("_first_page"), F.max_by("page", "line_no").alias("page_end"),
        F.max("on_cover").alias("_cover"),
    )
    text = strip(F.array_join(F.transform("_lines", lambda ln: ln["text"]), "\n"))
    untitled = F.when(F.col("_cover"), "Front cover").otherwise("Preamble")
    return (
        bodies.join(titled, ["doc_id", "section"], "left")
        .select(
            "doc_id", "section", F.coalesce("path", untitled).alias("path"),
            F.coalesce("_head_page", "_first_page").alias("page_start"), "page_end", text.alias("text"),
            F.coalesce("heading_level", F.lit(0)).alias("heading_level"),
            F.coalesce("front", F.lit(False)).alias("front"),
        )
        .where(F.col("text") != "")
    )


def fold_short(sections: DataFrame) -> DataFrame:
    """Fold short sections into the one before under the same parent; number what is left.

    The fold reads lengths and paths only. A section that joins takes the group of the one before
    and lifts that group's path to the shared parent, so the next comparison is one level up.
    """
    step_type = "array<struct<section:long,grp:int,path:string>>"
    entry = F.struct("section", F.col("path"), F.length("text").alias("size"))
    ordered = sections.where(~F.col("front")).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(entry)).alias("entries")
    )

    def step(out, e):
        last = F.get(out, F.size(out) - 1)
        joins = F.coalesce(
            (e["size"] < SHORT_SECTION)
            & F.contains(e["path"], F.lit(PATH_SEPARATOR))
            & (parent_path(e["path"]) == parent_path(last["path"])),
            F.lit(False),
        )
        placed = F.struct(
            e["section"].alias("section"),
            F.when(joins, last["grp"]).otherwise(F.coalesce(last["grp"] + 1, F.lit(0))).alias("grp"),
            F.when(joins, parent_path(e["path"])).otherwise(e["path"]).alias("path"),
        )
        return F.concat(out, F.array(placed))

    placed = ordered.select(
        "doc_id", F.aggregate("entries", F.array().cast(step_type), step).alias("placed")
    )
    first = W.partitionBy("doc_id", "grp").orderBy("section")
    groups = unroll(placed, "placed", "p").select("doc_id", "p.section", "p.grp", F.col("p.path").alias("_path"))
    groups = groups.withColumn("_n", F.row_number().over(first))
    piece = F.when(F.col("_n") == 1, F.col("text")).otherwise(
        F.concat(leaf_title(F.col("path")), F.lit(": "), F.col("text"))
    )
    return (
        sections.join(groups, ["doc_id", "section"])
        .groupBy("doc_id", F.col("grp").alias("seq"))
        .agg(
            F.max_by("_path", "section").alias("path"), F.min_by("page_start", "section").alias("page_start"),
            F.max("page_end").alias("page_end"),
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct(F.col("section"), piece.alias("t")))), lambda x: x["t"]
                ),
                "\n",
            ).alias("text"),
            F.min_by("heading_level", "section").alias("heading_level"),
        )
    )


def parse_lines(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, path, page_start, page_end, text, heading_level."""
    return fold_short(cut_lineage(raw_sections(headed_lines(lines, pages))))


def document_sizes(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, n_pages, n_chars: what the text-layer rule reads."""
    pages = page_counts(lines) if pages is None else pages
    chars = lines.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n_chars"))
    return pages.join(chars, "doc_id", "left").withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))
