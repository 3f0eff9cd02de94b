"""The allow-list of documents: comparing it with what is there, and the record of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.bind import let
from ..functions.text import strip, title_case

# What a usable title looks like.
TITLE_CHARS = (8, 130)
TITLE_LINES = 40
# Pages that may carry a cover title, the share of the largest size its lines have, lines that are none,
# and stored titles that only name a program or a file.
COVER_PAGES, COVER_SIZE = 3, 0.95
NOT_A_COVER_LINE = (
    r"(?i)^(page\s*(no\.?|\d+)|contents?|index|topics?|s\.?l?\.?\s*no\.?|table of contents|chapter\s*\d*|\d+)\.?$"
)
PROGRAM_TITLE = r"(?i)^(microsoft word|untitled|document\d*|book\d*|\d+)|\.(docx?|cdr|indd|pdf)$"


def diff(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """filename, status: ok, missing, changed or unlisted, from (filename, sha256) on both sides."""
    listed = manifest.select("filename", F.col("sha256").alias("_listed"), F.lit(True).alias("_in_list"))
    there = found.select("filename", F.col("sha256").alias("_found"), F.lit(True).alias("_there"))
    status = (
        F.when(F.col("_there").isNull(), "missing")
        .when(F.col("_in_list").isNull(), "unlisted")
        .when(F.col("_listed") == F.col("_found"), "ok")
        .otherwise("changed")
    )
    return listed.join(there, "filename", "full_outer").select("filename", status.alias("status"))


def diff_summary(statuses: DataFrame) -> DataFrame:
    """One row: how many files are ok, missing, unlisted, changed, and whether all is clean."""
    one = statuses.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "missing", "unlisted", "changed")])
    return one.withColumn("clean", (F.col("missing") + F.col("unlisted") + F.col("changed")) == 0)


def name_title(filename: Column) -> Column:
    """A file name without its ending, tidied."""
    return title_case(strip(F.translate(F.regexp_replace(filename, r"\.[^.]*$", ""), "_-", "  ")))


def cover_titles(lines: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, title for every row of files(doc_id, filename, stored_title), from typeset lines(doc_id, line_no, page, size, text).

    The first of the first three pages whose largest lines, joined in reading order, read like a title gives it; else
    the stored title, unless it names a program; else the file name. Only lines of those pages are shuffled, and a
    page's lines are gathered only where together they are short enough for a title. Documents without lines count.
    """
    page = W.partitionBy("doc_id", "page")
    shown = lines.where(F.col("page") <= COVER_PAGES).select(
        "doc_id", "page", "line_no", F.round("size", 1).alias("size"), strip(F.col("text")).alias("text")
    ).where(F.col("text") != "")
    large = (
        shown.withColumn("_largest", F.max("size").over(page))
        .where((F.col("size") >= F.col("_largest") * COVER_SIZE) & ~F.col("text").rlike(NOT_A_COVER_LINE))
        .withColumn("text", F.regexp_replace("text", r"\s+", " "))
        .withColumn("_chars", F.sum(F.length("text") + 1).over(page) - 1)
        .where(F.col("_chars").between(*TITLE_CHARS))
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    titles = large.groupBy("doc_id", "page").agg(joined.alias("t"))
    titles = titles.where(F.size(F.filter(F.split("t", " "), lambda w: w.rlike(r"\p{L}"))) >= 2)
    first = titles.groupBy("doc_id").agg(F.min_by("t", "page").alias("_cover"))
    stored = strip(F.col("stored_title"))
    return files.join(first, "doc_id", "left").select("doc_id", F.coalesce(
        F.when(F.col("_cover") == F.upper("_cover"), title_case(F.col("_cover"))).otherwise(F.col("_cover")),
        F.when((F.length(stored) > 3) & ~stored.rlike(PROGRAM_TITLE), stored),
        name_title(F.col("filename")),
    ).alias("title"))


def text_title(text: Column, filename: Column) -> Column:
    """First title-shaped line among the first forty, else the tidied file name."""
    def title_like(t):
        named = F.filter(F.split(t, r"\s+"), lambda w: w.rlike(r"^\p{L}+$"))
        return F.length(t).between(*TITLE_CHARS) & (F.size(named) >= 2)

    lines = F.slice(F.split(text, r"\r\n|\n|\r"), 1, TITLE_LINES)
    shaped = F.filter(
        F.transform(lines, lambda ln: strip(F.regexp_replace(strip(ln), "^#+", ""))), title_like
    )
    return let(
        F.get(shaped, F.lit(0)),
        lambda t: F.when(t.isNull(), name_title(filename))
        .when(t == F.upper(t), title_case(t))
        .otherwise(t),
    )


def indexed(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Listed documents that contributed chunks."""
    return manifest.join(chunks.select("doc_id").distinct(), "doc_id", "left_semi")


def skipped(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Listed documents that contributed none."""
    return manifest.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")


def ingest_report(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, sections, chunks, tokens, mean_tokens per document; no mean for one without chunks."""
    cut = sections.groupBy("doc_id").agg(F.count("*").alias("sections"))
    made = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens"))
    both = cut.join(made, "doc_id", "left").na.fill(0, ["chunks", "tokens"])
    return both.withColumn("mean_tokens", F.try_divide("tokens", "chunks"))
