"""Plain text documents to sections.

The whole walk happens inside the row that holds the document, so it is a map over the input:
no shuffle, no regrouping of lines, and each document costs in proportion to its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let, unroll
from ..functions.text import LINE_BREAK, strip
from .headings import PAGE_MARKER, heading_paths, is_front_matter, text_level, text_title

MIN_CHARS_PER_PAGE = 100  # fixed value: less than this is a scan without a text layer


def _page_lines(page: Column, page_no: Column) -> Column:
    """Lines of one page with blank-neighbour flags and the page number in force."""

    def build(lines):
        # Only markers are cast: a cast that fails costs far more than the match.
        numbered = F.transform(
            lines,
            lambda s, i: F.struct(
                i.alias("i"),
                F.when(s.rlike(PAGE_MARKER), F.regexp_extract(s, PAGE_MARKER, 1).try_cast("int")).alias("number"),
            ),
        )
        marks = F.filter(numbered, lambda m: m["number"].isNotNull())
        return let(
            marks,
            lambda ms: F.transform(
                lines,
                lambda s, i: F.struct(
                    s.alias("text"),
                    F.aggregate(
                        ms, page_no, lambda acc, m: F.when(m["i"] < i, m["number"]).otherwise(acc)
                    ).alias("page"),
                    ((i == 0) | (F.get(lines, i - 1) == "")).alias("prev_blank"),
                    ((i + 1 >= F.size(lines)) | (F.get(lines, i + 1) == "")).alias("next_blank"),
                ),
            ),
        )

    return let(F.transform(F.split(page, LINE_BREAK), strip), build)


def text_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with `lines`: visible lines, their page and heading level.

    A form feed is the only evidence of pages. A page marker line moves the page number for the
    rest of its page; without form feeds every page number is 0, meaning unknown.
    """
    pages = F.split(F.col(text), "\f")
    lines = F.flatten(F.transform(F.col("_pages"), lambda p, i: _page_lines(p, i + 1)))
    kept = F.filter(lines, lambda ln: (ln["text"] != "") & ~ln["text"].rlike(PAGE_MARKER))
    levelled = F.transform(
        kept,
        lambda ln: F.struct(
            ln["text"].alias("text"),
            F.when(F.size("_pages") > 1, ln["page"]).otherwise(F.lit(0)).alias("page"),
            text_level(ln["text"], ln["prev_blank"], ln["next_blank"]).alias("level"),
        ),
    )
    return (
        docs.where(F.col(text).isNotNull())
        .select(F.col(doc_id).alias("doc_id"), pages.alias("_pages"))
        .select("doc_id", F.size("_pages").alias("n_pages"), levelled.alias("lines"))
    )


def heading_levels(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every visible line with its heading level."""
    rows = unroll(text_lines(docs, doc_id, text).select("doc_id", "lines"), "lines", "line", "line_no")
    return rows.select("doc_id", "line_no", "line.text", "line.level")


def parse_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pages, n_chars and an ordered `sections` array per document."""
    marked = F.filter(
        F.transform(F.col("lines"), lambda ln, i: F.struct(i.alias("at"), ln.alias("ln"))),
        lambda m: m["ln"]["level"] > 0,
    )
    heads = F.transform(
        marked,
        lambda m: F.struct(
            m["at"].alias("at"), m["ln"]["level"].cast("double").alias("rank"),
            text_title(m["ln"]["text"]).alias("title"), m["ln"]["page"].alias("page"),
        ),
    )
    titled = F.zip_with(
        F.col("heads"),
        heading_paths(F.col("heads"), lambda opened, new: opened < new),
        lambda h, p: F.struct(
            h["at"].alias("at"), h["page"].alias("page"), p["path"].alias("path"),
            p["depth"].alias("depth"), is_front_matter(h["title"]).alias("front"),
        ),
    )
    untitled = F.array(
        F.struct(
            F.lit(-1).alias("at"), F.get("lines", F.lit(0))["page"].alias("page"),
            F.lit("Body").alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("front"),
        )
    )
    starts = F.when(
        F.coalesce(F.get("heads", F.lit(0))["at"], F.lit(-1)) == 0, titled
    ).otherwise(F.concat(untitled, titled))

    def section(start, k):
        stop = F.coalesce(F.get("starts", k + 1)["at"], F.size("lines"))
        body = F.slice("lines", start["at"] + 2, stop - start["at"] - 1)
        return let(
            body,
            lambda b: F.struct(
                start["path"].alias("path"),
                start["page"].alias("page_start"),
                F.coalesce(F.try_element_at(b, F.lit(-1))["page"], start["page"]).alias("page_end"),
                F.array_join(F.transform(b, lambda ln: ln["text"]), "\n").alias("text"),
                start["depth"].alias("heading_level"),
                start["front"].alias("front"),
            ),
        )

    kept = F.filter(
        F.transform(F.col("starts"), section), lambda s: (s["text"] != "") & ~s["front"]
    )
    seen = F.aggregate("lines", F.lit(0), lambda acc, ln: acc + F.length(ln["text"]))
    return (
        text_lines(docs, doc_id, text)
        .withColumn("heads", heads)
        .withColumn("starts", starts)
        .select(
            "doc_id", "n_pages", seen.alias("_seen"),
            F.transform(kept, lambda s: s.dropFields("front")).alias("sections"),
        )
        .select(
            "doc_id", "n_pages",
            F.greatest(
                F.col("_seen"),
                F.when(F.size("sections") > 0, F.lit(MIN_CHARS_PER_PAGE) * F.col("n_pages")).otherwise(F.lit(0)),
            ).alias("n_chars"),
            "sections",
        )
    )


def has_text_layer() -> Column:
    return F.coalesce(F.try_divide(F.col("n_chars"), F.col("n_pages")), F.lit(0.0)) >= MIN_CHARS_PER_PAGE


def explode_sections(parsed: DataFrame) -> DataFrame:
    """doc_id, seq, path, page_start, page_end, text, heading_level."""
    return unroll(parsed.select("doc_id", "sections"), "sections", "s", "seq").select(
        "doc_id", "seq", "s.path", "s.page_start", "s.page_end", "s.text", "s.heading_level"
    )
