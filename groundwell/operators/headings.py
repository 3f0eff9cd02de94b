"""What makes a line a heading, a page number, a page marker or front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import WS, letters, strip

# Patterns and limits that decide how documents are cut.
FRONT_MATTER = (
    r"(?i)^\s*(table\s+of\s+)?contents?\s*$|^\s*(acknowledge?ments?|foreword|preface"
    r"|abbreviations?|list\s+of\s+(tables?|figures?|contributors?|abbreviations?)"
    r"|contributors?|expert\s+group|copyright|disclaimer|message\s+from"
    r"|about\s+(this|the)\s+\w+|references?|further\s+reading"
    r"|bibliography|suggested\s+reading)\s*$"
)
KNOWN_SECTION = (
    r"(?i)^\s*(?:\d+(?:\.\d+)*\s*[.)]?\s*)?("
    r"case\s+definition|introduction|incidence|epidemiology|aetiology|etiology"
    r"|risk\s+factors?|clinical\s+features?|signs?\s+and\s+symptoms?"
    r"|differential\s+diagnos[ei]s|diagnos(?:is|tic\s+criteria)"
    r"|investigations?|laboratory\s+\w+|management|treatment(?:\s+\w+)?"
    r"|pharmacological\s+\w+|non[- ]pharmacological\s+\w+"
    r"|prevention|prophylaxis|follow[- ]?up|referral\s+criteria"
    r"|complications?|prognosis|counsell?ing|references?"
    r")\s*:?\s*$"
)
PAGE_NUMBER = r"(?i)^(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?$"
PAGE_MARKER = r"(?i)^\s*(?:\[\[|<)?\s*page\s+(\d+)\s*(?:\]\]|>)?\s*$"
HASH_HEADING = r"^(#{1,6})\s+(.+?)\s*#*$"
NUMBERED = r"^\s*(\d+(?:\.\d+)*)\.?\s+(\S.*)$"
ALL_CAPS = r"^[^a-z]*[A-Z][^a-z]{2,}$"
INNER_SENTENCE = r"[.!?]\s+\S"
MAX_LINE, MAX_NUMBERED, MAX_CAPS, MAX_ALONE = 110, 90, 80, 70
MAX_TITLE_WORDS = 9
MIN_LETTERS, MIN_NUMBERED_LETTERS = 4, 3
HEADING_RATIO, CHAPTER_RATIO, BOLD_RATIO = 1.12, 1.15, 0.98
MAX_TYPESET_LINE, MAX_BOLD_LINE = 120, 80
PATH_DEPTH = 4
PATH_SEPARATOR = " > "

VISIBLE = f"[^{WS[1:]}"
# A letter between white space. Most letters leave at the one after them, before the dear class is asked.
LONE_LETTER = rf"(?=\p{{L}}(?!\p{{L}}))(?<!{VISIBLE})\p{{L}}(?!{VISIBLE})"


def is_front_matter(title: Column) -> Column:
    return title.rlike(FRONT_MATTER)


def is_page_number(text: Column) -> Column:
    return strip(text).rlike(PAGE_NUMBER)


def _ends_with_any(text: Column, marks: str) -> Column:
    return F.substring(text, -1, 1).isin(*marks)


def _word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{VISIBLE}+"))


def text_level(text: Column, prev_blank: Column, next_blank: Column) -> Column:
    """Heading level 1-6 of a stripped plain-text line, 0 for body text. First rule wins."""
    size = F.length(text)
    title = F.regexp_extract(text, NUMBERED, 2)
    lone_letters = F.regexp_count(text, F.lit(LONE_LETTER))
    numbered = (
        text.rlike(NUMBERED)
        & (size <= MAX_NUMBERED)
        & ~_ends_with_any(text, ".;,")
        & (_word_count(title) <= MAX_TITLE_WORDS)
        & (letters(title) >= MIN_NUMBERED_LETTERS)
        & ~title.rlike(INNER_SENTENCE)
    )
    dots = F.regexp_count(F.regexp_extract(text, NUMBERED, 1), F.lit(r"\."))
    capitals = text.rlike(ALL_CAPS) & size.between(3, MAX_CAPS) & (letters(text) >= MIN_LETTERS)
    alone = (
        prev_blank & next_blank & (size <= MAX_ALONE)
        & ~_ends_with_any(text, ".;,:")
        & text.rlike(r"^\p{Lu}")
        & (letters(text) >= MIN_LETTERS)
    )
    return (
        F.when((size == 0) | (size > MAX_LINE), 0)
        .when(text.rlike(HASH_HEADING), F.length(F.regexp_extract(text, HASH_HEADING, 1)))
        .when(lone_letters >= 2, 0)
        .when(numbered, F.least(F.lit(6), dots + 1))
        .when(capitals, 1)
        .when(alone, 2)
        .otherwise(0)
    )


def text_title(text: Column) -> Column:
    """The heading without its hashes or closing colons."""
    return F.when(text.rlike(HASH_HEADING), strip(F.regexp_extract(text, HASH_HEADING, 2))).otherwise(
        strip(F.regexp_replace(text, ":+$", ""))
    )


def typeset_heading(text: Column, size: Column, bold: Column, block_lines: Column, body: Column) -> Column:
    """Whether a typeset line is a heading, judged against the document's body size."""
    shaped = (F.length(text) <= MAX_TYPESET_LINE) & ~_ends_with_any(text, ".;,")
    own_block = bold & (block_lines == 1) & (F.length(text) <= MAX_BOLD_LINE) & (size >= body * BOLD_RATIO)
    return shaped & ((size >= body * HEADING_RATIO) | text.rlike(KNOWN_SECTION) | own_block)


def typeset_title(text: Column) -> Column:
    return strip(F.regexp_replace(text, ":+$", ""))


def render_path(titles: Column) -> Column:
    """The last four titles that are not front matter, joined; `Body` when none is left."""
    shown = F.filter(titles, lambda t: ~is_front_matter(t))
    return let(
        shown,
        lambda s: F.when(
            F.size(s) > 0,
            F.array_join(F.slice(s, F.greatest(F.size(s) - (PATH_DEPTH - 1), F.lit(1)), F.lit(PATH_DEPTH)), PATH_SEPARATOR),
        ).otherwise(F.lit("Body")),
    )


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"(?s)^(.*) > .*$", "$1")


def leaf_title(path: Column) -> Column:
    return F.regexp_replace(path, r"(?s)^.* > ", "")


def heading_paths(heads: Column, outranks, title_field: str = "title", reset_field: str | None = None) -> Column:
    """Walk an ordered heading array and give each heading its path and depth.

    `outranks(open, new)` says whether an open heading stays an ancestor of the new one. Ranks on
    the open stack are strictly ordered, so keeping those that outrank the newcomer is the same
    as popping the rest.
    """
    stack_type = "array<struct<rank:double,title:string>>"
    out_type = "array<struct<path:string,depth:int>>"

    def step(state, head):
        opened = F.filter(state["stack"], lambda e: outranks(e["rank"], head["rank"]))
        if reset_field:
            opened = F.when(head[reset_field], F.array().cast(stack_type)).otherwise(opened)
        grown = F.concat(
            opened, F.array(F.struct(head["rank"].cast("double").alias("rank"), head[title_field].alias("title")))
        )
        return let(
            grown,
            lambda stack: F.struct(
                stack.alias("stack"),
                F.concat(
                    state["out"],
                    F.array(
                        F.struct(
                            render_path(F.transform(stack, lambda e: e["title"])).alias("path"),
                            F.size(stack).alias("depth"),
                        )
                    ),
                ).alias("out"),
            ),
        )

    start = F.struct(F.array().cast(stack_type).alias("stack"), F.array().cast(out_type).alias("out"))
    return F.aggregate(heads, start, step, lambda s: s["out"])
