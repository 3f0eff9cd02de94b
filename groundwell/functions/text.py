"""Text column functions: tokens, sentences, numbers, words, cleaning.

All are `Column -> Column` built from Spark's own functions, so they run in the scan stage
without a shuffle and without Python workers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results. WS is Unicode white space, spelled out because
# Java's \s is ASCII only.
WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARS = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
TOKEN = r"[a-z0-9]+(?:-[a-z0-9]+)*"
WORD = r"[a-z0-9]+"
QUERY_WORD = r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"
SENTENCE_BREAK = rf"(?<=[.!?:]){WS}+(?=[A-Z(])|\n+"
PROSE_BREAK = rf"(?<=[.!?]){WS}+"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"
GROUPING = r"(?<=[0-9]),(?=[0-9]{2,3}\b)"
MARKER = rf"\[(?:C[0-9]+)(?:{WS}*,{WS}*C[0-9]+)*\]"
LIST_NUMBER = rf"(?m)(^|[.!?]{WS}+)[0-9]+[.)]{WS}"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"

#: How long a text is, in tokens. Any `Column -> Column` can stand in for the default.
TokenCounter = Callable[[Column], Column]


def _find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends (Spark's `trim` takes spaces only)."""
    return F.btrim(text, F.lit(WS_CHARS))


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, rf"{WS}+", " "))


def tokens(text: Column) -> Column:
    """Lower-case index terms; hyphens inside a word are kept, nothing is stemmed or stopped."""
    return _find_all(F.lower(text), TOKEN)


def words(text: Column) -> Column:
    """The set of lower-case words, as a distinct array."""
    return F.array_distinct(_find_all(F.lower(text), WORD))


def count_tokens(text: Column) -> Column:
    """Offline token count: runs of letters and digits, and each other visible character.

    Every run shrinks to one character and white space goes, so what is left is as long as the
    count; that builds no array of matches.
    """
    return F.length(F.regexp_replace(F.regexp_replace(text, "[A-Za-z0-9]+", "x"), r"\s+", ""))


def _non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Sentence-like pieces: break after . ! ? : before a capital or bracket, and at line ends."""
    return _non_blank(F.split(text, SENTENCE_BREAK))


def prose_sentences(text: Column) -> Column:
    """Pieces of answer prose: break after . ! ? and white space; untrimmed as split."""
    return F.split(strip(text), PROSE_BREAK)


def strip_markers(text: Column) -> Column:
    """Remove citation markers such as [C1, C2], then list numbering."""
    return F.regexp_replace(F.regexp_replace(text, MARKER, " "), LIST_NUMBER, "$1 ")


def numbers(text: Column) -> Column:
    """Distinct quantities as strings: grouping commas dropped, leading zeros dropped."""
    found = _find_all(F.regexp_replace(text, GROUPING, ""), NUMBER)
    return F.array_distinct(
        F.transform(
            found,
            lambda n: F.coalesce(F.nullif(F.regexp_replace(n, "^0+", ""), F.lit("")), F.lit("0")),
        )
    )


def letters(text: Column) -> Column:
    """How many letters a text holds."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def overlap_share(part: Column, whole: Column) -> Column:
    """|part AND whole| / |part| over word sets; 0 when `part` is empty."""
    return F.when(
        F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)
    ).otherwise(F.lit(0.0))


# Characters a recogniser confuses on Latin pages, and what they stand for.
CONFUSIONS = (
    ("一", "-"), ("二", "II"), ("三", "III"), ("四", "IV"),
    ("，", ","), ("：", ":"), ("；", ";"), ("．", "."),
    ("（", "("), ("）", ")"), ("＜", "<"), ("＞", ">"),
    ("％", "%"), ("／", "/"), ("‘", "'"), ("’", "'"),
    ("“", '"'), ("”", '"'), ("　", " "),
)
CJK = r"[\x{2e80}-\x{9fff}\x{ac00}-\x{d7ff}\x{ff00}-\x{ffef}]"


def clean_recognised(text: Column) -> Column:
    """Repair text read from page images: confused characters, stray ideographs, spacing."""
    for wrong, right in CONFUSIONS:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    text = F.regexp_replace(text, CJK, "")
    text = F.regexp_replace(text, rf"{WS}+([,;:)%])", "$1")
    text = F.regexp_replace(text, rf"([(]){WS}+", "$1")
    return strip(F.regexp_replace(text, r"[ \t]{2,}", " "))


def slug(name: Column) -> Column:
    """File name to identifier: lower case, runs of other characters become one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_case(text: Column) -> Column:
    """Capitalise after every non-letter (Spark's `initcap` does so after spaces only)."""
    parts = _find_all(text, r"\p{L}+|[^\p{L}]+")
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))),
        ),
        "",
    )
