"""Personal data replaced by made-up data of the same kind.

Found entities are brought to a plain form, so that spellings of one entity count as one, and each distinct
entity gets one surrogate for the whole corpus, drawn from a keyed digest: people stay apart, and the
same person stays the same. A surrogate that equals another one or an entity of the corpus is drawn anew.
Occurrences then take the surrogate in their own format: digits in the same places, the same
letter case, given names of the title's gender, letters of the same script. Names are found after a title; wherever
a name found so stands in the same document without one, it takes the same surrogate. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.bind import let

from .common import stored, whole

# Titles by gender, and alphabets by script.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "г-жа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "г-н"),
    "n": ("Dr", "Prof", "Professor", "Doctor", "Doktor", "Docteur", "д-р", "проф"),
}
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
CONSONANTS = {"latin": "bdfgklmnprstv", "cyrillic": "бвгдклмнпрст", "greek": "βγδκλμνπρστ"}

_TITLE = r"(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?"
# Letters with inner hyphens and apostrophes, but no 's at the end; an initial counts only in a row of names.
_PART = r"['’-](?!s(?!\p{L}))\p{L}++"
_WORD = rf"(?!{_TITLE}(?!\p{{L}}))\p{{Lu}}(?:\p{{L}}++(?:{_PART})*+|(?:{_PART})++)"
_NAME = rf"(?:{_WORD}|\p{{Lu}}(?:\.|(?![\p{{L}}\p{{N}}'’-])))"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![\p{L}0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![\p{L}0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![\p{L}0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
             r"|(?<![\p{L}0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    # a name word takes the space before the next one along, so that the next one starts where it ends
    "name": rf"(?=\p{{Lu}})(?:(?<=(?<!\p{{L}}){_TITLE} )|\G(?<= )){_NAME}(?: (?={_NAME}))?",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Where a text has names: also every capitalised word, which may be a name found elsewhere in the text.
_ANY_OR_WORD = rf"{_ANY}|(?<![\p{{L}}'’-]){_WORD}"
NAMES = ("given_f", "given_m", "given_n", "initial", "surname")
#: Draws after which surrogates grow by a letter or digit, so that a crowded format cannot run out.
CROWDED = 4


def _kind(raw: Column, before: Column, last: Column, title: Column) -> Column:
    """`before` is the text since the match `last`; `title` the text that ends with the title of a row of names."""
    digits = F.length(F.regexp_replace(raw, "[^0-9]", ""))

    def of(*sexes):
        return F.regexp_like(title, F.lit(r"(?<!\p{L})(?:" + "|".join(t for s in sexes for t in TITLES[s]) + r")\.? $"))

    named = F.when(before == "", F.endswith(last, F.lit(" "))).otherwise(of(*TITLES))
    name = (
        F.when(~F.coalesce(named, F.lit(False)), "bare").when(F.regexp_like(raw, F.lit(r"^\p{Lu}\.? ?$")), "initial")
        .when(~F.endswith(raw, F.lit(" ")), "surname").when(of("f"), "given_f").when(of("m"), "given_m").otherwise("given_n")
    )
    return (
        F.when(F.instr(raw, "@") > 0, "email")
        .when(F.regexp_like(raw, F.lit(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")), "ip")
        .when(digits == 0, name)
        .when(F.regexp_like(raw, F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), "ssn")
        .when((digits == 16) & ~F.startswith(raw, F.lit("+")), "card").otherwise("phone")
    )


def _plain(kind: Column, raw: Column) -> Column:
    """The form that spellings of one entity share."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    # a country code of 1 before ten digits does not change a number
    number = F.when((F.length(digits) == 11) & F.startswith(digits, F.lit("1")), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(kind == "phone", number).when(kind.isin("card", "ssn"), digits).otherwise(F.lower(F.rtrim(raw)))


def detect(text: Column) -> Column:
    """Entities of a text in order: array of struct(start, end, kind, plain, raw), code points from 0.

    In a text with names, the other capitalised words follow as kind "bare".
    """
    pattern = F.when(F.regexp_like(text, F.lit(PATTERNS["name"])), _ANY_OR_WORD).otherwise(_ANY)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))

    def build(pair):
        def item(raw, i):
            before, from_ = F.get(pair["gaps"], i), F.greatest(i - 15, F.lit(0))
            # in a row of names (for the gender, of up to 16) the last text between matches ends with the title
            title = F.when(before != "", before).otherwise(F.get(F.reverse(F.filter(F.slice(pair["gaps"], from_ + 1, i - from_ + 1), lambda g: g != "")), F.lit(0)))
            kind = _kind(raw, before, F.get(pair["found"], i - 1), F.coalesce(title, F.lit("")))
            return F.struct(F.length(before).alias("gap"), F.length(raw).alias("width"), kind.alias("kind"), _plain(kind, raw).alias("plain"), raw.alias("raw"))
        return F.transform(pair["found"], item)

    items = let(F.struct(gaps.alias("gaps"), found.alias("found")), build)
    return F.when(F.regexp_like(text, F.lit(_ANY)), items)


def _letter(alphabet: str, value: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(value, F.lit(len(alphabet))) + 1, F.lit(1))


def _value(digest: Column, i: Column) -> Column:
    """The i-th number from 0 to 255 of a hex digest, over and over."""
    return F.conv(F.substring(digest, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _like(pattern: Column, digest: Column) -> Column:
    """Characters of the same classes: digits for digits, letters of the same script for letters, the rest as it is."""
    def swap(c, i):
        v = _value(digest, i)
        return (
            F.when(F.regexp_like(c, F.lit("[0-9]")), F.pmod(v, F.lit(10)).cast("string"))
            .when(F.regexp_like(c, F.lit(r"\p{IsCyrillic}")), _letter(CYRILLIC, v))
            .when(F.regexp_like(c, F.lit(r"\p{IsGreek}")), _letter(GREEK, v))
            .when(F.regexp_like(c, F.lit(r"\p{L}")), _letter(LATIN, v)).otherwise(c)
        )
    return F.array_join(F.transform(F.split(pattern, ""), swap), "")


def _name(plain: Column, kind: Column, digest: Column) -> Column:
    """A pronounceable name of the script, as long as the digest asks; given names end as the gender's do."""
    def of(script):
        def syllable(i):
            return F.concat(_letter(CONSONANTS[script], _value(digest, F.lit(2 * i))), _letter(VOWELS[script], _value(digest, F.lit(2 * i + 1))))
        a, last = {"latin": "a", "cyrillic": "а", "greek": "α"}[script], {"latin": "n", "cyrillic": "н", "greek": "ς"}[script]
        stem = F.concat(syllable(0), syllable(1), F.when(_value(digest, F.lit(20)) % 2 == 0, syllable(2)).otherwise(""), _letter(CONSONANTS[script], _value(digest, F.lit(9))))
        ending = F.when(kind == "given_f", a).when(kind == "given_m", F.concat(_letter(VOWELS[script], _value(digest, F.lit(11))), F.lit(last))).otherwise(_letter(VOWELS[script], _value(digest, F.lit(12))))
        return F.concat(stem, ending)
    return F.when(F.regexp_like(plain, F.lit(r"\p{IsCyrillic}")), of("cyrillic")).when(F.regexp_like(plain, F.lit(r"\p{IsGreek}")), of("greek")).otherwise(of("latin"))


def draw(kind: Column, plain: Column, attempt: Column, secret: str) -> Column:
    """The surrogate of a plain entity at a draw, in plain form."""
    def build(digest):
        grown = F.when(attempt >= CROWDED, _like(F.repeat(F.lit("x"), (attempt - (CROWDED - 1)).cast("int")), F.reverse(digest))).otherwise("")
        local = F.regexp_extract(plain, "^(.*)@", 1)
        home = F.concat(F.lit("@mail"), F.pmod(_value(digest, F.lit(60)), F.lit(10)).cast("string"), F.lit(".example."), F.get(F.array(F.lit("com"), F.lit("net"), F.lit("org")), F.pmod(_value(digest, F.lit(61)), F.lit(3))))
        octets = F.concat_ws(".", *[(F.pmod(_value(digest, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)])
        # the first digit tells a card's or an area's class and stays
        number = F.concat(F.substring(plain, 1, 1), _like(F.substring(plain, F.lit(2), F.length(plain)), digest))
        return (
            F.when(kind == "email", F.concat(_like(local, digest), grown, home)).when(kind == "ip", octets)
            .when(kind.isin("card", "phone"), number).when(kind == "ssn", _like(plain, digest))
            .otherwise(F.concat(_name(plain, kind, digest), grown))
        )
    return let(F.sha2(F.concat_ws("\u0001", F.lit(secret), kind, plain, attempt.cast("string")), 512), build)


def surrogates(entities: DataFrame, secret: str, most: int = 64) -> DataFrame:
    """(kind, plain, surrogate) for distinct entities (kind, plain): no two alike within a kind, none equal to an entity.

    Each round keeps the surrogates that are new and, of entities that drew the same one, gives it to the first
    by plain form; the others draw again. It fails, rather than repeat a surrogate, if `most` rounds are not enough,
    which needs a format with nearly as many entities as it has values.
    """
    real = stored(entities.select("kind", "plain").distinct())
    open_, taken = real, None
    for attempt in range(most):
        drawn = open_.select("kind", "plain", draw(F.col("kind"), F.col("plain"), F.lit(attempt), secret).alias("surrogate"))
        drawn = stored(drawn)
        used = real.select("kind", F.col("plain").alias("surrogate"))
        if taken is not None:
            used = used.union(taken.select("kind", "surrogate"))
        free = drawn.join(used, ["kind", "surrogate"], "left_anti")
        won = stored(free.groupBy("kind", "surrogate").agg(F.min("plain").alias("plain")).select("kind", "plain", "surrogate"))
        taken = won if taken is None else taken.union(won)
        open_ = stored(drawn.join(won, ["kind", "plain"], "left_anti").select("kind", "plain"))
        if not open_.limit(1).count():
            return taken
    raise ValueError(f"no distinct surrogates found in {most} draws")


def _dress(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the occurrence's format."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    code = F.when(F.length(digits) > F.length(surrogate), F.substring(digits, F.lit(1), F.length(digits) - F.length(surrogate))).otherwise("")

    def fill(numbers):  # numbers take the places of digits one by one
        chars = F.split(raw, "")
        return F.array_join(F.transform(chars, lambda c, i: F.when(
            F.regexp_like(c, F.lit("[0-9]")),
            F.substring(numbers, F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1)),
        ).otherwise(c)), "")

    space = F.when(F.endswith(raw, F.lit(" ")), " ").otherwise("")
    cased = F.when(kind == "initial", F.concat(F.upper(F.substring(surrogate, 1, 1)), F.when(F.instr(raw, ".") > 0, ".").otherwise(""))).when((F.upper(raw) == raw) & (F.lower(raw) != raw) & (F.length(F.rtrim(raw)) > 1), F.upper(surrogate)).when(
        kind == "email", surrogate
    ).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate))))
    return F.when(kind == "ip", surrogate).when(kind.isin("card", "phone", "ssn"), let(F.concat(code, surrogate), fill)).otherwise(F.concat(cased, space))


def replace(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text with surrogates, n_entities; one row per row of `docs`.

    Null text becomes empty. Null keys stay, repeated rows get the same result, other columns are ignored, an
    empty table gives an empty result. Occurrences move without their texts; the texts move once, to meet
    their replacements. A hot entity is counted once per task, and its occurrences meet their
    surrogate in a join that adaptive execution can split.
    """
    rows = docs.select(F.col(key).alias("_key"), whole(F.col(text)).alias("_text"))
    digest = F.xxhash64("_key", "_text")
    found = stored(rows.select(digest.alias("_row"), detect(F.col("_text")).alias("_found")).where("_found is not null").dropDuplicates(["_row"]))
    single = found.select("_row", F.posexplode("_found").alias("_at", "_e")).select("_row", "_at", "_e.*")
    # in one document a name is one entity, with a title or without
    is_name = F.col("kind").isin(*NAMES)
    known = single.where(is_name).groupBy("_row", "plain").agg(F.min("kind").alias("_known"))
    words = single.where(is_name | (F.col("kind") == "bare")).join(known, ["_row", "plain"], "left").withColumn("kind", F.coalesce("_known", "kind"))
    every = stored(single.where(~is_name & (F.col("kind") != "bare")).unionByName(words.drop("_known")))
    single, untouched = every.where("kind != 'bare'"), every.where("kind = 'bare'")
    chosen = stored(surrogates(single.select("kind", "plain"), secret))
    dressed = single.join(chosen, ["kind", "plain"]).select("_row", F.struct("_at", "gap", "width", _dress(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("new")).alias("_s"))
    kept = untouched.select("_row", F.struct("_at", "gap", "width", F.col("raw").alias("new")).alias("_s"), F.lit(0).alias("_n"))
    dressed = dressed.withColumn("_n", F.lit(1)).union(kept)
    swaps = dressed.groupBy("_row").agg(F.sort_array(F.collect_list("_s")).alias("_swaps"), F.sum("_n").alias("_n"))

    def rebuild(swaps):
        # running end of each gap and match; the text is cut between them
        ends = F.aggregate(
            swaps, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,len:int,new:string>>").alias("cuts")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + s["width"]).alias("at"),
                F.concat(acc["cuts"], F.array(F.struct(acc["at"].alias("from"), s["gap"].alias("len"), s["new"].alias("new")))).alias("cuts"),
            ),
        )
        return let(ends, lambda e: F.concat(
            F.array_join(F.transform(e["cuts"], lambda c: F.concat(F.substring(F.col("_text"), c["from"] + 1, c["len"]), c["new"])), ""),
            F.substring(F.col("_text"), e["at"] + 1, F.length("_text")),
        ))

    together = rows.withColumn("_row", digest).join(swaps.hint("shuffle_hash"), "_row", "left")
    return together.select(
        F.col("_key").alias(key), F.when(F.col("_swaps").isNotNull(), rebuild(F.col("_swaps"))).otherwise(F.col("_text")).alias(text),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_entities"),
    )
