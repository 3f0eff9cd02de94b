"""Question rewriting: white space and additive abbreviation expansion, inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import QUERY_WORD, squeeze

# The glossary, and the abbreviations left alone because they have several readings.
GLOSSARY = {
    "tb": "tuberculosis",
    "mdr-tb": "multidrug resistant tuberculosis",
    "xdr-tb": "extensively drug resistant tuberculosis",
    "dots": "directly observed treatment short course",
    "naat": "nucleic acid amplification test",
    "cbnaat": "cartridge based nucleic acid amplification test",
    "ors": "oral rehydration solution",
    "anc": "antenatal care",
    "pnc": "postnatal care",
    "pph": "postpartum haemorrhage",
    "gdm": "gestational diabetes mellitus",
    "ncd": "non communicable disease",
    "copd": "chronic obstructive pulmonary disease",
    "ckd": "chronic kidney disease",
    "aki": "acute kidney injury",
    "uti": "urinary tract infection",
    "urti": "upper respiratory tract infection",
    "lrti": "lower respiratory tract infection",
    "ari": "acute respiratory infection",
    "art": "antiretroviral therapy",
    "hiv": "human immunodeficiency virus",
    "sti": "sexually transmitted infection",
    "rti": "reproductive tract infection",
    "sam": "severe acute malnutrition",
    "mam": "moderate acute malnutrition",
    "ifa": "iron and folic acid",
    "bcg": "bacillus calmette guerin",
    "opv": "oral polio vaccine",
    "aes": "acute encephalitis syndrome",
    "je": "japanese encephalitis",
    "imnci": "integrated management of neonatal and childhood illness",
    "phc": "primary health centre",
    "chc": "community health centre",
    "asha": "accredited social health activist",
    "anm": "auxiliary nurse midwife",
    "t2dm": "type 2 diabetes mellitus",
    "htn": "hypertension",
}
AMBIGUOUS = ("mi", "ms", "as", "ra", "cp", "pid", "dm", "bp", "hb", "ca")


def expansions(query: Column, glossary: dict[str, str] = GLOSSARY) -> Column:
    """Applied expansions in token order: array of (token, expansion)."""
    table = F.create_map(*[F.lit(x) for pair in glossary.items() for x in pair])
    found = F.regexp_extract_all(query, F.lit(f"({QUERY_WORD})"), F.lit(1))

    def pick(tokens):
        lowered = F.transform(tokens, lambda t: F.lower(t))
        first_seen = let(
            lowered,
            lambda low: F.filter(
                tokens, lambda t, i: F.array_position(low, F.lower(t)) == i + 1
            ),
        )
        paired = F.transform(
            first_seen,
            lambda t: F.struct(t.alias("token"), F.try_element_at(table, F.lower(t)).alias("expansion")),
        )
        return F.filter(
            paired,
            lambda p: p["expansion"].isNotNull()
            & ~F.lower(p["token"]).isin(*AMBIGUOUS)
            & ~F.contains(F.lower(query), F.lower(p["expansion"])),
        )

    return let(found, pick)


def rewrite(query: Column) -> Column:
    """struct(rewritten, applied): the tidied question with expansions appended, and what was added."""
    def build(tidy):
        return let(
            expansions(tidy),
            lambda es: F.struct(
                F.concat_ws(" ", tidy, F.nullif(F.array_join(F.transform(es, lambda e: e["expansion"]), " "), F.lit("")))
                .alias("rewritten"),
                F.transform(es, lambda e: F.concat(e["token"], F.lit(" -> "), e["expansion"])).alias("applied"),
            ),
        )

    return let(squeeze(query), build)
