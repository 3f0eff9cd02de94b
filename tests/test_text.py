import pytest
from pyspark.sql import functions as F

from groundwell.functions import keys, text


@pytest.mark.parametrize("value,expected", [
    ("Co-trimoxazole and B12, NAAT-based", ["co-trimoxazole", "and", "b12", "naat-based"]),
    ("a--b -c- d", ["a", "b", "c", "d"]),
    ("", []),
])
def test_tokens_keep_inner_hyphens(one, value, expected):
    assert one(text.tokens, value) == expected


@pytest.mark.parametrize("value,expected", [
    ("One. Two! three: Four (five)? (Six)", ["One.", "Two! three:", "Four (five)?", "(Six)"]),
    ("line one\n\nline two. Next", ["line one", "line two.", "Next"]),
    ("e.g. this stays", ["e.g. this stays"]),
    ("  \n ", []),
])
def test_sentences(one, value, expected):
    assert one(text.sentences, value) == expected


@pytest.mark.parametrize("value,expected", [
    ("10,000 cells", {"10000"}), ("1,00,000 people", {"100000"}), ("see 1,2 and 3", {"1", "2", "3"}),
    ("007 and 0", {"7", "0"}), ("2.50 is not 2.5", {"2.50", "2.5"}), ("none", set()), ("1,2345", {"1", "2345"}),
])
def test_numbers(one, value, expected):
    assert set(one(text.numbers, value)) == expected


def test_markers_and_list_numbers_are_not_numbers(one):
    out = one(text.strip_markers, "1. Give 5 mg [C1, C2]. 2. Then rest [C12].\n3) Stop [X4]")
    assert "C1" not in out and "C12" not in out and "[X4]" in out
    assert set(one(lambda c: text.numbers(text.strip_markers(c)), "1. Give 5 mg [C1]. 2. Then 7")) == {"5", "7"}


def test_white_space_is_unicode(one):
    assert one(text.strip, " 　 a b  \n") == "a b"
    assert one(text.squeeze, " a \n b\t") == "a b"


def test_recognised_text_is_cleaned(one):
    assert one(text.clean_recognised, "grade 三 ( severe ) ， 5 ％ 丁 “x”") == 'grade III (severe), 5% "x"'


def test_title_case_and_slug(one):
    assert one(text.title_case, "o'neil CO-OP 3rd") == "O'Neil Co-Op 3Rd"
    assert one(text.slug, "--The FILE__name (2)!") == "the-file-name-2"


def test_overlap_share_of_an_empty_set_is_zero(spark):
    row = spark.range(1).select(
        text.overlap_share(F.array().cast("array<string>"), F.array(F.lit("a"))).alias("e"),
        text.overlap_share(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("h"),
    ).first()
    assert row["e"] == 0.0 and row["h"] == 0.5


def test_keys(one):
    import hashlib

    assert one(lambda c: keys.cache_key(c, F.lit("3072")), "t") == hashlib.sha256(b"t|3072").hexdigest()[:32]
    assert one(lambda c: keys.embedding_key("m", 4, c), "t") == hashlib.sha256(b"m|4|t").hexdigest()
    assert one(keys.normalise_email, " A@B.Org\n") == "a@b.org"


@pytest.mark.parametrize("email,valid", [("a@b.org", True), ("a@b", False), ("a b@c.d", False), ("", False), ("@b.c", False), ("a@b..c", False)])
def test_address_shape(one, email, valid):
    assert one(keys.valid_email, email) is valid


def test_client_address(one):
    run = lambda h, r, p, **k: one(lambda a, b, c: keys.client_address(a, b, c, **k), h, r=r, p=p)
    assert run(" 1.1.1.1 , 2.2.2.2", None, "9") == "1.1.1.1"
    assert run("", "3.3.3.3", "9") == "3.3.3.3"
    assert run(None, None, None) == "unknown"
    assert run("1.1.1.1", None, "9", trust_proxy=False) == "9"


def test_iso_times(one):
    assert one(keys.epoch_millis, "2024-01-01T00:00:01.250+00:00") == 1704067201250
    assert one(keys.epoch_millis, "not a time") is None
    assert one(keys.epoch_millis, None) is None
