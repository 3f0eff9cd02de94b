"""Names of any length, initials, neutral titles and later mentions."""

import re

from groundwell.llm import surrogate_pii


def test_a_person_is_replaced_throughout_a_document(spark):
    texts = [
        "Mr John Paul Smith came.", "Mr. J. Smith came.", "Mrs Anna Berg came. Berg said Anna left, and Berg's hat stayed in Paris.",
        "Dr. Anna Berg and Prof. Dr. O'Neil met Herr Dr. Lang.", "Berg and Anna stay.", "Dr A B. Ostrander Miles, Mr BERG; BERG x@Berg.com Berg",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_entities) for r in surrogate_pii.replace(df, "k").collect()}
    w = r"([A-Z][a-z]+)"
    assert re.fullmatch(rf"Mr {w} {w} {w} came\.", got[0][0]) and got[0][1] == 3
    assert not re.search("John|Paul|Smith", got[0][0])
    second = re.fullmatch(rf"Mr\. [A-Z]\. {w} came\.", got[1][0])
    assert second and second[1] == re.search(r"(\w+) came", got[0][0])[1] and got[1][1] == 2
    third = re.fullmatch(rf"Mrs {w} {w} came\. {w} said {w} left, and {w}'s hat stayed in Paris\.", got[2][0])
    assert third and third[1] == third[4] and third[2] == third[3] == third[5] and third[1].endswith("a") and got[2][1] == 5
    assert "Anna" not in got[2][0] and "Berg" not in got[2][0]
    assert re.fullmatch(rf"Dr\. {w} {w} and Prof\. Dr\. {w} met Herr Dr\. {w}\.", got[3][0]) and not re.search("Anna|Berg|Neil|Lang", got[3][0])
    assert got[4] == (texts[4], 0)
    assert not re.search("Ostrander|Miles|BERG|Berg", got[5][0])
