"""Persons of one document: short forms, other titles and repeats without a title."""

import itertools

import pytest
import regex

from narrata.llm import pii

TEXT = "Dr John Smith came. Mr Smith sat, and Mr John Smith's dog too. Then John Smith and SMITH left; Smith's hat stayed. Mrs Smith and Ms Eva Stone-Hill met Stone-Hill. Smithson, Smith-Jones and stone stay."


def test_mentions_of_a_person_share_a_surrogate(spark):
    rows = spark.createDataFrame([(1, TEXT), (2, "no one, Smith")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.surrogates(rows, "key", count_col="n").collect()}
    text = got[1].text
    m = regex.fullmatch(r"Dr (\w+) (\w+) came\. Mr (\w+) sat, and Mr (\w+ \w+)'s dog too\. Then (\w+ \w+) and (\w+) left; (\w+)'s hat stayed\. Mrs (\w+) and Ms (\w+) (\w+) met (\w+)\. Smithson, Smith-Jones and stone stay\.", text)
    assert m, text
    first, last = m[1], m[2]
    assert first in pii.NAMES["m"].split() and m[3] == last == m[7] and m[4] == m[5] == f"{first} {last}" and m[6] == last.upper()
    assert m[8] != last and m[9] in pii.NAMES["f"].split() and m[10] == m[11] and got[1].n == 9
    assert got[2].text == "no one, Smith"


@pytest.mark.parametrize("kind", ["ip", "person", "email"])
def test_more_entities_than_a_form_has(spark, kind):
    digits = "0123456789"
    entities = {
        "ip": [".".join(x) for x in itertools.product(digits, digits, digits, digits[:8])],  # 8,000 of 10,000
        "person": [f"m:имя{''.join(chr(ord('а') + int(c)) for c in str(i))}" for i in range(30000)],  # three of 30 syllables make 27,000
        "email": [f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"],  # all 676
    }[kind]
    drawn = pii.draw_surrogates(spark.createDataFrame([(kind, e) for e in entities], "kind string, entity string"), "k").collect()
    new = {d.surrogate.lower() for d in drawn}
    assert len(drawn) == len(new) == len(entities) and not new & {e.removeprefix("m:") for e in entities}
    if kind == "ip":
        assert all(0 <= int(o) <= 255 for n in new for o in n.split("."))
