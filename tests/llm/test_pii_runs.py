"""Dates and cards in runs of digits: each is found, whatever stands beside it."""

import re

import pytest

from cloakwork.llm import pii

CARD = "4111 1111 1111 1111"


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10


@pytest.mark.parametrize("key", ["a", "b"])
def test_values_in_runs(spark, key):
    texts = {
        "2024-01-15 2024-01-16": ["2024-01-15", "2024-01-16"],
        "48213 2024-01-15": ["2024-01-15"],
        "4711 0815 1234 15.01.2024 end": ["15.01.2024"],
        f"{CARD} 12/25": [CARD],
        f"{CARD} 123": [CARD],
        f"{CARD} 2024-01-15": [CARD, "2024-01-15"],
        f"7 {CARD}": [CARD],
        f"48 21 11 {CARD} 123": [CARD],
        f"{CARD} 5500 0000 0000 0004": [CARD, "5500 0000 0000 0004"],
        f"{CARD} 123-45-6789": [CARD, "123-45-6789"],
        "1234567 123-45-6789": ["123-45-6789"],
        "1 2 " * 20_000 + "end": [],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, key).collect()}
    for i, (text, values) in enumerate(texts.items()):
        new = got[i].text
        assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", text)
        if not values:
            continue
        assert got[i].n_values == len(values) and not any(v in new for v in values), (text, new)
        for v in values:
            at = text.index(v)
            other = new[at : at + len(v)]
            if len(v) == len(CARD):
                assert luhn(re.sub(r"\D", "", other)) == 0
            if re.fullmatch(r"\d{4}-\d\d-\d\d", v):
                assert re.fullmatch(r"20\d\d-(0[1-9]|1[0-2])-([0-2]\d|3[01])", other)
