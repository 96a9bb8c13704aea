"""Layers as plug-ins, and surrogates by locale."""

import re

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import spans as sp
from cloakwork.operators import detect, layers, surrogates
from cloakwork.plans.engine import PiiEngine
from cloakwork.sources.locales import LOCALES

EMAIL = next(p for p in detect.SEEDED if p.pii_type == "EMAIL")


def by_word(word, pii_type="PERSON", score=0.9):
    return lambda texts, languages: [[(m.start(), m.end(), pii_type, score) for m in re.finditer(word, t)] for t in texts]


def breaks_on(word):
    def find(texts, languages):
        if any(word in t for t in texts):
            raise RuntimeError(word)
        return [[(0, 1, "X", 1.0), (3, 2, "X", 1.0), (0, 9999, "X", 1.0)] for _ in texts]

    return find


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "it" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, language string")


def test_order_switches_and_availability(spark):
    docs = frame(spark, ["Anna Anna@x.com", None, "", "no"])
    registry = layers.Layers.of([layers.PatternLayer((EMAIL,)), layers.ArrowLayer(by_word("Anna"), "b", 20), layers.ArrowLayer(by_word("Anna", "CITY"), "a", 20), layers.ColumnLayer("absent", "column", 1), layers.FindingsLayer(None, "filter", 2), layers.ArrowLayer(by_word("no"), "unready", 3, ready=lambda: 1 / 0), layers.ArrowLayer(by_word("no"), "off", 4)], {"off": {"enabled": False}, "b": {}})
    assert [x.name for x in registry.ordered(docs)] == ["b", "a", "regex"]
    assert registry.by_name("off").name == "off" and registry.by_name("nothing") is None
    with pytest.raises(ValueError, match="'a'"):
        registry.register(layers.PatternLayer(name="a"))
    rows = registry.find(docs).orderBy("doc_id").collect()
    assert [(s.source, s.start, s.end) for s in rows[0].spans] == [("b", 0, 4), ("b", 5, 9), ("a", 0, 4), ("a", 5, 9), ("regex", 5, 15)]
    assert [r.spans for r in rows[1:]] == [[], [], []] and rows[0].asDict().keys() == {"doc_id", "text", "language", "spans"}
    assert layers.Layers().find(docs).where(F.size("spans") > 0).isEmpty()


def test_a_failing_layer_finds_nothing_where_it_fails(spark):
    docs = frame(spark, ["good one", "bad one", None, "good two", "x"]).coalesce(1)
    found = layers.Layers.of([layers.ArrowLayer(breaks_on("bad"), "picky", 1)]).find(docs).orderBy("doc_id").collect()
    assert [[(s.start, s.end, s.text) for s in r.spans] for r in found] == [[(0, 1, "g")], [], [], [(0, 1, "g")], [(0, 1, "x")]]
    short = layers.Layers.of([layers.ArrowLayer(lambda texts, languages: [], "short", 1)]).find(docs)
    assert short.where(F.size("spans") > 0).isEmpty()


def test_languages_and_guard(spark):
    seen = lambda texts, languages: [[(0, 1, lang.upper(), 1.0)] for lang in languages]
    found = layers.Layers.of([layers.ArrowLayer(seen, "tongue", 1, guard="a", language="de")]).find(frame(spark, ["a", "a", "b"])).orderBy("doc_id").collect()
    assert [[s.pii_type for s in r.spans] for r in found] == [["DE"], ["IT"], []]


def test_patterns_win_over_models_in_the_engine(spark):
    docs = frame(spark, ["Scrivi a mario@test.com ora"]).withColumns({"context_id": F.lit("c"), "context_type": F.lit("t")})
    registry = layers.Layers.of([layers.ArrowLayer(by_word("a mario@test.com ora", "ADDRESS", 0.99), "wide", 10), layers.PatternLayer((EMAIL,)), layers.ArrowLayer(by_word("Scrivi", "CITY"), "words", 40)])
    assert PiiEngine(spark, layers=registry).anonymise(docs).first().anonymized_text == "[CITY_1] a [EMAIL_1] ora"


def test_findings_and_columns_keep_other_columns(spark):
    docs = frame(spark, ["Anna e Luca", "niente"]).withColumn("spans", F.lit("mine")).withColumn("model", F.array(sp.span(F.lit(0), F.lit(2), F.lit("X"), F.lit("An"), F.lit(1.0), F.lit("model"))))
    rows = spark.createDataFrame([(0, 0, 4, "private_person", 0.9), (0, 7, 11, "private_person", 0.1)], "doc_id long, start int, end int, label string, score double")
    found = layers.Layers.of([layers.FindingsLayer(rows, "filter", 2), layers.ColumnLayer("model", "model", 1)]).find(docs, "found").orderBy("doc_id").collect()
    assert [[(s.source, s.start, s.end) for s in r.found] for r in found] == [[("model", 0, 2), ("filter", 0, 4)], [("model", 0, 2)]]
    assert {r.spans for r in found} == {"mine"}


LENGTHS = {"IT": 27, "GB": 22, "DE": 22, "FR": 27, "ES": 24, "PT": 25, "NL": 18, "PL": 28, "CZ": 24, "RO": 24, "HU": 28}


def remainder(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_values_by_locale(spark):
    names = [*LOCALES, "xx_XX"]
    rows = spark.createDataFrame([(f"value {i}", n) for n in names for i in range(12)], "v string, locale string")
    kinds = ("person", "city", "address", "phone", "iban", "email", "username", "company", "passport")
    made = rows.select("v", "locale", *[surrogates.generate(F.lit(k), F.col("v"), F.lit("ctx"), F.col("locale")).alias(k) for k in kinds])
    got = made.collect()
    assert sorted(map(str, got)) == sorted(map(str, made.collect()))
    for r in got:
        table = LOCALES.get(r.locale, LOCALES["en_US"])
        first, last = r.person.split(" ")
        assert first in table.first_names and last in table.last.split() and r.city in table.towns.split(",")
        assert r.city in r.address and any(s in r.address for s in table.streets.split(",")) and not re.search("[#?{}]", r.address + r.phone)
        assert any(re.fullmatch(re.escape(p).replace(r"\#", "[0-9]"), r.phone) for p in table.phones)
        assert r.iban[:2] == table.country and len(r.iban) == LENGTHS[table.country] and remainder(r.iban) == 1
        assert re.fullmatch(r"[a-z]\.[a-z]+\d\d", r.username) and r.email == f"{r.username}@example.com"
        assert r.passport[:2] == r.locale.split("_")[1]
    by = {}
    for r in got:
        by.setdefault(r.v, set()).add(r.person)
    assert all(len(people) > 6 for people in by.values())  # another locale gives another value
