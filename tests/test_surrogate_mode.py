"""Surrogate mode gives no protected value back in clear, whatever ids and contexts a request has; and its values can be restored."""

import random

from pyspark.sql import functions as F

from cloakwork.operators import replace
from cloakwork.plans.engine import PiiEngine

KIND = "doc_id long, text string, context_id string, context_type string, language string, mode string"


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def test_null_and_repeated_ids_and_contexts(spark):
    text = "Scrivi a mario@test.com, targa AB123CD, CF RSSMRA80A01H501U"
    rows = [(1, text, None, "case_file", "it", "surrogate"), (None, text, "c", "case_file", "it", "surrogate"), (7, text, "a", "case_file", "it", "surrogate"), (7, text, "b", "case_file", None, "surrogate")]
    rows += [(None, text, None, None, None, "surrogate"), (None, None, None, None, None, "surrogate"), (8, text, "a", "case_file", "it", None), (7, text, "a", "case_file", "it", "surrogate")]
    found = PiiEngine(spark).anonymise(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.text is None:
            assert r.anonymized_text is None and r.entity_count == 0
            continue
        assert not any(v in r.anonymized_text for v in ("mario@", "AB123CD", "RSSMRA80A01H501U"))
        assert ("[EMAIL_1]" in r.anonymized_text) == (r.mode == "tag")
        assert sum(len(e.original) for e in r.entities) == len("mario@test.comAB123CDRSSMRA80A01H501U")
    by = {}
    for r in found:
        if r.mode == "surrogate" and r.text:
            by.setdefault(r.context_id, set()).add(r.anonymized_text)
    # One value within a context, whatever the language of the row.
    assert len(by["a"]) == len(by["c"]) == len(by[None]) == 1 and by["a"] != by["b"]


def test_no_protected_span_is_left(spark):
    rng = random.Random(2)
    parts = ["mario@test.com", "MARIO@test.com", "AB123CD", "RSSMRA80A01H501U", "IT60X0542811101000001234567", "il 3 marzo 1980", "il 01/03/1980", "+39 333 1234567", "RAL di 35.000 euro", "login: mrossi", "192.168.0.1", "ciao", "\n", "nata a Roma il 01/03/1980"]
    rows = [(rng.choice([None, 1, 2]), " ; ".join(rng.choices(parts, k=rng.randint(0, 9))), rng.choice([None, "", "a", "b"]), rng.choice([None, "case_file", "embedding"]), rng.choice([None, "it", "de", "xx"]), rng.choice([None, "surrogate"])) for _ in range(80)]
    found = PiiEngine(spark).anonymise(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.entity_count == len(r.entities)
        pieces, end = [], len(r.text)
        for e in r.entities:  # the last in the text first
            assert e.token.lower() != e.original.lower() and r.text[e.start : e.end] == e.original
            pieces[:0] = [e.token, r.text[e.end : end]]
            end = e.start
        assert r.anonymized_text == "".join([r.text[:end], *pieces])


def test_surrogates_are_restored_by_their_words(spark):
    engine = PiiEngine(spark)
    texts = ["Scrivi a mario@test.com e a anna@test.com; targa AB123CD.", "CF RSSMRA80A41H501U, IBAN IT60X0542811101000001234567, IP 10.1.2.3", "niente"]
    rows = [(i, t, "c" if i < 2 else "d", "case_file", "it", "surrogate") for i, t in enumerate(texts)]
    found = engine.anonymise(frame(spark, rows)).persist()
    assert all(r.anonymized_text != r.text for r in found.collect() if r.doc_id < 2)
    asked = found.select("doc_id", "context_id", "context_type", F.col("anonymized_text").alias("text"))
    back = {r.doc_id: r.restored_text for r in replace.deanonymise(asked, replace.mapping_rows(found)).collect()}
    assert back == dict(enumerate(texts))
    found.unpersist()


def test_restoring_takes_whole_words_longest_first(spark):
    stored = [("Rossi", "A$1"), ("Anna Rossi", r"B\E"), ("Rossini", "C"), ("+39 34", "D"), ("é", "E"), ("[x] (y)", "F"), (r"q\Eq", "G"), ("[T_1]", "Rossi")]
    rows = [("c", "t", token, original, "X") for token, original in stored] + [("c", "other", "ciao", "no", "X"), ("c", "t", "Rossi", "zz", "X")]
    mappings = spark.createDataFrame(rows, "context_id string, context_type string, token string, original string, pii_type string")
    text = r"Rossi, Anna Rossi; Rossini Rossinis xRossi +39 345 +39 34 né [x] (y) q\Eq ciao"
    asked = spark.createDataFrame([("c", "t", text), ("d", "t", text), (None, "t", text), ("c", "t", None), ("c", "t", "")], "context_id string, context_type string, text string")
    got = [r.restored_text for r in replace.deanonymise(asked, mappings).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [r"A$1, B\E; C Rossinis xRossi +39 345 D nE F G ciao", text, text, None, ""]))


def test_no_text_meets_all_values_of_its_context(spark):
    n = 3000
    mappings = spark.range(n).selectExpr("'c' context_id", "'t' context_type", "concat('user', id, '@example.com') token", "concat('real', id, '@x.org') original", "'EMAIL' pii_type")
    texts = spark.range(200).selectExpr("id", "'c' context_id", "'t' context_type", "concat('mail user', id * 7, '@example.com or user', id, '@example.com now') text")
    found = replace.deanonymise(texts, mappings)
    assert {r.id: r.restored_text for r in found.collect()} == {i: f"mail real{i * 7}@x.org or real{i}@x.org now" for i in range(200)}
    anchors = replace.anchored(mappings).select("anchor").collect()
    assert len({r.anchor for r in anchors}) == n  # the rarest word, not "example"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("anchor" in line or "word" in line for line in joins)  # none by context alone
