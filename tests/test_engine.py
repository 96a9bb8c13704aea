"""The flagship way of a document: detection by type, policies, round trips, determinism."""

import re

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import detect, policy, replace
from cloakwork.plans.engine import Config, PiiEngine

SCHEMA = "doc_id long, text string, context_id string, context_type string, language string, mode string, policy struct<protect:array<string>,keep:array<string>,surrogate:array<string>>"

CASES = [
    ("Il codice fiscale è RSSMRA80A01H501U", ["FISCAL_CODE"], "RSSMRA80A01H501U"),
    ("Bonifico su IT60X0542811101000001234567", ["IBAN"], "IT60X0542811101000001234567"),
    ("Scrivimi a mario.rossi@example.com", ["EMAIL"], "mario.rossi@example.com"),
    ("Chiamami al +39 333 1234567", ["PHONE"], "333 1234567"),
    ("Il veicolo è targato AB123CD", ["TARGA"], "AB123CD"),
    ("Il cielo è azzurro oggi.", [], None),
    ("CF RSSMRA80A01H501U, email mario@test.com, targa AB123CD", ["EMAIL", "FISCAL_CODE", "TARGA"], "mario@test.com"),
    ("Anna, nata a San Giovanni il 01/03/1980, partita IVA: 12345678901", ["CITY_BORN", "DATE_BORN", "PIVA"], "01/03/1980"),
    ("RAL di 35.000 euro; username: mrossi", ["SALARY", "USERNAME"], "mrossi"),
    ("chiave sk-abcdefghijklmnopqrstuvwx e login: 'x' non basta", ["API_KEY", "USERNAME"], "sk-abcdefghijklmnopqrstuvwx"),
    ('token = "0123456789abcdef0123456789abcdef01234567"', ["SECRET"], "0123456789abcdef"),
    (None, [], None),
    ("", [], None),
]


def frame(spark, texts, **fields):
    rows = [(i, t, fields.get("context_id", f"c{i}"), fields.get("context_type", "case_file"), fields.get("language"), fields.get("mode"), fields.get("policy")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_types_and_masking(spark):
    got = PiiEngine(spark).anonymise(frame(spark, [c[0] for c in CASES])).orderBy("doc_id").collect()
    for (text, types, secret), row in zip(CASES, got, strict=True):
        assert row.pii_types_found == types, text
        assert row.entity_count == len(row.entities)
        assert row.mode == "tag"
        if secret:
            assert secret not in row.anonymized_text and all(f"[{t}_" in row.anonymized_text for t in types)
        else:
            assert row.anonymized_text == text
        for e in row.entities:
            assert text[e.start : e.end] == e.original
        starts = [(e.start, e.end) for e in row.entities]
        assert starts == sorted(starts, reverse=True) and all(a[0] >= b[1] for a, b in zip(starts, starts[1:]))


def test_tokens_are_shared_by_equal_values(spark):
    text = "a@b.com scrive a c@d.org e poi di nuovo a A@B.com, fine"
    row = PiiEngine(spark).anonymise(frame(spark, [text])).first()
    # A gap of up to five characters joins neighbours of one type.
    assert row.anonymized_text == "[EMAIL_1] scrive a [EMAIL_2] e poi di nuovo a [EMAIL_1], fine"
    stored = replace.mapping_rows(PiiEngine(spark).anonymise(frame(spark, [text]))).collect()
    assert {(r.token, r.original) for r in stored} == {("[EMAIL_1]", "A@B.com"), ("[EMAIL_2]", "c@d.org")}
    joined = PiiEngine(spark).anonymise(frame(spark, ["a@b.co e c@d.org"])).first()
    assert joined.anonymized_text == "[EMAIL_1]"


def test_round_trip_and_isolation(spark):
    texts = [c[0] for c in CASES if c[0]]
    found = PiiEngine(spark).anonymise(frame(spark, texts)).persist()
    stored = replace.mapping_rows(found)
    asked = found.select("doc_id", "context_id", "context_type", F.col("anonymized_text").alias("text"))
    back = {r.doc_id: r.restored_text for r in replace.deanonymise(asked, stored).collect()}
    assert back == dict(enumerate(texts))
    other = replace.deanonymise(asked.withColumn("context_id", F.lit("elsewhere")), stored).collect()
    assert all(r.restored_text == r.text for r in other)
    found.unpersist()


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_same_result_for_any_partitioning(spark, sf, partitions):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("source").alias("context_id"), F.lit("hr").alias("context_type"))
    tags = PiiEngine(spark).anonymise(docs.repartition(partitions).withColumn("mode", F.when(F.col("doc_id") % 2 == 0, "surrogate")))
    rows = sorted((r.doc_id, r.anonymized_text, r.mode) for r in tags.collect())
    known = test_same_result_for_any_partitioning.__dict__.setdefault("rows", rows)
    assert rows == known and len(rows) == docs.count()


def test_policies(spark):
    text = "mario@test.com, targa AB123CD"
    engine = PiiEngine(spark)
    fine = engine.anonymise(frame(spark, [text], context_type="fine_appeal")).first()
    assert fine.anonymized_text == "[EMAIL_1], targa AB123CD"
    inline = engine.anonymise(frame(spark, [text], context_type="fine_appeal", policy=(["TARGA"], None, None))).first()
    assert inline.anonymized_text == text  # protect is replaced, keep stays the domain's and wins
    inline = engine.anonymise(frame(spark, [text], context_type="fine_appeal", policy=(["TARGA"], [], None))).first()
    assert inline.anonymized_text == "mario@test.com, targa [TARGA_1]"
    both = engine.anonymise(frame(spark, [text], policy=([], [], ["EMAIL"]))).first()
    assert both.anonymized_text == "[EMAIL_1], targa AB123CD"
    faked = engine.anonymise(frame(spark, [text], policy=([], [], ["EMAIL"])), per_type_surrogate=True).first()
    assert re.match(r"\S+@test\.com, targa AB123CD$", faked.anonymized_text) and "mario@" not in faked.anonymized_text


def test_resolution_of_policies(spark):
    contexts, policies = policy.context_types(spark), policy.domain_policies(spark)
    docs = spark.createDataFrame([("default", None), ("unknown", ""), ("embedding", None), ("medical", "surrogate"), (None, "odd")], "context_type string, mode string")
    got = {r.context_type: r for r in policy.resolve(docs, contexts, policies).collect()}
    assert got["unknown"].protect is None and got["unknown"].keep == [] and got["unknown"].mode == "tag"
    assert got["embedding"].mode == "surrogate" and "EMAIL" in got["embedding"].protect
    assert got["medical"].mode == "surrogate" and got[None].mode == "odd" and got["default"].mode == "tag"
    as_json = policies.select("domain", *[F.to_json(f"{n}_types").alias(f"{n}_types") for n in ("protect", "keep", "surrogate")], "enabled")
    assert {r.context_type: r.protect for r in policy.resolve(docs, contexts, as_json).collect()} == {k: r.protect for k, r in got.items()}
    disabled = policies.withColumn("enabled", F.col("domain") != "medical")
    assert {r.context_type: r.protect for r in policy.resolve(docs, contexts, disabled).collect()}["medical"] is None


def test_surrogate_mode(spark):
    texts = ["Scrivi a mario@test.com oppure a MARIO@test.com; targa AB123CD", "CF RSSMRA80A41H501U"]
    found = PiiEngine(spark).anonymise(frame(spark, texts, context_id="x", mode="surrogate")).orderBy("doc_id").collect()
    fakes = re.fullmatch(r"Scrivi a (\S+@test\.com) oppure a (\S+@test\.com); targa ([A-Z]{2}\d{3}[A-Z]{2})", found[0].anonymized_text)
    assert fakes and fakes[1] == fakes[2] != "mario@test.com" and fakes[3] != "AB123CD"
    assert re.fullmatch(r"CF [A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]", found[1].anonymized_text) and "RSSMRA" not in found[1].anonymized_text
    assert int(found[1].anonymized_text[12:14]) > 40  # a woman's code stays one


def test_configuration_tables(spark):
    patterns = spark.createDataFrame([("1", "X", r"x+(y)z", "", 1, True), ("2", "BAD", "(", "", 0, True), ("3", "OFF", "off", "", 0, False), ("4", "NOGROUP", "q", "", 2, True), ("5", "CASE", "abc", "IGNORECASE", 0, True), ("6", "BAR", "d.e", "IGNORECASE|DOTALL", 0, True)], "id string, pii_type string, pattern string, flags string, capture_group int, enabled boolean")
    rules = spark.createDataFrame([("1", "CASE", None, None, "^abc$", 60, 1, True)], "id string, from_type string, to_type string, context_pattern string, entity_pattern string, context_window int, created_at int, enabled boolean")
    denied = spark.createDataFrame([("X", "y", "exact_word", True), ("X", "nothing", "contains", False)], "pii_type string, value string, match_type string, enabled boolean")
    config = Config.read(patterns, rules, denied)
    assert [p.pii_type for p in config.patterns if p.compiled] == ["BAR", "CASE", "X"]
    rows = PiiEngine(spark, config).detect(frame(spark, ["xxyz ABC and then abc off q d\ne"])).select("spans").first().spans
    # Flags that are joined by a bar are none; the rule discards the lone "abc", the denylist the "y".
    assert [(s.pii_type, s.text) for s in rows] == [("CASE", "ABC")]


def test_groups_inside_a_match_go_to_arrow(spark):
    token = detect.USER[-1]
    assert not token.group_ends_match and all(p.group_ends_match for p in detect.SEEDED)
    docs = frame(spark, ['a token = "0123456789abcdef0123456789abcdef01234567" b', None, "none"])
    spans = docs.select("doc_id", detect.regex_spans(F.col("text"), (token,)).alias("s")).orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in spans[0].s] == [(11, 51)] and spans[1].s == [] and spans[2].s == []


def test_every_seeded_pattern_equals_pythons_re(spark):
    text = (
        "Io @mario_rossi e @ab, sk-abcdefghijklmnopqrstuvwx UNCRITMM UNCRITM1XXX nata a Reggio Emilia e nato a Città Alta; Rossi & Figli S.r.l. e ACME di Bari SpA, "
        "CVV: 123 cvc 4567 il 1/2/2020, 12-12-1999. 3 marzo 2021, a.b+c@d-e.co.uk RSSMRA80A01H501U 45.1234, 9.56789 IT60X0542811101000001234567 carta d'identità: AB1234567 "
        "IMEI 123456789012345 carta fedeltà n AZ123456 aa:bb:cc:dd:ee:ff YA1234567 (06 12345678) +39 333-1234567 pin 1234 p. iva 12345678901 PNR ABC123 "
        "polizza numero AB-12345 pratica sanitaria n. 123456 sinistro x codice AB1234 ral lorda 35.000,50 targa AB 123 CD login: mario 123e4567-e89b-12d3-a456-426614174000 é@àbcd"
    )
    rows = frame(spark, [text]).select(*[detect.regex_spans(F.col("text"), (p,)).alias(f"p{i}") for i, p in enumerate(detect.SEEDED)]).first()
    for i, p in enumerate(detect.SEEDED):
        want = [(m.start(p.group), m.end(p.group), m.group(p.group)) for m in p.compiled.finditer(text) if m.group(p.group)]
        assert [(s.start, s.end, s.text) for s in rows[i]] == want, p
