"""Tables, reports, encryption, streams, and values of the text functions."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import text as tx
from cloakwork.operators import policy, replace, reporting, surrogates
from cloakwork.plans import oracles, queries
from cloakwork.plans.engine import PiiEngine
from cloakwork.sources import store
from cloakwork.streaming.stream import anonymise_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes_of_tables(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", "y"), (3, "d", None), (3, "e", None)], "k int, v string, w string")
    assert rows(store.insert_if_absent(old, new, ["k"], [F.col("v")])) == [(1, "a", None), (2, "b", "x"), (3, "d", None)]
    assert rows(store.upsert(old, new, ["k"], [F.col("v")])) == [(1, "a", None), (2, "c", "y"), (3, "e", None)]
    changes = spark.createDataFrame([(1, None, "z"), (9, "q", None)], "k int, v string, w string")
    assert rows(store.partial_update(old, changes, ["k"])) == [(1, "a", "z"), (2, "b", "x")]
    assert rows(store.delete_keys(old, new.select("k"))) == [(1, "a", None)]
    assert store.deleted_count(old, new.select("k").distinct()).first().deleted == 1
    with pytest.raises(ValueError):
        store.insert_or_conflict(old, new, ["k"])
    assert store.insert_or_conflict(old, new.where("k = 3"), ["k"]).count() == 4
    for f in (store.insert_if_absent, store.upsert):
        assert rows(f(old.limit(0), new.limit(0), ["k"], [F.col("v")])) == []
    settings = spark.createDataFrame([("default_language", "it")], "key string, value string")
    assert settings.agg(store.setting(settings, "default_language", "en").alias("a"), store.setting(settings, "other", "en").alias("b")).first() == ("it", "en")


def test_retention_and_encryption(spark, tmp_path):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    table = spark.createDataFrame([(1, datetime.datetime(2024, 2, 20)), (2, datetime.datetime(2024, 2, 19, 23, 59))], "id int, created_at timestamp_ntz")
    assert [r.id for r in store.keep_recent(table, now, 10).collect()] == [1]
    plain = spark.createDataFrame([(1, "segreto è"), (2, "")], "id int, original string")
    hidden = store.with_encrypted(plain, F.lit("0123456789abcdef"))
    path = str(tmp_path / "m")
    store.append(hidden, path)
    assert "segreto" not in str(spark.read.parquet(path).collect())
    assert rows(store.readable(spark.read.parquet(path), F.lit("0123456789abcdef"))) == rows(plain)
    assert store.readable(spark.read.parquet(path), F.lit("another key 1234")).count() == 0
    store.rewrite(spark.read.parquet(path).where("id = 1"), path)
    assert [r.id for r in spark.read.parquet(path).collect()] == [1]
    keys = spark.createDataFrame([("k1", "admin", True), ("k2", "admin", False), ("k3", "service", True)], "name string, role string, active boolean").withColumn("key_hash", store.key_hash(F.col("name")))
    asked = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("zz",)], "api_key string")
    assert [r.api_key for r in store.authorised(asked, keys, ["admin"]).collect()] == ["k1"]


def test_pages_and_accuracy(spark):
    table = spark.range(250).select("id", F.lit(datetime.datetime(2024, 1, 1)).alias("created_at"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("action"))
    assert [r.id for r in reporting.audit_page(table, "a", 2, 10).collect()] == list(range(20, 40, 2))
    for bad in ((0, 10), (1, 0), (1, 201)):
        with pytest.raises(ValueError):
            reporting.page(table, *bad)
    empty = spark.createDataFrame([], "doc_id long, start int, end int, pii_type string")
    one = spark.createDataFrame([(1, 0, 5, "X"), (1, 7, 9, "X")], "doc_id long, start int, end int, pii_type string")
    half = reporting.accuracy(one, one.where("start = 0")).first()
    assert (half.tp, half.fp, half.fn, half.precision, half.recall) == (1, 1, 0, 0.5, 1.0)
    assert reporting.accuracy(empty, empty).count() == 0 and reporting.accuracy(empty, one).first().recall == 0.0
    none = reporting.summary(table.limit(0), table.limit(0).select(F.col("action").alias("pii_type")), F.lit("2024-01-01").cast("timestamp_ntz")).first()
    assert (none.total_requests, none.total_mappings, none.requests_last_24h, none.pii_breakdown) == (0, 0, 0, {})


def test_tax_codes(spark):
    people = spark.createDataFrame([("Rossi", "Mario", "1980-01-01", "M", "Roma"), ("Rossi", "Maria", "1985-06-15", "F", "Milano"), ("Verdi", "Francesco", "1990-12-31", "m", "Atlantide"), ("Fo", "Al", "2001-02-03", "M", "Bari")], "l string, f string, b string, g string, c string")
    codes = [r.cf for r in people.select(tx.tax_code(F.col("l"), F.col("f"), F.col("b").cast("date"), F.col("g"), F.col("c")).alias("cf")).collect()]
    assert codes[0] == "RSSMRA80A01H501I" and codes[1].startswith("RSSMRA85H55F205") and codes[2][3:6] == "FNC" and codes[2][11:15] == "H501" and codes[3].startswith("FOXLAX01B03A662")
    odd = spark.createDataFrame([(" rssmra80a41h501u ",), ("short",), ("RSSMRA80ZXXH501U",), (None,)], "c string").select(tx.decoded_tax_code(F.col("c")).alias("d")).collect()
    assert tuple(odd[0].d) == ("80", 1, 1, "F", "H501") and [r.d for r in odd[1:]] == [None] * 3


STRATEGIES = {
    "email": ("user@example.com", r"\S+@example\.com"), "phone": ("+39 333 1", r"\+?[\d ]+"), "targa": ("AB123CD", r"[A-Z]{2}\d{3}[A-Z]{2}"), "pnr": ("ABC123", r"[A-Z0-9]{6}"),
    "imei": ("123456789012345", r"\d{15}"), "bic": ("UNCRITMM", r"[A-Z]{6}[A-Z0-9]{5}"), "passport": ("YA1", r"IT\d{7}"), "identity_card": ("CA1", r"[A-Z]{2}\d{7}[A-Z]"),
    "driver_license": ("x", r"[A-Z0-9]{10}"), "health_card": ("x", r"[A-Z]{2}\d{13}"), "salary": ("35.000", r"[\d.]+"), "date_shift": ("15/04/2024", r"\d\d/\d\d/202[45]"), "api_key": ("A" * 32, r"[A-Za-z0-9]{32}"),
    "company": ("ACME", r".+ (S\.r\.l\.|S\.p\.A\.|S\.n\.c\.|S\.a\.s\.|S\.r\.l\.s\.)"), "practice_id": ("x", r"[A-Z0-9]{8}"), "policy_number": ("x", r"[A-Z0-9]{10}"), "loyalty_id": ("x", r"[A-Z0-9]{10}"),
    "ticket_id": ("x", r"[A-Z0-9]{8}"), "iban": ("IT1", r"IT\d{2}[A-Z]\d{22}"), "credit_card": ("4", r"4\d{15}"), "ip": ("1.1.1.1", r"10(\.\d+){3}"), "mac": ("x", r"([0-9a-f]{2}:){5}[0-9a-f]{2}"),
    "gps": ("x", r"-?\d+\.\d+, -?\d+\.\d+"), "password": ("short", r".{12}"), "person": ("x", r"\w+ \w+"), "city": ("x", r"[\w ]+"), "address": ("x", r".+, \d{5} .+"), "url": ("x", r"https://\S+"),
    "username": ("x", r"\S+"), "organization": ("x", r".+"), "unheard_of": ("abcdefghij", r"[A-Z0-9]{10}"),
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def test_strategies(spark):
    given = [(s, v, c) for s, (v, _) in STRATEGIES.items() for c in ("ctx-A", "ctx-B")] + [("date_shift", "not a date", "c"), ("salary", "none", "c"), ("email", "noemail", "c")]
    frame = spark.createDataFrame(given, "s string, v string, c string")
    made = surrogates.generate(F.col("s"), F.col("v"), F.col("c"), F.lit("it_IT"))
    got, again = ({(r.s, r.v, r.c): r.x for r in f.select("s", "v", "c", made.alias("x")).collect()} for f in (frame, frame.repartition(3)))
    assert got == again
    for s, (v, form) in STRATEGIES.items():
        assert re.fullmatch(form, got[s, v, "ctx-A"]), (s, got[s, v, "ctx-A"])
    assert got["date_shift", "not a date", "c"] == "not a date" and got["salary", "none", "c"].isdigit() and "@" in got["email", "noemail", "c"]
    assert luhn(got["imei", "123456789012345", "ctx-A"]) == 0 and luhn(got["credit_card", "4", "ctx-A"]) == 0
    iban = got["iban", "IT1", "ctx-A"]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert sum(got[s, v, "ctx-A"] != got[s, v, "ctx-B"] for s, (v, _) in STRATEGIES.items()) > 25


def test_surrogate_cache_and_profiles(spark):
    values = spark.createDataFrame([("c", "EMAIL", "a@b.com", "it"), ("c", "PERSON", "Mario  ROSSI", "it"), ("c", "PERSON", "mario rossi", "it"), ("c", "FISCAL_CODE", "RSSMRA80A41H501U", "it"), ("c", "NEW", "abcdefghi", None)], "context_id string, pii_type string, text string, language string")
    registry = policy.type_registry(spark)
    got = {r.text: r for r in surrogates.surrogates(values, registry).collect()}
    assert got["Mario  ROSSI"].fake_value == got["mario rossi"].fake_value and re.fullmatch("[A-Z0-9]{9}", got["abcdefghi"].fake_value)
    cached = spark.createDataFrame([("c", "EMAIL", got["a@b.com"].real_hash, "kept@b.com")], "context_id string, pii_type string, real_hash string, fake_value string")
    again = {r.text: r.fake_value for r in surrogates.surrogates(values, registry, cached).collect()}
    assert again == {t: "kept@b.com" if t == "a@b.com" else r.fake_value for t, r in got.items()}


def test_stream_adds_new_mappings_once(spark, tmp_path):
    schema = "doc_id long, text string, context_id string, context_type string"
    for number, batch in enumerate(([(1, "scrivi a a@b.com", "x", "case_file")], [(2, "scrivi a c@d.org", "x", "case_file"), (3, "e a e@f.net", "y", "case_file"), (4, None, "y", "case_file")])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        docs = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        anonymise_stream(PiiEngine(spark), docs, str(tmp_path / "out"), str(tmp_path / "maps"), str(tmp_path / "ck")).awaitTermination()
    stored = {(r.context_id, r.token): r.original for r in spark.read.parquet(str(tmp_path / "maps")).collect()}
    assert stored == {("x", "[EMAIL_1]"): "a@b.com", ("y", "[EMAIL_1]"): "e@f.net"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_many_tokens_of_one_context(spark):
    """A text meets the tokens that it holds, whatever else its context has stored; surrogate values come after them."""
    stored = spark.range(100_000).selectExpr("'c' context_id", "'t' context_type", "concat('[X_', id, ']') token", "concat('v', id) original")
    stored = stored.unionAll(spark.createDataFrame([("c", "t", "Ada Rossi", "Bo"), ("c", "t", "Ada", "Cy"), ("d", "t", "[X_1]", "other")], stored.schema))
    rows = [(1, "c", "t", "[X_1] and [X_99999], [X_1] [Y_1] Ada Rossi, Ada"), (2, "d", "t", "[X_1] Ada"), (3, "c", "t", None), (4, "e", "t", "[X_1]"), (4, "e", "t", "[X_1]")]
    texts = spark.createDataFrame(rows, "doc_id long, context_id string, context_type string, text string")
    got = sorted((r.doc_id, r.restored_text) for r in replace.deanonymise(texts, stored).collect())
    assert got == [(1, "v1 and v99999, v1 [Y_1] Bo, Cy"), (2, "other Ada"), (3, None), (4, "[X_1]"), (4, "[X_1]")]


def test_stored_surrogates_and_personas_are_used_again(spark):
    docs = spark.createDataFrame([(1, "Targa AB123CD, CF RSSMRA80A41H501U", "x", "case_file", "surrogate")], "doc_id long, text string, context_id string, context_type string, mode string")
    engine = PiiEngine(spark)
    first = engine.anonymise(docs).first().anonymized_text
    made, people = engine.new_surrogates(docs)
    assert {r.pii_type for r in made.collect()} == {"TARGA"} and people.count() == 1
    edited = spark.createDataFrame([(r.context_id, r.pii_type, r.real_hash, "ZZ999ZZ") for r in made.collect()], "context_id string, pii_type string, real_hash string, fake_value string")
    persona = spark.createDataFrame([(r.context_id, r.real_hash, *(getattr(r, c) for c in surrogates.PERSONA[:-1]), "AAAAAA00A00A000A") for r in people.collect()], people.schema)
    again = PiiEngine(spark, stored_surrogates=edited, stored_profiles=persona)
    second = again.anonymise(docs).first().anonymized_text
    assert second == "Targa ZZ999ZZ, CF AAAAAA00A00A000A" != first
    assert [d.count() for d in again.new_surrogates(docs)] == [0, 0]
    engine.clear()
    again.clear()


def test_rewrite_leaves_a_whole_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.rewrite(spark.range(3), path)
    store.rewrite(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception):
        store.rewrite(spark.range(2).selectExpr("raise_error('no') x"), path)
    assert spark.read.parquet(path).count() == 5


def test_queries_have_names_and_oracles():
    assert set(oracles.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) >= 45


@pytest.mark.parametrize("name", ["anonymize_tag", "policy_resolve", "spans_merged_adjacent", "cf_encode", "stats_summary", "insert_if_absent", "bioes_collapse", "analyzer_layer_spans", "snap_boundary", "key_last_used", "profile_join", "surrogate_cache_join", "deanonymize_roundtrip"])
def test_oracle(spark, sf, name):
    import os

    import duckdb

    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t[:-8]} as select * from '{sf}/{t}'")
    want = con.sql(oracles.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    plain = lambda rs: sorted(tuple(map(str, r)) for r in rs)
    assert plain(got.select(*[F.col(f"`{c}`") for c in columns]).collect()) == plain(con.sql(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} from want").fetchall())
