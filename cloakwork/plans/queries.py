"""One query for each family of operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.spans import merge_adjacent, resolve_overlaps, span
from ..operators import detect, policy, replace, reporting, rules, surrogates
from ..operators.detect import Pattern
from ..sources import store
from .engine import Config, PiiEngine
from ..operators import layers
from ..sources.locales import LOCALES

EMAIL = next(p for p in detect.SEEDED if p.pii_type == "EMAIL")
ACCOUNT = next(p for p in detect.SEEDED if p.pii_type == "ACCOUNT")
BIC = next(p for p in detect.SEEDED if p.pii_type == "BIC")
CARD, IP, PHONE, TOKEN = detect.USER
#: The patterns that occur in the bundled tables and that SQL can express.
BUNDLED = Config(patterns=(EMAIL, CARD, IP, PHONE), rules=(), denylist={})
NOW = "2024-01-30 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def requests(spark: SparkSession, sf_dir: str, mode: str | None = None) -> DataFrame:
    """Documents as requests: the source is the context, the language is the document's."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.col("source").alias("context_id"), F.lit("case_file").alias("context_type"), F.col("lang").alias("language"))
    return docs.withColumn("mode", F.lit(mode)) if mode else docs


def span_rows(docs: DataFrame, spans: Column) -> DataFrame:
    rows = docs.select("doc_id", F.explode(spans).alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.pii_type").alias("pii_type"), F.col("s.text").alias("value"))


def pattern_query(*patterns: Pattern):
    return lambda spark, sf_dir: span_rows(documents(spark, sf_dir), detect.regex_spans(F.col("text"), patterns))


def spans_all_raw(spark, sf_dir):
    return reporting.breakdown(span_rows(documents(spark, sf_dir), detect.regex_spans(F.col("text"), (EMAIL, CARD, IP, PHONE, ACCOUNT))))


def spans_merged_overlap(spark, sf_dir):
    return span_rows(documents(spark, sf_dir), resolve_overlaps(detect.regex_spans(F.col("text"), (EMAIL, ACCOUNT, IP))))


def spans_merged_adjacent(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("spans", detect.regex_spans(F.col("text"), (BIC,)))
    return span_rows(docs, merge_adjacent(F.col("spans"), F.col("text")))


def reclassify_by_context(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("spans", detect.regex_spans(F.col("text"), (IP, CARD)))
    moved = (rules.Rule("IP_ADDRESS", "HOST", r"[aeiou]\s$", None, 20), rules.Rule("CREDIT_CARD", None, None, r"^4[0-4]"))
    return span_rows(docs, rules.reclassify(F.col("spans"), F.col("text"), moved))


#: Capitalised words, and the ends of two neighbouring words of which the second is capitalised.
NAME, ENDS = "[A-Z][a-z]+", "[a-z] [A-Z]"


def named(spark, sf_dir, pii_type: str = "PERSON", pattern: str = NAME) -> DataFrame:
    """Documents with a span over every match in the whole text."""
    return documents(spark, sf_dir).withColumn("spans", detect.regex_spans(F.col("text"), (Pattern(pii_type, pattern),)))


def denylist_exact(spark, sf_dir):
    return span_rows(named(spark, sf_dir), rules.allowed(F.col("spans"), {"PERSON": (frozenset(("the", "of", "in", "and", "to", "der", "la", "de")), ())}))


def denylist_contains(spark, sf_dir):
    return span_rows(named(spark, sf_dir), rules.allowed(F.col("spans"), {"PERSON": (frozenset(), ("th", "ion"))}))


def context_boost(spark, sf_dir):
    score = lambda s: F.round(F.pmod(F.col("doc_id") + s["start"], F.lit(10)) / 10.0, 1)
    scored = F.transform("spans", lambda s: span(s["start"], s["end"], s["pii_type"], s["text"], score(s), F.lit("analyzer")))
    docs = named(spark, sf_dir).withColumn("spans", scored)
    rows = docs.select("doc_id", F.explode(detect.boosted(F.col("spans"), F.col("text"), {"PERSON": ["the ", "der "]})).alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.score").alias("score"))


def snap_boundary(spark, sf_dir):
    return span_rows(named(spark, sf_dir, "ADDRESS", ENDS), rules.snap(F.col("spans"), F.col("text")))


def bioes_collapse(spark, sf_dir):
    """Tags dealt by position over all capitalised words of each document."""
    tags = F.array(*map(F.lit, ("B-a", "I-a", "E-a", "O", "S-b", "I-b", "B-b", "E-b", "B-a", "I-b")))
    tag = lambda s, i: F.element_at(tags, (F.pmod(F.col("doc_id") * 7 + i * (F.pmod("doc_id", F.lit(3)) + 1), F.lit(10)) + 1).cast("int"))
    tokens = F.transform("spans", lambda s, i: F.struct(s["start"], s["end"], tag(s, i).alias("tag"), (F.pmod(s["start"], F.lit(64)) / 128.0).alias("score")))
    rows = named(spark, sf_dir).select("doc_id", F.explode(detect.collapsed_tags(tokens)).alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.label", "s.score")


def model_rows(spark, sf_dir, labels=("FIRSTNAME", "JOBTITLE", "EMAIL", "NEWLABEL", "IPV4", "ZIPCODE", "AGE")) -> DataFrame:
    """A model's findings: a label and a score, dealt by place, for every capitalised word."""
    found = named(spark, sf_dir).select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    at = F.col("doc_id") + F.col("start")
    return found.select("doc_id", F.element_at(F.array(*map(F.lit, labels)), (F.pmod(at, F.lit(len(labels))) + 1).cast("int")).alias("label"), (F.pmod(at * 37, F.lit(100)) / 100.0).alias("score"), "start", "end")


def label_map_threshold(spark, sf_dir):
    return detect.labelled_spans(model_rows(spark, sf_dir), "classifier").select("doc_id", F.col("start").cast("long").alias("start"), "pii_type", "score")


def external_layer_spans(spark, sf_dir):
    return span_rows(detect.external_spans(documents(spark, sf_dir), model_rows(spark, sf_dir), "classifier"), F.col("spans"))


def analyzer_layer_spans(spark, sf_dir):
    """Scores on both sides of the threshold: a context word before a span rescues a low one."""
    found = detect.external_spans(documents(spark, sf_dir), model_rows(spark, sf_dir, ("PERSON", "LOCATION", "EMAIL_ADDRESS", "DATE_TIME", "URL")), "analyzer", words={"PERSON": ["the ", "der "], "EMAIL": [" de "]})
    rows = found.select("doc_id", F.explode("spans").alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.pii_type").alias("pii_type"), F.col("s.score").alias("score"))


def mail_like(texts: list[str], languages: list[str]) -> list:
    """A detector in Python: runs around an at sign."""
    import re

    return [[(m.start(), m.end(), "URL", 0.8) for m in re.finditer(r"[^ \n\r\t]*@[^ \n\r\t]*", t)] for t in texts]


def failing(texts: list[str], languages: list[str]) -> list:
    raise RuntimeError("no model")


def layers_by_priority(spark, sf_dir):
    """Four layers, of which one isn't available and one fails on every text; patterns win over the models' overlapping spans."""
    docs = documents(spark, sf_dir).withColumn("from_model", F.transform(detect.regex_spans(F.col("text"), (IP,)), lambda s: span(s["start"], s["end"], s["pii_type"], s["text"], F.lit(0.7), F.lit("model"))))
    registry = layers.Layers.of([
        layers.PatternLayer((EMAIL,)),
        layers.ColumnLayer("from_model", "model", 20),
        layers.ArrowLayer(mail_like, "mail", 10, guard="@"),
        layers.ArrowLayer(failing, "failing", 5),
        layers.FindingsLayer(None, "classifier", 25),
        layers.ArrowLayer(mail_like, "off", 1),
    ], {"off": {"enabled": False}})
    found = registry.find(docs)
    rows = found.select("doc_id", F.explode(resolve_overlaps(F.col("spans"))).alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.pii_type").alias("pii_type"), F.col("s.source").alias("source"))


CONTEXT_NAMES = ("default", "fine_appeal", "medical", "hr", "embedding", "legal_brief", "unheard_of")


def contextual(spark, sf_dir) -> DataFrame:
    names = F.array(*map(F.lit, CONTEXT_NAMES))
    inline = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.struct(F.array(F.lit("EMAIL")).alias("protect"), F.lit(None).cast("array<string>").alias("keep"), F.array().cast("array<string>").alias("surrogate")))
    return documents(spark, sf_dir).select("doc_id", "text", F.element_at(names, (F.pmod("doc_id", F.lit(7)) + 1).cast("int")).alias("context_type"), F.when(F.pmod("doc_id", F.lit(11)) == 0, "").when(F.pmod("doc_id", F.lit(13)) == 0, "surrogate").alias("mode"), inline.alias("policy"))


def policy_resolve(spark, sf_dir):
    found = policy.resolve(contextual(spark, sf_dir), policy.context_types(spark), policy.domain_policies(spark))
    listed = lambda c: F.array_join(F.array_sort(c), " ")
    return found.select("doc_id", "context_type", "mode", listed("protect").alias("protect"), listed("keep").alias("keep"), listed("surrogate").alias("surrogate"))


def policy_filter(spark, sf_dir):
    docs = contextual(spark, sf_dir).withColumn("spans", detect.regex_spans(F.col("text"), (EMAIL, CARD, IP)))
    found = policy.resolve(docs, policy.context_types(spark), policy.domain_policies(spark))
    return span_rows(found, policy.protected(F.col("spans"), F.col("protect"), F.col("keep"), F.col("surrogate")))


def tagged(spark, sf_dir) -> DataFrame:
    return PiiEngine(spark, BUNDLED).anonymise(requests(spark, sf_dir, "tag"))


def tag_tokens(spark, sf_dir):
    rows = tagged(spark, sf_dir).select("doc_id", F.explode("entities").alias("e"))
    return rows.select("doc_id", F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"), F.col("e.token").alias("token"))


def anonymize_tag(spark, sf_dir):
    return tagged(spark, sf_dir).select("doc_id", "anonymized_text", F.col("entity_count").cast("long").alias("entity_count"), F.array_join("pii_types_found", " ").alias("types"))


def anonymize_all_patterns(spark, sf_dir):
    found = PiiEngine(spark).anonymise(requests(spark, sf_dir, "tag"))
    return found.select("doc_id", "anonymized_text", "entity_count", F.array_join("pii_types_found", " ").alias("types"))


def mapping_rows_dedup(spark, sf_dir):
    return replace.mapping_rows(tagged(spark, sf_dir))


def deanonymize_roundtrip(spark, sf_dir):
    """Each document is its own context, so its text comes back. Texts and mappings are read from what was written once."""
    docs = requests(spark, sf_dir, "tag").withColumn("context_id", F.col("doc_id").cast("string"))
    found, _ = store.settled(PiiEngine(spark, BUNDLED).anonymise(docs).select("doc_id", "context_id", "context_type", "anonymized_text", "entities"))
    texts = found.select("doc_id", "context_id", "context_type", F.col("anonymized_text").alias("text"))
    return replace.deanonymise(texts, replace.mapping_rows(found)).select("doc_id", "restored_text")


def deanonymize_surrogates(spark, sf_dir):
    """Each document is its own context; what surrogates have replaced comes back from the stored texts and mappings."""
    docs = requests(spark, sf_dir, "surrogate").withColumn("context_id", F.col("doc_id").cast("string"))
    found, _ = store.settled(PiiEngine(spark, BUNDLED).anonymise(docs).select("doc_id", "context_id", "context_type", "anonymized_text", "entities"))
    texts = found.select("doc_id", "context_id", "context_type", F.col("anonymized_text").alias("text"))
    return replace.deanonymise(texts, replace.mapping_rows(found)).select("doc_id", "restored_text")


def surrogate_leaks(spark, sf_dir):
    """Requests with repeated and null ids and contexts: how many values were protected, and how many stand where they stood."""
    docs = requests(spark, sf_dir, "surrogate").withColumn("nth", F.col("doc_id"))
    odd = docs.withColumns({"doc_id": F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("doc_id") % 5), "context_id": F.when(F.col("doc_id") % 2 == 0, F.col("context_id"))})
    found = PiiEngine(spark, BUNDLED).anonymise(odd)
    kept = F.size(F.filter("entities", lambda e: F.lower(e["token"]) == F.lower(e["original"])))
    return found.select("nth", F.col("entity_count").cast("long").alias("entities"), kept.cast("long").alias("in_clear"), (F.col("anonymized_text") == F.col("text")).alias("unchanged"))


def orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def insert_if_absent(spark, sf_dir):
    rows = orders(spark, sf_dir).select("id", "cust", "status")
    there = rows.where("id % 3 = 0").groupBy("cust", "status").agg(F.min("id").alias("id")).select("id", "cust", "status")
    return store.insert_if_absent(there, rows, ["cust", "status"], [F.desc("id")])


def upsert_last_wins(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.lit("none").alias("value"))
    return store.upsert(customers, orders(spark, sf_dir).select("cust", F.concat("status", F.lit(" "), F.col("id").cast("string")).alias("value"), "id"), ["cust"], [F.col("id")])


def partial_update(spark, sf_dir):
    rows = orders(spark, sf_dir).select("id", "cust", "status")
    changes = rows.where("id % 2 = 0").select("id", F.when(F.col("cust") % 2 == 0, "X").alias("status"))
    return store.partial_update(rows, changes, ["id"])


def bulk_delete_anti(spark, sf_dir):
    rows = orders(spark, sf_dir)
    return store.delete_keys(rows.select("id", "cust", "status"), rows.where("price > 200000").select("id"))


def bulk_delete_count(spark, sf_dir):
    rows = orders(spark, sf_dir)
    return store.deleted_count(rows, rows.where("price > 200000").select("id").distinct())


def audit(spark, sf_dir) -> DataFrame:
    """The events as an audit table."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("context_id"), F.col("ts").alias("created_at"))


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def ttl_delete(spark, sf_dir):
    return store.keep_recent(audit(spark, sf_dir), now(), 10).select("id", "action", "context_id")


def stats_breakdown(spark, sf_dir):
    return reporting.breakdown(audit(spark, sf_dir), "action")


def stats_summary(spark, sf_dir):
    rows = audit(spark, sf_dir).withColumn("action", F.when(F.col("action") == "click", "anonymize").otherwise(F.col("action")))
    stored = table(spark, sf_dir, "events").select(F.col("event_type").alias("pii_type"))
    found = reporting.summary(rows, stored, now())
    return found.select("total_requests", "total_mappings", "requests_last_24h", F.array_join(F.transform(F.map_entries("pii_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ").alias("by_type"))


def requests_last_24h(spark, sf_dir):
    return audit(spark, sf_dir).agg(reporting.requests_since(audit(spark, sf_dir), now()).alias("requests"))


def audit_page(spark, sf_dir):
    return reporting.audit_page(audit(spark, sf_dir), "purchase", number=3, size=20).select("id", "action", "context_id")


MAPPING_KEY = "0123456789abcdef"


def mapping_page(spark, sf_dir):
    rows = audit(spark, sf_dir).withColumn("original", F.concat(F.lit("value "), F.col("id").cast("string")))
    hidden = store.with_encrypted(rows, F.lit(MAPPING_KEY)).withColumn("original_encrypted", F.when(F.col("id") % 4 == 0, "bm90IGVuY3J5cHRlZA==").otherwise(F.col("original_encrypted")))
    return reporting.mapping_page(hidden, F.lit(MAPPING_KEY), number=2, size=40).select("id", "original")


def mappings_by_context(spark, sf_dir):
    """Mappings of the asked contexts with their originals; those that don't decrypt are left out."""
    rows = audit(spark, sf_dir).withColumn("original", F.concat(F.lit("value "), F.col("id").cast("string")))
    hidden = store.with_encrypted(rows, F.lit(MAPPING_KEY)).withColumn("original_encrypted", F.when(F.col("id") % 4 == 0, "bm90IGVuY3J5cHRlZA==").otherwise(F.col("original_encrypted")))
    asked = people(spark, sf_dir).where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("context_id"))
    return store.readable(hidden.join(asked, "context_id", "left_semi"), F.lit(MAPPING_KEY)).select("id", "context_id", "original")


def setting_or_default(spark, sf_dir):
    settings = people(spark, sf_dir).select(F.col("c_name").alias("key"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("value"))
    return settings.agg(store.setting(settings, "Customer#000000007", "none").alias("known"), store.setting(settings, "default_language", "it").alias("unknown"))


def audit_sink_rows(spark, sf_dir):
    rows = reporting.audit_rows(tagged(spark, sf_dir), now())
    return rows.select("id", "action", "context_id", F.array_join("pii_types_found", " ").alias("types"), F.col("char_count").cast("long").alias("char_count"))


def insert_new_keys(spark, sf_dir):
    """Orders whose keys the table doesn't have go in without a conflict."""
    rows = orders(spark, sf_dir).select("id", "cust", "status")
    return store.insert_or_conflict(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["id"])


def audit_total(spark, sf_dir):
    """How many rows all pages of an action have together."""
    return audit(spark, sf_dir).where("action = 'purchase'").agg(F.count("*").alias("total"))


def api_key_count(spark, sf_dir):
    return people(spark, sf_dir).agg(F.count("*").alias("keys"))


def key_last_used(spark, sf_dir):
    keys = people(spark, sf_dir).select("c_custkey", store.key_hash(F.col("c_name")).alias("key_hash"), (F.col("c_custkey") % 5 != 0).alias("active"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("last_used_at"))
    asked = audit(spark, sf_dir).join(people(spark, sf_dir), F.col("context_id") == F.col("c_custkey").cast("string")).select(F.col("c_name").alias("api_key"), "created_at")
    return store.usage(keys, asked).select("c_custkey", "last_used_at")


def name_keys(spark, sf_dir):
    written = F.concat(F.lit("  "), F.upper("c_name"), F.lit("\t de\n la "), F.col("c_custkey").cast("string"))
    return people(spark, sf_dir).select("c_custkey", tx.name_key(written).alias("key"))


def surrogate_cache_join(spark, sf_dir):
    """Values whose surrogates are stored take the stored one; others are left out here, for they are drawn."""
    values = surrogate_values(spark, sf_dir)
    stored = values.where(F.length("text") % 2 == 0).select("context_id", "pii_type", tx.value_hash(F.col("text")).alias("real_hash"), F.concat(F.lit("fake "), F.col("text")).alias("fake_value"))
    return surrogates.surrogates(values, policy.type_registry(spark), stored).where(F.length("text") % 2 == 0).select("pii_type", "text", "fake_value")


def profile_join(spark, sf_dir):
    """Persons with a stored persona get its name, those of the other contexts an invented one."""
    values = people(spark, sf_dir).select(F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("context_id"), F.lit("PERSON").alias("pii_type"), F.col("c_name").alias("text"), F.lit("it").alias("language"))
    stored = people(spark, sf_dir).select(
        F.lit("a").alias("context_id"), tx.value_hash(F.lower("c_name")).alias("real_hash"), F.lit("Ada").alias("fake_first_name"), F.concat(F.lit("N"), F.col("c_custkey").cast("string")).alias("fake_last_name"),
        F.lit("1970-01-01").cast("date").alias("fake_birth_date"), F.lit("F").alias("fake_gender"), F.lit("Roma").alias("fake_city"), F.lit("H501").alias("fake_belfiore"), F.lit("X").alias("fake_cf"),
    )
    made = surrogates.surrogates(values, policy.type_registry(spark), stored=stored)
    return made.select("context_id", "text", F.when(F.col("context_id") == "a", F.col("fake_value")).alias("fake_value"))


def distribution_normalised(spark, sf_dir):
    return reporting.distribution(audit(spark, sf_dir), "action")


def requests_by_window(spark, sf_dir):
    from ..streaming.stream import requests_by_day

    return requests_by_day(audit(spark, sf_dir))


def people(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name")


def sha_seed(spark, sf_dir):
    return people(spark, sf_dir).select("c_custkey", tx.value_hash(F.col("c_name")).alias("hash"), F.substring(tx.value_hash(F.concat_ws("|", "c_name", F.col("c_custkey").cast("string"))), 1, 16).alias("hex"), tx.seed(F.col("c_name"), F.col("c_custkey").cast("string")).cast("string").alias("seed"))


def citizens(spark, sf_dir) -> DataFrame:
    """Customers as persons with names, dates and towns derived from their keys."""
    key = F.col("c_custkey")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    return people(spark, sf_dir).select(
        "c_custkey",
        pick(("Rossi", "Verdi", "Fo", "D'Angelo", "Bianchi", "Aiello"), key).alias("last"),
        pick(("Maria", "Francesco", "Al", "Gianluca", "Io"), key * 3).alias("first"),
        F.date_add(F.lit("1950-01-01").cast("date"), F.pmod(key * 37, F.lit(18_000)).cast("int")).alias("birth"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        pick(("Roma", "Milano", "Reggio Emilia", "Atlantide"), key).alias("city"),
    )


def cf_encode(spark, sf_dir):
    return citizens(spark, sf_dir).select("c_custkey", tx.tax_code(*map(F.col, ("last", "first", "birth", "gender", "city"))).alias("cf"))


def cf_decode(spark, sf_dir):
    rows = cf_encode(spark, sf_dir).withColumn("cf", F.when(F.col("c_custkey") % 9 == 0, "short").otherwise(F.lower("cf")))
    return rows.select("c_custkey", tx.decoded_tax_code(F.col("cf")).alias("d")).select("c_custkey", "d.year2", F.col("d.month").cast("string").alias("month"), F.col("d.day").cast("string").alias("day"), "d.gender", "d.belfiore")


def luhn_imei(spark, sf_dir):
    body = F.lpad((F.col("c_custkey") * 7919 + 12345).cast("string"), 14, "3")
    return people(spark, sf_dir).select("c_custkey", F.concat(body, tx.digit_sum_luhn(body)).alias("imei"))


def salary_parse(spark, sf_dir):
    key = F.col("c_custkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("EUR "), F.format_number(key * 1000, 0))).when(key % 3 == 1, F.concat(key.cast("string"), F.lit(".500,25 euro"))).otherwise("none")
    return people(spark, sf_dir).select("c_custkey", tx.salary_amount(text).alias("amount"))


def date_shift_fixed(spark, sf_dir):
    key = F.col("c_custkey")
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(key, F.lit(900)).cast("int"))
    written = F.when(key % 5 == 0, F.date_format(day, "dd/MM/yyyy")).when(key % 5 == 1, F.date_format(day, "yyyy-MM-dd")).when(key % 5 == 2, F.date_format(day, "dd-MM-yyyy")).when(key % 5 == 3, F.date_format(day, "dd.MM.yyyy")).otherwise("3 marzo 2024")
    return people(spark, sf_dir).select("c_custkey", tx.shifted_date(written, F.pmod(key, F.lit(330)) + 30).alias("shifted"))


def locale_lookup(spark, sf_dir):
    languages = F.array(*map(F.lit, ("it", "EN", "en_gb", "xx", "Ro")))
    return people(spark, sf_dir).select("c_custkey", tx.locale_of(F.element_at(languages, (F.pmod("c_custkey", F.lit(5)) + 1).cast("int"))).alias("locale"))


def surrogate_values(spark, sf_dir) -> DataFrame:
    found = span_rows(documents(spark, sf_dir), detect.regex_spans(F.col("text"), (EMAIL, CARD, IP, PHONE)))
    return found.select(F.lit("corpus").alias("context_id"), "pii_type", F.col("value").alias("text"), F.lit("en").alias("language")).distinct()


def surrogate_simple(spark, sf_dir):
    return surrogates.surrogates(surrogate_values(spark, sf_dir), policy.type_registry(spark))


def surrogate_locales(spark, sf_dir):
    """Customers in twelve locales: name, town, address, telephone and account number, with the number's remainder by 97."""
    names = F.array(*map(F.lit, LOCALES))
    rows = people(spark, sf_dir).select("c_custkey", "c_name", F.element_at(names, (F.pmod("c_custkey", F.lit(len(LOCALES))) + 1).cast("int")).alias("locale"))
    made = {k: surrogates.generate(F.lit(k), F.col("c_name"), F.lit("ctx"), F.col("locale")) for k in ("person", "city", "address", "phone", "iban")}
    found = rows.select("c_custkey", "locale", *[c.alias(k) for k, c in made.items()])
    return found.withColumn("remainder", surrogates.mod97(F.concat(F.expr("substring(iban, 5)"), F.substring("iban", 1, 4))).cast("long"))


def surrogate_profile(spark, sf_dir):
    return surrogates.profiles(people(spark, sf_dir).select(F.lit("ctx").alias("context_id"), F.lower("c_name").alias("profile_key"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender")))


def anonymize_surrogate(spark, sf_dir):
    found = PiiEngine(spark, BUNDLED).anonymise(requests(spark, sf_dir, "surrogate"))
    return found.select("doc_id", "anonymized_text", "entity_count", "mode")


def precision_recall(spark, sf_dir):
    """A narrow pattern set, measured against the full one."""
    docs = documents(spark, sf_dir)
    truth = span_rows(docs, detect.regex_spans(F.col("text"), (EMAIL, IP, CARD)))
    narrow = (Pattern("EMAIL", r"[a-z]+\.[0-9]+@mail[1-5]\.example\.com"), Pattern("IP_ADDRESS", IP.pattern), Pattern("CREDIT_CARD", r"\b4[0-9]{14}[0-4]\b"))
    return reporting.accuracy(span_rows(docs, detect.regex_spans(F.col("text"), narrow)), truth)


def authorised_requests(spark, sf_dir):
    keys = people(spark, sf_dir).where("c_custkey % 4 <> 0").select(store.key_hash(F.col("c_name")).alias("key_hash"), F.when(F.col("c_custkey") % 3 == 0, "admin").otherwise("service").alias("role"), (F.col("c_custkey") % 5 != 0).alias("active"))
    asked = people(spark, sf_dir).select("c_custkey", F.col("c_name").alias("api_key"))
    return store.authorised(asked, keys, ["admin"]).select("c_custkey")


def config_listing(spark, sf_dir):
    """The parts as a table of settings: its enabled rows, in order."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(key.alias("id"), F.concat(F.lit("TYPE_"), (key % 7).cast("string")).alias("code"), (key % 3 != 0).alias("enabled"))
    listed = store.scan(rows, "code", "id", enabled_only=True)
    return listed.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("id")))


def surrogates_longest_first(spark, sf_dir):
    rows = people(spark, sf_dir).select("c_custkey", F.col("c_name").alias("fake_value"))
    ranked = reporting.longest_first(rows)
    return ranked.withColumn("rank", F.rank().over(Window.partitionBy(F.length("fake_value")).orderBy("fake_value")))


QUERIES = {
    "regex_spans_email": pattern_query(EMAIL),
    "regex_spans_ip": pattern_query(IP),
    "regex_spans_card": pattern_query(CARD),
    "regex_spans_bic": pattern_query(BIC),
    "regex_spans_token_group": pattern_query(TOKEN),
} | {
    f.__name__: f
    for f in (
        spans_all_raw, spans_merged_overlap, spans_merged_adjacent, reclassify_by_context, denylist_exact, denylist_contains, context_boost, snap_boundary, bioes_collapse,
        label_map_threshold, external_layer_spans, analyzer_layer_spans, mappings_by_context, setting_or_default, audit_sink_rows, insert_new_keys, audit_total, api_key_count, key_last_used, name_keys,
        surrogate_cache_join, profile_join, policy_resolve, policy_filter, tag_tokens, anonymize_tag, anonymize_all_patterns, mapping_rows_dedup, deanonymize_roundtrip,
        insert_if_absent, upsert_last_wins, partial_update, bulk_delete_anti, bulk_delete_count, ttl_delete, stats_breakdown, stats_summary, requests_last_24h, audit_page,
        mapping_page, distribution_normalised, requests_by_window, sha_seed, cf_encode, cf_decode, luhn_imei, salary_parse, date_shift_fixed, locale_lookup, surrogate_simple,
        surrogate_profile, surrogate_locales, surrogate_leaks, deanonymize_surrogates, layers_by_priority, anonymize_surrogate, precision_recall, authorised_requests, config_listing, surrogates_longest_first,
    )
}
