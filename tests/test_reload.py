"""A stream that follows its configuration tables."""

import pytest

from cloakwork.plans.engine import Config, PiiEngine
from cloakwork.streaming.stream import ReloadedEngine, anonymise_stream

PATTERN = "id string, pii_type string, pattern string, flags string, capture_group int, enabled boolean"
RULE = "id string, from_type string, to_type string, context_pattern string, entity_pattern string, context_window int, created_at int, enabled boolean"
DENIED = "pii_type string, value string, match_type string, enabled boolean"


def test_a_pattern_added_between_batches_counts_from_the_next_on(spark, tmp_path):
    patterns, rules, denied = (str(tmp_path / n) for n in ("patterns", "rules", "denied"))
    put = lambda rows: spark.createDataFrame(rows, PATTERN).write.mode("overwrite").parquet(patterns)
    put([("1", "CODE", r"\bC\d+\b", "", 0, True)])
    spark.createDataFrame([], RULE).write.parquet(rules)
    spark.createDataFrame([], DENIED).write.parquet(denied)
    made = []
    engine = ReloadedEngine(lambda: tuple(spark.read.parquet(p) for p in (patterns, rules, denied)), lambda config: made.append(config) or PiiEngine(spark, config))
    docs, texts, mappings, checkpoint = (str(tmp_path / n) for n in ("docs", "texts", "mappings", "checkpoint"))
    kind = "doc_id long, text string, context_id string, context_type string"

    def batch(i):
        spark.createDataFrame([(i, "C12 and D34", "c", "t")], kind).coalesce(1).write.mode("append").parquet(docs)
        anonymise_stream(engine, spark.readStream.schema(kind).parquet(docs), texts, mappings, checkpoint).awaitTermination()

    batch(0)
    batch(1)
    assert engine.version == len(made) == 1
    put([("1", "CODE", r"\bC\d+\b", "", 0, True), ("2", "PLACE", r"\bD\d+\b", "", 0, True), ("3", "OFF", "and", "", 0, False)])
    batch(2)
    assert engine.version == len(made) == 2
    got = {r.doc_id: r.anonymized_text for r in spark.read.parquet(texts).collect()}
    assert got == {0: "[CODE_1] and D34", 1: "[CODE_1] and D34", 2: "[CODE_1] and [PLACE_1]"}
    assert {r.token for r in spark.read.parquet(mappings).collect()} == {"[CODE_1]", "[PLACE_1]"}


def test_a_table_that_cannot_be_read_leaves_the_last_engine(spark):
    state = {"fail": False}

    def tables():
        if state["fail"]:
            raise OSError("gone")
        return spark.createDataFrame([("1", "CODE", "C", "", 0, True)], PATTERN), spark.createDataFrame([], RULE), spark.createDataFrame([], DENIED)

    engine = ReloadedEngine(tables, lambda config: config)
    first = engine()
    assert isinstance(first, Config)
    state["fail"] = True
    assert engine() is first and isinstance(engine.failure, OSError) and engine.version == 1
    with pytest.raises(OSError, match="gone"):
        ReloadedEngine(tables, lambda config: config)()
