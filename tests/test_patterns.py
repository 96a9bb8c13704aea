"""Patterns of users: both dialects, and the table function."""

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import detect, patterns
from cloakwork.operators.detect import Pattern


def test_seeded_patterns_can_be_stored(spark):
    for p in (*detect.USER, *detect.SEEDED[:6]):
        assert patterns.refusal(spark, p) is None, p


@pytest.mark.parametrize(
    ("pattern", "group", "reason"),
    [("(", 0, "Python"), ("a", 1, "Python"), (r"(?P<x>a)", 0, "Java can't"), (r"\Z", 0, "Java"), (r"[a&&b]", 0, "finds"), (r"[[a]", 0, "Java can't"), (r"$", 0, "finds"), (r"(a)|b", 1, None), (r"\bAnna\b", 0, None), (r"[^\W\d_]+", 0, "finds"), (r"[a-z]+@[a-z]+", 0, None)],
)
def test_a_pattern_that_differs_is_refused(spark, pattern, group, reason):
    found = patterns.refusal(spark, Pattern("X", pattern, "", group))
    assert (found is None) == (reason is None) and (reason is None or reason in found), found


def test_rows_are_checked_before_they_are_stored(spark):
    kind = "pii_type string, pattern string, flags string, capture_group int"
    good = spark.createDataFrame([("A", r"\d+", None, None), ("B", "x", "IGNORECASE", 0)], kind)
    assert patterns.checked(spark, good).count() == 2
    with pytest.raises(ValueError, match="^C: Python"):
        patterns.checked(spark, good.unionByName(spark.createDataFrame([("C", "(", "", 0)], kind)))


def test_table_function_equals_column_expression(spark, sf):
    patterns.register_detect_pii(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "Scrivi a é@x mario@test.com, targa AB123CD")], "doc_id long, text string"))
    docs.createOrReplaceTempView("texts_to_search")
    got = sorted(tuple(r) for r in spark.sql("SELECT d.doc_id, p.start, p.end, p.pii_type, p.value FROM texts_to_search d, LATERAL detect_pii(d.text) p").collect())
    want = docs.select("doc_id", F.explode(detect.regex_spans(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.end", "s.pii_type", "s.text").collect()
    assert got == sorted(tuple(r) for r in want) and len(got) > 2
