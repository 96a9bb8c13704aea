"""What keeps the work of a task small as tables grow."""

from pyspark.sql import functions as F

from cloakwork.operators import policy, replace
from cloakwork.plans.engine import PiiEngine


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_policies_do_not_gather_documents_by_context(spark, sf):
    """All documents of one context type have one domain: an exchange by it would put them into one task."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("source").alias("context_id"), F.lit("case_file").alias("context_type"))
    plan = plan_of(PiiEngine(spark).anonymise(docs))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_seeded_tables_tell_their_size(spark):
    for table in (policy.context_types(spark), policy.domain_policies(spark), policy.type_registry(spark)):
        assert table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 100_000
        assert table.count() > 4


def exchanged(df):
    """The lines of the plan's exchanges."""
    return [x for x in plan_of(df).split("\n") if "Exchange hashpartitioning" in x]


def test_restoring_moves_hashes_of_words(spark):
    """Words go to the join as hashes: neither they nor their contexts are exchanged, and they aren't exchanged to be made distinct."""
    texts = spark.createDataFrame([(1, "c", "t", "mail [EMAIL_1] now")], "doc_id int, context_id string, context_type string, text string")
    stored = spark.createDataFrame([("c", "t", "[EMAIL_1]", "a@b.c", "EMAIL")], "context_id string, context_type string, token string, original string, pii_type string")
    restored = replace.deanonymise(texts, stored)
    assert [r.restored_text for r in restored.collect()] == ["mail a@b.c now"]
    joined = [x for x in exchanged(restored) if "anchor" in x]
    assert joined and all("(_anchor#" in x for x in joined)


def test_mapping_rows_are_found_in_part_first(spark):
    """A token that all documents of a context have: its rows don't meet in one task, and the first document's right-most original stays."""
    kind = "doc_id long, context_id string, context_type string, entities array<struct<token:string,original:string,pii_type:string,start:int,end:int,score:double>>"
    found = spark.createDataFrame([(i, "c", "t", [("[A_1]", f"x{i}", "A", 0, 2, 1.0), ("[A_1]", f"y{i}", "A", 5, 7, 1.0)]) for i in range(9, -1, -1)], kind)
    rows = replace.mapping_rows(found)
    assert [tuple(r) for r in rows.collect()] == [("c", "t", "[A_1]", "y0", "A")]
    assert "Window" not in plan_of(rows)


def test_restoring_keeps_contexts_apart(spark):
    """Null contexts have no mappings, repeated texts are restored alike, and contexts whose joined names are equal stay apart."""
    rows = [(1, "a", "b\0c", "[X_1] Ada"), (2, "a\0b", "c", "[X_1] Ada"), (3, None, "c", "[X_1]"), (4, "a", "b\0c", "[X_1] Ada"), (5, "a", "b\0c", None)]
    texts = spark.createDataFrame(rows, "doc_id int, context_id string, context_type string, text string")
    stored = spark.createDataFrame([("a", "b\0c", "[X_1]", "one"), ("a\0b", "c", "[X_1]", "two"), ("a\0b", "c", "Ada", "Eva"), (None, "c", "[X_1]", "none")], "context_id string, context_type string, token string, original string")
    got = {r.doc_id: r.restored_text for r in replace.deanonymise(texts, stored).collect()}
    assert got == {1: "one Ada", 2: "two Eva", 3: "[X_1]", 4: "one Ada", 5: None}
