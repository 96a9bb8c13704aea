"""Counts, pages and accuracy figures over audit rows, mappings and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import decrypted


def breakdown(rows: DataFrame, column: str = "pii_type") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("cnt"))


def requests_since(audit: DataFrame, now: Column, hours: int = 24) -> Column:
    """An aggregate over audit rows: how many are at most so many hours old."""
    return F.count_if(F.col("created_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def summary(audit: DataFrame, mappings: DataFrame, now: Column) -> DataFrame:
    """One row: anonymise requests, mappings, requests of the last 24 hours, and mappings by type as a map."""
    requests = audit.agg(F.count_if(F.col("action") == "anonymize").alias("total_requests"), requests_since(audit, now).alias("requests_last_24h"))
    by_type = breakdown(mappings).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_mappings"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("pii_type", "cnt")))).alias("pii_breakdown"))
    return requests.join(by_type)  # one row each


def page(rows: DataFrame, number: int = 1, size: int = 50, time: str = "created_at", key: str = "id") -> DataFrame:
    """A page of rows, the latest first, equal times by key. Pages count from 1 and have 1 to 200 rows."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("pages count from 1 and have 1 to 200 rows")
    return rows.orderBy(F.desc(time), key).offset((number - 1) * size).limit(size)


def audit_page(audit: DataFrame, action: str | None = None, number: int = 1, size: int = 50) -> DataFrame:
    return page(audit.where(F.col("action") == action) if action else audit, number, size)


def mapping_page(mappings: DataFrame, key: Column, number: int = 1, size: int = 50) -> DataFrame:
    """A page of mappings; what doesn't decrypt is shown as ***."""
    return page(mappings, number, size).withColumn("original", F.coalesce(decrypted(F.col("original_encrypted"), key), F.lit("***"))).drop("original_encrypted")


def audit_rows(anonymised: DataFrame, now: Column, action: str = "anonymize") -> DataFrame:
    """What an anonymise run adds to the audit table."""
    return anonymised.select(
        F.sha2(F.concat_ws("|", F.lit(action), "context_id", "doc_id", now.cast("string")), 256).alias("id"),
        F.lit(action).alias("action"),
        "context_id",
        "pii_types_found",
        F.length("text").alias("char_count"),
        now.alias("created_at"),
    )


def distribution(rows: DataFrame, column: str = "pii_type") -> DataFrame:
    """Counts and their share of the largest count, largest first."""
    counts = breakdown(rows, column)
    return counts.withColumn("share", F.col("cnt") / F.max("cnt").over(Window.partitionBy(F.lit(1)))).orderBy(F.desc("cnt"), column)


def longest_first(surrogates: DataFrame) -> DataFrame:
    return surrogates.orderBy(F.length("fake_value").desc(), "fake_value")


def accuracy(found: DataFrame, truth: DataFrame) -> DataFrame:
    """pii_type, tp, fp, fn, precision, recall, f1 of (doc_id, start, end, pii_type) spans that match exactly."""
    keys = ["doc_id", "start", "end", "pii_type"]
    both = found.select(*keys).distinct().withColumn("f", F.lit(1)).join(truth.select(*keys).distinct().withColumn("t", F.lit(1)), keys, "full")
    counts = both.groupBy("pii_type").agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("pii_type", "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))
