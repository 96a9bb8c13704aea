"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

#: A classifier sees about so many labelled rows; what is drawn is settled by a hash of doc_id.
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of about ``rows`` labelled documents that aren't held out (remainder 2 of 4)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).select("doc_id", F.col(label).cast("double").alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # bounded by ``rows``


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(remainder(F.col(doc_id), 4) == 2, F.lit(False))
