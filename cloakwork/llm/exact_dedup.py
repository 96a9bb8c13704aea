"""Exact duplicates by sorting contents.

Sampled splitters deal the texts out by range, each partition sorts its share outside memory
if need be, and equal texts then stand side by side: the window compares each text in full
with the one before it. Only a text that is very frequent could fill one partition, so those
few are summed up before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SPLITTER_CHARS = 24


#: A text with more rows than this, and more than this share of all, isn't sorted; so there are at most a million such texts.
HOT_ROWS, HOT_SHARE = 1_000, 1e-6


def exact_dedup(docs: DataFrame, keep: str = "max", hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "min" or "max": which id of equal texts stays; ``doc_id`` is a number. Texts are compared as they are.
    A null text counts as empty. Rows that repeat an id are rows of their own; exactly one row
    of a group has ``kept``. A null id never beats another. An empty table gives no rows; other
    columns of ``docs`` are ignored.

    A text that more than ``hot_rows`` rows and more than ``hot_share`` of all rows have is grouped by partial
    aggregation instead of being sorted. There are fewer than 1 / hot_share such texts, which bounds what is broadcast, and
    a partition sorts at most so many equal rows.
    """
    sign = {"max": 1, "min": -1}[keep]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()}
    )
    # Ordered so that the row that stays is the largest of its group.
    rows = rows.withColumn("rank", F.struct((F.col("doc_id") * sign).alias("by"), (-F.col("row")).alias("row")))
    total = docs.count()
    frequent = rows.groupBy("h").count().where(F.col("count") > max(hot_rows, total * hot_share)).select("h", F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(frequent), "h", "left")

    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    # Splitters are sampled to the driver, so they are the beginning of a text and, where many begin alike, its hash;
    # the window then compares whole texts.
    start = F.substring("text", 1, SPLITTER_CHARS)
    same = Window.partitionBy("start", "h", "text")
    cold = (
        rows.where("hot is null")
        .select("doc_id", start.alias("start"), "h", "text", "rank")
        .repartitionByRange("start", "h")
        .withColumns({"best": F.max("rank").over(same), "group_size": F.count("*").over(same)})
        .select("doc_id", "rank", "best", "group_size", sha.alias("text_sha256"))
    )
    hot = rows.where("hot").select("doc_id", "rank", "text", "h")
    groups = hot.groupBy("text").agg(F.max("rank").alias("best"), F.count("*").alias("group_size")).select("best", "group_size", sha.alias("text_sha256"))
    hot = hot.select("doc_id", "rank", sha.alias("text_sha256")).join(F.broadcast(groups), "text_sha256")
    return cold.unionByName(hot).select(
        "doc_id",
        (F.col("best.by") * sign).alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("rank") == F.col("best")).alias("kept"),
        "text_sha256",
    )


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
