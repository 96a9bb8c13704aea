"""Benchmark passages in documents, by Wu-Manber search over words.

The patterns are the benchmark's windows of consecutive words. For all windows of one length, a
table tells for each block of two words how far the search may jump; only at the last block
of a window is the jump zero, and the windows that end in that block, found by its hash, are then
compared word by word.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import discard, materialise, schema_of

#: A-Z to a-z; digits, a-z and bytes of other characters stay; all else separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FOUND = "n_words long, hits array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Search:
    """Shift table and suffix buckets of the windows of one length."""

    def __init__(self, length: int, windows: dict[tuple, set]):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list] = {}
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, length), length - end)
            self.bucket.setdefault(window[-self.block :], []).append((list(window), items))

    def ends(self, words: list[bytes]):
        """(position after the window's last word, items) of each occurrence."""
        shift, length, block = self.shift.get, self.length, self.block
        far, end, n = length - block + 1, length, len(words)
        while end <= n:
            jump = shift((words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],), far)
            if jump:
                end += jump
                continue
            for window, items in self.bucket[tuple(words[end - block : end])]:
                if words[end - length : end] == window:
                    yield end, items
            end += 1


def searches(items: list[Row], window: int) -> list[Search]:
    by_length: dict[int, dict[tuple, set]] = {}
    for item in items:
        words = words_of(item["text"])
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = tuple(words[i : i + window])
            by_length.setdefault(len(part), {}).setdefault(part, set()).add(str(item["item_id"]))
    return [Search(n, found) for n, found in sorted(by_length.items())]


def _scan(rows: DataFrame, items: list[Row], window: int, kept: list[str]) -> DataFrame:
    """Adds what the given items hit to the columns hits and items of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(searches(items, window))

    def run(batches):
        for batch in batches:
            counts, hits, found = [], [], []
            for text, old_hits, old_items in zip(batch.column("text"), batch.column("hits"), batch.column("items")):
                words, at, of = words_of(text.as_py()), set(), set()
                for search in shared.value:
                    for end, names in search.ends(words):
                        at.update(range(end - search.length, end))
                        of |= names
                counts.append(len(words))
                hits.append(sorted(at.union(old_hits.as_py())))
                found.append(sorted(of.union(old_items.as_py())))
            new = [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, "n_words", "hits", "items"])

    return rows.mapInArrow(run, f"{schema_of(rows, kept)}, {FOUND}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 1_000_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, text, n_words, hits (indexes of hit words), items (ids as text), and ``carry``.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A
    window is ``window`` consecutive words of an item, or all words of an item with fewer. A null or
    wordless text has no words and no hits; items without an id or without words are ignored; rows
    that repeat an item_id are one item. Repeated documents appear as often as they come in. An empty
    benchmark hits nothing. Other columns, whatever their names, are ignored.

    Tables of a benchmark are about 130 times its text in a Python worker. A benchmark of up to ``block_bytes`` of text is sent to the executors whole; a larger
    one is searched for in blocks of about that size, each over all documents.
    """
    benchmark = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    kept = ["doc_id", "text", *(c for c in carry if c not in ("doc_id", "text"))]
    rows = docs.select(*kept, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for k in range(blocks):
        items = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        before, rows = rows, _scan(rows, items, window, kept)
        if blocks > 1:
            rows = materialise(rows, "scanned")
            if k:
                discard(before)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The digest of ``decontaminate``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = decontaminate(docs, benchmark, window)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS part
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), places AS (
  SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS part
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT k, i, n, item FROM places JOIN windows USING (n, part)
), hit AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM found) GROUP BY k
), items AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT k, item FROM found) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (k) LEFT JOIN items USING (k)
"""
