"""Spelling variants: words of a corpus that are one letter apart, found by deletion keys of rolling hashes.

Two words differ by one replaced letter if they are the same without the letter at one place, and by one inserted letter if
one of them without a letter is the other. A word's polynomial hash and its prefix and suffix sums give the hash without each of its
letters as one NumPy expression over a batch of words. The 64-bit keys are dealt by their high bits and sorted; only keys that occur
twice are joined with their words, and a group counts only if its strings are equal too, so a collision of hashes changes nothing.

No pairs are made: the words of a group are counted, and each gets the most frequent other one. A group is bounded by the alphabet
(the words that a letter at one place tells apart) or by alphabet times length (the words with one letter more).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_TABLE, ascii_lower, crc_sql, discard, materialise, text_chunks

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Words are hashed in batches of about so many bytes; a longer word is a batch of its own.
BATCH_BYTES = 1 << 20
#: A frequency grows at least fivefold from a word to its form, so 27 steps lead to the end, and five doublings cover 32.
DOUBLINGS = 5


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters in lower case (A-Z only), with the slips that a hash of document and run makes.

    Where the CRC-32 of ``<doc_id>:<run>`` is a multiple of 199, the run loses the letter at the CRC modulo its length. A null id
    counts as empty, a null text has no runs.
    """
    # A result has at most as many letters as its run, so shorter runs needn't be read.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_letters},}}"), 0)).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    words = runs.select(F.when(F.col("h") % 199 == 0, _without(F.col("run"), at)).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _without(word: Column, at: Column) -> Column:
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, what they stand for, and the word's place in the list.

    A key stands for the word itself (-1), for the word without its letter at ``at`` where only that place may differ
    (``at``), or for it as a word with one letter less (-2 - ``at``, once for each run of one letter).
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(words)), lengths)
    start = np.cumsum(lengths) - lengths
    at = np.arange(len(points)) - start[row]
    powers = np.full(max(1, int(lengths.max(initial=0))), BASE, np.uint64)
    powers[0] = 1
    terms = (points + np.uint64(1)) * np.cumprod(powers)[at]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    whole = sums[start + lengths] - sums[start]
    before = sums[:-1] - sums[start][row]
    after = whole[row] - before - terms
    without = before + after * np.uint64(INVERSE)
    new = np.ones(len(points), bool)
    new[1:] = (points[1:] != points[:-1]) | (row[1:] != row[:-1])
    own = _mixed(whole)
    keys = np.concatenate([own, _mixed(without[new]), _mixed(without + _mixed(at.astype(np.uint64) + np.uint64(1)))])
    kinds = np.concatenate([np.full(len(words), -1), -2 - at[new], at]).astype(np.int32)
    return keys.view(np.int64), kinds, np.concatenate([np.arange(len(words)), row[new], row])


def _key_batches(mask: int):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, 1, BATCH_BYTES):
            keys, kinds, rows = deletion_keys(batch.column(1).to_pylist())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys & mask), pa.array(kinds), pa.array(ids[rows])], names=["key", "at", "id"])

    return keyed


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, those whose key another row has; the last row of a batch waits for the next."""
    held, joined = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if held is not None:
            same = bool(held.column(0)[0].as_py() == keys[0])
            if joined or same:
                yield held
            joined = same
        equal = np.zeros(len(keys) + 1, bool)
        equal[0] = joined
        equal[1:-1] = keys[1:] == keys[:-1]
        shared = equal[:-1] | equal[1:]
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(shared[:-1]))
        held, joined = batch.slice(batch.num_rows - 1), bool(equal[-2])
    if held is not None and joined:
        yield held


def near_words(words: DataFrame, mask: int = -1) -> DataFrame:
    """(word, n_near, form, form_n) of every word that has near ones: how many, and the most frequent (then the least) of them.

    ``words``: word, n; distinct words. ``mask``: the bits of a key that count; fewer only make more candidates.
    """
    named = words.withColumn("id", F.xxhash64("word"))
    keys = named.select("id", "word").mapInArrow(_key_batches(mask), "key long, at int, id long")
    # Radix partitions: the high bits name a partition, the low ones are sorted within it.
    dealt = keys.repartition(F.shiftrightunsigned("key", 40)).sortWithinPartitions("key")
    shared = dealt.mapInArrow(_shared_keys, "key long, at int, id long").select("at", "id")
    found = shared.join(named, "id")
    rest = F.when(F.col("at") == -1, F.col("word")).otherwise(_without(F.col("word"), F.when(F.col("at") < 0, -2 - F.col("at")).otherwise(F.col("at"))))
    members = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "word", (F.col("at") == -1).alias("own"))))
    groups = found.select("word", "n", "at", F.greatest("at", F.lit(-1)).alias("place"), rest.alias("rest")).groupBy("place", "rest").agg(members.alias("members")).where(F.size("members") > 1)
    result = lambda x, near, best: F.struct(x["word"].alias("word"), near.cast("long").alias("near"), best["order"].alias("order"), best["word"].alias("form"))
    m = F.col("members")
    replaced = F.transform(m, lambda x, i: result(x, F.size(m) - 1, F.when(i == 0, m[1]).otherwise(m[0])))
    own, longer = F.filter(m, lambda x: x["own"]), F.filter(m, lambda x: ~x["own"])
    inserted = F.when(F.size(own) == 1, F.concat(F.transform(own, lambda x: result(x, F.size(longer), longer[0])), F.transform(longer, lambda x: result(x, F.lit(1), own[0]))))
    rows = groups.select(F.explode(F.when(F.col("place") >= 0, replaced).otherwise(inserted)).alias("r")).select("r.*")
    best = F.min(F.struct("order", "form"))
    return rows.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.order")).alias("form_n"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of words with a form: each round doubles how far a word looks along the forms."""
    now = materialise(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(DOUBLINGS):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        new = materialise(now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        discard(now)
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return now


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """One row per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    Words are those of ``word_counts``. Near words differ by exactly one inserted, deleted or replaced letter; a word's form is its
    near word of largest n, of several the least in code-point order, if it occurs at least ``times`` as often; its root is where
    the forms lead, the word itself if it has none. Rows of one id are texts of their own. An empty table gives no rows; other
    columns are ignored. Letters are code points of A-Z, a-z and U+00C0 to U+00FF; accented capitals stay as they are.
    """
    words = materialise(word_counts(docs, least_letters, least_count), "words")
    formed = F.col("form_n") >= F.col("n") * times
    near = words.join(near_words(words), "word", "left").withColumns({"form": F.when(formed, F.col("form")), "form_n": F.when(formed, F.col("form_n"))})
    near = materialise(near, "forms")
    discard(words)
    roots = _roots(near.where("form is not null").select("word", "form"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{6,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
hashed AS (SELECT id, run, m, {crc_sql("(id || ':' || run)")} AS h FROM (SELECT id, run, count(*) AS m FROM runs GROUP BY id, run), crc_table),
slips AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, m FROM hashed),
words AS (SELECT word, sum(m)::BIGINT AS n FROM slips WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, min(struct_pack(o := -m, w := other)) AS best FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.o >= 5 * n THEN best.w END AS form, CASE WHEN -best.o >= 5 * n THEN -best.o END AS form_n
  FROM words w LEFT JOIN near USING (word)),
walk AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN ends USING (word)
"""
