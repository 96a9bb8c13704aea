"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of the bytes that followed.
The probability of a byte comes from the longest context that is in the tree; if the byte
never followed it, an escape probability is paid and the context loses its oldest byte, down to
a uniform choice among 256. The counts are frozen before scoring, so the exact code length of a byte
depends only on the bytes just before it and is tabulated once per context, byte and language.
A text's language is the one whose tree gives it the shortest code.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, text_chunks
from .lookup import Lookup

ORDER = 3
#: At most about so many documents of a language teach its tree.
SAMPLE_DOCS = 1_500
#: Bytes of text that are scored at once.
CHUNK = 300_000


def _folded(text: str | None) -> bytes:
    """What trees are learned from and scored on: a line of lower case between newlines."""
    return f"\n{(text or '').lower()}".encode()


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each run of ORDER + 1 bytes, as an integer, occurs in whole texts."""

    def run(batches):
        for batch in text_chunks(batches, 1, 500_000):
            grams = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(b"\n" * (ORDER - 1) + _folded(text.as_py()), np.uint8).astype(np.int64)
                code = np.zeros(max(0, len(data) - ORDER), np.int64)
                for k in range(ORDER + 1):
                    code = code << 8 | data[k : k + len(code)]
                grams[lang].append(code)
            for lang, codes in grams.items():
                values, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """Code lengths in bits, tabulated, one column per language.

    ``cost[k]`` has a row for each run of k + 1 bytes that occurs in any language: the whole code length of its last byte after
    the others. ``escape[k]`` has a row for each context of k bytes: what a byte costs in addition that never followed it.
    The tables hold every context of the counts and nothing else, so they grow with what was learned from, and not with
    the number of possible contexts.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.cost, self.escape, self.grams, self.contexts = [], [], [], []
        width = len(self.langs)
        for k in range(ORDER + 1):
            ends = [counts[x][0] & (1 << 8 * (k + 1)) - 1 for x in self.langs]
            grams = np.unique(np.concatenate(ends)) if width else np.zeros(0, np.int64)
            n = np.zeros((len(grams), width))
            for j, x in enumerate(self.langs):
                np.add.at(n[:, j], np.searchsorted(grams, ends[j]), counts[x][1])
            contexts, of = np.unique(grams >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                below = 8.0 if k == 0 else self.cost[k - 1][np.searchsorted(before, grams & (1 << 8 * k) - 1)]
                cost = np.where(n > 0, -np.log2(n / (total + kinds)[of]), escape[of] + below)
            self.cost.append(cost)
            self.escape.append(escape)
            self.grams.append(Lookup(grams))
            self.contexts.append(Lookup(contexts))
            before = grams
        self.cost, self.escape = [[t.astype(np.float32) for t in tables] for tables in (self.cost, self.escape)]

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Bits of each whole text under each language."""
        parts = [b"\n" * (ORDER - 1) + _folded(t) for t in texts]
        sizes = np.array([len(x) for x in parts])
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        run = data.copy()
        for k in range(1, ORDER + 1):
            run[k:] |= data[:-k] << 8 * k
        bits = np.zeros((len(data), len(self.langs)), np.float32)
        starts = np.cumsum(sizes) - sizes
        counted = np.ones(len(data), bool)
        for k in range(ORDER):  # what stands before a text isn't part of it
            counted[starts + k] = False
        left = np.flatnonzero(counted)
        for k in range(ORDER, -1, -1):
            code = run[left] & (1 << 8 * (k + 1)) - 1
            at = self.grams[k].find(code)
            known = at >= 0
            bits[left[known]] += self.cost[k][at[known]]
            left, code = left[~known], code[~known] >> 8
            at = self.contexts[k].find(code)
            known = at >= 0
            bits[left[known]] += self.escape[k][at[known]]
        bits[left] += 8
        return np.add.reduceat(bits, starts, axis=0, dtype=np.float64)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Trees:
    """Trees of the languages in ``lang``, from about ``sample_docs`` whole documents of each.

    The sample is dealt by a hash of doc_id; what comes to the driver is its n-gram counts, and their
    number is bounded by the sample.
    """
    docs = docs.where("lang is not null and text is not null and text <> ''").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not sizes:
        return Trees({})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_docs / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    counts = count_grams(docs.where(draw < F.try_element_at(share, F.col("lang")))).toPandas()
    return Trees({lang: (x["gram"].to_numpy(), x["n"].to_numpy()) for lang, x in counts.groupby("lang")})


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs with lang_pred and score of every row: the language with the shortest code, its posterior share.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned. Equal codes
    go to the language that sorts first. Repeated rows appear as often as they come in; other columns
    are ignored, ``lang`` too. Texts alone go to Python, about CHUNK bytes at once; one long text is taken whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def predicted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        trees = shared.value
        names = np.array(trees.langs, object)
        known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool) & bool(len(names))
        pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if known.any():
            bits = trees.lengths([t for t, k in zip(texts, known) if k])
            pred[known] = names[bits.argmin(axis=1)]
            score[known] = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
        return pred, score

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def verdict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            batch = pa.RecordBatch.from_arrays([array], ["text"])
            found = [predicted(part.column(0).to_pylist()) for part in text_chunks([batch], 0, CHUNK)]
            pred, score = (np.concatenate(x) for x in zip(*found)) if found else ([], [])
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return docs.withColumn("_verdict", verdict("text")).withColumns({c: F.col(f"_verdict.{c}") for c in ("lang_pred", "score")}).drop("_verdict")


def language_id(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the columns in ``carry``; learned from the rows that aren't held out (remainder 2 of 4)."""
    trees = learn(docs.where(F.coalesce(remainder(F.col("doc_id"), 4) != 2, F.lit(False))), sample_docs)
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text", *[c for c in carry if c != "text"]), trees).select("doc_id", held_out, "lang_pred", "score", *carry)
