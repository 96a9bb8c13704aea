"""Text quality by gradient-boosted trees over histograms of document statistics.

The statistics of a bounded, labelled sample are binned by quantile; each tree grows level by level
from sums of gradients per bin. For scoring, trees are complete and lie in flat arrays, and
all rows of a batch descend all trees together, one level at a time.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks
from .learning import SAMPLE_ROWS, held_out, labelled_sample

STATISTICS = (
    "chars words lines mean_word sd_word longest_word short_words upper digits blanks marks non_ascii "
    "exclamations symbols bars distinct_words top_word repeats distinct_pairs marked_words "
    "mean_line distinct_lines repeated_line_chars ended_lines capitalised"
).split()


def statistics(text: str | None) -> list[float]:
    """The document statistics, in the order of STATISTICS; all are defined for an empty text."""
    data = (text or "").encode()
    n = max(1, len(data))
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    upper, lower, digits = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    blanks, high = hist[9:14].sum() + hist[32], hist[128:].sum()
    words = data.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    lines = data.split(b"\n")
    line_counts = Counter(lines)
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        sizes.mean(),
        sizes.std(),
        np.log1p(sizes.max()),
        (sizes <= 3).mean(),
        upper,
        digits,
        blanks,
        1 - upper - lower - digits - blanks - high,
        high,
        hist[33],
        hist[[35, 36, 37, 38, 42]].sum(),
        hist[124],
        len(counts) / m,
        max(counts.values(), default=0) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        len(set(zip(words, words[1:]))) / m,
        sum(w[-1] in b"!#$%&*" for w in words) / m,
        len(data) / len(lines),
        len(line_counts) / len(lines),
        sum((k - 1) * len(x) for x, k in line_counts.items()) / n,
        sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
        sum(65 <= w[0] <= 90 for w in words) / m,
    ]


class Forest:
    """Boosted complete trees of one depth in flat arrays."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least_hessian: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least_hessian
        inner = (1 << depth) - 1
        self.feature, self.cut, self.leaf, self.base = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        n, width = x.shape if x.size else (0, 0)
        if n == 0:
            return self
        share = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(share / (1 - share)))
        if len(np.unique(y)) < 2:
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        margin = np.full(n, self.base)
        trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                nodes, first = 1 << level, (1 << level) - 1
                best = np.full(nodes, 1e-9)
                total_g, total_h = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
                chosen = np.full(nodes, self.bins, np.int64)
                for j in range(width):
                    key = at * self.bins + binned[:, j]
                    left_g = np.bincount(key, g, nodes * self.bins).reshape(nodes, -1).cumsum(1)[:, : len(cuts[j])]
                    left_h = np.bincount(key, h, nodes * self.bins).reshape(nodes, -1).cumsum(1)[:, : len(cuts[j])]
                    if not left_g.size:
                        continue
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - (total_g**2 / (total_h + self.ridge))[:, None]
                    gain[(left_h < self.least) | (right_h < self.least)] = 0
                    k = gain.argmax(1)
                    better = gain[np.arange(nodes), k] > best
                    best = np.where(better, gain[np.arange(nodes), k], best)
                    feature[first : first + nodes][better] = j
                    chosen[better] = k[better]
                    cut[first : first + nodes][better] = cuts[j][k[better]]
                at = 2 * at + (binned[np.arange(n), feature[first + at]] > chosen[at])
            leaves = 1 << self.depth
            leaf = self.rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + self.ridge)
            margin += leaf[at]
            trees.append((feature, cut, leaf))
        self.feature, self.cut, self.leaf = (np.stack(a) for a in zip(*trees))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        trees, at = np.arange(len(self.leaf)), np.zeros((len(x), len(self.leaf)), np.int64)
        rows = np.arange(len(x))[:, None]
        for level in range(self.depth):
            node = (1 << level) - 1 + at
            at = 2 * at + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[trees, at].sum(1))))


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of docs and the statistics of its texts as an array of doubles."""

    def run(batches):
        for batch in text_chunks(batches, len(keep), 4_000_000):
            found = pa.array([statistics(t.as_py()) for t in batch.column(len(keep))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*keep, "statistics"])

    docs = docs.select(*keep, "text")
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.mapInArrow(run, f"{kinds}, statistics array<double>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest:
    """A forest fitted on about ``rows`` labelled documents, whose statistics alone reach the driver."""
    sample = with_statistics(labelled_sample(docs, labels, "quality", rows), "doc_id", "label").orderBy("doc_id").toPandas()
    x = np.array(sample["statistics"].tolist()).reshape(-1, len(STATISTICS))
    return Forest().fit(x, sample["label"].to_numpy())


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score (probability of quality 1), predicted.

    Null and empty texts are scored by their statistics like any other. Without labels the score is
    0.5; with labels of one kind only, it is near that kind. Null labels are ignored, repeated
    label rows count as often as they come in. Ids that are null are not held out. Other columns
    are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    def run(batches):
        for batch in text_chunks(batches, 1, 4_000_000):
            x = np.array([statistics(t.as_py()) for t in batch.column(1)])
            score = np.concatenate([shared.value.score(x[i : i + 2048]) for i in range(0, len(x), 2048)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    docs = docs.select("doc_id", "text")
    scored = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
