"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters look for words of fixed lexicons, for patterns, and for stems that go with toxic labels in a
bounded training sample; the annotation of a sampled document is one more vote. None is trusted: a generative model of their votes, with a
hidden label, estimates how accurate each is and which of them are correlated given the label, and
gives each sampled document a posterior. A logistic classifier on word and stem features is then trained on
these posteriors and scores whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_chunks
from .learning import SAMPLE_ROWS, held_out, labelled_sample

#: Fixed word lists of the lexicon voters, by language.
LEXICONS = {
    "insults_en": "stupid idiot moron loser scum trash pathetic worthless disgusting clown dumb fool jerk imbecile cretin".split(),
    "insults_de": "idiot dumm trottel abschaum depp arschloch versager widerlich wertlos".split(),
    "insults_fr": "idiot stupide imbécile crétin ordure connard minable pathétique salaud".split(),
    "insults_es": "idiota estúpido imbécil basura payaso asqueroso patético inútil cabrón".split(),
    "profanity": "fuck fucking shit bitch bastard asshole damn merde putain scheiße mierda puta joder".split(),
}
PATTERNS = {
    "threat": r"\b(?:kill|hurt|destroy|beat) (?:you|him|her|them)\b|\bgo die\b",
    "attack": r"\b(?:you|you're|u) (?:are |r )?(?:so |such |an? |all )*(?:stupid|idiots?|dumb|trash|pathetic|worthless)\b",
    "hate": r"\bi hate (?:you|them|those)\b|\bshut up\b",
}
#: Of the features in the sample, so many may enter voters and classifier.
MOST_FEATURES, INDUCED_VOTERS, LEAST_Z = 3_000, 6, 3.0
EDGES = b".,;:!?\"'()[]{}<>*#%&$|-_"


LISTED = {w: f"@{name}" for name, words in LEXICONS.items() for w in words}


def features_of(word: str) -> list[str]:
    """Features of a word: itself, its first four and five letters, and the lexicon that lists it."""
    found = ["=" + word, word[:4]]
    if len(word) > 4:
        found.append(word[:5])
    if word in LISTED:
        found.append(LISTED[word])
    return found


def distinct_words(text: str | None) -> set[str]:
    return {w.decode(errors="ignore") for w in {w.strip(EDGES) for w in set((text or "").lower().encode().split())}}


def fixed_votes(text: str | None, words: set[str]) -> int:
    """Bits of the lexicon and pattern voters that vote toxic."""
    lower = (text or "").lower()
    votes = [not words.isdisjoint(x) for x in LEXICONS.values()] + [re.search(p, lower) is not None for p in PATTERNS.values()]
    return sum(1 << i for i, v in enumerate(votes) if v)


def sample_features(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, label, fixed votes, features of each distinct word) of the sampled documents."""

    def run(batches):
        for batch in text_chunks(batches, 2, 2_000_000):
            votes, found = [], []
            for text in batch.column(2).to_pylist():
                words = distinct_words(text)
                votes.append(fixed_votes(text, words))
                found.append([f for w in words for f in features_of(w)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(votes, pa.int32()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "label", "votes", "features"])

    sample = labelled_sample(docs, labels, "toxic", rows).select("doc_id", "label", "text")
    kind = sample.schema["doc_id"].dataType.simpleString()
    return sample.mapInArrow(run, f"doc_id {kind}, label double, votes int, features array<string>")


class LabelModel:
    """Hidden label y; each voter votes or not, with its own rates given y.

    Voters whose votes stay correlated given the posterior are tied in pairs, strongest first, and a pair
    has a joint table instead of two rates, so it isn't counted as two independent witnesses.
    """

    def __init__(self, voters: int, rounds: int = 60, tie: float = 0.25):
        self.voters, self.rounds, self.tie = voters, rounds, tie

    def fit(self, votes: np.ndarray, weight: np.ndarray) -> LabelModel:
        """votes: distinct rows of 0/1; weight: how many documents vote so."""
        self.factors = [(j,) for j in range(self.voters)]
        any_vote = votes.any(axis=1)
        posterior = np.where(any_vote, np.clip(0.4 + 0.25 * votes.sum(1), 0, 0.95), 0.02)
        posterior = self._em(votes, weight, posterior)
        self.correlation = self._residual(votes, weight, posterior)
        free, pairs = set(range(self.voters)), []
        for a, b in sorted(((a, b) for a in free for b in free if a < b), key=lambda p: -abs(self.correlation[p])):
            if abs(self.correlation[a, b]) > self.tie and {a, b} <= free:
                pairs.append((a, b))
                free -= {a, b}
        self.factors = [(j,) for j in sorted(free)] + pairs
        self._em(votes, weight, posterior)
        return self

    def _cells(self, votes: np.ndarray) -> list[np.ndarray]:
        return [sum(votes[:, j].astype(np.int64) << i for i, j in enumerate(f)) for f in self.factors]

    def _em(self, votes, weight, posterior):
        cells = self._cells(votes)
        for _ in range(self.rounds):
            # Weak priors: a vote is more likely on a toxic document, and most documents aren't.
            self.prior = (posterior @ weight + 1) / (weight.sum() + 10)
            self.tables = []
            for f, c in zip(self.factors, cells):
                prior = np.array([[2.0, 0.1], [1.5, 0.5]]) if len(f) == 1 else np.array([[2.0, 0.1, 0.1, 0.05], [1.5, 0.5, 0.5, 0.5]])
                table = np.stack([np.bincount(c, weight * w, 1 << len(f)) for w in (1 - posterior, posterior)]) + prior
                self.tables.append(np.log(table / table.sum(1, keepdims=True)))
            posterior = self.posterior(votes)
        return posterior

    def _residual(self, votes, weight, posterior):
        """Correlation of votes given the label."""
        total = np.zeros((self.voters, self.voters))
        for w in (weight * (1 - posterior), weight * posterior):
            if w.sum() > 1:
                centred = votes - (w @ votes) / w.sum()
                total += (centred * w[:, None]).T @ centred
        sd = np.sqrt(np.maximum(np.diag(total), 1e-9))
        return total / sd[:, None] / sd[None, :]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logit = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for table, c in zip(self.tables, self._cells(votes)):
            logit += table[1, c] - table[0, c]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


@dataclass
class Classifier:
    """Logistic regression over word features: a text's margin is the sum over its distinct words."""

    bias: float
    weights: dict[str, float]

    def __post_init__(self):
        self.cache: dict[bytes, float] = {}

    def _word(self, token: bytes) -> float:
        word = token.strip(EDGES).decode(errors="ignore")
        return sum(self.weights.get(f, 0.0) for f in features_of(word))

    def score(self, text: str | None) -> float:
        if len(self.cache) > 400_000:
            self.cache.clear()
        margin, cache = self.bias, self.cache
        for token in set((text or "").lower().encode().split()):
            known = cache.get(token)
            if known is None:
                known = cache[token] = self._word(token)
            margin += known
        return float(1 / (1 + np.exp(-min(max(margin, -30.0), 30.0))))


def train_linear(rows: list[np.ndarray], target: np.ndarray, width: int, ridge: float = 0.03, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with soft targets: rows are lists of feature numbers, each one word more."""
    if not len(rows):
        return 0.0, np.zeros(width)
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    flat, owner = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), np.diff(at))
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    bias, w = float(np.log(share / (1 - share))), np.zeros(width)
    scale_w, scale_b = np.full(width, 1e-8), 1e-8
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(owner, w[flat], len(rows)), -30, 30)))
        error = p - target
        grad = np.bincount(flat, error[owner], width) + ridge * w
        scale_w += grad**2
        scale_b += error.sum() ** 2
        rate = 0.5
        w -= rate * grad / np.sqrt(scale_w)
        bias -= rate * error.sum() / np.sqrt(scale_b)
    return bias, w


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Classifier:
    """Fits everything on about ``rows`` labelled documents; a bounded sample reaches the driver, as numbers."""
    sample = materialise(sample_features(docs, labels, rows), "toxicity")
    sizes = {r["label"] > 0: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    positive, negative = sizes.get(True, 0), sizes.get(False, 0)
    seen = sample.select("label", F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature").agg(F.sum((F.col("label") > 0).cast("int")).alias("p"), F.count("*").alias("n"))
    # How far the number of toxic documents with the feature lies from what chance would give.
    share = positive / max(1, positive + negative)
    spread = (F.col("p") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1.0)
    seen = seen.where("n >= 3").withColumn("z", spread).where(F.abs("z") >= LEAST_Z)
    chosen = seen.orderBy(F.desc(F.abs("z")), "feature").limit(MOST_FEATURES).toPandas()
    number = {f: i for i, f in enumerate(sorted({*chosen["feature"], *LISTED.values()}))}
    toxic = chosen[(chosen["z"] > 0) & (chosen["p"] >= 0.8 * chosen["n"])]["feature"].tolist()
    induced = {f: i % INDUCED_VOTERS for i, f in enumerate(toxic)}
    fixed = 1 + len(LEXICONS) + len(PATTERNS)

    def reduce(batches):
        for batch in batches:
            votes, kept = [], []
            for label, bits, found in zip(*(c.to_pylist() for c in batch.columns)):
                mine = [f for f in found if f in number]
                votes.append((label > 0) | bits << 1 | sum(1 << fixed + k for k in {induced[f] for f in mine if f in induced}))
                kept.append([number[f] for f in mine])
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.int32()), pa.array(kept, pa.list_(pa.int32()))], ["votes", "features"])

    kept = sample.select("label", "votes", "features").mapInArrow(reduce, "votes int, features array<int>").toPandas()
    voters = fixed + INDUCED_VOTERS
    inputs = [np.array(x, np.int64) for x in kept["features"]]
    patterns, which, weight = np.unique(kept["votes"].to_numpy(np.int64), return_inverse=True, return_counts=True)
    matrix = (patterns[:, None] >> np.arange(voters) & 1).astype(float)
    if not len(patterns):
        return Classifier(-3.0, dict.fromkeys(LISTED.values(), 4.0))
    target = LabelModel(voters).fit(matrix, weight.astype(float)).posterior(matrix)[which]
    bias, w = train_linear(inputs, target, max(1, len(number)))
    return Classifier(bias, {f: float(w[i]) for f, i in number.items() if w[i]})


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score (probability of toxic 1), predicted.

    A null text is scored like an empty one. Null labels and null ids of labels are ignored. Without
    any labelled document, the score rests on the fixed lexicons. Ids that are null are not held out.
    Repeated rows appear as often as they come in; other columns are ignored; an empty table gives no
    rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, rows))

    def run(batches):
        for batch in text_chunks(batches, 1, 4_000_000):
            score = [shared.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    docs = docs.select("doc_id", "text")
    scored = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
