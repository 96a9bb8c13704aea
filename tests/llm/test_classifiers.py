"""Learned operators: held-out accuracy, and plain recomputations of what they tabulate."""

import math
from collections import defaultdict

import numpy as np
import pytest

from cloakwork.llm import language_id, quality, toxicity
from cloakwork.llm.lookup import Lookup

MEDIUM = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def plain_length(trees_of, text):
    """Code length by walking the contexts from the longest down, byte by byte."""
    counts = defaultdict(lambda: defaultdict(int))
    order = language_id.ORDER
    for t in trees_of:
        data = b"\n" * (order - 1) + language_id._folded(t)
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[data[i - k : i]][data[i]] += 1
    data, bits = b"\n" * (order - 1) + language_id._folded(text), 0.0
    for i in range(order, len(data)):
        p = 1.0
        for k in range(order, -1, -1):
            seen = counts.get(data[i - k : i])
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                p *= seen[data[i]] / total
                break
            p *= len(seen) / total
        else:
            p /= 256
        bits -= math.log2(p)
    return bits


def test_lookup():
    rng = np.random.default_rng(9)
    keys = rng.permutation(np.unique(np.concatenate([np.arange(300), rng.integers(0, 1 << 40, 500)])))
    keys[5] = -7
    table = Lookup(keys)
    assert np.array_equal(table.find(keys), np.arange(len(keys)))
    assert (table.find(np.arange(1 << 41, (1 << 41) + 500)) == -1).all()


def test_tabulated_code_lengths(spark, sf):
    """Every context of the sample counts, on a few words and on whole documents."""
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and r.lang]
    learned, texts = {}, []
    for i, r in enumerate(sorted(docs, key=lambda r: len(r.text))[:90]):
        if i % 3:
            learned.setdefault(r.lang, []).append(r.text)
        else:
            texts.append(r.text)
    rows = [(i, t, lang) for lang, own in learned.items() for i, t in enumerate(own)]
    counts = language_id.count_grams(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    trees = language_id.Trees({x: (g["gram"].to_numpy(), g["n"].to_numpy()) for x, g in counts.groupby("lang")})
    want = [[plain_length(learned[x], t) for x in trees.langs] for t in texts[:12]]
    assert np.allclose(trees.lengths(texts[:12]), want, rtol=1e-5)


def test_tabulated_code_lengths_of_few_words(spark):
    learned = {"xx": ["the cat sat", "on the mat", "ça"], "yy": ["abab abba", "the"]}
    rows = [(i, t, lang) for lang, texts in learned.items() for i, t in enumerate(texts)]
    counts = language_id.count_grams(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    trees = language_id.Trees({x: (g["gram"].to_numpy(), g["n"].to_numpy()) for x, g in counts.groupby("lang")})
    texts = ["the hat", "abba", "ça va 漢", "zzz", "q" * 500]
    want = [[plain_length(learned[x], t) for x in trees.langs] for t in texts]
    assert np.allclose(trees.lengths(texts), want, rtol=1e-5)


def test_language_odd_rows(spark):
    good = [(i, f"the quick brown fox number {i} jumps", "en", 0.5) for i in range(40)] + [(100 + i, f"der schnelle braune fuchs nummer {i} springt", "de", 0.5) for i in range(40)]
    odd = [(200, None, "en", 1.0), (201, "", None, 1.0), (202, "12 34 !!", "en", 1.0), (203, "the fox " * 30_000, None, None), (None, "der fuchs", "de", 0.0), (203, "the fox", None, None)]
    docs = spark.createDataFrame(good + odd, "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred) for r in language_id.language_id(docs).collect()}
    assert {(200, "und"), (201, "und"), (202, "und"), (203, "en"), (None, "de")} <= got
    assert language_id.language_id(docs).count() == len(good + odd)
    assert {r.lang_pred for r in language_id.language_id(docs.where("lang is null")).collect()} == {"und"}
    assert language_id.language_id(docs.limit(0)).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(600, 3)), rng.integers(0, 3, 600)])
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 1)).astype(float)
    forest = quality.Forest(trees=20, depth=3).fit(x, y)
    score = forest.score(x)
    for row, s in zip(x[:50], score):
        margin = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > cut[node])
            margin += leaf[node - len(feature)]
        assert math.isclose(s, 1 / (1 + math.exp(-margin)), rel_tol=1e-9)
    assert ((score > 0.5) == y).mean() > 0.97


def test_quality_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 50_000), (4, "\n\n\n"), (4, "again"), (None, "no id"), (5, "%%% &&&")]
    docs = spark.createDataFrame([(d, t, 9.0, "l") for d, t in rows], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(1, 1, None), (3, 0, 1), (3, 0, 1), (None, 1, 1), (4, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_label_model_learns_accuracies_and_ties():
    rng = np.random.default_rng(5)
    n, y = 20_000, None
    y = rng.random(n) < 0.2
    votes = np.stack([np.where(y, rng.random(n) < hit, rng.random(n) < false) for hit, false in ((0.8, 0.02), (0.6, 0.05), (0.7, 0.01), (0.5, 0.03))], axis=1)
    votes = np.column_stack([votes, votes[:, 1] ^ (rng.random(n) < 0.02)])  # the last voter copies the second
    patterns, which, weight = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = toxicity.LabelModel(5).fit(patterns.astype(float), weight.astype(float))
    assert (1, 4) in model.factors
    assert abs(model.prior - 0.2) < 0.02
    posterior = model.posterior(patterns.astype(float))[which.ravel()]
    assert ((posterior > 0.5) == y).mean() > 0.95


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted and r.toxic for r in got) >= 0.85 * sum(r.toxic for r in got)
    assert sum(r.predicted and not r.toxic for r in got) <= 0.01 * len(got)


def test_toxicity_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "fine words " * 50_000), (4, "you stupid idiot, you pathetic loser"), (4, "calm"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, 9.0, "l") for d, t in rows], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(1, 1, None), (3, 0, 0), (3, 0, 0), (None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    unlearned = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.doc_id for r in unlearned if r.predicted} == {4}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
