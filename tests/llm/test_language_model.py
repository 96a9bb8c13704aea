"""The automaton's scores against plain recomputation, and its probabilities against 1."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cloakwork.llm import language_model as lm

END = b"\n"


def tokens_of(text):
    return [*(text or "").encode().lower().split(), END]


def plain(rows, least=lm.LEAST):
    """All counts, without bounds of any kind but ``least``."""
    train = [tokens_of(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    low = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    states = {}
    for (a, b), k in Counter(p for t in train for p in zip([END, *t[:-1]], t)).items():
        if k >= least:
            states.setdefault(a, {})[b] = (k - lm.DISCOUNT) / c[a]
    fail = {a: (1 - sum(arcs.values())) / (1 - sum(map(low, arcs))) for a, arcs in states.items()}
    high = lambda a, b: states.get(a, {}).get(b) or low(b) * fail.get(a, 1.0)
    out = []
    for d, t in rows:
        t = tokens_of(t)
        held = d is not None and zlib.crc32(str(d).encode()) % 5 == 1
        base = sum(math.log10(low(w)) for w in t)
        out.append((d, held, len(t), sum(c[w] > 0 for w in t), n, base, sum(math.log10(high(a, b)) for a, b in zip([END, *t[:-1]], t))))
    mass = [sum(high(a, b) for b in c) + high(a, b"\0never") for a in [END, *states][:5]]
    return out, mass


def same(got, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    want = sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_tokens():
    texts = ["A b\x1c\tc  É", None, "", " x\n\ny ", "a" * 30, "b"]
    got, sizes = lm.tokens_of(texts)
    want = [w for t in texts for w in tokens_of(t)]
    assert sizes.tolist() == [len(tokens_of(t)) for t in texts]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(want, got.tolist())) and len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("words,arcs,least", [(1_000_000, 3_000_000, 1), (40, 60, 5), (1, 1, 1), (10, 1, 2)])
def test_scores(spark, monkeypatch, words, arcs, least):
    """The bounds of what executors hold change nothing: tiny ones leave all to the joins."""
    monkeypatch.setattr(lm, "WORDS", words)
    monkeypatch.setattr(lm, "ARCS", arcs)
    texts = ["the cat sat on the mat", "the dog sat on the rug", "THE cat", None, "", "a rare word here", "É é unknown bits \x1c", "the cat sat"] * 9 + ["the cat " * 5_000, "never seen before"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "the cat"), (3, "the cat"), (None, "the dog")]
    docs = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, c int, word string")
    want, mass = plain(rows, least)
    same(lm.held_out_scores(docs, least).collect(), want)
    assert np.allclose(mass, 1)
    assert lm.held_out_scores(docs.limit(0)).count() == 0


def test_unlearned(spark):
    only = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    docs = spark.createDataFrame([(i, "some words") for i in only], "doc_id long, text string")
    got = lm.held_out_scores(docs).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)] * 3


@pytest.mark.parametrize("words,arcs", [(1_000_000, 3_000_000), (300, 400)])
def test_whole_table_and_held_out_gain(spark, sf, monkeypatch, words, arcs):
    monkeypatch.setattr(lm, "WORDS", words)
    monkeypatch.setattr(lm, "ARCS", arcs)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = lm.held_out_scores(docs).collect()
    want, _ = plain([(r.doc_id, r.text) for r in docs.collect()])
    same(got, want)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
