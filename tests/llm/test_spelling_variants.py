"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cloakwork.llm import spelling_variants


def slip(doc_id, run):
    run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % 199 == 0 else run


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(docs, least_letters=6, least_count=5):
    runs = Counter(w for d, t in docs for r in re.findall("[A-Za-zÀ-ÿ]+", t or "") if len(w := slip(d, r)) >= least_letters)
    n = {w: c for w, c in runs.items() if c >= least_count}
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(close[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] is not None else None) for w in n)


def found(spark, docs, **how):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, n int")
    rows = spelling_variants.spelling_variants(frame, **how)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in rows.collect())


def variants():
    rng = random.Random(3)
    words = ["letters", "letters", "letter", "aaaaaaa", "aaaaaaaa", "aaaaaa", "aaaabaa", "Ünderé", "ünderé", "naïveté", "naïvete", "times×two", "abcabcabc", "abcabcab"]
    for _ in range(60):
        w = list(rng.choice(words))
        at = rng.randrange(len(w))
        w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "B", "ab"])
        words.append("".join(w))
    docs = [(rng.choice([None, *range(3000)]), " ".join(rng.choices(words, [50 if i % 9 == 0 else 1 for i in range(len(words))], k=rng.randint(0, 60)))) for _ in range(200)]
    return docs + docs[:20] + [(1, None), (2, ""), (None, "letters1letters_LETTERS-Letters letters")]


def test_all_pairs(spark):
    docs = variants()
    want = brute(docs)
    assert found(spark, docs) == want
    assert any(form is not None for _, form, *_ in want) and max(r[4] for r in want) > 5


def test_chain_of_forms(spark):
    chain = ["abcdefghij", "abcdefghik", "abcdefghlk", "abcdefgmlk", "abcdefnmlk"]
    docs = [(i, " ".join([w] * 2 * 5**i)) for i, w in enumerate(chain)]
    want = brute(docs, least_count=1)
    assert found(spark, docs, least_count=1) == want
    assert {r[2] for r in want if r[0] in chain} == {chain[-1]}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert found(spark, [tuple(r) for r in docs.collect()]) == brute([tuple(r) for r in docs.collect()])


def test_long_words_and_empty_tables(spark):
    docs = [(i, f"{'ab' * 40_000} {'ab' * 39_999}a {'ab' * 39_999}cb") for i in range(5)]
    got = found(spark, docs)
    assert [(r[0][:2], len(r[0]), r[3], r[4]) for r in got] == [(w[:2], len(w), n, k) for w, _, _, n, k, _ in brute(docs)]
    assert found(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_keys_are_hashes_of_deletions(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abé", k=rng.randint(6, 12))) for _ in range(300)]
    keys, kinds, rows = spelling_variants.deletion_keys(words)
    named = {}
    for key, kind, row in zip(keys.tolist(), kinds.tolist(), rows.tolist()):
        w = words[row]
        at = kind if kind >= 0 else -2 - kind
        name = (-1, w) if kind == -1 else (max(kind, -1), w[:at] + w[at + 1 :])
        assert named.setdefault(key, name) == name
    assert len(named) == len(set(named.values())) == len(np.unique(keys))
    assert [len(a) for a in spelling_variants.deletion_keys([])] == [0, 0, 0]


def test_colliding_hashes_change_nothing(spark):
    counts = {r[0]: r[3] for r in brute(variants(), least_count=1)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = lambda mask: sorted(tuple(r) for r in spelling_variants.near_words(words, mask).collect())
    assert rows(0x3F) == rows(-1) != []
