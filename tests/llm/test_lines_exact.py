"""The exact way of the fuzzy line dedup: no pair of similar lines is left out."""

import random

import pytest

from cloakwork.llm import line_dedup as ld


def noisy(line, share, random):
    return "".join(random.choice("abcdefghijklmnopqrstuvwxyz") if c != " " and random.random() < share else c for c in line)


@pytest.mark.parametrize("tile", [4096, 40])
def test_no_similar_pair_is_left_out(spark, tile):
    """Short lines, and long lines with many scattered edits, which share no block."""
    random.seed(11)
    lines = []
    for size in (9, 12, 20, 30, 70, 150, 600):
        for _ in range(6):
            base = "".join(random.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(size)).strip() + "xyz abcde"
            lines += [base] + [noisy(base, share, random) for share in (0.05, 0.1, 0.17)]
    lines += ["a b c d e", "a b c d f"]  # under eight letters: compared for equality only
    names = sorted({ld.words_of(x.encode()) for x in lines})
    long = [w for w in names if len(w.replace(" ", "")) >= 8]
    root = {w: w for w in names}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    for i, a in enumerate(long):
        for b in long[:i]:
            if ld.similar(a, b, 0.8):
                root[find(a)] = find(b)
    first = {}
    for i, x in enumerate(lines):
        first.setdefault(find(ld.words_of(x.encode())), i)
    want = {i: 0 if i in first.values() else 1 for i in range(len(lines))}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in ld.line_dedup(docs, tile=tile, exact=True).collect()}
    assert got == want
    by_blocks = {r.doc_id: r.n_removed for r in ld.line_dedup(docs).collect()}
    assert sum(by_blocks.values()) < sum(want.values())  # what the blocks leave out
