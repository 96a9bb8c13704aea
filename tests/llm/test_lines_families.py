"""Crowds of the fuzzy line dedup with lines in common, and texts that are found by their places."""

import random

import numpy as np

from cloakwork.llm import line_dedup as ld


def test_lines_of_a_family_are_compared_once(monkeypatch):
    """Three crowds share most lines: what is linked or apart in one isn't compared again, and no link is lost."""
    random.seed(5)
    bases = [" ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(9)) for _ in range(4)]
    words = [w[:k] + "x" + w[k + 1 :] for w in bases for k in range(0, 12, 2)]
    crowds = [list(range(24)), list(range(2, 24)), list(range(0, 24, 2)) + [1, 3]]
    asked = []
    whole = ld.similar
    monkeypatch.setattr(ld, "similar", lambda a, b, similarity: asked.append(tuple(sorted((a, b)))) or whole(a, b, similarity))
    monkeypatch.setattr(ld, "may_be_similar", lambda a, b, longer, most: np.ones(len(longer), bool))
    family, edges = ld.Family(0.8, 64), []
    for crowd in crowds:
        own = [words[k] for k in crowd]
        edges += family.grow(crowd, own, *ld.simhashes(own))
    assert len(asked) == len(set(asked))
    root = list(range(24))
    for u, v in edges:
        root = [root[u] if r == root[v] else r for r in root]
    assert [len({root[6 * k + i] for i in range(6)}) for k in range(4)] == [1] * 4 and len(set(root)) == 4


def test_texts_come_once_from_their_places(spark):
    """Only the wanted lines come, and each once, also if rows are repeated; lines are counted over the pieces of a long text."""
    long = "\n".join(f"line number {k} of a long text" for k in range(60_000))
    docs = spark.createDataFrame([(1, "One Line\nΑΣ other\n\nthird", 11), (1, "One Line\nΑΣ other\n\nthird", 11), (2, long, 12)], "doc_id long, text string, key long")
    lines = ld.occurrences(docs)
    bit = ld.place_bit(lines["key"], lines["line_no"]).cast("int").alias("place")
    wanted = {(11, 1): "ας other", (11, 3): "third", (12, 59_999): "line number 59999 of a long text", (12, 7): "line number 7 of a long text"}
    places = lines.where("key = 11 and line_no in (1, 3) or key = 12 and line_no in (7, 59999)").select(bit)
    assert sorted(r.words for r in ld.texts_of(docs, places).collect()) == sorted(wanted.values())
