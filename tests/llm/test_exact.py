"""Exact duplicates and benchmark passages, against brute force on small tables."""

import hashlib
import re

import pytest

from cloakwork.llm import decontaminate, exact_dedup


@pytest.mark.parametrize(("hot_share", "hot_rows"), [(0.0, 1), (0.001, 1), (0.2, 1), (1.0, 1), (1e-6, 100_000)])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, hot_share, hot_rows, keep):
    rows = [(1, "a"), (2, "A"), (3, "a"), (4, None), (5, ""), (6, "a "), (7, "a"), (7, "a"), (None, "a"), (None, "solo"), (8, "x" * 200_000), (9, "x" * 200_000), (9, "x" * 199_999 + "y")]
    docs = spark.createDataFrame([(d, t, "k", 0) for d, t in rows], "doc_id long, text string, h string, rank int")
    got = exact_dedup.exact_dedup(docs, keep, hot_share, hot_rows).collect()
    assert len(got) == len(rows)
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    pick = {"max": max, "min": min}[keep]
    for sha, ids in by_sha.items():
        mine = [r for r in got if r.text_sha256 == sha]
        known = [i for i in ids if i is not None]
        best = pick(known) if known else None
        assert sorted(str(r.doc_id) for r in mine) == sorted(map(str, ids))
        assert {(r.keep_id, r.group_size) for r in mine} == {(best, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [best]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_content_sort_moves_each_text_once(spark, sf):
    plan = exact_dedup.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") >= 1 and "Python" not in plan
    assert not re.search(r"hashpartitioning\(text#\d+, \d+\), ENSURE_REQUIREMENTS.*\n.*Project \[doc_id", plan)


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute(docs, items, window):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= found
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [16_000_000, 60])
def test_decontamination(spark, block_bytes):
    text = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, text), (2, "short item"), (10, "Solo"), (3, "two three four five six seven eight nine ten eleven"), (4, None), (5, "?!"), (None, "a b"), (2, "other short"), (6, "x x x x x x x x x x x"), (7, "é-ü Ñ")]
    docs = [(1, text.upper()), (2, None), (3, ""), (4, f"{text}, {text}!"), (5, "x " * 3000), (6, "a solo short. item a b"), (7, "é ü Ñ"), (8, "nothing"), (8, "nothing"), (None, "other SHORT item"), (9, text.replace("five", "5"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, hits int, items string")
    found = decontaminate.decontaminate(frame, bench, 10, block_bytes)
    got = sorted(((r.doc_id, r.n_words, len(r.hits), len(r.items), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.hits)) for r in found.collect()), key=str)
    assert got == brute(docs, items, 10)
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
    assert {r.contaminated for r in decontaminate.contamination(frame, bench.limit(0)).collect()} == {False}
