"""Mixed sources against plain sums over sorted lists."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import mixing

KIND = "doc_id long, text string, source string, size int, key string, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "k", "b") for r in rows], KIND)


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def targets(sizes):
    """Excess is reshared by weight until no source is above its bound; exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, left = Fraction(3, 2) * sum(sizes.values()), {}, set(names)
    while left:
        each = (total - sum(out.values())) / sum(weight[s] for s in left)
        full = {s for s in left if each * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: each * weight[s] for s in left}
        out |= {s: Fraction(2 * sizes[s]) for s in full}
        left -= full
    return out


def check(rows, got):
    sizes, by = Counter(), defaultdict(list)
    for d, t, s in rows:
        sizes[s] += words(t)
    want = targets(sizes) if rows else {}
    source = {d: s for d, _, s in rows}
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), words(t)) for d, t, _ in rows)
    for r in got:
        assert r.taken in (r.epochs * r.size, (r.epochs + 1) * r.size) or r.epochs * r.size < r.taken < (r.epochs + 1) * r.size
        assert 0 <= r.taken <= 2 * r.size
        by[source[r.doc_id]].append(r)
    for s, found in by.items():
        assert {r.source_size for r in found} == {sizes[s]}
        assert all(math.isclose(r.target, want[s], abs_tol=1e-6) for r in found)
        assert abs(sum(r.taken for r in found) - want[s]) <= 1
        cut = [r for r in found if r.taken not in (r.epochs * r.size, (r.epochs + 1) * r.size)]
        assert len(cut) <= 1


def made(seed, sources, n):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 5, 40, 700]))) or rng.choice(["", None, " \t\n"]), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize(("sources", "n"), [(["a"] * 30 + ["b", "c", "é", None, "", "Z"], 500), ([None], 20), ([f"s{i}" for i in range(70)], 300)])
def test_against_plain_sums(spark, sources, n):
    rows = made(4, sources, n)
    check(rows, mixing.mix(frame(spark, rows)).collect())


def test_reruns_agree_whatever_the_partitions(spark, monkeypatch):
    rows = made(7, ["a", "a", "a", "b", None], 400)
    once = sorted(map(tuple, mixing.mix(frame(spark, rows)).collect()), key=str)
    random.Random(1).shuffle(rows)
    monkeypatch.setattr(mixing, "BUCKETS", 3)
    assert sorted(map(tuple, mixing.mix(frame(spark, rows).repartition(7)).collect()), key=str) == once
    other = sorted(map(tuple, mixing.mix(frame(spark, rows), seed="again").collect()), key=str)
    assert other != once and sorted(r[3] for r in other) == sorted(r[3] for r in once)


def test_quality_raises_the_chance(spark):
    rows = [(i, "word " * 10, "a") for i in range(3000)]
    better = mixing.mix(frame(spark, rows), quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0), share=0.5).collect()
    taken = Counter()
    for r in better:
        taken[r.doc_id % 2] += r.taken
    # Half of all words: the share of kind w is 1 - exp(-w t), with (1 - exp(-t) + 1 - exp(-4 t)) / 2 = 0.5.
    t = next(x / 1000 for x in range(1, 5000) if 2 - math.exp(-x / 1000) - math.exp(-4 * x / 1000) >= 1)
    assert abs(taken[0] / 15_000 - (1 - math.exp(-4 * t))) < 0.03


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [(None, "a b c", None)] * 50 + [(1, "x y", "s")] * 30 + [(1, "x y", "t"), (1, "x z", "s"), (2, None, "s"), (3, "", "empty")]
    got = mixing.mix(frame(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    assert len(got) == len(rows) and sum(r.taken for r in got) == pytest.approx(float(sum(targets(sizes).values())), abs=2)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix(frame(spark, [])).collect() == []
    assert [tuple(r) for r in mixing.mix(frame(spark, [(1, None, "a"), (2, "", None)])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]


def test_native_plan(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
