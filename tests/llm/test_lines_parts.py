"""Buckets of the fuzzy line dedup, whose keys go in arrays by their first bits."""

import io
import random
from collections import defaultdict
from contextlib import redirect_stdout

import pytest

from cloakwork.llm import line_dedup as ld


@pytest.mark.parametrize("held", [ld.HELD, 20, 1])
def test_buckets_are_whole(spark, held, monkeypatch):
    """All pairs of small buckets and all members of crowds come, also if little is held; keys aren't exchanged one by one."""
    random.seed(9)
    words = ["".join(random.choices("abcdefghij", k=7)) for _ in range(400)]
    lines = [" ".join(random.sample(words, 30)) for _ in range(20)]
    for base in lines[:6]:
        for _ in range(random.choice([1, 3, 9, 14, 40])):
            other = base.split()
            other[random.randrange(30)] = random.choice(words)
            lines.append(" ".join(other))
    rows = [(k, "\n".join(random.sample(lines, 20)), k) for k in range(60)] + [(60, "\n".join(lines), 60)]
    found = ld.occurrences(spark.createDataFrame(rows, "doc_id long, text string, key long").repartition(7))
    got = ld.candidates(found, 0.8, most_held=held)
    with redirect_stdout(io.StringIO()) as plan:
        got.explain()
    assert "Generate" not in plan.getvalue()
    line, _, _, _, parts = ld.identities("\n".join(lines).encode())
    buckets, size = defaultdict(set), dict(zip(line.astype("int64").tolist(), map(len, lines)))
    for owner, key in zip(*(x.tolist() for x in ld.block_keys(parts))):
        buckets[key - (key >> 63 << 64)].add(int(line.astype("int64")[owner]))
    pairs = {tuple(sorted((a, b))) for m in buckets.values() if len(m) <= ld.JOINED for a in m for b in m if a < b and abs(size[a] - size[b]) <= 0.2 * max(size[a], size[b])}
    crowds = {(b, a) for b, m in buckets.items() if len(m) > ld.JOINED for a in m}
    got = got.collect()
    assert pairs and crowds
    assert {tuple(sorted((r.u, r.v))) for r in got if r.v is not None} == pairs
    assert {(r.bucket, r.u) for r in got if r.v is None} == crowds


def test_distance_near_its_bound():
    """Lines whose distance is the bound or one more, with other letters in common than those in place."""
    random.seed(12)
    for n in (40, 100, 300):
        for extra in (0, 1):
            base = [random.choice("abcdefgh") for _ in range(n)]
            other = list(base)
            for i in random.sample(range(n), n // 5 + extra):
                other[i] = chr(0x3B1 + i)
            a, b = "".join(base), "".join(other)
            assert ld.similar(a, b, 0.8) == ld.similar(b, a, 0.8) == (extra == 0)
            crowd = [a, b, a[::-1] + "xyz", b[::-1] + "xyz"]
            assert len(ld.forest(crowd, *ld.simhashes(crowd), 0.8, radius=64)) == 2 * (extra == 0)
