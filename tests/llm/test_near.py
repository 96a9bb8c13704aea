"""SimHash near-duplicates, their joins and components, against brute force."""

import random

import numpy as np
import pytest
import xxhash

from cloakwork.llm import hamming, simhash
from cloakwork.llm.components import connected_components


def components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    at = components(len(rows), edges)
    least = {}
    for (doc_id, _), r in zip(rows, at):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, at)), key=str)


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = simhash.simhash_dedup(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(3, None), (1, ""), (2, " \n\t"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (None, "one two"), (6, "É é x y z a b"), (7, "w " * 50_000), (None, "alone here")]
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, fp long, component_id long")
    got = simhash.simhash_dedup(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("joined,gathered", [(32, 10_000), (1, 10_000), (1, 1)])
@pytest.mark.parametrize("radius", [3, 4])
def test_links_connect_what_is_linked(spark, joined, gathered, radius):
    random.seed(radius)
    if gathered == 1 and radius == 4:
        centres, each = 3, 12
    else:
        centres, each = 4, 40
    values = set()
    for _ in range(centres):
        v = random.getrandbits(64)
        for _ in range(each):
            w = v
            for b in random.sample(range(64), random.randint(0, 5)):
                w ^= 1 << b
            values.add(w - (1 << 64) if w >> 63 else w)
    values = sorted(values)
    edges = hamming.links(spark.createDataFrame([(v,) for v in values], "fp long"), radius, joined, gathered).collect()
    assert all((np.int64(u) ^ np.int64(v)).astype(np.uint64).item().bit_count() <= radius for u, v in edges)
    at = {v: i for i, v in enumerate(values)}
    want = components(len(values), [(i, j) for i, a in enumerate(values) for j, b in enumerate(values[:i]) if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius])
    assert components(len(values), [(at[u], at[v]) for u, v in edges]) == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    random.seed(1)
    names = list(range(300))
    random.shuffle(names)
    got = connected_components(spark.createDataFrame([(names[a], names[b]) for a, b in edges], "u long, v long"))
    want = {}
    for group in (range(61), range(100, 160), (200, 201)):
        least = min(names[i] for i in group)
        want |= {names[i]: least for i in group}
    assert {r.node: r.root for r in got.collect() if r.node != r.root} == {k: v for k, v in want.items() if k != v}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
