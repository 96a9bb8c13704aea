"""Fuzzy line dedup against brute force, and its recall against edit similarity alone."""

import random

import numpy as np
import pytest

from cloakwork.llm import line_dedup as ld
from cloakwork.llm import line_prints as lp


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar():
    random.seed(2)
    for _ in range(400):
        a = "".join(random.choice("ab é") for _ in range(random.randint(0, 40)))
        b = "".join(random.choice("ab é") if random.random() < 0.2 else x for x in a if random.random() < 0.95)
        want = distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
        assert ld.similar(a, b, 0.8) == want
        assert ld.similar_pairs([a, b], [b, a], 0.8) == [want, want]


def test_similar_pairs_of_very_long_lines():
    """Counts of classes end at 65,535; what they tell must stay a bound."""
    long = "ab" * 200_000
    assert ld.similar_pairs([long, long, long, "", ""], [long[2:], "x" + long, "c" * 400_000, "", long], 0.8) == [True, True, False, True, False]
    assert ld.similar_pairs([], [], 0.8) == []


def test_forest_connects_what_is_similar():
    random.seed(4)
    words = []
    for _ in range(12):
        base = "".join(random.choice("abcdefgh ") for _ in range(random.randint(1, 60)))
        words += ["".join(random.choice("xyz") if random.random() < 0.12 else c for c in base) for _ in range(6)]
    got = components(len(words), ld.forest(words, *ld.simhashes(words), 0.8))
    want = components(len(words), [(i, j) for i in range(len(words)) for j in range(i) if ld.similar(words[i], words[j], 0.8)])
    assert len({*zip(got, want)}) == len(set(got)) == len(set(want))


def components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in edges:
        root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_majorities():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 40, 60)
    starts = np.cumsum(sizes) - sizes
    hashes = rng.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    for got, s, n in zip(lp._majorities(hashes, starts, sizes).tolist(), starts, sizes):
        assert got == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in hashes[s : s + n]) > n)


def keys_of(lines):
    owner, keys = lp.block_keys(lp.identities("\n".join(lines).encode())[-1])
    found = [set() for _ in lines]
    for o, k in zip(owner.tolist(), keys.tolist()):
        found[o].add(k)
    return found


def test_identities_follow_words():
    lines = ["a b", "a  b!", "ab", "b a", "", "--", "é ü", "x" * 50, "x" * 49 + "y", "a b c", "12 3", "1 23", " a b"]
    line, check, size, words, _ = lp.identities("\n".join(lines).encode())
    names = [ld.words_of(x.encode()) for x in lines]
    for i, a in enumerate(names):
        assert words[i] == bool(a) and size[i] == len(a)
        for j, b in enumerate(names):
            assert (line[i] == line[j]) == (check[i] == check[j]) == (a == b)
    # The same whatever stands before.
    assert np.array_equal(lp.identities(("z y\n" + "\n".join(lines)).encode())[0][1:], line)


def brute(rows, similarity=0.8):
    places = {}
    key = lambda d: (d is not None, d or 0)
    for d, t in rows:
        for i, raw in enumerate(t.split("\n") if t is not None else []):
            if line := ld.words_of(raw.lower().encode()):
                places.setdefault(line, []).append((key(d), i, d, t))
    names = list(places)
    by_key = {}
    for i, keys in enumerate(keys_of(names)):
        for k in keys:
            by_key.setdefault(k, []).append(i)
    pairs = {(i, j) for m in by_key.values() for i in m for j in m if i < j}
    fps, tells = ld.simhashes(names)
    near = lambda i, j: not (tells[i] and tells[j]) or int(fps[i] ^ fps[j]).bit_count() <= ld.RADIUS
    roots = components(len(names), [(i, j) for i, j in pairs if near(i, j) and ld.similar(names[i], names[j], similarity)])
    groups = {}
    for n, r in zip(names, roots):
        groups.setdefault(r, []).extend(places[n])
    gone = set()
    for group in groups.values():
        for p in sorted(set(group), key=lambda p: p[:2])[1:]:
            gone.add((p[2], p[3], p[1]))
    out = []
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        stay = [x for i, x in enumerate(lines) if (d, t, i) not in gone]
        out.append((d, "\n".join(stay) if t is not None else None, len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = ld.line_dedup(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_recall_against_edit_similarity(spark, sf):
    """All pairs of the table's lines that are similar, whatever their blocks: the recall that README gives."""
    names = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for x in (r.text or "").split("\n") if len(w := ld.words_of(x.lower().encode())) >= 8}, key=len)
    chars = sorted({c for x in names for c in x})
    counts = np.array([[x.count(c) for c in chars] for x in names], np.int32)
    sizes, keys, met = np.array(list(map(len, names))), keys_of(names), []
    fps, tells = ld.simhashes(names)
    near = lambda i, j: not (tells[i] and tells[j]) or int(fps[i] ^ fps[j]).bit_count() <= ld.RADIUS
    for i, a in enumerate(names):
        rest = np.arange(i + 1, np.searchsorted(sizes, sizes[i] / 0.8 + 1))
        apart = np.abs(counts[rest] - counts[i]).sum(axis=1) + sizes[rest] - sizes[i]  # twice a lower bound
        met += [bool(keys[i] & keys[j]) and near(i, j) for j in rest[apart <= 0.4 * sizes[rest] + 1e-9].tolist() if ld.similar(a, names[j], 0.8)]
    assert len(met) > 30 and np.mean(met) >= 0.9


@pytest.mark.parametrize("change,least", [("letter", 0.95), ("word", 0.9)])
def test_recall_of_one_change(spark, sf, change, least):
    """Lines of 32 to 400 characters in which a letter or a word has changed."""
    random.seed(6)
    lines = [w for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for x in (r.text or "").split("\n") if 32 <= len(w := ld.words_of(x.lower().encode())) <= 400]
    vocabulary, met = [w for x in lines for w in x.split()], []
    for line in random.sample(lines, 300):
        words = line.split()
        at = random.randrange(len(words))
        i = random.randrange(len(words[at]))
        words[at] = words[at][:i] + "q" + words[at][i + 1 :] if change == "letter" else random.choice(vocabulary)
        if ld.similar(line, " ".join(words), 0.8):
            both = [line, " ".join(words)]
            (a, b), (fps, tells) = keys_of(both), ld.simhashes(both)
            met.append(line == both[1] or bool(a & b) and (not tells.all() or int(fps[0] ^ fps[1]).bit_count() <= ld.RADIUS))
    assert len(met) > 250 and np.mean(met) >= least


def test_unspaced_text_takes_part():
    random.seed(8)
    signs = [chr(0x4E00 + i) for i in range(2_000)]
    met = []
    for _ in range(60):
        line = random.choices(signs, k=60)
        other = list(line)
        other[random.randrange(60)] = "語"
        a, b = keys_of(["".join(line), "".join(other)])
        met.append(bool(a & b))
    assert np.mean(met) >= 0.9


@pytest.mark.parametrize("joined,tile", [(12, 4096), (1, 4096), (1, 3), (3, 4096)])
def test_odd_rows_and_crowds(spark, joined, tile):
    random.seed(7)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    base = random.sample(words, 120)
    many = []
    for _ in range(14):
        w = list(base)
        w[random.randrange(120)] = random.choice(words)
        many.append(" ".join(w))
    # Equal words in another order have the same blocks and are still not alike.
    for _ in range(6):
        many.append(" ".join(random.sample(base, 120)))
    rows = [(i, f"Header line number {i} is here\n{t}\nshort one\n2023 14 88 {i}\n") for i, t in enumerate(many)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "short one"), (54, "A b c d e!\na, b, c, d; e\n---\n***\n---"), (54, "x"), (None, "a b c d e"), (55, "z " * 30_000), (56, "z " * 30_000)]
    rows += [(57, "same row here it is"), (57, "same row here it is"), (58, "2023 14 88 1207 33\n1998 52 10 4461 90"), (59, "one line after another\n" * 60_000)]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, line int, key string")
    assert sorted(map(tuple, ld.line_dedup(docs, joined=joined, tile=tile).collect()), key=str) == brute(rows)
    assert ld.line_dedup(docs.limit(0)).count() == 0
