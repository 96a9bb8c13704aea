"""Packing: ids by the tokenizers library, gapless sequences, as few as can be."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cloakwork.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(docs, rows, capacity=2048):
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc_id, many in texts.items():
        for text in many:
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
            first = (len(ids) - 1) % capacity + 1
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want.append((doc_id, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(w[3] for w in want) // capacity)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    used, least = check(docs, packing.pack(docs, PATH).collect())
    assert used <= least + 2


def test_odd_texts(spark):
    texts = [None, "", " ", "  a  b", "a\n b", " a", "a ", "a b\tc d  e", "x<|endoftext|>y z", "it's we'll ", "é ü　ñ 漢字 かな", "1 22 333-4 $%& --", "\x1c a \x1d", "word " * 9000, "a" * 3000 + " b", "tie tie", "tie tie"]
    docs = spark.createDataFrame([(i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, bucket string, length long")
    check(docs, packing.pack(docs, PATH).collect())
    assert packing.pack(docs.limit(0), PATH).count() == 0
    with_ids = packing.pack(docs, PATH, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in with_ids)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_piece_once(seed):
    import random

    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100])
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
    fill, ranks = defaultdict(list), defaultdict(list)
    for n, low, high, sequence, each, at in packing.plan(counts, capacity):
        for rank in range(low, high):
            ranks[n].append(rank)
            fill[sequence + (rank - low) // each].append((at + (rank - low) % each * n, n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for parts in fill.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= capacity
    assert len(fill) <= -(-sum(n * c for n, c in counts.items()) // capacity) * 1.25 + sum(c for n, c in counts.items() if 2 * n > capacity)


def test_encoder_gives_the_ids_of_the_tokenizers_library():
    encoder = packing.Encoder(PATH)
    rng = random.Random(1)
    symbols = " \n\t 　ab'stre.,;0９²éßñ漢字😀́\x00\x1c\x85"
    texts = ["".join(rng.choice(symbols) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|> b", " " * 50_000 + "x", "ab " * 20_000, "x" * 100_000]
    for text in texts:
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, "<u4").tobytes()
