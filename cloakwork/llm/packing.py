"""Best-fit packing of tokenised documents into sequences of fixed length.

Executors tokenise and count; how often each length occurs is all that the plan needs, so the
driver sees at most ``capacity`` counts, however many documents there are. The plan speaks of groups of
equal sequences: pieces above a third of the capacity are paired greedily, at most two to a sequence,
and smaller ones go into the tightest gap, longest first. Executors then rank the pieces of each
length and look up where that rank goes.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_chunks

#: How a byte-level vocabulary cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The bytes that such a vocabulary writes as the character of the same number; the others follow from 256.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers.

    The vocabulary file is one of the tokenizers library. Its ids number its merges in their order, so that tiktoken,
    which merges by rank and is several times as fast, gives the same ids; a file of another kind is
    refused. Special tokens are known in texts, as they are there.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocabulary, cutter = model["model"]["vocab"], model["pre_tokenizer"] or {}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        merged = [vocabulary["".join(m)] for m in pairs]
        if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or model["normalizer"] or merged != sorted(merged):
            raise ValueError(f"{path} is no byte-level vocabulary whose ids follow its merges")
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        rest = (b for b in range(256) if b not in PLAIN)
        byte_of = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(map(byte_of.get, token)): i for token, i in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:  # a run of white space too long for its regular expression
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}  # one for each Python worker, not for each task


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (bytes) of every piece."""

    def run(batches):
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        end = end_id.to_bytes(4, "little")
        for batch in text_chunks(batches, 1, 1_000_000):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                encoded = encoder.encode(text.as_py() or "") + end
                n = len(encoded) // 4
                at = 0
                for k, to in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                    part = encoded[4 * at : 4 * to]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(part))
                    ids.append(part if with_ids else None)
                    at = to
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, end rank, first sequence, pieces a
    sequence, offset). Ranks count the pieces of a length from 0."""
    large = sorted(n for n in counts if 3 * n > capacity)
    left = {n: counts[n] for n in large}
    gaps: list[int] = []  # sorted, each once
    bins: dict[int, list[tuple[int, tuple]]] = {}  # gap: groups of so many equal sequences and their contents

    def add(gap: int, many: int, contents: tuple) -> None:
        if many:
            if gap not in bins:
                insort(gaps, gap)
            bins.setdefault(gap, []).append((many, contents))

    while large:
        a = large[-1]
        fits = [n for n in large if a + n <= capacity and left[n] > (n == a)]
        b = fits[-1] if fits else 0
        many = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        add(capacity - a - b, many, ((a, 1), (b, 1)) if b not in (0, a) else ((a, 1 + (a == b)),))
        left[a] -= many * (1 + (a == b))
        if b and b != a:
            left[b] -= many
        large = [n for n in large if left[n]]

    for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        todo = counts[n]
        while todo:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                add(capacity, -(-todo // (capacity // n)), ())
                continue
            gap = gaps[at]
            many, contents = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[at]
            each = gap // n
            full = min(many, todo // each)
            add(gap - full // max(full, 1) * each * n, full, (*contents, (n, each)))
            todo -= full * each
            rest = todo if full < many and todo < each else 0
            add(gap - rest * n, 1 if rest else 0, (*contents, (n, rest)))
            add(gap, many - full - bool(rest), contents)
            todo -= rest

    slots, ranks, sequence = [], dict.fromkeys(counts, 0), 0
    for groups in bins.values():
        for many, contents in groups:
            offset = 0
            for n, each in contents:
                slots.append((n, ranks[n], ranks[n] + many * each, sequence, each, offset))
                ranks[n] += many * each
                offset += n * each
            sequence += many
    return slots


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its token ids and then ``end_id``; a null or empty text is that one id. Only
    documents longer than ``capacity`` are cut, into pieces of ``capacity`` ids, the first of which takes
    what is left over. The pieces of a sequence fill it from 0 without gaps. Repeated rows are packed as
    often as they come in; an empty table gives no rows; other columns are ignored. ``tokenizer`` is the
    path of a byte-level BPE vocabulary for the tokenizers library on every executor.
    """
    spark = docs.sparkSession
    pieces = materialise(tokenised_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    # A length that very many pieces share is ranked in buckets; a bucket's base is what the others before it hold.
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    held = materialise(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = spark.createDataFrame(plan(counts, capacity) or [], "of long, low long, high long, sequence long, each long, at long")

    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    # The slots' number depends on the capacity alone, not on the documents.
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] * with_ids),
    )
