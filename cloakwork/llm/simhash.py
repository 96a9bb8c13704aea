"""Near duplicates by SimHash: fingerprints, pigeonhole joins on blocks, Hamming distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components
from .hamming import GATHERED, JOINED, links

SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the shingles' XXH64 as a signed 64-bit integer; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: lower() changes A-Z only, split() takes 09-0D and 20
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())], ["doc_id", "fp"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def simhash_dedup(docs: DataFrame, shingle: int = 4, radius: int = 4, joined: int = JOINED, gathered: int = GATHERED) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked if their fingerprints differ in at most ``radius`` bits; ``component_id``
    is the least doc_id that a document reaches over links, itself included. A fingerprint bit is 1
    if it is set in over half of the hashes of the word ``shingle``s (words are separated by ASCII
    white space, A-Z lower-cased, repeats count). A text with fewer words has one shingle, all of
    it; a null text or one without words has fingerprint zero and is linked like any other.
    Equal fingerprints are folded before any join. Repeated rows appear as often as they come in;
    null ids are never a component_id unless all of a component's ids are null. An empty table
    gives no rows; other columns of ``docs`` are ignored.
    """
    marked = materialise(fingerprints(docs, shingle), "fingerprints")
    firsts = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "folded")
    roots = connected_components(links(firsts.select("fp"), radius, joined, gathered))
    linked = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = linked.join(least, "root").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
