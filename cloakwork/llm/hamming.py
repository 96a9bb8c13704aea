"""Which 64-bit fingerprints are linked by at most ``radius`` differing bits: pigeonhole joins.

The 64 bits are cut into blocks. Two fingerprints that differ in at most ``radius`` bits agree on
at least ``blocks - radius`` whole blocks, so they meet in one of the buckets that are keyed by a
choice of that many blocks, and are then compared there. The buckets of a crowd of near
copies are large; what is emitted of a bucket is always enough to connect what is linked in it,
and never all its pairs:

* up to ``JOINED`` fingerprints: a join on the bucket, with the distance in the join's condition;
* up to ``GATHERED``: the edges of a spanning forest, found in one task with bounded memory;
* beyond: no comparison at all. Between two linked fingerprints there is a point half-way, so each
  is tied to the least fingerprint that is half the radius away from a point around it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOINED, GATHERED = 32, 16_384


def block_count(fingerprints: int, radius: int) -> int:
    """Blocks so many that a bucket of unrelated fingerprints has about four at most."""
    blocks = radius + 2
    while blocks < radius + 6 and fingerprints / 2 ** (64 * (blocks - radius) // blocks) > 4:
        blocks += 1
    return blocks


def bucket_keys(column: str, blocks: int, radius: int) -> list:
    """The keys of a fingerprint, one for each choice of blocks - radius blocks."""
    at = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for b in chosen:
            width = at[b + 1] - at[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(column, at[b]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return keys


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among int64 values, as indexes; trees grow from the first values."""
    bits = np.ascontiguousarray(values, np.int64).view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    left, ends = np.arange(len(bits)), ([], [])
    frontier = left[:0]
    while len(left):
        if not len(frontier):
            frontier, left = left[:1], left[1:]
        here, frontier = frontier[:256], frontier[256:]
        near = np.bitwise_count(bits[here][:, None] ^ bits[left][None, :]) <= radius
        reached = near.any(axis=0)
        if reached.any():
            ends[0].append(left[reached])
            ends[1].append(here[near[:, reached].argmax(axis=0)])
            frontier, left = np.concatenate([frontier, left[reached]]), left[~reached]
    return tuple(np.concatenate(e) if e else np.zeros(0, np.int64) for e in ends)


def links(fps: DataFrame, radius: int, joined: int = JOINED, gathered: int = GATHERED) -> DataFrame:
    """(u, v): edges that connect what is linked among the distinct ``fp`` values of ``fps``."""
    blocks = block_count(fps.count(), radius)
    keyed = fps.select("fp", F.explode(F.array(*bucket_keys("fp", blocks, radius))).alias("key"))
    sizes = keyed.groupBy("key").count().where("count > 1")
    keyed = keyed.join(sizes, "key")

    few = keyed.where(F.col("count") <= joined)
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)).select("u", "v")

    def compare(bucket: pd.DataFrame) -> pd.DataFrame:
        values = bucket["fp"].to_numpy()
        u, v = forest(values, radius)
        return pd.DataFrame({"u": values[u], "v": values[v]})

    some = keyed.where((F.col("count") > joined) & (F.col("count") <= gathered)).select("key", "fp")
    trees = some.groupBy("key").applyInPandas(compare, "u long, v long")

    def around(distance: int) -> DataFrame:
        masks = [sum(1 << b for b in c) for r in range(distance + 1) for c in combinations(range(64), r)]
        masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
        return crowd.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))

    crowd = keyed.where(F.col("count") > gathered).select("fp").distinct()
    centres = around(radius // 2).groupBy("point").agg(F.min("fp").alias("v"))
    stars = around(radius - radius // 2).join(centres, "point").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.unionAll(trees).unionAll(stars)
