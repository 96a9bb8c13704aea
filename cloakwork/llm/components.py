"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node it can reach.

    ``edges``: two columns u, v of one orderable type; direction, repeats and loops don't matter,
    rows with a null are ignored. Each round is a few groupings and joins whose result goes to the
    shared folder, so neither lineage nor driver grows; a hub's edges may be split by adaptive
    execution because no step gathers a node's neighbours. The rounds are about logarithmic in
    the number of nodes.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(now, "edges")
    before, after = None, _state(now)
    while after != before and after[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(now)
        now, before, after = new, after, _state(new)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
