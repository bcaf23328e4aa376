"""Connected components by alternating stars (Kiveris et al., "Connected components in MapReduce and beyond")."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.shared import shared_dir

#: Cuts a table's lineage; returns the reread table.
Cut = Callable[[DataFrame], DataFrame]


def checkpointed(df: DataFrame) -> DataFrame:
    """Through the session's own checkpoint folder; one of our own only where none is set and all run on this machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def connected_components(edges: DataFrame, cut: Cut = checkpointed, max_rounds: int = 60) -> DataFrame:
    """edges: a, b (longs, any direction); node and its component's least node, for each node of an edge between two nodes.

    A node's neighbours are linked to the least of them, first the greater ones, then the lesser; when nothing
    changes, every component is a star.  Each step is an aggregation and a join, which can be split where a
    node has very many neighbours.
    """
    stars = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        stars = cut(small)
        now = tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    roots = stars.select(F.col("v").alias("u"), "v").distinct()
    return stars.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
