"""Connected components of an edge table, without leaving it: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import drop, materialize


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()[0:2]


def _star(edges: DataFrame, both: DataFrame, small: bool) -> DataFrame:
    """Every edge's far end is tied to the smallest node around its near end."""
    near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) if small else both
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = near.join(least, "u")
    out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")) if small else tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node on an edge, root being the smallest node of its component.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of
    the longest path. Nulls and loops are ignored; repeated edges are allowed.
    """
    now = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while (found := _mark(now)) != mark:
        mark, before = found, now
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_star(now, both, small=False), "large-star")
        now = materialize(_star(large, large, small=True), "small-star")
        drop(before, large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
