"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a row draws ``-ln(u) / weight`` for every child of the node it is in, u being a hash
of its key and the child's path, and goes to the child with the smallest draw. A child's draws
depend on nothing but the key, its path and its weight, so a change of weights moves rows only
between the subtree whose weight changed and its siblings. A new shard becomes a region of its
own: no weight below another region changes, so rows move only into the new shard.

Everything is a column expression: one map over the rows, with no shuffle but for the slots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import gapless_rank, materialize


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def balanced_tree(n_shards: int, per_rack: int = 2, racks: int = 2) -> tuple[Leaf, ...]:
    """``n_shards`` equal shards, ``per_rack`` to a rack and ``racks`` racks to a region."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    per_region = per_rack * racks
    return tuple(Leaf(s, s // per_region, s % per_region // per_rack) for s in range(n_shards))


def grow(tree: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one shard more, in a new region: rows move only into it."""
    return (*tree, Leaf(max(x.shard for x in tree) + 1, max(x.region for x in tree) + 1, 0, weight))


def _draw(key: Column, path: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _pick(key: Column, children: dict[int, float], path: str) -> Column:
    """The id of the child with the smallest draw; ties go to the smaller id."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct(_draw(key, f"{path}/{c}", w).alias("d"), F.lit(c).alias("c")) for c, w in sorted(children.items()) if w > 0]
    return F.least(*draws)["c"] if len(draws) > 1 else draws[0]["c"]


def place(df: DataFrame, tree: tuple[Leaf, ...], key: Column, out: str) -> DataFrame:
    """Adds ``out``, the shard of each row. A null key is a key of its own."""
    if not tree or all(x.weight <= 0 for x in tree):
        raise ValueError("the tree needs a shard with a weight above 0")
    k = F.coalesce(key.cast("string"), F.lit("\x00null"))
    live = [x for x in tree if x.weight > 0]

    def total(level: list[Leaf], of) -> dict[int, float]:
        sums: dict[int, float] = {}
        for x in level:
            sums[of(x)] = sums.get(of(x), 0.0) + x.weight
        return sums

    df = df.withColumn("_region", _pick(k, total(live, lambda x: x.region), "r"))
    rack = shard = None
    for r in sorted({x.region for x in live}):
        inside = [x for x in live if x.region == r]
        pick = _pick(k, total(inside, lambda x: x.rack), f"r/{r}")
        rack = F.when(F.col("_region") == r, pick) if rack is None else rack.when(F.col("_region") == r, pick)
    df = df.withColumn("_rack", rack)
    for r, c in sorted({(x.region, x.rack) for x in live}):
        pick = _pick(k, {x.shard: x.weight for x in live if (x.region, x.rack) == (r, c)}, f"r/{r}/{c}")
        here = (F.col("_region") == r) & (F.col("_rack") == c)
        shard = F.when(here, pick) if shard is None else shard.when(here, pick)
    return df.withColumn(out, shard.cast("int")).drop("_region", "_rack")


def assign_shards(df: DataFrame, tree: tuple[Leaf, ...], key: str = "doc_id", text: str = "text", buckets: int = 4096) -> DataFrame:
    """One row per row of ``df``: key, size, text_crc32, law, shard, slot, grown_shard.

    Law ``key``: the key and the tree decide the shard, so equal texts under different keys may lie
    in different shards. Null texts count as empty (size 1, crc 0); null keys are a key of their own;
    repeated rows each get a slot; other columns are not read. An empty table gives an empty table.
    Slots follow (hash bucket of the key, key, crc), so no task holds a shard; rows equal in all of
    these are interchangeable.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = place(rows, tree, F.col("doc_id"), "shard")
    rows = place(rows, grow(tree), F.col("doc_id"), "grown_shard")
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    rows = gapless_rank(materialize(rows, "shards"), ["shard"], "_b", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 of two regions of two racks of two."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), balanced_tree(8))
