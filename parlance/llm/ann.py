"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Rows are dealt to shards by a hash of their id, about ``SHARD_ROWS`` to a shard and at most
``SHARD_BYTES`` of vectors, so one task holds one shard whatever the input; a small table gives
every core a shard, of ``LEAST_ROWS`` at least. A shard's equal vectors become one node with its
list of ids. The graph is hierarchical: every level holds the first nodes of a random order, each
with a fixed number of neighbour slots in one flat array. Nodes are inserted in batches: the graph
so far is searched for a whole batch in lockstep, candidates are thinned by the diversity rule, and
links run both ways. An index is one row of binary arrays per shard. A shard's row reaches a task
once and the blocks of queries stream past it; the shards' best are merged.

For inner products the vectors of a shard get one more coordinate that makes their norms equal, so
that the graph is built by distance and searched by inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import materialize

SHARD_ROWS, SHARD_BYTES, LEAST_ROWS = 131_072, 64 << 20, 16_384
BLOCK_QUERIES, BLOCKS_PER_TASK, LINKS, EF_BUILD, EF_SEARCH = 512, 64, 20, 96, 128


def beam(adj: np.ndarray, x: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 2, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` best nodes found for every row of ``q``, best first (-1: none), searching all rows in lockstep.

    ``tally`` is told how many nodes were scored.
    """
    nq, rows = len(q), np.arange(len(q))[:, None]
    ids = np.full((nq, ef), -1, np.int32)
    score = np.full((nq, ef), -np.inf, np.float32)
    done = np.ones((nq, ef), bool)
    seen = np.zeros((nq, len(adj) + 1), bool)  # the last column stands for -1
    seen[:, -1] = True
    ids[:, 0], score[:, 0], done[:, 0] = entry, np.einsum("qd,qd->q", q, x[entry]), False
    seen[rows[:, 0], entry] = True
    alive = np.arange(nq)
    while len(alive):
        open_ = ~done[alive]
        pick = open_ & (np.cumsum(open_, 1) <= wide)
        alive = alive[pick.any(1)]
        if not len(alive):
            break
        pick = pick[pick.any(1)]
        at = np.argsort(~pick, 1, kind="stable")[:, :wide]
        chosen = np.where(np.take_along_axis(pick, at, 1), np.take_along_axis(ids[alive], at, 1), -1)
        done[alive] |= pick
        near = np.where(chosen[:, :, None] >= 0, adj[chosen], -1).reshape(len(alive), -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[alive[:, None], near]] = -1
        seen[alive[:, None], near] = True
        new = np.einsum("qd,qkd->qk", q[alive], x[near])
        new[near < 0] = -np.inf
        if tally is not None:
            tally.append(int((near >= 0).sum()))
        all_score = np.concatenate([score[alive], new], 1)
        order = np.argsort(-all_score, 1, kind="stable")[:, :ef]
        score[alive] = np.take_along_axis(all_score, order, 1)
        ids[alive] = np.take_along_axis(np.concatenate([ids[alive], near], 1), order, 1)
        done[alive] = np.take_along_axis(np.concatenate([done[alive], near < 0], 1), order, 1)
    return ids, score


def diverse(x: np.ndarray, cand: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, those nearer to the row than to any kept one; free slots go to the best of the rest."""
    order = np.argsort(-score, 1, kind="stable")
    cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
    v = x[cand]
    between = np.einsum("bcd,bed->bce", v, v)
    keep = np.zeros(cand.shape, bool)
    for c in range(cand.shape[1]):
        hidden = ((between[:, c, :] > score[:, c, None]) & keep).any(1)
        keep[:, c] = ~hidden & (cand[:, c] >= 0) & (keep.sum(1) < most)
    rank = np.argsort(np.where(cand < 0, 2, np.where(keep, 0, 1)), 1, kind="stable")[:, :most]
    out = np.take_along_axis(cand, rank, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def link(adj: np.ndarray, x: np.ndarray, new: np.ndarray) -> None:
    """Adds the links back from the neighbours of ``new`` nodes, thinning lists that overflow."""
    src = np.repeat(new, adj.shape[1])
    dst = adj[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.lexsort((-np.einsum("ed,ed->e", x[src], x[dst]), dst))
    src, dst = src[order], dst[order]
    to, first, n = np.unique(dst, return_index=True, return_counts=True)
    extra = np.full((len(to), min(int(n.max()), 2 * adj.shape[1])), -1, np.int32)
    k = np.arange(len(dst)) - np.repeat(first, n)
    ok = k < extra.shape[1]
    extra[np.repeat(np.arange(len(to)), n)[ok], k[ok]] = src[ok]
    cand = np.concatenate([adj[to], extra], 1)
    again = np.sort(cand, 1)
    if (again[:, 1:] == again[:, :-1]).any():  # links that both ends chose
        order = np.argsort(cand, 1, kind="stable")
        twice = np.zeros(cand.shape, bool)
        np.put_along_axis(twice, order[:, 1:], again[:, 1:] == again[:, :-1], 1)
        cand[twice] = -1
    score = np.einsum("bd,bcd->bc", x[to], x[cand])
    score[cand < 0] = -np.inf
    for lo in range(0, len(to), 1024):
        adj[to[lo : lo + 1024]] = diverse(x, cand[lo : lo + 1024], score[lo : lo + 1024], adj.shape[1])


def build(x: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 7) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the nodes, and for each level from 0 the neighbours of its nodes (the first of that order)."""
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(rng.random(n)) / np.log(links)).astype(int)
    order = np.argsort(-level, kind="stable")
    x, level = x[order], level[order]
    levels: list[np.ndarray] = []
    for depth in range(int(level[0]), -1, -1):
        size = int((level >= depth).sum())
        adj = np.full((size, links * (2 if depth == 0 else 1)), -1, np.int32)
        done = 0
        while done < size:
            until = min(size, max(64, done + min(done, 512)))
            new = np.arange(done, until)
            inside = x[new] @ x[new].T
            np.fill_diagonal(inside, -np.inf)
            k = min(ef, len(new) - 1)
            own = np.argpartition(-inside, k - 1, 1)[:, :k] if k > 0 else np.zeros((len(new), 0), int)
            cand, score = new[own].astype(np.int32), np.take_along_axis(inside, own, 1)
            if done:
                got, s = beam(adj[:done], x[:done], x[new], np.minimum(descend(levels, x, x[new]), done - 1), ef)
                cand, score = np.concatenate([cand, got], 1), np.concatenate([score, s], 1)
            if cand.shape[1]:
                adj[new] = diverse(x, cand, score, adj.shape[1])
                link(adj, x, new)
            done = until
        levels.insert(0, adj)
    return order, levels


def descend(upper: list[np.ndarray], x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The node from which to enter the level below ``upper`` (its levels from the lowest)."""
    entry = np.zeros(len(q), np.int64)
    for adj in reversed(upper):
        entry = np.maximum(beam(adj, x, q, entry, 4, 1)[0][:, 0], 0)
    return entry


def augmented(v: np.ndarray) -> np.ndarray:
    """Rows in proportion, none longer than 1, with one more coordinate that makes them all of the largest row's norm."""
    v = v / np.abs(v).max()  # whatever the numbers are, squares and single precision hold them
    norm = (v * v).sum(1)
    return np.concatenate([v, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], 1).astype(np.float32)


_INDEX = "shard int, dim int, vectors binary, member_offs binary, members binary, level_sizes array<int>, neighbours array<binary>"


def build_index(rows: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """One row per shard: vectors (doubles), the ids of each, and the flat neighbour arrays of each level."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    sizes = {}
    for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect():
        most = shard_rows or max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * r["dim"])))
        sizes[r["dim"]] = max(-(-r["n"] // most), 1 if shard_rows else min(cores, r["n"] // LEAST_ROWS))
    n = F.lit(1)
    for dim, s in sizes.items():
        n = F.when(F.size("v") == dim, F.lit(s)).otherwise(n)

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        v = flat.reshape(len(ids), -1)
        v = np.where(v == 0, 0.0, v)  # one zero
        by = np.lexsort((ids,))
        ids, v = ids[by], v[by]
        _, first, own = np.unique(np.ascontiguousarray(v).view([("", f"V{v.dtype.itemsize * v.shape[1]}")]).ravel(), return_index=True, return_inverse=True)
        own = own.ravel()
        order, levels = build(augmented(v[first]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        node = rank[own]
        members = ids[np.argsort(node, kind="stable")].astype(np.int64)
        offs = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(order)))]).astype(np.int64)
        return pa.table(
            {
                "shard": pa.array([key[1].as_py()], pa.int32()),
                "dim": pa.array([key[0].as_py()], pa.int32()),
                "vectors": pa.array([v[first][order].tobytes()], pa.binary()),
                "member_offs": pa.array([offs.tobytes()], pa.binary()),
                "members": pa.array([members.tobytes()], pa.binary()),
                "level_sizes": pa.array([[len(a) for a in levels]], pa.list_(pa.int32())),
                "neighbours": pa.array([[a.tobytes() for a in levels]], pa.list_(pa.binary())),
            }
        )

    dealt = rows.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("id"), n).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(shard, _INDEX)


def search_shard(index: dict, q: np.ndarray, ids: np.ndarray, k: int, ef: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query's row, ids, scores) of the best ``k`` of a shard for each query; equal vectors by their smallest ids."""
    x, levels, offs, members = index["x"], index["levels"], index["offs"], index["members"]
    largest = np.abs(q).max(1, keepdims=True)
    flat = np.concatenate([q / largest, np.zeros((len(q), 1))], 1).astype(np.float32)
    out = []
    for lo in range(0, len(q), 128):
        part = flat[lo : lo + 128]
        got, _ = beam(levels[0], index["graph"], part, descend(levels[1:], index["graph"], part), max(ef, k + 2))
        for i, row in enumerate(got):
            nodes = row[row >= 0].astype(np.int64)
            exact = (x[nodes] * q[lo + i]).sum(1)  # row by row, so equal rows have equal products
            best = np.argsort(-exact, kind="stable")[: k + 1]
            cut = exact >= exact[best[-1]]
            nodes, exact = nodes[cut], exact[cut]
            n = np.minimum(offs[nodes + 1] - offs[nodes], k + 1)
            at = np.repeat(offs[nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, score = members[at], np.repeat(exact, n)
            ok = who != ids[lo + i]
            who, score = who[ok], score[ok]
            top = np.lexsort((who, -score))[:k]
            out.append((np.full(len(top), lo + i), who[top], score[top]))
    return out


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (doubles) of the rows that take part: no null, zero, empty or non-finite vectors."""
    v = F.transform(F.col(vector), lambda e: e.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda e: e != 0))


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard_rows: int | None = None, ef: int = EF_SEARCH) -> DataFrame:
    """Each query's ``k`` best rows of ``df`` by inner product: query_id, rank, vec_id, score.

    Rows with the query's own id are no candidates. Vectors that are null, empty, zero or hold null
    or non-finite components take no part, nor do null ids; vectors of different lengths do not meet.
    Ties go to the smaller id; equal vectors are all indexed and each can be returned; fewer than
    ``k`` candidates give fewer rows; an empty table gives none. Components of any finite size are
    found alike; a score that doubles cannot hold is infinite. Other columns are not read.
    """
    index = materialize(build_index(usable(df, key, vector), shard_rows), "ann-index")
    asked = usable(queries, key, vector)
    n = asked.count()
    blocks = max(1, -(-n // BLOCK_QUERIES))
    groups = -(-blocks // BLOCKS_PER_TASK)
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([table.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()), "q": pa.array([flat.tobytes()], pa.binary())})

    grouped = asked.withColumn("dim", F.size("v")).withColumn("block", block).groupBy("dim", "block").applyInArrow(gather, "dim int, block int, ids binary, q binary")
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    asks = grouped.join(shards, "dim").select("dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), (F.col("block") % groups).alias("group"), F.lit(1).alias("ask"), "ids", "q")
    held = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("ask", F.lit(0))
    both = held.unionByName(asks, allowMissingColumns=True)
    both = both.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dim", "shard", "group").sortWithinPartitions("dim", "shard", "group", "ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {}
        for b in batches:
            column = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                get = lambda c: column[c][r].as_py()  # noqa: B023, E731
                if get("ask") == 0:  # a shard; the queries for it follow
                    x = np.frombuffer(get("vectors"), np.float64).reshape(-1, get("dim"))
                    levels = [np.frombuffer(a, np.int32).reshape(s, -1) for a, s in zip(get("neighbours"), get("level_sizes"), strict=True)]
                    at = {"x": x, "graph": augmented(x), "levels": levels, "offs": np.frombuffer(get("member_offs"), np.int64), "members": np.frombuffer(get("members"), np.int64)}
                    continue
                ids = np.frombuffer(get("ids"), np.int64)
                got = search_shard(at, np.frombuffer(get("q"), np.float64).reshape(len(ids), -1), ids, k, ef)
                row, who, score = (np.concatenate(c) for c in zip(*got, strict=True))
                yield pa.record_batch([pa.array(ids[row]), pa.array(who), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, among all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.filter("vec_id % 20 = 0"))
