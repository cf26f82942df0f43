"""Near-duplicate classes by DartMinHash and banded joining.

A text is a weighted set of shingles (five words each). Every shingle owns a region as wide as its
weight and endless in rank, into which hashed darts are thrown: their ranks are a Poisson process
and each dart carries a coordinate and, in the top layer of a fractional weight, a height. Only
the darts up to a rank at which every coordinate has been hit are thrown, about
``t * (log t + 3)`` of them however long the text is; the earliest dart of each coordinate is the
signature. Two texts agree in a coordinate with their weighted Jaccard similarity as the odds. A
shingle's weight is 1, or, if asked, the number of times that it stands in the text.

Equal texts are one node. Nodes with an equal band are joined to the smallest of them and the
pairs' exact similarity is taken from the whole texts; in buckets that then hold nodes of several
components every pair across components is compared, block against block, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import U, between, chunks, drop, materialize, mix, prefix, ragged, release, small_batches, utf8, word_hashes, words
from parlance.llm.components import components

SHINGLE, THRESHOLD, BANDS, ROWS, BLOCK, BLOCK_BYTES = 5, 0.8, 25, 5, 256, 8_000_000
_ONE = 1 << 32  # ranks are whole numbers of 2**-32, so that machines agree on them


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles and the texts' offsets; a shorter text is one shingle, a wordless one none."""
    raw, offs = utf8(texts)
    starts, ends, rows = words(raw, offs)
    sums = prefix(word_hashes(raw, starts, ends))
    n = np.diff(rows)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.repeat(rows[:-1], count) + ragged(count)
    last = first + np.repeat(np.minimum(n, size), count)
    return between(sums, first, last), np.concatenate([[0], np.cumsum(count)])


def distinct(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's different hashes in order, their counts, and the rows' offsets."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(row[at], np.arange(len(offs)))


def elements(texts: pa.Array, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """The set of elements of each text that similarity compares: its shingles, or each occurrence of them."""
    h, n, offs = distinct(*shingles(texts))
    if not counted:
        return h, offs
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    with np.errstate(over="ignore"):
        h = mix(np.repeat(h, n) + ragged(n).astype(U) * U(0xA24BAED4963EE407))
    h, _, offs = distinct(h, np.searchsorted(np.repeat(row, n), np.arange(len(offs))))
    return h, offs


def dart_signatures(h: np.ndarray, weight: np.ndarray, offs: np.ndarray, t: int) -> np.ndarray:
    """The rank of the earliest dart of each of ``t`` coordinates, for each row of weighted elements.

    Rows without weight keep the largest rank everywhere. Elements are hashes; weights any numbers
    of at least 0.
    """
    n_rows = len(offs) - 1
    sig = np.full(n_rows * t, np.iinfo(np.int64).max)
    layers = np.ceil(weight).astype(np.int64)  # unit layers of the region; the top one may be partial
    row = np.repeat(np.repeat(np.arange(n_rows), np.diff(offs)), layers)
    level = ragged(layers)
    height = np.repeat(weight, layers) - level
    with np.errstate(over="ignore"):
        key = mix(np.repeat(h, layers) ^ (level.astype(U) * U(0xA24BAED4963EE407)))
    mass = np.bincount(row, np.minimum(height, 1.0), minlength=n_rows)
    whole = height >= 1
    reach = np.zeros(n_rows)
    reach[mass > 0] = t * (np.log(t) + 3) / mass[mass > 0]
    live, at, count = np.arange(len(row)), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    open_rows = mass > 0
    while open_rows.any():
        limit = (reach * _ONE).astype(np.int64)
        turn = live[open_rows[row[live]]]
        while len(turn):
            r = row[turn]
            room = limit[r] - at[turn]
            many = np.where(room > 4 * _ONE, 16, 1)
            for k in (1, 16):
                e = turn[many == k]
                if not len(e):
                    continue
                with np.errstate(over="ignore"):
                    step = count[e, None].astype(U) + np.arange(k, dtype=U)[None]
                    d = mix(key[e, None] + step * U(0x9E3779B97F4A7C15))
                gap = (-np.log(((d >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)) * _ONE).astype(np.int64) + 1
                rank = at[e, None] + np.cumsum(gap, 1)
                inside = rank <= limit[row[e]][:, None]
                thrown = inside.copy()
                part = ~whole[e]
                if part.any():
                    thrown[part] &= (mix(d[part] ^ U(0x5851F42D4C957F2D)) >> U(11)).astype(np.float64) / float(1 << 53) < height[e[part], None]
                coord = ((d & U(0x7FF)) * U(t) >> U(11)).astype(np.int64)
                np.minimum.at(sig, (row[e][:, None] * t + coord)[thrown], rank[thrown])
                used = inside.sum(1)
                count[e] += used
                moved = used > 0
                at[e[moved]] = rank[moved, used[moved] - 1]
                many[many == k] = np.where(used == k, -1, 0)
            turn = turn[many == -1]
        missing = (sig.reshape(n_rows, t) == np.iinfo(np.int64).max).any(1) & open_rows
        open_rows = missing
        reach[missing] *= 2
    return sig.reshape(n_rows, t)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per row and band; equal where the band's coordinates are."""
    h = np.broadcast_to(np.arange(bands, dtype=U)[None] * U(0x9E3779B97F4A7C15), (len(sig), bands)).copy()
    parts = sig.reshape(len(sig), bands, rows).astype(U)
    with np.errstate(over="ignore"):
        for r in range(rows):
            h = mix((h ^ parts[:, :, r]) * U(0xD6E8FEB86659FD93) + U(r))
    return h.view(np.int64)


def jaccard(a: pa.Array, b: pa.Array, counted: bool = False) -> np.ndarray:
    """The exact similarity of the two columns' sets of shingles, or bags of them, row by row."""
    ha, oa = elements(a, counted)
    hb, ob = elements(b, counted)
    both, _, offs = (None, None, None) if not len(ha) or not len(hb) else _merge(ha, oa, hb, ob)
    na, nb = np.diff(oa), np.diff(ob)
    union = np.diff(offs) if offs is not None else na + nb
    return np.where(union > 0, (na + nb - union) / np.maximum(union, 1), 0.0)


def _merge(ha: np.ndarray, oa: np.ndarray, hb: np.ndarray, ob: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.diff(oa) + np.diff(ob)
    offs = np.concatenate([[0], np.cumsum(n)])
    h = np.empty(offs[-1], U)
    h[np.repeat(offs[:-1], np.diff(oa)) + ragged(np.diff(oa))] = ha
    h[np.repeat(offs[:-1] + np.diff(oa), np.diff(ob)) + ragged(np.diff(ob))] = hb
    return distinct(h, offs)


def node_of(text: str):
    """The id of a text: equal texts, and null and empty ones, are one node."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sketches(docs: DataFrame, key: str, text: str, bands: int, rows: int, counted: bool = False) -> DataFrame:
    """doc_id, node, bytes of text and the band keys of every row; wordless texts have no keys."""
    kind = dict(docs.dtypes)[key]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text")
            for lo, hi in chunks(utf8(column)[1], 1_000_000):
                h, offs = shingles(column.slice(lo, hi - lo))
                h, n, offs = distinct(h, offs)
                weight = n.astype(np.float64) if counted else np.ones(len(h))
                keys = band_keys(dart_signatures(h, weight, offs, bands * rows), bands, rows)
                n = np.where(np.diff(offs) > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("node").slice(lo, hi - lo), b.column("size").slice(lo, hi - lo), lists], names=["doc_id", "node", "size", "bands"])

    return docs.select(F.col(key).alias("doc_id"), node_of(text).alias("node"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, node long, size int, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, counted: bool = False) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are at least ``threshold`` alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ta, tb = b.column("ta"), b.column("tb")
            for lo, hi in chunks(utf8(ta)[1] + utf8(tb)[1], 2_000_000):
                ok = pa.array(jaccard(ta.slice(lo, hi - lo), tb.slice(lo, hi - lo), counted) >= threshold - 1e-12)
                yield pa.RecordBatch.from_arrays([b.column("a").slice(lo, hi - lo), b.column("b").slice(lo, hi - lo)], names=["a", "b"]).filter(ok)

    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicate_nodes(docs: DataFrame, sketch: DataFrame, text: str = "text", threshold: float = THRESHOLD, counted: bool = False) -> DataFrame:
    """(node, root) for every text that has a near duplicate.

    Copies are merged before anything is dealt out by node, on the map side, so a text that a third
    of all rows hold is one row from each task.
    """
    spark = docs.sparkSession
    rows = sketch.dropDuplicates(["node"]).select("node", "size", F.explode("bands").alias("band"))
    rows = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1").join(rows, "band")
    buckets = materialize(rows.select("band", "node", "size", "hub"), "buckets")
    release(spark)
    found = buckets.select("node").distinct()
    texts = docs.select(node_of(text).alias("node"), F.col(text).alias("text")).dropDuplicates(["node"]).join(found, "node", "left_semi")
    texts = materialize(texts, "texts")
    release(spark)
    pairs = materialize(buckets.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    edges = materialize(verified(pairs, texts, threshold, counted), "links")
    labels = components(edges, "a", "b")
    named = buckets.select("band", "node", "size").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = named.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    open_ = materialize(named.drop("size").join(split.filter("lo < hi").select("band", "n", "bytes"), "band"), "open-buckets")
    more = materialize(cross_links(open_, sketch, texts, threshold, counted), "links")
    if not more.isEmpty():
        labels = components(edges.unionByName(more), "a", "b")
    labels = materialize(labels, "labels")
    drop(buckets, texts, pairs, edges, open_, more)
    release(spark)
    return labels


def cross_links(named: DataFrame, sketch: DataFrame, texts: DataFrame, threshold: float, counted: bool = False) -> DataFrame:
    """Links (a, b) between different components inside the buckets of ``named`` (band, node, root, and the bucket's n and bytes).

    Every pair of nodes of one bucket but two components is compared once, in the first band that
    both share, block against block of about ``BLOCK`` nodes and ``BLOCK_BYTES`` of text (a longer
    text is a block). A task holds two blocks and returns at most one link for each two components,
    so neither pairs nor whole buckets become rows.
    """
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")
    rows = named.withColumn("_k", blocks).withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
    rows = rows.select("band", "node", "root", "_i", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_j"))
    rows = rows.select("band", "node", "root", F.col("_i").alias("own"), F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"))
    keys = sketch.select("node", "bands").dropDuplicates(["node"]).join(named.select("node").distinct(), "node", "left_semi")
    rows = rows.join(keys.join(texts, "node"), "node")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        band, i, j = (k.as_py() for k in key)
        own = table.column("own").to_numpy()
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(left) or not len(right) or (root == root[0]).all():
            return none
        h, offs = elements(table.column("text").combine_chunks(), counted)
        size = np.diff(offs)
        row = np.repeat(np.arange(len(node)), size)
        both = np.zeros((len(left), len(right)), np.float32)
        at = np.full((2, len(node)), -1)
        at[0, left], at[1, right] = np.arange(len(left)), np.arange(len(right))
        in_left, in_right = at[0, row] >= 0, at[1, row] >= 0
        shared = np.intersect1d(h[in_left], h[in_right])
        for lo in range(0, len(shared), 8192):
            part = shared[lo : lo + 8192]
            sides = []
            for side, inside in ((0, in_left), (1, in_right)):
                col = np.minimum(np.searchsorted(part, h), len(part) - 1)
                ok = inside & (part[col] == h)
                m = np.zeros((len((left, right)[side]), len(part)), np.float32)
                m[at[side, row[ok]], col[ok]] = 1
                sides.append(m)
            both += sides[0] @ sides[1].T
        union = size[left][:, None] + size[right][None] - both
        ok = (both >= (threshold - 1e-12) * union) & (root[left][:, None] != root[right][None])
        place = int(np.flatnonzero(bands[0] == band)[0])
        for b in range(place):
            ok &= bands[left, b][:, None] != bands[right, b][None]
        x, y = np.nonzero(ok)
        if not len(x):
            return none
        ends = np.sort(np.stack([root[left[x]], root[right[y]]]), 0)
        _, first = np.unique(ends, axis=1, return_index=True)
        return pa.table({"a": pa.array(node[left[x[first]]]), "b": pa.array(node[right[y[first]]])})

    return rows.groupBy("band", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, counted: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, n_texts.

    A class is a connected component of texts whose sets of five-word shingles are at least
    ``threshold`` alike (``counted``: bags, in which a shingle weighs as often as it stands there);
    class_id is its smallest doc_id, class_size its rows, n_texts its different texts. Null and
    empty texts are copies of each other; texts of under five words are one shingle; wordless texts
    are alike only when equal; texts of any length are compared whole. Repeated rows and ids each
    have a row; null ids are allowed (a class of null ids only has a null class_id). An empty table
    gives an empty table; other columns are not read. Texts of similarity 0.8 share a band with odds
    of 0.99995, more similar ones more surely.
    """
    sketch = materialize(sketches(docs, key, text, bands, rows, counted), "sketches")
    labels = near_duplicate_nodes(docs, sketch, text, threshold, counted)
    nodes = sketch.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    named = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("n_texts"))
    named = named.join(classes, "root").select("node", "class_id", "class_size", "n_texts")
    return sketch.select("doc_id", "node").join(named, "node").select("doc_id", "class_id", "class_size", "n_texts")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, counted: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, of the smallest id of each class.

    One row stays where ids or rows repeat; a null id comes after the others. The rows are joined by
    text and id together, so copies of one text do not meet in one task.
    """
    sketch = materialize(sketches(docs, key, text, bands, rows, counted), "sketches")
    labels = near_duplicate_nodes(docs, sketch, text, threshold, counted)
    nodes = sketch.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"))
    named = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min(F.struct("least", "node")).alias("m")).select(F.col("m.least.doc_id").alias("id"), F.col("m.node").alias("node"))
    rows = docs.select(node_of(text).alias("node"), F.col(key).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("d")
    same = (F.col("d.node") == F.col("f.node")) & F.col("d.id").eqNullSafe(F.col("f.id"))
    # equal id and text: any one row
    return rows.join(first.alias("f"), same).select("d.node", "d.id", "d.row").dropDuplicates(["node", "id"]).select("row.*")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
