"""What the operators of this subpackage share: tables in the shared folder, gapless ranks, byte kernels.

The kernels work on the UTF-8 bytes of whole Arrow columns at once; no loop runs over words or
bytes in Python. Hashes are 64 bits: with n different strings a run errs with odds of about
n * n / 2**65.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.sources.shared import shared_dir

# --- tables in the shared folder -----------------------------------------------------------


def materialize(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``group_rows``: rows of a row group at most. A task buffers a row group to write it and up to
    4096 rows of one to read it, so tables of large rows need it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parlance-{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.row.count.limit", str(group_rows)) if group_rows else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._parlance_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB: the JVM holds them outside its heap, and Python once more."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def drop(*tables: DataFrame) -> None:
    """Delete tables written by ``materialize`` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._parlance_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# --- ranks ------------------------------------------------------------------------------------


def gapless_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Rows of each group numbered from 0 without gaps, in the order (bucket, *order).

    ``bucket`` splits groups of any size over tasks: rows are numbered inside (group, bucket), and
    the counts of the earlier buckets, one row per (group, bucket), are added. Needs a ``df`` that
    gives the same rows each time it is read, as it is read twice.
    """
    keys = [*group, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(inside).cast("long") - 1)
    return ranked.join(starts, keys).withColumn(out, F.col("_start") + F.col("_rn")).drop("_start", "_rn")


# --- byte kernels -----------------------------------------------------------------------------

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.ones(size, U)
        step = 1
        while step < size:
            with np.errstate(over="ignore"):
                have[step : 2 * step] = have[:step] * U(pow(base, step, 1 << 64))
            step *= 2
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray, copy: bool = True) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        h = h.astype(U, copy=copy)
        h ^= h >> U(30)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(27)
        h *= U(0x94D049BB133111EB)
        h ^= h >> U(31)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base**i, from which ``between`` hashes any range."""
    out = np.zeros(len(values) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(values.astype(U) * powers(_BASE, len(values)), out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges start..end, the same wherever equal values stand."""
    with np.errstate(over="ignore"):
        h = (sums[end] - sums[start]) * powers(_INV, len(sums))[start]
        h += (end - start).astype(U) * U(0xD6E8FEB86659FD93)
    return mix(h, copy=False)


def rolling(sums: np.ndarray, size: int) -> np.ndarray:
    """``between`` for every range of ``size`` values, without arrays of places."""
    n = max(0, len(sums) - size)
    with np.errstate(over="ignore"):
        h = sums[size:] - sums[:n] if n else np.zeros(0, U)
        h *= powers(_INV, len(sums))[:n]
        h += U(size * 0xD6E8FEB86659FD93 % (1 << 64))
    return mix(h, copy=False)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the n+1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def words(raw: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are not space), and the n+1 offsets of each row's words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    gap = space[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    first = ~gap
    first[1:] &= gap[:-1] | edge[1:-1]
    last = ~gap
    last[:-1] &= gap[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 1 << 16) -> np.ndarray:
    """A hash per word, worked out for ``size`` words at a time: eight bytes a byte of text are held for those only."""
    out = np.empty(len(starts), U)
    for lo in range(0, len(starts), size):
        hi = min(lo + size, len(starts))
        at = starts[lo]
        out[lo:hi] = between(prefix(raw[at : ends[hi - 1]].astype(U) + U(1)), starts[lo:hi] - at, ends[lo:hi] - at)
    return out


def chunks(offs: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes each; a larger row stands alone."""
    out, lo, n = [], 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        out.append((lo, hi))
        lo = hi
    return out


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, ... in one array."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)
