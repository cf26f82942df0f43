"""Packing into optimal length buckets.

The global histogram of lengths (at most ``max_len`` rows, whatever the input) goes to the driver;
dynamic programming chooses the bucket bounds with the least padding; sequences are numbered
inside their bucket and cut into batches of ``budget // bound`` sequences, so that a batch never
holds more than ``budget`` tokens, padding included.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import gapless_rank, materialize

MAX_LEN, N_BUCKETS, BUDGET, SLICES = 2048, 8, 16384, 1024
WORD = r"[^\x20\x09-\x0D]+"


def optimal_bounds(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """The upper bounds of at most ``n_buckets`` buckets that need the least padding in all.

    Exact, in O(n_buckets * lengths**2) vectorised steps; among equal costs the smaller cut wins.
    """
    lengths = np.array(sorted(k for k in histogram if k > 0), np.int64)
    if not len(lengths):
        return []
    count = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in lengths])]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum([histogram[int(x)] * int(x) for x in lengths])]).astype(np.int64)
    d = len(lengths)
    k = min(n_buckets, d)
    far = np.iinfo(np.int64).max // 4
    cost = np.full(d + 1, far)
    cost[0] = 0
    cuts = []
    for _ in range(k):
        new, cut = np.full(d + 1, far), np.zeros(d + 1, np.int64)
        for lo in range(1, d + 1, 256):
            j = np.arange(lo, min(d + 1, lo + 256))
            i = np.arange(0, j[-1])
            c = cost[i, None] + lengths[j - 1] * (count[j] - count[i, None]) - (total[j] - total[i, None])
            c[i[:, None] >= j] = far
            cut[j] = c.argmin(0)
            new[j] = np.minimum(c.min(0), far)
        cost = new
        cuts.append(cut)
    bounds, j = [], d
    for cut in reversed(cuts):
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def slice_of(*parts: Column) -> Column:
    """One of ``SLICES`` slices by the first digits of an MD5 sum, which SQL engines have alike."""
    digits = F.left(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), F.lit(6))
    return F.conv(digits, 16, 10).cast("long") % SLICES


def pack(docs: DataFrame, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, budget: int = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sequence: doc_id, piece, n_tokens, bucket, bucket_len, batch, position.

    Tokens are words. A document longer than ``max_len`` gives several sequences of ``max_len``
    and one with the rest; nothing is dropped. A document without words (null, empty, blank) gives
    one row with n_tokens 0 and null bucket, bucket_len, batch and position. Repeated rows and ids
    each count; ties in length share a bucket; an empty table gives an empty table; other columns
    are not read. Sequences of a bucket are ordered by (slice, id, piece, n_tokens), the slice being
    one of 1024 by a hash of the three, so that no kind of ids, null ones included, fills one slice.
    """
    if max_len < 1 or n_buckets < 1 or budget < max_len:
        raise ValueError("max_len and n_buckets must be positive, and budget at least max_len")
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(key).alias("doc_id"), n.alias("_n"))
    last = F.greatest(F.floor((F.col("_n") - 1) / max_len).cast("long"), F.lit(0).cast("long"))
    rows = rows.select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    rows = rows.select("doc_id", "piece", F.least(F.col("_n") - F.col("piece") * max_len, F.lit(max_len).cast("long")).alias("n_tokens"))
    rows = materialize(rows, "sequences")
    histogram = {r["n_tokens"]: r["n"] for r in rows.filter("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = optimal_bounds(histogram, n_buckets)
    none = F.lit(None)
    bucket, bound = none.cast("int"), none.cast("long")
    if bounds:
        bucket, bound = F.when(F.lit(False), 0), F.when(F.lit(False), 0)
        for b, most in enumerate(bounds):
            here = (F.col("n_tokens") > 0) & (F.col("n_tokens") <= most)
            bucket, bound = bucket.when(here, b), bound.when(here, most)
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("bucket_len", bound.cast("long"))
    full = rows.filter("bucket is not null").withColumn("_b", slice_of(F.col("doc_id"), F.col("piece"), F.col("n_tokens")))
    full = gapless_rank(full, ["bucket"], "_b", [F.col("doc_id"), F.col("piece"), F.col("n_tokens")], "_r")
    size = F.floor(F.lit(budget) / F.col("bucket_len")).cast("long")
    full = full.withColumn("batch", F.floor(F.col("_r") / size).cast("long")).withColumn("position", (F.col("_r") % size).cast("int"))
    empty = rows.filter("bucket is null").select("*", none.cast("long").alias("batch"), none.cast("int").alias("position"))
    names = ["doc_id", "piece", "n_tokens", "bucket", "bucket_len", "batch", "position"]
    return full.select(*names).unionByName(empty.select(*names))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sequences of at most 2048 words in 8 buckets and batches of 16384 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packing_sql(source: str = "documents", max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, budget: int = BUDGET) -> str:
    """The same in DuckDB's SQL, the dynamic programme included (for at least n_buckets lengths)."""
    ctes = [
        f"words AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n FROM {source})",
        f"seqs AS (SELECT doc_id, piece, least(n - piece * {max_len}, {max_len}) AS n_tokens FROM (SELECT doc_id, n, unnest(range(0, greatest((n - 1) // {max_len}, 0) + 1)) AS piece FROM words))",
        "hist AS (SELECT n_tokens AS l, count(*) AS c FROM seqs WHERE n_tokens > 0 GROUP BY 1)",
        "cum AS (SELECT row_number() OVER (ORDER BY l) AS j, l, CAST(sum(c) OVER (ORDER BY l) AS BIGINT) AS cc, CAST(sum(c * l) OVER (ORDER BY l) AS BIGINT) AS tt FROM hist)",
        "base AS (SELECT 0 AS j, 0 AS l, CAST(0 AS BIGINT) AS cc, CAST(0 AS BIGINT) AS tt UNION ALL SELECT * FROM cum)",
        "d0 AS (SELECT 0 AS j, CAST(0 AS BIGINT) AS cost, 0 AS cut)",
    ]
    for k in range(1, n_buckets + 1):
        ctes.append(
            f"d{k} AS (SELECT b.j AS j, min(p.cost + b.l * (b.cc - a.cc) - (b.tt - a.tt)) AS cost, arg_min(a.j, (p.cost + b.l * (b.cc - a.cc) - (b.tt - a.tt), a.j)) AS cut"
            f" FROM d{k - 1} p JOIN base a ON a.j = p.j JOIN base b ON b.j > a.j GROUP BY b.j)"
        )
    ctes.append(f"e{n_buckets} AS (SELECT j, cut, {n_buckets - 1} AS bucket FROM d{n_buckets} WHERE j = (SELECT max(j) FROM base))")
    for k in range(n_buckets - 1, 0, -1):
        ctes.append(f"e{k} AS (SELECT d.j, d.cut, {k - 1} AS bucket FROM d{k} d JOIN e{k + 1} e ON d.j = e.cut)")
    every = " UNION ALL ".join(f"SELECT e.bucket, b.l AS bucket_len FROM e{k} e JOIN base b ON b.j = e.j" for k in range(1, n_buckets + 1))
    ctes.append(f"bounds AS ({every})")
    ctes.append("put AS (SELECT s.*, (SELECT min(bucket_len) FROM bounds WHERE bucket_len >= s.n_tokens) AS bl FROM seqs s)")
    ctes.append(
        "ranked AS (SELECT p.doc_id, p.piece, p.n_tokens, b.bucket, b.bucket_len, row_number() OVER (PARTITION BY b.bucket ORDER BY "
        f"('0x' || left(md5(concat_ws(':', p.doc_id, p.piece, p.n_tokens)), 6))::INT % {SLICES}, p.doc_id NULLS FIRST, p.piece, p.n_tokens) - 1 AS r FROM put p JOIN bounds b ON b.bucket_len = p.bl WHERE p.n_tokens > 0)"
    )
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, piece, n_tokens, CAST(bucket AS INTEGER) AS bucket, CAST(bucket_len AS BIGINT) AS bucket_len, CAST(r // ({budget} // bucket_len) AS BIGINT) AS batch,"
        f" CAST(r % ({budget} // bucket_len) AS INTEGER) AS position FROM ranked"
        "\nUNION ALL SELECT doc_id, piece, n_tokens, NULL, NULL, NULL, NULL FROM seqs WHERE n_tokens <= 0"
    )
