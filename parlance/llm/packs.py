"""Texts in packs, and an exchange of hashed keys between them.

A pack is one row that holds some texts, about ``PACK_BYTES`` of them (a longer text stands alone).
An exchange sends each pack's different keys, sorted and delta coded, to buckets of the key space,
and brings back one code per key. A key that a third of all texts hold reaches its bucket once per
pack, and each bucket holds about ``BUCKET_KEYS`` keys whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import U, chunks, materialize, small_batches, utf8

PACK_BYTES, BUCKET_KEYS = 2_000_000, 2_000_000
GROUP_PACKS = 4  # packs of a row group of their table: as many texts as a task holds at once, however the input is laid out


@dataclass
class Pack:
    number: int
    ids: pa.Array
    raw: np.ndarray
    offs: np.ndarray
    codes: dict[tuple[str, int], bytes]  # what came back, by kind and bucket


def make_packs(docs: DataFrame, key: str, text: str, ordered: bool, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Writes the table of packs: pack, ids, texts, n_bytes. Null texts are empty ones.

    ``ordered``: by a range shuffle, packs and their rows follow the order of the key (null first;
    equal keys by their texts' hash). Otherwise rows stay where they are and nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    if ordered:
        rows = rows.withColumn("h", F.xxhash64("text"))
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            _, offs = utf8(b.column("text"))
            for lo, hi in chunks(offs, pack_bytes):
                ids, texts = b.column("id").slice(lo, hi - lo), b.column("text").slice(lo, hi - lo)
                one = pa.array([0, hi - lo], pa.int32())
                lists = [pa.ListArray.from_arrays(one, x) for x in (ids, texts)]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([int(offs[hi] - offs[lo])], pa.int64())], names=["pack", "ids", "texts", "n_bytes"])
                number += 1

    return materialize(rows.mapInArrow(run, f"pack long, ids array<{kind}>, texts array<string>, n_bytes long"), "packs", GROUP_PACKS)


def each_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[Pack]:
    for b in batches:
        get = {name: b.column(i) for i, name in enumerate(b.schema.names)}
        for i in range(b.num_rows):
            codes = {}
            if "replies" in get and get["replies"][i].is_valid:
                codes = {(r["kind"], r["bucket"]): r["codes"] for r in get["replies"][i].as_py()}
            raw, offs = utf8(get["texts"][i].values)
            yield Pack(get["pack"][i].as_py(), get["ids"][i].values, raw, offs, codes)


def encode(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and the differences, in as few bytes each as they all fit in."""
    step = np.diff(keys)
    width = max(1, (int(step.max()).bit_length() + 7) // 8) if len(step) else 1
    return bytes([width]) + keys[:1].tobytes() + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decode(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(body) + 1, 8), np.uint8)
    step[1:, :width] = body
    step = step.view("<u8").ravel()
    step[0] = np.frombuffer(data, "<u8", 1, 1)[0]
    return np.cumsum(step, dtype=U)


def parts(keys: np.ndarray, bits: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that ascending keys of ``bits`` bits fall into, and where each begins, and the end.

    The key space is cut into ``n_buckets`` equal ranges; the work grows with the keys alone.
    """
    if bits > 32:
        bucket = (keys >> U(bits - 32)) * U(n_buckets) >> U(32)
    else:
        bucket = keys * U(n_buckets) >> U(bits)
    first = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1])) if len(keys) else np.zeros(0, np.int64)
    return bucket[first].astype(np.int64), np.append(first, len(keys))


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys if bits >= 64 else keys >> U(64 - bits)


Emit = Callable[[Pack], Iterator[tuple[str, np.ndarray, int, np.ndarray | None]]]


def exchange(packs: DataFrame, emit: Emit, answer: Callable[[str, list[np.ndarray], list[np.ndarray | None]], list[np.ndarray]], n_buckets: int) -> DataFrame:
    """Writes the table of replies: pack, kind, bucket, codes.

    ``emit`` gives (kind, ascending different keys, their bits, a value of fixed width per key or
    None) for a pack. ``answer`` gets a kind's keys and values in one bucket, by pack in the packs'
    order, and gives a code (0 to 15) per key.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in each_pack(batches):
            for kind, keys, bits, values in emit(pack):
                full, at = parts(keys, bits, n_buckets)
                yield pa.record_batch(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([pack.number] * len(full), pa.int64()),
                        pa.array([kind] * len(full), pa.string()),
                        pa.array([encode(keys[lo:hi]) for lo, hi in pairwise(at)], pa.binary()),
                        pa.array([None if values is None else values[lo:hi].tobytes() for lo, hi in pairwise(at)], pa.binary()),
                    ],
                    names=["bucket", "pack", "kind", "keys", "vals"],
                )

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        bucket, kind = key[0].as_py(), key[1].as_py()
        order = np.argsort(table.column("pack").to_numpy())
        keys, values = table.column("keys").to_pylist(), table.column("vals").to_pylist()
        lists = [decode(keys[i]) for i in order]
        vals = [None if values[i] is None else np.frombuffer(values[i], np.uint8).reshape(len(k), -1) for i, k in zip(order, lists, strict=True)]
        codes = answer(kind, lists, vals)
        some = [i for i, c in enumerate(codes) if c.any()]
        packed = [_nibbles(codes[i]) for i in some]
        return pa.table({"pack": pa.array(table.column("pack").to_numpy()[order[some]], pa.int64()), "kind": pa.array([kind] * len(some), pa.string()), "bucket": pa.array([bucket] * len(some), pa.int32()), "codes": pa.array(packed, pa.binary())})

    sent = packs.mapInArrow(send, "bucket int, pack long, kind string, keys binary, vals binary")
    return materialize(sent.groupBy("bucket", "kind").applyInArrow(meet, "pack long, kind string, bucket int, codes binary"), "replies")


def _nibbles(codes: np.ndarray) -> bytes:
    codes = np.append(codes, 0)[: len(codes) // 2 * 2 + 2].astype(np.uint8) if len(codes) % 2 else codes.astype(np.uint8)
    return (codes[0::2] | codes[1::2] << 4).tobytes()


def returned(pack: Pack, kind: str, keys: np.ndarray, bits: int, n_buckets: int) -> np.ndarray:
    """The codes that came back for the keys that ``emit`` gave."""
    out = np.zeros(len(keys), np.uint8)
    full, at = parts(keys, bits, n_buckets)
    for b, (lo, hi) in zip(full, pairwise(at), strict=True):
        data = pack.codes.get((kind, int(b)))
        if data is not None:
            two = np.frombuffer(data, np.uint8)
            out[lo:hi] = np.stack([two & 15, two >> 4], 1).ravel()[: hi - lo]
    return out


def attach(packs: DataFrame, *replies: DataFrame) -> DataFrame:
    """The packs with all their replies; the text crosses the network once."""
    every = replies[0]
    for r in replies[1:]:
        every = every.unionByName(r)
    grouped = every.groupBy("pack").agg(F.collect_list(F.struct("kind", "bucket", "codes")).alias("replies"))
    return packs.join(grouped, "pack", "left").select("pack", "ids", "texts", "replies")


def positions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, where each first stands, and for every place the index of its key."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    own = np.empty(len(s), np.int64)
    own[order] = np.cumsum(new) - 1
    return s[new], order[new], own
