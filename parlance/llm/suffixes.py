"""Removal of repeated byte strings by a logarithmic family of suffix indexes.

Suffixes are sampled: of every ``window`` consecutive bytes the one whose ``GRAM`` bytes have the
least hash is an anchor, so two copies of such a string are anchored at the same place. A suffix
is known by the hash of its first ``GRAM`` bytes, and by the hash of its run: all bytes of the
windows that it anchors. The suffixes of a pack, sorted, are that pack's suffix array. Packs come
in the order of their documents' ids; in every bucket of the key space each new pack's array is
merge-scanned against the levels of an index family, where whatever is found is earlier, and then
joins the family, whose levels merge when they grow to equal size.

A run that stands earlier is removed whole. Where suffixes agree but their runs do not, the windows
of the first of each different run are compared themselves, in the same way, so that matches are
exact to the byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import U, between, mix, prefix, ragged, release, rolling
from parlance.llm.packs import BUCKET_KEYS, Pack, attach, each_pack, exchange, make_packs, positions, returned

WINDOW, GRAM, BYTES = 100, 40, 1_000_000
_EARLIER, _SEVERAL = 1, 2


class IndexFamily:
    """Levels of sorted keys; a level of some size exists at most once, as equal ones are merged."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def scan(self, batch: np.ndarray) -> np.ndarray:
        """Which keys of the sorted batch some level holds."""
        found = np.zeros(len(batch), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, batch), len(level) - 1)
            found |= level[at] == batch
        return found

    def add(self, batch: np.ndarray) -> None:
        """Adds a sorted batch as a level and merges levels of about equal size."""
        if len(batch):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            both = np.concatenate([self.levels.pop(), self.levels.pop()])
            both.sort(kind="stable")
            self.levels.append(both)


def anchors(gram: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first and last window start, and the anchor's place.

    ``gram`` has the hash at every place; windows start at first[d]..last[d] for each document and
    hold ``width`` places. The leftmost of equal least hashes is the anchor.
    """
    n = len(gram)
    least, have = gram.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < n:
            np.minimum(least[: n - step], least[step:], out=least[: n - step])
        have += step
    edge = np.zeros(n + 1, np.int8)
    edge[first[last >= first]] += 1
    edge[last[last >= first] + 1] -= 1
    starts = np.cumsum(edge[:n], dtype=np.int8).view(bool)
    same = np.zeros(n + 1, bool)  # a place whose run goes on from the place before
    np.equal(least[1:], least[:-1], out=same[1:n])
    same[1:n] &= starts[1:] & starts[:-1]
    if len(first):
        same[first] = False
    lo, hi = np.flatnonzero(starts & ~same[:n]), np.flatnonzero(starts & ~same[1:])
    value = least[lo]
    del least, edge, starts, same
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    span = np.arange(width)
    while len(lo):
        at = np.empty(len(lo), np.int64)
        for b in range(0, len(lo), 20_000):
            at[b : b + 20_000] = lo[b : b + 20_000] + (gram[lo[b : b + 20_000, None] + span] == value[b : b + 20_000, None]).argmax(1)
        out.append((lo, np.minimum(hi, at), at))
        more = hi > at  # the same hash again further on
        lo, hi, value = at[more] + 1, hi[more], value[more]
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    lo, hi, at = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(lo, kind="stable")
    return lo[order], hi[order], at[order]


class _Runs:
    """The runs of a pack with their keys."""

    def __init__(self, pack: Pack, window: int, gram: int) -> None:
        self.sums = prefix(pack.raw.astype(U) + U(1))
        size = np.diff(pack.offs)
        long = size >= window
        first, last = pack.offs[:-1][long], pack.offs[1:][long] - window
        hashes = rolling(self.sums, gram)
        self.lo, self.hi, place = anchors(hashes, first, last, window - gram + 1)
        self.suffix = mix(hashes[place])  # least hashes are small ones; mixed again they spread over the buckets
        run = between(self.sums, self.lo, self.hi + window)
        with np.errstate(over="ignore"):
            self.run = mix(run ^ ((place - self.lo).astype(U) * U(0xA24BAED4963EE407)))

    def first_of(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different run keys, the first run of each, and every run's key."""
        return positions(self.run)


def _answer(kind: str, keys: list[np.ndarray], values: list[np.ndarray | None]) -> list[np.ndarray]:
    if kind != "suffix":
        family, codes = IndexFamily(), []
        for batch in keys:
            codes.append(family.scan(batch).astype(np.uint8) * _EARLIER)
            family.add(batch)
        return codes
    # suffixes: whether their runs differ anywhere
    every = np.concatenate(keys)
    seen = np.concatenate([v.copy().view("<u4").reshape(-1, 2) for v in values])
    _, _, own = positions(every)
    low, high = np.full(own.max() + 1, 0xFFFFFFFF, np.uint32), np.zeros(own.max() + 1, np.uint32)
    np.minimum.at(low, own, seen[:, 0])
    np.maximum.at(high, own, seen[:, 1])
    return np.split(((low != high)[own] * _SEVERAL).astype(np.uint8), np.cumsum([len(k) for k in keys])[:-1])


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (binary).

    Removed is each byte covered by a ``window``-byte string of one document that starts earlier
    too: in a document with a smaller id or earlier in the same one. Documents with equal or null
    ids are in the order of their texts' hash, null first. Null texts are empty; texts shorter than
    the window stay whole; of repeated rows all but one are removed; an empty table gives an empty
    table; other columns are not read. Removal may cut a character; kept is therefore bytes.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    packs = make_packs(docs, key, text, ordered=True, pack_bytes=BYTES)
    release(spark)
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = max(1, total // 16 // BUCKET_KEYS)

    def runs(pack: Pack) -> Iterator[tuple]:
        r = _Runs(pack, window, gram)
        keys, _, own = positions(r.suffix)
        seen = np.zeros((len(keys), 2), "<u4")
        seen[:, 0] = 0xFFFFFFFF
        low = (r.run >> U(32)).astype(np.uint32)
        np.minimum.at(seen[:, 0], own, low)
        np.maximum.at(seen[:, 1], own, low)
        yield "suffix", keys, 64, seen.view(np.uint8)
        yield "run", r.first_of()[0], 64, None

    def open_windows(pack: Pack) -> tuple:
        """Runs to remove whole; starts and hashes of the windows to be compared."""
        r = _Runs(pack, window, gram)
        keys, first, own = r.first_of()
        earlier = (returned(pack, "run", keys, 64, n_buckets) == _EARLIER)[own]
        earlier |= np.arange(len(own)) != first[own] if len(own) else False
        keys, _, own = positions(r.suffix)
        several = (returned(pack, "suffix", keys, 64, n_buckets) == _SEVERAL)[own]
        open_ = several & ~earlier
        n = (r.hi - r.lo + 1)[open_]
        at = np.repeat(r.lo[open_], n) + ragged(n)
        return r, earlier, at, positions(between(r.sums, at, at + window))

    def compare(pack: Pack) -> Iterator[tuple]:
        _, _, _, (keys, _, _) = open_windows(pack)
        yield "window", keys, 64, None

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in each_pack(batches):
            r, earlier, at, (keys, first, own) = open_windows(pack)
            gone = returned(pack, "window", keys, 64, n_buckets)[own] == _EARLIER
            gone |= np.arange(len(own)) != first[own] if len(own) else False
            n = len(pack.raw)
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, r.lo[earlier], 1)
            np.add.at(edge, r.hi[earlier] + window, -1)
            np.add.at(edge, at[gone], 1)
            np.add.at(edge, at[gone] + window, -1)
            mask = np.cumsum(edge)[:n] > 0
            ids, size, removed, spans, sums, kept = pack.ids, np.diff(pack.offs), [], [], [], []
            for d in range(len(size)):
                own_bytes, own_mask = pack.raw[pack.offs[d] : pack.offs[d + 1]], mask[pack.offs[d] : pack.offs[d + 1]]
                removed.append(int(own_mask.sum()))
                spans.append(int((own_mask & ~np.append(False, own_mask[:-1])).sum()) if removed[-1] else 0)
                rest = (own_bytes[~own_mask] if removed[-1] else own_bytes).tobytes()
                sums.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_bytes else None)
            cols = [ids, pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    found = exchange(packs, runs, _answer, n_buckets)
    release(spark)
    windows = exchange(attach(packs, found), compare, _answer, n_buckets)
    release(spark)
    return attach(packs, found, windows).mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 100 bytes that start earlier."""
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_bytes=False)
