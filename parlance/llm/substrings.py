"""Removal of repeated passages by fixed-block anchors.

Every document is cut into blocks of ``block`` words that do not overlap; the blocks are the
index. Every rolling window of as many words of every document probes it. A passage of ``window``
words that stands in two places holds a whole block of either place, as ``window >= 2 * block - 1``,
so both places are hit; hits are extended to the windows around them, whose hashes are exchanged
in turn, and the union of the windows that stand in two places is the maximal repeats.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import between, prefix, release, word_hashes, words
from parlance.llm.packs import BUCKET_KEYS, Pack, attach, each_pack, exchange, make_packs, positions, returned, short

WINDOW = 35
_HIT = 1


def _hashes(pack: Pack, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Words' bounds, documents' word offsets, and for each size the starts and hashes of all windows."""
    starts, ends, rows = words(pack.raw, pack.offs)
    sums = prefix(word_hashes(pack.raw, starts, ends))
    last = np.repeat(rows[1:], np.diff(rows))  # the end of each word's document
    out = {}
    for size in sizes:
        at = np.flatnonzero(np.arange(len(starts)) + size <= last)
        out[size] = (at, between(sums, at, at + size))
    return np.stack([starts, ends]), rows, out


def _probes(at: np.ndarray, h: np.ndarray, rows: np.ndarray, block: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes of the rolling windows, which window has which, and flags: 1 several, 2 a block."""
    keys, first, own = positions(short(h, bits))
    begin = rows[np.searchsorted(rows, at, "right") - 1] if len(at) else at
    flags = (np.bincount(own, minlength=len(keys)) > 1).astype(np.uint8)
    flags[own[(at - begin) % block == 0]] |= 2
    return keys, own, flags


def _hit(kind: str, keys: list[np.ndarray], flags: list[np.ndarray | None]) -> list[np.ndarray]:
    """1 where a key stands in two places (and, among the probes, one place is a block)."""
    every, flag = np.concatenate(keys), np.concatenate([f.ravel() for f in flags])
    _, _, own = positions(every)
    twice = np.bincount(own, 1 + (flag & 1)) > 1
    if kind == "probe":
        twice &= np.bincount(own, flag >> 1) > 0
    return np.split(twice[own].astype(np.uint8), np.cumsum([len(k) for k in keys])[:-1])


def _candidates(at: np.ndarray, hit_at: np.ndarray, n_words: int, window: int, block: int) -> np.ndarray:
    """Which of the windows starting at ``at`` hold a hit block."""
    hits = np.zeros(n_words + 1, np.int64)
    hits[hit_at + 1] = 1
    hits = np.cumsum(hits)
    return hits[at + window - block + 1] > hits[at]


def repeated_words(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, n_spans and, if asked, kept_text.

    Removed is each word covered by ``window`` consecutive words of one document that stand in a
    second place anywhere, the same document included; all copies go. kept_text is the rest joined
    by single spaces. Null, empty and blank texts have no words; texts of fewer words than the
    window keep all; repeated rows are copies of each other; an empty table gives an empty table;
    null and repeated ids are allowed; other columns are not read.
    """
    block = (window + 1) // 2
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    packs = make_packs(docs, key, text, ordered=False)
    release(spark)
    total = max(1, (packs.agg(F.sum("n_bytes")).first()[0] or 0) // 5)
    n_buckets, bits = -(-total // BUCKET_KEYS), min(64, total.bit_length() + 9)

    def probe(pack: Pack) -> Iterator[tuple]:
        _, rows, h = _hashes(pack, (block,))
        keys, _, flags = _probes(*h[block], rows, block, bits)
        yield "probe", keys, bits, flags

    def extended(pack: Pack) -> tuple:
        bounds, rows, h = _hashes(pack, (block, window))
        at, hashes = h[block]
        keys, own, _ = _probes(at, hashes, rows, block, bits)
        hit = returned(pack, "probe", keys, bits, n_buckets)[own] == _HIT
        at, hashes = h[window]
        some = _candidates(at, h[block][0][hit], bounds.shape[1], window, block)
        at = at[some]
        keys, _, own = positions(hashes[some])
        return bounds, rows, at, keys, own

    def extend(pack: Pack) -> Iterator[tuple]:
        _, _, _, keys, own = extended(pack)
        yield "window", keys, 64, (np.bincount(own, minlength=len(keys)) > 1).astype(np.uint8)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in each_pack(batches):
            bounds, rows, at, keys, own = extended(pack)
            twice = at[returned(pack, "window", keys, 64, n_buckets)[own] == _HIT]
            n = bounds.shape[1]
            edge = np.bincount(twice, minlength=n + 1) - np.bincount(twice + window, minlength=n + 1)[: n + 1]
            gone = np.cumsum(edge)[:n] > 0
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), rows[:-1]) if len(rows) > 1 else np.zeros(0, np.int64)
            removed[np.diff(rows) == 0] = 0
            data = pack.raw.tobytes()
            sums, texts, spans = [], [], []
            for d in range(len(rows) - 1):
                own_words = data[pack.offs[d] : pack.offs[d + 1]].split()
                mask = gone[rows[d] : rows[d + 1]]
                if removed[d]:
                    own_words = list(itertools.compress(own_words, (~mask).tolist()))
                kept = b" ".join(own_words)
                sums.append(hashlib.sha256(kept).hexdigest())
                spans.append(int((mask & ~np.append(False, mask[:-1])).sum()) if removed[d] else 0)
                texts.append(kept.decode("utf-8", "replace") if with_text else None)
            cols = [pack.ids, pa.array(np.diff(rows)), pa.array(removed), pa.array(sums, pa.string()), pa.array(spans, pa.int64())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans"]
            if with_text:
                cols, names = [*cols, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    probes = exchange(packs, probe, _hit, n_buckets)
    release(spark)
    windows = exchange(attach(packs, probes), extend, _hit, n_buckets)
    release(spark)
    return attach(packs, probes, windows).mapInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, n_spans long" + ", kept_text string" * with_text)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of passages of 35 words that stand anywhere else."""
    return repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
