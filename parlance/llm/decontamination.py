"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the words at a place and ignore the others, so a seed survives the
substitution of an ignored word. The seeds of the benchmark, a table, are joined with those at every
place of every different text; a bit filter of the benchmark's seeds, of bounded size, keeps seeds
that no item has out of the shuffle. Around a hit the item is laid over the text on the hit's
diagonal and the stretch with the most agreeing words of those that are alike enough is measured,
substitutions included.

Texts are known by a 64-bit hash, so copies are searched once. Neither the benchmark nor the texts
reach the driver; texts are fetched, for measuring, only where a seed was hit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import U, chunks, materialize, mix, small_batches, utf8, word_hashes, words

# Together these masks hit every 13 words of which any two are substituted, and
# 99 of 100 ways to substitute three (tests/llm).
MASKS = ((0, 1, 3, 4, 5), (0, 2, 3, 4, 7), (0, 2, 3, 4, 6), (0, 4, 5, 6, 7))
# They hit every stretch that the default rule allows in items of 8, 9 and 11 or more words, and
# the short ones in items of 4 to 10; 3 words or fewer must agree as a whole.
SHORT, SHORT_WORDS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4)), 10
WHOLE = tuple(tuple(range(n)) for n in (1, 2, 3))
MIN_MATCH, IDENTITY = 13, 0.8
FEW_BITS, MOST_BITS = 20, 27  # of the filter: 2**27 bits are 16 MB
SMALL = 200_000  # rows of a table that is broadcast, after a count

_SPACE = np.ones(256, bool)
_SPACE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words (letters and digits only) of every text, and the texts' offsets."""
    lowered = pa.array([t.lower() if t else "" for t in texts.to_pylist()], pa.large_string())
    raw, offs = utf8(lowered)
    starts, ends, rows = words(raw, offs, _SPACE)
    return word_hashes(raw, starts, ends), rows


def spaced(word: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of the masked words at every place where the mask fits; another one for each mask."""
    n = len(word) - mask[-1]
    if n <= 0:
        return np.zeros(0, U)
    h = np.full(n, zlib.crc32(bytes(mask)), U)
    with np.errstate(over="ignore"):
        for o in mask:
            h = (h ^ word[o : o + n]) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
    return mix(h)


def _ends_of_runs(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the ascending places to keep: of the same seed at place after place, the first and the last.

    Where a run meets a run, the best overlap has their firsts or their lasts on one another.
    """
    if len(at) < 3:
        return np.ones(len(at), bool)
    on = (at[1:] == at[:-1] + 1) & (h[at[1:]] == h[at[:-1]])
    return ~(np.append(False, on) & np.append(on, False))


def item_seeds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, key, place in the text, mask's number) of every seed of benchmark items."""
    word, offs = tokens(texts)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    size, place = np.diff(offs)[row], np.arange(len(word)) - offs[row]
    every = [((m, size == len(m))) for m in WHOLE] + [(m, (size > 3) & (size <= SHORT_WORDS)) for m in SHORT] + [(m, size > SHORT_WORDS) for m in MASKS]
    out = []
    for number, (mask, use) in enumerate(every):
        h = spaced(word, mask)
        at = np.flatnonzero(use[: len(h)] & (row[: len(h)] == row[mask[-1] :][: len(h)])) if len(h) else np.zeros(0, np.int64)
        at = at[_ends_of_runs(h, at) | (np.diff(row[at], prepend=-1) != 0) | (np.diff(row[at], append=-1) != 0)] if len(at) else at
        out.append((row[at], h[at], place[at], np.full(len(at), number)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def text_seeds(word: np.ndarray, masks: list[int], there: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, place) of the seeds of a column of texts that the filter ``there`` knows, mask by mask."""
    bits = U(64 - (len(there) * 8).bit_length() + 1)
    for m in masks:
        h = spaced(word, (*WHOLE, *SHORT, *MASKS)[m])
        b = (h >> bits).astype(np.int64)
        at = np.flatnonzero(there[b >> 3] >> (b & 7).astype(np.uint8) & 1)
        at = at[_ends_of_runs(h, at)]
        yield h[at], at


def stretch(same: np.ndarray, identity: float = IDENTITY) -> tuple[int, int, int]:
    """Start, end and matches of the stretch with the most matches of all whose matches are ``identity`` of it.

    Prefix sums weigh a match by 1 - identity and a mismatch by -identity; for each end the first
    start whose sum is no higher gives the most matches. Mismatches at its ends are left out; of
    equals the shortest counts, then the first.
    """
    share = Fraction(str(identity))
    n, seen = len(same), np.concatenate([[0], np.cumsum(same)])
    sums = seen * share.denominator - np.arange(n + 1) * share.numerator
    start = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
    matches = seen - seen[start]
    most = int(matches.max())
    if not most:
        return 0, 0, 0
    at = np.flatnonzero(same)
    end = np.flatnonzero(matches == most)
    first, last = at[seen[start[end]]], at[seen[end] - 1] + 1
    best = int((last - first).argmin())
    return int(first[best]), int(last[best]), most


def measure(word: np.ndarray, item: np.ndarray, diagonals: np.ndarray, min_match: int = MIN_MATCH, identity: float = IDENTITY) -> tuple[int, int, int] | None:
    """(first word, words, matches) of the best overlap of a text with an item laid over it at any of the places, or None.

    It counts if it has ``min_match`` matching words (of a shorter item: ``identity`` of all), and
    they are ``identity`` of the stretch. About a million words are compared at a time.
    """
    n, share, best = len(item), Fraction(str(identity)), None
    need = min(min_match, -(-n * share.numerator // share.denominator))
    step = max(1, 1_000_000 // max(n, 1))
    diagonals = np.sort(diagonals)
    for lo in range(0, len(diagonals), step):
        first = diagonals[lo : lo + step]
        where = first[:, None] + np.arange(n)
        same = (where >= 0) & (where < len(word))
        same &= word[np.clip(where, 0, max(0, len(word) - 1))] == item
        total = same.sum(1)
        for c in np.argsort(-total, kind="stable"):
            if total[c] < max(need, best[2] + 1 if best else 1):
                break
            a, b, matches = stretch(same[c], identity)
            if matches >= need and (not best or matches > best[2]):
                best = int(first[c]) + a, b - a, matches
    return best


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _small(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if its count allows that."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _filter(seeds: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bits of the benchmark's seeds, about 16 to a seed but at most ``MOST_BITS``, and the masks in use."""
    stats = seeds.agg(F.count(F.lit(1)), F.collect_set("mask")).first()
    bits = min(MOST_BITS, max(FEW_BITS, (16 * stats[0]).bit_length()))
    b = F.shiftrightunsigned("key", 64 - bits) + 1  # they are counted from 1
    got = seeds.groupBy(F.bitmap_bucket_number(b).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(b)).alias("m")).collect()
    there = np.zeros(1 << (bits - 3), np.uint8)
    for r in got:
        there[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return there, sorted(stats[1])


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "item_id", text: str = "text", item_text: str = "text", min_match: int = MIN_MATCH, identity: float = IDENTITY) -> tuple[DataFrame, DataFrame]:
    """(h, ih, start_word, n_words, n_match, item_words), a table of the best overlap of each text and item by their hashes; and the items' hashes (item_id, ih)."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(key).alias("item_id"), F.col(item_text).alias("item")).filter("item is not null").withColumn("ih", _hash(F.col("item")))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in chunks(utf8(b.column("item"))[1], 1_000_000):
                row, h, place, mask = item_seeds(b.column("item").slice(lo, hi - lo))
                yield pa.record_batch([b.column("ih").take(pa.array(lo + row)), pa.array(h.view(np.int64)), pa.array(place, pa.int32()), pa.array(mask, pa.int32())], names=["ih", "key", "place", "mask"])

    different = items.dropDuplicates(["ih"]).select("ih", "item")
    seeds = materialize(different.mapInArrow(index, "ih long, key long, place int, mask int"), "seeds")
    there, masks = _filter(seeds)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text")
            for lo, hi in chunks(utf8(column)[1], 2_000_000):
                word, offs = tokens(column.slice(lo, hi - lo))
                for found, at in text_seeds(word, masks, there):
                    if len(at):
                        row = np.searchsorted(offs, at, "right") - 1
                        yield pa.record_batch([b.column("h").take(pa.array(lo + row)), pa.array(found.view(np.int64)), pa.array(at - offs[row], pa.int32())], names=["h", "key", "at"])

    rows = docs.select(_hash(F.col(text)).alias("h"), F.col(text).alias("text")).filter("text is not null")
    hits = rows.mapInArrow(probe, "h long, key long, at int").distinct()
    pairs = hits.join(_small(seeds.select("key", "ih", "place")), "key").select("h", "ih", (F.col("at") - F.col("place")).alias("d"))
    pairs = materialize(pairs.groupBy("h", "ih").agg(F.collect_set("d").alias("ds")), "overlap-pairs")
    hit = _small(pairs.select("h").distinct())
    texts = rows.join(hit, "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    laid = pairs.join(_small(different), "ih").select("h", F.lit(1).alias("k"), F.col("item").alias("text"), "ih", "ds")
    both = texts.select("h", F.lit(0).alias("k"), "text", F.lit(None).cast("long").alias("ih"), F.lit(None).cast("array<int>").alias("ds")).unionByName(laid)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(n, "h").sortWithinPartitions("h", "k", "ih")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lru_cache(1000)(lambda t: tokens(pa.array([t], pa.large_string()))[0])
        word = np.zeros(0, U)
        for b in batches:
            cols, out = [b.column(i) for i in range(5)], []
            for i in range(b.num_rows):
                h, k, t, ih, ds = (c[i] for c in cols)
                if k.as_py() == 0:  # a text, and after it the items to lay over it
                    word = tokens(pa.array([t.as_py()], pa.large_string()))[0]
                    continue
                item = one(t.as_py())
                if got := measure(word, item, ds.values.to_numpy().astype(np.int64), min_match, identity):
                    out.append((h.as_py(), ih.as_py(), *got, len(item)))
            if out:
                types = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["h", "ih", "start_word", "n_words", "n_match", "item_words"])

    found = both.mapInArrow(compare, "h long, ih long, start_word int, n_words int, n_match int, item_words int")
    return materialize(found, "overlaps"), items.select("item_id", "ih")


def contaminations(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", min_match: int = MIN_MATCH, identity: float = IDENTITY) -> DataFrame:
    """One row per overlapping document row and item row: doc_id, item_id, start_word, n_words, n_match, item_words.

    The best overlap of each pair: the most matching words, then the first place. Null, empty and
    wordless texts and items overlap nothing; ids of any type may be null or repeated, and repeated
    rows each give their rows; an item repeated under another id gives a row for each; an empty table
    on either side gives an empty table; other columns are not read. Whole texts of any length are
    searched; a text that repeats a seed with a period is laid under the item once for each place.
    """
    found, items = overlaps(docs, benchmark, text=text, min_match=min_match, identity=identity)
    rows = docs.select(F.col(key).alias("doc_id"), _hash(F.col(text)).alias("h"), F.col(text).isNull().alias("none")).filter("not none")
    return rows.join(_small(found), "h").join(_small(items), "ih").select("doc_id", "item_id", "start_word", "n_words", "n_match", "item_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_match: int = MIN_MATCH, identity: float = IDENTITY) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that overlap no item of the benchmark; see ``contaminations``."""
    found, _ = overlaps(docs, benchmark, text=text, min_match=min_match, identity=identity)
    rows = docs.select(_hash(F.col(text)).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(_small(found.select("h").distinct()), "h", "left_anti").select("row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
