"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Texts become lower case letters with single spaces between runs of letters; their byte trigrams
are hashed into a fixed number of features. A bounded sample of labelled texts gives the inverse
document frequencies and, by spherical k-means, several centroids per language. A text gets the
language of the centroid with the largest cosine; it is rejected when that cosine is below what
the sample's own texts of about its length reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import small_batches

DIMS, PER_LANG, MAX_SAMPLE, CENTROIDS, SLACK = 8192, 400, 4000, 3, 0.2
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray  # least cosine to accept, by the log2 of the number of trigrams


def clean(text: str | None) -> str:
    """Lower case letters and single spaces; empty if the text has no letter."""
    t = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {t} " if t and (t.isascii() or any(c.isalpha() for c in t)) else ""


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of feature counts, and the number of trigrams, for each cleaned text; a million bytes at a time."""
    data = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum([len(x) for x in data])
    n = np.zeros(len(data) * DIMS, np.float32)
    for lo in range(0, max(0, len(raw) - 2), 1 << 20):
        part = raw[lo : lo + (1 << 20) + 2].astype(np.uint32)
        gram = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
        at = np.arange(lo, lo + len(gram))
        row = np.searchsorted(ends, at, "right")
        inside = at + 2 < ends[row]
        feature = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int64)
        n += np.bincount((row * DIMS + feature)[inside], minlength=len(n))
    n = n.reshape(len(data), DIMS)
    return n, n.sum(1)


def few(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of at most 64 texts and about half a million characters; a longer text stands alone."""
    lo = size = 0
    for hi, t in enumerate(texts):
        if hi > lo and (hi - lo == 64 or size + len(t or "") > 500_000):
            yield lo, hi
            lo, size = hi, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows, with a logarithm of the counts; zero rows stay zero."""
    v = np.log1p(n) * idf
    size = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.maximum(size, 1e-12)


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the farthest-first rows; deterministic."""
    picks = [int((v @ v.mean(0)).argmax())]
    while len(picks) < min(k, len(v)):
        near = (v @ v[picks].T).max(1)
        picks.append(int(near.argmin()))
    c = v[picks].copy()
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = v[own == i].mean(0)
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = PER_LANG, most: int = MAX_SAMPLE, k: int = CENTROIDS) -> Model:
    """Learns every language, from about 1.2 * ``per_lang`` texts of each, and of ``most`` in all, chosen by a hash of the key.

    However many languages there are, each teaches one text at least, that with the least hash.
    Rows with a null text or language, or without letters, teach nothing. The bounded sample, as
    feature counts, and one count per language are all that reaches the driver.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null and t rlike '\\\\p{L}'")
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("k"), F.lit("")), F.lit("langid")), 11).cast("double") / F.lit(float(1 << 53))
    n = {r["l"]: (r["n"], r["d"]) for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("d")).collect()}
    if not n:
        return Model((), np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(40))
    share = max(1, min(per_lang, most // len(n)))
    until = {name: max(1.2 * share / c, np.nextafter(least, 2)) for name, (c, least) in n.items()}
    rate = F.create_map(*[F.lit(x) for name in sorted(until) for x in (name, float(until[name]))])
    rows = rows.filter(draw < F.element_at(rate, F.col("l")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column("l").to_pylist(), b.column("t").to_pylist()
            for lo, hi in few(texts):
                c, _ = counts([clean(t) for t in texts[lo:hi]])
                where = [np.flatnonzero(x) for x in c]
                yield pa.record_batch([pa.array(langs[lo:hi], pa.string()), pa.array([w.astype(np.int32).tobytes() for w in where], pa.binary()), pa.array([x[w].tobytes() for x, w in zip(c, where, strict=True)], pa.binary())], names=["l", "f", "c"])

    got = sorted((r["l"], bytes(r["f"]), bytes(r["c"])) for r in rows.mapInArrow(features, "l string, f binary, c binary").collect())
    dense = np.zeros((len(got), DIMS), np.float32)
    for i, (_, f, c) in enumerate(got):
        dense[i, np.frombuffer(f, np.int32)] = np.frombuffer(c, np.float32)
    idf = (np.log((1 + len(got)) / (1 + (dense > 0).sum(0))) + 1).astype(np.float32)
    v = vectors(dense, idf)
    own = np.array([x[0] for x in got])
    langs: list[str] = []
    cents = []
    for name in sorted(set(own)):
        c = _kmeans(v[own == name], k)
        cents.append(c)
        langs += [str(name)] * len(c)
    centroids = np.concatenate(cents).astype(np.float32)
    best = (v @ centroids.T).max(1)
    size = np.log2(np.maximum(dense.sum(1), 1)).astype(int)
    floor = np.zeros(40)
    for b in range(40):
        near = best[np.abs(size - b) <= 1]
        floor[b] = SLACK * np.median(near) if len(near) >= 20 else np.nan
    known = np.flatnonzero(~np.isnan(floor))
    # a class with few texts takes the floor of the nearest that has enough, or else of all texts
    for b in np.flatnonzero(np.isnan(floor)):
        floor[b] = floor[known[np.abs(known - b).argmin()]] if len(known) else SLACK * np.median(best)
    return Model(tuple(langs), idf, centroids, floor)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (the cosine, 0 to 1) and rejected to every row; other columns stay.

    ``und`` with score 0, rejected, where the text is null or has no letter, or nothing was learnt.
    Only the text is read. Clashing names: columns lang_pred, score, rejected of the input are replaced.
    """
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    keep = docs.drop("lang_pred", "score", "rejected")
    schema = StructType(list(keep.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    names = np.array([*model.langs, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            pred, score, out = [], [], []
            for lo, hi in few(texts):
                cleaned = [clean(t) for t in texts[lo:hi]]
                n, total = counts(cleaned)
                if len(model.centroids):
                    sim = vectors(n, model.idf) @ model.centroids.T
                    at, top = sim.argmax(1), np.clip(sim.max(1).astype(float), 0.0, 1.0)
                else:
                    at, top = np.full(hi - lo, -1), np.zeros(hi - lo)
                none = np.array([not t for t in cleaned])
                at, top = np.where(none, -1, at), np.where(none, 0.0, top)
                pred += list(names[at])
                score += top.tolist()
                out += (none | (at < 0) | (top < model.floor[np.log2(np.maximum(total, 1)).astype(int)])).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    return keep.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """From the rows of ``docs`` that aren't held out."""
    return fit(docs.filter(~held_out(F.col("doc_id"))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), train(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
