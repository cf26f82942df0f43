"""Repeated passages and strings against brute force, on texts made to hold hard cases."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from parlance.llm.common import between, prefix, word_hashes, words
from parlance.llm.packs import GROUP_PACKS, make_packs
from parlance.llm.substrings import repeated_words
from parlance.llm.suffixes import IndexFamily, anchors, repeated_bytes


def texts(seed):
    rng = random.Random(seed)
    w = lambda n: " ".join(rng.choice(["aa", "b", "ccc", "é", "dd"]) + str(rng.randint(0, 99)) for _ in range(n))
    shared, line = w(60), w(36)
    out = [w(rng.randint(1, 120)) for _ in range(12)]
    out += [w(10) + " " + shared + "\n" + w(20), shared + " " + w(5), w(3) + "\t" + shared[:-9], line, line + " " + line, w(40) + " " + line]
    out += ["ab " * 300, "ab " * 90, "x" * 400, "x" * 150, "xy" * 200, w(3000), None, "", "   \n", out[3], out[3], out[0], "a", "é" * 120, "é" * 120]
    out.append(out[12][7:] + " end")
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_words string, kept int")


@pytest.mark.parametrize("seed,window", [(1, 35), (2, 5), (3, 8)])
def test_words(spark, seed, window):
    rows = list(enumerate(texts(seed)))
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    n = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    got = {r.doc_id: r for r in repeated_words(frame(spark, rows), window=window).collect()}
    assert len(got) == len(rows)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if n[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), sum(gone), kept), i
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert r.n_spans == sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))


@pytest.mark.parametrize("seed,window,gram", [(1, 100, 40), (2, 20, 8), (3, 12, 12)])
def test_bytes(spark, seed, window, gram):
    rows = list(enumerate(texts(seed)))
    random.Random(seed).shuffle(rows)
    seen, want = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if b[k : k + window] in seen:
                mask[k : k + window] = b"\1" * window
            seen.add(b[k : k + window])
        want[i] = (len(b), sum(mask), (b"\0" + bytes(mask)).count(b"\0\1"), bytes(x for x, m in zip(b, mask, strict=True) if not m))
    got = {r.doc_id: r for r in repeated_bytes(frame(spark, rows), window=window, gram=gram).collect()}
    for i, (n, removed, spans, kept) in want.items():
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (n, removed, spans, kept), i
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "x" * 200), (None, "x" * 200), (5, "x" * 200), (5, "y"), (5, "y")], "doc_id long, text string")
    got = repeated_bytes(rows)
    assert got.count() == 5
    # of 200 equal bytes the first string of 100 stays unless it is repeated from before; nothing else does
    assert sorted(r.n_removed for r in got.collect()) == [0, 0, 199, 200, 200]
    assert repeated_words(rows).count() == 5


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_words(none).count() == 0
    assert repeated_bytes(none).count() == 0


def test_anchors_are_the_leftmost_least(spark):
    rng = np.random.default_rng(0)
    for n, width in ((40, 7), (9, 9), (30, 1)):
        gram = rng.integers(0, 6, n).astype(np.uint64)
        lo, hi, at = anchors(gram, np.array([0]), np.array([n - width]), width)
        got = {s: int(a) for x, y, a in zip(lo, hi, at, strict=True) for s in range(x, y + 1)}
        assert got == {s: s + int(gram[s : s + width].argmin()) for s in range(n - width + 1)}


def test_index_family_merges_geometrically():
    family, seen = IndexFamily(), set()
    rng = random.Random(0)
    for _ in range(40):
        batch = np.array(sorted({rng.randint(0, 400) for _ in range(10)}), np.uint64)
        assert family.scan(batch).tolist() == [int(x) in seen for x in batch]
        family.add(batch)
        seen |= {int(x) for x in batch}
    sizes = [len(x) for x in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) < 8


def test_packs_of_a_large_partition_stand_in_small_row_groups(spark):
    docs = frame(spark, [(i, f"text {i} " * 20) for i in range(150)]).coalesce(1)
    packs = make_packs(docs, "doc_id", "text", ordered=False, pack_bytes=500)
    files = [pq.ParquetFile(f).metadata for f in Path(packs._parlance_path.removeprefix("file:")).glob("*.parquet")]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) == packs.count() > 5 * GROUP_PACKS
    assert max(groups) <= GROUP_PACKS


def test_hashes_of_words_in_slices():
    raw = np.frombuffer("".join(f"wörd{k % 999} " for k in range(200_000)).encode(), np.uint8)
    starts, ends, _ = words(raw, np.array([0, len(raw)]))
    n = len(raw) // 20
    whole = between(prefix(raw[:n].astype(np.uint64) + np.uint64(1)), starts[ends <= n], ends[ends <= n])
    tracemalloc.start()
    got = word_hashes(raw, starts, ends, size=1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[: len(whole)] == whole).all() and len(np.unique(got)) == 999
    assert len(word_hashes(raw[:0], starts[:0], ends[:0])) == 0
    assert peak < got.nbytes + 2 * len(raw)
