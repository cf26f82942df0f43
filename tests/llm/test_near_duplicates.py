"""DartMinHash signatures, and near-duplicate classes against brute force."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from parlance.llm.components import components
from parlance.llm.minhash import dart_signatures, near_duplicates, one_of_each


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def shingle_bag(text):
    seen = defaultdict(int)
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        out.add((tuple(w[i : i + 5]), seen[tuple(w[i : i + 5])]))
        seen[tuple(w[i : i + 5])] += 1
    return out


def brute(rows, of=shingle_set):
    sets = [of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        same = (rows[a][1] or "") == (rows[b][1] or "")
        union = len(sets[a] | sets[b])
        if same or (union and len(sets[a] & sets[b]) / union >= 0.8):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    return sorted((rows[i][0], min(least[find(i)])) for i in range(len(rows)))


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(1, 160))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += [None, "", "  ", "one two", "one two", "one", "la " * 400, "la " * 90]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, -1) for i, t in rows], "doc_id long, text string, class_id int")
    got = near_duplicates(df)
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == brute(rows)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(rows)})


def test_counted_shingles_weigh_as_often_as_they_stand(spark):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randint(0, 400)}" for _ in range(8))
    rows = []
    for _ in range(25):
        lines = [line() for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(1, 4)):
            rows.append((len(rows), " ".join(x for x in lines for _ in range(rng.choice([1, 1, 2, 5])))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, shingle_bag)
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(df, counted=True).collect()) == want != brute(rows)
    assert sorted(r.doc_id for r in one_of_each(df, counted=True).collect()) == sorted({c for _, c in want})


def test_names_of_columns_do_not_clash(spark):
    df = spark.createDataFrame([(5, "a b c d e f", 1, "n", 2, "r", None), (3, "a b c d e f", 4, "m", 5, "s", None)], "doc_id long, text string, _node int, node string, id int, row string, `a.b` int")
    assert [tuple(r) for r in one_of_each(df).collect()] == [(3, "a b c d e f", 4, "m", 5, "s", None)] and one_of_each(df).columns == df.columns


def test_long_texts_are_blocks_of_their_own(spark, monkeypatch):
    from parlance.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_BYTES", 1500)
    rng = random.Random(17)
    base = [f"w{rng.randint(0, 9000)}" for _ in range(150)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9000)}"
        rows.append((i, " ".join(copy)))
    long = " ".join(f"y{i}" for i in range(60_000))
    rows += [(100, long), (101, long + " end"), (102, long[: len(long) // 2])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == brute(rows)


def test_a_family_on_both_sides_of_the_threshold(spark):
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 9000)}" for _ in range(150)]
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9000)}"
        rows.append((i, " ".join(copy)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == brute(rows)


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.class_id, r.class_size) for r in near_duplicates(df).collect())
    assert got == [(False, 2, 2, 3), (False, 2, 2, 3), (False, 3, 3, 2), (False, 4, 3, 2), (True, 0, 2, 3)]
    assert one_of_each(df).count() == 2
    assert near_duplicates(df.limit(0)).count() == 0 and one_of_each(df.limit(0)).count() == 0


def weighted(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


@pytest.mark.parametrize("weights", ["ones", "fractions"])
def test_signatures_agree_as_often_as_texts_are_alike(weights):
    rng = np.random.default_rng(3)
    t, agree, want = 256, [], []
    for _ in range(40):
        keys = rng.integers(0, 1 << 62, 60)
        a = {int(k): 1.0 if weights == "ones" else float(rng.uniform(0.1, 3)) for k in keys[:45]}
        b = {int(k): a.get(int(k), 1.0) if weights == "ones" else float(rng.uniform(0.1, 3)) for k in keys[15:]}
        h = np.array([*a, *b], np.uint64)
        sig = dart_signatures(h, np.array([*a.values(), *b.values()]), np.array([0, len(a), len(a) + len(b)]), t)
        assert (sig < np.iinfo(np.int64).max).all()
        agree.append((sig[0] == sig[1]).mean())
        want.append(weighted(a, b))
    assert abs(np.mean(agree) - np.mean(want)) < 0.02
    assert np.abs(np.array(agree) - np.array(want)).max() < 0.15


def test_signature_of_nothing():
    sig = dart_signatures(np.zeros(0, np.uint64), np.zeros(0), np.array([0, 0]), 8)
    assert (sig == np.iinfo(np.int64).max).all()


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
