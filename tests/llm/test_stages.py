"""The pipeline's stages on odd tables, and operators without SQL against plain versions of themselves."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from parlance.llm import langid, sanitisation, sharding

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)
EXTRA = ["lang_pred", "spans", "_node", "row", "h", "id", "_text", "clean_text", "bucket"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in EXTRA)
EN = "the and of it when came with phoned rest house over there was once a little fox that ran away from home"


def rows_of(bench):
    said = [
        (1, f"{EN} one", "en"), (2, f"{EN} one", "en"), (2, f"{EN} one", "en"), (None, f"{EN} two went on and on with words", None), (4, None, "en"), (5, "", "en"), (6, None, None),
        (7, "12 !?", "en"), (8, f"{EN} then {bench} and so on", "en"), (9, f"{EN} mail me@example.org today or never again my friend", "en"), (10, f"{EN} " * 20_000, "en"),
    ]
    said += [(100 + i, f"{EN} {' '.join(f'{c}{i}house' for c in 'abcdefghijklmnop')}", "en") for i in range(30)]
    return [(i, t, lang, None if i == 9 else "s", len(t) if t else None, *(f"{n}{i}" for n in EXTRA)) for i, t, lang in said]


@pytest.fixture(scope="module")
def docs(spark, tables):
    bench = next(r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect() if r.text and len(r.text.split()) > 14)
    return spark.createDataFrame(rows_of(bench), SCHEMA)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows(spark, tables, docs, name):
    out = STAGES[name](spark, docs, tables)
    assert STAGES[name](spark, docs.limit(0), tables).count() == 0
    got = out.collect()
    if name == "packing":
        assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()} and sum(r.n_tokens for r in got) == sum(len((r.text or "").split()) for r in docs.collect())
        assert {r.doc_id for r in got if r.batch is None} == {4, 5, 6}
        return
    assert out.columns == docs.columns
    assert all(getattr(r, c) == f"{c}{r.doc_id}" for r in got for c in ("lang_pred", "spans", "_node", "row", "h", "id", "_text", "clean_text", "bucket"))
    ids = Counter(r.doc_id for r in got)
    every = Counter(r.doc_id for r in docs.collect())
    want = {
        "language id": {k: n for k, n in every.items() if k not in (4, 5, 6, 7)},
        "near duplicates": {k: 1 for k in every if k not in (2, 5, 6)},
        "decontamination": {k: n for k, n in every.items() if k != 8},
        "personal data": every,
    }
    assert ids == want[name]
    if name == "personal data":
        assert all(r.n_chars == len(r.text or "") for r in got) and all(r.text is None for r in got if r.doc_id in (4, 6))
        assert "[EMAIL]" in next(r.text for r in got if r.doc_id == 9)


def test_nothing_to_learn_from_keeps_nothing(spark, tables, docs):
    assert STAGES["language id"](spark, docs.withColumn("lang", F.lit(None).cast("string")), tables).count() == 0


# --- operators against plain versions --------------------------------------------------------------------


def test_language_scores_agree_with_plain_cosines(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = langid.train(docs)
    for r in langid.predict(docs, model).collect():
        clean = re.sub(r"[\W\d_]+", " ", (r.text or "").lower()).strip()
        if not any(c.isalpha() for c in clean):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        raw = f" {clean} ".encode()
        n = Counter(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 % (1 << 32)) >> 19 for i in range(len(raw) - 2))
        v = {f: math.log1p(k) * float(model.idf[f]) for f, k in n.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[f]) for f, x in v.items()) / size for c in model.centroids]
        assert abs(max(cos) - r.score) < 1e-4
        best = {lang for lang, c in zip(model.langs, cos, strict=True) if c > max(cos) - 1e-4}
        assert r.lang_pred in best
        floor = model.floor[int(math.log2(len(raw) - 2))]
        assert abs(max(cos) - floor) < 1e-4 or r.rejected == (max(cos) < floor)


def plain_terms(rows, smooth=1.0, generalise=1.1, remove=1.01):
    """{row: {term: removed}} of [(text, entities, words outside entities)], by the definitions."""
    first, seen = set(), set()
    for i, (text, _, _) in enumerate(rows):
        if text not in seen:
            seen.add(text)
            first.add(i)
    holders = [i for i, (_, e, _) in enumerate(rows) if e]
    total = sum(len(w) for _, e, w in rows if not e) + sum(len(rows[i][2]) for i in holders if i in first)
    n_t = Counter(w for _, e, ws in rows if not e for w in ws) + Counter(w for i in holders if i in first for w in rows[i][2])
    where = defaultdict(list)
    for i in holders:
        for e in rows[i][1]:
            where[e].append(i)
    out = defaultdict(dict)
    for at in where.values():
        n_e = max(1, sum(len(rows[i][2]) for i in at if i in first))
        both = Counter(w for i in at if i in first for w in rows[i][2])
        ic = math.log(total / n_e)
        for t, n in both.items():
            pmi = math.log(n * total / (n_e * (n_t[t] + smooth)))
            if pmi >= ic / generalise - 1e-9:
                for i in at:
                    if t in rows[i][2]:
                        out[i][t] = out[i].get(t, False) or pmi >= ic / remove - 1e-9
    return out


def test_revealing_terms_agree_with_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").coalesce(1)
    got = sorted(sanitisation.sanitise(docs, with_text=False).join(docs, "doc_id").collect())
    rows = []
    for r in got:
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k != "term"]
        value = {"email": str.lower, "ip": str, "card": lambda v: re.sub(r"\D", "", v), "phone": lambda v: re.sub(r"\D", "", v)}
        plain = list(r.text or "")
        for _, s, e in spans:
            plain[s:e] = " " * (e - s)
        rows.append((r.text, {f"{k}:{value[k](r.text[s:e])}" for k, s, e in spans}, [w.lower() for w in regex.findall(r"\p{L}+", "".join(plain))]))
    want = plain_terms(rows)
    assert sum(map(len, want.values())) > 5
    for i, r in enumerate(got):
        plain = r.text or ""
        found = {plain[int(s) : int(e)].lower() for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}
        assert found == set(want.get(i, {})), r.doc_id


def test_placement_agrees_with_plain_draws(spark):
    tree = sharding.balanced_tree(8)
    tree = tuple(sharding.Leaf(x.shard, x.region, x.rack, 1 + x.shard / 4) for x in tree)

    def draw(key, path, weight):
        h = xxhash.xxh64_intdigest(path.encode(), seed=xxhash.xxh64_intdigest(key.encode(), seed=42))
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    def place(key, leaves, path="r", of=("region", "rack", "shard")):
        weight = defaultdict(float)
        for x in leaves:
            weight[getattr(x, of[0])] += x.weight
        best = min(sorted(weight), key=lambda c: draw(key, f"{path}/{c}", weight[c]) if len(weight) > 1 else 0)
        inside = [x for x in leaves if getattr(x, of[0]) == best]
        return place(key, inside, f"{path}/{best}", of[1:]) if len(of) > 1 else best

    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(400)], "doc_id long, text string")
    got = sharding.assign_shards(df, tree).collect()
    for r in got:
        assert (r.shard, r.grown_shard) == (place(str(r.doc_id), tree), place(str(r.doc_id), sharding.grow(tree)))
    assert np.bincount([r.shard for r in got]).sum() == 400
