"""Language id, decontamination, personal data, pages, packing, sharding and neighbours on small rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import ann, decontamination, html_text, langid, packing, sanitisation, sharding
from parlance.llm.queries import oracle_sql, queries

# --- language id -----------------------------------------------------------------------------------


def test_held_out_accuracy(spark, tables):
    got = queries()["op7_language_id"](spark, tables).join(spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 200
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert ((got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)) == got.held_out).all()
    assert got.score.between(0, 1).all()


def test_language_of_nothing(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([(None, "en"), ("", "en"), ("12 !?", "en"), ("²", "fr"), ("the cat", None), ("the and of it the", "en"), ("le la les des et", "fr"), ("été", "fr")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df)
    assert set(model.langs) == {"en", "fr"}
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in range(4))
    assert [got[i].lang_pred for i in (5, 6, 7)] == ["en", "fr", "fr"]
    assert langid.predict(df, langid.fit(df.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(df.limit(0), model).count() == 0


def test_every_one_of_many_languages_is_learnt(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    own = {f"l{i:03}": [word() for _ in range(4)] for i in range(300)}
    rows = [(7 * i + k, " ".join(rng.choices(w, k=30)), name) for i, (name, w) in enumerate(own.items()) for k in range(1 + 4 * (i % 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (4000, 10):
        model = langid.fit(df, most=most)
        assert set(model.langs) == set(own)
    got = langid.predict(df, model).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.99 * len(rows)


def test_long_texts_are_read_whole():
    a, n = langid.counts([langid.clean("the " * 5000 + "été")])
    b, m = langid.counts([langid.clean("the " * 5000)])
    assert n[0] > m[0] and (a != b).any()


def test_unknown_languages_are_rejected_at_any_length(spark):
    rng = random.Random(5)
    say = lambda vocabulary, n: " ".join(rng.choice(vocabulary.split()) for _ in range(n))
    en, fr, ru = "the and of it when came with phoned rest house", "le la les des et une dans pour maison avec", "привет мир жизнь время человек дело рука место слово друг"
    df = spark.createDataFrame([(2 * i + k, say(v, 60), name) for i in range(30) for k, (name, v) in enumerate((("en", en), ("fr", fr)))], "doc_id long, text string, lang string")
    model = langid.fit(df)
    texts = [say(v, n) for n in (1, 3, 60, 20_000) for v in (en, fr, ru)]
    got = sorted(langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect())
    assert [r.rejected for r in got] == [False, False, True] * 4
    assert (model.floor > 0).all() and (langid.fit(df.limit(6)).floor > 0).all()


# --- decontamination ---------------------------------------------------------------------------------


def test_masks_survive_substitutions():
    def hit(n, subs):
        return any(all(p + o not in subs for o in m) for m in decontamination.MASKS for p in range(n - m[-1]))

    assert all(hit(13, set(s)) for s in itertools.combinations(range(13), 2))
    three = [hit(13, set(s)) for s in itertools.combinations(range(13), 3)]
    assert np.mean(three) > 0.99


def test_overlaps(spark):
    rng = random.Random(2)
    w = lambda n: [f"w{rng.randint(0, 9999)}" for _ in range(n)]
    item, short = w(40), w(9)
    sub = list(item)
    for i in (3, 11, 19, 27, 35):
        sub[i] = "zzz"
    docs = [" ".join(w(20) + item + w(5)), " ".join(item).upper() + "!", ", ".join(w(3) + sub), " ".join(item[10:25]), " ".join(item[:8]), " ".join(w(200)), None, "", " ".join(w(5) + short), " ".join(item) * 2]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, None), (4, ""), (5, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminations(df, bench).collect()}
    assert {k for k in got if k[1] == 1} == {(i, 1) for i in (0, 1, 2, 3, 9)} and (8, 2) in got
    assert {k[0] for k in got if k[1] == 5} == {0, 1, 2, 3, 9}
    assert (got[0, 1].start_word, got[0, 1].n_words, got[0, 1].n_match) == (20, 40, 40)
    assert got[2, 1].n_match == 35 and got[3, 1].n_match == 15
    clean = decontamination.decontaminate(df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7]
    assert decontamination.contaminations(df, bench.limit(0)).count() == 0 == decontamination.contaminations(df.limit(0), bench).count()
    assert decontamination.decontaminate(df, bench.limit(0)).count() == 10


def found_in(texts, item, filter_bits=20):
    """The numbers of the texts that overlap one item, without Spark: seeds, diagonals and measuring."""
    row, key, place, mask = decontamination.item_seeds(pa.array([item]))
    there = np.zeros(1 << (filter_bits - 3), np.uint8)
    at = (key >> np.uint64(64 - filter_bits)).astype(int)
    np.bitwise_or.at(there, at >> 3, (1 << (at & 7)).astype(np.uint8))
    own, out = decontamination.tokens(pa.array([item]))[0], set()
    for i, t in enumerate(texts):
        word, _ = decontamination.tokens(pa.array([t], pa.string()))
        hit = {int(p - q) for h, places in decontamination.text_seeds(word, sorted(set(mask.tolist())), there) for k, p in zip(h, places) for q in place[key == k]}
        if hit and decontamination.measure(word, own, np.array(sorted(hit))):
            out.add(i)
    return out


def test_ids_of_any_kind_and_any_number_of_items(spark):
    rng = random.Random(8)
    items = [" ".join(f"t{i}x{k}" for k in range(rng.randint(1, 30))) for i in range(60)]
    bench = spark.createDataFrame([*((f"i{i}", t, 1) for i, t in enumerate(items)), (None, "alone", 1), ("i0", None, 1)], "item_id string, text string, h int")
    docs = [*((f"d{i}", f"before {t} after", "x") for i, t in enumerate(items)), (None, "alone", "y"), (None, None, "z"), ("d1", f"before {items[1]} after", "x")]
    df = spark.createDataFrame(docs, "doc_id string, text string, h string")
    held = decontamination.SMALL
    try:
        for decontamination.SMALL in (held, 0):
            got = sorted(((r.doc_id, r.item_id) for r in decontamination.contaminations(df, bench).collect()), key=repr)
            assert got == sorted([*((f"d{i}", f"i{i}") for i in range(60)), ("d1", "i1"), (None, None)], key=repr)
            left = decontamination.decontaminate(df, bench)
            assert left.columns == df.columns and [tuple(r) for r in left.collect()] == [(None, None, "z")]
    finally:
        decontamination.SMALL = held


def test_overlaps_agree_with_brute_force(spark):
    """Every diagonal of every text and item, over few words, so that seeds collide and repeat."""
    rng = random.Random(9)
    say = lambda n, m: " ".join(rng.choice("abcdefghijkl"[:m]) for _ in range(n))
    items = [say(rng.randint(1, 25), m) for m in (2, 6, 12) for _ in range(6)] + ["a " * 30]
    texts = [say(rng.randint(0, 60), rng.choice((2, 6, 12))) for _ in range(40)] + ["a " * 200, "b " + "a " * 14 + "c"]
    for k in range(12):
        w = items[k].split()
        if len(w) > 10:
            w[rng.randrange(len(w))] = "zz"
        texts.append(f"{say(5, 12)} {' '.join(w)} {say(5, 12)}")
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            a, b = t.split(), item.split()
            need = min(13, -(-4 * len(b) // 5))
            same = [[0 <= p < len(a) and a[p] == x for p, x in enumerate(b, d)] for d in range(-len(b), len(a) + 1)]
            if (m := max((best_stretch(s, need) for s in same if sum(s) >= need), default=0)) >= need:
                want[i, j] = m
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_match for r in decontamination.contaminations(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    # three substitutions in 13 words may escape the masks (1 in 100 ways)
    assert set(got) <= set(want) and all(got[k] <= want[k] for k in got)
    assert sum(got.get(k) == n for k, n in want.items()) >= 0.99 * len(want)


def best_stretch(same, need):
    """The most matches of any window with ``need`` matches that are 0.8 of it."""
    n, sums = len(same), [0, *itertools.accumulate(same)]
    return max((m for a in range(n) for b in range(a + 1, n + 1) if (m := sums[b] - sums[a]) >= need and 5 * m >= 4 * (b - a)), default=0)


def test_stretches_are_the_best_of_all_windows():
    rng = random.Random(6)
    for k in range(2000):
        same = [rng.random() < (0.5, 0.7, 0.8, 0.9)[k % 4] for _ in range(rng.randint(1, 45))]
        a, b, matches = decontamination.stretch(np.array(same))
        assert matches == best_stretch(same, 1) == sum(same[a:b]) and 5 * matches >= 4 * (b - a)
        assert not matches or same[a] and same[b - 1]


def test_every_substitution_that_the_rule_allows_is_found():
    for n, subs in ((11, 2), (12, 2), (14, 1), (15, 3), (16, 3), (20, 4)):
        item = " ".join(f"w{k}" for k in range(n))
        ways = list(itertools.combinations(range(n), subs))
        texts = [" ".join("zz" if k in set(s) else f"w{k}" for k in range(n)) for s in ways]
        assert len(found_in(texts, item)) == len(ways), n


def test_short_items_are_found():
    for n in range(1, 11):
        item = " ".join(f"w{k}" for k in range(n))
        for gone in range(n - -(-4 * n // 5) + 1):
            ways = list(itertools.combinations(range(n), gone))
            texts = [" ".join(["x"] * 3 + ["zz" if k in s else f"w{k}" for k in range(n)] + ["y"] * 9) for s in ways]
            want = {i for i, s in enumerate(ways) if best_stretch([k not in s for k in range(n)], -(-4 * n // 5))}
            assert found_in(texts, item) == want == set(range(len(ways))), (n, gone)
        assert not found_in(["x y z", "", None], item)


# --- personal data ------------------------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def private_texts():
    rng = random.Random(4)
    alphabet = list("a1.2@-+ ()é𝒳\x01\n%_3") + ["4111 1111-1111 1111", "1.2.3.4", "256.1.1.1", "a@b.c", "+1 (212) 555-0100", "@", "..", "378282246310005", "00.0255.1.1"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", "a@b." * 5000, "1" * 50_000, "+" + "1 " * 20_000, "a@b.c_d@e.f", "x" * 100_000]


def test_spans_are_those_of_the_plain_patterns(spark):
    rows = list(enumerate(private_texts()))
    got = {r.doc_id: r for r in sanitisation.sanitise(spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, spans int")).collect()}
    for i, t in rows:
        spans = base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (i, t[:90])
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("term")] == spans
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(s.startswith(k) for s in spans) for k in KINDS]
        if t is not None and not spans:
            assert got[i].clean_text == t


def test_texts_with_very_many_matches(spark):
    many = "a@b.c, 10.0.0.1 und +49 (0) 30 123456; " * 40_000
    rows = [(1, many), (2, "é𝒳" * 300_000 + " a@b.c " + "x" * 300_000 + " 1.2.3.4")]
    got = {r.doc_id: r for r in sanitisation.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_phone) == (40_000,) * 3
    assert got[1].clean_text.replace("[TERM]", "und") == "[EMAIL], [IP] und [PHONE]; " * 40_000
    assert hashlib.sha256(",".join(base(many)).encode()).hexdigest() == got[1].base_sha256
    assert got[2].spans.startswith("email:600001:600006,ip:900008:900015")


def test_sanitised_columns_keep_their_names(spark):
    names = ["_text", "_rid", "_email", "_words", "_term", "_marks", "row", "a.b", "spans"]
    df = spark.createDataFrame([(1, "me a@b.c", *map(str, range(9)))], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = sanitisation.sanitise(df)
    assert out.columns[:10] == ["doc_id", "text", *names[:-1]] and tuple(out.first())[:10] == (1, "me a@b.c", *map(str, range(8)))
    assert out.first().spans.startswith("email:3:8") and sanitisation.sanitise(df, with_text=False).columns[0] == "doc_id"


def test_revealing_terms_go_and_common_ones_stay(spark):
    near = [(i, f"the word{'abcdefgh'[i]} came when Zorblax phoned +1 (212) 555-0100 and the rest{'abcdefgh'[i]} went on") for i in range(8)]
    far = [(100 + i, "the and of it when came the went on phoned rest " * 30) for i in range(20)]
    copies = [(200 + i, "my secret Quux at 10.0.0.1 today") for i in range(6)]
    got = {r.doc_id: r for r in sanitisation.sanitise(spark.createDataFrame(near + far + copies, "doc_id long, text string")).collect()}
    assert got[0].n_term == 1 and "Zorblax" not in got[0].clean_text and "phoned [PHONE]" in got[0].clean_text
    assert got[100].clean_text == far[0][1]
    assert got[200].n_term == 0 and got[200].clean_text == "my secret Quux at [IP] today"  # copies are no evidence
    assert sanitisation.sanitise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def sanitised_rows(spark, rows):
    far = [(100 + i, "the and of it when came with " * 700) for i in range(4)]
    return {r.doc_id: r for r in sanitisation.sanitise(spark.createDataFrame(rows + far, "doc_id long, text string")).collect()}, dict(far)


def test_terms_of_rare_entities_go(spark):
    rows = [(1, "the Zorblax came with jo@x.org when it came"), (2, "the Quux and +1 (212) 555-0100 came"), (3, "it came with Quux and the +1 212 5550100"), (4, "it and the Frob came")]
    got, far = sanitised_rows(spark, rows)
    assert got[1].clean_text == "the [TERM] came with [EMAIL] when it came" and got[1].n_term == 1
    assert got[2].clean_text == "the [TERM] and [PHONE] came" and got[3].n_term == 1
    assert got[4].clean_text == rows[3][1] and all(got[i].clean_text == t for i, t in far.items())


def test_terms_far_from_the_mention_go(spark):
    rows = [(1, "Zorblax came and it came with the and of it when zorblax, with the of it. When: jo@x.org"), (2, "it came with jo@x.org and Zorblax"), (3, None)]
    at = rows[0][1].index("zorblax")
    got, _ = sanitised_rows(spark, rows)
    assert got[1].clean_text == "[TERM] came and it came with the and of it when [TERM], with the of it. When: [EMAIL]"
    assert [s for s in got[1].spans.split(",") if s.startswith("term")] == ["term:0:7", f"term:{at}:{at + 7}"] and got[1].n_term == 2
    assert got[2].clean_text == "it came with [EMAIL] and [TERM]" and got[3].clean_text is None


# --- pages ---------------------------------------------------------------------------------------------


def text_of(page, other=None):
    mine, theirs = (html_text.Page(i, None, "", "", html_text.lines(x)) if x is not None else None for i, x in enumerate((page, other)))
    return html_text.content(mine.lines, html_text.shared_by(mine, theirs)[0])


def test_markup():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>one<br>two  <b>three</b><p>four &lt;x&gt; &eacute;&#x41;<div class='ad'>buy</div><aside>side</aside><ul><li>x<li>y</ul><form>name</form><!-- no --><script>var a='</p>'</script><section id='comments'>bad</section></article><footer>f</footer>"
    assert text_of(page) == "A & B\n\none two three\n\nfour <x> éA\n\nx\n\ny"


def test_regions():
    assert text_of("<body class='no-sidebar'><div class='has-sidebar'><main><p>crumbs</p><article class='post'><p>x</p><article class='comment'><p>c</p></article></article></main></div>") == "x"
    assert text_of("<main><p>a</p><div id='site-nav'>n</div><p>b</p></main><p>out</p>") == "a\n\nb"
    assert text_of("<div role='main'><p>a</p></div><p>out</p>") == "a"
    assert text_of("<article><div class='cookie-notice'>c</div><p>a</p><p hidden>h</p></article>") == "a"


def test_shared_lines_go_where_the_markup_says_nothing():
    a = "<body><div>Site</div><div>Menu</div><p>Own story</p><p>More</p><div>Imprint</div>"
    b = "<body><div>Site</div><div>Menu</div><p>Other story</p><div>Imprint</div>"
    assert text_of(a, b) == "Own story\n\nMore" and text_of(b, a) == "Other story"
    same = "<body><nav>n</nav><article><p>Syndicated</p></article>"
    assert text_of(same, same) == "Syndicated"


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "plain", "<p>unclosed <b>bold", "</div></p>x", "<a title='x>y", "<script>x", "<div " * 2000, "<p>" * 2000 + "x", "&amp", "<p>\xa0</p>"])
def test_broken_markup_does_not_fail(page):
    assert isinstance(text_of(page), str)


def test_longest_common_subsequence():
    rng = random.Random(0)

    def best(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    held = html_text.TRACED
    try:
        for most in (held, 20):
            html_text.TRACED = most
            for _ in range(300):
                a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
                at, bt = html_text.aligned(a, b)
                assert len(at) == best(a, b) and at == sorted(set(at)) and bt == sorted(set(bt))
                assert [a[i] for i in at] == [b[j] for j in bt]
    finally:
        html_text.TRACED = held


def test_very_many_lines_align_in_bounded_memory():
    import tracemalloc

    rng = random.Random(1)
    a = [str(rng.randrange(30_000)) for _ in range(30_000)]
    b = [x for x in a if rng.random() < 0.9] + ["end"]
    tracemalloc.start()
    at, bt = html_text.aligned(a, b)
    assert tracemalloc.get_traced_memory()[1] < 150_000_000
    tracemalloc.stop()
    assert len(at) == len(b) - 1 and [a[i] for i in at] == [b[j] for j in bt]


def test_the_place_that_differs_is_the_content():
    page = lambda i: f"<div class=a><p>entry {i} here</p></div><div class=b><h1>Title {i}</h1><p>{f'story {i} goes on ' * 9}</p></div><div class=c>notice {i % 3}</div>"
    pages = [html_text.Page(i, None, "h", f"/{i}", html_text.lines(page(i))) for i in range(7)]
    for i, _, text, _, _, n, _ in html_text.decided(pages, False, False, False):
        assert text == f"Title {i}\n\n{(f'story {i} goes on ' * 9).strip()}" and n == 4
    # the difference overrules the markup where an article hardly differs
    page = lambda i: f"<article>card</article><div>{f'text {i} ' * 60}</div>"
    pages = [html_text.Page(i, None, "h", f"/{i}", html_text.lines(page(i))) for i in range(4)]
    assert all(text.startswith("text") for _, _, text, *_ in html_text.decided(pages, False, False, False))


def plainly(pages):
    """The whole result for (id, host, path, [(kind, place, line)]) whose lines are unique in their page, without streams."""
    pages = sorted(pages, key=lambda p: (p[1], p[2], p[0]))
    groups = []
    for p in pages:
        mine = [t for _, _, t in p[3]]
        theirs = [t for _, _, t in groups[-1][0][3]] if groups else []
        same = sum(len(t) for t in set(mine) & set(theirs))
        if groups and groups[-1][0][1] == p[1] and same >= 0.95 * max(sum(map(len, mine)), sum(map(len, theirs))):
            groups[-1].append(p)
        else:
            groups.append([p])

    def partner(g, p):
        near = [groups[k][0] for k in (g - 1, g + 1) if 0 <= k < len(groups) and groups[k][0][1] == p[1]]
        prefix = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905, E731
        return max(near, key=lambda q: prefix(p[2], q[2]), default=None)

    def left(g, p):
        q = partner(g, p)
        gone = {t for _, _, t in q[3]} if q else set()  # template lines are in the same order everywhere
        return [x for x in p[3] if x[2] not in gone]

    out = {}
    for g, group in enumerate(groups):
        for p in group:
            mass = {}
            for k in range(g - 2, g + 3):
                if 0 <= k < len(groups) and groups[k][0][1] == p[1]:
                    for kind, place, t in left(g, p) if k == g else left(k, groups[k][0]):
                        mass[kind, place] = mass.get((kind, place), 0) + len(t)
            own = {(kind, place) for kind, place, _ in p[3]}
            if not own:
                out[p[0]] = ""
                continue
            kind, place = max(own, key=lambda x: (mass.get(x, 0) * (64 if x[0] == html_text.ARTICLE else 1 / 64 if x[0] == html_text.NOISE else 1), -(x[0] == html_text.NOISE), x))
            kept = [t for k, _, t in p[3] if k == kind] if kind == html_text.ARTICLE else [t for k, at, t in left(g, p) if (k, at) == (kind, place)]
            out[p[0]] = "\n\n".join(kept)
    return out


def test_pages_agree_with_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        host = rng.choice(["a", "a", "a", "b", "c"])
        story = [f"{w} {i}" for w in rng.sample(["one fine day", "two of them went", "three came back again", "four"], rng.randint(1, 4))]
        body = "<article>" + "".join(f"<p>{x}</p>" for x in story) + "</article>" if rng.random() < 0.4 else "<div class=x>" + "".join(f"<p>{x}</p>" for x in story) + "</div>"
        html = f"<div class=m><p>menu</p><p>menu {rng.randrange(3)}</p></div>{body}<footer>imprint {host}</footer>"
        rows += [(1000 * k + i, f"http://{host}/{rng.randrange(40):02}/{i}", html) for k in range(rng.choice([1, 1, 1, 3]))]
    pages = [(i, u[7], u[8:], [x for x in html_text.lines(h) if x[2]]) for i, u, h in rows]
    want = plainly(pages)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    held, fan = spark.conf.get("spark.sql.shuffle.partitions"), html_text.FAN
    try:
        for n, html_text.FAN in ((1, 4096), (5, 4096), (70, 4), (70, 4096)):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = {r.page_id: r.text for r in html_text.extract(df).collect()}
            assert got == want, n
    finally:
        html_text.FAN = fan
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_given_pages_keep_their_articles_with_the_markup_hidden(spark, tables):
    """The difference alone finds nearly all articles of the given pages; with the markup, all."""
    pages = []
    for r in spark.read.parquet(f"{tables}/pages.parquet").collect():
        host, _, path = (r.url or "").partition("://")[2].partition("/")
        pages.append(html_text.Page(r.page_id, r.url, host, re.sub(r"[?#].*", "", path), html_text.lines(r.html or "")))
    pages.sort(key=lambda p: (p.host, p.path, p.id))
    want = {p.id: "\n\n".join(t for k, _, t in p.lines if k == html_text.ARTICLE and t) for p in pages}
    assert {r[0]: r[2] for r in html_text.decided(pages, False, False, False)} == want
    bare = [html_text.Page(p.id, p.url, p.host, p.path, [(html_text.NEUTRAL, place, t) for _, place, t in p.lines if t]) for p in pages]
    got = {r[0]: r[2] for r in html_text.decided(bare, False, False, False)}
    assert sum(got[i] == want[i] for i in want) >= 0.8 * len(want)


def test_pages(spark):
    rows = [(1, "http://h/a/1", "<p>Top</p><p>one</p>", 0), (2, "http://h/a/2", "<p>Top</p><p>two</p>", 0), (3, None, None, 0), (4, None, "", 0), (5, "http://g/x", "<p>Top</p>", 0), (2, "http://h/a/2", "<p>Top</p><p>two</p>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(df)
    assert got.count() == 6 and html_text.extract(df.limit(0)).count() == 0
    by = {r.page_id: r for r in got.collect()}
    assert by[3].text == by[4].text == "" and by[3].n_chars == 0 and by[5].text == "Top"


def test_copies_and_partition_edges_lose_no_text(spark):
    html = lambda i: f"<p>Top</p><p>Story number {i} of the day</p><p>Imprint</p>"
    rows = [(i, f"http://h/a/{i:03}", html(i)) for i in range(40)]
    rows += [(7, "http://h/a/007", html(7)), (107, "http://h/a/007?print=1", html(7)), (39, "http://h/a/039", html(39)), (300, "http://g/x", html(1)), (301, "http://g/x", html(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = html_text.extract(df).collect()
            assert len(got) == len(rows)
            for r in got:
                want = f"Story number {r.page_id % 100} of the day" if r.page_id < 300 else "Top\n\nStory number 1 of the day\n\nImprint"
                assert r.text == want and (r.partner_id is None) == (r.page_id >= 300), (n, r)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


# --- packing -------------------------------------------------------------------------------------------


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        hist = {rng.randint(1, 30): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        lengths, k = sorted(hist), rng.randint(1, 4)
        pad = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist.items())  # noqa: E731, B023
        best = min(pad([*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
        assert pad(packing.optimal_bounds(hist, k)) == best
    assert packing.optimal_bounds({}, 4) == [] and packing.optimal_bounds({5: 2}, 4) == [5]


def test_packed_rows(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 50), 1) for i in range(200)] + [(500, None, 1), (501, "", 1), (502, " \n ", 1), (503, "x " * 1000, 1), (None, "a b", 1), (7, "a b c", 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, bucket int"), max_len=64, n_buckets=4, budget=256).collect()
    words = lambda t: len((t or "").split())
    assert sum(r.n_tokens for r in got) == sum(words(t) for _, t, _ in rows)
    assert len([r for r in got if r.doc_id == 503]) == 16
    full = [r for r in got if r.bucket is not None]
    assert len(got) - len(full) == sum(words(t) == 0 for _, t, _ in rows)
    for (_b, _n), group in itertools.groupby(sorted(full, key=lambda r: (r.bucket, r.batch)), key=lambda r: (r.bucket, r.batch)):
        group = list(group)
        assert len(group) * group[0].bucket_len <= 256 and sorted(r.position for r in group) == list(range(len(group)))
        assert all(r.n_tokens <= r.bucket_len for r in group)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing_of_ids_with_a_stride_and_of_null_ids(spark):
    rows = [(1024 * i if i % 3 else None, "w " * (1 + i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    slices = df.select(packing.slice_of(F.col("doc_id"), F.lit(0).cast("long"), F.lit(1).cast("long")).alias("s"), "doc_id").filter("doc_id is not null")
    assert slices.select("s").distinct().count() > 800
    view = duckdb.from_df(df.toPandas().astype({"doc_id": "Int64"})) if hasattr(duckdb, "from_df") else None
    got = sorted(map(tuple, packing.pack(df, max_len=7, n_buckets=3, budget=14).collect()), key=repr)
    c = duckdb.connect()
    c.register("docs", view.df() if view is not None else df.toPandas())
    c.sql("CREATE TABLE t AS SELECT doc_id::BIGINT AS doc_id, text FROM docs")
    want = sorted(c.sql(packing.packing_sql("t", 7, 3, 14)).fetchall(), key=repr)
    assert got == want


def test_packing_agrees_with_sql(spark, tables):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    mine = queries()["op3_packing"](spark, tables)
    theirs = duck.sql(oracle_sql()["op3_packing"])
    order = [theirs.columns.index(c) for c in mine.columns]
    assert sorted(map(tuple, mine.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in theirs.fetchall()), key=str)


# --- sharding ------------------------------------------------------------------------------------------


def test_shards(spark, tables):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    got = queries()["op10_sharding"](spark, tables).collect()
    assert len(got) == len(docs) and {r.law for r in got} == {"key"}
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_movement_stays_where_weights_change(spark):
    tree = sharding.balanced_tree(8)
    heavier = tuple(sharding.Leaf(x.shard, x.region, x.rack, 3.0 if x.shard == 5 else x.weight) for x in tree)
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    rows = sharding.place(sharding.place(sharding.place(rows, tree, F.col("doc_id"), "a"), heavier, F.col("doc_id"), "b"), sharding.grow(tree), F.col("doc_id"), "c")
    got = rows.collect()
    counts = np.bincount([r.a for r in got], minlength=8)
    assert abs(counts / 2500 - 1).max() < 0.08
    assert abs(np.bincount([r.b for r in got])[5] / 6000 - 1) < 0.08
    assert all(r.a // 4 == 0 and r.b // 4 == 1 or r.a // 4 == r.b // 4 for r in got if r.a != r.b)  # never into the other region
    assert all(r.b // 2 == 2 for r in got if r.a != r.b and r.a // 4 == 1)  # inside the region only into the rack
    assert all(r.c == 8 for r in got if r.c != r.a) and abs(sum(r.c == 8 for r in got) / (20_000 / 9) - 1) < 0.1


def test_shards_of_odd_rows(spark):
    rows = [(None, None), (None, None), (1, ""), (1, ""), (2, "é")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), sharding.balanced_tree(3)).collect()
    assert sorted(r.size for r in got) == [1, 1, 1, 1, 3] and len({(r.shard, r.slot) for r in got}) == 5
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string"), sharding.balanced_tree(3)).count() == 0


# --- nearest neighbours ----------------------------------------------------------------------------------


def brute_nearest(ids, x, i, k):
    s = x @ x[i]
    ok = ids != ids[i]
    order = np.lexsort((ids[ok], -s[ok]))[:k]
    return list(zip(ids[ok][order], s[ok][order], strict=True))


def test_recall(spark, tables):
    rows = spark.read.parquet(f"{tables}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    got = queries()["op5_nearest_neighbours"](spark, tables).toPandas()
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, [x[list(ids).index(v)] @ x[i] for v in mine.vec_id], rtol=0, atol=1e-12)
        hits += len(set(mine.vec_id) & {v for v, _ in brute_nearest(ids, x, i, 20)})
        total += 20
    assert hits / total >= 0.95


def test_the_graph_scores_a_part_of_its_nodes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9000, 24))
    order, levels = ann.build(ann.augmented(x))
    graph, q = ann.augmented(x[order]), rng.normal(size=(64, 24))
    flat = np.concatenate([q, np.zeros((64, 1))], 1).astype(np.float32)
    tally = []
    got, _ = ann.beam(levels[0], graph, flat, ann.descend(levels[1:], graph, flat), ann.EF_SEARCH, tally=tally)
    exact = np.argsort(-(q @ x[order].T), 1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(got, exact)]) >= 0.9
    assert sum(tally) / 64 < 0.5 * len(x)


def test_recall_over_several_shards_and_groups_of_queries(spark, tables, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 8)
    monkeypatch.setattr(ann, "BLOCKS_PER_TASK", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), shard_rows=300).collect()
    score = x[::20] @ x.T
    score[np.arange(60), np.arange(0, 1200, 20)] = -np.inf
    want = {(20 * q, int(i)) for q, row in enumerate(np.argsort(-score, 1)[:, :20]) for i in row}
    assert len(got) == 1200 and len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.95 * len(want)


def test_huge_components_are_found_alike(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4))
    near = []
    for f in (1.0, 1e150, 1e-150):
        df = spark.createDataFrame([(i, (v * f).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        near.append(sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, df, k=3).collect()))
    assert near[0] == near[1] == near[2]


def test_equal_vectors_small_shards_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * rng.uniform(0.5, 2, (300, 1))
    x[50:200] = x[0]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    bad = [(900, None, "x"), (901, [0.0] * 8, "x"), (902, [float("nan")] * 8, "x"), (903, [float("inf")] + [1.0] * 7, "x"), (904, [None] + [1.0] * 7, "x"), (905, [], "x"), (906, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank string")
    got = ann.nearest(df, df.filter("vec_id % 30 = 0 or vec_id >= 900"), k=20, shard_rows=64, ef=64).toPandas()
    assert set(got.query_id) == set(range(0, 300, 30))
    ids, hits = np.arange(300), 0
    for q, mine in got.groupby("query_id"):
        want = brute_nearest(ids, x, q, 20)
        hits += len(set(mine.vec_id) & {v for v, _ in want})
        assert len(mine) == 20 and q not in set(mine.vec_id)
    assert hits / (20 * got.query_id.nunique()) > 0.97
    few = df.filter("vec_id in (1, 2, 3)")
    assert ann.nearest(few, few, k=20).count() == 6
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------


def test_pipeline_by_stages(spark, tables):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, tables), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= 0.98 * counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    left = docs.collect()
    assert not any(b in r.text for r in left for b in bench) and not any(base(r.text) for r in left)
    assert all(r.n_chars == len(r.text) for r in left)
    got = corpus_pipeline.run(spark, tables)
    assert got.select("doc_id").distinct().count() == counts[4]
    assert got.selectExpr("sum(n_tokens) n").first().n == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in left)
