"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Patterns find the protected entities (e-mail addresses, IP addresses, card and phone numbers).
The documents that mention an entity are its context, copies of one document being one; over the
whole corpus a word position lies in the context of an entity ``e`` with probability p(e), is the
term ``t`` with p(t), and both with p(e, t). A term reveals an entity as strongly as their
pointwise mutual information says, which is at most the entity's own information content
``IC(e) = -log p(e)``. A term is counted ``smooth`` times more than it was seen, so few sightings
are weak evidence: a term seen once, in the context, reveals an entity only if the context is
small enough a part of the corpus (one in 2048 words by default). In the documents of an entity,
terms with ``PMI(e, t) >= IC(e) / generalise`` are generalised wherever they stand, and those that
come near to IC(e) itself (``IC(e) / remove``) are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import materialize

SMOOTH, GENERALISE, REMOVE = 1.0, 1.1, 1.01

# The kinds in their order, with their patterns. Possessive, and starting only where a
# leftmost match can start, so that they take linear time; they match what the plain ones match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_MARK = "\x01"
_GUARD = {"email": "contains(_text, '@')", "ip": "_text rlike r'[0-9][.][0-9]'", "card": "_text rlike r'[0-9][ -]?[0-9]'", "phone": "contains(_text, '+')"}
_DIGITS = "regexp_replace({v}, r'[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, k) -> a + CASE WHEN k % 2 = 1 THEN cast(substr(d, length(d) - k + 1, 1) AS int)"
    " ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substr(d, length(d) - k + 1, 1) AS int) + 1) END) % 10 = 0"
)
_VALID = {
    "email": "true",
    "ip": "forall(split({v}, r'[.]'), o -> o rlike r'^0*(?:[0-9]{{1,2}}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')",
    "card": f"exists(array({_DIGITS}), d -> length(d) BETWEEN 16 AND 19 AND {_LUHN})",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}
_VALUE = {"email": "lower({v})", "ip": "{v}", "card": _DIGITS, "phone": _DIGITS}
_NONE = "cast(array() AS array<struct<s: int, e: int, v: string>>)"


_SLICE, _CHUNK = 512, 4096  # parts and characters that are gone through at once, so that long texts take linear time


def _matches(p: str, want: Callable[[str], str], made: Callable[[str, str], str]) -> str:
    """SQL of an array of every second part ``i`` of the array ``p`` that is wanted, made of it and of where it begins.

    Running sums are kept within slices; those of whole slices are summed first.
    """
    sums = f"transform(sequence(0, (size({p}) - 1) div {_SLICE}), g -> aggregate(slice({p}, g * {_SLICE} + 1, {_SLICE}), 0, (a, x) -> a + length(x)))"
    begins = f"aggregate({sums}, named_struct('at', 0, 'out', cast(array() AS array<int>)), (a, n) -> named_struct('at', a.at + n, 'out', concat(a.out, array(a.at))), a -> a.out)"
    within = (
        f"aggregate(sequence(g * {_SLICE}, least((g + 1) * {_SLICE}, size({p})) - 1), named_struct('at', b, 'out', filter(array({made('0', '0')}), x -> false)), "
        f"(a, i) -> named_struct('at', a.at + length({p}[i]), 'out', CASE WHEN i % 2 = 1 AND ({want('i')}) THEN concat(a.out, array({made('a.at', 'i')})) ELSE a.out END), a -> a.out)"
    )
    return f"flatten(transform({begins}, (b, g) -> {within}))"


def _put(text: str, marks: str, instead: Callable[[str], str]) -> str:
    """SQL of the text with something instead of each of the sorted marks ``m`` (s, e), given where those before it end."""
    ends = f"transform(sequence(0, (size({marks}) - 1) div {_SLICE}), g -> array_max(transform(slice({marks}, g * {_SLICE} + 1, {_SLICE}), m -> m.e)))"
    begins = f"aggregate({ends}, named_struct('at', 0, 'out', cast(array() AS array<int>)), (a, n) -> named_struct('at', greatest(a.at, n), 'out', concat(a.out, array(a.at))), a -> a.out)"
    piece = lambda lo, hi: f"substring(array_join(slice(k, {lo} div {_CHUNK} + 1, ({hi}) div {_CHUNK} - {lo} div {_CHUNK} + 1), ''), {lo} % {_CHUNK} + 1, greatest({hi} - {lo}, 0))"
    own = f"concat({piece('a.at', 'greatest(m.s, a.at)')}, {instead('a.at')})"
    within = f"aggregate(slice({marks}, g * {_SLICE} + 1, {_SLICE}), named_struct('at', b, 'out', cast(array() AS array<string>)), (a, m) -> named_struct('at', greatest(a.at, m.e), 'out', concat(a.out, array({own}))), a -> a.out)"
    rest = piece(f"array_max(transform({marks}, m -> m.e))", f"length({text})")
    chunks = f"regexp_extract_all({text}, r'(?s).{{1,{_CHUNK}}}', 0)"
    return f"transform(array({chunks}), k -> concat(array_join(flatten(transform({begins}, (b, g) -> {within})), ''), {rest}))[0]"


def _spans(kind: str) -> Column:
    """The valid matches of a kind in column _text: start, end and normalised value."""
    # the text is split at marks put around the matches, so every second part is a match
    made = lambda at, i: f"named_struct('s', {at}, 'e', {at} + length(p[{i}]), 'v', {_VALUE[kind].format(v=f'p[{i}]')})"
    found = _matches("p", lambda i: _VALID[kind].format(v=f"p[{i}]"), made)
    return F.expr(f"CASE WHEN {_GUARD[kind]} THEN transform(array(split(regexp_replace(_text, r'{PATTERNS[kind]}', '{_MARK}$0{_MARK}'), '{_MARK}')), p -> CASE WHEN size(p) > 1 THEN {found} ELSE {_NONE} END)[0] ELSE {_NONE} END")


def _whole(text: str) -> Column:
    return F.translate(F.coalesce(F.col("row")[text], F.lit("")), _MARK, "\x02")  # no pattern has either


def scan(docs: DataFrame, text: str) -> DataFrame:
    """Every row, as a struct, with _rid, the spans of each kind, and the number of words."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("_rid")).withColumn("_text", _whole(text))
    found = [_spans(kind).alias(f"_{kind}") for kind in PATTERNS]
    return rows.select("row", "_rid", *found, F.regexp_count("_text", F.lit(r"\p{L}+")).alias("_words"))


def _holders(rows: DataFrame) -> DataFrame:
    """The rows with an entity: _rid, entities, _plain (the text, its entities blanked), _size (its words), _first (no copy of an earlier row)."""
    every = F.concat(*[F.transform(f"_{k}", lambda x, k=k: F.concat(F.lit(f"{k}:"), x["v"])) for k in PATTERNS])
    marks = F.sort_array(F.concat(*[F.transform(f"_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in PATTERNS]))
    blank = _put("_text", "_marks", lambda at: f"repeat(' ', greatest(m.e - greatest({at}, m.s), 0))")
    held = rows.withColumn("entities", F.array_distinct(every)).filter(F.size("entities") > 0).withColumn("_marks", marks)
    held = held.select("_rid", "entities", F.expr(blank).alias("_plain"), F.xxhash64("_text").alias("_copy"))
    first = held.groupBy("_copy").agg(F.min("_rid").alias("_rid")).select("_rid", F.lit(True).alias("_first"))
    held = held.withColumn("_size", F.regexp_count("_plain", F.lit(r"\p{L}+")))
    return held.drop("_copy").join(first, "_rid", "left").withColumn("_first", F.coalesce("_first", F.lit(False)))


def _terms(text: str) -> Column:
    return F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\p{L}+"), F.lit(0))).alias("term")


def revealing(rows: DataFrame, held: DataFrame, smooth: float, generalise: float, remove: float) -> DataFrame:
    """(rid, term, removed) of the terms that reveal an entity of the row beyond the thresholds.

    Entities of the same documents are one group, as their terms and figures are the same.
    """
    none = F.size("_email") + F.size("_ip") + F.size("_card") + F.size("_phone") == 0
    n_in = held.select("_rid", "_first", _terms("_plain")).groupBy("_rid", "_first", F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    n_in = materialize(n_in, "terms")
    seen = F.coalesce(F.sum(F.when(F.col("_first"), F.col("n"))), F.lit(0))
    n_out = rows.filter(none).select(_terms("_text")).groupBy(F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("n_out"))
    own = n_in.groupBy("term").agg(seen.alias("n_own")).join(n_out, "term", "left")
    total = (rows.filter(none).agg(F.sum("_words")).first()[0] or 0) + (held.filter("_first").agg(F.sum("_size")).first()[0] or 0) or 1
    # no entity's information content is above log(total), so no other term can reach a threshold
    most = float(total) ** max(0.0, 1 - 1 / generalise)
    n_t = F.col("n_own") + F.coalesce("n_out", F.lit(0)) + F.lit(float(smooth))
    rare = own.withColumn("n_t", n_t).filter(F.col("n_t") <= F.col("n_own") * F.lit(most * 1.000001)).select("term", "n_t")
    mentions = materialize(held.select("_rid", "_first", F.explode("entities").alias("e")), "mentions")
    mark = [F.bit_xor(F.when(F.col("_first"), F.xxhash64("_rid", F.lit(k)))).alias(f"g{k}") for k in (1, 2)]
    groups = mentions.groupBy("e").agg(*mark)
    members = materialize(mentions.join(groups, "e").select("_rid", "_first", "g1", "g2").distinct(), "groups")
    size = members.filter("_first").join(held.select("_rid", "_size"), "_rid").groupBy("g1", "g2").agg(F.greatest(F.sum("_size"), F.lit(1)).cast("double").alias("n_e"))
    pairs = materialize(members.drop("_first").join(n_in.join(rare, "term"), "_rid"), "pairs")
    both = pairs.groupBy("g1", "g2", "term", "n_t").agg(seen.cast("double").alias("n_et"))
    content = F.log(F.lit(float(total)) / F.col("n_e"))
    pmi = F.log(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t")))
    scored = both.join(size, ["g1", "g2"]).withColumn("pmi", pmi).withColumn("ic", content)
    flagged = scored.filter((F.col("n_et") > 0) & (F.col("pmi") >= F.col("ic") / generalise))
    flagged = flagged.select("g1", "g2", "term", (F.col("pmi") >= F.col("ic") / remove).alias("removed"))
    return pairs.join(flagged, ["g1", "g2", "term"]).groupBy("_rid", "term").agg(F.max("removed").alias("removed"))


def _places(held: DataFrame, flagged: DataFrame) -> DataFrame:
    """(rid, _term): every place of the flagged terms of each row."""
    one = F.collect_list(F.when(F.col("removed"), F.col("term"))).alias("gone"), F.collect_list(F.when(~F.col("removed"), F.col("term"))).alias("general")
    rows = flagged.groupBy("_rid").agg(*one).join(held.select("_rid", "_plain"), "_rid")
    rows = rows.withColumn("p", F.split(F.regexp_replace("_plain", F.lit(r"\p{L}+"), F.lit(f"{_MARK}$0{_MARK}")), _MARK))
    told = lambda i: f"array_contains(gone, lower(p[{i}])) OR array_contains(general, lower(p[{i}]))"
    words = F.expr(_matches("p", told, lambda at, i: f"named_struct('s', {at}, 'e', {at} + length(p[{i}]), 'removed', array_contains(gone, lower(p[{i}])))"))
    return rows.select("_rid", words.alias("_term"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True, smooth: float = SMOOTH, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Every row with n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans and, if asked, clean_text.

    spans lists kind:start:end, by kind (email, ip, card, phone, term) and then start, in code
    points; base_sha256 is of the spans of the patterns alone. clean_text has ``[KIND]`` for
    entities, ``[TERM]`` for generalised terms and nothing for removed ones; overlapping spans go as
    one. Without the text only the key is kept, else all columns; columns of the input with the
    names of these are replaced. Null texts are empty and stay null in clean_text; matches that fail
    their check are dropped and not tried again; repeated rows are treated alike and each counts;
    ties at a threshold are revealing; an empty table gives an empty table; null and repeated keys
    are allowed. Whole texts are searched, in time linear in their length and matches.
    """
    new = [*(f"n_{k}" for k in (*PATTERNS, "term")), "base_sha256", "spans", "clean_text"]
    mine = [c for c in docs.columns if (c not in new if with_text else c == key)]
    kept = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*mine, text])])
    rows = materialize(scan(kept, text), "pii")
    texts = rows.withColumn("_text", _whole(text))
    held = materialize(_holders(texts), "holders")
    terms = _places(held, revealing(texts, held, smooth, generalise, remove))
    any_span = F.size("_email") + F.size("_ip") + F.size("_card") + F.size("_phone") > 0
    none = F.expr("cast(array() AS array<struct<s: int, e: int, removed: boolean>>)")
    some = rows.filter(any_span).join(terms, "_rid", "left").withColumn("_term", F.coalesce("_term", none))
    out = some.unionByName(rows.filter(~any_span).withColumn("_term", none))

    def listed(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    base = F.concat(*[listed(k) for k in PATTERNS])
    for k in (*PATTERNS, "term"):
        out = out.withColumn(f"n_{k}", F.size(f"_{k}").cast("long"))
    out = out.withColumn("base_sha256", F.sha2(F.concat_ws(",", base), 256)).withColumn("spans", F.concat_ws(",", base, listed("term")))
    if with_text:

        def mark(kind: str) -> Column:
            return F.transform(f"_{kind}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("r")))

        marks = [mark(k) for k in PATTERNS]
        marks.append(F.transform("_term", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["removed"], F.lit("")).otherwise(F.lit("[TERM]")).alias("r"))))
        out = out.withColumn("_marks", F.sort_array(F.concat(*marks)))
        put = _put("_whole", "_marks", lambda at: f"CASE WHEN m.s >= {at} THEN m.r ELSE '' END")
        out = out.withColumn("_whole", F.col("row")[text]).withColumn("clean_text", F.when(F.size("_marks") > 0, F.expr(put)).otherwise(F.col("_whole")))
    else:
        new = new[:-1]
    return out.select(*[F.col("row")[c].alias(c) for c in mine], *new)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data, and the terms that reveal it, in every document."""
    out = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")
