"""Names, ids, task texts, payloads, rosters and documents over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions import vectors as vec
from parlance.operators import actors, documents, progress, scoring, search, splitting
from parlance.operators import segmentation as sg
from parlance.operators import transcripts as tr
from parlance.plans.meeting_queries import roster
from parlance.plans.registry import query, table
from parlance.plans.segment_queries import MEETINGS, STOP, meetings
from parlance.plans.transcript_queries import LINES, TURNS, conversation_turns, line_items
from parlance.sources import payloads

# --- texts whose results are known: {n} stands for a number of the row -----------------------------


def forms(spark: SparkSession, sf_dir: str, said: list[str]) -> DataFrame:
    """(o_orderkey, said): one of the texts for every order, with its customer's number."""
    one = F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("o_orderkey") % len(said) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.replace(one, F.lit("{n}"), F.col("o_custkey").cast("string")).alias("said"))


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return "replace('" + str(value).replace("'", "''") + "', '{n}', o_custkey::VARCHAR)"


def forms_sql(known: list[tuple], columns: list[str]) -> str:
    """What every order's text must give."""
    cases = [f"CASE o_orderkey % {len(known)} " + " ".join(f"WHEN {k} THEN {_literal(row[c])}" for k, row in enumerate(known)) + f" END AS {name}" for c, name in enumerate(columns, 1)]
    return f"SELECT o_orderkey, {', '.join(cases)} FROM orders"


# said, name_key, grouping_key, scoring_name, pronoun, vague, organisation, given, initials
NAMES = [
    ("Anh Tra\u0302\u0300n  Sơn{n}", "trần sơn{n}", "trần sơn{n}", "trần sơn{n}", False, False, False, "sơn{n}", "AS"),
    ("UBND Tp. Huế{n}", "ủy ban thành phố huế{n}", "ubnd tp. huế{n}", "ubnd tp. huế{n}", False, False, True, "huế{n}", "UH"),
    ("đồng chí Lê Hà (Sở Y tế) {n}", "lê hà {n}", "đồng chí lê hà (sở y tế) {n}", "lê hà {n}", False, False, False, "{n}", "Đ{n}"),
    ("Sở Y te\u0302\u0301 số{n}", "sở y tế số{n}", "sở y tế số{n}", "sở y tế số{n}", False, False, True, "số{n}", "SS"),
    ("Chúng  tôi", "chúng tôi", "chúng tôi", "chúng tôi", True, True, False, "tôi", "CT"),
    ("mọi người", "mọi người", "mọi người", "mọi người", False, True, False, "người", "MN"),
    ("Ủy ban nhân dân xã{n}", "ủy ban xã{n}", "ủy ban nhân dân xã{n}", "ủy ban nhân dân xã{n}", False, False, True, "xã{n}", "ỦX"),
    ("anh chị An{n}", "chị an{n}", "chị an{n}", "an{n}", False, False, False, "an{n}", "AA"),
]
_NAMES = ["name_key", "grouping_key", "scoring_name", "pronoun", "vague", "organization", "given", "initials"]


@query(forms_sql(NAMES, _NAMES).replace("THEN replace('Đ{n}', '{n}', o_custkey::VARCHAR)", "THEN 'Đ' || left(o_custkey::VARCHAR, 1)"))
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by their keys and kinds, marks apart and together."""
    x = F.col("said")
    made = [tx.name_key(x), tx.grouping_key(x), tx.scoring_name(x), tx.is_pronoun(x), tx.is_vague(x), tx.looks_like_organization(x), tx.given_name(x), tx.initials(x)]
    return forms(spark, sf_dir, [row[0] for row in NAMES]).select("o_orderkey", *[c.alias(n) for c, n in zip(made, _NAMES, strict=True)])


# said, actor, bare task, is an assignment
TASKS = [
    ("giao Hiếu{n} map lại nhãn", "Hiếu{n}", "Map lại nhãn", True),
    ("Giao cho chị Mai{n} cập nhật đặc tả", "Chị Mai{n}", "Cập nhật đặc tả", True),
    ("Ông Bình{n} phải lập tiến độ", "Ông Bình{n}", "Lập tiến độ", False),
    ("giao diện mới số {n} cần sửa", "Hà", "giao diện mới số {n} cần sửa", False),
    ("Phối hợp với Nam{n} tích hợp SMS", "Hiếu", "Phối hợp với Nam{n} tích hợp SMS", False),
    ("Phân công Lan{n} soạn thảo", None, "Lan{n} soạn thảo", True),
    ("giao Hà{n}", "Hà{n}", "giao Hà{n}", True),
]


@query(forms_sql([(a, b, c) for a, _, b, c in TASKS], ["bare_text", "is_assignment"]))
def task_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task texts without who does them, and whether a text only hands out a task."""
    rows = forms(spark, sf_dir, [row[0] for row in TASKS]).join(forms(spark, sf_dir, [row[1] or "" for row in TASKS]).withColumnRenamed("said", "actor"), "o_orderkey")
    return splitting.with_bare_task(rows.withColumn("actor", F.nullif("actor", F.lit(""))), "said", "actor").select("o_orderkey", "bare_text", tx.is_assignment_point(F.col("said")).alias("is_assignment"))


# said, bare id, cited ids, number at the end
IDS = [
    ("[T{n}|Lê Hà]", "T{n}", "", "{n}"),
    ("<{n}>", "{n}", "", "{n}"),
    (" x{n} ", "x{n}", "", "{n}"),
    ("TURN_000012 và TURN_000003, TURN_000012 ({n})", "TURN_000012 và TURN_000003, TURN_000012 ({n})", "TURN_000012,TURN_000003", "{n}"),
    ("[ seg {n} ]", "seg {n}", "", "{n}"),
    ("không số", "không số", "", None),
]


@query(forms_sql(IDS, ["bare", "cited", "number"]))
def citation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids without decoration, ids that a text cites, and the number at its end."""
    x = F.col("said")
    return forms(spark, sf_dir, [row[0] for row in IDS]).select("o_orderkey", tx.bare_id(x).alias("bare"), F.array_join(tx.cited_ids(x), ",").alias("cited"), tx.trailing_number(x).cast("string").alias("number"))


SAID_DUE = [("nộp báo cáo số {n} (hạn: thứ Sáu).", "thứ Sáu", "nộp báo cáo số {n}"), ("nộp (hạn chót: 15/11) báo cáo {n}", "15/11", "nộp (hạn chót: 15/11) báo cáo {n}"), ("nộp {n} (Deadline: mai)", None, "nộp {n} (Deadline: mai)")]


@query(forms_sql([(a, b) for a, _, b in SAID_DUE], ["text"]))
def deadline_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task texts without the deadline at their end where it is held apart."""
    raw = F.element_at(F.array(*[F.lit(r) for _, r, _ in SAID_DUE]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return forms(spark, sf_dir, [row[0] for row in SAID_DUE]).select("o_orderkey", tx.without_deadline_echo(F.col("said"), raw).alias("text"))


# --- tokens ----------------------------------------------------------------------------------------

_SIMILAR = "[" + ", ".join(f"'{w}'" for w in (*tx.SIMILARITY_STOPWORDS, *STOP)) + "]"
CONTENT = f"""{TURNS}, w AS (SELECT meeting_id, turn_no, list_distinct(list_filter(regexp_extract_all(lower(nfc_normalize(replace(text_exact, 'é', 'e' || chr(769)))), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: len(x) > 1 AND NOT list_contains({_SIMILAR}, x))) AS w FROM turns)"""


def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = F.replace(F.col("text_exact"), F.lit("é"), F.lit("e\u0301"))
    return conversation_turns(spark, sf_dir).select("meeting_id", "turn_no", tx.content_tokens(apart, (*tx.SIMILARITY_STOPWORDS, *STOP)).alias("w"))


@query(f"WITH {CONTENT} SELECT meeting_id, turn_no, len(w)::INT AS n_tokens, array_to_string(list_sort(w), ' ') AS tokens FROM w")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content words of every turn, from texts with marks apart."""
    return content_words(spark, sf_dir).select("meeting_id", "turn_no", F.size("w").alias("n_tokens"), F.array_join(F.array_sort("w"), " ").alias("tokens"))


@query(
    f"""WITH {CONTENT}, p AS (SELECT a.meeting_id, a.turn_no AS a, b.turn_no AS b, a.w AS x, b.w AS y, len(list_intersect(a.w, b.w)) AS k FROM w a JOIN w b ON a.meeting_id = b.meeting_id AND b.turn_no > a.turn_no)
SELECT meeting_id, a, b, len(x) > 0 AND len(y) > 0 AND k >= 0.45 * len(list_distinct(list_concat(x, y))) AND k >= 0.7 * least(len(x), len(y)) AS same FROM p"""
)
def same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two turns of a conversation say the same thing."""
    w = content_words(spark, sf_dir)
    later = w.select("meeting_id", F.col("turn_no").alias("b"), F.col("w").alias("y"))
    pairs = w.select("meeting_id", F.col("turn_no").alias("a"), F.col("w").alias("x")).join(later, "meeting_id").filter("b > a")
    return pairs.select("meeting_id", "a", "b", tx.same_content(F.col("x"), F.col("y")).alias("same"))


# --- payloads --------------------------------------------------------------------------------------


def _json(*names: str, **given: Column) -> Column:
    return F.to_json(F.struct(*names, *[c.alias(n) for n, c in given.items()]))


def conversation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a payload: native, of speech recognition, or legacy, in turn."""
    i = table(spark, sf_dir, "conversations").withColumn("id", F.concat(F.lit("i"), "turn"))
    native = F.struct("id", "text", F.col("role").alias("speaker"), F.lit("Chair").alias("speaker_role"), (F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000 + 900).alias("end_ms"), F.when(F.col("turn") % 2 == 0, F.struct(F.lit("").alias("text"), F.lit("R").alias("speaker"))).alias("review"))
    export = F.struct(F.col("turn").alias("id"), F.col("text").alias("segment"), F.col("role").alias("speaker_name"), (F.col("turn") + 0.2504).alias("start_time"), (F.col("turn") + 0.75).alias("end_time"), F.array(F.lit("S1"), F.lit("S1"), F.lit("S2")).alias("ref_id"))
    legacy = F.struct("id", F.col("role").alias("speaker_raw"), "text", F.when(F.col("conv_id") % 2 == 0, 0.0).otherwise(F.col("turn") * 2.0).alias("t_start"))
    ordered = lambda s: F.transform(F.array_sort(F.collect_list(F.struct("turn", s.alias("x")))), lambda y: y["x"])
    rows = i.groupBy("conv_id").agg(ordered(native).alias("a"), ordered(export).alias("b"), ordered(legacy).alias("c"))
    key = F.col("conv_id").cast("string")
    said = F.when(F.col("conv_id") % 3 == 0, _json(meeting_id=key, revision_id=F.lit("r2"), items=F.col("a"))).when(F.col("conv_id") % 3 == 1, _json(transcript=F.lit("x"), full_text=F.lit("x"), metadata=F.struct(key.alias("meeting_id")), items=F.col("b")))
    return rows.select(key.alias("source"), said.otherwise(_json(meeting=F.struct(key.alias("session_number")), turns=F.col("c"))).alias("payload"))


@query(
    """WITH z AS (SELECT *, conv_id % 3 AS k, max(CASE WHEN conv_id % 2 = 0 THEN 0 ELSE turn END) OVER (PARTITION BY conv_id) > 0 AS known, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
SELECT CASE k WHEN 0 THEN 'native' WHEN 1 THEN 'stt_export' ELSE 'legacy' END AS format, conv_id::VARCHAR AS meeting_id, CASE k WHEN 0 THEN 'r2' WHEN 1 THEN 'export-0' ELSE '0' END AS revision_id, pos::INT AS pos, CASE k WHEN 1 THEN turn::VARCHAR ELSE 'i' || turn END AS item_id, text, role AS speaker,
CASE k WHEN 1 THEN 'S1' END AS speaker_track, CASE k WHEN 0 THEN turn * 1000 WHEN 1 THEN turn * 1000 + 250 ELSE CASE WHEN known THEN CASE WHEN conv_id % 2 = 0 THEN 0 ELSE turn * 2000 END END END AS start_ms, CASE k WHEN 0 THEN turn * 1000 + 900 WHEN 1 THEN turn * 1000 + 750 END AS end_ms,
CASE k WHEN 1 THEN 'S1,S2' ELSE '' END AS refs, CASE WHEN k = 0 AND turn % 2 = 0 THEN '' END AS reviewed_text, CASE WHEN k = 0 AND turn % 2 = 0 THEN 'R' END AS reviewed_speaker FROM z"""
)
def parsed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of payloads in three formats."""
    out = payloads.strict(payloads.parse_transcripts(conversation_payloads(spark, sf_dir)))
    return out.select("format", "meeting_id", "revision_id", "pos", "item_id", "text", "speaker", "speaker_track", "start_ms", "end_ms", F.array_join("ref_ids", ",").alias("refs"), "reviewed_text", "reviewed_speaker")


def roster_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers and suppliers of every nation as rosters."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    p = c.groupBy(F.col("c_nationkey").alias("meeting_id")).agg(F.collect_list(F.struct(F.concat(F.lit("P"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("full_name"), F.col("c_mktsegment").alias("position"))).alias("people"))
    o = s.groupBy(F.col("s_nationkey").alias("meeting_id")).agg(F.collect_list(F.struct(F.concat(F.lit("O"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.lit("a"), F.col("s_nationkey").cast("string")).alias("aliases"))).alias("organizations"))
    return p.join(o, "meeting_id", "full_outer").select("meeting_id", _json("people", "organizations").alias("payload"))


@query(
    """SELECT c_nationkey AS meeting_id, 'P' || c_custkey AS ref_id, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS name, c_mktsegment AS more, CASE WHEN c_custkey % 9 = 0 THEN 'no name' ELSE '' END AS errors FROM customer
UNION ALL SELECT s_nationkey, 'O' || s_suppkey, s_name, 'a,' || s_nationkey, '' FROM supplier"""
)
def parsed_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and organisations of rosters, with what is wrong with each."""
    people, orgs = payloads.parse_rosters(roster_payloads(spark, sf_dir))
    p = people.select("meeting_id", "ref_id", F.col("full_name").alias("name"), F.col("position").alias("more"), F.array_join("errors", ",").alias("errors"))
    return p.unionByName(orgs.select("meeting_id", "ref_id", "name", F.array_join("aliases", ",").alias("more"), F.array_join("errors", ",").alias("errors")))


@query(
    """WITH t AS (SELECT o.*, c_nationkey AS meeting_id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) - 1)::INT AS task_no FROM orders o JOIN customer ON c_custkey = o_custkey)
SELECT meeting_id, task_no, 'T' || o_orderkey AS task_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Ban dự án' WHEN o_orderkey % 5 = 1 THEN 'P99999999' ELSE c_name END AS owner, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE::VARCHAR END AS due,
array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'bad date' END, CASE WHEN o_orderstatus = 'P' THEN 'unknown status' END, CASE WHEN o_orderkey % 5 = 1 THEN 'unknown party P99999999' END], lambda x: x IS NOT NULL), ',') AS errors
FROM t JOIN customer ON c_custkey = o_custkey"""
)
def parsed_agendas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agendas made of orders: owners by code or in words, dates, statuses, and what is wrong with each task."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    task = F.struct(
        F.concat(F.lit("T"), k).alias("id"), F.lit("việc").alias("title"), F.when(k % 5 == 0, "Ban dự án").when(k % 5 == 1, "P99999999").otherwise(F.concat(F.lit("P"), "o_custkey")).alias("owner"),
        F.when(k % 4 == 0, "31/12/2026").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("due"), F.when(F.col("o_orderstatus") == "P", "half").otherwise("done").alias("last_status"),
    )
    rows = o.groupBy(F.col("c_nationkey").alias("meeting_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", task.alias("t")))), lambda x: x["t"]).alias("tasks")).select("meeting_id", _json("tasks").alias("payload"))
    people = c.select(F.col("c_nationkey").alias("meeting_id"), F.concat(F.lit("P"), "c_custkey").alias("ref_id"), F.col("c_name").alias("full_name"))
    none = people.select("meeting_id", "ref_id", F.lit("").alias("name")).limit(0)
    out = payloads.parse_agendas(rows, people, none)
    return out.select("meeting_id", "task_no", "task_id", F.col("owner.name").alias("owner"), F.col("due").cast("string").alias("due"), F.array_join("errors", ",").alias("errors"))


# --- people ----------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT c_nationkey AS meeting_id, 'P' || c_custkey AS ref_id, c_mktsegment || ' ' || c_name || ' ' || (c_custkey % 7) AS name FROM customer), s AS (SELECT DISTINCT meeting_id, CASE WHEN right(ref_id, 1) = '1' THEN upper(name) ELSE 'Khách ' || right(ref_id, 2) END AS speaker FROM p),
k AS (SELECT s.meeting_id, s.speaker, p.ref_id FROM s LEFT JOIN p ON p.meeting_id = s.meeting_id AND lower(p.name) = lower(s.speaker))
SELECT p.meeting_id, p.name, p.ref_id, k.speaker FROM p LEFT JOIN k ON k.meeting_id = p.meeting_id AND k.ref_id = p.ref_id UNION ALL SELECT meeting_id, speaker, NULL, speaker FROM k WHERE ref_id IS NULL"""
)
def people_and_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone of the roster with the label by which they spoke, and speakers whom it lacks."""
    _, people, _ = roster(spark, sf_dir)
    label = F.when(F.col("ref_id").endswith("1"), F.upper("full_name")).otherwise(F.concat(F.lit("Khách "), F.right("ref_id", F.lit(2))))
    return actors.people_and_speakers(people, people.select("meeting_id", label.alias("speaker")).distinct())


@query("SELECT n_nationkey AS meeting_id, 'Bà ' || n_name AS chair, CASE n_nationkey % 3 WHEN 0 THEN upper(n_name) WHEN 1 THEN 'Chủ toạ ' || n_name END AS speaker FROM nation")
def chairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label by which each meeting's chair speaks: by key, by whole words if one fits, else none."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("meeting_id"), F.concat(F.lit("Bà "), "n_name").alias("chair"), "n_name")
    k = F.col("meeting_id") % 3
    says = F.when(k == 0, F.array(F.upper("n_name"), F.concat(F.lit("Phó "), "n_name"))).when(k == 1, F.array(F.concat(F.lit("Chủ toạ "), "n_name"), F.lit("Người khác"))).otherwise(F.array(F.concat(F.lit("Một "), "n_name"), F.concat(F.lit("Hai "), "n_name")))
    return actors.chair_speaker(n.select("meeting_id", "chair"), n.select("meeting_id", F.explode(says).alias("speaker")))


@query("SELECT o_orderkey % 20 AS meeting_id, o_orderkey AS row_id, x.n AS name FROM (SELECT o_orderkey, unnest(CASE o_orderkey % 3 WHEN 0 THEN [{'n': 'Sở Y tế'}, {'n': 'Sở Xây dựng'}] WHEN 1 THEN [{'n': 'Sở Xây dựng'}] ELSE [] END) AS x FROM orders)")
def support_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties of the roster that tasks name in support, clause by clause."""
    said = ["soạn đề án {n}, phối hợp với Sở Xây dựng và Sở Lạ. Sở Công an; PHỐI HỢP Sở Y te\u0302\u0301", "phối hợp với sở xây dựng rà soát số {n}; báo Sở Y tế", "Sở Y tế báo cáo số {n}, không phối hợp"]
    tasks = forms(spark, sf_dir, said).select((F.col("o_orderkey") % 20).alias("meeting_id"), F.col("o_orderkey").alias("row_id"), F.col("said").alias("text"))
    names = tasks.select("meeting_id").distinct().withColumn("name", F.explode(F.array(*[F.lit(n) for n in ("Sở Y tế", "Sở Xây dựng", "Sở Công an")])))
    return actors.support_parties(tasks, names).select("meeting_id", "row_id", "name")


@query(
    """SELECT d.conv_id AS meeting_id, w AS name FROM (SELECT DISTINCT conv_id FROM conversations) d, unnest(['the', 'The of', 'la', 'zzz']) t(w)
WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = d.conv_id AND regexp_matches(' ' || lower(replace(text, chr(10), ' ')) || ' ', '[^\\p{L}\\p{N}_]' || lower(w) || '[^\\p{L}\\p{N}_]'))"""
)
def named_in_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that some turn of their conversation says, as whole words."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text_exact"))
    names = turns.select("meeting_id").distinct().withColumn("name", F.explode(F.array(*[F.lit(w) for w in ("the", "The of", "la", "zzz")])))
    return actors.named_in_meeting(names, turns).select("meeting_id", "name")


# --- turns -----------------------------------------------------------------------------------------


@query(f"WITH {TURNS} SELECT meeting_id, turn_no, string_agg(text_exact, ' ') OVER (PARTITION BY meeting_id ORDER BY turn_no ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS block FROM turns")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the three before it, as one text."""
    rows = conversation_turns(spark, sf_dir).select("meeting_id", "turn_no", F.col("turn_no").alias("pos"), F.col("text_exact").alias("text"))
    return sg.context_blocks(rows, 3).select("meeting_id", "turn_no", "block")


@query(
    f"""WITH {LINES}, d AS (SELECT meeting_id, pos, greatest(500, round_even(len(regexp_split_to_array(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^$', ' '), ' ')) / 2.3 * 1000, 0))::BIGINT AS d, lag(role) OVER w AS b, role, row_number() OVER w AS n FROM items WHERE trim(text) <> '' WINDOW w AS (PARTITION BY meeting_id ORDER BY pos)),
e AS (SELECT meeting_id, pos, d, sum(d + CASE WHEN n = 1 THEN 0 WHEN b = role THEN 300 ELSE 800 END) OVER (PARTITION BY meeting_id ORDER BY pos)::BIGINT AS end_ms FROM d) SELECT meeting_id, pos, end_ms - d AS start_ms, end_ms FROM e"""
)
def synthetic_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up times for lines without any: speaking time by words, pauses by speakers."""
    rows = line_items(spark, sf_dir).filter(F.trim("text") != "").select("meeting_id", "pos", "speaker", "text")
    return tr.synthetic_clock(rows).select("meeting_id", "pos", "start_ms", "end_ms")


@query("SELECT conv_id AS meeting_id, turn, CASE lower(trim(r)) WHEN 'chair' THEN 'chair' ELSE lower(trim(r)) END AS role, CASE WHEN turn % 3 <> 0 THEN role || ' ' || turn END AS speaker FROM (SELECT *, CASE turn % 2 WHEN 0 THEN ' Chair ' ELSE 'Guest' END AS r FROM conversations)")
def speaker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and speakers as they are kept; labels of unknown speakers give none."""
    said = F.when(F.col("turn") % 3 == 0, "Unknown  speaker 0" + "1").otherwise(F.concat_ws("  ", F.lit(""), "role", F.col("turn").cast("string")))
    role = F.when(F.col("turn") % 2 == 0, " Chair ").otherwise("Guest")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), "turn", tr.speaker_role(role).alias("role"), tr.clean_speaker(said).alias("speaker"))


@query(f"WITH {MEETINGS} SELECT meeting_id, pos, round(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 6) AS total, round(1 / (1 + exp(-e[1])), 8) AS first FROM m")
def vector_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of length one, summed, and the sigmoid of their first component."""
    v = F.col("embedding")
    return meetings(spark, sf_dir).select("meeting_id", "pos", F.round(F.aggregate(vec.normalized(v), F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(vec.sigmoid(F.get(v, F.lit(0)).cast("double")), 8).alias("first"))


# --- documents -------------------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT l_orderkey AS owner_id, l_orderkey % 50 AS meeting_id, list_distinct(list(l_partkey % 97)) AS ids FROM lineitem GROUP BY ALL), k AS (SELECT owner_id, meeting_id, unnest(ids) AS id FROM o)
SELECT meeting_id, owner_id, string_agg(id || ':' || coalesce(CASE WHEN id % 5 <> 0 THEN 't' || (id // 3) END, '-'), ',' ORDER BY id % 5 = 0, CASE WHEN id % 5 <> 0 THEN 1000 - id END, id) AS cited FROM k GROUP BY ALL"""
)
def cited_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in the transcript's order, unknown items at the end."""
    line = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("meeting_id"), F.col("l_orderkey").alias("owner_id"), (F.col("l_partkey") % 97).alias("id"))
    owners = line.groupBy("meeting_id", "owner_id").agg(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")).alias("item_ids"))
    known = line.select("meeting_id", "id").distinct().filter("id % 5 <> 0")
    items = known.select("meeting_id", F.col("id").cast("string").alias("item_id"), (F.lit(1000) - F.col("id")).alias("pos"), F.concat(F.lit("t"), F.floor(F.col("id") / 3).cast("string")).alias("turn_id"), F.lit("x").alias("text"), F.lit("s").alias("speaker_id"))
    out = documents.cited(owners, items)
    return out.select("meeting_id", "owner_id", F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["item_id"], F.coalesce(c["turn_id"], F.lit("-")))), ",").alias("cited"))


@query("SELECT conv_id AS meeting_id, role AS speaker, arg_min('s' || turn, turn) AS speaker_id FROM conversations WHERE turn % 3 <> 0 GROUP BY ALL")
def speaker_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id with which each name is first seen."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("role").alias("speaker"), F.when(F.col("turn") % 3 != 0, F.concat(F.lit("s"), F.col("turn"))).alias("speaker_id"), F.col("turn").alias("pos"))
    return documents.speaker_ids(rows)


@query(
    """WITH d AS (SELECT o_custkey % 40 AS meeting_id, 'S' || (o_orderkey % 7) AS segment_id, o_orderkey AS pos FROM orders)
SELECT meeting_id, CASE WHEN segment_id = 'S6' THEN 'other' ELSE segment_id END AS topic, string_agg(pos, ',' ORDER BY pos) AS decisions FROM d GROUP BY ALL"""
)
def decisions_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by topic, those of unknown topics in a bucket of their own."""
    d = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("meeting_id"), F.concat(F.lit("S"), (F.col("o_orderkey") % 7).cast("string")).alias("segment_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("decision_id"), F.lit("x").alias("text"), F.lit(None).cast("string").alias("citations"))
    segments = d.select("meeting_id").distinct().withColumn("segment_no", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("segment_id", F.concat(F.lit("S"), F.col("segment_no").cast("string")))
    out = documents.decisions_data(d, segments).select("meeting_id", F.explode("groups").alias("g"))
    return out.select("meeting_id", F.coalesce("g.bucket", F.concat(F.lit("S"), F.col("g.segment_no").cast("string"))).alias("topic"), F.array_join(F.transform("g.decisions", lambda x: x["decision_id"]), ",").alias("decisions"))


@query(
    """WITH r AS (SELECT l_orderkey % 10 AS meeting_id, (l_partkey % 300)::VARCHAR AS task_id, l_orderkey * 10 + l_linenumber AS pos, CASE l_linenumber % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'reassign' WHEN 2 THEN 'reschedule' ELSE 'follow_up' END AS relation FROM lineitem)
SELECT * FROM r WHERE relation IN ('new', 'follow_up') UNION ALL SELECT meeting_id, task_id, max(pos), arg_max(relation, pos) FROM r WHERE relation NOT IN ('new', 'follow_up') GROUP BY ALL"""
)
def moved_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reassigned and rescheduled tasks folded into one row for each meeting's task: the last."""
    k = F.col("l_linenumber") % 4
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("meeting_id"), (F.col("l_partkey") % 300).cast("string").alias("task_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(k == 0, "new").when(k == 1, "reassign").when(k == 2, "reschedule").otherwise("follow_up").alias("relation"))
    return progress.latest_by_task(rows)


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS shown, CASE WHEN o_orderkey % 2 = 0 THEN 'chưa rõ' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS other FROM orders")
def shown_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as they are shown, and words where there is none."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", documents.shown_date(day).alias("shown"), documents.shown_date(F.when(F.col("o_orderkey") % 2 == 1, day), "chưa rõ").alias("other"))


@query(
    """WITH p AS (SELECT event_id, [{'label': 'commit', 'p': value / 100}, {'label': 'report', 'p': (100 - value) / 100}, {'label': 'other', 'p': 0.04}] AS x FROM events)
SELECT event_id, array_to_string(list_transform(list_sort(list_transform(list_filter(x, lambda e: e.p >= 0.05), lambda e: {'o': -e.p, 'label': e.label})), lambda e: e.label), ',') AS labels FROM p"""
)
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that a judge finds likely enough, the likeliest first."""
    p = F.create_map(F.lit("commit"), F.col("value") / 100, F.lit("report"), (F.lit(100) - F.col("value")) / 100, F.lit("other"), F.lit(0.04))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(scoring.label_distribution(p), lambda x: x["label"]), ",").alias("labels"))


@query(
    """WITH t AS (SELECT conv_id AS session, role AS speaker, count(*) AS n FROM conversations GROUP BY ALL), k AS (SELECT conv_id AS session, role AS speaker, sum(length(text) % 4)::BIGINT AS n FROM conversations GROUP BY ALL),
e AS (SELECT session, sum(t.n)::BIGINT AS n_turns, sum(k.n)::BIGINT AS n_topics, sum(greatest(k.n - t.n, 0))::BIGINT AS excess FROM t JOIN k USING (session, speaker) GROUP BY 1)
SELECT row_number() OVER (ORDER BY excess DESC, session)::INT AS place, * FROM e"""
)
def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with the most topic changes inside turns first."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("role").alias("speaker"), (F.length("text") % 4).alias("n"))
    return documents.session_order(documents.purity(t, t.filter("n > 0").withColumn("x", F.explode(F.sequence(F.lit(1), "n")))))


@query("WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT lang, doc_id, rank::INT AS rank, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INT AS place FROM r WHERE rank <= 5")
def best_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest documents of each language, again in their own order: a top-k report."""
    top = documents.top_points(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), "lang", "n_chars", "doc_id", 5)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")))
    return search.best_first_then_in_order(ranked, "lang", "doc_id").select("lang", "doc_id", "rank", "place")
