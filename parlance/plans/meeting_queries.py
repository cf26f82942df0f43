"""Actors, progress, relations, deadlines, scoring and documents over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions.dates import normalize_deadline
from parlance.operators import actors, documents, progress, scoring
from parlance.plans.registry import query, table
from parlance.plans.segment_queries import STOP
from parlance.plans.transcript_queries import LINES, TURNS, conversation_turns, line_items
from parlance.sources import payloads

# --- actors -------------------------------------------------------------------------------------


def roster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """People from customers, organisations from suppliers, a meeting per nation; mentions from orders."""
    c = table(spark, sf_dir, "customer")
    name = F.concat_ws(" ", "c_mktsegment", "c_name", (F.col("c_custkey") % 7).cast("string"))
    people = c.select(F.col("c_nationkey").alias("meeting_id"), F.concat(F.lit("P"), "c_custkey").alias("ref_id"), name.alias("full_name"), F.lit(None).cast("string").alias("org_id"))
    s = table(spark, sf_dir, "supplier")
    orgs = s.select(F.col("s_nationkey").alias("meeting_id"), F.concat(F.lit("O"), "s_suppkey").alias("ref_id"), F.concat(F.lit("Sở "), "s_name", F.lit(" N"), "s_nationkey").alias("name"), F.array("s_name").alias("aliases"), F.array().cast("array<string>").alias("functions"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, F.upper(name)).when(k == 1, F.concat_ws(" ", "c_name", (F.col("c_custkey") % 7).cast("string"))).when(k == 2, F.concat(F.lit("Sở Supplier#"), F.lpad((F.col("o_custkey") % 100).cast("string"), 9, "0"))).when(k == 4, (F.col("c_custkey") % 7).cast("string"))
    return o.select(F.col("c_nationkey").alias("meeting_id"), F.col("o_orderkey").alias("mention_id"), said.alias("mention")), people, orgs


CANDIDATES = """p AS (SELECT c_nationkey AS meeting_id, 'P' || c_custkey AS ref_id, c_mktsegment || ' ' || c_name || ' ' || (c_custkey % 7) AS name FROM customer),
o AS (SELECT s_nationkey AS meeting_id, 'O' || s_suppkey AS ref_id, 'Sở ' || s_name || ' N' || s_nationkey AS name, s_name AS alias FROM supplier),
m AS (SELECT c_nationkey AS meeting_id, o_orderkey AS mention_id, CASE o_orderkey % 5 WHEN 0 THEN upper(c_mktsegment || ' ' || c_name || ' ' || (c_custkey % 7)) WHEN 1 THEN c_name || ' ' || (c_custkey % 7)
  WHEN 2 THEN 'Sở Supplier#' || lpad((o_custkey % 100)::VARCHAR, 9, '0') WHEN 4 THEN (c_custkey % 7)::VARCHAR END AS mention FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT *, lower(mention) AS al FROM m WHERE mention IS NOT NULL),
pc AS (SELECT a.meeting_id, mention_id, ref_id, name, 'person' AS kind, CASE WHEN lower(name) = al THEN 1.0 ELSE 0.6 END AS score FROM a JOIN p ON a.meeting_id = p.meeting_id AND (lower(name) = al OR ends_with(lower(name), ' ' || al))),
k AS (SELECT meeting_id, ref_id, name, lower(name) AS key FROM o UNION ALL SELECT meeting_id, ref_id, name, lower(alias) FROM o),
oc AS (SELECT a.meeting_id, mention_id, ref_id, name, 'organization' AS kind, max(CASE WHEN key = al THEN 1.0 ELSE 0.7 END) AS score FROM a JOIN k ON a.meeting_id = k.meeting_id AND (key = al OR (contains(al, ' ') AND (contains(key, al) OR (contains(key, ' ') AND contains(al, key))))) GROUP BY ALL),
uc AS (SELECT meeting_id, mention_id, NULL AS ref_id, mention AS name, 'organization' AS kind, 0.6 AS score FROM a WHERE al LIKE 'sở %' AND NOT EXISTS (SELECT 1 FROM oc WHERE oc.mention_id = a.mention_id AND oc.meeting_id = a.meeting_id)),
cand AS (SELECT * FROM pc UNION ALL SELECT * FROM oc UNION ALL SELECT * FROM uc)"""


@query(f"WITH {CANDIDATES} SELECT meeting_id, mention_id, ref_id, name, kind, score::DOUBLE AS score FROM cand")
def actor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone whom a mention may mean, scored."""
    return actors.candidates(*roster(spark, sf_dir)).select("meeting_id", "mention_id", "ref_id", "name", "kind", "score")


@query(
    f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER w AS rk, round(score - coalesce(lead(score) OVER w, 0), 2) AS ld, count(*) OVER (PARTITION BY meeting_id, mention_id) AS n FROM cand WINDOW w AS (PARTITION BY meeting_id, mention_id ORDER BY score DESC, kind, name, ref_id)),
t AS (SELECT *, score >= 0.6 AND ld >= 0.2 AS ok FROM r WHERE rk = 1)
SELECT m.mention_id, CASE WHEN ok THEN name END AS name, CASE WHEN ok THEN kind ELSE 'unknown' END AS kind, CASE WHEN m.mention IS NULL THEN 'missing' WHEN ok THEN NULL ELSE 'ambiguous' END AS flag, coalesce(n, 0) AS n_candidates FROM m LEFT JOIN t USING (meeting_id, mention_id)"""
)
def actor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clear candidate of each mention; else it is ambiguous or missing."""
    return actors.resolved_by_roster(*roster(spark, sf_dir)).select("mention_id", "name", "kind", "flag", "n_candidates")


@query(
    """WITH x AS (SELECT o_orderkey, o_orderkey % 3 AS meeting_id, CASE o_orderkey % 4 WHEN 0 THEN 'P' || o_custkey WHEN 1 THEN 'O' || (o_custkey % 120) WHEN 2 THEN 'Ban dự án' ELSE 'P999999999' END AS code FROM orders),
p AS (SELECT m AS meeting_id, 'P' || c_custkey AS code, c_name || ' M' || m AS p FROM customer, range(2) t(m)), o AS (SELECT m AS meeting_id, 'O' || s_suppkey AS code, s_name || ' M' || m AS o FROM supplier, range(3) t(m))
SELECT o_orderkey, meeting_id, code, coalesce(p, o, CASE WHEN NOT regexp_matches(code, '^[PO][0-9]+$') THEN code END) AS party_name, CASE WHEN p IS NOT NULL THEN 'person' WHEN o IS NOT NULL THEN 'organization' WHEN regexp_matches(code, '^[PO][0-9]+$') THEN 'unknown code' ELSE 'text' END AS party_kind
FROM x LEFT JOIN p USING (meeting_id, code) LEFT JOIN o USING (meeting_id, code)"""
)
def party_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Party codes of tasks in meetings whose rosters use the same codes: people, then organisations, else text or an unknown code."""
    k = F.col("o_orderkey") % 4
    code = F.when(k == 0, F.concat(F.lit("P"), "o_custkey")).when(k == 1, F.concat(F.lit("O"), (F.col("o_custkey") % 120).cast("string"))).when(k == 2, "Ban dự án").otherwise("P999999999")
    named = lambda c: F.concat(F.col(c), F.lit(" M"), "meeting_id")
    people = table(spark, sf_dir, "customer").withColumn("meeting_id", F.explode(F.array(*[F.lit(m).cast("bigint") for m in range(2)]))).select("meeting_id", F.concat(F.lit("P"), "c_custkey").alias("ref_id"), named("c_name").alias("full_name"))
    orgs = table(spark, sf_dir, "supplier").withColumn("meeting_id", F.explode(F.array(*[F.lit(m).cast("bigint") for m in range(3)]))).select("meeting_id", F.concat(F.lit("O"), "s_suppkey").alias("ref_id"), named("s_name").alias("name"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("meeting_id"), code.alias("code"))
    return actors.resolve_party(rows, "code", people, orgs).select("o_orderkey", "meeting_id", "code", "party_name", "party_kind")


COMPOUND = {
    "Sở Xây dựng chủ trì, phối hợp với anh {n} và Ban Quản lý và Vận hành": [("Sở Xây dựng", "lead"), ("anh {n}", "support"), ("Ban Quản lý và Vận hành", "support")],
    "chị {n}": [("chị {n}", "lead")],
    "Sở A{n}, Sở B phối hợp với Sở C": [("Sở A{n}", "lead"), ("Sở B", "lead"), ("Sở C", "support")],
    "Sở Văn hóa và Thể thao {n}": [("Sở Văn hóa và Thể thao {n}", "lead")],
    "anh Sơn{n} và chị Hà": [("anh Sơn{n}", "joint"), ("chị Hà", "joint")],
    "Sở B (phối hợp); Sở A{n} (chủ trì)": [("Sở B", "support"), ("Sở A{n}", "lead")],
    "  ": [],
}
_PARTS = " ".join(f"WHEN {k} THEN [" + ", ".join(f"{{'m': replace('{m}', '{{n}}', o_custkey::VARCHAR), 'r': '{r}'}}" for m, r in parts) + "]" for k, parts in enumerate(COMPOUND.values()))


@query(f"SELECT o_orderkey, (i - 1)::INT AS mention_no, x[i].m AS mention, x[i].r AS role FROM (SELECT o_orderkey, CASE o_orderkey % {len(COMPOUND)} {_PARTS} END AS x, unnest(range(1, len(x) + 1)) AS i FROM orders)")
def actor_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound actors split into parties with roles."""
    o = table(spark, sf_dir, "orders")
    said = F.element_at(F.array(*[F.lit(c) for c in COMPOUND]), (F.col("o_orderkey") % len(COMPOUND) + 1).cast("int"))
    rows = o.select((F.col("o_orderkey") % 5).alias("meeting_id"), "o_orderkey", F.replace(said, F.lit("{n}"), F.col("o_custkey").cast("string")).alias("actor"))
    names = o.select((F.col("o_orderkey") % 5).alias("meeting_id")).distinct().withColumn("names", F.array(F.lit("Ban Quản lý và Vận hành")))
    return actors.exploded_mentions(rows, names).select("o_orderkey", "mention_no", "mention", "role")


# --- progress -------------------------------------------------------------------------------------

UPDATES = """u AS (SELECT l_orderkey AS task_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS pos, CASE WHEN l_quantity < 5 THEN 'mentioned' WHEN l_returnflag = 'A' THEN 'in_progress' WHEN l_returnflag = 'R' THEN 'blocked' ELSE 'done' END AS status,
l_discount > 0.075 AS unc, l_quantity > 40 AS dir, CASE WHEN l_suppkey % 11 <> 0 AND l_tax > 0.045 THEN l_shipdate::DATE END AS dl, l_suppkey % 11 = 0 AS rem FROM lineitem)"""


def task_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_quantity") < 5, "mentioned").when(F.col("l_returnflag") == "A", "in_progress").when(F.col("l_returnflag") == "R", "blocked").otherwise("done")
    removed = F.col("l_suppkey") % 11 == 0
    return line.select(
        F.col("l_orderkey").alias("task_id"), (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"), status.alias("status"), (F.col("l_discount") > 0.075).alias("uncertain"),
        (F.col("l_quantity") > 40).alias("is_directive"), F.when(~removed & (F.col("l_tax") > 0.045), F.col("l_shipdate").cast("date")).alias("deadline"), removed.alias("deadline_removed"),
    )


@query(
    f"""WITH {UPDATES}, v AS (SELECT *, status <> 'mentioned' AND NOT unc AS conf, dl IS NOT NULL OR rem AS has FROM u),
g AS (SELECT task_id, arg_max(status, (conf::INT, (conf AND dir)::INT, pos)) AS status, arg_max(pos, (conf::INT, (conf AND dir)::INT, pos)) AS deciding_pos, arg_max({{'d': dl, 'h': has}}, (conf::INT, (conf AND dir)::INT, pos)) AS own,
arg_max({{'d': dl}}, CASE WHEN has THEN pos END) AS lst, count(DISTINCT CASE WHEN conf THEN status END) AS ns, count(*) AS nu FROM v GROUP BY 1),
r AS (SELECT o_orderkey AS task_id, o_orderdate::DATE + 60 AS due, coalesce(status, 'not_reported') AS status, deciding_pos, CASE WHEN own.h THEN own.d ELSE lst.d END AS new_due, coalesce(nu, 0) AS n_updates, coalesce(status = 'done' AND ns >= 2, false) AS conflict FROM orders LEFT JOIN g ON o_orderkey = task_id)
SELECT * REPLACE (due::VARCHAR AS due, new_due::VARCHAR AS new_due, coalesce(deciding_pos, -1) AS deciding_pos), coalesce(new_due, due) < DATE '1998-06-01' AND status <> 'done' AS overdue FROM r"""
)
def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a task of the agenda, with what its line items report."""
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.date_add(F.col("o_orderdate").cast("date"), 60).alias("due"), F.lit("1998-06-01").cast("date").alias("meeting_date"))
    out = progress.task_progress(tasks, task_updates(spark, sf_dir))
    return out.withColumn("due", F.col("due").cast("string")).withColumn("new_due", F.col("new_due").cast("string")).withColumn("deciding_pos", F.coalesce("deciding_pos", F.lit(-1)))


@query(
    """WITH x AS (SELECT o_orderkey, o_orderpriority <> '5-LOW' AS ag, o_orderkey % 7 <> 0 AS kn, CASE WHEN o_orderstatus = 'P' THEN 'self_committed' ELSE 'assigned' END AS st, o_custkey % 5 AS who, o_orderkey % 5 AS p1, (o_orderkey + 1) % 5 AS p2, o_orderdate::DATE + (o_custkey % 3)::INT AS due, o_orderdate::DATE + 1 AS adue FROM orders)
SELECT o_orderkey, CASE WHEN NOT ag THEN NULL WHEN NOT kn THEN 'new' WHEN st <> 'self_committed' AND who NOT IN (p1, p2) THEN 'reassign' WHEN due <> adue THEN 'reschedule' ELSE 'follow_up' END AS relation FROM x"""
)
def relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each assignment relates to the agenda."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("date")
    rel = progress.relation(
        F.col("o_orderpriority") != "5-LOW", k % 7 != 0, F.when(F.col("o_orderstatus") == "P", "self_committed").otherwise("assigned"), F.array(c % 5), F.array(k % 5, (k + 1) % 5), F.date_add(day, (c % 3).cast("int")), F.date_add(day, 1)
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", rel.alias("relation"))


PHRASES = ("hôm nay", "ngày mai", "trong 3 ngày tới", "khoảng 3 tuần", "2 tháng nữa", "cuối tháng", "tháng sau", "cuối quý", "quý I", "tuần sau", "trước thứ Sáu", "cuối năm", "ngày 15/11", "thứ Hai hoặc thứ Tư tuần sau", "không rõ")


@query(
    """WITH x AS (SELECT o_orderkey, o_orderkey % 15 AS k, o_orderdate::DATE AS a, date_trunc('week', o_orderdate)::DATE AS mon FROM orders),
y AS (SELECT *, make_date(year(a), 3, 31) AS q1, make_date(year(a), 11, 15) AS n15 FROM x)
SELECT o_orderkey, CASE k WHEN 0 THEN a WHEN 1 THEN a + 1 WHEN 2 THEN a + 3 WHEN 3 THEN a + 21 WHEN 4 THEN (a + INTERVAL 2 MONTH)::DATE WHEN 5 THEN last_day(a) WHEN 6 THEN last_day((date_trunc('month', a) + INTERVAL 1 MONTH)::DATE)
WHEN 7 THEN last_day((date_trunc('quarter', a) + INTERVAL 2 MONTH)::DATE) WHEN 8 THEN CASE WHEN q1 >= a THEN q1 ELSE make_date(year(a) + 1, 3, 31) END WHEN 9 THEN mon + 13 WHEN 10 THEN CASE WHEN mon + 4 < a THEN mon + 11 ELSE mon + 4 END
WHEN 11 THEN make_date(year(a), 12, 31) WHEN 12 THEN CASE WHEN n15 >= a THEN n15 ELSE make_date(year(a) + 1, 11, 15) END WHEN 13 THEN mon + 9 END::DATE::VARCHAR AS deadline_date,
CASE WHEN k IN (5, 7, 8, 11) THEN 'end_of_period' WHEN k = 10 THEN 'before' WHEN k = 12 THEN 'exact' WHEN k = 14 THEN 'unknown' ELSE 'relative' END AS deadline_kind FROM y"""
)
def deadline_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines in words, relative to the orders' dates."""
    said = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("o_orderkey") % 15 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", normalize_deadline(said, F.col("o_orderdate")).alias("d"))
    return rows.select("o_orderkey", F.col("d.deadline_date").cast("string").alias("deadline_date"), "d.deadline_kind")


@query(
    """WITH c AS (SELECT conv_id AS meeting_id, turn, text, lower(text) AS t, role FROM conversations),
r AS (SELECT meeting_id, turn, CASE WHEN role = 'system' THEN ['no actor'] ELSE [] END || CASE WHEN role = 'system' OR length(text) % 2 = 0 THEN [] ELSE ['actor not in the topic'] END || CASE WHEN turn % 3 = 2 THEN ['status is not clear'] ELSE [] END
|| CASE WHEN length(text) % 5 = 0 THEN CASE WHEN regexp_matches(t, '(^|[^\\p{L}\\p{N}_])(the|la|der)($|[^\\p{L}\\p{N}_])') THEN [] ELSE ['confirm turn is no commitment'] END WHEN (length(text) % 100) / 100.0 >= 0.8 THEN [] WHEN (length(text) % 100) / 100.0 < 0.2 THEN ['confirm turn is no commitment'] ELSE ['confirm turn is unclear'] END AS r FROM c)
SELECT meeting_id, turn, array_to_string(r, '; ') AS reasons, CASE WHEN len(r) = 0 THEN 'clear' ELSE 'uncertain' END AS verdict FROM r"""
)
def evidence_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against taking each turn as an assignment: all reasons, by cues or by a judge's probability."""
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("meeting_id"), "turn", F.when(F.col("role") != "system", F.col("role")).alias("actor"), (n % 2 == 0).alias("grounded"), F.when(F.col("turn") % 3 != 2, "assigned").alias("status"),
        F.col("text").alias("confirm_text"), F.lit("a").alias("confirm_speaker"), F.lit("a").alias("matched_speaker"), F.when(n % 5 != 0, (n % 100) / 100.0).alias("p_commit"),
    )
    out = progress.check_actions(rows, cues=["the", "la", "der"])
    return out.select("meeting_id", "turn", F.array_join("reasons", "; ").alias("reasons"), "verdict")


@query(
    """WITH c AS (SELECT conv_id AS meeting_id, turn, lower(text) AS t, CASE WHEN length(text) % 3 <> 0 THEN (length(text) % 100) / 100.0 END AS p FROM conversations),
r AS (SELECT meeting_id, turn, CASE WHEN turn % 2 = 0 THEN [] ELSE ['not agreed'] END || CASE WHEN p IS NULL AND regexp_matches(t, '(^|[^\\p{L}\\p{N}_])(of|que)($|[^\\p{L}\\p{N}_])') THEN ['hedged'] ELSE [] END
|| CASE WHEN p IS NULL THEN CASE WHEN regexp_matches(t, '(^|[^\\p{L}\\p{N}_])(the|la|der)($|[^\\p{L}\\p{N}_])') THEN [] ELSE ['confirm turn is no commitment'] END WHEN p >= 0.8 THEN [] WHEN p < 0.2 THEN ['confirm turn is no commitment'] ELSE ['confirm turn is unclear'] END AS r FROM c)
SELECT meeting_id, turn, array_to_string(r, '; ') AS reasons, CASE WHEN len(r) = 0 THEN 'clear' ELSE 'uncertain' END AS verdict FROM r"""
)
def decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against taking each turn as a decision."""
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), "turn", "text", F.when(F.col("turn") % 2 == 0, "agreed").otherwise("proposed").alias("status"), F.col("text").alias("confirm_text"), F.when(n % 3 != 0, (n % 100) / 100.0).alias("p_commit"))
    out = progress.check_decisions(rows, cues=["the", "la", "der"], hedges=["of", "que"])
    return out.select("meeting_id", "turn", F.array_join("reasons", "; ").alias("reasons"), "verdict")


_SIMILAR = "[" + ", ".join(f"'{w}'" for w in tx.SIMILARITY_STOPWORDS) + "]"
#: One line after another, with the list of what is kept; ``{same}`` and ``{wins}`` compare a kept ``k`` with the line ``l``.
_MERGED = """WITH RECURSIVE {lines}, t AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY pos) AS i, pos, role AS actor_key, text, CASE WHEN pos % 2 = 0 THEN '2026-01-01' END AS deadline, [item_id] AS ev,
  list_distinct(list_filter(regexp_extract_all(lower(nfc_normalize(text)), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: len(x) > 1 AND NOT list_contains({stop}, x) {own})) AS w FROM items),
r AS (SELECT DISTINCT meeting_id, 0::BIGINT AS i, []::STRUCT(pos BIGINT, actor_key VARCHAR, text VARCHAR, deadline VARCHAR, ev VARCHAR[], w VARCHAR[], n INT)[] AS kept FROM t
UNION ALL SELECT l.meeting_id, l.i, CASE WHEN hit IS NULL THEN list_append(kept, {{'pos': l.pos, 'actor_key': l.actor_key, 'text': l.text, 'deadline': l.deadline, 'ev': l.ev, 'w': l.w, 'n': 1}})
  ELSE list_concat(list_concat(kept[:hit - 1], [CASE WHEN {wins} THEN {{'pos': kept[hit].pos, 'actor_key': kept[hit].actor_key, 'text': l.text, 'deadline': l.deadline, 'ev': list_concat(l.ev, kept[hit].ev), 'w': l.w, 'n': kept[hit].n + 1}}
    ELSE {{'pos': kept[hit].pos, 'actor_key': kept[hit].actor_key, 'text': kept[hit].text, 'deadline': kept[hit].deadline, 'ev': list_concat(kept[hit].ev, l.ev), 'w': kept[hit].w, 'n': kept[hit].n + 1}} END]), kept[hit + 1:]) END
  FROM (SELECT t.*, r.kept, list_position(list_transform(r.kept, lambda k: {same} len(k.w) > 0 AND len(t.w) > 0 AND len(list_intersect(k.w, t.w)) >= 0.45 * len(list_distinct(list_concat(k.w, t.w))) AND len(list_intersect(k.w, t.w)) >= 0.7 * least(len(k.w), len(t.w))), true) AS hit
    FROM r JOIN t ON t.meeting_id = r.meeting_id AND t.i = r.i + 1) l),
z AS (SELECT meeting_id, unnest(kept) AS k FROM (SELECT meeting_id, arg_max(kept, i) AS kept FROM r GROUP BY 1))"""


@query(
    _MERGED.format(lines=LINES, stop=_SIMILAR, own="AND x <> lower(role)", same="k.actor_key = t.actor_key AND", wins="(l.deadline IS NOT NULL AND kept[hit].deadline IS NULL) OR ((l.deadline IS NULL) = (kept[hit].deadline IS NULL) AND length(l.text) > length(kept[hit].text))")
    + " SELECT meeting_id, k.pos AS pos, k.actor_key AS actor_key, k.text AS text, k.deadline AS deadline, array_to_string(k.ev, ',') AS evidence, k.n AS n_merged FROM z"
)
def merged_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations as assignments, duplicates merged by first fit."""
    rows = line_items(spark, sf_dir).select("meeting_id", "pos", F.col("speaker").alias("actor_key"), F.lit(None).cast("string").alias("task_id"), "text", F.when(F.col("pos") % 2 == 0, "2026-01-01").alias("deadline"), F.array("item_id").alias("evidence_ids"))
    out = progress.merge_assignments(rows)
    return out.select("meeting_id", "pos", "actor_key", "text", "deadline", F.array_join("evidence_ids", ",").alias("evidence"), "n_merged")


@query(
    _MERGED.format(lines=LINES, stop=_SIMILAR, own="", same="", wins="length(l.text) > length(kept[hit].text)")
    + " SELECT meeting_id, k.pos AS pos, k.text AS text, array_to_string(k.ev, ',') AS evidence, k.n AS n_merged FROM z"
)
def merged_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations as decisions, duplicates merged by first fit."""
    out = progress.merge_decisions(line_items(spark, sf_dir).select("meeting_id", "pos", "text", F.array("item_id").alias("evidence_ids")))
    return out.select("meeting_id", "pos", "text", F.array_join("evidence_ids", ",").alias("evidence"), "n_merged")


# --- scoring --------------------------------------------------------------------------------------


ALIKE = 0.02  # invented texts have few words in common


def scored_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A conversation's assistant turns as predictions, its user turns as gold."""
    rows = conversation_turns(spark, sf_dir).select("meeting_id", "turn_no", "speaker", tx.syllables(F.col("text_exact"), STOP).alias("words"), F.array("turn_no").alias("turns"))
    pred = rows.filter("speaker = 'assistant'").select("meeting_id", F.col("turn_no").alias("pred_id"), "turns", "words", (F.col("turn_no") % 2 == 0).alias("has_actor"))
    gold = rows.filter("speaker = 'user'").select("meeting_id", F.col("turn_no").alias("gold_id"), "turns", "words")
    return pred, gold


_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
PAIRS = f"""{TURNS},
w AS (SELECT meeting_id, turn_no, speaker, list_distinct(list_filter(regexp_extract_all(lower(text_exact), '[\\p{{L}}\\p{{N}}_]+'), lambda x: NOT list_contains({_STOPS}, x))) AS ws FROM turns),
pr AS (SELECT p.meeting_id, p.turn_no AS pred_id, g.turn_no AS gold_id, CASE WHEN len(p.ws) = 0 OR len(g.ws) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(p.ws, g.ws)) / (len(p.ws) + len(g.ws)) END::DOUBLE AS score FROM w p JOIN w g ON p.meeting_id = g.meeting_id AND abs(p.turn_no - g.turn_no) <= 1 WHERE p.speaker = 'assistant' AND g.speaker = 'user')"""


@query(f"WITH {PAIRS} SELECT * FROM pr WHERE score >= 0.02")
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions near gold items with words in common."""
    return scoring.pairs_in_window(*scored_turns(spark, sf_dir), least=ALIKE)


#: One candidate after another, with the lists of what is taken.
GREEDY = """k AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY score DESC, pred_id, gold_id) AS i FROM pr WHERE score >= 0.02),
gr AS (SELECT meeting_id, 0::BIGINT AS i, []::BIGINT[] AS ps, []::BIGINT[] AS gs, NULL::BIGINT AS pred_id, NULL::BIGINT AS gold_id, NULL::DOUBLE AS score, false AS ok FROM (SELECT DISTINCT meeting_id FROM k)
  UNION ALL SELECT meeting_id, i, CASE WHEN ok THEN list_append(ps, pred_id) ELSE ps END, CASE WHEN ok THEN list_append(gs, gold_id) ELSE gs END, pred_id, gold_id, score, ok
  FROM (SELECT k.meeting_id, k.i, gr.ps, gr.gs, k.pred_id::BIGINT AS pred_id, k.gold_id::BIGINT AS gold_id, k.score, NOT list_contains(gr.ps, k.pred_id) AND NOT list_contains(gr.gs, k.gold_id) AS ok FROM gr JOIN k ON k.meeting_id = gr.meeting_id AND k.i = gr.i + 1)),
matched AS (SELECT meeting_id, pred_id, gold_id, score FROM gr WHERE ok)"""


@query(f"WITH RECURSIVE {PAIRS}, {GREEDY} SELECT * FROM matched")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions matched to gold one to one, the best score first."""
    return scoring.greedy_match(scoring.pairs_in_window(*scored_turns(spark, sf_dir), least=ALIKE))


@query(
    f"""WITH RECURSIVE {PAIRS}, {GREEDY}
SELECT p.meeting_id, p.pred_id, min(p.gold_id) AS trap_id FROM pr p WHERE p.score >= 0.02 AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.meeting_id = p.meeting_id AND m.pred_id = p.pred_id) AND (p.gold_id % 2 = 1 OR p.pred_id % 2 = 0) GROUP BY ALL"""
)
def trap_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmatched predictions that fall into traps, made of the turns before."""
    pred, gold = scored_turns(spark, sf_dir)
    matched = scoring.greedy_match(scoring.pairs_in_window(pred, gold, least=ALIKE))
    traps = gold.select("meeting_id", F.col("gold_id").alias("trap_id"), F.when(F.col("gold_id") % 2 == 0, "unassigned_task").otherwise("rejected_task").alias("kind"), "turns", "words")
    return scoring.trapped(pred, matched, traps, least=ALIKE)


@query(f"WITH {PAIRS} SELECT meeting_id, turn_no AS point_id, EXISTS (SELECT 1 FROM pr WHERE pr.meeting_id = w.meeting_id AND pr.gold_id = w.turn_no AND score >= 0.02) AS covered FROM w WHERE speaker = 'user'")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which key points some discussion point covers; all are by one speaker."""
    pred, gold = scored_turns(spark, sf_dir)
    points = gold.select("meeting_id", F.col("gold_id").alias("point_id"), F.lit("x").alias("speaker"), "turns", "words")
    said = pred.select("meeting_id", F.col("pred_id").alias("discussion_id"), F.array(F.lit("x")).alias("speakers"), "turns", "words")
    return scoring.covered(points, said, least=ALIKE).select("meeting_id", "point_id", "covered")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", "lang", "source", (F.col("n_chars") > 1500).alias("pred"), (F.col("quality") == 1).alias("gold"), (F.col("toxic") == 1).alias("toxic"), F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("p"))


LABELLED = "l AS (SELECT doc_id, lang, source, n_chars > 1500 AS pred, quality = 1 AS gold, toxic = 1 AS toxic, least(n_chars / 5000.0, 1.0)::DOUBLE AS p FROM documents JOIN labels USING (doc_id))"


@query(
    f"""WITH {LABELLED}, c AS (SELECT lang, count_if(pred AND gold)::BIGINT AS tp, count_if(pred)::BIGINT AS n_pred, count_if(gold)::BIGINT AS n_gold FROM l GROUP BY 1)
SELECT *, tp / nullif(n_pred, 0) AS precision, tp / nullif(n_gold, 0) AS recall, CASE WHEN n_pred + n_gold = 0 THEN 1.0 ELSE 2.0 * tp / (n_pred + n_gold) END::DOUBLE AS f1 FROM c"""
)
def micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 by language."""
    return scoring.rates(labelled(spark, sf_dir), "pred", "gold", ["lang"])


@query(f"WITH {LABELLED}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS p, avg(gold::INT) AS a FROM l GROUP BY 1) SELECT round(sum(n * abs(p - a)) / sum(n), 8) AS ece, sum(n)::BIGINT AS n_rows FROM b")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error of a made-up probability."""
    return scoring.calibration_error(labelled(spark, sf_dir), "p", "gold").select(F.round("ece", 8).alias("ece"), "n_rows")


@query(f"WITH {LABELLED} SELECT CASE WHEN p >= 0.8 THEN 'clear' WHEN p < 0.2 THEN 'rejected' ELSE 'unclear' END AS zone, count(*) AS n_rows, count_if(gold)::BIGINT AS n_hits FROM l GROUP BY 1")
def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits where the probability is clear, rejected and between."""
    return scoring.zones(labelled(spark, sf_dir), "p", "gold")


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).groupBy(F.col("source").alias("meeting_id"))
    return rows.agg(F.count_if(F.col("pred") & F.col("gold")).alias("tp"), F.count_if("pred").alias("n_pred"), F.count_if("gold").alias("n_gold"), F.count_if((F.col("p") > 0.5) & F.col("gold")).alias("tp_b"), F.count_if(F.col("p") > 0.5).alias("n_b"))


#: Counts by source, numbered, and how often each resample draws each; sums of each resample.
DRAWS = f"""{LABELLED}, ct AS (SELECT source, count_if(pred AND gold) AS tp, count_if(pred) AS n_pred, count_if(gold) AS n_gold, count_if(p > 0.5 AND gold) AS tp_b, count_if(p > 0.5) AS n_b FROM l GROUP BY 1),
nb AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS no, count(*) OVER () AS n FROM ct),
dr AS (SELECT r, ('0x' || left(md5('7:' || r || ':' || d), 12))::BIGINT % n AS no FROM range(1000) a(r), (SELECT DISTINCT n FROM nb), unnest(range(n)) b(d)),
sm AS (SELECT r, sum(tp) AS tp, sum(n_pred) AS n_pred, sum(n_gold) AS n_gold, sum(tp_b) AS tp_b, sum(n_b) AS n_b FROM dr JOIN nb USING (no) GROUP BY 1),
wh AS (SELECT sum(tp) AS tp, sum(n_pred) AS n_pred, sum(n_gold) AS n_gold, sum(tp_b) AS tp_b, sum(n_b) AS n_b FROM ct)"""


@query(
    f"""WITH {DRAWS}, f AS (SELECT CASE WHEN n_pred + n_gold = 0 THEN 1.0 ELSE 2.0 * tp / (n_pred + n_gold) END::DOUBLE AS s FROM sm)
SELECT (SELECT CASE WHEN n_pred + n_gold = 0 THEN 1.0 ELSE 2.0 * tp / (n_pred + n_gold) END::DOUBLE FROM wh) AS f1, quantile_cont(s, 0.025) AS low, quantile_cont(s, 0.975) AS high FROM f"""
)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro F1 with an interval by resampling sources."""
    return scoring.bootstrap_interval(source_counts(spark, sf_dir).select("meeting_id", "tp", "n_pred", "n_gold"))


@query(
    f"""WITH {DRAWS}, e AS (SELECT *, 2.0 * tp / greatest(n_pred + n_gold, 1) - 2.0 * tp_b / greatest(n_b + n_gold, 1) AS d FROM sm)
SELECT (SELECT 2.0 * tp / greatest(n_pred + n_gold, 1) - 2.0 * tp_b / greatest(n_b + n_gold, 1) FROM wh)::DOUBLE AS difference, quantile_cont(d, 0.025)::DOUBLE AS low, quantile_cont(d, 0.975)::DOUBLE AS high,
least(1.0, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT)))::DOUBLE AS p_value FROM e"""
)
def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predictors' difference in micro F1, by the same resamples."""
    return scoring.paired_bootstrap(source_counts(spark, sf_dir).select("meeting_id", F.col("tp").alias("tp_a"), F.col("n_pred").alias("n_a"), "tp_b", "n_b", "n_gold"))


@query(
    f"""WITH {LABELLED}, t AS (SELECT source AS name, (count_if(toxic) + 1) * 0.02 / (count(*) + 1) AS p_value FROM l GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p_value, name) AS rank, count(*) OVER () AS n FROM t)
SELECT name, round(p_value, 8)::DOUBLE AS p_value, rank::INT AS rank, min((p_value <= 0.05 / (n - rank + 1))::INT) OVER (ORDER BY rank) = 1 AS rejected FROM r"""
)
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's step-down over one test per source."""
    t = labelled(spark, sf_dir).groupBy(F.col("source").alias("name")).agg(((F.count_if("toxic") + 1) * F.lit(0.02) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    return scoring.holm(t).withColumn("p_value", F.round("p_value", 8))


@query(
    f"""WITH {TURNS}, un AS (SELECT meeting_id, turn_no - 1 AS pos, speaker = 'user' AND turn_no > 1 AS gold, length(text_exact) % 2 = 0 AND turn_no > 1 AS pred FROM turns),
s AS (SELECT *, sum(gold::INT) OVER w AS g, sum(pred::INT) OVER w AS p FROM un WINDOW w AS (PARTITION BY meeting_id ORDER BY pos)), k AS (SELECT meeting_id, greatest(1, round_even(count(*) / (2 * (max(g) + 1)), 0))::INT AS k FROM s GROUP BY 1)
SELECT k.meeting_id, k.k, avg(CASE WHEN (a.g = b.g) <> (a.p = b.p) THEN 1.0 WHEN b.pos IS NOT NULL THEN 0.0 END) AS pk, avg(CASE WHEN b.g - a.g <> b.p - a.p THEN 1.0 WHEN b.pos IS NOT NULL THEN 0.0 END) AS windowdiff FROM k JOIN s a USING (meeting_id) LEFT JOIN s b ON b.meeting_id = a.meeting_id AND b.pos = a.pos + k.k GROUP BY ALL"""
)
def pk_windowdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation errors of made-up boundaries against those at users' turns."""
    rows = conversation_turns(spark, sf_dir)
    units = rows.select("meeting_id", (F.col("turn_no") - 1).alias("pos"), (F.col("speaker") == "user").alias("gold"), (F.length("text_exact") % 2 == 0).alias("pred"))
    return scoring.pk_windowdiff(units)


@query("SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = least(floor(n * 0.95), n - 1)")
def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at index floor(0.95 n) of every event type."""
    return scoring.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95, "p95")


# --- documents --------------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT l_orderkey % 100 AS meeting_id, l_orderkey AS task_id, min(l_orderkey) AS pos, 'Supplier ' || (l_suppkey % 9) AS a FROM lineitem GROUP BY ALL), g AS (SELECT meeting_id, a, min(task_id) AS f, count(*) AS n FROM t GROUP BY ALL)
SELECT meeting_id, a AS assignee, n::INT AS n_tasks, f AS first_task FROM g"""
)
def group_by_assignee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks under everyone who has them."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("meeting_id"), F.col("l_orderkey").alias("task_id"), F.col("l_orderkey").alias("pos"))
    tasks = rows.agg(F.array_sort(F.collect_set(F.concat(F.lit("Supplier "), (F.col("l_suppkey") % 9).cast("string")))).alias("targets"))
    return documents.by_assignee(tasks).select("meeting_id", "assignee", "n_tasks", F.get("task_ids", F.lit(0)).alias("first_task"))


@query("SELECT source AS meeting_id, lang AS segment_id, count(*) AS n_points, count(DISTINCT n_chars) AS n_lengths FROM documents GROUP BY ALL")
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and different lengths per topic."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("meeting_id"), F.col("lang").alias("segment_id"), F.col("n_chars").alias("lengths"))
    return documents.topic_counts(rows, distinct="lengths")


@query(
    f"""WITH {LINES}, s AS (SELECT meeting_id, role, count(*) AS n FROM items GROUP BY ALL) SELECT meeting_id, sum(n)::BIGINT AS n_items, sum(CASE WHEN (meeting_id % 2 = 0 AND role = 'system') THEN 0 ELSE n END)::BIGINT AS n_covered,
sum(CASE WHEN (meeting_id % 2 = 0 AND role = 'system') THEN 0 ELSE n END) / sum(n) AS coverage FROM s GROUP BY 1"""
)
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of items in topics that did not fail; a conversation's roles are its topics."""
    items = line_items(spark, sf_dir)
    segments = items.groupBy("meeting_id", F.col("speaker").alias("segment_id")).agg(F.count(F.lit(1)).alias("n_items"))
    failures = segments.filter("meeting_id % 2 = 0 and segment_id = 'system'")
    return documents.coverage(segments, failures)


@query(
    f"""WITH {TURNS}, t AS (SELECT meeting_id AS session, speaker, count(*) AS n_turns FROM turns GROUP BY ALL), k AS (SELECT conv_id AS session, role AS speaker, count(*) AS n_topics FROM conversations WHERE length(text) % 2 = 0 GROUP BY ALL)
SELECT session, speaker, coalesce(n_turns, 0) AS n_turns, coalesce(n_topics, 0) AS n_topics, greatest(coalesce(n_topics, 0) - coalesce(n_turns, 0), 0) AS excess FROM t FULL JOIN k USING (session, speaker)"""
)
def turn_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that fall inside turns, by speaker."""
    t = conversation_turns(spark, sf_dir).select(F.col("meeting_id").alias("session"), "speaker")
    k = table(spark, sf_dir, "conversations").filter(F.length("text") % 2 == 0).select(F.col("conv_id").alias("session"), F.col("role").alias("speaker"))
    return documents.purity(t, k)


@query("SELECT event_type, count(*) AS calls, count_if(value > 50)::BIGINT AS failed, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS tokens FROM events GROUP BY 1")
def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, failed calls and tokens, by kind."""
    return documents.usage_ledger(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50, F.get_json_object("props", "$.k").cast("bigint"))


@query("SELECT doc_id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, doc_id) AS r FROM (SELECT doc_id, lang AS label, n_chars AS n FROM documents)) WHERE r <= 6")
def top_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six largest of each label, ties to the smaller id: a top-k report."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), F.col("n_chars").alias("n"))
    return documents.top_points(rows, "label", "n", "doc_id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run has still to do: rows without a result."""
    return payloads.todo(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT source AS name, bool_or(quality = 1) AS has_positive, bool_or(toxic = 1) AS has_negative FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING NOT (bool_or(quality = 1) AND bool_or(toxic = 1))")
def disjoint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that are not both positive and negative."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumnRenamed("source", "name")
    return scoring.disjoint(rows, "name", F.col("quality") == 1, F.col("toxic") == 1)
