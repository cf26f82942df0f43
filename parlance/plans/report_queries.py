"""Boundaries, manifests, merged updates, samples and pieces over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import actors, progress, scoring, splitting
from parlance.operators import segmentation as sg
from parlance.plans.meeting_queries import UPDATES, labelled, roster, task_updates
from parlance.plans.registry import query, table
from parlance.plans.segment_queries import DEPTHS, meetings
from parlance.plans.transcript_queries import TURNS, conversation_turns, line_items
from parlance.sources import benchmark, sinks


@query(f"WITH {DEPTHS}, r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY depth DESC, gap) AS k FROM dp) SELECT meeting_id, (gap + 1)::INT AS pos FROM r WHERE k <= 3")
def strongest_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three deepest gaps of every meeting: a top-k report."""
    deep = sg.depths(sg.smoothed(sg.gap_scores(meetings(spark, sf_dir))))
    return scoring.strongest_boundaries(deep, deep.select("meeting_id").distinct().withColumn("n", F.lit(3)))


@query(f"WITH {TURNS}, i AS (SELECT meeting_id, count(*) AS n_items FROM items GROUP BY 1) SELECT meeting_id, any_value(i.n_items) AS n_items, count(*) AS n_turns, sum(length(text_exact))::BIGINT AS total_chars, count_if(speaker = 'user')::BIGINT AS n_questions FROM turns JOIN i USING (meeting_id) GROUP BY 1")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of every conversation."""
    turns = conversation_turns(spark, sf_dir)
    return sinks.manifest(line_items(spark, sf_dir), turns, {"questions": turns.filter("speaker = 'user'")})


@query(
    f"""WITH {UPDATES} SELECT task_id, arg_max(status, ((status <> 'mentioned')::INT, pos)) AS status, arg_max(pos, ((status <> 'mentioned')::INT, pos)) AS pos, count(DISTINCT pos) AS n_evidence FROM u GROUP BY 1"""
)
def merged_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update per task: the latest that says more than a mention, with everyone's evidence."""
    rows = task_updates(spark, sf_dir).select(F.lit("m").alias("meeting_id"), F.lit("s").alias("segment_id"), "task_id", "pos", F.col("pos").alias("update_no"), "status", (F.col("status") != "mentioned").alias("informative"), F.array(F.col("pos").cast("string")).alias("evidence_ids"))
    return progress.merge_same_task(rows).select("task_id", "status", "pos", F.size("evidence_ids").cast("bigint").alias("n_evidence"))


@query(
    """WITH s AS (SELECT DISTINCT c_nationkey AS meeting_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' ' || c_name || ' ' || (c_custkey % 7) ELSE (c_custkey % 7)::VARCHAR END AS speaker FROM customer),
p AS (SELECT c_nationkey AS meeting_id, 'P' || c_custkey AS ref_id, lower(c_mktsegment || ' ' || c_name || ' ' || (c_custkey % 7)) AS k, (c_custkey % 7)::VARCHAR AS g FROM customer),
gv AS (SELECT meeting_id, g, any_value(ref_id) AS ref_id FROM p GROUP BY ALL HAVING count(*) = 1)
SELECT s.meeting_id, s.speaker, coalesce(p.ref_id, gv.ref_id) AS ref_id FROM s LEFT JOIN p ON p.meeting_id = s.meeting_id AND p.k = lower(s.speaker) LEFT JOIN gv ON gv.meeting_id = s.meeting_id AND gv.g = lower(s.speaker)"""
)
def speaker_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who of the roster a speaker is: by full name, else by a given name that only one has."""
    _, people, _ = roster(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    name = F.concat_ws(" ", "c_mktsegment", "c_name", (F.col("c_custkey") % 7).cast("string"))
    label = F.when(F.col("c_custkey") % 2 == 0, name).otherwise((F.col("c_custkey") % 7).cast("string"))
    speakers = c.select(F.col("c_nationkey").alias("meeting_id"), label.alias("speaker")).distinct()
    return actors.speaker_person(speakers, people).select("meeting_id", "speaker", "ref_id")


#: Sentences, long ones cut at their last space before the limit, then packed one after another.
WINDOWS = """WITH RECURSIVE s AS (SELECT doc_id, generate_subscripts(x, 1) AS sn, unnest(x) AS rest FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM documents WHERE length(text) > 2500)),
c AS (SELECT doc_id, sn, 0 AS pn, NULL::VARCHAR AS piece, rest FROM s UNION ALL SELECT doc_id, sn, pn + 1, CASE WHEN length(rest) <= 2500 THEN rest ELSE left(rest, cut) END, CASE WHEN length(rest) <= 2500 THEN '' ELSE regexp_replace(substr(rest, cut + 1), '^\\s+', '') END
  FROM (SELECT *, CASE WHEN strpos(reverse(left(rest, 2500)), ' ') BETWEEN 1 AND 2499 THEN 2500 - strpos(reverse(left(rest, 2500)), ' ') ELSE 2500 END AS cut FROM c WHERE rest <> '')),
p AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY sn, pn) AS i FROM c WHERE pn > 0 AND piece <> ''),
g AS (SELECT doc_id, i, 0 AS piece, length(piece) AS have FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN have + 1 + length(p.piece) > 2500 THEN g.piece + 1 ELSE g.piece END, CASE WHEN have + 1 + length(p.piece) > 2500 THEN length(p.piece) ELSE have + 1 + length(p.piece) END FROM g JOIN p ON p.doc_id = g.doc_id AND p.i = g.i + 1)"""


@query(f"{WINDOWS} SELECT g.doc_id, g.piece::INT AS piece, string_agg(p.piece, ' ' ORDER BY g.i) AS text FROM g JOIN p USING (doc_id, i) GROUP BY ALL UNION ALL SELECT doc_id, 0, coalesce(text, '') FROM documents WHERE coalesce(length(text), 0) <= 2500")
def turn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces of at most 2500 characters, cut at sentences."""
    rows = splitting.with_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.posexplode("windows").alias("piece", "text"))


@query(
    """WITH l AS (SELECT doc_id, source, bool_or(quality = 1) AS g, bool_or(toxic = 1) AS t FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
f AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || source || ':' || doc_id), doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l WHERE g OR t))
SELECT source AS meeting_id, doc_id AS turn_no, g AS label FROM l WHERE g <> t UNION ALL SELECT source, doc_id, NULL FROM f WHERE r <= 8"""
)
def labelled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents and eight others of every source: a sampling operator."""
    rows = labelled(spark, sf_dir)
    every = table(spark, sf_dir, "documents").select(F.col("source").alias("meeting_id"), F.col("doc_id").alias("turn_no"))
    keyed = rows.select(F.col("source").alias("meeting_id"), F.col("doc_id").alias("turn_no"), "gold", "toxic")
    return scoring.labelled_sample(every, keyed.filter("gold"), keyed.filter("toxic"))


@query(f"WITH {TURNS} SELECT meeting_id, string_agg('[' || turn_id || '] ' || speaker || ': ' || text_exact, chr(10) ORDER BY turn_no) AS prompt, sum(length('[' || turn_id || '] ' || speaker || ': ' || text_exact) + 1)::BIGINT - 1 AS chars FROM turns GROUP BY 1")
def method_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as methods are shown them."""
    return benchmark.rendered(conversation_turns(spark, sf_dir)).withColumn("chars", F.col("chars").cast("bigint"))


@query(
    """SELECT conv_id::VARCHAR AS meeting_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS item_no, 'A' || turn AS id, role AS actor, text AS task, CASE WHEN turn % 2 = 0 THEN 'T' || turn ELSE '' END AS evidence,
CASE WHEN conv_id % 4 = 0 THEN 'no number of turns' ELSE '' END AS errors FROM conversations"""
)
def parsed_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold files made of conversations: their assignments, and what is wrong with each file."""
    one = F.struct(F.concat(F.lit("A"), "turn").alias("id"), F.col("role").alias("actor"), F.col("text").alias("task"), F.when(F.col("turn") % 2 == 0, F.array(F.concat(F.lit("T"), "turn"))).alias("evidence_turn_ids"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))), lambda y: y["x"]).alias("assignments"), F.count(F.lit(1)).alias("n"))
    said = F.to_json(F.struct(F.col("conv_id").cast("string").alias("meeting_id"), F.when(F.col("conv_id") % 4 != 0, F.col("n")).alias("n_turns"), "assignments"))
    gold = benchmark.parse_gold(rows.select(F.col("conv_id").cast("string").alias("source"), said.alias("payload")))
    items = benchmark.gold_items(gold, "assignments").join(gold.select("meeting_id", "errors"), "meeting_id")
    return items.select("meeting_id", "item_no", "id", "actor", "task", F.array_join("evidence", ",").alias("evidence"), F.array_join("errors", ",").alias("errors"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::INT AS n_assignments, 0::INT AS n_topics, CASE WHEN doc_id % 2 = 0 THEN lang END AS task FROM documents"""
)
def common_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw outputs of methods in the schema that all share."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.array(F.struct(F.col("lang").alias("task"))).alias("assignments"), F.lit("x").alias("reasoning")))).otherwise("[]")
    rows = table(spark, sf_dir, "documents").select("doc_id", benchmark.common_schema(raw).alias("r"))
    return rows.select("doc_id", F.size("r.assignments").alias("n_assignments"), F.size("r.topics").alias("n_topics"), F.get("r.assignments", F.lit(0))["task"].alias("task"))
