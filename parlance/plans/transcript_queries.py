"""Queries over conversations, as transcripts whose items are lines, and over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import segmentation as sg
from parlance.operators import transcripts as tr
from parlance.plans.registry import query, table


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every conversation turn as one transcript item; line times are made up from positions."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), "turn", "role", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    pos = F.col("turn") * 100_000 + F.col("line")
    return rows.select(
        "meeting_id", pos.alias("pos"), F.concat_ws("-", F.col("turn").cast("string"), F.col("line").cast("string")).alias("item_id"), "text", F.col("role").alias("speaker"), F.col("role").alias("speaker_role"),
        F.lit(None).cast("string").alias("speaker_track"), (pos * 10).alias("start_ms"), (pos * 10 + 5).alias("end_ms"), F.lit(None).cast("string").alias("point_id"), F.array().cast("array<string>").alias("ref_ids"),
        F.when((F.col("meeting_id") + F.col("line")) % 5 == 0, F.concat(F.lit("* "), F.col("text"))).alias("reviewed_text"), F.when(F.col("line") % 7 == 3, F.lit("Unknown speaker 01")).alias("reviewed_speaker"),
        F.when(F.col("meeting_id") % 3 == 0, F.lit("stt_export")).alias("source_schema"),
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = line_items(spark, sf_dir).withColumn("reviewed_text", F.lit(None).cast("string")).withColumn("reviewed_speaker", F.lit(None).cast("string"))
    return tr.turns(tr.evidence(tr.effective(items)), max_gap_ms=10_000_000)


LINES = """lines AS (SELECT conv_id AS meeting_id, turn, role, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS text FROM conversations),
items AS (SELECT meeting_id, turn * 100000 + line AS pos, turn || '-' || line AS item_id, role, text, turn, line FROM lines)"""
TURNS = (
    LINES
    + """,
marked AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS brk FROM items WHERE trim(text) <> '' WINDOW w AS (PARTITION BY meeting_id ORDER BY pos)),
numbered AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY meeting_id ORDER BY pos) AS BIGINT) AS turn_no FROM marked),
turns AS (SELECT meeting_id, turn_no, 'TURN_' || lpad(CAST(turn_no AS VARCHAR), 6, '0') AS turn_id, arg_min(role, pos) AS speaker, string_agg(text, ' ' ORDER BY pos) AS text_exact,
  count(*) AS n_items, min(pos * 10) AS start_ms, max(pos * 10 + 5) AS end_ms, string_agg(meeting_id || ':TR01:' || item_id, ',' ORDER BY pos) AS evidence FROM numbered GROUP BY meeting_id, turn_no)"""
)


@query(f"WITH {TURNS} SELECT meeting_id, turn_no, turn_id, speaker, text_exact, n_items, start_ms, end_ms, evidence FROM turns")
def turns_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns of all conversations."""
    rows = conversation_turns(spark, sf_dir)
    return rows.select("meeting_id", "turn_no", "turn_id", "speaker", "text_exact", F.size("source_items").cast("bigint").alias("n_items"), "start_ms", "end_ms", F.array_join("evidence_ids", ",").alias("evidence"))


@query(
    """WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM m)
SELECT user_id, session_no, count(*) AS n_events, min(event_id) AS first_event, max(event_id) AS last_event, string_agg(event_type, ',' ORDER BY ts, event_id) AS path FROM n GROUP BY ALL"""
)
def turns_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events: a gap of more than an hour ends one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ends = F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 1 HOUR"))
    rows = table(spark, sf_dir, "events").withColumn("brk", ends.cast("int"))
    rows = rows.withColumn("session_no", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ",")
    return rows.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), path.alias("path"))


@query(
    f"""WITH {LINES}, r AS (SELECT *, CASE WHEN (meeting_id + line) % 5 = 0 THEN '* ' || text END AS rt, CASE WHEN line % 7 = 3 THEN 'Unknown speaker 01' END AS rs, meeting_id % 3 = 0 AS ex FROM items)
SELECT meeting_id, item_id, coalesce(rt, text) AS text, CASE WHEN rs IS NULL THEN role END AS speaker, role AS track, CASE WHEN rt IS NOT NULL THEN 'human_review' WHEN ex THEN 'source_export_effective' ELSE 'raw_stt' END AS text_from,
CASE WHEN rs IS NOT NULL THEN 'human_review' WHEN ex THEN 'source_export_effective' ELSE 'speaker_model' END AS speaker_from, CASE WHEN ex THEN 'source_export_effective' ELSE 'raw_stt' END AS time_from FROM r"""
)
def effective_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews laid over raw items, with the provenance of each field."""
    p = F.col("provenance")
    return tr.effective(line_items(spark, sf_dir)).select("meeting_id", "item_id", "text", "speaker", "track", p["text"].alias("text_from"), p["speaker"].alias("speaker_from"), p["start_ms"].alias("time_from"))


@query(
    f"""WITH {LINES} SELECT meeting_id, item_id, meeting_id || ':TR01:' || item_id AS evidence_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text_normal,
sha256(concat_ws(chr(31), meeting_id::VARCHAR, item_id, role, (pos * 10)::VARCHAR, (pos * 10 + 5)::VARCHAR, trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content_hash, 0 AS n_errors FROM items"""
)
def evidence_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids and content hashes of all items."""
    items = line_items(spark, sf_dir).withColumn("reviewed_text", F.lit(None).cast("string")).withColumn("reviewed_speaker", F.lit(None).cast("string"))
    return tr.evidence(tr.effective(items)).select("meeting_id", "item_id", "evidence_id", "text_normal", "content_hash", F.size("errors").alias("n_errors"))


@query(
    f"""WITH {LINES}, d AS (SELECT meeting_id, pos, substr(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) AS digest FROM items),
n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, digest ORDER BY pos) AS k FROM d)
SELECT meeting_id, pos, CASE WHEN k = 1 THEN digest ELSE digest || '_' || k END AS stable_id FROM n"""
)
def stable_item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from content, suffixed where a conversation repeats a line."""
    return tr.stable_ids(line_items(spark, sf_dir), tx.squeeze(F.col("text")), ["pos"]).select("meeting_id", "pos", "stable_id")


@query("SELECT text AS text_key, count(*) AS n_rows, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text FROM documents) GROUP BY 1 HAVING count(*) > 1")
def duplicate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts that several documents have."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.squeeze(F.col("text"))).alias("text_key"))
    return rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("n_rows > 1")


@query(
    f"""WITH {TURNS}, c AS (SELECT meeting_id, turn_no, length(coalesce(speaker, 'None') || ': ' || text_exact) + 1 AS chars FROM turns)
SELECT meeting_id, turn_no, CAST(chars AS INTEGER) AS chars, CAST(coalesce(sum(chars) OVER (PARTITION BY meeting_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM c"""
)
def turn_chars_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered lengths of turns and their sums over earlier turns."""
    return tr.char_prefix(conversation_turns(spark, sf_dir)).select("meeting_id", "turn_no", "chars", "chars_before")


@query(f"WITH {TURNS}, s AS (SELECT meeting_id, speaker, min(turn_no) AS first_turn, count(*) AS n_turns FROM turns GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY first_turn, speaker) AS INTEGER) AS speaker_no FROM s")
def speaker_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who speaks in a conversation, in order of first words."""
    return tr.speaker_registry(conversation_turns(spark, sf_dir))


@query(
    f"""WITH {TURNS} SELECT meeting_id, turn_no, concat_ws(chr(10), lag(text_exact, 2) OVER w, lag(text_exact) OVER w) AS context, CASE WHEN lead(speaker) OVER w <> speaker THEN lead(speaker) OVER w END AS responder
FROM turns WINDOW w AS (PARTITION BY meeting_id ORDER BY turn_no)"""
)
def context_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two turns before each turn, and who answers it."""
    return tr.neighbours(conversation_turns(spark, sf_dir)).select("meeting_id", "turn_no", "context", "responder")


@query(
    f"""WITH {LINES}, c AS (SELECT meeting_id, role AS owner, row_number() OVER (PARTITION BY meeting_id ORDER BY pos) AS p, text FROM items), k AS (SELECT * FROM c WHERE length(text) % 3 <> 0),
g AS (SELECT *, p - row_number() OVER (PARTITION BY meeting_id, owner ORDER BY p) AS run FROM k)
SELECT meeting_id, owner, min(p) AS first_pos, max(p) AS last_pos, string_agg(text, ' ' ORDER BY p) AS quote FROM g GROUP BY meeting_id, owner, run"""
)
def citation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring cited lines of a speaker as one quote; lines whose length 3 divides are not cited."""
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("pos")).cast("bigint")
    rows = line_items(spark, sf_dir).select("meeting_id", F.col("speaker").alias("owner"), n.alias("pos"), "text").filter(F.length("text") % 3 != 0)
    return tr.citation_runs(rows)


_PREV = "lag(text_exact) OVER (PARTITION BY meeting_id ORDER BY turn_no)"
_SET = "list_distinct(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'))"


@query(
    f"""WITH {TURNS}, p AS (SELECT meeting_id, turn_no, {_SET.format(t="text_exact")} AS a, {_SET.format(t=_PREV)} AS b FROM turns),
c AS (SELECT meeting_id, turn_no, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS k FROM p WHERE b IS NOT NULL)
SELECT meeting_id, turn_no, CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE 2.0 * k / (na + nb) END::DOUBLE AS dice, CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE k / (na + nb - k) END::DOUBLE AS jaccard,
CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE k / least(na, nb) END::DOUBLE AS overlap FROM c"""
)
def dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the words of each turn and the one before it are."""
    w = Window.partitionBy("meeting_id").orderBy("turn_no")
    rows = conversation_turns(spark, sf_dir).select("meeting_id", "turn_no", F.array_distinct(tx.word_tokens(F.col("text_exact"))).alias("a"))
    rows = rows.withColumn("b", F.lag("a").over(w)).filter("b is not null")
    a, b = F.col("a"), F.col("b")
    return rows.select("meeting_id", "turn_no", tx.dice(a, b).alias("dice"), tx.jaccard(a, b).alias("jaccard"), tx.overlap(a, b).alias("overlap"))


_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_types, CAST(greatest(len(t) - 1, 0) AS INTEGER) AS n_bigrams FROM (SELECT doc_id, {_TOK} AS t FROM documents)")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, types and bigrams of every document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.word_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_types"), F.greatest(F.size("t") - 1, F.lit(0)).alias("n_bigrams"))


STOP = ("the", "of", "and", "la", "de", "der", "que", "en", "to", "in")
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_all, CAST(len(k) AS INTEGER) AS n_kept, md5(array_to_string(k, ' ')) AS kept FROM (SELECT doc_id, t, list_filter(t, lambda x: NOT list_contains({_STOP_SQL}, x)) AS k FROM (SELECT doc_id, {_TOK} AS t FROM documents))")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without stopwords, repeats kept."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.word_tokens(F.col("text")).alias("t"))
    rows = rows.withColumn("k", tx.without(F.col("t"), STOP))
    return rows.select("doc_id", F.size("t").alias("n_all"), F.size("k").alias("n_kept"), F.md5(F.array_join("k", " ")).alias("kept"))


@query(
    f"""WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents), b AS (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS bigram FROM t)
SELECT bigram, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM b GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5"""
)
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams that five documents or more have."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.word_tokens(F.col("text")).alias("t"))
    rows = rows.select("doc_id", F.explode(tx.bigrams(F.col("t"))).alias("bigram"))
    each = rows.groupBy("bigram", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("bigram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs")).filter("n_docs >= 5")


CUES = ("the", "of the", "la", "der", "que de", "and the")


@query(
    "SELECT meeting_id, turn_no, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_]){c}($|[^\\p{{L}}\\p{{N}}_])') THEN '{c}' END" for c in CUES)
    + f"], lambda x: x IS NOT NULL)::VARCHAR AS cues FROM (WITH {TURNS} SELECT meeting_id, turn_no, lower(trim(regexp_replace(text_exact, '\\s+', ' ', 'g'))) AS t FROM turns)"
)
def cue_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cue phrases stand in a turn as whole words."""
    rows = conversation_turns(spark, sf_dir)
    cues = F.concat(F.lit("["), F.array_join(tx.find_cues(F.col("text_exact"), CUES), ", "), F.lit("]"))
    return rows.select("meeting_id", "turn_no", cues.alias("cues"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok FROM events")
def props_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant reading of JSON properties."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.try_parse_json("props").isNotNull().alias("ok"))


@query(
    f"""WITH {TURNS} SELECT meeting_id, count(*) AS n_turns, CAST(sum(n_items) AS BIGINT) AS n_items, count(DISTINCT speaker) AS n_speakers, (max(end_ms) - min(start_ms)) / 1000.0::DOUBLE AS seconds,
CAST(greatest(1500, least(10000, sum(length(speaker || ': ' || text_exact) + 1) // 15)) AS BIGINT) AS min_segment_chars FROM turns GROUP BY 1"""
)
def transcript_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, speakers, length in seconds and the least size of a segment, per conversation."""
    rows = tr.char_prefix(conversation_turns(spark, sf_dir))
    floor = F.greatest(F.lit(1500), F.least(F.lit(10000), F.floor(F.sum("chars") / 15))).cast("bigint")
    return rows.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(F.size("source_items")).cast("bigint").alias("n_items"), F.count_distinct("speaker").alias("n_speakers"),
        ((F.max("end_ms") - F.min("start_ms")) / 1000.0).alias("seconds"), floor.alias("min_segment_chars"),
    )


@query(
    f"""WITH {TURNS}, c AS (SELECT meeting_id, turn_no, (turn_no - 1) // 3 + 1 AS topic_no, length(coalesce(speaker, 'None') || ': ' || text_exact) + 1 AS chars FROM turns),
p AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY meeting_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT meeting_id, topic_no, 'TOPIC_SEG_' || lpad(topic_no::VARCHAR, 6, '0') AS segment_id, min(turn_no) AS first_turn, max(turn_no) AS last_turn, min(before)::BIGINT AS chars_before, sum(chars)::BIGINT AS chars FROM p GROUP BY meeting_id, topic_no"""
)
def topic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where topics of three turns each begin and end, in turns and characters."""
    rows = tr.char_prefix(conversation_turns(spark, sf_dir)).withColumn("pos", F.col("turn_no"))
    rows = sg.numbered_segments(rows, (F.col("turn_no") - 1) % 3 == 0)
    agg = rows.groupBy("meeting_id", F.col("segment_no").alias("topic_no"), "segment_id")
    return agg.agg(F.min("turn_no").alias("first_turn"), F.max("turn_no").alias("last_turn"), F.min("chars_before").alias("chars_before"), F.sum("chars").alias("chars"))


_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1))"


@query(
    f"""WITH {LINES}, p AS (SELECT meeting_id, pos, {_CONTENT.format(t="text")} AS a, {_CONTENT.format(t="lag(text) OVER (PARTITION BY meeting_id ORDER BY pos)")} AS b FROM items),
c AS (SELECT meeting_id, pos, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS k FROM p WHERE b IS NOT NULL)
SELECT meeting_id, pos, na > 0 AND nb > 0 AND k / nullif(na + nb - k, 0) >= 0.2 AS alike FROM c"""
)
def near_duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of a conversation share a fifth of their words with the line before."""
    rows = line_items(spark, sf_dir).select("meeting_id", "pos", F.array_distinct(F.filter(tx.word_tokens(F.col("text")), lambda x: F.length(x) > 1)).alias("a"))
    rows = rows.withColumn("b", F.lag("a").over(Window.partitionBy("meeting_id").orderBy("pos"))).filter("b is not null")
    return rows.select("meeting_id", "pos", (tx.jaccard(F.col("a"), F.col("b")) >= 0.2).alias("alike"))
