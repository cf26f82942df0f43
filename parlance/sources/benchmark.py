"""Gold, manifests and predictions of a benchmark of meetings, as checked tables.

As with transcripts, one row holds one JSON text, nothing raises, and what is wrong with a row is in
its errors column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXT = "id string, text string, topic_index int, evidence_turn_ids array<string>"
GOLD = (
    "meeting_id string, meeting_date string, source string, n_turns int, total_chars bigint, boundaries array<int>, speakers map<string,string>, tags array<string>,"
    " topics array<struct<index int, title string, summary string, turn_range array<int>, turn_ids array<string>, chars int, same_topic_as int>>,"
    " assignments array<struct<id string, actor string, actor_aliases array<string>, task string, deadline string, topic_index int, evidence_turn_ids array<string>>>,"
    f" decisions array<struct<{_TEXT}>>, negatives array<struct<id string, type string, text string, topic_index int, evidence_turn_ids array<string>>>,"
    " key_points array<struct<id string, speaker string, point string, topic_index int, evidence_turn_ids array<string>>>"
)
MANIFEST = (
    "meeting_id string, title string, meeting_type string, length_bucket string, split string, tags array<string>, n_items int, n_turns int, n_topics int, total_chars bigint,"
    " topic_chars array<int>, n_assignments int, n_decisions int, n_negatives int"
)
OUTPUT = {
    "topics": "array<struct<start_turn string, title string>>",
    "assignments": "array<struct<actor string, task string, deadline string, evidence_turn_ids array<string>>>",
    "decisions": "array<struct<text string, evidence_turn_ids array<string>>>",
    "discussion": "array<struct<text string, speakers array<string>, evidence_turn_ids array<string>>>",
}
PREDICTION = (
    "meeting_id string, method string, model string, cache_key string, git_sha string, finished_at string, status string, error string, output string,"
    " usage struct<calls int, failed_attempts int, prompt_tokens int, completion_tokens int, seconds double>, input_chars int"
)
NEGATIVES = ("hedged_proposal", "superseded_decision", "unassigned_task", "rejected_task")


def _errors(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda e: e.isNotNull()).alias("errors")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def parse_gold(rows: DataFrame) -> DataFrame:
    """The gold of meetings (source, payload), with errors for a missing id, number of turns, or an unknown kind of negative."""
    g = rows.select(F.col("source").alias("file"), F.from_json("payload", GOLD).alias("g")).select("file", "g.*")
    odd = F.exists(F.coalesce(F.transform("negatives", lambda x: x["type"]), F.array().cast("array<string>")), lambda t: ~F.coalesce(t.isin(*NEGATIVES), F.lit(False)))
    return g.select("*", _errors(F.when(_blank(F.col("meeting_id")), "no meeting id"), F.when(F.col("n_turns").isNull(), "no number of turns"), F.when(odd, "unknown kind of negative")))


def gold_items(gold: DataFrame, name: str) -> DataFrame:
    """One row per assignment, decision, negative or key point: meeting_id, item_no, its fields, and evidence."""
    rows = gold.select("meeting_id", F.posexplode(name).alias("item_no", "x")).select("meeting_id", "item_no", "x.*")
    return rows.withColumn("evidence", F.coalesce("evidence_turn_ids", F.array().cast("array<string>"))).drop("evidence_turn_ids")


def parse_manifests(rows: DataFrame) -> DataFrame:
    """The rows of manifests (payload: a list), with errors for a missing id."""
    m = rows.select(F.explode(F.from_json("payload", f"array<struct<{MANIFEST}>>")).alias("m")).select("m.*")
    return m.select("*", _errors(F.when(_blank(F.col("meeting_id")), "no meeting id")))


def common_schema(raw: Column) -> Column:
    """A method's raw JSON output with the four lists that all methods share; missing ones are empty, other keys go."""
    x = F.from_json(raw, ", ".join(f"{name} {kind}" for name, kind in OUTPUT.items()))
    return F.struct(*[F.coalesce(x[name], F.array().cast(kind.replace(" string", ": string").replace(" array", ": array"))).alias(name) for name, kind in OUTPUT.items()])


def parse_predictions(rows: DataFrame) -> DataFrame:
    """Stored results of methods (payload), their output in the common schema, with errors for a missing id or an unknown status."""
    p = rows.select(F.from_json("payload", PREDICTION).alias("p")).select("p.*")
    bad = F.when(~F.coalesce(F.col("status").isin("ok", "error"), F.lit(False)), "unknown status")
    return p.select("*", common_schema(F.col("output")).alias("result"), _errors(F.when(_blank(F.col("meeting_id")), "no meeting id"), bad))


def turn_counts(gold: DataFrame, turns: DataFrame) -> DataFrame:
    """(meeting_id, n_turns, built): meetings whose turns are not as many as the gold counts, whose ids would be off."""
    built = turns.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("built"))
    rows = gold.select("meeting_id", "n_turns").join(built, "meeting_id", "left").withColumn("built", F.coalesce("built", F.lit(0)))
    return rows.filter(~F.col("n_turns").eqNullSafe(F.col("built")))


def rendered(turns: DataFrame) -> DataFrame:
    """(meeting_id, prompt, chars): a meeting as the lines that a method is shown, "[turn] speaker: text"."""
    line = F.format_string("[%s] %s: %s", "turn_id", F.coalesce("speaker", F.lit("None")), "text_exact")
    each = turns.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", line.alias("line")))).alias("t"))
    return each.select("meeting_id", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("prompt")).withColumn("chars", F.length("prompt"))
