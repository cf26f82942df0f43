"""Labels, discussion points, assignments, decisions and progress from models' answers.

A topic's prompt is built from its turns; what a model answers is read with a tolerant schema,
checked against the topic's turns, and kept only with evidence. Calls go through ``ports``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.dates import resolve_deadline
from parlance.functions.text import STOPWORDS, bare_id, is_assignment_point, is_pronoun, squeeze, without, without_deadline_echo, word_tokens
from parlance.operators import ports

_IDS = "evidence_segment_ids array<string>"
ANSWERS = {
    "content": f"discussion_points array<struct<{_IDS.replace(' array', ': array')}, text: string>>",
    "decision": f"decisions array<struct<{_IDS.replace(' array', ': array')}, confirm_turn_id: string, status: string, text: string>>",
    "action": f"action_items array<struct<{_IDS.replace(' array', ': array')}, confirm_turn_id: string, status: string, actor: string, text: string, deadline: string, deadline_date: string, task_id: string>>",
    "progress": f"updates array<struct<task_id: string, status: string, status_turn_id: string, {_IDS.replace(' array', ': array')}, deadline: string, deadline_date: string, deadline_removed: boolean, summary: string, blockers: array<string>, directive: string>>",
}
ACTION_STATUSES = ("assigned", "self_committed", "proposed", "unclear")
DECISION_STATUSES = ("agreed", "proposed", "rejected", "unclear")
PROGRESS_STATUSES = ("not_started", "in_progress", "done", "blocked", "mentioned")


def topic_prompts(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """(meeting_id, segment_id, prompt): the transcript of each topic, a line per turn.

    ``segments``: meeting_id, segment_id, turn_lo, turn_hi (turn numbers). A topic's turns are
    exploded, so the join is by (meeting_id, turn_no).
    """
    s = segments.select("meeting_id", "segment_id", F.explode(F.sequence(F.col("turn_lo").cast("bigint"), F.col("turn_hi").cast("bigint"))).alias("turn_no"))
    line = F.concat(F.lit("["), "turn_id", F.lit("|"), F.coalesce("speaker", F.lit("?")), F.lit("] "), F.array_join(F.transform("source_items", lambda x: F.concat(F.lit("<"), x["item_id"], F.lit("> "), x["text"])), " "))
    rows = s.join(turns.select("meeting_id", F.col("turn_no").cast("bigint").alias("turn_no"), line.alias("line")), ["meeting_id", "turn_no"])
    grouped = rows.groupBy("meeting_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "line"))).alias("l"))
    return grouped.select("meeting_id", "segment_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("prompt"))


def answers(prompts: DataFrame, agent: str, system: str, make: Callable[[], ports.LLM], schema: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """An agent's elements, one row each (meeting_id, segment_id, pos, x), and its failures (meeting_id, segment_id, agent, error)."""
    asked = ports.ask(prompts, system, "prompt", schema or {}, make)
    read = asked.withColumn("_a", F.from_json("answer", ANSWERS[agent]))
    field = ANSWERS[agent].split(" ")[0]
    rows = read.select("meeting_id", "segment_id", F.posexplode(f"_a.{field}").alias("pos", "x")).filter("x is not null")
    failures = asked.filter("answer_error is not null").select("meeting_id", "segment_id", F.lit(agent).alias("agent"), F.col("answer_error").alias("error"))
    return rows, failures


def resolve_citations(rows: DataFrame, turns: DataFrame, ids: str = "evidence_segment_ids", required: str | None = None) -> DataFrame:
    """Adds item_ids and turn_ids of what a row cites, by item or by turn, decorated or not, in transcript order.

    ``rows`` has meeting_id and row_id. The turn of ``required`` is among the turns; if nothing else
    was cited validly, its items are the evidence. Rows without evidence get empty arrays.
    """
    items = turns.select("meeting_id", "turn_id", "turn_no", F.posexplode("source_items").alias("i", "s")).select("meeting_id", "turn_id", "turn_no", "i", F.col("s.item_id").alias("item_id"))
    cited = rows.select("meeting_id", "row_id", F.explode(F.array_distinct(F.transform(F.coalesce(F.col(ids), F.array().cast("array<string>")), bare_id))).alias("cited"))
    by_item = cited.join(items.withColumn("cited", F.col("item_id")), ["meeting_id", "cited"])
    by_turn = cited.join(items.select("meeting_id").distinct(), "meeting_id", "left_semi").join(items.withColumn("cited", F.col("turn_id")), ["meeting_id", "cited"])
    names = ["meeting_id", "row_id", "turn_no", "i", "turn_id", "item_id"]
    found = by_item.select(*names).unionByName(by_turn.select(*names)).withColumn("given", F.lit(True))
    if required:
        needed = rows.select("meeting_id", "row_id", bare_id(F.col(required)).alias("turn_id")).join(items, ["meeting_id", "turn_id"])
        found = found.unionByName(needed.select(*names).withColumn("given", F.lit(False)))
    agg = found.groupBy("meeting_id", "row_id").agg(F.array_sort(F.collect_set(F.struct("turn_no", "i", "turn_id", "item_id", "given"))).alias("f"), F.bool_or("given").alias("any"))
    kept = F.filter("f", lambda x: x["given"] | ~F.col("any"))
    agg = agg.select("meeting_id", "row_id", F.array_distinct(F.transform(kept, lambda x: x["item_id"])).alias("item_ids"), F.array_distinct(F.transform("f", lambda x: x["turn_id"])).alias("turn_ids"))
    none = F.array().cast("array<string>")
    return rows.join(agg, ["meeting_id", "row_id"], "left").withColumn("item_ids", F.coalesce("item_ids", none)).withColumn("turn_ids", F.coalesce("turn_ids", none))


def _ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_id", F.concat_ws("/", "segment_id", F.col("pos").cast("string")))


def _status(raw: Column, allowed: tuple[str, ...]) -> Column:
    s = F.lower(F.trim(raw))
    return F.when(s.isin(*allowed), s).otherwise("unclear")


def points(elements: DataFrame, turns: DataFrame) -> DataFrame:
    """Discussion points with evidence; those that only hand out a task go. Speakers are those of the cited turns, in order."""
    rows = _ids(elements).select("meeting_id", "segment_id", "pos", "row_id", F.trim("x.text").alias("text"), "x.evidence_segment_ids").filter("text <> ''").filter(~is_assignment_point(F.col("text")))
    rows = resolve_citations(rows, turns).filter(F.size("item_ids") > 0)
    said = rows.select("meeting_id", "row_id", F.explode("turn_ids").alias("turn_id")).join(turns.select("meeting_id", "turn_id", "turn_no", "speaker"), ["meeting_id", "turn_id"]).filter("speaker is not null")
    first = said.groupBy("meeting_id", "row_id", "speaker").agg(F.min("turn_no").alias("n")).groupBy("meeting_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("n", "speaker"))).alias("s"))
    speakers = F.coalesce(F.transform("s", lambda x: x["speaker"]), F.array().cast("array<string>"))
    return rows.join(first, ["meeting_id", "row_id"], "left").select("meeting_id", "segment_id", "pos", "row_id", "text", speakers.alias("speakers"), "item_ids", "turn_ids")


def _confirmed(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """confirm_turn_id, or null if there is no such turn."""
    known = turns.select("meeting_id", F.col("turn_id").alias("confirm_turn_id"), F.lit(True).alias("_known"))
    rows = rows.withColumn("confirm_turn_id", bare_id(F.col("confirm_turn_id"))).join(known, ["meeting_id", "confirm_turn_id"], "left")
    return rows.withColumn("confirm_turn_id", F.when(F.col("_known"), F.col("confirm_turn_id"))).drop("_known")


def decisions(elements: DataFrame, turns: DataFrame) -> DataFrame:
    """Decisions with text and evidence."""
    rows = _ids(elements).select("meeting_id", "segment_id", "pos", "row_id", F.trim("x.text").alias("text"), _status(F.col("x.status"), DECISION_STATUSES).alias("status"), "x.confirm_turn_id", "x.evidence_segment_ids").filter("text <> ''")
    return resolve_citations(_confirmed(rows, turns), turns, required="confirm_turn_id").filter(F.size("item_ids") > 0).drop("evidence_segment_ids")


def actions(elements: DataFrame, turns: DataFrame, meeting_date: Column, tasks: DataFrame | None = None) -> DataFrame:
    """Assignments with text and evidence; pronouns are no actors, deadlines become dates, unknown task ids null."""
    x = F.col("x")
    raw = F.nullif(F.trim(x["deadline"]), F.lit(""))
    rows = _ids(elements).withColumn("_d", resolve_deadline(raw, x["deadline_date"], meeting_date))
    rows = rows.select(
        "meeting_id", "segment_id", "pos", "row_id", without_deadline_echo(F.trim(x["text"]), raw).alias("text"), _status(x["status"], ACTION_STATUSES).alias("status"), x["confirm_turn_id"].alias("confirm_turn_id"), x["evidence_segment_ids"].alias("evidence_segment_ids"),
        F.when((F.trim(x["actor"]) != "") & ~is_pronoun(x["actor"]), squeeze(x["actor"])).alias("actor"), raw.alias("deadline"), F.col("_d.deadline_date").alias("deadline_date"), F.col("_d.deadline_kind").alias("deadline_kind"), F.nullif(F.trim(x["task_id"]), F.lit("")).alias("task_id"),
    ).filter("text <> ''")
    rows = resolve_citations(_confirmed(rows, turns), turns, required="confirm_turn_id").filter(F.size("item_ids") > 0).drop("evidence_segment_ids")
    if tasks is None:
        return rows.withColumn("task_id", F.lit(None).cast("string"))
    known = tasks.select("meeting_id", "task_id", F.lit(True).alias("_known"))
    return rows.join(known, ["meeting_id", "task_id"], "left").withColumn("task_id", F.when(F.col("_known"), F.col("task_id"))).drop("_known")


def updates(elements: DataFrame, turns: DataFrame, tasks: DataFrame, meeting_date: Column) -> DataFrame:
    """Progress reports of known tasks with evidence; at most two blockers, of 200 characters."""
    x = F.col("x")
    raw = F.nullif(F.trim(x["deadline"]), F.lit(""))
    blockers = F.slice(F.filter(F.transform(F.coalesce(x["blockers"], F.array().cast("array<string>")), lambda b: F.substring(F.trim(b), 1, 200)), lambda b: b != ""), 1, 2)
    status = F.lower(F.trim(x["status"]))
    rows = _ids(elements).withColumn("_d", resolve_deadline(raw, x["deadline_date"], meeting_date)).select(
        "meeting_id", "segment_id", "pos", "row_id", x["task_id"].alias("task_id"), F.when(status.isin(*PROGRESS_STATUSES), status).otherwise("mentioned").alias("status"), x["status_turn_id"].alias("confirm_turn_id"), x["evidence_segment_ids"].alias("evidence_segment_ids"),
        raw.alias("deadline"), F.col("_d.deadline_date").alias("deadline_date"), F.coalesce(x["deadline_removed"], F.lit(False)).alias("deadline_removed"), F.trim(x["summary"]).alias("summary"), blockers.alias("blockers"), F.nullif(F.trim(x["directive"]), F.lit("")).alias("directive"),
    )
    rows = rows.join(tasks.select("meeting_id", "task_id"), ["meeting_id", "task_id"], "left_semi")
    out = resolve_citations(_confirmed(rows, turns), turns, required="confirm_turn_id").filter(F.size("item_ids") > 0).drop("evidence_segment_ids")
    return out.withColumnRenamed("confirm_turn_id", "status_turn_id")


TITLE_BLACKLIST = ("thảo luận chung", "nội dung cuộc họp", "các vấn đề khác", "trao đổi chung", "general discussion", "other matters", "meeting content")


def label_issues(title: Column, summary: Column, text: Column, most: int = 1024) -> Column:
    """What is wrong with a topic's label: empty, too long, a stock phrase, or no word of it in the topic."""
    words = lambda c: F.array_distinct(without(word_tokens(c), STOPWORDS))
    stock = F.lit(False)
    for phrase in TITLE_BLACKLIST:
        stock = stock | (F.size(F.array_except(word_tokens(title), word_tokens(F.lit(phrase)))) == 0)
    return F.filter(
        F.array(
            F.when(F.coalesce(F.trim(title), F.lit("")) == "", "no title"),
            F.when(F.length(title) > most, "title is too long"),
            F.when((F.trim(title) != "") & stock, "stock title"),
            F.when((F.trim(title) != "") & (F.size(F.array_intersect(words(title), words(text))) == 0), "title is not about the topic"),
            F.when(F.coalesce(F.trim(summary), F.lit("")) == "", "no summary"),
        ),
        lambda e: e.isNotNull(),
    )


def label_topics(prompts: DataFrame, texts: DataFrame, system: str, make: Callable[[], ports.LLM], attempts: int = 3) -> DataFrame:
    """(meeting_id, segment_id, title, summary, method): the model's label if nothing is wrong with it, asked again if so; else one from the text.

    ``texts``: meeting_id, segment_id, text. Only topics without a good label are asked again.
    """
    left, done = prompts.join(texts, ["meeting_id", "segment_id"]), None
    for n in range(attempts):
        turn = left.withColumn("_p", F.concat("prompt", F.lit("" if not n else f"\n(attempt {n + 1})")))
        asked = ports.ask(turn, system, "_p", {}, make).withColumn("_l", F.from_json("answer", "title string, summary string"))
        asked = asked.withColumn("_bad", label_issues(F.col("_l.title"), F.col("_l.summary"), F.col("text"))).withColumn("_ok", F.col("_l").isNotNull() & (F.size("_bad") == 0))
        good = asked.filter("_ok").select("meeting_id", "segment_id", F.trim("_l.title").alias("title"), F.trim("_l.summary").alias("summary"), F.lit("model").alias("method"))
        done = good if done is None else done.unionByName(good)
        left = asked.filter("not _ok").select("meeting_id", "segment_id", "prompt", "text")
    sentence = F.trim(F.regexp_extract(squeeze(F.col("text")), r"^[^.!?]*", 0))
    spare = left.select("meeting_id", "segment_id", F.substring(sentence, 1, 80).alias("title"), F.substring(squeeze(F.col("text")), 1, 240).alias("summary"), F.lit("extract").alias("method"))
    return done.unionByName(spare)
