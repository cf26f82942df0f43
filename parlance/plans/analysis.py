"""From turns and topics to the three documents: the whole analysis as one lazy plan of tables.

Cheap checks come first and in their own stages: only candidates that the rules leave uncertain
reach the verifier, and tables between a filter and a model call are written, so that Spark never
calls a model for rows that a filter drops.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import grouping_key, name_key
from parlance.operators import actors, documents, extraction, ports, progress
from parlance.operators.verifier import verified
from parlance.sources.shared import written


@dataclass
class Report:
    """What an analysis gives, as tables."""

    labels: DataFrame
    points: DataFrame
    assignments: DataFrame
    decisions: DataFrame
    records: DataFrame
    failures: DataFrame
    content: DataFrame
    decided: DataFrame
    tasks: DataFrame | None
    progress: DataFrame | None
    coverage: DataFrame


def _with_confirm(rows: DataFrame, turns: DataFrame, make_judge: Callable[[], ports.Judge] | None, cues: list[str] | None) -> DataFrame:
    said = turns.select("meeting_id", F.col("turn_id").alias("confirm_turn_id"), F.col("text_exact").alias("confirm_text"), F.col("speaker").alias("confirm_speaker"))
    rows = rows.join(said, ["meeting_id", "confirm_turn_id"], "left")
    if make_judge is None:
        return rows.withColumn("p_commit", F.lit(None).cast("double"))
    judged = ports.judge(rows, "confirm_text", make_judge)
    return judged.withColumn("p_commit", F.try_element_at("labels", F.lit("commit"))).drop("labels", "labels_failed")


def analyze(
    turns: DataFrame,
    segments: DataFrame,
    people: DataFrame,
    organizations: DataFrame,
    meeting_date: Column,
    make: Callable[[], ports.LLM],
    make_judge: Callable[[], ports.Judge] | None = None,
    cues: list[str] | None = None,
    hedges: list[str] | None = None,
    tasks: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = written,
    evidence: bool = True,
) -> Report:
    """``turns`` as ``transcripts.turns`` gives them; ``segments``: meeting_id, segment_id, segment_no, turn_lo, turn_hi.

    ``tasks``, the agenda if there is one: meeting_id, task_id, task_no, title, owner and support
    (names and ids as ``payloads.parse_agendas`` gives them), due. Without it there is no progress.
    ``keep`` holds a table between stages; by default it is written to the shared folder and read again.
    ``evidence`` off leaves the rules out: everything goes to the verifier.
    """
    prompts = keep(extraction.topic_prompts(segments, turns))
    texts = prompts.select("meeting_id", "segment_id", F.col("prompt").alias("text"))
    labels = keep(extraction.label_topics(prompts, texts, "label", make))
    found = {agent: tuple(map(keep, extraction.answers(prompts, agent, agent, make))) for agent in ("content", "decision", "action")}
    points = keep(extraction.points(found["content"][0], turns))

    decided = progress.check_decisions(_with_confirm(extraction.decisions(found["decision"][0], turns), turns, make_judge, cues), cues, hedges)
    acted = _with_confirm(extraction.actions(found["action"][0], turns, meeting_date, tasks), turns, make_judge, cues)
    acted = keep(acted)
    named = actors.parties_of(acted, people, organizations).groupBy("meeting_id", "row_id").agg(F.collect_list("mention").alias("_parts"))
    acted = acted.join(named, ["meeting_id", "row_id"], "left").join(texts.withColumnRenamed("text", "_topic"), ["meeting_id", "segment_id"])
    acted = acted.withColumn("grounded", F.coalesce(progress.actor_grounded(F.col("_parts"), F.col("_topic")), F.lit(False))).drop("_topic", "_parts")
    acted = keep(progress.check_actions(acted.withColumn("matched_speaker", F.col("actor")), cues))
    open_ = actors.resolved_parties(acted, people, organizations, turns, keep).select("meeting_id", "row_id", actors.ambiguity(F.col("assignees")).alias("_open"))
    acted = acted.join(open_, ["meeting_id", "row_id"], "left")
    acted = acted.withColumn("reasons", F.concat("reasons", F.array_compact(F.array("_open")))).withColumn("verdict", F.when(F.size("reasons") == 0, "clear").otherwise("uncertain")).drop("_open")
    if not evidence:
        off = {"reasons": F.array(F.lit("not checked")), "verdict": F.lit("uncertain")}
        decided, acted = decided.withColumns(off), acted.withColumns(off)
    decided, acted = keep(decided), keep(acted)

    pending = acted.filter("verdict = 'uncertain'").select("meeting_id", F.concat(F.lit("a/"), "row_id").alias("candidate_id"), F.lit("assignment").alias("kind"), "text", "actor")
    pending = pending.unionByName(decided.filter("verdict = 'uncertain'").select("meeting_id", F.concat(F.lit("d/"), "row_id").alias("candidate_id"), F.lit("decision").alias("kind"), "text", F.lit(None).cast("string").alias("actor")))
    known = people.select("meeting_id", F.col("full_name").alias("name"), F.lit("person").alias("kind"), F.array().cast("array<string>").alias("aliases"))
    known = known.unionByName(organizations.select("meeting_id", "name", F.lit("organization").alias("kind"), "aliases"))
    records = keep(verified(keep(pending), turns, make, roster=known))

    def settled(rows: DataFrame, prefix: str) -> DataFrame:
        """Clear rows, and uncertain ones as their record leaves them."""
        r = records.filter("kept").select("meeting_id", F.expr("substring(candidate_id, 3)").alias("row_id"), F.col("text").alias("_t"), F.col("actor").alias("_a"), F.left("candidate_id", F.lit(1)).alias("_k")).filter(F.col("_k") == prefix).drop("_k")
        doubtful = rows.filter("verdict = 'uncertain'").join(r, ["meeting_id", "row_id"]).withColumn("text", F.col("_t"))
        if "actor" in rows.columns:
            doubtful = doubtful.withColumn("actor", F.col("_a"))
        return rows.filter("verdict = 'clear'").unionByName(doubtful.drop("_t", "_a"))

    order = segments.select("meeting_id", "segment_id", "segment_no")
    place = (F.col("segment_no").cast("bigint") * 1_000_000 + F.when(F.col("verdict") == "clear", 0).otherwise(500_000) + F.col("pos")).alias("pos")
    kept = settled(decided, "d").join(order, ["meeting_id", "segment_id"])
    decisions = keep(progress.merge_decisions(kept.select("meeting_id", place, "segment_id", "row_id", "text", F.col("item_ids").alias("evidence_ids"))))
    mine = settled(acted, "a").join(order, ["meeting_id", "segment_id"])
    mine = progress.merge_assignments(
        mine.select("meeting_id", place, "segment_id", "row_id", F.coalesce(grouping_key(F.col("actor")), F.lit("")).alias("actor_key"), "actor", "status", "confirm_turn_id", "task_id", "text", F.col("deadline_date").cast("string").alias("deadline"), F.col("item_ids").alias("evidence_ids"))
    )
    mine = keep(mine)
    assignments = keep(mine.drop("confirm_turn_id").join(actors.resolved_parties(mine, people, organizations, turns, keep), ["meeting_id", "row_id"], "left"))

    failures = found["content"][1].unionByName(found["decision"][1]).unionByName(found["action"][1])
    items = turns.select("meeting_id", "turn_id", "turn_no", "speaker", F.posexplode("source_items").alias("i", "s"))
    items = items.select("meeting_id", F.col("s.item_id").alias("item_id"), (F.col("turn_no").cast("bigint") * 100_000 + F.col("i")).alias("pos"), "turn_id", F.col("s.text").alias("text"), F.col("speaker").alias("speaker_id"))
    cited = documents.cited(points.select("meeting_id", F.col("row_id").alias("owner_id"), "item_ids"), items)
    shown = points.join(cited.withColumnRenamed("owner_id", "row_id"), ["meeting_id", "row_id"], "left").select("meeting_id", "segment_id", F.col("pos").alias("point_no"), "text", "speakers", "citations")
    content = documents.content_data(order, labels, shown)
    sizes = segments.select("meeting_id", "segment_id", F.explode(F.sequence(F.col("turn_lo").cast("bigint"), F.col("turn_hi").cast("bigint"))).alias("turn_no")).join(turns.select("meeting_id", F.col("turn_no").cast("bigint").alias("turn_no"), F.greatest(F.size("source_items"), F.lit(1)).alias("n")), ["meeting_id", "turn_no"])
    covered = documents.coverage(sizes.groupBy("meeting_id", "segment_id").agg(F.sum("n").alias("n_items")), failures)
    quoted = documents.cited(decisions.select("meeting_id", F.col("row_id").alias("owner_id"), F.col("evidence_ids").alias("item_ids")), items).withColumnRenamed("owner_id", "row_id")
    told = decisions.join(quoted, ["meeting_id", "row_id"], "left").select("meeting_id", "segment_id", "pos", F.col("row_id").alias("decision_id"), "text", "citations")
    by_topic = documents.decisions_data(told, order)
    if tasks is None:
        return Report(labels, points, assignments, decisions, records, failures, content, by_topic, None, None, covered)

    rolled, lost = task_reports(prompts, turns, order, tasks, meeting_date, make, make_judge, keep)
    related = with_relation(assignments, tasks)
    to_names = F.coalesce(F.transform("assignees", lambda x: F.coalesce(x["name"], x["mention"])), F.array("assignee"))
    moved = progress.latest_by_task(related.filter(F.col("relation").isin("reassign", "reschedule"))).select("meeting_id", "task_id", "relation", F.col("deadline").cast("date").alias("due"), to_names.alias("assignees"))
    fresh = related.filter(~F.col("relation").isin("reassign", "reschedule")).select("meeting_id", F.col("row_id").alias("task_id"), "pos", "text", to_names.alias("assignees"), F.col("deadline").cast("date").alias("due"))
    backlog = tasks.select("meeting_id", "task_id", "task_no", "title").join(rolled.select("meeting_id", "task_id", "status", F.coalesce("new_due", "due").alias("due")), ["meeting_id", "task_id"])
    return Report(labels, points, keep(related), decisions, records, failures.unionByName(lost), content, by_topic, documents.tasks_data(fresh, backlog, moved), rolled, covered)


def with_relation(assignments: DataFrame, tasks: DataFrame) -> DataFrame:
    """Assignments with how each relates to the agenda; the task id of a new one is cleared."""
    parties = F.filter(F.array_union(F.array("owner.name"), F.transform(F.coalesce("support", F.array()), lambda x: x["name"])), lambda n: n.isNotNull())
    known = tasks.select("meeting_id", "task_id", F.col("due").alias("_due"), F.transform(parties, lambda n: name_key(n)).alias("_parties"), F.lit(True).alias("_known"))
    rows = assignments.join(known, ["meeting_id", "task_id"], "left")
    mine = F.coalesce(F.filter(F.transform("assignees", lambda x: name_key(x["name"])), lambda n: n.isNotNull()), F.array().cast("array<string>"))
    rel = progress.relation(F.lit(True), F.col("_known"), F.col("status"), mine, F.coalesce("_parties", F.array().cast("array<string>")), F.col("deadline").cast("date"), F.col("_due"))
    return rows.withColumn("relation", rel).withColumn("task_id", F.when(F.col("relation") != "new", F.col("task_id"))).drop("_due", "_parties", "_known")


def task_reports(prompts: DataFrame, turns: DataFrame, order: DataFrame, tasks: DataFrame, meeting_date: Column, make: Callable[[], ports.LLM], make_judge: Callable[[], ports.Judge] | None, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Every task of the agenda with what the meeting reports of it, and the failed calls.

    With a judge, a status must be confirmed by a turn, and mentions are dropped or raised by what
    their turns are; without one, a status without a turn of its own is only a mention.
    """
    found, failures = map(keep, extraction.answers(prompts, "progress", "progress", make))
    rows = extraction.updates(found, turns, tasks, meeting_date)
    rows = keep(rows.withColumn("update_id", F.concat_ws("/", "meeting_id", "row_id")).withColumn("generic_question", F.lit(True)))
    if make_judge is None:
        alone = F.col("status_turn_id").isNull() & (F.col("status") != "mentioned")
        rows = rows.withColumn("checked_status", F.when(alone, "mentioned").otherwise(F.col("status"))).withColumn("flag", F.when(alone, "uncertain").otherwise("unchecked"))
    else:
        judged = ports.judge(progress.candidate_turns(rows, turns), "text", make_judge)
        judged = keep(judged.select("update_id", "turn_rank", "pos", F.coalesce("labels", F.create_map().cast("map<string,double>")).alias("labels"), F.col("labels_failed").alias("failed"), F.try_element_at("labels", F.lit("commit")).alias("p_commit")))
        stated = progress.check_status(rows.filter("status <> 'mentioned'"), judged).drop("status_pos")
        mentioned = progress.check_mentions(rows.filter("status = 'mentioned'"), judged.drop("failed"))
        rows = stated.unionByName(mentioned)
    last = turns.select("meeting_id", F.col("turn_id").alias("_t"), "turn_no")
    place = rows.select("meeting_id", "update_id", F.explode("turn_ids").alias("_t")).join(last, ["meeting_id", "_t"]).groupBy("meeting_id", "update_id").agg(F.max("turn_no").alias("pos_turn"))
    rows = rows.join(place, ["meeting_id", "update_id"], "left").join(order, ["meeting_id", "segment_id"])
    pos = F.coalesce("pos_turn", F.lit(0)).cast("bigint") * 1_000_000 + F.col("segment_no") * 1_000 + F.col("pos")
    said = rows.select("meeting_id", "task_id", pos.alias("pos"), F.when(F.col("checked_status") == "directive", "mentioned").otherwise(F.col("checked_status")).alias("status"), (F.col("flag") == "uncertain").alias("uncertain"), F.col("directive").isNotNull().alias("is_directive"), F.col("deadline_date").alias("deadline"), "deadline_removed")
    agenda = tasks.select("meeting_id", "task_id", "due", meeting_date.cast("date").alias("meeting_date"))
    return keep(progress.task_progress(agenda, said, ("meeting_id", "task_id"))), failures
