"""Checks of extracted candidates, task progress, relations to the agenda, and merging of duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.dates import is_overdue
from parlance.functions.text import COMMIT_CUES, HEDGE_CUES, MIN_JACCARD, MIN_OVERLAP, SIMILARITY_STOPWORDS, find_cues, is_vague, name_key

# --- fixed values -----------------------------------------------------------------------------
CLEAR, REJECTED = 0.8, 0.2
# -----------------------------------------------------------------------------------------------


def _reasons(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda r: r.isNotNull())


def confirm_reason(rows: DataFrame | None = None, cues: list[str] | None = None) -> Column:
    """What is wrong with a confirming turn (confirm_text, p_commit): a judge's probability decides, else the cues."""
    known = F.size(find_cues(F.col("confirm_text"), cues or COMMIT_CUES)) > 0
    judged = F.when(F.col("p_commit") >= CLEAR, None).when(F.col("p_commit") < REJECTED, "confirm turn is no commitment").otherwise("confirm turn is unclear")
    return F.when(F.col("confirm_text").isNull(), "no confirm turn").when(F.col("p_commit").isNotNull(), judged).when(~known, "confirm turn is no commitment")


def check_actions(rows: DataFrame, cues: list[str] | None = None) -> DataFrame:
    """Adds reasons and verdict to actions: actor, grounded, status, confirm_text, confirm_speaker, matched_speaker, p_commit."""
    reasons = _reasons(
        F.when(F.col("actor").isNull(), "no actor"),
        F.when(F.col("actor").isNotNull() & is_vague(F.col("actor")), "vague actor"),
        F.when(F.col("actor").isNotNull() & ~is_vague(F.col("actor")) & ~F.col("grounded"), "actor not in the topic"),
        F.when(~F.coalesce(F.col("status").isin("assigned", "self_committed"), F.lit(False)), "status is not clear"),
        confirm_reason(cues=cues),
        F.when((F.col("status") == "self_committed") & (name_key(F.col("matched_speaker")) != name_key(F.col("confirm_speaker"))), "someone else committed"),
    )
    return rows.withColumn("reasons", reasons).withColumn("verdict", F.when(F.size("reasons") == 0, "clear").otherwise("uncertain"))


def check_decisions(rows: DataFrame, cues: list[str] | None = None, hedges: list[str] | None = None) -> DataFrame:
    """Adds reasons and verdict to decisions: text, status, confirm_text, p_commit. Hedges count only without a judge."""
    hedged = F.col("p_commit").isNull() & (F.size(find_cues(F.col("text"), hedges or HEDGE_CUES)) > 0)
    reasons = _reasons(F.when(~F.coalesce(F.col("status") == "agreed", F.lit(False)), "not agreed"), F.when(hedged, "hedged"), confirm_reason(cues=cues))
    return rows.withColumn("reasons", reasons).withColumn("verdict", F.when(F.size("reasons") == 0, "clear").otherwise("uncertain"))


def actor_grounded(parts: Column, haystack: Column) -> Column:
    """Whether every part of an actor stands in the topic's text or names as whole words."""
    return F.forall(parts, lambda p: F.regexp_like(F.lower(haystack), F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.lower(p), F.lit(r"\E(?!\w)"))))


REPORTS = ("in_progress", "done", "blocked", "not_started")


def check_status(updates: DataFrame, judged: DataFrame) -> DataFrame:
    """Adds checked_status, flag and status_pos to updates (update_id, status, generic_question).

    ``judged`` has a row per candidate turn: update_id, turn_rank (the status turn first, then
    evidence turns from the latest), pos, labels (map of probabilities) and failed. The first turn
    that confirms the status keeps it; else a clear other label of the first turn revises it; else
    a report may stay under a generic question; else it falls to ``mentioned``.
    """
    p = F.coalesce(F.try_element_at("labels", F.col("status")), F.lit(0.0))
    rows = judged.join(updates.select("update_id", "status", "generic_question"), "update_id")
    any_report = F.aggregate(F.map_values(F.map_filter("labels", lambda k, v: k.isin(*REPORTS))), F.lit(0.0), lambda s, x: s + x)
    other = F.map_filter("labels", lambda k, v: (v >= CLEAR) & (k != F.col("status")) & k.isin(*REPORTS) & ~(F.col("generic_question") & F.col("status").isin(*REPORTS)))
    rows = rows.withColumn("_ok", p >= CLEAR).withColumn("_other", F.get(F.map_keys(other), F.lit(0))).withColumn("_report", any_report)
    first = F.struct("turn_rank", "_other", "_report")
    agg = rows.groupBy("update_id").agg(
        F.min_by("pos", F.when(F.col("_ok"), F.col("turn_rank"))).alias("_okpos"), F.max(F.col("_ok")).alias("_any"), F.min(first).alias("_f"), F.min(F.when(F.col("failed"), F.col("turn_rank"))).alias("_failed"), F.min(F.when(F.col("_ok"), F.col("turn_rank"))).alias("_okrank"),
    )
    out = updates.join(agg, "update_id", "left")
    broke = F.col("_failed").isNotNull() & (F.col("_okrank").isNull() | (F.col("_failed") < F.col("_okrank")))
    kept = F.col("generic_question") & F.col("status").isin(*REPORTS) & (F.col("_f._report") >= CLEAR)
    flag = F.when(F.col("_f").isNull() | broke, "unchecked").when(F.col("_any"), "confirmed").when(F.col("_f._other").isNotNull(), "revised").when(kept, "kept").otherwise("uncertain")
    status = F.when(flag == "revised", F.col("_f._other")).when(flag == "uncertain", "mentioned").otherwise(F.col("status"))
    return out.withColumn("flag", flag).withColumn("checked_status", status).withColumn("status_pos", F.when(flag == "confirmed", F.col("_okpos"))).drop("_okpos", "_any", "_f", "_failed", "_okrank")


def candidate_turns(updates: DataFrame, turns: DataFrame) -> DataFrame:
    """(update_id, turn_rank, pos, text) of the turns that may confirm an update: its status turn, then its evidence's from the latest.

    ``updates``: meeting_id, update_id, status_turn_id, turn_ids.
    """
    named = updates.select("meeting_id", "update_id", "status_turn_id", F.explode(F.array_distinct(F.filter(F.concat(F.array("status_turn_id"), "turn_ids"), lambda t: t.isNotNull()))).alias("turn_id"))
    rows = named.join(turns.select("meeting_id", "turn_id", F.col("turn_no").alias("pos"), F.col("text_exact").alias("text")), ["meeting_id", "turn_id"])
    w = Window.partitionBy("meeting_id", "update_id").orderBy(F.coalesce(F.col("turn_id") == F.col("status_turn_id"), F.lit(False)).desc(), F.desc("pos"))
    return rows.select("update_id", (F.row_number().over(w) - 1).alias("turn_rank"), "pos", "text")


def check_mentions(updates: DataFrame, judged: DataFrame) -> DataFrame:
    """Mentioned updates (update_id, status) by their evidence turns' labels: dropped, raised to a report or directive, or kept.

    ``judged``: update_id, turn_rank, labels, p_commit. Updates with no judged turn are unchecked.
    """
    p = lambda name: F.coalesce(F.try_element_at("labels", F.lit(name)), F.lit(0.0))
    best = F.map_filter("labels", lambda k, v: k.isin(*REPORTS) & (v >= CLEAR))
    related = p("unrelated") < CLEAR
    rows = judged.withColumn("_rel", related).withColumn("_report", F.get(F.map_keys(best), F.lit(0))).withColumn("_dir", (p("directive") >= CLEAR) & (F.coalesce("p_commit", F.lit(0.0)) >= CLEAR))
    agg = rows.groupBy("update_id").agg(F.max("_rel").alias("_any"), F.min(F.when(F.col("_rel"), F.struct("turn_rank", "_report"))).alias("_first"), F.max(F.col("_rel") & F.col("_dir")).alias("_dir"))
    out = updates.join(agg, "update_id", "left").filter(F.col("_any").isNull() | F.col("_any"))
    status = F.coalesce(F.col("_first._report"), F.when(F.col("_dir"), "directive"), F.col("status"))
    flag = F.when(F.col("_any").isNull(), "unchecked").when(status != F.col("status"), "raised").otherwise("kept")
    return out.withColumn("checked_status", status).withColumn("flag", flag).drop("_any", "_first", "_dir")


def merge_same_task(updates: DataFrame) -> DataFrame:
    """One update per topic and task: the most informative, then the latest; evidence of all, its own first."""
    keys = ["meeting_id", "segment_id", "task_id"]
    rank = F.struct(F.col("informative").cast("int"), F.col("pos"), -F.col("update_no"))
    agg = updates.groupBy(*keys).agg(F.max_by(F.struct("update_no", "status", "evidence_ids", "pos"), rank).alias("b"), F.array_sort(F.collect_list(F.struct("update_no", "evidence_ids"))).alias("_all"))
    rest = F.flatten(F.transform("_all", lambda x: x["evidence_ids"]))
    return agg.select(*keys, "b.update_no", "b.status", "b.pos", F.array_distinct(F.concat(F.col("b.evidence_ids"), rest)).alias("evidence_ids"))


def task_progress(tasks: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Every task of the agenda with what the meeting says of it.

    ``tasks``: the keys, due, meeting_date. ``updates``: the keys, pos, status, uncertain,
    is_directive, deadline, deadline_removed. The latest directive wins, else the latest confirmed
    update, else the latest; so for the deadline. A task is in conflict when it is done and
    confirmed updates differ.
    """
    confirmed = (F.col("status") != "mentioned") & ~F.col("uncertain")
    has_date = F.col("deadline").isNotNull() | F.col("deadline_removed")
    rank = F.struct(confirmed.cast("int"), (confirmed & F.col("is_directive")).cast("int"), "pos")
    agg = updates.groupBy(*keys).agg(
        F.max_by("status", rank).alias("status"),
        F.max_by("pos", rank).alias("deciding_pos"),
        F.max_by(F.struct("deadline", has_date.alias("has")), rank).alias("_own"),
        F.max_by(F.struct("deadline"), F.when(has_date, F.col("pos"))).alias("_last"),
        F.count_distinct(F.when(confirmed, F.col("status"))).alias("n_statuses"),
        F.count(F.lit(1)).alias("n_updates"),
    )
    rows = tasks.join(agg, list(keys), "left")
    new_due = F.when(F.coalesce(F.col("_own.has"), F.lit(False)), F.col("_own.deadline")).otherwise(F.col("_last.deadline"))
    status = F.coalesce("status", F.lit("not_reported"))
    return rows.select(
        *keys, "due", status.alias("status"), "deciding_pos", new_due.alias("new_due"), F.coalesce("n_updates", F.lit(0)).alias("n_updates"),
        (F.coalesce(F.col("status") == "done", F.lit(False)) & (F.col("n_statuses") >= 2)).alias("conflict"), is_overdue(F.coalesce(new_due, F.col("due")), F.col("meeting_date"), status).alias("overdue"),
    )


def relation(has_agenda: Column, task_known: Column, status: Column, assignees: Column, parties: Column, due: Column, agenda_due: Column) -> Column:
    """How an assignment relates to the agenda: new, reassign, reschedule, follow_up, or null without an agenda."""
    given = ~F.coalesce(status.isin("self_committed", "reported"), F.lit(False))
    return (
        F.when(~has_agenda, None)
        .when(~F.coalesce(task_known, F.lit(False)), "new")
        .when(given & (F.size(assignees) > 0) & ~F.arrays_overlap(assignees, parties), "reassign")
        .when(due.isNotNull() & agenda_due.isNotNull() & (due != agenda_due), "reschedule")
        .otherwise("follow_up")
    )


# --- merging: the result depends on the order, so one meeting at a time -----------------------------


def _tokens(text: str, drop: frozenset[str]) -> frozenset[str]:
    import re
    import unicodedata

    return frozenset(w for w in re.findall(r"\w+", unicodedata.normalize("NFC", text or "").casefold()) if len(w) > 1 and w not in drop)


def _same(a: frozenset[str], b: frozenset[str]) -> bool:
    k = len(a & b)
    return bool(a) and bool(b) and k / len(a | b) >= MIN_JACCARD and k / min(len(a), len(b)) >= MIN_OVERLAP


def _union(a: list, b: list) -> list:
    return list(dict.fromkeys([*a, *b]))


def merge_assignments(rows: DataFrame) -> DataFrame:
    """Duplicate assignments (meeting_id, pos, actor_key, task_id, text, deadline, evidence_ids) merged by first fit.

    The kept one is compared as it stands then, so the order matters. The one with a deadline wins,
    else the longer text; evidence of both stays, the winner's first. Adds n_merged.
    """
    from pyspark.sql.types import StructType

    schema = StructType(list(rows.schema.fields)).add("n_merged", "integer")
    stop = frozenset(SIMILARITY_STOPWORDS)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for row in part.sort_values("pos").to_dict("records"):
            row |= {"n_merged": 1, "evidence_ids": list(row["evidence_ids"])}
            drop = stop | _tokens(row["actor_key"] or "", frozenset())
            for i, old in enumerate(kept):
                clash = row["task_id"] and old["task_id"] and row["task_id"] != old["task_id"]
                if (row["actor_key"] or "") == (old["actor_key"] or "") and not clash and _same(_tokens(old["text"], drop), _tokens(row["text"], drop)):
                    dated = [x["deadline"] is not None and x["deadline"] == x["deadline"] for x in (old, row)]
                    wins = dated[1] > dated[0] or (dated[0] == dated[1] and len(row["text"]) > len(old["text"]))
                    base, other = (row, old) if wins else (old, row)
                    kept[i] = base | {"pos": old["pos"], "task_id": base["task_id"] or other["task_id"], "evidence_ids": _union(base["evidence_ids"], other["evidence_ids"]), "n_merged": old["n_merged"] + 1}
                    break
            else:
                kept.append(row)
        return pd.DataFrame(kept, columns=[f.name for f in schema.fields])

    return rows.groupBy("meeting_id").applyInPandas(run, schema)


def merge_decisions(rows: DataFrame) -> DataFrame:
    """Duplicate decisions (meeting_id, pos, text, evidence_ids) merged by first fit; the longer text stays. Adds n_merged."""
    from pyspark.sql.types import StructType

    schema = StructType(list(rows.schema.fields)).add("n_merged", "integer")
    stop = frozenset(SIMILARITY_STOPWORDS)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for row in part.sort_values("pos").to_dict("records"):
            row |= {"n_merged": 1, "evidence_ids": list(row["evidence_ids"])}
            for i, old in enumerate(kept):
                if _same(_tokens(old["text"], stop), _tokens(row["text"], stop)):
                    base, other = (row, old) if len(row["text"]) > len(old["text"]) else (old, row)
                    kept[i] = base | {"pos": old["pos"], "evidence_ids": _union(base["evidence_ids"], other["evidence_ids"]), "n_merged": old["n_merged"] + 1}
                    break
            else:
                kept.append(row)
        return pd.DataFrame(kept, columns=[f.name for f in schema.fields])

    return rows.groupBy("meeting_id").applyInPandas(run, schema)


def latest_by_task(rows: DataFrame) -> DataFrame:
    """Reassigning and rescheduling rows fold into their meeting's task, the last one wins; others stay (meeting_id, relation, task_id, pos)."""
    folds = F.coalesce(F.col("relation").isin("reassign", "reschedule"), F.lit(False))
    n = F.row_number().over(Window.partitionBy("meeting_id", "task_id").orderBy(F.desc("pos")))
    return rows.filter(~folds).unionByName(rows.filter(folds).withColumn("_n", n).filter("_n = 1").drop("_n"))
