"""The three documents of a meeting, content, decisions and tasks, as nested rows with citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import grouping_key

ENVELOPE = ("analysis_key", "document", "document_key", "meeting_id", "version", "computed_at")


def cited(owners: DataFrame, items: DataFrame) -> DataFrame:
    """Citations of owners (meeting_id, owner_id, item_ids) with turn, text, speaker_id, in transcript order, unknown items last.

    ``items``: meeting_id, item_id, pos, turn_id, text, speaker_id.
    """
    rows = owners.select("meeting_id", "owner_id", F.posexplode(F.array_distinct("item_ids")).alias("_i", "item_id")).join(items, ["meeting_id", "item_id"], "left")
    one = F.struct(F.coalesce("pos", F.lit(1 << 62)).alias("order"), F.col("_i").alias("given"), "item_id", "turn_id", "text", "speaker_id")
    grouped = rows.groupBy("meeting_id", "owner_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return grouped.select("meeting_id", "owner_id", F.transform("c", lambda x: F.struct(x["item_id"].alias("item_id"), x["turn_id"].alias("turn_id"), x["text"].alias("text"), x["speaker_id"].alias("speaker_id"))).alias("citations"))


def speaker_ids(items: DataFrame) -> DataFrame:
    """(meeting_id, speaker, speaker_id): the id with which a name is first seen."""
    return items.filter("speaker is not null and speaker_id is not null").groupBy("meeting_id", "speaker").agg(F.min_by("speaker_id", "pos").alias("speaker_id"))


def coverage(segments: DataFrame, failures: DataFrame) -> DataFrame:
    """(meeting_id, n_items, n_covered, coverage) of segments (meeting_id, segment_id, n_items): those in topics without failures."""
    bad = failures.select("meeting_id", "segment_id").distinct().withColumn("_bad", F.lit(True))
    rows = segments.join(bad, ["meeting_id", "segment_id"], "left")
    agg = rows.groupBy("meeting_id").agg(F.sum("n_items").alias("n_items"), F.sum(F.when(F.col("_bad").isNull(), F.col("n_items")).otherwise(0)).alias("n_covered"))
    return agg.withColumn("coverage", F.try_divide("n_covered", "n_items"))


def by_assignee(tasks: DataFrame) -> DataFrame:
    """(meeting_id, group_no, assignee, task_ids, n_tasks) of tasks (meeting_id, task_id, pos, targets): first seen first, tasks of nobody last."""
    named = tasks.select("meeting_id", "task_id", "pos", F.posexplode_outer(F.filter("targets", lambda t: F.trim(t) != "")).alias("_i", "assignee"))
    rows = named.withColumn("key", grouping_key(F.col("assignee")))
    each = rows.groupBy("meeting_id", "key", "task_id").agg(F.min(F.struct("pos", "_i", "assignee")).alias("first"))
    grouped = each.groupBy("meeting_id", "key").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "task_id"))).alias("t"))
    order = Window.partitionBy("meeting_id").orderBy(F.col("key").isNull(), "first")
    return grouped.select("meeting_id", F.row_number().over(order).alias("group_no"), F.col("first.assignee").alias("assignee"), F.transform("t", lambda x: x["task_id"]).alias("task_ids"), F.size("t").alias("n_tasks"))


def content_data(segments: DataFrame, labels: DataFrame, points: DataFrame) -> DataFrame:
    """Topics with their points, in order: (meeting_id, topics).

    ``segments``: meeting_id, segment_id, segment_no. ``labels``: meeting_id, segment_id, title,
    summary. ``points``: meeting_id, segment_id, point_no, text, speakers, citations.
    """
    p = points.groupBy("meeting_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("point_no", "text", "speakers", "citations"))).alias("points"))
    rows = segments.join(labels, ["meeting_id", "segment_id"], "left").join(p, ["meeting_id", "segment_id"], "left")
    topic = F.struct("segment_no", "segment_id", "title", "summary", F.coalesce("points", F.array().cast(dict(p.dtypes)["points"])).alias("points"))
    return rows.groupBy("meeting_id").agg(F.array_sort(F.collect_list(topic)).alias("topics"))


def decisions_data(decisions: DataFrame, segments: DataFrame) -> DataFrame:
    """Decisions by topic, those of unknown topics in a bucket at the end: (meeting_id, groups)."""
    rows = decisions.join(segments.select("meeting_id", "segment_id", "segment_no"), ["meeting_id", "segment_id"], "left")
    each = rows.groupBy("meeting_id", F.coalesce("segment_no", F.lit(1 << 30)).alias("segment_no")).agg(F.array_sort(F.collect_list(F.struct("pos", "decision_id", "text", "citations"))).alias("decisions"))
    return each.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("segment_no", F.when(F.col("segment_no") == 1 << 30, "other").alias("bucket"), "decisions"))).alias("groups"))


def tasks_data(new: DataFrame, backlog: DataFrame, moved: DataFrame) -> DataFrame:
    """New tasks and the agenda's, each of the latter with its relation if one folded into it: (meeting_id, new_tasks, backlog).

    ``new``: meeting_id, task_id, pos, text, assignees, due. ``backlog``: meeting_id, task_id,
    task_no, title, status, due. ``moved``: meeting_id, task_id, relation, due, assignees.
    """
    n = new.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("pos", "task_id", "text", "assignees", "due"))).alias("new_tasks"))
    m = moved.select("meeting_id", "task_id", "relation", F.col("due").alias("moved_due"), F.col("assignees").alias("moved_to"))
    b = backlog.join(m, ["meeting_id", "task_id"], "left").groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("task_no", "task_id", "title", "status", F.coalesce("moved_due", "due").alias("due"), "relation", "moved_to"))).alias("backlog"))
    return n.join(b, "meeting_id", "full_outer")


def envelope(data: DataFrame, document: str, analysis_key: Column, document_key: Column, version: Column, computed_at: Column) -> DataFrame:
    """Rows of a document ready to be stored: the envelope and ``data`` as JSON."""
    inner = F.to_json(F.struct(*[c for c in data.columns if c != "meeting_id"]), {"ignoreNullFields": "false"})
    return data.select(analysis_key.alias("analysis_key"), F.lit(document).alias("document"), document_key.alias("document_key"), "meeting_id", version.alias("version"), computed_at.alias("computed_at"), inner.alias("data"))


def purity(turns: DataFrame, topics: DataFrame) -> DataFrame:
    """How many topic changes fall inside turns: (session, speaker, n_turns, n_topics, excess), speakers of either side."""
    t = turns.groupBy("session", "speaker").agg(F.count(F.lit(1)).alias("n_turns"))
    k = topics.groupBy("session", "speaker").agg(F.count(F.lit(1)).alias("n_topics"))
    rows = t.join(k, ["session", "speaker"], "full_outer").na.fill(0, ["n_turns", "n_topics"])
    return rows.withColumn("excess", F.greatest(F.col("n_topics") - F.col("n_turns"), F.lit(0)))


def topic_counts(points: DataFrame, keys: tuple[str, ...] = ("meeting_id", "segment_id"), distinct: str = "speaker") -> DataFrame:
    """(keys, n_points, n_<distinct>): the points of each topic, and how many different values of a column they have."""
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct(distinct).alias(f"n_{distinct}"))


def top_points(rows: DataFrame, group: str, best: str, key: str, most: int = 6) -> DataFrame:
    """The ``most`` rows of each group with the largest ``best``, ties to the smaller key: a top-k report."""
    order = Window.partitionBy(group).orderBy(F.desc(best), key)
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def usage_ledger(calls: DataFrame, kind: str, failed: Column, tokens: Column) -> DataFrame:
    """(kind, calls, failed, tokens) of logged calls."""
    return calls.groupBy(kind).agg(F.count(F.lit(1)).alias("calls"), F.count_if(failed).alias("failed"), F.sum(tokens).alias("tokens"))


def session_order(rows: DataFrame) -> DataFrame:
    """(place, session, n_turns, n_topics, excess) of ``purity`` by session, the largest excess first."""
    each = rows.groupBy("session").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_topics").alias("n_topics"), F.sum("excess").alias("excess"))
    return each.withColumn("place", F.row_number().over(Window.orderBy(F.desc("excess"), "session")))


def shown_date(day: Column, unknown: str = "") -> Column:
    """A date as it is shown, day first; ``unknown`` where there is none."""
    return F.coalesce(F.date_format(day, "dd/MM/yyyy"), F.lit(unknown))
