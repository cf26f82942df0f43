"""From raw transcript items to evidence, speaker turns and topics' spans.

Every function is DataFrame to DataFrame, keyed by meeting_id and an explicit position; one
exchange on meeting_id serves them all. A meeting is the unit of order, so its rows meet in a
task; meetings are bounded, tables are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import squeeze, turn_chars, url_quoted

# --- fixed values -----------------------------------------------------------------------------
UNKNOWN_SPEAKER = r"(?iU)^(?:người nói (?:không|chưa) xác định|(?:unknown|unidentified) speaker|speaker unknown)(?: \d+)?$"
ROLES = {
    "chair": "chair", "chủ trì": "chair", "chu tri": "chair",
    "presenter": "presenter", "báo cáo viên": "presenter", "bao cao vien": "presenter",
    "delegate": "delegate", "đại biểu": "delegate", "dai bieu": "delegate",
}
MAX_GAP_MS = 5000
# -----------------------------------------------------------------------------------------------


def clean_speaker(name: Column) -> Column:
    """The speaker's name, or null for an unknown speaker's label."""
    n = squeeze(name)
    return F.when((n != "") & ~n.rlike(UNKNOWN_SPEAKER), n)


def speaker_role(role: Column) -> Column:
    def meant(r: Column) -> Column:
        out = r
        for said, name in ROLES.items():
            out = F.when(r == said, F.lit(name)).otherwise(out)
        return F.when(r != "", out)

    return F.get(F.transform(F.array(F.lower(squeeze(role))), meant), F.lit(0))


def effective(items: DataFrame) -> DataFrame:
    """Lays reviews over the raw fields, each on its own, and says where every field is from.

    ``items`` has meeting_id, pos, item_id, text, speaker, speaker_role, speaker_track, start_ms,
    end_ms, point_id, ref_ids, reviewed_text, reviewed_speaker, source_schema. An empty review
    counts; a label of an unknown speaker gives no speaker but stays as the track.
    """
    export = F.coalesce(F.col("source_schema") == "stt_export", F.lit(False))
    said = F.coalesce("reviewed_speaker", "speaker")
    name = clean_speaker(said)
    when = lambda c: F.when(F.col(c).isNull(), "unknown").when(export, "source_export_effective").otherwise("raw_stt")
    provenance = F.struct(
        F.when(F.col("reviewed_text").isNotNull(), "human_review").when(export, "source_export_effective").otherwise("raw_stt").alias("text"),
        F.when(F.col("reviewed_speaker").isNotNull(), "human_review").when(export, "source_export_effective").when(name.isNotNull(), "speaker_model").otherwise("unknown").alias("speaker"),
        when("start_ms").alias("start_ms"),
        when("end_ms").alias("end_ms"),
    )
    track = F.coalesce(F.when(F.trim("speaker_track") != "", F.trim("speaker_track")), F.when(F.trim("speaker") != "", squeeze(F.col("speaker"))))
    return items.select(
        "meeting_id", "pos", "item_id", F.coalesce("reviewed_text", "text").alias("text"), name.alias("speaker"), speaker_role(F.col("speaker_role")).alias("role"),
        track.alias("track"), "start_ms", "end_ms", "point_id", "ref_ids", provenance.alias("provenance"),
    )


def evidence(items: DataFrame) -> DataFrame:
    """The registry of evidence: one row per effective item with a stable id and a content hash.

    evidence_id quotes the meeting and the item; content_hash is of the fields in a fixed order,
    nulls as such. errors lists what is wrong with a row, empty if nothing.
    """
    key = F.concat(url_quoted(F.col("meeting_id").cast("string")), F.lit(":TR01:"), url_quoted(F.col("item_id").cast("string")))
    shown = squeeze(F.col("text"))
    content = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("meeting_id", "item_id", "speaker", "start_ms", "end_ms")], shown)
    again = F.count(F.lit(1)).over(Window.partitionBy("meeting_id", "item_id"))
    errors = F.array(
        F.when(F.trim(F.col("meeting_id").cast("string")) == "", "blank meeting id"),
        F.when(again > 1, "repeated item id"),
        F.when(F.col("end_ms") < F.col("start_ms"), "end before start"),
    )
    return items.select("*", key.alias("evidence_id"), shown.alias("text_normal"), F.sha2(content, 256).alias("content_hash"), F.filter(errors, lambda e: e.isNotNull()).alias("errors"))


def renamed_ids(items: DataFrame) -> DataFrame:
    """Repeated item ids of a meeting get -1, -2, … until unused; the first keeps its own.

    Sequential, as a new name can meet a later id; only meetings with a repeat are gone through.
    """
    import pandas as pd

    counts = items.groupBy("meeting_id").agg((F.count(F.lit(1)) > F.count_distinct("item_id")).alias("_twice"))
    marked = items.join(counts, "meeting_id")

    def rename(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        used: set[str] = set()
        out = []
        for name in rows["item_id"]:
            fresh, n = name, 0
            while fresh in used:
                n += 1
                fresh = f"{name}-{n}"
            used.add(fresh)
            out.append(fresh)
        return rows.assign(item_id=out)

    twice = marked.filter("_twice").drop("_twice").groupBy("meeting_id").applyInPandas(rename, items.schema)
    return marked.filter("not _twice").drop("_twice").unionByName(twice)


def turn_numbers(rows: DataFrame, max_gap_ms: int = MAX_GAP_MS, merge_unknown: bool = False, merge_untimed: bool = False) -> DataFrame:
    """Adds turn_no to non-blank rows of meeting_id, pos, text, speaker, role, track, start_ms, end_ms, point_id, ref_ids.

    A turn ends where the voice, the role, the point or the first reference changes, where the
    voice is unknown, where a time is missing, or after a gap of more than ``max_gap_ms``.
    """
    w = Window.partitionBy("meeting_id").orderBy("pos")
    lag = lambda c: F.lag(c).over(w)
    rows = rows.filter(F.trim("text") != "").withColumn("_voice", F.coalesce(F.when(F.col("track") != "", F.col("track")), F.col("speaker")))
    rows = rows.withColumn("_ref", F.when(F.size("ref_ids") > 0, F.get("ref_ids", F.lit(0))))
    untimed = lag("end_ms").isNull() | F.col("start_ms").isNull()
    timed = F.lit(False) if merge_untimed else untimed
    gap = ~untimed & (F.col("start_ms") - lag("end_ms") > max_gap_ms)
    ends = (
        ~lag("_voice").eqNullSafe(F.col("_voice"))
        | ~lag("role").eqNullSafe(F.col("role"))
        | F.coalesce(lag("point_id") != F.col("point_id"), F.lit(False))
        | F.coalesce(lag("_ref") != F.col("_ref"), F.lit(False))
        | (F.lit(False) if merge_unknown else F.col("_voice").isNull())
        | timed
        | gap
    )
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("_new", (first | ends).cast("int"))
    return rows.withColumn("turn_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_voice", "_ref", "_new")


def turns(rows: DataFrame, **options) -> DataFrame:
    """Speaker turns of evidence rows: verbatim text joined by spaces, evidence in order, times where known."""
    numbered = turn_numbers(rows, **options)
    listed = F.array_sort(F.collect_list(F.struct("pos", "evidence_id", "item_id", "text")))
    grouped = numbered.groupBy("meeting_id", "turn_no").agg(
        F.min_by("speaker", "pos").alias("speaker"),
        F.min_by("role", "pos").alias("role"),
        F.min_by("track", "pos").alias("track"),
        listed.alias("_items"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
    )
    return grouped.select(
        "meeting_id", "turn_no", F.format_string("TURN_%06d", "turn_no").alias("turn_id"), "speaker", "role", "track",
        F.array_join(F.transform("_items", lambda x: x["text"]), " ").alias("text_exact"),
        F.transform("_items", lambda x: x["evidence_id"]).alias("evidence_ids"),
        F.transform("_items", lambda x: F.struct(x["item_id"].alias("item_id"), x["text"].alias("text"))).alias("source_items"),
        "start_ms", "end_ms",
    )


def char_prefix(rows: DataFrame) -> DataFrame:
    """Adds chars, a turn's rendered length, and chars_before, the sum over earlier turns of the meeting."""
    w = Window.partitionBy("meeting_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("chars", turn_chars(F.col("speaker"), F.col("text_exact")))
    return rows.withColumn("chars_before", F.coalesce(F.sum("chars").over(w), F.lit(0)).cast("bigint"))


def speaker_registry(rows: DataFrame) -> DataFrame:
    """The speakers of a meeting in the order in which they first speak."""
    seen = rows.filter("speaker is not null").groupBy("meeting_id", "speaker").agg(F.min("turn_no").alias("first_turn"), F.count(F.lit(1)).alias("n_turns"))
    return seen.withColumn("speaker_no", F.row_number().over(Window.partitionBy("meeting_id").orderBy("first_turn", "speaker")))


def neighbours(rows: DataFrame, before: int = 2) -> DataFrame:
    """Adds context, the texts of the ``before`` turns before a turn, and responder, the next turn's other speaker."""
    w = Window.partitionBy("meeting_id").orderBy("turn_no")
    after, text = F.lead("speaker").over(w), F.lead("text_exact").over(w)
    answers = (F.trim(text) != "") & ~after.eqNullSafe(F.col("speaker"))
    context = F.array_join(F.collect_list("text_exact").over(w.rowsBetween(-before, -1)), "\n")
    return rows.withColumn("context", context).withColumn("responder", F.when(answers, after))


def citation_runs(cited: DataFrame) -> DataFrame:
    """Cited items (meeting_id, owner, pos, text) merged where their positions follow each other."""
    w = Window.partitionBy("meeting_id", "owner").orderBy("pos")
    runs = cited.dropDuplicates(["meeting_id", "owner", "pos"]).withColumn("_run", F.col("pos") - F.row_number().over(w))
    grouped = runs.groupBy("meeting_id", "owner", "_run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_t"))
    return grouped.select("meeting_id", "owner", "first_pos", "last_pos", F.array_join(F.transform("_t", lambda x: x["text"]), " ").alias("quote"))


def stable_ids(rows: DataFrame, content: Column, order: list[str]) -> DataFrame:
    """Adds stable_id: the first 16 digits of the content's hash, with _2, _3, … where it repeats in a meeting."""
    rows = rows.withColumn("_digest", F.substring(F.sha2(content, 256), 1, 16))
    n = F.row_number().over(Window.partitionBy("meeting_id", "_digest").orderBy(*order))
    return rows.withColumn("stable_id", F.when(n == 1, F.col("_digest")).otherwise(F.concat("_digest", F.lit("_"), n.cast("string")))).drop("_digest")


def synthetic_clock(rows: DataFrame, words_per_second: float = 2.3, gap_ms: int = 300, change_ms: int = 800) -> DataFrame:
    """Adds start_ms and end_ms to untimed items: speaking time by words, a pause, a longer one where the speaker changes."""
    w = Window.partitionBy("meeting_id").orderBy("pos")
    spoken = F.greatest(F.lit(500), F.bround(F.size(F.split(squeeze(F.col("text")), " ")) / words_per_second * 1000)).cast("bigint")
    pause = F.when(F.row_number().over(w) == 1, 0).when(F.lag("speaker").over(w).eqNullSafe(F.col("speaker")), gap_ms).otherwise(change_ms)
    rows = rows.withColumn("_d", spoken).withColumn("_p", pause)
    end = F.sum(F.col("_d") + F.col("_p")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end_ms", end.cast("bigint")).withColumn("start_ms", (F.col("end_ms") - F.col("_d")).cast("bigint")).drop("_d", "_p")
