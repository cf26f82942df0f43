"""Transcripts, rosters and agendas from JSON payloads and text files, as checked tables.

A payload is one row with its JSON text; every format is read with one tolerant schema and
recognised by what it holds. Nothing raises: what is wrong with a row is in its errors column, and
``quarantine`` splits a table by it, so one bad payload never stops a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.text import squeeze
from parlance.operators.transcripts import synthetic_clock

_ITEM = (
    "struct<id string, item_id string, text string, segment string, speaker string, speaker_name string, speaker_raw string, speaker_id string, speaker_role string, speaker_track string,"
    " speaker_org_unit string, recording_id string, start_ms string, end_ms string, start_time double, end_time double, t_start double, point_id string, ref_id string, revision string,"
    " review struct<text string, speaker string, revision string>>"
)
PAYLOAD = (
    "meeting_id string, revision_id string, transcript string, full_text string, meeting struct<meeting_id string, id string, session_number string, revision_id string, revision string>,"
    " metadata struct<meeting_id string, recording_id string, revision_id string, last_edited string, has_edits boolean, source_note string>,"
    f" items array<{_ITEM}>, turns array<{_ITEM}>"
)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(source, payload) of JSON files, one payload to a file, or to a line of .jsonl files."""
    whole = spark.read.text(path, wholetext=not path.rstrip("/*").endswith(".jsonl"))
    return whole.select(F.input_file_name().alias("source"), F.col("value").alias("payload"))


def _whole_ms(raw: Column) -> Column:
    return F.when(raw.rlike(r"^\d+(\.0+)?$"), F.regexp_extract(raw, r"^(\d+)", 1).cast("bigint"))


def _first(*names: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(n) != "", F.trim(n)) for n in names])


def _references(raw: Column) -> Column:
    """A string or a list of strings, as an ordered distinct list."""
    many = F.from_json(raw, "array<string>")
    return F.when(raw.isNull() | (F.trim(raw) == ""), F.array().cast("array<string>")).when(raw.startswith("["), F.array_distinct(F.filter(F.coalesce(many, F.array().cast("array<string>")), lambda x: F.trim(x) != ""))).otherwise(F.array(F.trim(raw)))


def parse_transcripts(rows: DataFrame, meeting_hint: str | None = None, revision_hint: str | None = None) -> DataFrame:
    """Items of transcripts (source, payload): exports of speech recognition, native and legacy payloads.

    Gives source, format, meeting_id, revision_id, pos, item_id, text, speaker, speaker_role,
    speaker_track, start_ms, end_ms, point_id, ref_ids, reviewed_text, reviewed_speaker, revision,
    source_schema, metadata, errors. A payload of no known format is one row with only an error.
    """
    read = rows.withColumn("p", F.from_json("payload", PAYLOAD))
    p = F.col("p")
    first = F.get(p["items"], F.lit(0))
    export = F.coalesce(first["segment"].isNotNull() | first["speaker_name"].isNotNull(), F.lit(False)) | (p["transcript"].isNotNull() & p["full_text"].isNotNull())
    kind = F.when(export & p["items"].isNotNull(), "stt_export").when(p["items"].isNotNull(), "native").when(p["turns"].isNotNull(), "legacy")
    read = read.withColumn("format", kind)
    hint, version = F.lit(meeting_hint).cast("string"), F.lit(revision_hint).cast("string")
    meeting = (
        F.when(kind == "stt_export", _first(p["meeting_id"], p["metadata"]["meeting_id"], p["metadata"]["recording_id"], hint, F.lit("stt-export")))
        .when(kind == "native", _first(p["meeting_id"], hint))
        .otherwise(_first(p["meeting"]["meeting_id"], p["meeting"]["id"], p["meeting"]["session_number"], hint))
    )
    edited = F.when(p["metadata"]["has_edits"] & p["metadata"]["last_edited"].isNotNull(), F.concat(F.lit("edited-"), p["metadata"]["last_edited"]))
    revision = F.when(kind == "stt_export", _first(p["revision_id"], p["metadata"]["revision_id"], version, edited, F.lit("export-0"))).when(kind == "native", _first(p["revision_id"], version)).otherwise(_first(p["meeting"]["revision_id"], p["meeting"]["revision"], version, F.lit("0")))
    unknown = read.filter("format is null")
    elements = F.when(F.col("format") == "legacy", p["turns"]).otherwise(p["items"])
    flat = read.filter("format is not null").select("source", "format", meeting.alias("meeting_id"), revision.alias("revision_id"), p["metadata"].alias("meta"), F.posexplode(elements).alias("pos", "i"))
    i, fmt = F.col("i"), F.col("format")
    # a legacy timeline of zeros only is unknown; one other value makes zeros real
    known = F.max(F.coalesce(i["t_start"], F.lit(0.0))).over(Window.partitionBy("source")) > 0
    seconds = lambda c: F.when(c >= 0, F.bround(c * 1000).cast("bigint"))
    start = F.when(fmt == "stt_export", seconds(i["start_time"])).when(fmt == "native", _whole_ms(i["start_ms"])).otherwise(F.when(known, seconds(i["t_start"])))
    end = F.when(fmt == "stt_export", seconds(i["end_time"])).when(fmt == "native", _whole_ms(i["end_ms"]))
    item_id = _first(i["id"], i["item_id"])
    speaker = F.when(fmt == "stt_export", i["speaker_name"]).when(fmt == "legacy", F.coalesce(i["speaker_raw"], i["speaker"])).otherwise(i["speaker"])
    text = F.when(fmt == "stt_export", F.coalesce(i["segment"], i["text"])).otherwise(i["text"])
    bad_ms = lambda c: (fmt == "native") & i[c].isNotNull() & _whole_ms(i[c]).isNull()
    errors = F.array(
        F.when(F.col("meeting_id").isNull(), "no meeting id"),
        F.when(item_id.isNull(), "no item id"),
        F.when(text.isNull(), "no text"),
        F.when(bad_ms("start_ms"), "start_ms is no whole number"),
        F.when(bad_ms("end_ms"), "end_ms is no whole number"),
        F.when((i["start_time"] < 0) | (i["end_time"] < 0) | (i["t_start"] < 0), "negative time"),
        F.when(end < start, "end before start"),
    )
    bag = F.map_filter(
        F.create_map(F.lit("speaker_org_unit"), i["speaker_org_unit"], F.lit("recording_id"), F.coalesce(i["recording_id"], F.col("meta.recording_id")), F.lit("has_edits"), F.col("meta.has_edits").cast("string"), F.lit("source_note"), F.col("meta.source_note")),
        lambda k, v: v.isNotNull(),
    )
    out = flat.select(
        "source", "format", "meeting_id", "revision_id", "pos", F.coalesce(item_id, F.col("pos").cast("string")).alias("item_id"), text.alias("text"), speaker.alias("speaker"), i["speaker_role"].alias("speaker_role"),
        _first(i["speaker_track"], i["speaker_id"], F.when(fmt == "stt_export", F.get(_references(i["ref_id"]), F.lit(0)))).alias("speaker_track"), start.alias("start_ms"), end.alias("end_ms"), i["point_id"].alias("point_id"),
        _references(i["ref_id"]).alias("ref_ids"), i["review"]["text"].alias("reviewed_text"), i["review"]["speaker"].alias("reviewed_speaker"), F.coalesce(i["review"]["revision"], i["revision"]).cast("int").alias("revision"),
        F.when(fmt == "stt_export", "stt_export").alias("source_schema"), bag.alias("metadata"), F.filter(errors, lambda e: e.isNotNull()).alias("errors"),
    )
    lost = unknown.select("source", *[F.lit(None).cast(t).alias(c) for c, t in out.dtypes if c not in ("source", "errors")], F.array(F.lit("unknown format")).alias("errors")).select(*out.columns)
    return out.unionByName(lost)


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows without errors, and those with."""
    return rows.filter(F.size("errors") == 0), rows.filter(F.size("errors") > 0)


def strict(rows: DataFrame) -> DataFrame:
    """The rows; running a plan over a row with errors fails."""
    return rows.withColumn("errors", F.when(F.size("errors") == 0, F.col("errors")).otherwise(F.raise_error(F.array_join("errors", ", ")).cast("array<string>")))


_PEOPLE = "people array<struct<id string, full_name string, position string, org_id string>>, organizations array<struct<id string, name string, functions array<string>, aliases array<string>>>"


def parse_rosters(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People and organisations of rosters (meeting_id, payload), with errors for a missing id or name."""
    read = rows.select("meeting_id", F.from_json("payload", _PEOPLE).alias("r"))
    lacks = lambda *c: F.filter(F.array(*[F.when(F.trim(F.coalesce(x, F.lit(""))) == "", f"no {n}") for n, x in c]), lambda e: e.isNotNull())
    p = read.select("meeting_id", F.explode("r.people").alias("p"))
    o = read.select("meeting_id", F.explode("r.organizations").alias("o"))
    people = p.select("meeting_id", F.col("p.id").alias("ref_id"), "p.full_name", "p.position", "p.org_id", lacks(("id", F.col("p.id")), ("name", F.col("p.full_name"))).alias("errors"))
    empty = F.array().cast("array<string>")
    return people, o.select("meeting_id", F.col("o.id").alias("ref_id"), "o.name", F.coalesce("o.aliases", empty).alias("aliases"), F.coalesce("o.functions", empty).alias("functions"), lacks(("id", F.col("o.id")), ("name", F.col("o.name"))).alias("errors"))


_TASKS = "tasks array<struct<id string, title string, owner string, support array<string>, reporter string, due string, last_status string, source string>>"
STATUSES = ("not_started", "in_progress", "done", "blocked")


def parse_agendas(rows: DataFrame, people: DataFrame, organizations: DataFrame) -> DataFrame:
    """Tasks of agendas (meeting_id, payload): parties resolved by code, dates read, and errors.

    A party is a person's or an organisation's id, or free text; a code (P or O and digits) that the
    roster lacks is an error, as are a repeated id, a bad date and an unknown status.
    """
    t = rows.select("meeting_id", F.posexplode(F.from_json("payload", _TASKS)["tasks"]).alias("task_no", "t"))
    parties = t.select("meeting_id", "task_no", F.explode(F.concat(F.array(F.struct(F.lit("owner").alias("as"), F.col("t.owner").alias("code"))), F.transform(F.coalesce("t.support", F.array().cast("array<string>")), lambda s: F.struct(F.lit("support").alias("as"), s.alias("code"))))).alias("x"))
    parties = parties.select("meeting_id", "task_no", "x.as", "x.code").filter("code is not null")
    known = people.select("meeting_id", F.col("ref_id").alias("code"), F.col("full_name").alias("name")).unionByName(organizations.select("meeting_id", F.col("ref_id").alias("code"), "name"))
    found = parties.join(known, ["meeting_id", "code"], "left")
    bad = F.col("name").isNull() & F.col("code").rlike(r"^[PO]\d+$")
    one = F.struct(F.coalesce("name", "code").alias("name"), F.when(F.col("name").isNotNull(), F.col("code")).alias("ref_id"))
    grouped = found.groupBy("meeting_id", "task_no").agg(F.first(F.when(F.col("as") == "owner", one), ignorenulls=True).alias("owner"), F.collect_list(F.when(F.col("as") == "support", one)).alias("support"), F.collect_list(F.when(bad, F.concat(F.lit("unknown party "), "code"))).alias("party_errors"))
    due = F.try_to_date(F.col("t.due"), "yyyy-MM-dd")
    again = F.count(F.lit(1)).over(Window.partitionBy("meeting_id", F.col("t.id"))) > 1
    errors = F.filter(
        F.array(F.when(F.coalesce(F.col("t.id"), F.lit("")) == "", "no id"), F.when(F.coalesce(F.col("t.title"), F.lit("")) == "", "no title"), F.when(again, "repeated id"), F.when(F.col("t.due").isNotNull() & due.isNull(), "bad date"), F.when(F.col("t.last_status").isNotNull() & ~F.col("t.last_status").isin(*STATUSES), "unknown status")),
        lambda e: e.isNotNull(),
    )
    out = t.select("meeting_id", "task_no", F.col("t.id").alias("task_id"), "t.title", "t.reporter", due.alias("due"), "t.last_status", F.col("t.source").alias("origin"), errors.alias("errors")).join(grouped, ["meeting_id", "task_no"], "left")
    return out.withColumn("errors", F.concat("errors", F.coalesce("party_errors", F.array().cast("array<string>")))).drop("party_errors")


def sidecars(transcripts: DataFrame, files: DataFrame, suffix: str) -> DataFrame:
    """Files (source, payload) named <stem><suffix> beside transcripts (source, meeting_id); those without one get null."""
    stem = F.regexp_replace("source", r"\.json$", "")
    side = files.select(F.regexp_replace("source", F.lit(suffix.replace(".", r"\.") + "$"), F.lit("")).alias("stem"), "payload")
    return transcripts.select("meeting_id", stem.alias("stem")).distinct().join(side, "stem", "left").select("meeting_id", "payload")


# --- text files ------------------------------------------------------------------------------------


def _lines(files: DataFrame) -> DataFrame:
    return files.select("source", F.posexplode(F.split("payload", r"\r?\n")).alias("line_no", "line"))


def _down(column: Column) -> Column:
    """The last value that isn't null, down the lines of a file."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))


def speaker_lines(files: DataFrame) -> DataFrame:
    """Items of text transcripts (source, payload): "Speaker (Unit): text" lines after a line of ====, with a made-up clock."""
    rows = _lines(files)
    after = F.coalesce(_down(F.when(F.trim("line").rlike("^={4,}$"), F.lit(True))), F.lit(False))
    some = F.max(F.trim("line").rlike("^={4,}$")).over(Window.partitionBy("source"))
    rows = rows.withColumn("_in", after | ~some).filter(F.col("_in") & (F.trim("line") != "") & ~F.trim("line").rlike("^={4,}$"))
    pattern = r"^\s*([^:()]{1,80}?)\s*(?:\(([^)]*)\))?\s*:\s*(.*)$"
    rows = rows.select(F.col("source").alias("meeting_id"), F.col("line_no").alias("pos"), F.regexp_extract("line", pattern, 1).alias("speaker"), F.regexp_extract("line", pattern, 2).alias("unit"), F.coalesce(F.nullif(F.regexp_extract("line", pattern, 3), F.lit("")), F.col("line")).alias("text"))
    rows = rows.withColumn("speaker", F.nullif("speaker", F.lit(""))).withColumn("unit", F.nullif("unit", F.lit("")))
    w = Window.partitionBy("meeting_id").orderBy("pos")
    changed = F.coalesce((~F.lag("speaker").over(w).eqNullSafe(F.col("speaker"))).cast("int"), F.lit(1))
    rows = rows.withColumn("_c", changed).withColumn("point_id", F.sum("_c").over(w).cast("string")).drop("_c")
    return synthetic_clock(rows)


def headed_turns(files: DataFrame, header: str = r"^\s+(\p{Lu}[^-\n]{1,60}?)\s+-\s+(.+)$") -> DataFrame:
    """Turns of documents whose indented "Name - role" lines head a turn: (source, turn_no, speaker, role, text)."""
    rows = _lines(files).withColumn("_h", F.col("line").rlike(header))
    n = F.sum(F.col("_h").cast("int")).over(Window.partitionBy("source").orderBy("line_no"))
    rows = rows.withColumn("turn_no", n).filter("turn_no > 0")
    body = F.array_sort(F.collect_list(F.when(~F.col("_h") & (F.trim("line") != ""), F.struct("line_no", F.trim("line").alias("line")))))
    agg = rows.groupBy("source", "turn_no").agg(F.first(F.when(F.col("_h"), F.col("line")), ignorenulls=True).alias("_l"), body.alias("_b"))
    return agg.select("source", "turn_no", F.trim(F.regexp_extract("_l", header, 1)).alias("speaker"), F.trim(F.regexp_extract("_l", header, 2)).alias("role"), F.array_join(F.transform("_b", lambda x: x["line"]), " ").alias("text"))


def authored_turns(files: DataFrame) -> DataFrame:
    """Turns of authored scripts: "## TOPIC" lines, "@KEY #tag:" turns and their continuations: (source, topic_no, turn_no, key, tags, text)."""
    rows = _lines(files)
    fence = F.sum(F.trim("line").startswith("```").cast("int")).over(Window.partitionBy("source").orderBy("line_no"))
    rows = rows.withColumn("_f", fence).filter((F.col("_f") % 2 == 0) & ~F.trim("line").startswith("```"))
    turn = r"^@(\S+?)((?:\s+#\S+?)*)\s*:\s*(.*)$"
    w = Window.partitionBy("source").orderBy("line_no")
    rows = rows.withColumn("topic_no", F.sum(F.col("line").startswith("## ").cast("int")).over(w)).withColumn("turn_no", F.sum(F.col("line").rlike(turn).cast("int")).over(w))
    rows = rows.filter((F.col("turn_no") > 0) & ~F.col("line").startswith("## ") & (F.trim("line") != ""))
    part = F.when(F.col("line").rlike(turn), F.regexp_extract("line", turn, 3)).otherwise(F.trim("line"))
    agg = rows.groupBy("source", "turn_no").agg(F.min("topic_no").alias("topic_no"), F.min_by("line", "line_no").alias("_l"), F.array_sort(F.collect_list(F.struct("line_no", part.alias("t")))).alias("_t"))
    tags = F.regexp_extract_all(F.regexp_extract("_l", turn, 2), F.lit(r"#(\S+)"), F.lit(1))
    return agg.select("source", "topic_no", "turn_no", F.regexp_extract("_l", turn, 1).alias("key"), tags.alias("tags"), squeeze(F.array_join(F.transform("_t", lambda x: x["t"]), " ")).alias("text"))


def separated_segments(files: DataFrame) -> DataFrame:
    """Units of segmentation corpora: lines, with is_end on the line before a line of ====: (source, pos, text, is_end)."""
    rows = _lines(files).filter(F.trim("line") != "")
    rows = rows.withColumn("_s", F.trim("line").rlike("^={4,}")).withColumn("is_end", F.coalesce(F.lead("_s").over(Window.partitionBy("source").orderBy("line_no")), F.lit(False))).filter("not _s")
    return rows.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("line_no")) - 1).alias("pos"), F.col("line").alias("text"), "is_end")


def todo(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a result yet, for runs that resume."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")
