"""Ports, extraction, the verifier and the whole analysis with fakes; streams against tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import actors, extraction, ports
from parlance.operators import transcripts as tr
from parlance.operators.verifier import MeetingTools, settle_verdict, verify
from parlance.plans.analysis import analyze
from parlance.streaming import turns as st

TURNS = [{"turn_id": f"TURN_{i:06d}", "speaker": s, "text": t} for i, (s, t) in enumerate([("An", "we talk of the budget"), ("Hà", "the report is due"), ("An", "I agree, Hà takes the budget report")], 1)]


class Script:
    """Answers in order, by system prompt."""

    def __init__(self, **answers):
        self.answers = {k: list(v) for k, v in answers.items()}

    def generate_json(self, system, user, schema):
        answer = self.answers[system].pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


KEEP = {"verdict": "keep", "deciding_turn_id": "TURN_000003"}
DROP = {"verdict": "drop"}
CANDIDATE = {"candidate_id": "c", "kind": "assignment", "text": "report", "actor": "Hà"}


@pytest.mark.parametrize(
    "script,outcome,kept",
    [
        (Script(verify=[KEEP]), "consensus", True),
        (Script(verify=[{"verdict": "keep", "deciding_turn_id": "TURN_000099"}], feedback=[{"stance": "accept"}]), "consensus", False),
        (Script(verify=[DROP], feedback=[{"stance": "accept"}]), "consensus", False),
        (Script(verify=[DROP, KEEP], feedback=[{"stance": "amend", "revised_text": "new"}]), "consensus", True),
        (Script(verify=[DROP] * 3, feedback=[{"stance": "defend"}] * 3), "verifier", False),
        (Script(verify=[DROP, KEEP], feedback=[{"stance": "accept", "argument": "but TURN_000003 says so"}], stance=[{"stance": "defend"}]), "consensus", True),
        (Script(verify=[DROP], feedback=[{"stance": "accept", "argument": "x"}], stance=[RuntimeError("no")]), "consensus", False),
        (Script(verify=[{"verdict": "revise", "deciding_turn_id": "TURN_000003"}], feedback=[{"stance": "accept"}]), "consensus", True),
        (Script(verify=[{}] * 3, feedback=[{}] * 3), "fallback", True),
        (Script(verify=[RuntimeError("no")]), "fallback", True),
        (Script(verify=[DROP], feedback=[RuntimeError("no")]), "fallback", True),
    ],
)
def test_verifier_outcomes(script, outcome, kept):
    r = verify(CANDIDATE, MeetingTools(TURNS), script)
    assert (r.outcome, r.kept) == (outcome, kept)


def test_lookups_are_bounded():
    ask = {"action": "search_meeting", "argument": "budget"}
    r = verify(CANDIDATE, MeetingTools(TURNS), Script(verify=[ask, ask, ask, KEEP]))
    steps = r.rounds[0]["steps"]
    assert len(steps) == 3 and "TURN_000001" in steps[0]["observation"] and steps[1]["observation"] == "already looked up"


def test_tools_and_verdicts():
    tools = MeetingTools(TURNS)
    assert tools.find("3")["turn_id"] == "TURN_000003" and tools.find("x") is None
    assert [t["turn_id"] for t in tools.search("budget report")] == [t["turn_id"] for t in TURNS]
    assert tools.run("lookup_speaker", "hà").endswith("clear: " + tools.turns[1]["speaker"])
    many = MeetingTools(TURNS, [{"name": n, "kind": k, "aliases": a} for n, k, a in (("Phạm Sơn", "person", []), ("Lê Sơn", "person", []), ("Sở Y tế", "organization", ["SYT"]))])
    assert many.run("lookup_speaker", "anh Sơn").splitlines() == ["Lê Sơn | person | 0.60", "Phạm Sơn | person | 0.60", "ambiguous"]
    assert many.run("lookup_speaker", "syt") == "Sở Y tế | organization | 1.00\nclear: Sở Y tế"
    assert many.run("lookup_speaker", "x @T99") == "no such turn" and many.run("lookup_speaker", "@1") == "no name before @" and many.run("lookup_speaker", "Zoe").startswith("nobody")
    assert many.run("lookup_speaker", f"{TURNS[0]['speaker']} @1").splitlines()[0].endswith("0.70")  # who assigns
    assert settle_verdict("revise", "decision", "T", {"T"}, "An") == ("keep", "An")
    assert settle_verdict("keep", "assignment", "T", {"T"}, "em") == ("keep", None)
    assert MeetingTools([]).search("x") == []


def test_json_answers_and_schemas():
    assert ports.first_json_object('```json\n{"a": 1}\n``` tail') == {"a": 1}
    assert ports.first_json_object('so: {bad} then {"b": {"c": 2}} end') == {"b": {"c": 2}}
    with pytest.raises(ValueError):
        ports.first_json_object("none")
    s = ports.strict_schema({"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {}}}}}})
    assert s["required"] == ["a"] and s["properties"]["a"]["items"]["additionalProperties"] is False


def test_retries_have_budgets():
    for kind, most in ports.ATTEMPTS.items():
        n = []

        def call(kind=kind, n=n):
            n.append(1)
            raise ports.UpstreamError("x", kind)

        with pytest.raises(ports.UpstreamError):
            ports.with_retries(call, sleep=lambda s: None)
        assert len(n) == most


def test_ports_are_asked_once_per_input_and_fail_softly(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None)], "i int, prompt string")
    got = {r.i: r for r in ports.ask(rows, "s", "prompt", {}, lambda: ports.FakeLLM({"bad": ValueError("no")}, {"x": 1})).collect()}
    assert json.loads(got[1].answer) == json.loads(got[2].answer) == {"x": 1}
    assert got[3].answer is None and got[3].answer_error == "ValueError: no" and got[4].answer is None
    near = ports.embed(rows, "prompt", ports.HashingEmbedder).orderBy("i").collect()
    assert np.allclose(near[0].embedding, near[1].embedding) and near[3].embedding is None
    judged = {r.i: r.labels for r in ports.judge(rows, "prompt", lambda: ports.CueJudge({"a": ["a"], "b": ["b"]})).collect()}
    assert judged[1] == {"a": 1.0, "b": 0.0}


ANSWERS = {
    "content": {"discussion_points": [{"evidence_segment_ids": ["<0>"], "text": "Budget is short"}, {"evidence_segment_ids": ["nope"], "text": "lost"}, {"evidence_segment_ids": ["0"], "text": "Giao nhiệm vụ cho Hà"}, None, {"evidence_segment_ids": ["1"], "text": ""}]},
    "decision": {"decisions": [{"evidence_segment_ids": [], "confirm_turn_id": "[TURN_000003|An]", "status": "agreed", "text": "Take the plan"}, {"evidence_segment_ids": ["TURN_000001"], "status": "proposed", "text": "Maybe later"}]},
    "action": {"action_items": [{"evidence_segment_ids": ["2"], "confirm_turn_id": "TURN_000003", "status": "assigned", "actor": "Hà", "text": "write the report", "deadline": "tuần sau", "task_id": "T9"}, {"evidence_segment_ids": ["1"], "status": "odd", "actor": "em", "text": "check the report"}]},
    "label": {"title": "Budget report", "summary": "They talk of the budget"},
    "verify": {"verdict": "keep", "deciding_turn_id": "TURN_000003"},
}


class BySystem:
    def generate_json(self, system, user, schema):
        return ANSWERS[system]


def meeting(spark):
    rows = [("m", i, str(i), t["text"], t["speaker"]) for i, t in enumerate(TURNS)]
    items = spark.createDataFrame(rows, "meeting_id string, pos long, item_id string, text string, speaker string")
    none = F.lit(None).cast("string")
    items = items.select("*", none.alias("speaker_role"), none.alias("speaker_track"), (F.col("pos") * 10).alias("start_ms"), (F.col("pos") * 10 + 5).alias("end_ms"), none.alias("point_id"), F.array().cast("array<string>").alias("ref_ids"), none.alias("reviewed_text"), none.alias("reviewed_speaker"), none.alias("source_schema"))
    segments = spark.createDataFrame([("m", "TOPIC_SEG_000001", 1, 1, 3)], "meeting_id string, segment_id string, segment_no int, turn_lo int, turn_hi int")
    return tr.turns(tr.evidence(tr.effective(items))), segments


def test_whole_analysis(spark):
    turns, segments = meeting(spark)
    people = spark.createDataFrame([("m", "P1", "Trần Hà", None)], "meeting_id string, ref_id string, full_name string, org_id string")
    orgs = spark.createDataFrame([], "meeting_id string, ref_id string, name string, aliases array<string>, functions array<string>")
    r = analyze(turns, segments, people, orgs, F.lit("2026-10-08"), BySystem, cues=["agree"], hedges=["maybe"])
    assert [p.text for p in r.points.collect()] == ["Budget is short"] and r.points.first().speakers == ["An"]
    got = {a.text: a for a in r.assignments.collect()}
    assert got["write the report"].assignee == "Trần Hà" and got["write the report"].deadline == "2026-10-18" and got["write the report"].task_id is None
    assert got["check the report"].flag == "missing"
    assert sorted((d.text, d.evidence_ids) for d in r.decisions.collect()) == [("Maybe later", ["0"]), ("Take the plan", ["2"])]
    assert {x.candidate_id[0] for x in r.records.collect()} == {"a", "d"} and all(x.outcome == "consensus" for x in r.records.collect())
    topic = r.content.first().topics[0]
    assert topic.title == "Budget report" and topic.points[0].citations[0].text == "we talk of the budget"
    assert r.coverage.first().coverage == 1.0 and r.failures.count() == 0


def test_compound_actors_and_context(spark):
    turns, _ = meeting(spark)
    people = spark.createDataFrame([("m", "P1", "Trần Hà", None), ("m", "P2", "Lê Hà", None), ("m", "P3", "An", None)], "meeting_id string, ref_id string, full_name string, org_id string")
    orgs = spark.createDataFrame([("m", "O1", "Sở Y tế", [], [])], "meeting_id string, ref_id string, name string, aliases array<string>, functions array<string>")
    rows = [("m", "1", "Hà và Sở Y tế", "write", "assigned", None), ("m", "2", "An", "write, phối hợp với Sở Y tế", "self_committed", "TURN_000003"), ("m", "3", None, "x", "assigned", None), ("m", "4", "An", "x", "assigned", "TURN_000003")]
    df = spark.createDataFrame(rows, "meeting_id string, row_id string, actor string, text string, status string, confirm_turn_id string")
    got = {r.row_id: r for r in actors.resolved_parties(df, people, orgs, turns).collect()}
    assert [(a.name, a.role, a.flag) for a in got["1"].assignees] == [(None, "joint", "ambiguous"), ("Sở Y tế", "joint", None)]
    assert (got["1"].assignee, got["1"].assignee_kind, got["1"].flag) == ("Hà và Sở Y tế", "unknown", "ambiguous")
    assert [(a.name, a.role, a.ref_id) for a in got["2"].assignees] == [("An", "lead", "P3"), ("Sở Y tế", "support", "O1")] and got["2"].assignee == "An, Sở Y tế"
    assert (got["3"].flag, got["3"].assignee) == ("missing", None)
    assert got["4"].assignees[0].offered[0].score == 0.7  # who assigns is less likely meant
    told = spark.createDataFrame([got["1"]], "meeting_id string, row_id string, assignees array<struct<mention_no int, mention string, role string, name string, kind string, ref_id string, flag string, offered array<struct<name string, score double>>>>, assignee string, assignee_kind string, flag string")
    assert told.select(actors.ambiguity(F.col("assignees")).alias("a")).first().a == "ambiguous actor Hà: Lê Hà (0.60), Trần Hà (0.60)"


def test_rules_can_be_left_out(spark):
    turns, segments = meeting(spark)
    people = spark.createDataFrame([("m", "P1", "Trần Hà", None)], "meeting_id string, ref_id string, full_name string, org_id string")
    orgs = spark.createDataFrame([], "meeting_id string, ref_id string, name string, aliases array<string>, functions array<string>")
    with_rules, without = (analyze(turns, segments, people, orgs, F.lit("2026-10-08"), BySystem, cues=["agree"], hedges=["maybe"], evidence=e).records.count() for e in (True, False))
    assert with_rules < without == 4


def test_labels_fall_back_to_the_text(spark):
    turns, segments = meeting(spark)
    prompts = extraction.topic_prompts(segments, turns)
    texts = prompts.select("meeting_id", "segment_id", F.lit("Budget matters. More.").alias("text"))
    for bad in ({"title": "", "summary": "x"}, {"title": "General discussion", "summary": "x"}, {"title": "Weather", "summary": "x"}, ValueError("no")):
        row = extraction.label_topics(prompts, texts, "label", lambda bad=bad: ports.FakeLLM({"TURN": bad}), attempts=2).first()
        assert (row.title, row.method) == ("Budget matters", "extract")


def test_a_replayed_stream_gives_the_same_turns(spark, tmp_path):
    rows = [("m", 1, "A", "a"), ("m", 2, "A", "b"), ("m", 4, "B", "c"), ("n", 3, "A", "x"), ("m", 30, "B", "d"), ("m", 200, "A", "e"), ("n", 300, "Z", "z")]
    schema = "meeting_id string, s int, speaker string, text string"
    items = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    for i, lo in enumerate((0, 3, 5, 6)):
        spark.createDataFrame(rows[lo : [3, 5, 6, 7][i]], schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = st.closed_turns(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.meeting_id, r.turn_no, r.speaker, r.text) for r in spark.sql("SELECT * FROM closed").collect())
    assert got[:3] == [("m", 1, "A", "a b"), ("m", 2, "B", "c"), ("m", 3, "B", "d")] and ("n", 1, "A", "x") in got


def test_streamed_windows_are_those_of_the_table(spark, tables, tmp_path):
    events = spark.read.parquet(f"{tables}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{tables}/events.parquet*")
    q = st.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    table = {(r.window_start, r.event_type): r.n_events for r in st.windowed_counts(events).collect()}
    assert {(r.window_start, r.event_type): r.n_events for r in spark.sql("SELECT * FROM windows").collect()} == table


def test_progress_and_the_three_documents(spark):
    turns, segments = meeting(spark)
    people = spark.createDataFrame([("m", "P1", "Trần Hà", None)], "meeting_id string, ref_id string, full_name string, org_id string")
    orgs = spark.createDataFrame([], "meeting_id string, ref_id string, name string, aliases array<string>, functions array<string>")
    party = "struct<name: string, ref_id: string>"
    tasks = spark.createDataFrame(
        [("m", "T9", 0, "the report", ("Lê An", None), [], None), ("m", "T8", 1, "other", None, [], None)],
        f"meeting_id string, task_id string, task_no int, title string, owner {party}, support array<{party}>, due date",
    )

    class Reporting(BySystem):
        def generate_json(self, system, user, schema):
            if system == "progress":
                return {"updates": [{"task_id": "T9", "status": "done", "status_turn_id": "TURN_000002", "evidence_segment_ids": ["1"], "deadline": "ngày mai"}, {"task_id": "T7", "status": "done", "evidence_segment_ids": ["1"]}]}
            return super().generate_json(system, user, schema)

    for judge, status in ((None, "done"), (lambda: ports.CueJudge({"unrelated": ["due"], "commit": ["agree"]}), "mentioned")):
        r = analyze(turns, segments, people, orgs, F.lit("2026-10-08"), Reporting, judge, ["agree"], ["maybe"], tasks)
        got = {x.task_id: x for x in r.progress.collect()}
        assert (got["T9"].status, str(got["T9"].new_due), got["T8"].status) == (status, "2026-10-09", "not_reported")
    doc = r.tasks.first()
    assert [(b.task_id, b.relation, b.moved_to) for b in doc.backlog] == [("T9", "reassign", ["Trần Hà"]), ("T8", None, None)]
    assert [t.text for t in doc.new_tasks] == ["check the report"]
    assert [d.text for d in r.decided.first().groups[0].decisions] == ["Take the plan", "Maybe later"]
