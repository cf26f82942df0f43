"""Payload formats, text importers and the store."""

import json
import threading

import pytest

from parlance.sources import payloads as pl
from parlance.sources.store import AnalysisStore, SingleFlight, analysis_key, entry_name


def parse(spark, *objects):
    rows = spark.createDataFrame([(f"f{i}.json", json.dumps(o) if not isinstance(o, str) else o) for i, o in enumerate(objects)], "source string, payload string")
    return pl.parse_transcripts(rows).orderBy("source", "pos").collect()


def test_native(spark):
    a, b, c = parse(spark, {"meeting_id": "m", "revision_id": "1", "items": [{"id": "a", "text": "x", "speaker": "A", "start_ms": 5.0, "end_ms": 9, "ref_id": ["r", "r", "s"], "review": {"text": ""}}, {"id": 7, "text": "y", "start_ms": 1.5, "ref_id": "q"}, {"text": "z", "start_ms": True}]})
    assert (a.meeting_id, a.start_ms, a.end_ms, a.ref_ids, a.reviewed_text, a.errors) == ("m", 5, 9, ["r", "s"], "", [])
    assert (b.item_id, b.start_ms, b.ref_ids, b.errors) == ("7", None, ["q"], ["start_ms is no whole number"])
    assert c.errors == ["no item id", "start_ms is no whole number"]


def test_export(spark):
    (a,) = parse(spark, {"transcript": "t", "full_text": "t", "items": [{"id": 3, "segment": "x", "speaker_name": "Unknown speaker 01", "start_time": 0.0005, "end_time": 1.0015, "ref_id": ["sp1"], "recording_id": "rec"}], "metadata": {"has_edits": True, "last_edited": "T"}})
    assert (a.format, a.meeting_id, a.revision_id, a.start_ms, a.end_ms, a.speaker_track) == ("stt_export", "stt-export", "edited-T", 0, 1002, "sp1")
    assert a.metadata["recording_id"] == "rec" and a.source_schema == "stt_export"


def test_legacy_zeros(spark):
    rows = parse(spark, {"meeting": {"id": "m"}, "turns": [{"id": "1", "speaker_raw": "A", "text": "x", "t_start": 0.0}]}, {"meeting": {"id": "n"}, "turns": [{"id": "1", "text": "x", "t_start": 0.0}, {"id": "2", "text": "y", "t_start": 2.5}]})
    assert [(r.meeting_id, r.start_ms) for r in rows] == [("m", None), ("n", 0), ("n", 2500)]


def test_unknown_formats_are_quarantined(spark):
    rows = spark.createDataFrame([("a", "{}"), ("b", "not json"), ("c", '{"meeting_id": "m", "items": [{"id": "1", "text": "x"}]}')], "source string, payload string")
    good, bad = pl.quarantine(pl.parse_transcripts(rows))
    assert [r.source for r in good.collect()] == ["c"] and sorted(r.source for r in bad.collect()) == ["a", "b"]
    with pytest.raises(Exception, match="unknown format"):
        pl.strict(pl.parse_transcripts(rows)).collect()


def test_agenda(spark):
    roster = spark.createDataFrame([("m", json.dumps({"people": [{"id": "P1", "full_name": "An"}, {"id": "", "full_name": "B"}], "organizations": [{"id": "O1", "name": "Sở A"}]}))], "meeting_id string, payload string")
    people, orgs = pl.parse_rosters(roster)
    assert [r.errors for r in people.orderBy("ref_id").collect()] == [["no id"], []]
    tasks = [{"id": "T1", "title": "a", "owner": "P1", "support": ["O1", "Nhóm"], "due": "2026-01-31"}, {"id": "T2", "title": "b", "owner": "P9", "due": "2026-02-31", "last_status": "x"}, {"id": "T2", "title": ""}]
    got = pl.parse_agendas(spark.createDataFrame([("m", json.dumps({"tasks": tasks}))], "meeting_id string, payload string"), people, orgs).orderBy("task_no").collect()
    assert got[0].owner.name == "An" and [(s.name, s.ref_id) for s in sorted(got[0].support, key=str)] == [("Nhóm", None), ("Sở A", "O1")] and got[0].errors == []
    assert got[1].errors == ["repeated id", "bad date", "unknown status", "unknown party P9"] and got[2].errors == ["no title", "repeated id"]


def files(spark, text):
    return spark.createDataFrame([("f", text)], "source string, payload string")


def test_text_files(spark):
    rows = pl.speaker_lines(files(spark, "head: no\n=====\nAn (Sở A): one two\nAn: three\n\nHà: four\n")).orderBy("pos").collect()
    assert [(r.speaker, r.unit, r.text, r.point_id) for r in rows] == [("An", "Sở A", "one two", "1"), ("An", None, "three", "1"), ("Hà", None, "four", "2")]
    assert rows[0].start_ms == 0 and all(a.end_ms < b.start_ms for a, b in zip(rows, rows[1:], strict=False))
    rows = pl.authored_turns(files(spark, "```json\n@X: no\n```\n## One\n@A #k #l: first\nmore\n@B: x\n## Two\n@A: y")).orderBy("turn_no").collect()
    assert [(r.topic_no, r.key, r.tags, r.text) for r in rows] == [(1, "A", ["k", "l"], "first more"), (1, "B", [], "x"), (2, "A", [], "y")]
    rows = pl.separated_segments(files(spark, "a\nb\n=====\nc")).orderBy("pos").collect()
    assert [(r.text, r.is_end) for r in rows] == [("a", False), ("b", True), ("c", False)]
    rows = pl.headed_turns(files(spark, "x\n  An Bình - chair\nhello\nthere\n  Hà - delegate\nyes")).orderBy("turn_no").collect()
    assert [(r.speaker, r.role, r.text) for r in rows] == [("An Bình", "chair", "hello there"), ("Hà", "delegate", "yes")]


def test_store(spark, tmp_path):
    store, calls = AnalysisStore(spark, str(tmp_path / "store")), []
    key = analysis_key({"a": 1}, "f")

    def go(fail=False, **options):
        def compute(base):
            calls.append(1)
            if fail:
                raise RuntimeError("no")
            return {"n": base["n"] + len(calls)}

        return store.document(key, "tasks", {"chair": "A"}, lambda: {"n": 10}, compute, **options)

    assert store.cached(key, "tasks", {"chair": "A"}) is None
    assert (go()["from"], go()["from"]) == ("computed", "cached")
    assert go(refresh=True)["data"] == {"n": 12}
    assert go(refresh=True, fail=True) == {"data": {"n": 12}, "version": 3, "from": "stale"}
    assert store.cached(key, "tasks", {"chair": "A"}) == {"n": 12}
    assert go(refresh_base=True)["from"] == "computed"
    assert entry_name("tasks", {"chair": "A"}) != entry_name("tasks", {"chair": "B"}) and entry_name("content", {"chair": "A"}) == entry_name("content", {})
    with pytest.raises(ValueError):
        store.load("../x", "base")


def test_single_flight_shares_results():
    flight, started, n = SingleFlight(), threading.Event(), []

    def slow():
        n.append(1)
        started.set()
        threading.Event().wait(0.2)
        return 5

    out = []
    threads = [threading.Thread(target=lambda: out.append(flight.run("k", slow))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert out == [5] * 4 and len(n) <= 2


def test_gold_manifests_and_predictions(spark):
    import json

    from parlance.sources import benchmark as bm

    gold = {"meeting_id": "m", "n_turns": 2, "negatives": [{"id": "N1", "type": "rejected_task", "text": "x", "evidence_turn_ids": ["T1"]}], "assignments": [{"id": "A1", "actor": "An", "task": "t"}]}
    files = spark.createDataFrame([("a", json.dumps(gold)), ("b", json.dumps({"negatives": [{"type": "odd"}]})), ("c", "no json")], "source string, payload string")
    rows = {r.file: r for r in bm.parse_gold(files).collect()}
    assert rows["a"].errors == [] and rows["b"].errors == ["no meeting id", "no number of turns", "unknown kind of negative"] and "no meeting id" in rows["c"].errors
    good = bm.parse_gold(files).filter("file = 'a'")
    assert [(r.id, r.actor, r.evidence) for r in bm.gold_items(good, "assignments").collect()] == [("A1", "An", [])]
    assert [r.evidence for r in bm.gold_items(good, "negatives").collect()] == [["T1"]]
    turns = spark.createDataFrame([("m", 1, "T1", "An", "a"), ("m", 2, "T2", None, "b")], "meeting_id string, turn_no int, turn_id string, speaker string, text_exact string")
    assert bm.turn_counts(good, turns).count() == 0 and bm.turn_counts(good, turns.limit(1)).first().built == 1
    assert bm.rendered(turns).first().prompt == "[T1] An: a\n[T2] None: b"
    listed = spark.createDataFrame([(json.dumps([{"meeting_id": "m", "n_turns": 2}, {"title": "x"}]),)], "payload string")
    assert [(r.meeting_id, r.errors) for r in bm.parse_manifests(listed).collect()] == [("m", []), (None, ["no meeting id"])]
    stored = spark.createDataFrame([(json.dumps({"meeting_id": "m", "status": "ok", "output": {"assignments": [{"task": "t"}], "reasoning": "r"}}),), (json.dumps({"meeting_id": "n", "status": "?"}),)], "payload string")
    got = {r.meeting_id: r for r in bm.parse_predictions(stored).collect()}
    assert got["m"].errors == [] and got["m"].result.assignments[0].task == "t" and got["m"].result.topics == [] == got["n"].result.decisions and got["n"].errors == ["unknown status"]


def test_methods_resume(spark, tmp_path):
    import json

    from parlance.operators import ports
    from parlance.plans import methods

    turns = spark.createDataFrame([("m", 1, "T1", "An", "good"), ("n", 1, "T1", "An", "bad")], "meeting_id string, turn_no int, turn_id string, speaker string, text_exact string")
    answer = {"decisions": [{"text": "d"}], "reasoning": "gone"}
    got = {r.meeting_id: r for r in methods.run(["zero_shot"], turns, lambda: ports.FakeLLM({"bad": ValueError("no")}, answer), str(tmp_path / "r")).collect()}
    assert got["m"].status == "ok" and json.loads(got["m"].output)["decisions"][0]["text"] == "d" and "reasoning" not in got["m"].output
    assert got["n"].status == "error" and got["n"].error == "ValueError: no"
    again = {r.meeting_id: r for r in methods.run(["zero_shot"], turns, lambda: ports.FakeLLM({}, {"decisions": []}), str(tmp_path / "r")).collect()}
    assert json.loads(again["m"].output)["decisions"] and again["n"].status == "ok"  # only what failed is asked again
    with pytest.raises(ValueError, match="zero_shot"):
        methods.load("none")
