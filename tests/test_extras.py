"""Splitting, parties, whole scores, configuration and sinks."""

import pytest
from pyspark.sql import functions as F

from parlance.operators import actors, progress, scoring
from parlance.operators import splitting as sp
from parlance.sources import payloads, sinks
from parlance.sources.config import Config


def test_windows_keep_every_word():
    text = " ".join(f"Sentence number {i} is here." for i in range(300)) + " " + "x" * 40
    parts = sp.windows(text, 100)
    assert all(len(p) <= 100 for p in parts) and " ".join(parts) == text
    assert sp.windows("short") == ["short"] and sp.windows("y" * 250, 100) == ["y" * 100, "y" * 100, "y" * 50]
    assert sp.tail("aaa bbb ccc", 6) == "ccc" and sp.tail("abc") == "abc"


def test_small_pieces():
    text = " ".join(f"clause {i} goes on for a while," for i in range(30)) + " end."
    parts = sp.small_pieces(text)
    assert " ".join(parts) == text and all(len(p) >= 80 for p in parts) and max(map(len, parts)) < 300
    assert sp.small_pieces("") == []


def test_cuts_at_the_limit():
    # at the last space before the limit, though the limit itself falls on a word's end
    assert [len(p) for p in sp.windows("x" * 2496 + " bcd efg")] == [2496, 7]
    assert sp.windows("a" * 6 + "\t" + "b" * 6, 8) == ["a" * 6 + "\tb", "b" * 5]  # only spaces are cut at
    text = "Mở đầu báo cáo. " * 200 + "Việc giải trình ý kiến của Bộ đã xong."
    parts = sp.windows(text, 1000)
    assert len(parts) == 4 and parts[-1].endswith("Việc giải trình ý kiến của Bộ đã xong.") and " ".join(parts) == text
    assert sp.windows("chữ " * 600, 1000)[0] == ("chữ " * 250).strip() and " ".join(sp.windows("chữ " * 600, 1000)).split() == ["chữ"] * 600
    assert sp.tail("abc def ", 1) == "" and sp.tail("abcdef", 3) == "def"


def test_bare_tasks(spark):
    said = [
        ("giao Hiếu map lại nhãn", "Hiếu", "Map lại nhãn"), ("anh Sơn sẽ gửi báo cáo", "anh Sơn", "Gửi báo cáo"), ("giao diện mới cần sửa", "Hà", "giao diện mới cần sửa"),
        ("Giao nhiệm vụ cho phòng Tài chính rà soát", "phòng Tài chính", "Rà soát"), ("giao Hà", "Hà", "giao Hà"), ("làm báo cáo", None, "làm báo cáo"), ("giao Anh Tuấn làm phụ lục", "Anh Tuấn", "Làm phụ lục"),
        ("Giao cho chị Mai cập nhật đặc tả", "Chị Mai", "Cập nhật đặc tả"), ("Ông Bình phải lập tiến độ", "Ông Bình", "Lập tiến độ"), ("Phối hợp với Nam tích hợp SMS", "Hiếu", "Phối hợp với Nam tích hợp SMS"),
        ("giao", None, "giao"), ("giao phòng a.b(c ký", "phòng a.b(c", "Ký"), ("Phân công Lan soạn thảo", None, "Lan soạn thảo"), ("giao \\E x", "\\E", "X"),
    ]
    rows = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(said)], "i int, text string, actor string")
    assert [r.bare_text for r in sp.with_bare_task(rows, "text", "actor").orderBy("i").collect()] == [want for *_, want in said]
    assert sp.snippet("a" * 500 + " budget", ["budget"], 200).endswith("budget")


def test_support_parties(spark):
    names = ["Sở Y tế", "Sở Xây dựng", "Sở Công an"]
    text = "làm đề án, phối hợp với Sở Xây dựng và Sở Y te\u0302\u0301. Sở Lạ; phối hợp Sở Công an"
    tasks = spark.createDataFrame([("m", 1, text), ("m", 2, "Sở Y tế")], "meeting_id string, row_id int, text string")
    known = spark.createDataFrame([("m", n) for n in names], "meeting_id string, name string")
    found = actors.support_parties(tasks, known)
    assert [r.name for r in found.orderBy("place").collect()] == ["Sở Xây dựng", "Sở Y tế", "Sở Công an"]
    mine = spark.createDataFrame([("m", 1, 0, "Sở Tài chính", "joint"), ("m", 1, 1, "sở y tế", "joint")], "meeting_id string, row_id int, mention_no int, mention string, role string")
    got = actors.all_parties(mine, found).orderBy("mention_no").collect()
    assert [(r.mention, r.role) for r in got] == [("Sở Tài chính", "lead"), ("sở y tế", "lead"), ("Sở Xây dựng", "support"), ("Sở Công an", "support")]
    turns = spark.createDataFrame([("m", "hôm nay Sở Y te\u0302\u0301 báo cáo"), ("n", "Sở Xây dựng")], "meeting_id string, text_exact string")
    assert [r.name for r in actors.named_in_meeting(known, turns).collect()] == ["Sở Y tế"]


def test_codes_and_relations_stay_in_their_meeting(spark):
    people = spark.createDataFrame([("m", "P1", "An"), ("n", "P1", "Bình")], "meeting_id string, ref_id string, full_name string")
    orgs = spark.createDataFrame([], "meeting_id string, ref_id string, name string")
    rows = spark.createDataFrame([("m", "P1"), ("n", "P1"), ("o", "P1")], "meeting_id string, code string")
    assert sorted((r.meeting_id, r.party_name, r.party_kind) for r in actors.resolve_party(rows, "code", people, orgs).collect()) == [("m", "An", "person"), ("n", "Bình", "person"), ("o", None, "unknown code")]
    moved = spark.createDataFrame([("m", "t", "reassign", 1), ("m", "t", "reschedule", 2), ("n", "t", "reassign", 1)], "meeting_id string, task_id string, relation string, pos int")
    assert sorted((r.meeting_id, r.pos) for r in progress.latest_by_task(moved).collect()) == [("m", 2), ("n", 1)]


def test_normal_form(spark):
    import unicodedata

    from parlance.functions import text as tx

    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.normalize("NFC", chr(c)) == chr(c)]
    forms = [(f"x{f}y {x}", f"x{x}y {x}") for x in letters for f in {unicodedata.normalize("NFD", x)}] + [("a\u0302\u0301 a\u0323\u0302 â\u0323 ạ\u0302 q\u0301", "ấ ậ ậ ậ q\u0301"), (None, None)]
    got = spark.createDataFrame(forms, "said string, want string").select(tx.nfc(F.col("said")).alias("got"), "want").collect()
    assert [r for r in got if r.got != r.want] == []


def test_speakers_and_chairs(spark):
    people = spark.createDataFrame([("m", "P1", "Trần An", None), ("m", "P2", "Lê Hà", None), ("m", "P3", "Ngô Hà", None)], "meeting_id string, ref_id string, full_name string, org_id string")
    speakers = spark.createDataFrame([("m", "An"), ("m", "Hà"), ("m", "Lạ")], "meeting_id string, speaker string")
    got = {(r.name, r.ref_id, r.speaker) for r in actors.people_and_speakers(people, speakers).collect()}
    assert got == {("Trần An", "P1", "An"), ("Lê Hà", "P2", None), ("Ngô Hà", "P3", None), ("Hà", None, "Hà"), ("Lạ", None, "Lạ")}
    chairs = spark.createDataFrame([("m", "Trần An"), ("n", "X")], "meeting_id string, chair string")
    assert {r.meeting_id: r.speaker for r in actors.chair_speaker(chairs, speakers).collect()} == {"m": "An", "n": None}


def test_gold_as_prediction_is_perfect(spark):
    a = "meeting_id string, gold_id int, turns array<int>, words array<string>"
    gold = spark.createDataFrame([("m", 1, [1, 2], ["a", "b"]), ("m", 2, [5], ["c"])], a)
    pred = gold.select("meeting_id", F.col("gold_id").alias("pred_id"), "turns", "words", F.lit(True).alias("has_actor"))
    traps = spark.createDataFrame([("m", 1, "rejected_task", [9], ["z"])], "meeting_id string, trap_id int, kind string, turns array<int>, words array<string>")
    points = gold.select("meeting_id", F.col("gold_id").alias("point_id"), F.lit("A").alias("speaker"), "turns", "words")
    said = gold.select("meeting_id", F.col("gold_id").alias("discussion_id"), F.array(F.lit("A")).alias("speakers"), "turns", "words")
    meetings = spark.createDataFrame([("m",), ("empty",)], "meeting_id string")
    s = scoring.summarize(scoring.score_meetings(pred, gold, pred, gold, traps, points, said, meetings)).first()
    assert (s.action_f1, s.decision_f1, s.coverage, s.trap_rate, s.average) == (1.0, 1.0, 1.0, 0.0, 1.0)
    none = scoring.summarize(scoring.score_meetings(pred.limit(0), gold, pred.limit(0), gold, traps, points, said.limit(0), meetings)).first()
    assert (none.action_f1, none.decision_f1, none.coverage) == (0.0, 0.0, 0.0)


def test_deadlines_that_match(spark):
    rows = [("thứ Sáu tuần này", "chậm nhất thứ Sáu", True), (None, None, True), ("", None, True), ("ngày mai", None, False), ("sau khi có kinh phí", "khi có kinh phí", True), ("sau POC", "quý I", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, g string, want boolean")
    assert all(r.ok == r.want for r in df.select("want", scoring.deadline_matches(F.col("p"), F.col("g"), F.lit("2026-11-25")).alias("ok")).collect())


def test_samples_and_turns(spark):
    turns = spark.createDataFrame([("m", i, f"T{i}") for i in range(30)], "meeting_id string, turn_no int, turn_id string")
    p, n = turns.filter("turn_no in (1, 2)"), turns.filter("turn_no in (2, 3)")
    got = scoring.labelled_sample(turns, p, n).collect()
    assert sorted((r.turn_no, r.label) for r in got if r.label is not None) == [(1, True), (3, False)] and len(got) == 10
    rows = spark.createDataFrame([("m", 1, ["T3", "T1"]), ("m", 2, ["T1", "nope"]), ("m", 3, [])], "meeting_id string, item_no int, evidence array<string>")
    assert [(r.item_no, r.turns) for r in scoring.with_turns(rows, turns).collect()] == [(1, [1, 3])]


def test_configuration_is_strict():
    assert Config.of({"turn_builder": {"max_gap_ms": 9}}).turn_builder.max_gap_ms == 9
    for bad in ({"x": {}}, {"turn_builder": {"y": 1}}, {"turn_builder": {"max_gap_ms": True}}, {"verifier": {"enabled": 1}}):
        with pytest.raises(ValueError):
            Config.of(bad)


def test_results_resume(spark, tmp_path):
    path = str(tmp_path / "results")
    asked = spark.createDataFrame([("a", "1", "k"), ("a", "2", "k")], "method string, meeting_id string, cache_key string")
    assert sinks.unfinished(asked, path).count() == 2
    done = asked.withColumn("status", F.when(F.col("meeting_id") == "1", "ok").otherwise("error")).withColumn("error", F.lit(None).cast("string")).withColumn("output", F.lit("{}"))
    sinks.save_results(done, path)
    assert [r.meeting_id for r in sinks.unfinished(asked, path).collect()] == ["2"]
    assert sinks.unfinished(asked.withColumn("cache_key", F.lit("other")), path).count() == 2


def test_scripts_become_transcripts(spark):
    text = "## One\n@A: " + "This is a sentence of some length, " * 12 + "end.\n@B: ok"
    authored = payloads.authored_turns(spark.createDataFrame([("f", text)], "source string, payload string"))
    items = sinks.transcript_of(authored)
    rows = items.orderBy("pos").collect()
    assert len(rows) >= 3 and len({r.item_id for r in rows}) == len(rows) and all(a.end_ms < b.start_ms for a, b in zip(rows, rows[1:], strict=False))
    built = items.groupBy("meeting_id", "turn_no").count()
    assert sinks.turns_as_authored(built, authored).count() == 0
    old = spark.createDataFrame([("f", 1), ("g", 2)], "meeting_id string, n int")
    assert sorted(tuple(r) for r in sinks.upserted(old, old.filter("n = 1").withColumn("n", F.lit(9)), ["meeting_id"]).collect()) == [("f", 9), ("g", 2)]
    assert "| f | 1 |" in sinks.markdown(old, "t", F.col("n"))
