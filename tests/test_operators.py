"""Operators whose results depend on order, and edge cases, on small rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import actors, documents, progress, scoring
from parlance.operators import segmentation as sg
from parlance.operators import transcripts as tr


def column(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first().y


def test_text_keys(spark):
    assert column(spark, "Đồng chí  Nguyễn Văn A (Sở Y tế)", tx.name_key) == "nguyễn văn a"
    assert column(spark, "UBND TP", tx.name_key) == column(spark, "Ủy ban nhân dân Thành phố", tx.name_key) == "ủy ban thành phố"
    assert column(spark, "anh Sơn", tx.grouping_key) == "sơn"
    assert column(spark, "anh chị Sơn", tx.scoring_name) == "sơn"
    assert column(spark, "anh", tx.scoring_name) == ""
    assert column(spark, "Nhóm phụ trách", tx.is_vague) is True
    assert column(spark, "Sở Xây dựng", tx.looks_like_organization) is True
    assert column(spark, "Ban đầu", lambda c: tx.looks_like_organization(c)) is True
    assert column(spark, "Sởn", tx.looks_like_organization) is False
    assert column(spark, "[TURN_000001|An]", tx.bare_id) == "TURN_000001"
    assert column(spark, "<130>", tx.bare_id) == "130"
    assert column(spark, "a b*~c", tx.url_quoted) == "a%20b%2A~c"
    assert column(spark, "em sẽ làm", lambda c: tx.find_cues(c, tx.COMMIT_CUES)) == ["em sẽ"]
    assert column(spark, "Đề án", tx.word_tokens) == ["đề", "án"]
    assert column(spark, "à", lambda c: tx.nfc(c)) == "à"


def test_bigrams_of_short_texts(spark):
    assert column(spark, "a", lambda c: tx.bigrams(tx.word_tokens(c))) == []
    assert column(spark, "a b c", lambda c: tx.bigrams(tx.word_tokens(c))) == ["a b", "b c"]


ITEM = "meeting_id string, pos long, item_id string, text string, speaker string, speaker_role string, speaker_track string, start_ms long, end_ms long, point_id string, ref_ids array<string>, reviewed_text string, reviewed_speaker string, source_schema string"


def items(spark, *rows):
    out = []
    for i, r in enumerate(rows):
        base = dict(meeting_id="m", pos=i, item_id=str(i), text="x", speaker="A", speaker_role=None, speaker_track=None, start_ms=i * 10, end_ms=i * 10 + 5, point_id=None, ref_ids=[], reviewed_text=None, reviewed_speaker=None, source_schema=None)
        out.append(tuple((base | r).values()))
    return spark.createDataFrame(out, ITEM)


def turn_texts(rows, **options):
    return [r.text_exact for r in tr.turns(tr.evidence(tr.effective(rows)), **options).orderBy("turn_no").collect()]


def test_turns_break_where_they_should(spark):
    assert turn_texts(items(spark, {"text": "a"}, {"text": "b"}, {"text": " "}, {"text": "c"})) == ["a b c"]
    assert turn_texts(items(spark, {"text": "a"}, {"text": "b", "speaker": "B"})) == ["a", "b"]
    assert turn_texts(items(spark, {"text": "a", "point_id": "1"}, {"text": "b"}, {"text": "c", "point_id": "1"})) == ["a b c"]
    assert turn_texts(items(spark, {"text": "a", "point_id": "1"}, {"text": "b", "point_id": "2"})) == ["a", "b"]
    assert turn_texts(items(spark, {"text": "a"}, {"text": "b", "start_ms": None})) == ["a", "b"]
    assert turn_texts(items(spark, {"text": "a"}, {"text": "b", "start_ms": None}), merge_untimed=True) == ["a b"]
    assert turn_texts(items(spark, {"text": "a"}, {"text": "b", "start_ms": 9000, "end_ms": 9001})) == ["a", "b"]
    assert turn_texts(items(spark, {"text": "a", "speaker": None}, {"text": "b", "speaker": None})) == ["a", "b"]
    # a label of an unknown speaker is no speaker, but it is a voice
    assert turn_texts(items(spark, {"text": "a", "speaker": "Unknown speaker 01"}, {"text": "b", "speaker": "Unknown speaker 01"})) == ["a b"]


def test_reviews_and_errors(spark):
    rows = tr.evidence(tr.effective(items(spark, {"reviewed_text": ""}, {"item_id": "0"}, {"end_ms": 1, "start_ms": 5, "speaker_role": "Chủ trì"}))).orderBy("pos").collect()
    assert rows[0].text == "" and rows[0].provenance.text == "human_review"
    assert rows[0].errors == ["repeated item id"] and rows[2].errors == ["end before start"]
    assert rows[2].role == "chair"


def test_renaming_keeps_the_first(spark):
    got = tr.renamed_ids(items(spark, {"item_id": "a"}, {"item_id": "a"}, {"item_id": "a-1"}, {"item_id": "a"})).orderBy("pos")
    assert [r.item_id for r in got.collect()] == ["a", "a-1", "a-1-1", "a-2"]


def brute_depth(s):
    out = []
    for i in range(len(s)):
        left = right = i
        while left > 0 and s[left - 1] >= s[left]:
            left -= 1
        while right < len(s) - 1 and s[right + 1] >= s[right]:
            right += 1
        out.append(s[left] + s[right] - 2 * s[i])
    return out


def test_depth_is_that_of_the_definition(spark):
    rng = random.Random(5)
    series = [[rng.randint(0, 4) / 4 for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows = spark.createDataFrame([(m, g, float(v)) for m, s in enumerate(series) for g, v in enumerate(s)], "meeting_id int, gap int, smooth double")
    got = {(r.meeting_id, r.gap): r.depth for r in sg.depths(rows).collect()}
    assert all(abs(got[m, g] - d) < 1e-9 for m, s in enumerate(series) for g, d in enumerate(brute_depth(s)))


def test_partition_tree_against_brute_force():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(16, 3))
    scatter = lambda a, b: ((x[a:b] - x[a:b].mean(0)) ** 2).sum() if b > a else 0.0
    lo, hi, cut, gain, order = sg.partition_tree(x, 2)[0]
    losses = {i: scatter(0, i) + scatter(i, 16) for i in range(2, 15)}
    assert (lo, hi, order) == (0, 16, 0) and cut == min(losses, key=losses.get)
    assert abs(gain - (scatter(0, 16) - losses[cut])) < 1e-9
    cuts = [sg.cut_by_number(sg.partition_tree(x, 2), n) for n in (1, 2, 3, 4)]
    assert [len(c) for c in cuts] == [0, 1, 2, 3] and all(set(a) <= set(b) for a, b in zip(cuts, cuts[1:], strict=False))


def test_gain_cut_finds_a_shift_and_nothing_in_a_constant():
    x = np.concatenate([np.zeros((10, 2)), np.ones((10, 2))])
    assert sg.cut_by_gain(sg.partition_tree(x), x, 0.1) == [10]
    flat = np.ones((12, 2))
    assert sg.cut_by_gain(sg.partition_tree(flat), flat, 0.1) == []
    assert sg.cut_by_gain(sg.partition_tree(flat), flat, 0.1, weight=np.full(12, 10.0), heaviest=70.0) != []


def test_boundaries_respect_sizes():
    depth = np.zeros(19)
    depth[[4, 9, 14]] = [1.0, 2.0, 1.5]
    assert sg.choose_boundaries(depth, np.full(20, 500), k=0.5) == [5, 10, 15]
    assert sg.choose_boundaries(depth, np.full(20, 100), k=0.5) == []  # all too short: they merge away
    assert sg.choose_boundaries(np.zeros(7), np.full(8, 3000), cap=12_000) == [4]


def test_compound_actors():
    split = actors.split_mentions
    assert split("Sở Xây dựng", []) == [("Sở Xây dựng", "lead")]
    assert split("Sở A chủ trì, phối hợp với Sở B và Sở C", []) == [("Sở A", "lead"), ("Sở B", "support"), ("Sở C", "support")]
    assert split("anh Sơn và chị Hà", []) == [("anh Sơn", "joint"), ("chị Hà", "joint")]
    assert split("Ban Quản lý và Vận hành", ["Ban Quản lý và Vận hành"]) == [("Ban Quản lý và Vận hành", "lead")]
    assert split("Sở A (chủ trì), Sở B (phối hợp)", []) == [("Sở A", "lead"), ("Sở B", "support")]
    assert split(None, []) == split("  ", []) == []
    assert split("Sở A, Sở B phối hợp với Sở C", []) == [("Sở A", "lead"), ("Sở B", "lead"), ("Sở C", "support")]
    assert split("Sở Nông nghiệp và Môi trường", []) == [("Sở Nông nghiệp và Môi trường", "lead")]
    assert split("Sở Văn hóa và Thể thao", []) == [("Sở Văn hóa và Thể thao", "lead")] and split("Sở Văn hóa và chị Hà", ["Lê Hà"]) == [("Sở Văn hóa", "joint"), ("chị Hà", "joint")]
    assert split("Sở A (phối hợp), Sở B (chủ trì)", []) == [("Sở A", "support"), ("Sở B", "lead")]
    assert split("do Sở A đầu mối; anh Sơn cùng với chị Hà", []) == [("Sở A", "lead"), ("anh Sơn", "lead"), ("chị Hà", "lead")]
    assert split("Sở Y te\u0302\u0301 và Sở Xây dựng", ["Sở Y tế"]) == [("Sở Y tế", "joint"), ("Sở Xây dựng", "joint")]


def test_context_and_functions_decide_ties(spark):
    people = spark.createDataFrame([("m", "P1", "Trần An", "O1"), ("m", "P2", "Lê An", "O2")], "meeting_id string, ref_id string, full_name string, org_id string")
    orgs = spark.createDataFrame([("m", "O1", "Sở Y tế", [], ["khám bệnh"]), ("m", "O2", "Sở Tài chính", [], ["ngân sách"])], "meeting_id string, ref_id string, name string, aliases array<string>, functions array<string>")
    mentions = spark.createDataFrame([("m", 1, "An"), ("m", 2, None), ("m", 3, "Sở Lạ")], "meeting_id string, mention_id int, mention string")
    found = actors.candidates(mentions, people, orgs)
    plain = {r.mention_id: r for r in actors.resolved(mentions, found).collect()}
    assert plain[1].flag == "ambiguous" and plain[1].n_candidates == 2 and plain[2].flag == "missing"
    assert plain[3].name == "Sở Lạ" and plain[3].kind == "organization"
    context = spark.createDataFrame([("m", 1, "Chủ toạ", "Lê An", False)], "meeting_id string, mention_id int, confirm_speaker string, responder string, self_committed boolean")
    assert {r.mention_id: r.ref_id for r in actors.choose(actors.with_context(found, context)).collect()}[1] == "P2"
    tasks = spark.createDataFrame([("m", 1, "rà soát ngân sách năm tới")], "meeting_id string, mention_id int, text string")
    assert {r.mention_id: r.ref_id for r in actors.choose(found, tasks).collect()}[1] == "P2"


def most_shuffled(df):
    """Rows of the result, and the most rows that one exchange of its plan wrote."""
    n, most, nodes = len(df.collect()), 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "Exchange":
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
        below = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
        nodes += below
    return n, most


def crowd(spark):
    """A meeting where 100 people share a given name that is said 200 times, in two spellings."""
    people = spark.createDataFrame([("m", f"P{i}", f"Họ{i} An", None) for i in range(100)], "meeting_id string, ref_id string, full_name string, org_id string")
    orgs = spark.createDataFrame([("m", "O1", "Sở Y tế", ["Y tế"], [])], "meeting_id string, ref_id string, name string, aliases array<string>, functions array<string>")
    said = [("m", i, "An" if i % 2 else "AN") for i in range(200)] + [("m", 200, "Sở Lạ"), ("m", 201, "sở y tế"), ("m", 202, "họ7 an"), ("m", 203, None), ("m", 204, " "), (None, 205, "Sở Lạ"), (None, 206, "An")]
    return spark.createDataFrame(said, "meeting_id string, mention_id int, mention string"), people, orgs


def test_no_pair_of_a_mention_and_a_candidate_is_shuffled(spark):
    mentions, people, orgs = crowd(spark)
    found = actors.candidates(mentions, people, orgs)
    n, most = most_shuffled(found)
    assert n == 200 * 100 + 4 and most < 1000
    assert sorted((r.mention_id, r.name, r.score) for r in found.filter("mention_id >= 200").collect()) == [(200, "Sở Lạ", 0.6), (201, "Sở Y tế", 1.0), (202, "Họ7 An", 1.0), (205, "Sở Lạ", 0.6)]


def test_a_choice_by_the_roster_is_made_once_for_each_name(spark):
    mentions, people, orgs = crowd(spark)
    got = actors.resolved_by_roster(mentions, people, orgs)
    assert most_shuffled(got) == (207, 207)
    columns = ["meeting_id", "mention_id", "mention", "name", "kind", "ref_id", "score", "flag", "n_candidates"]
    each = actors.resolved(mentions, actors.candidates(mentions, people, orgs)).select(columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, each.collect()))
    rows = {r.mention_id: (r.name, r.flag, r.n_candidates) for r in got.collect()}
    assert rows[0] == rows[1] == (None, "ambiguous", 100) and rows[202] == ("Họ7 An", None, 1) and rows[203][1] == rows[204][1] == "missing"


def test_pairs_of_a_frequent_name_take_many_tasks_and_the_same_rows(spark):
    mentions, people, orgs = crowd(spark)
    plain = sorted(map(str, actors.candidates(mentions, people, orgs).collect()))
    tiled = actors.candidates(mentions, people, orgs, many=2, side=32, run=8)
    assert sorted(map(str, tiled.collect())) == plain
    of_name = tiled.filter("lower(mention) = 'an'")  # tiles of at most 32 x 32 pairs, dealt out by a hash
    assert of_name.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 8 * 32 * 32


def test_a_frequent_name_is_no_single_task(spark):
    people = spark.range(9000).select(F.lit("m").alias("meeting_id"), F.concat(F.lit("P"), "id").alias("ref_id"), F.concat(F.lit("Nguyễn"), "id", F.lit(" An")).alias("full_name"), F.lit(None).cast("string").alias("org_id"))
    mentions = spark.range(150).select(F.lit("m").alias("meeting_id"), F.col("id").alias("mention_id"), F.lit("An").alias("mention"))
    n = [r["count"] for r in actors.candidates(mentions, people, crowd(spark)[2]).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == 150 * 9000 and len(n) > 1


def test_merging_is_first_fit(spark):
    rows = [("m", 1, "sơn", None, "rà soát báo cáo tài chính quý", None, ["1"]), ("m", 2, "sơn", "T1", "rà soát báo cáo tài chính quý ba", "2026-01-01", ["2"]), ("m", 3, "hà", None, "rà soát báo cáo tài chính quý", None, ["3"]), ("m", 4, "sơn", "T2", "rà soát báo cáo tài chính quý", None, ["4"])]
    df = spark.createDataFrame(rows, "meeting_id string, pos int, actor_key string, task_id string, text string, deadline string, evidence_ids array<string>")
    got = [(r.pos, r.task_id, r.deadline, r.evidence_ids, r.n_merged) for r in progress.merge_assignments(df).orderBy("pos").collect()]
    assert got == [(1, "T1", "2026-01-01", ["2", "1"], 2), (3, None, None, ["3"], 1), (4, "T2", None, ["4"], 1)]


def test_status_checks(spark):
    updates = spark.createDataFrame([(1, "done", False), (2, "done", False), (3, "done", True), (4, "done", False), (5, "done", False)], "update_id int, status string, generic_question boolean")
    judged = [(1, 0, 7, {"done": 0.1}, False), (1, 1, 3, {"done": 0.9}, False), (2, 0, 7, {"blocked": 0.9}, False), (3, 0, 7, {"blocked": 0.5, "in_progress": 0.4}, False), (4, 0, 7, {"done": 0.3}, False)]
    rows = spark.createDataFrame(judged, "update_id int, turn_rank int, pos int, labels map<string,double>, failed boolean")
    named = rows.join(updates.select("update_id", "status"), "update_id").withColumn("labels", F.map_concat("labels", F.create_map(F.lit("status"), F.coalesce(F.try_element_at("labels", "status"), F.lit(0.0))))).drop("status")
    got = {r.update_id: (r.flag, r.checked_status, r.status_pos) for r in progress.check_status(updates, named).collect()}
    assert got == {1: ("confirmed", "done", 3), 2: ("revised", "blocked", None), 3: ("kept", "done", None), 4: ("uncertain", "mentioned", None), 5: ("unchecked", "done", None)}


def test_mentions(spark):
    updates = spark.createDataFrame([(i, "mentioned") for i in range(5)], "update_id int, status string")
    judged = [(0, 0, {"unrelated": 0.9}, 0.0), (1, 0, {"unrelated": 0.9}, 0.0), (1, 1, {"done": 0.9}, 0.0), (2, 0, {"directive": 0.9}, 0.9), (3, 0, {"directive": 0.9}, 0.1)]
    rows = spark.createDataFrame(judged, "update_id int, turn_rank int, labels map<string,double>, p_commit double")
    got = {r.update_id: (r.flag, r.checked_status) for r in progress.check_mentions(updates, rows).collect()}
    assert got == {1: ("raised", "done"), 2: ("raised", "directive"), 3: ("kept", "mentioned"), 4: ("unchecked", "mentioned")}


@pytest.mark.parametrize("seed", range(3))
def test_gold_scores_one_and_empty_scores_nothing(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    gold = [("m", i, [i, i + 1], rng.sample(words, 6)) for i in range(8)]
    g = spark.createDataFrame(gold, "meeting_id string, gold_id int, turns array<int>, words array<string>")
    p = g.select("meeting_id", F.col("gold_id").alias("pred_id"), "turns", "words")
    pairs = scoring.pairs_in_window(p, g)
    got = scoring.greedy_match(pairs).collect()
    assert len(got) == 8 and all(r.score == 1.0 for r in got if r.pred_id == r.gold_id)
    assert scoring.greedy_match(scoring.pairs_in_window(p.limit(0), g)).count() == 0


def test_bootstrap_of_perfect_scores(spark):
    counts = spark.createDataFrame([(str(i), 5, 5, 5) for i in range(4)], "meeting_id string, tp int, n_pred int, n_gold int")
    r = scoring.bootstrap_interval(counts, resamples=50).first()
    assert (r.f1, r.low, r.high) == (1.0, 1.0, 1.0)
    both = counts.select("meeting_id", F.col("tp").alias("tp_a"), F.col("n_pred").alias("n_a"), F.col("tp").alias("tp_b"), F.col("n_pred").alias("n_b"), "n_gold")
    assert scoring.paired_bootstrap(both, resamples=50).first().p_value == 1.0


def test_unassigned_tasks_stay_last(spark):
    rows = spark.createDataFrame([("m", "t1", 1, ["anh Sơn", "Sơn"]), ("m", "t2", 2, []), ("m", "t3", 3, ["Hà", "sơn"])], "meeting_id string, task_id string, pos int, targets array<string>")
    got = [(r.assignee, r.task_ids) for r in documents.by_assignee(rows).orderBy("group_no").collect()]
    assert got == [("anh Sơn", ["t1", "t3"]), ("Hà", ["t3"]), (None, ["t2"])]
