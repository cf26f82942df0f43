"""Deadline rules against a table of phrases; the meeting is on Thursday 2026-10-08."""

import datetime

from pyspark.sql import functions as F

from parlance.functions.dates import is_overdue, normalize_deadline, resolve_deadline

CASES = """
ngày 15/11|2026-11-15|exact
15-11-2026|2026-11-15|exact
15.11.2026|2026-11-15|exact
ngày 15 tháng 11 năm 2027|2027-11-15|exact
ngày 5/3|2027-03-05|exact
từ 10/11 đến 15/11|2026-11-15|exact
trước ngày 15 tháng 11|2026-11-15|before
trước 25/11|2026-11-25|before
chậm nhất 15/11/26|2026-11-15|before
trước thứ Sáu|2026-10-09|before
cuối tháng|2026-10-31|end_of_period
trước cuối tháng|2026-10-31|end_of_period
trong tháng 12|2026-12-31|end_of_period
cuối quý|2026-12-31|end_of_period
quý IV|2026-12-31|end_of_period
quý I|2027-03-31|end_of_period
cuối năm|2026-12-31|end_of_period
cuối tuần|2026-10-11|end_of_period
tuần sau|2026-10-18|relative
trong tuần này|2026-10-11|relative
tháng sau|2026-11-30|relative
thứ Sáu tuần sau|2026-10-16|relative
thứ Hai hoặc thứ Tư tuần sau|2026-10-14|relative
trong 3 ngày tới|2026-10-11|relative
hôm nay|2026-10-08|relative
sang tuần|2026-10-18|relative
tuần tiếp theo|2026-10-18|relative
khoảng 3 tuần|2026-10-29|relative
ba tuần nữa|2026-10-29|relative
3 tháng tới|2027-01-08|relative
sang tháng|2026-11-30|relative
đầu tuần sau|2026-10-12|relative
giữa tháng sau|2026-11-20|relative
thứ năm tuần sau|2026-10-15|relative
quý sau|2027-03-31|relative
năm tới|2027-12-31|relative
ngày mai|2026-10-09|relative
31/2||unknown
sau POC||unknown
||unknown
"""


def _resolve(spark, raws, anchor):
    rows = spark.createDataFrame([(i, r, anchor) for i, r in enumerate(raws)], "i int, raw string, d date")
    out = rows.select("i", normalize_deadline(F.col("raw"), F.col("d")).alias("x")).orderBy("i").collect()
    return [(str(r.x.deadline_date) if r.x.deadline_date else "", r.x.deadline_kind) for r in out]


def test_phrases(spark):
    cases = [line.split("|") for line in CASES.strip().split("\n")]
    got = _resolve(spark, [c[0] for c in cases], datetime.date(2026, 10, 8))
    assert [(c[0], *g) for c, g in zip(cases, got, strict=True)] == [tuple(c) for c in cases]


def test_without_a_meeting_date_the_kind_stays(spark):
    got = _resolve(spark, ["tuần sau", "15-11-2026", "trước ngày 15/11", "31/2", None], None)
    assert got == [("", "relative"), ("2026-11-15", "exact"), ("", "before"), ("", "unknown"), ("", "unknown")]


def test_rules_win_over_the_model(spark):
    rows = spark.createDataFrame([("tuần sau", "2026-01-01"), ("sau POC", "2026-12-01"), ("sau POC", "2026-02-31")], "raw string, m string")
    got = [str(r.x.deadline_date) for r in rows.select(resolve_deadline(F.col("raw"), F.col("m"), F.lit("2026-10-08")).alias("x")).collect()]
    assert got == ["2026-10-18", "2026-12-01", "None"]


def test_overdue(spark):
    day = datetime.date(2026, 1, 1)
    rows = spark.createDataFrame([(day, "in_progress"), (day, "done"), (None, "blocked")], "due date, status string")
    got = [r[0] for r in rows.select(is_overdue(F.col("due"), F.lit("2026-02-01").cast("date"), F.col("status"))).collect()]
    assert got == [True, False, False]
