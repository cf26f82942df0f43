"""Deadlines in words to dates and kinds, as one column expression.

A raw deadline is lower-cased and split at "or"; every option goes through rules in a fixed order
(explicit dates, counts, quarters, months, weekdays, weeks, years, day words) and the latest dated
option wins. Kinds: exact, before, end_of_period, relative, unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
SLASH = r"(?<!\d)\d{1,2}\s*[/-]\s*\d{1,2}(?:\s*[/-]\s*(?:\d{4}|\d{2}))?(?!\d)"
DOTTED = r"(?<!\d)\d{1,2}\.\d{1,2}\.\d{4}(?!\d)"
WORDED = r"(?<!\d)\d{1,2}\s+tháng\s+\d{1,2}(?:\s+năm\s+\d{4})?"
NUMBERS = {"một": 1, "hai": 2, "ba": 3, "bốn": 4, "tư": 4, "năm": 5, "sáu": 6, "bảy": 7, "tám": 8, "chín": 9, "mười": 10}
COUNT = r"(?U)(?<![\w/])(?<!thứ )(\d+|" + "|".join(NUMBERS) + r")\s+(ngày|tuần|tháng)\b(?!\s+\d)"
QUARTER, QUARTERS = r"(?U)quý\s+(iv|iii|ii|i|[1-4])\b", {"i": 1, "ii": 2, "iii": 3, "iv": 4, "1": 1, "2": 2, "3": 3, "4": 4}
MONTH = r"(?U)tháng\s+(1[0-2]|[1-9])\b"
WEEKDAY = r"(?U)(?:thứ\s+(hai|ba|tư|năm|sáu|bảy|[2-7])\b|(chủ nhật))"
WEEKDAYS = {"hai": 0, "2": 0, "ba": 1, "3": 1, "tư": 2, "4": 2, "năm": 3, "5": 3, "sáu": 4, "6": 4, "bảy": 5, "7": 5}
NEXT = (
    (r"(?U)\bsang\s+(tuần|tháng|quý|năm)\b(?!\s+(?:sau|tới))", "$1 sau"),
    (r"(?U)\b(tuần|tháng|quý|năm)\s+(?:tiếp theo|tiếp|kế tiếp|kế)\b", "$1 sau"),
)
BEFORE = r"(?U)\b(?:trước|chậm nhất|muộn nhất|không quá|không muộn hơn|hạn chót|hạn cuối|đến hết|đến ngày|tới ngày|hạn)\b"
EITHER = r"(?U)\s+(?:hoặc|hay là|hay)\s+"
# -----------------------------------------------------------------------------------------------


def _result(when: Column, kind: Column | str) -> Column:
    return F.struct(when.cast("date").alias("deadline_date"), (F.lit(kind) if isinstance(kind, str) else kind).alias("deadline_kind"))


def _date(y: Column, m: Column, d: Column) -> Column:
    """The date, or null where there is none, such as 31 February."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd")


def _upcoming(build, anchor: Column) -> Column:
    """A date without a year: this year's, next year's if that has passed, null if this year has none."""
    now = build(F.year(anchor))
    return F.when(now >= anchor, now).when(now < anchor, build(F.year(anchor) + 1))


def _has(text: Column, *phrases: str) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def _lookup(values: dict[str, int], key: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _explicit(t: Column, a: Column) -> Column:
    every = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (SLASH, DOTTED, WORDED)])
    parts = F.transform(every, lambda m: F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)))

    def resolved(p: Column) -> Column:
        d, m, y = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
        year = y.cast("int") + F.when(F.length(y) == 2, 2000).otherwise(0)
        return F.when(y.isNotNull(), _date(year, m, d)).otherwise(_upcoming(lambda x: _date(x, m, d), a))

    def yearless(p: Column) -> Column:  # without an anchor the day must still exist, in a leap year
        return a.isNull() & (F.size(p) == 2) & _date(F.lit(2024), F.get(p, F.lit(1)), F.get(p, F.lit(0))).isNotNull()

    dates = F.array_max(F.transform(parts, resolved))
    kind = F.when(t.rlike(BEFORE), "before").otherwise("exact")
    none = dates.isNull() & ~F.exists(parts, yearless)
    return F.when(F.size(every) > 0, F.when(none, _result(dates, "unknown")).otherwise(_result(dates, kind)))


def _count(t: Column, a: Column) -> Column:
    token, unit = F.regexp_extract(t, COUNT, 1), F.regexp_extract(t, COUNT, 2)
    n = F.coalesce(_lookup(NUMBERS, token), F.when(token.rlike(r"^\d{1,6}$"), token).cast("int"))
    when = F.when(unit == "tháng", F.add_months(a, n)).when(unit == "tuần", F.date_add(a, n * 7)).otherwise(F.date_add(a, n))
    return F.when(token != "", _result(when, "relative"))


def _quarter(t: Column, a: Column) -> Column:
    end = lambda y, q: F.last_day(_date(y, q * 3, F.lit(1)))
    token = F.regexp_extract(t, QUARTER, 1)
    q = _lookup(QUARTERS, token)
    now = F.quarter(a)
    following = F.when(now == 4, end(F.year(a) + 1, F.lit(1))).otherwise(end(F.year(a), now + 1))
    late = F.when(t.contains("cuối"), "end_of_period").otherwise("relative")
    return (
        F.when(token != "", _result(_upcoming(lambda y: end(y, q), a), "end_of_period"))
        .when(_has(t, "quý sau", "quý tới"), _result(following, late))
        .when(t.contains("quý"), _result(end(F.year(a), now), "end_of_period"))
    )


def _month(t: Column, a: Column) -> Column:
    token = F.regexp_extract(t, MONTH, 1)
    named = _upcoming(lambda y: F.last_day(_date(y, F.when(token != "", token).cast("int"), F.lit(1))), a)
    first = F.add_months(F.trunc(a, "month"), 1)
    kind = F.when(t.contains("cuối"), "end_of_period").otherwise("relative")
    following = F.when(t.contains("đầu tháng"), F.date_add(first, 9)).when(t.contains("giữa tháng"), F.date_add(first, 19)).otherwise(F.last_day(first))
    return (
        F.when(token != "", _result(named, "end_of_period"))
        .when(_has(t, "tháng sau", "tháng tới"), _result(following, kind))
        .when(_has(t, "cuối tháng", "tháng này", "trong tháng"), _result(F.last_day(a), kind))
    )


def _monday(a: Column) -> Column:
    return F.date_sub(a, F.weekday(a))


def _weekday(t: Column, a: Column) -> Column:
    name, sunday = F.regexp_extract(t, WEEKDAY, 1), F.regexp_extract(t, WEEKDAY, 2)
    day = F.when(sunday != "", 6).otherwise(_lookup(WEEKDAYS, name))
    later = _has(t, "tuần sau", "tuần tới")
    target = F.date_add(_monday(a), day + F.when(later, 7).otherwise(0))
    target = F.when(~later & ~t.contains("tuần này") & (target < a), F.date_add(target, 7)).otherwise(target)
    return F.when(t.rlike(WEEKDAY), _result(target, F.when(t.rlike(BEFORE), "before").otherwise("relative")))


def _week(t: Column, a: Column) -> Column:
    later = _has(t, "tuần sau", "tuần tới")
    some = later | _has(t, "tuần này", "trong tuần", "cuối tuần", "đầu tuần", "giữa tuần")
    day = F.when(t.contains("đầu tuần"), 0).when(t.contains("giữa tuần"), 2).otherwise(6)
    target = F.date_add(_monday(a), day + F.when(later, 7).otherwise(0))
    target = F.when(target < a, F.date_add(target, 7)).otherwise(target)
    return F.when(some, _result(target, F.when(t.contains("cuối tuần"), "end_of_period").otherwise("relative")))


def _year(t: Column, a: Column) -> Column:
    end = lambda y: _date(y, F.lit(12), F.lit(31))
    return F.when(_has(t, "năm sau", "năm tới"), _result(end(F.year(a) + 1), "relative")).when(
        _has(t, "cuối năm", "năm nay", "trong năm"), _result(end(F.year(a)), F.when(t.contains("cuối năm"), "end_of_period").otherwise("relative"))
    )


def _day(t: Column, a: Column) -> Column:
    return F.when(t.contains("hôm nay"), _result(a, "relative")).when(t.contains("ngày mai"), _result(F.date_add(a, 1), "relative")).when(t.contains("ngày kia"), _result(F.date_add(a, 2), "relative"))


def normalize_deadline(raw: Column, anchor: Column) -> Column:
    """struct<deadline_date date, deadline_kind string> of a deadline in words, relative to the meeting's date.

    Without an anchor only full dates resolve, but the kind is still given. Null and empty are unknown.
    """
    unknown = _result(F.lit(None), "unknown")
    text = F.regexp_replace(F.trim(F.regexp_replace(F.lower(raw), r"(?U)\s+", " ")), r"^[ .,;:]+|[ .,;:]+$", "")
    for pattern, by in NEXT:
        text = F.regexp_replace(text, pattern, by)
    a = anchor.cast("date")
    rules = (_explicit, _count, _quarter, _month, _weekday, _week, _year, _day)
    options = F.transform(F.filter(F.split(text, EITHER), lambda x: x != ""), lambda x: F.coalesce(*[r(x, a) for r in rules], unknown))
    dated = F.array_max(F.transform(F.filter(options, lambda o: o["deadline_date"].isNotNull()), lambda o: o["deadline_date"]))
    first = F.get(F.filter(options, lambda o: o["deadline_date"] == dated), F.lit(0))
    kind = F.get(F.filter(options, lambda o: o["deadline_kind"] != "unknown"), F.lit(0))
    return F.when(raw.isNull() | (raw == ""), unknown).otherwise(F.coalesce(first, kind, unknown))


def resolve_deadline(raw: Column, model_date: Column, anchor: Column) -> Column:
    """The rules' date if they give one, else a valid date of the model, else what the rules say."""
    rule = normalize_deadline(raw, anchor)
    given = F.try_to_date(model_date, "yyyy-MM-dd")
    kind = F.when(rule["deadline_kind"] == "unknown", F.lit("relative")).otherwise(rule["deadline_kind"])
    return F.when(rule["deadline_date"].isNull() & given.isNotNull(), _result(given, kind)).otherwise(rule)


def is_overdue(due: Column, meeting_date: Column, status: Column) -> Column:
    return F.coalesce(due < meeting_date, F.lit(False)) & ~F.coalesce(status == "done", F.lit(False))
