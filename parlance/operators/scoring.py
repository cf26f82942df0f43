"""Scoring of predictions against gold: matching, rates, calibration, resampling, segmentation errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.dates import normalize_deadline
from parlance.functions.text import dice, syllables

# --- fixed values -----------------------------------------------------------------------------
WINDOW, MIN_DICE, RESAMPLES = 1, 0.15, 1000
# -----------------------------------------------------------------------------------------------


def pairs_in_window(pred: DataFrame, gold: DataFrame, window: int = WINDOW, least: float = MIN_DICE) -> DataFrame:
    """(meeting_id, pred_id, gold_id, score): predictions with a turn near a gold item's and words in common.

    Both have meeting_id, an id, turns (array) and words (set). The window runs from the first gold
    turn to the last; predicted turns are exploded and gold windows too, so the range join is an
    equi-join on (meeting_id, turn).
    """
    p = pred.select("meeting_id", "pred_id", F.col("words").alias("pw"), F.explode(F.array_distinct("turns")).alias("turn"))
    span = F.sequence(F.array_min("turns") - window, F.array_max("turns") + window)
    g = gold.select("meeting_id", "gold_id", F.col("words").alias("gw"), F.explode(span).alias("turn"))
    near = p.join(g, ["meeting_id", "turn"]).dropDuplicates(["meeting_id", "pred_id", "gold_id"])
    return near.withColumn("score", dice(F.col("pw"), F.col("gw"))).filter(F.col("score") >= least).select("meeting_id", "pred_id", "gold_id", "score")


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One to one, the best score first, then the smaller ids; one meeting's candidates at a time."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", "pred_id", "gold_id"], ascending=[False, True, True], kind="stable")
        p, g, keep = set(), set(), []
        for a, b in zip(part["pred_id"], part["gold_id"], strict=True):
            ok = a not in p and b not in g
            keep.append(ok)
            if ok:
                p.add(a)
                g.add(b)
        return part[keep]

    return pairs.groupBy("meeting_id").applyInPandas(run, pairs.schema)


def trapped(pred: DataFrame, matched: DataFrame, traps: DataFrame, window: int = WINDOW, least: float = MIN_DICE) -> DataFrame:
    """(meeting_id, pred_id, trap_id): predictions that match no gold but a trap; its first by order.

    ``traps`` have meeting_id, trap_id, kind, turns, words; ``unassigned_task`` traps only those
    predictions that name an actor (has_actor).
    """
    free = pred.join(matched.select("meeting_id", "pred_id"), ["meeting_id", "pred_id"], "left_anti")
    hits = pairs_in_window(free, traps.withColumnRenamed("trap_id", "gold_id"), window, least).withColumnRenamed("gold_id", "trap_id")
    hits = hits.join(traps.select("meeting_id", "trap_id", "kind"), ["meeting_id", "trap_id"]).join(free.select("meeting_id", "pred_id", "has_actor"), ["meeting_id", "pred_id"])
    hits = hits.filter((F.col("kind") != "unassigned_task") | F.col("has_actor"))
    return hits.groupBy("meeting_id", "pred_id").agg(F.min("trap_id").alias("trap_id"))


def covered(points: DataFrame, discussion: DataFrame, window: int = WINDOW, least: float = MIN_DICE) -> DataFrame:
    """Adds covered to key points: some discussion point is near, alike and by the speaker; many may share one."""
    near = pairs_in_window(discussion.withColumnRenamed("discussion_id", "pred_id"), points.withColumnRenamed("point_id", "gold_id"), window, least)
    by = near.join(discussion.select("meeting_id", F.col("discussion_id").alias("pred_id"), "speakers"), ["meeting_id", "pred_id"])
    by = by.join(points.select("meeting_id", F.col("point_id").alias("gold_id"), "speaker"), ["meeting_id", "gold_id"]).filter(F.array_contains("speakers", F.col("speaker")))
    hit = by.select("meeting_id", F.col("gold_id").alias("point_id")).distinct().withColumn("covered", F.lit(True))
    return points.join(hit, ["meeting_id", "point_id"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def f1(tp: Column, n_pred: Column, n_gold: Column) -> Column:
    """1 if there is nothing to find and nothing found."""
    return F.when((n_pred + n_gold) == 0, F.lit(1.0)).otherwise(2.0 * tp / (n_pred + n_gold))


def rates(rows: DataFrame, predicted: str, actual: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of boolean columns, over groups or all rows; null where there is nothing to divide by."""
    p, a = F.col(predicted), F.col(actual)
    agg = rows.groupBy(*(by or [])).agg(F.count_if(p & a).alias("tp"), F.count_if(p).alias("n_pred"), F.count_if(a).alias("n_gold"))
    return agg.withColumn("precision", F.try_divide("tp", "n_pred")).withColumn("recall", F.try_divide("tp", "n_gold")).withColumn("f1", f1(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


def calibration_error(rows: DataFrame, probability: str, actual: str, bins: int = 10) -> DataFrame:
    """The expected calibration error over equal bins, the last one closed."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1))
    each = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("p"), F.avg(F.col(actual).cast("double")).alias("a"))
    return each.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("a"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n_rows"))


def zones(rows: DataFrame, probability: str, actual: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Rows and hits where the probability is clear, rejected or between."""
    z = F.when(F.col(probability) >= high, "clear").when(F.col(probability) < low, "rejected").otherwise("unclear")
    return rows.groupBy(z.alias("zone")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(actual).alias("n_hits"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, share: float, out: str) -> DataFrame:
    """The value at index floor(n * share) of each group in order."""
    w = Window.partitionBy(*by)
    n = rows.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return n.filter(F.col("_i") == F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)).select(*by, F.col(value).alias(out))


def drawn(seed: int, *parts: Column, below: Column) -> Column:
    """A number from 0 to ``below`` - 1 by the MD5 sum of a seed and some numbers, which every SQL engine draws alike."""
    digits = F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary")), F.lit(12))
    return F.conv(digits, 16, 10).cast("long") % below


def _resampled(counts: DataFrame, resamples: int, seed: int, sums: list[str]) -> DataFrame:
    """Sums of the counts of each resample: as many draws, with replacement, as there are meetings.

    Meetings are numbered over all in the order of their ids: there are as many as were scored.
    """
    numbered = counts.withColumn("meeting_no", F.row_number().over(Window.orderBy("meeting_id")).cast("long") - 1)
    n = counts.agg(F.count(F.lit(1))).scalar()
    draws = counts.sparkSession.range(resamples).withColumnRenamed("id", "resample").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    draws = draws.withColumn("meeting_no", drawn(seed, F.col("resample"), F.col("draw"), below=n)).groupBy("resample", "meeting_no").agg(F.count(F.lit(1)).alias("times"))
    return draws.join(numbered, "meeting_no").groupBy("resample").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in sums])


def with_turns(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Items (meeting_id, item_no, evidence) with turns, the sorted positions of their evidence; unknown or no evidence drops an item."""
    e = rows.select("meeting_id", "item_no", F.explode("evidence").alias("turn_id")).join(turns.select("meeting_id", "turn_id", "turn_no"), ["meeting_id", "turn_id"], "left")
    agg = e.groupBy("meeting_id", "item_no").agg(F.sort_array(F.collect_set("turn_no")).alias("turns"), F.max(F.col("turn_no").isNull()).alias("_lost")).filter("not _lost").drop("_lost")
    return rows.join(agg, ["meeting_id", "item_no"])


def deadline_matches(pred: Column, gold: Column, anchor: Column) -> Column:
    """Both none, the same date, or, where one has no date, words enough in common."""
    p = F.nullif(F.trim(pred), F.lit(""))
    a, b = normalize_deadline(p, anchor)["deadline_date"], normalize_deadline(gold, anchor)["deadline_date"]
    alike = dice(syllables(p), syllables(gold)) >= 0.5
    return F.when(p.isNull() | gold.isNull(), p.isNull() & gold.isNull()).when(a.isNotNull() & b.isNotNull(), a == b).otherwise(alike)


COUNTS = ("tp_actions", "n_pred_actions", "n_gold_actions", "tp_decisions", "n_pred_decisions", "n_gold_decisions", "n_trapped", "n_traps", "n_covered", "n_points")


def score_meetings(pred_actions: DataFrame, gold_actions: DataFrame, pred_decisions: DataFrame, gold_decisions: DataFrame, traps: DataFrame, points: DataFrame, discussion: DataFrame, meetings: DataFrame) -> DataFrame:
    """The counts of each meeting: matches, predictions, gold, traps and covered points, zeros where there is nothing."""

    def count(rows: DataFrame, name: str, only: Column | None = None) -> DataFrame:
        return rows.groupBy("meeting_id").agg((F.count(F.lit(1)) if only is None else F.count_if(only)).alias(name))

    ma, md = greedy_match(pairs_in_window(pred_actions, gold_actions)), greedy_match(pairs_in_window(pred_decisions, gold_decisions))
    on_actions = traps.filter(F.col("kind").isin("rejected_task", "unassigned_task", "hedged_proposal"))
    on_decisions = traps.filter(F.col("kind").isin("hedged_proposal", "superseded_decision", "rejected_task"))
    hits = trapped(pred_actions, ma, on_actions).select("meeting_id", "trap_id").unionByName(trapped(pred_decisions, md, on_decisions).select("meeting_id", "trap_id")).distinct()
    parts = [
        count(ma, "tp_actions"), count(pred_actions, "n_pred_actions"), count(gold_actions, "n_gold_actions"), count(md, "tp_decisions"), count(pred_decisions, "n_pred_decisions"), count(gold_decisions, "n_gold_decisions"),
        count(hits, "n_trapped"), count(traps, "n_traps"), count(covered(points, discussion), "n_covered", F.col("covered")), count(points, "n_points"),
    ]
    out = meetings.select("meeting_id").distinct()
    for part in parts:
        out = out.join(part, "meeting_id", "left")
    return out.na.fill(0)


def summarize(counts: DataFrame) -> DataFrame:
    """Micro rates over all meetings, and their average: null if one of the four is."""
    sums = counts.agg(*[F.sum(c).alias(c) for c in COUNTS])
    rows = sums.select(
        f1(F.col("tp_actions"), F.col("n_pred_actions"), F.col("n_gold_actions")).alias("action_f1"), f1(F.col("tp_decisions"), F.col("n_pred_decisions"), F.col("n_gold_decisions")).alias("decision_f1"),
        F.try_divide("n_covered", "n_points").alias("coverage"), F.try_divide("n_trapped", "n_traps").alias("trap_rate"),
    )
    return rows.withColumn("average", (F.col("action_f1") + F.col("decision_f1") + F.col("coverage") + 1 - F.col("trap_rate")) / 4)


def labelled_sample(turns: DataFrame, positive: DataFrame, negative: DataFrame, others: int = 8, seed: int = 7) -> DataFrame:
    """Labelled turns (meeting_id, turn_no, label): gold ones that are not both, and ``others`` random ones of each meeting: a sampling operator."""
    keys = ["meeting_id", "turn_no"]
    p, n = positive.select(*keys).distinct(), negative.select(*keys).distinct()
    gold = p.join(n, keys, "left_anti").withColumn("label", F.lit(True)).unionByName(n.join(p, keys, "left_anti").withColumn("label", F.lit(False)))
    free = turns.select(*keys).join(p.unionByName(n).distinct(), keys, "left_anti")
    draw = F.row_number().over(Window.partitionBy("meeting_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys).cast("binary")), "turn_no"))
    return gold.unionByName(free.withColumn("_r", draw).filter(F.col("_r") <= others).drop("_r").withColumn("label", F.lit(None).cast("boolean")))


def strongest_boundaries(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``n`` deepest gaps of each meeting (wanted: meeting_id, n) as boundaries: (meeting_id, pos)."""
    w = Window.partitionBy("meeting_id").orderBy(F.desc("depth"), "gap")
    rows = scores.withColumn("_r", F.row_number().over(w)).join(wanted, "meeting_id").filter(F.col("_r") <= F.col("n"))
    return rows.select("meeting_id", (F.col("gap") + 1).alias("pos"))


def bootstrap_interval(counts: DataFrame, resamples: int = RESAMPLES, seed: int = 7, level: float = 0.95) -> DataFrame:
    """The micro F1 of per-meeting counts (tp, n_pred, n_gold), and its percentile interval over resamples of meetings."""
    score = f1(F.col("tp"), F.col("n_pred"), F.col("n_gold"))
    point = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_gold")]).select(score.alias("f1"))
    each = _resampled(counts, resamples, seed, ["tp", "n_pred", "n_gold"]).select(score.alias("s"))
    tail = (1 - level) / 2
    return point.crossJoin(each.agg(F.percentile("s", tail).alias("low"), F.percentile("s", 1 - tail).alias("high")))


def paired_bootstrap(counts: DataFrame, resamples: int = RESAMPLES, seed: int = 7) -> DataFrame:
    """The difference of two systems' micro F1 (tp_a, n_a, tp_b, n_b, n_gold), its interval and two-sided p by the same draws."""
    d = f1(F.col("tp_a"), F.col("n_a"), F.col("n_gold")) - f1(F.col("tp_b"), F.col("n_b"), F.col("n_gold"))
    sums = ["tp_a", "n_a", "tp_b", "n_b", "n_gold"]
    point = counts.agg(*[F.sum(c).alias(c) for c in sums]).select(d.alias("difference"))
    each = _resampled(counts, resamples, seed, sums).select(d.alias("d"))
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))))
    return point.crossJoin(each.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), p.alias("p_value")))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds rejected by Holm's step-down to tests (name, p_value): all tests up to the first that fails."""
    w = Window.orderBy("p_value", "name")  # a family of tests is small
    rows = tests.withColumn("rank", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    passes = (F.col("p_value") <= alpha / (F.col("_n") - F.col("rank") + 1)).cast("int")
    return rows.withColumn("rejected", F.min(passes).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_n")


def pk_windowdiff(units: DataFrame) -> DataFrame:
    """(meeting_id, k, pk, windowdiff) of units (meeting_id, pos from 0, gold, pred: true where a segment starts).

    Beeferman, Berger and Lafferty's Pk and Pevzner and Hearst's WindowDiff; k is half the mean
    length of a gold segment. Null where no window fits.
    """
    w = Window.partitionBy("meeting_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.col("pos") > 0).cast("int")
    rows = units.withColumn("g", F.sum(F.col("gold").cast("int") * start).over(w)).withColumn("p", F.sum(F.col("pred").cast("int") * start).over(w))
    size = rows.groupBy("meeting_id").agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) / (2 * (F.max("g") + 1))).cast("int")).alias("k"))
    rows = rows.join(size, "meeting_id")
    far = rows.select("meeting_id", (F.col("pos") - F.col("k")).alias("pos"), F.col("g").alias("g2"), F.col("p").alias("p2"))
    both = rows.join(far, ["meeting_id", "pos"])
    apart = ((F.col("g") == F.col("g2")) != (F.col("p") == F.col("p2"))).cast("double")
    differ = ((F.col("g2") - F.col("g")) != (F.col("p2") - F.col("p"))).cast("double")
    scores = both.groupBy("meeting_id").agg(F.avg(apart).alias("pk"), F.avg(differ).alias("windowdiff"))
    return size.join(scores, "meeting_id", "left")


def disjoint(rows: DataFrame, name: str, positive: Column, negative: Column) -> DataFrame:
    """(name, has_positive, has_negative) of the groups that are not both."""
    agg = rows.groupBy(name).agg(F.bool_or(positive).alias("has_positive"), F.bool_or(negative).alias("has_negative"))
    return agg.filter(~(F.col("has_positive") & F.col("has_negative")))


def label_distribution(labels: Column, least: float = 0.05) -> Column:
    """The labels of a map of probabilities that reach ``least``, as (label, p), the likeliest first."""
    pairs = F.transform(F.map_entries(F.map_filter(labels, lambda k, v: v >= least)), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("label")))
    return F.transform(F.array_sort(pairs), lambda x: F.struct(x["label"].alias("label"), (-x["o"]).alias("p")))
