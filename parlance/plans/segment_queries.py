"""Segmentation over embeddings, fifty neighbouring vectors to a meeting, and search over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.vectors import cosine, dot, norm, total
from parlance.operators import search
from parlance.operators import segmentation as sg
from parlance.plans.registry import query, table

STOP = ("the", "of", "and", "to", "in", "that", "is", "it", "on", "as")


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.floor(F.col("vec_id") / 50).alias("meeting_id"), (F.col("vec_id") % 50).cast("int").alias("pos"), "embedding")


MEETINGS = "m AS (SELECT vec_id // 50 AS meeting_id, CAST(vec_id % 50 AS INTEGER) AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
DIMS = f"{MEETINGS}, d AS (SELECT meeting_id, pos, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM m)"
GAPS = (
    DIMS
    + """,
lr AS (SELECT meeting_id, pos, i, sum(x) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS l, sum(x) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r FROM d WINDOW w AS (PARTITION BY meeting_id, i ORDER BY pos)),
gaps AS (SELECT meeting_id, pos AS gap, sum(l * r) / (sqrt(sum(l * l)) * sqrt(sum(r * r))) AS score FROM lr WHERE r IS NOT NULL GROUP BY meeting_id, pos),
sm AS (SELECT *, avg(score) OVER (PARTITION BY meeting_id ORDER BY gap ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM gaps)"""
)
DEPTHS = (
    GAPS
    + """,
u AS (SELECT *, coalesce((smooth < lag(smooth) OVER w)::INT, 0) AS dn, coalesce((smooth > lag(smooth) OVER w)::INT, 0) AS up FROM sm WINDOW w AS (PARTITION BY meeting_id ORDER BY gap)),
v AS (SELECT *, sum(dn) OVER w AS gd, sum(up) OVER w AS gu FROM u WINDOW w AS (PARTITION BY meeting_id ORDER BY gap)),
dp AS (SELECT meeting_id, gap, smooth, max(smooth) OVER (PARTITION BY meeting_id, gu ORDER BY gap) - smooth + max(smooth) OVER (PARTITION BY meeting_id, gd ORDER BY gap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - smooth AS depth FROM v)"""
)


@query(f"WITH {GAPS} SELECT meeting_id, gap, round(score, 6) AS score FROM gaps")
def gap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the two turns on either side of every gap are."""
    return sg.gap_scores(meetings(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {GAPS} SELECT meeting_id, gap, round(smooth, 6) AS smooth FROM sm")
def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap scores by a centred moving average."""
    return sg.smoothed(sg.gap_scores(meetings(spark, sf_dir))).select("meeting_id", "gap", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {DEPTHS} SELECT meeting_id, gap, round(depth, 6) AS depth FROM dp")
def depth_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep each gap lies between its peaks."""
    return sg.depths(sg.smoothed(sg.gap_scores(meetings(spark, sf_dir)))).select("meeting_id", "gap", F.round("depth", 6).alias("depth"))


@query(f"WITH {DEPTHS} SELECT meeting_id, gap, depth > avg(depth) OVER w + stddev_pop(depth) OVER w AS is_edge, round(avg(depth) OVER w + stddev_pop(depth) OVER w, 6) AS threshold FROM dp WINDOW w AS (PARTITION BY meeting_id)")
def threshold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps deeper than the meeting's mean by a standard deviation."""
    rows = sg.edges(sg.depths(sg.smoothed(sg.gap_scores(meetings(spark, sf_dir)))))
    return rows.select("meeting_id", "gap", "is_edge", F.round("threshold", 6).alias("threshold"))


@query(
    f"""WITH {DIMS}, t AS (SELECT meeting_id, i, sum(x) AS tx, count(*) AS n FROM d GROUP BY ALL), c AS (SELECT meeting_id, pos + 1 AS cut, i, sum(x) OVER (PARTITION BY meeting_id, i ORDER BY pos) AS px FROM d),
q AS (SELECT meeting_id, sum(x * x) AS sq FROM d GROUP BY 1),
g AS (SELECT c.meeting_id, c.cut, any_value(t.n) AS n, sum(px * px) / c.cut + sum((tx - px) * (tx - px)) / (any_value(t.n) - c.cut) AS kept FROM c JOIN t USING (meeting_id, i) WHERE c.cut BETWEEN 4 AND t.n - 4 GROUP BY c.meeting_id, c.cut)
SELECT meeting_id, arg_max(cut, kept)::INT AS cut, round(any_value(sq) - max(kept), 6) AS loss FROM g JOIN q USING (meeting_id) GROUP BY 1"""
)
def best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split of every meeting: where the scatter inside both parts is least."""
    rows = meetings(spark, sf_dir)
    n = rows.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 8")
    first = sg.tree_splits(rows.join(n.select("meeting_id"), "meeting_id", "left_semi")).filter("split_order = 0")
    size = rows.groupBy("meeting_id").agg(F.sum(norm(F.col("embedding")) * norm(F.col("embedding"))).alias("sq"), F.collect_list("embedding").alias("v"))
    mean = total(F.col("v"))
    whole = F.col("sq") - dot(mean, mean) / F.size("v")
    return first.join(size.select("meeting_id", whole.alias("whole")), "meeting_id").select("meeting_id", "cut", F.round(F.col("whole") - F.col("gain"), 6).alias("loss"))


@query()
def treeseg_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every meeting by its partition tree."""
    return sg.tree_segments(meetings(spark, sf_dir))


@query()
def select_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every meeting by its gaps' depths; every turn counts as 800 characters."""
    rows = meetings(spark, sf_dir)
    deep = sg.depths(sg.smoothed(sg.gap_scores(rows))).select("meeting_id", F.col("gap").alias("pos"), "depth")
    return sg.depth_segments(rows.join(deep, ["meeting_id", "pos"], "left").withColumn("chars", F.lit(800)))


@query(f"WITH {MEETINGS} SELECT meeting_id, pos, round(list_cosine_similarity(e, lag(e) OVER (PARTITION BY meeting_id ORDER BY pos)), 6) AS cosine, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm FROM m")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine with the vector before, and norm, of every vector."""
    before = F.lag("embedding").over(Window.partitionBy("meeting_id").orderBy("pos"))
    rows = meetings(spark, sf_dir).withColumn("b", before)
    near = F.when(F.col("b").isNotNull(), cosine(F.col("embedding"), F.col("b")))
    return rows.select("meeting_id", "pos", F.round(near, 6).alias("cosine"), F.round(norm(F.col("embedding")), 6).alias("norm"))


def _terms_sql(key: str, source: str, name: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
    return f"""{name}0 AS (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS t FROM {source}),
{name}1 AS (SELECT {key}, unnest(list_filter(t, lambda x: NOT list_contains({stop}, x))) AS term, 1.0 AS w FROM {name}0
UNION ALL SELECT {key}, b.a || ' ' || b.b, 2.0 FROM (SELECT {key}, unnest(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS b FROM {name}0) WHERE NOT (list_contains({stop}, b.a) AND list_contains({stop}, b.b))),
{name} AS (SELECT {key}, term, w, count(*) AS tf FROM {name}1 GROUP BY ALL)"""


_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@query(
    f"""WITH {_terms_sql("item_id", "benchmark", "q")}, {_terms_sql("doc_id", "documents", "p")},
ln AS (SELECT doc_id, len(list_filter(t, lambda x: NOT list_contains({_STOPS}, x))) AS len FROM p0), st AS (SELECT count(*) AS n, avg(len) AS mean FROM ln),
ps AS (SELECT * FROM p SEMI JOIN q USING (term)), df AS (SELECT term, count(*) AS df FROM ps GROUP BY 1),
sc AS (SELECT q.item_id, ps.doc_id, sum(q.w * ln(1 + (n - df + 0.5) / (df + 0.5)) * ps.tf * 2.2 / (ps.tf + 1.2 * (0.25 + 0.75 * ln.len / mean))) AS score FROM ps JOIN q USING (term) JOIN df USING (term) JOIN ln USING (doc_id), st GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM sc)
SELECT item_id, doc_id, round(score, 5) AS score, rank::INT AS rank FROM rk WHERE rank <= 5"""
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents that match each benchmark item best."""
    out = search.bm25_topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5, "doc_id", "item_id", "text", STOP)
    return out.withColumn("score", F.round("score", 5))
