"""Where results go: rows by method and meeting that resume, JSON lines, manifests, scripts' transcripts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.splitting import with_pieces
from parlance.operators.transcripts import synthetic_clock

RESULT = "method string, meeting_id string, cache_key string, status string, error string, output string, finished_at timestamp"


def results(spark: SparkSession, path: str) -> DataFrame:
    """The newest result of each method and meeting; none if there is nothing yet."""
    try:
        rows = spark.read.schema(RESULT).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], RESULT)
    newest = rows.groupBy("method", "meeting_id").agg(F.max_by(F.struct("cache_key", "status", "error", "output", "finished_at"), "finished_at").alias("r"))
    return newest.select("method", "meeting_id", "r.*")


def unfinished(requests: DataFrame, path: str) -> DataFrame:
    """Requests (method, meeting_id, cache_key) without a good result under the same key."""
    done = results(requests.sparkSession, path).filter("status = 'ok'").select("method", "meeting_id", "cache_key")
    return requests.join(done, ["method", "meeting_id", "cache_key"], "left_anti")


def save_results(rows: DataFrame, path: str) -> None:
    """Appends results, failed ones too."""
    rows.withColumn("finished_at", F.current_timestamp()).select(*[c.split(" ")[0] for c in RESULT.split(", ")]).write.mode("append").parquet(path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new``, and those of ``old`` that it doesn't replace."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def manifest(items: DataFrame, turns: DataFrame, gold: dict[str, DataFrame]) -> DataFrame:
    """(meeting_id, n_items, n_turns, total_chars, n_<name> …): the sizes of each meeting and of its gold tables."""
    out = items.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n_items"))
    out = out.join(turns.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text_exact")).alias("total_chars")), "meeting_id", "left")
    for name, rows in gold.items():
        out = out.join(rows.groupBy("meeting_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "meeting_id", "left")
    return out.na.fill(0)


def transcript_of(turns: DataFrame) -> DataFrame:
    """Recogniser-like items of authored turns (source, turn_no, key, text): small pieces with a made-up clock and stable ids."""
    cut = with_pieces(turns.select(F.col("source").alias("meeting_id"), "turn_no", F.col("key").alias("speaker"), F.col("text").alias("whole")), "whole")
    rows = cut.select("meeting_id", "speaker", "turn_no", F.posexplode("pieces").alias("piece", "text"))
    rows = rows.withColumn("pos", F.col("turn_no").cast("bigint") * 10_000 + F.col("piece"))
    name = F.concat_ws("/", "meeting_id", F.col("pos").cast("string"))
    return synthetic_clock(rows.select("meeting_id", "pos", "speaker", "text", "turn_no", F.substring(F.sha2(name, 256), 1, 32).alias("item_id")))


def turns_as_authored(built: DataFrame, authored: DataFrame) -> DataFrame:
    """Meetings whose built turns are not the authored ones: (meeting_id, built, authored); none is as it should be."""
    a = built.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("built"))
    b = authored.groupBy(F.col("source").alias("meeting_id")).agg(F.count(F.lit(1)).alias("authored"))
    return a.join(b, "meeting_id", "full_outer").na.fill(0).filter("built <> authored")


def markdown(rows: DataFrame, title: str, order: Column, most: int = 1000) -> str:
    """A report of a small table: a top-k report of ``most`` rows, which says how many more there are."""
    got = rows.orderBy(order).limit(most + 1).collect()
    rest = f"\n{rows.count() - most} more rows are not shown.\n" if len(got) > most else ""
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in got[:most]) + rest
