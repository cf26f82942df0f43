"""Documents to training batches: five stages, each one operator, each written before the next reads it.

Every stage but the last returns the columns of its input and works on all rows that it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontamination, langid, minhash, packing, sanitisation
from parlance.llm.common import materialize, release


def apart(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """The table with columns of these names, in any case, renamed, and the columns that undo it."""
    taken = {n.lower() for n in names}
    other = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c.lower() in taken}
    renamed = docs.select(*[F.col(f"`{c}`").alias(other.get(c, c)) for c in docs.columns])
    return renamed, [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier rejects go: no letters, or nothing like its language.

    Null, empty and wordless texts go; repeated rows share their fate; rows with a null lang or
    doc_id are judged like others; without a row to learn from everything goes.
    """
    rows, back = apart(docs, "lang_pred", "score", "rejected")
    return langid.predict(rows, langid.train(rows)).filter(~F.col("rejected")).select(*back)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest id (null ones last).

    Null and empty texts are one class; of repeated rows one stays.
    """
    return minhash.one_of_each(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. Null and empty texts overlap nothing and stay; copies go together."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced; n_chars is that of the new text. All rows stay; null texts stay null, with n_chars 0."""
    rows, back = apart(docs, "n_email", "n_ip", "n_card", "n_phone", "n_term", "base_sha256", "spans", "clean_text")
    out = sanitisation.sanitise(rows).withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and batches; a document without words is one empty sequence in no batch."""
    return packing.pack(docs)


STAGES = [
    ("language id", known_language),
    ("near duplicates", one_of_each),
    ("decontamination", not_in_benchmark),
    ("personal data", sanitised),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the signatures; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
