"""BM25 over tokens and weighted bigrams, as joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import bigrams, without, word_tokens

# --- fixed values -----------------------------------------------------------------------------
K1, B, BIGRAM_WEIGHT = 1.2, 0.75, 2.0
# -----------------------------------------------------------------------------------------------
FEW = 200_000  # terms that are broadcast, after a count


def terms(rows: DataFrame, key: str, text: str, stopwords: Iterable[str], wanted: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, weight) of every row: tokens that are no stopwords, and bigrams that are not all stopwords.

    Only the terms of ``wanted`` are counted, if it is given: others go before anything is grouped.    """
    stop = list(stopwords)
    tokens = rows.select(F.col(key), word_tokens(F.col(text)).alias("t"))
    known = F.array(*[F.lit(s) for s in stop]) if stop else F.array().cast("array<string>")
    pairs = F.filter(bigrams(F.col("t")), lambda p: ~F.forall(F.split(p, " "), lambda x: F.array_contains(known, x)))
    weighed = F.concat(F.transform(without(F.col("t"), stop) if stop else F.col("t"), lambda x: F.struct(x.alias("term"), F.lit(1.0).alias("weight"))), F.transform(pairs, lambda x: F.struct(x.alias("term"), F.lit(BIGRAM_WEIGHT).alias("weight"))))
    flat = tokens.select(key, F.explode(weighed).alias("x")).select(key, "x.term", "x.weight")
    if wanted is not None:
        flat = flat.join(wanted, "term", "left_semi")
    return flat.groupBy(key, "term", "weight").agg(F.count(F.lit(1)).alias("tf"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, doc_key: str, query_key: str, text: str, stopwords: Iterable[str] = ()) -> DataFrame:
    """(query, doc, score, rank) of the ``k`` best documents of each query with a score above 0; ties to the smaller key.

    Only terms that some query has are counted per document, so postings stay small; lengths are in
    tokens that are no stopwords. Scores are ranked at eight digits, so that equal texts tie.
    """
    stop = list(stopwords)
    asked = terms(queries, query_key, text, stop).select(query_key, "term", "weight")
    wanted = asked.select("term").distinct()
    if wanted.limit(FEW + 1).count() <= FEW:  # then the documents' terms need no shuffle to be compared
        wanted = F.broadcast(wanted)
    postings = terms(docs, doc_key, text, stop, wanted)
    kept = word_tokens(F.col(text))
    lengths = docs.select(doc_key, F.size(without(kept, stop) if stop else kept).alias("len"))
    n, mean = lengths.agg(F.count(F.lit(1))).scalar(), lengths.agg(F.avg("len")).scalar()
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    hits = postings.drop("weight").join(asked, "term").join(df, "term").join(lengths, doc_key)
    scored = hits.groupBy(query_key, doc_key).agg(F.sum(part).alias("score")).filter("score > 0")
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 8)), doc_key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_first_then_in_order(found: DataFrame, query_key: str, order: str) -> DataFrame:
    """The found rows of each query again in their own order, with their place."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(query_key).orderBy(order)))
