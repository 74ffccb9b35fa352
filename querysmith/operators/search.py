"""Top-k keyword search: queries joined to the inverted index, scored and ranked, for all queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import settled

#: Parameters of BM25.
K1, B = 1.2, 0.75


def bm25() -> Column:
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def tfidf() -> Column:
    return F.col("tf") * F.log(F.col("n") / F.col("df"))


def overlap_count() -> Column:
    return F.lit(1.0)


SCORERS: dict[str, Callable[[], Column]] = {"bm25": bm25, "tfidf": tfidf, "overlap_count": overlap_count}


def weighted_postings(posts: DataFrame, scorer: str = "bm25", totals: DataFrame | None = None) -> DataFrame:
    """(keyword, id, w): what a term adds to a document's score. Computed once, it makes a search a join and a sum. `totals` are
    (n, avgdl) of all documents, where the postings are those of some terms."""
    df = posts.groupBy("keyword").agg(F.count("*").alias("df"))
    if totals is None:
        totals = posts.groupBy("id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    else:
        df = settled(df, "df")  # few terms: they are sent along, and postings aren't dealt out
    rows = posts.join(df, "keyword").join(F.broadcast(totals))  # one row
    return rows.select("keyword", "id", SCORERS[scorer]().alias("w"))


def contributions(queries: DataFrame, weighted: DataFrame) -> DataFrame:
    """(intent_id, keyword, external_id, w) for every distinct keyword of a query and every document that has it."""
    return queries.select("intent_id", "keyword").distinct().join(weighted.withColumnRenamed("id", "external_id"), "keyword")


def ranked(scored: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The k best documents of each key, best first, ties to the smaller id. Scores are rounded first, so that the order of
    summation can't change a ranking."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "external_id"))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def search(queries: DataFrame, weighted: DataFrame, k: int = 20) -> DataFrame:
    """(intent_id, external_id, score, rank): documents with any of a query's keywords, ranked by the sum of their weights."""
    scored = contributions(queries, weighted).groupBy("intent_id", "external_id").agg(F.round(F.sum("w"), 6).alias("score"))
    return ranked(scored, k, ["intent_id"])
