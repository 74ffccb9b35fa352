"""What matches teach an entity: borrowed terms, external frequencies, sent words. All idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_sent(sent: DataFrame, queries: DataFrame) -> DataFrame:
    """(local_id, keyword, sent): terms of an entity, true once a query had them."""
    now = queries.select(F.col("intent_id").alias("local_id"), "keyword").distinct().withColumn("now", F.lit(True))
    return sent.join(now, ["local_id", "keyword"], "full_outer").select("local_id", "keyword", (F.coalesce("sent", F.lit(False)) | F.coalesce("now", F.lit(False))).alias("sent"))


def exhausted(sent: DataFrame, share: float = 0.7) -> DataFrame:
    """(local_id, sent_share, exhausted): whether at least `share` of an entity's terms were sent."""
    return sent.groupBy("local_id").agg(F.avg(F.col("sent").cast("int")).alias("sent_share")).withColumn("exhausted", F.col("sent_share") >= share)


def new_pairs(matches: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs (local_id, external_id) that weren't matched before."""
    return matches.select("local_id", "external_id").distinct().join(seen, ["local_id", "external_id"], "left_anti")


def borrow(pairs: DataFrame, external_signals: DataFrame, local_signals: DataFrame, mode: str) -> DataFrame:
    """(local_id, keyword, external_id, tf, mode): terms of an entity's matches that it doesn't have itself."""
    terms = external_signals.select(F.col("id").alias("external_id"), "keyword", "tf")
    own = local_signals.select(F.col("id").alias("local_id"), "keyword")
    return pairs.join(terms, "external_id").join(own, ["local_id", "keyword"], "left_anti").select("local_id", "keyword", "external_id", "tf", F.lit(mode).alias("mode"))


def borrow_unsupervised(pairs: DataFrame, sent: DataFrame, external_signals: DataFrame, local_signals: DataFrame, share: float = 0.7) -> DataFrame:
    """Borrows only for entities whose terms are exhausted."""
    done = exhausted(sent, share).filter("exhausted").select("local_id")
    return borrow(pairs.join(done, "local_id", "left_semi"), external_signals, local_signals, "unsupervised")


def merge_borrowed(known: DataFrame, new: DataFrame) -> DataFrame:
    """Adds borrowed terms; a supervised one clears an entity's unsupervised mark for the term."""
    rows = known.unionByName(new)
    return rows.groupBy("local_id", "keyword", "external_id").agg(F.max("tf").alias("tf"), F.min("mode").alias("mode"))  # "supervised" sorts first


def external_tf(pairs: DataFrame, external_signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(local_id, keyword, external_id, tf) and (local_id, external_id, max_tf) of matched pairs."""
    rows = pairs.join(external_signals.select(F.col("id").alias("external_id"), "keyword", "tf"), "external_id").select("local_id", "keyword", "external_id", "tf")
    return rows, rows.groupBy("local_id", "external_id").agg(F.max("tf").alias("max_tf"))
