"""Ground truth, matches, rewards and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import with_rank


def symmetric(truth: DataFrame) -> DataFrame:
    """Pairs in both directions, once each: an equality join on both ids then is the symmetric test."""
    return truth.select("local_id", "external_id").union(truth.select(F.col("external_id").alias("local_id"), F.col("local_id").alias("external_id"))).distinct()


def is_match(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs (a, b) with `matched`: whether (a, b) or (b, a) is true."""
    known = symmetric(truth).select(F.col("local_id").alias("a"), F.col("external_id").alias("b"), F.lit(True).alias("matched"))
    return pairs.join(known, ["a", "b"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def matches(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results that are true, with rr, the reciprocal of their rank."""
    known = symmetric(truth).select(F.col("local_id").alias("intent_id"), "external_id")
    return results.join(known, ["intent_id", "external_id"], "left_semi").withColumn("rr", 1 / F.col("rank"))


def total_true(ids: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, n_true): pairs with the id on the local side, else on the external side, else 0; repeated pairs count again."""
    left = truth.groupBy(F.col("local_id").alias("id")).agg(F.count("*").alias("l"))
    right = truth.groupBy(F.col("external_id").alias("id")).agg(F.count("*").alias("r"))
    return ids.select("id").join(left, "id", "left").join(right, "id", "left").select("id", F.coalesce("l", "r", F.lit(0)).cast("long").alias("n_true"))


def real_matches(truth: DataFrame, local_id: str) -> DataFrame:
    return truth.filter(F.col("local_id") == F.lit(local_id)).select("external_id")


def side_ids(truth: DataFrame, side: str = "local_id") -> DataFrame:
    return truth.select(F.col(side).alias("id")).distinct()


def indexed_truth(truth: DataFrame, external_index: DataFrame) -> DataFrame:
    """Pairs whose external entity is in the index."""
    return truth.join(external_index.select(F.col("id").alias("external_id")), "external_id", "left_semi").select("local_id", "external_id")


def findable(entities: DataFrame, truth: DataFrame) -> DataFrame:
    return entities.join(side_ids(truth), "id", "left_semi")


def unfindable(entities: DataFrame, truth: DataFrame) -> DataFrame:
    return entities.join(side_ids(truth), "id", "left_anti")


def in_series(entities: DataFrame, series: DataFrame) -> DataFrame:
    """Entities that a fixed series of intents uses."""
    return entities.join(series.select(F.col("local_id").alias("id")), "id", "left_semi")


def reciprocal_rank(intents: DataFrame, results: DataFrame, truth: DataFrame) -> DataFrame:
    """(intent_id, n_returned, n_matches, rr) for every intent; rr is 0 without a match."""
    returned = results.groupBy("intent_id").agg(F.count("*").alias("n_returned"))
    matched = matches(results, truth).groupBy("intent_id").agg(F.count("*").alias("n_matches"), F.max("rr").alias("rr"))
    rows = intents.select("intent_id").join(returned, "intent_id", "left").join(matched, "intent_id", "left")
    return rows.select("intent_id", F.coalesce("n_returned", F.lit(0)).alias("n_returned"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("rr", F.lit(0.0)).alias("rr"))


def metrics(intents: DataFrame, results: DataFrame, truth: DataFrame) -> DataFrame:
    """reciprocal_rank with precision (of what was returned) and recall (of all pairs)."""
    rr = reciprocal_rank(intents, results, truth)
    true = total_true(intents.select(F.col("intent_id").alias("id")), truth).withColumnRenamed("id", "intent_id")
    return rr.join(true, "intent_id").select("*", (F.col("n_matches") / F.greatest("n_returned", F.lit(1))).alias("precision"), (F.col("n_matches") / F.greatest("n_true", F.lit(1))).alias("recall"))


def summary(measured: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: mean reciprocal rank, precision, recall and query length."""
    sizes = queries.groupBy("intent_id").agg(F.count("*").alias("terms"))
    return measured.join(sizes, "intent_id", "left").agg(F.avg("rr").alias("mrr"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg(F.coalesce("terms", F.lit(0))).alias("query_length"))


def rewards(queries: DataFrame, results: DataFrame, truth: DataFrame, external_signals: DataFrame) -> DataFrame:
    """(intent_id, pos, keyword, attr, y): for each query term the mean over matches of rr if the match has the term, else 0."""
    found = matches(results, truth).select("intent_id", "external_id", "rr", F.count("*").over(Window.partitionBy("intent_id")).alias("n_matches"))
    has = external_signals.select(F.col("id").alias("external_id"), "keyword")
    hit = queries.select("intent_id", "keyword").distinct().join(found, "intent_id").join(has, ["external_id", "keyword"])
    hit = hit.groupBy("intent_id", "keyword").agg((F.sum("rr") / F.max("n_matches")).alias("y"))
    return queries.join(hit, ["intent_id", "keyword"], "left").select("intent_id", "pos", "keyword", "attr", F.coalesce("y", F.lit(0.0)).alias("y"))


def running_mean(log: DataFrame, value: str = "rr", order: str = "interaction", by: list[str] | None = None, every: int = 1) -> DataFrame:
    """The mean to date of a log, at every so many interactions. Runs (`by`) are independent, each one ordered series; without
    them the whole log is one, whose sums run over range partitions."""
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = log.withColumn(f"running_{value}", F.avg(value).over(w))
    else:
        out = with_rank(log, order, name="__at", value=F.col(value), total="__upto").withColumn(f"running_{value}", F.col("__upto") / F.col("__at")).drop("__at", "__upto")
    return out.filter(F.col(order) % every == 0) if every > 1 else out


def count_windows(log: DataFrame, size: int = 50, by: list[str] | None = None) -> DataFrame:
    """(window, mrr, last_mrr): means of whole tumbling windows of `size` interactions (from 1), with the window before."""
    keys = by or []
    full = log.groupBy(*keys, F.floor((F.col("interaction") - 1) / size).alias("window")).agg(F.avg("rr").alias("mrr"), F.count("*").alias("n")).filter(F.col("n") == size).drop("n")
    return full.withColumn("last_mrr", F.lag("mrr").over(Window.partitionBy(*keys).orderBy("window")))


def last_rr(log: DataFrame, size: int = 50, by: list[str] | None = None) -> DataFrame:
    """(local_id, last_rr): each entity's latest reciprocal rank, from the interaction on that closes the first window."""
    return log.filter(F.col("interaction") >= size).groupBy(*(by or []), "local_id").agg(F.max_by("rr", "interaction").alias("last_rr"))


def hybrid_trigger(log: DataFrame, size: int = 50, threshold: float = 1 / 15, by: list[str] | None = None) -> DataFrame:
    """(local_id, last_rr) of entities that get a model of their own now: their last try was poor, and the last whole window was
    no better than the one before it. `by` names the runs of a log of several."""
    keys = by or []
    latest = count_windows(log, size, keys).groupBy(*keys).agg(F.max_by(F.struct("mrr", "last_mrr"), "window").alias("w"))
    tried = last_rr(log, size, keys)
    rows = tried.join(F.broadcast(latest), keys) if keys else tried.join(F.broadcast(latest))  # one row a run
    return rows.filter((F.col("last_rr") <= threshold) & (F.col("w.last_mrr") >= F.col("w.mrr"))).select(*keys, "local_id", "last_rr")
