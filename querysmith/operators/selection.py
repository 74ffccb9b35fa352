"""From scored terms to queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def _order() -> list:
    return [F.desc("score"), "is_external", "ord", "attr_ord", "keyword", "attr"]


def top_terms(scored: DataFrame, n: int, dedupe_keywords: bool = False) -> DataFrame:
    """The n best candidates of each entity as its query, with `pos` from 1. A keyword may fill several places, once for each
    attribute, unless `dedupe_keywords`."""
    if "is_external" not in scored.columns:
        scored = scored.withColumn("is_external", F.lit(False))
    if dedupe_keywords:
        scored = scored.withColumn("__k", F.row_number().over(Window.partitionBy("id", "keyword").orderBy(*_order()))).filter("__k = 1").drop("__k")
    pos = F.row_number().over(Window.partitionBy("id").orderBy(*_order())).cast("long")
    return scored.withColumn("pos", pos).filter(F.col("pos") <= n)


def probability_mass(scored: DataFrame, n: int, p: float) -> DataFrame:
    """The best candidates until their softmax mass is above p, the one that crosses it included, n at most."""
    if "is_external" not in scored.columns:
        scored = scored.withColumn("is_external", F.lit(False))
    entity = Window.partitionBy("id")
    e = F.exp(F.col("score") - F.max("score").over(entity))
    rows = scored.withColumn("__e", e).withColumn("prob", F.col("__e") / F.sum("__e").over(entity))
    best = entity.orderBy(*_order())
    rows = rows.withColumn("pos", F.row_number().over(best).cast("long")).withColumn("before", F.coalesce(F.round(F.sum("prob").over(best.rowsBetween(Window.unboundedPreceding, -1)), 9), F.lit(0.0)))
    return rows.filter((F.col("before") <= p) & (F.col("pos") <= n)).drop("__e", "before")
