"""Intent draws, epsilon-greedy selection and samples, all from explicit seeds.

A draw is a hash of the seed and of what is drawn for, so it depends on neither partitions nor engine, and reruns agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import settled
from .ranking import with_rank


def unit(seed: int, *of: Column) -> Column:
    """A number in [0, 1) for the seed and `of`: the first 52 bits of an MD5."""
    key = F.concat_ws("/", F.lit(str(seed)), *[c.cast("string") for c in of])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def interactions(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(interaction, u): numbered draws from [0, 1)."""
    return spark.range(1, n + 1).select(F.col("id").alias("interaction"), unit(seed, F.col("id")).alias("u"))


def uniform_draws(entities: DataFrame, n: int, seed: int) -> DataFrame:
    """(interaction, local_id): uniform, with replacement."""
    dense = with_rank(entities.select("id"), "id")
    size = dense.agg(F.count("*").alias("size"))
    draws = interactions(entities.sparkSession, n, seed).join(F.broadcast(size)).withColumn("rn", F.floor(F.col("u") * F.col("size")).cast("long") + 1)
    return draws.join(dense, "rn").select("interaction", F.col("id").alias("local_id"))


def zipf_weights(order: DataFrame) -> DataFrame:
    """(id, rn, weight, upto) from (id, place): 1 / rank over the harmonic number of all, and its running sum."""
    ranked = with_rank(order.select("id", "place"), "place", "id").select("id", "rn")
    harmonic = ranked.agg(F.sum(1 / F.col("rn")).alias("h"))
    rows = ranked.join(F.broadcast(harmonic)).select("id", "rn", (1 / F.col("rn") / F.col("h")).alias("weight"))
    return with_rank(rows, "rn", name="__again", value=F.col("weight"), total="upto").drop("__again")


def permutation(entities: DataFrame, seed: int) -> DataFrame:
    """(id, place): a random order that depends on the seed and the ids alone."""
    return entities.select("id", unit(seed, F.col("id")).alias("place"))


def zipf_draws(weights: DataFrame, n: int, seed: int) -> DataFrame:
    """(interaction, local_id): the first entity whose running weight reaches the draw; the last one if rounding leaves a gap.

    Draws and running weights are range-partitioned together and merged in each partition, so a task has its part of the draws and
    entities, however the weights are spread: the entity of a draw is the next running weight in order, or the first of the partitions
    behind.
    """
    bounds = weights.select(F.col("upto").alias("v"), F.lit(1).alias("kind"), "rn", "id", F.lit(None).cast("long").alias("interaction"))
    draws = interactions(weights.sparkSession, n, seed).select(F.col("u").alias("v"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("rn"), F.lit(None).cast(weights.schema["id"].dataType).alias("id"), "interaction")
    parts = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(bounds.unionByName(draws).repartitionByRange(parts, "v", "kind", "rn").withColumn("slot", F.spark_partition_id()), "merged")
    # Backwards, so that the next in order is the last that was seen.
    back = Window.partitionBy("slot").orderBy(F.desc("v"), F.desc("kind"), F.desc("rn")).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("own", F.last(F.when(F.col("kind") == 1, F.col("id")), ignorenulls=True).over(back)).filter("kind = 0")
    firsts = dealt.groupBy("slot").agg(F.min_by("id", F.when(F.col("kind") == 1, F.struct("v", "rn"))).alias("first"))
    behind = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    firsts = firsts.select("slot", F.last("first", ignorenulls=True).over(behind).alias("behind"))
    last = weights.agg(F.max_by("id", "rn").alias("last"))  # one row
    rows = found.join(F.broadcast(firsts), "slot").join(F.broadcast(last))
    return rows.select("interaction", F.coalesce("own", "behind", "last").alias("local_id"))


def series_draws(series: DataFrame, run_id: int) -> DataFrame:
    """A fixed series in order, as interactions."""
    return series.filter(F.col("run_id") == run_id).select(F.col("pos").alias("interaction"), "local_id")


def epsilon_greedy(scored: DataFrame, n: int, epsilon: float, seed: int, key: str = "id") -> DataFrame:
    """Up to n rows a key in the order of choice (`pos` from 1): each choice is the best left, or with probability epsilon any.

    Rows need `score` and `ord`; keyword and attr, if there, tell rows apart. With epsilon 0 it is the plain top n. Any of those
    left is the first of them in a random order, which is the same for all choices of a key.
    """
    if epsilon == 0:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "ord"))
        return scored.withColumn("pos", rank.cast("long")).filter(F.col("pos") <= n)
    name = [F.col(c) for c in (key, "ord", "keyword", "attr") if c in scored.columns]
    coins = F.array(*[unit(seed, F.lit("coin"), F.col(key), F.lit(i)) < epsilon for i in range(1, n + 1)])

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        best = rows.sort_values(["score", "ord", "__u"], ascending=[False, True, True], kind="stable").index.tolist()
        some = rows.sort_values(["__u", "ord"], kind="stable").index.tolist()
        taken: list = []
        for lucky in rows["__coins"].iloc[0][: len(rows)]:
            taken.append(next(i for i in (some if lucky else best) if i not in taken))
        return rows.loc[taken].drop(columns=["__u", "__coins"]).assign(pos=range(1, len(taken) + 1))

    fields = ", ".join(f"`{c}` {t}" for c, t in scored.dtypes) + ", pos long"
    return scored.withColumn("__u", unit(seed, F.lit("any"), *name)).withColumn("__coins", coins).groupBy(key).applyInPandas(choose, fields)


def replay_sample(buffer: DataFrame, n: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """n rows of a buffer, uniform and without replacement; `by` are the columns that tell rows apart (all by default)."""
    names = [F.col(c) for c in by] if by else [F.to_json(F.struct(*buffer.columns))]
    return buffer.withColumn("__u", unit(seed, *names)).orderBy("__u").limit(n).drop("__u")
