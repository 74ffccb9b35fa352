"""Global ranks and prefix sums without gathering a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import settled


def with_rank(df: DataFrame, *order: str, name: str = "rn", value: Column | None = None, total: str | None = None) -> DataFrame:
    """Adds the rank from 1 in a global order, and with `value` its running sum as `total`.

    Range partitions are ranked by themselves; their counts and sums, one row a partition, give each its offset. They are
    written once, so that both passes see the same ones, on lost executors too.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.withColumn("__v", (value if value is not None else F.lit(0.0)).cast("double")).repartitionByRange(n, *order).withColumn("__slot", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("__slot").agg(F.count("*").alias("c"), F.sum("__v").alias("s"))
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__slot", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__c"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("__s"))
    inside = Window.partitionBy("__slot").orderBy(*order)
    out = dealt.withColumn("__r", F.row_number().over(inside)).withColumn("__t", F.sum("__v").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(offsets, "__slot")
    out = out.withColumn(name, (F.col("__c") + F.col("__r")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("__s") + F.col("__t"))
    return out.drop("__v", "__slot", "__r", "__t", "__c", "__s")


def with_rank_within(df: DataFrame, by: str, *order: str, name: str = "rn") -> DataFrame:
    """Adds the rank from 1 within each group of `by`. Groups are range-partitioned by their order too, so a large one is in many tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(n, by, *order).withColumn("__slot", F.spark_partition_id()), "ranked")
    before = Window.partitionBy(by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__slot", by).agg(F.count("*").alias("__c"))  # a row a group and partition that it is in
    offsets = sizes.select("__slot", by, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__slot", by).orderBy(*order))
    out = dealt.withColumn("__r", own).join(offsets, ["__slot", by]).withColumn(name, (F.col("__before") + F.col("__r")).cast("long"))
    return out.drop("__slot", "__r", "__before")
