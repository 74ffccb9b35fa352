"""What the operators share: the shared folder, written intermediate tables, text helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The word rule of every operator: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a local one of our own where it is unset and all runs
    on this machine. A cluster without the setting is an error: each executor would write to its own disk."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        if there.isDefined():
            root = there.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="querysmith-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is removed when the driver ends."""
    path = f"{shared_folder(spark)}/querysmith/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop_written(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first, or the folder is gone
            continue


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """`df` with the rank from 1 in a global order, without gathering it in one task: range partitions are written once and ranked
    by themselves, their counts (one row a partition) give the offsets."""
    dealt = written(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("__slot", F.spark_partition_id()), "ranked")
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__slot").agg(F.count("*").alias("__n")).select("__slot", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy("__slot").orderBy(*order))
    return dealt.withColumn("__own", inside).join(F.broadcast(offsets), "__slot").withColumn(name, F.col("__own") + F.col("__ahead")).drop("__slot", "__own", "__ahead")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it if a column of `df` is called so (case doesn't tell columns apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
