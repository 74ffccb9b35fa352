"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file; it is there whole or not at all."""
    hadoop, part = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(hadoop, False)
    if not fs.rename(part, hadoop):
        raise OSError(f"{path} can't be written")


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None if there is none."""
    if not exists(spark, path):
        return None
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: `spark.checkpoint.dir`, or a local one where that is unset and all
    runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        if there.isDefined():
            root = there.get()
        elif spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="querysmith-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/querysmith/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "state") -> DataFrame:
    """`df` written and read again: its lineage is cut and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
