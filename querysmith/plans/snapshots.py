"""Versions of what a run has learned, in a folder that outlives the driver.

A version is a directory of tables with a file of values, which is written last: without it the version doesn't count. The last two
versions are kept, the one before in case that the batch of the last is played again.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from ..sources.store import exists, read_text, remove, write_text
from .loop import Loop

_VALUES = "values.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions in a folder, in order."""
    if not exists(spark, root):
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    found = [re.fullmatch(r"version=(\d+)", status.getPath().getName()) for status in there]
    return sorted(int(m[1]) for m in found if m and exists(spark, f"{root}/{m[0]}/{_VALUES}"))


def save(loop: Loop, root: str, version: int, keep: int = 2) -> None:
    """Writes a version, from which the loop's tables are read from now on, and removes versions before the last `keep`."""
    path, (values, tables) = f"{root}/version={version}", loop.snapshot()
    remove(loop.spark, path)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    write_text(loop.spark, f"{path}/{_VALUES}", json.dumps({"values": values, "tables": {name: df.schema.json() for name, df in tables.items()}}))
    load(loop, root, version)
    for old in versions(loop.spark, root)[:-keep]:
        remove(loop.spark, f"{root}/version={old}")


def load(loop: Loop, root: str, version: int) -> None:
    """Sets a loop to a version."""
    path = f"{root}/version={version}"
    said = json.loads(read_text(loop.spark, f"{path}/{_VALUES}"))
    schemas = {name: StructType.fromJson(json.loads(schema)) for name, schema in said["tables"].items()}
    loop.restore(said["values"], {name: loop.spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in schemas.items()})
