"""Entity tables, pair tables, caches of derived structures and run logs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import row_string
from ..operators.ranking import with_rank
from .store import exists, read_text, write_text


def read_entities(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A CSV entity table, all strings: comma, double quotes, Latin-1, line feeds and very long fields in quotes."""
    return spark.read.option("header", header).option("encoding", "ISO-8859-1").option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).csv(path)


def as_entities(df: DataFrame, id_col: str, attrs: list[str], prefix: str = "") -> DataFrame:
    """Any table as an entity table: a string id first, then string attributes. A prefix keeps the ids of two tables apart."""
    return df.select(F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("id"), *[F.col(a).cast("string").alias(a) for a in attrs])


def upsert_by_id(df: DataFrame, id_col: str, pos_col: str) -> DataFrame:
    """One row an id: the last by `pos_col`, with `first_pos`, where the id came first."""
    rest = [c for c in df.columns if c not in (id_col, pos_col)]
    last = df.groupBy(id_col).agg(F.max_by(F.struct(*rest), pos_col).alias("__row"), F.min(pos_col).alias("first_pos"))
    return last.select(id_col, "__row.*", "first_pos")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A CSV pair table: local id first, external id second; pairs that repeat stay."""
    df = read_entities(spark, path)
    return df.select(F.col(df.columns[0]).alias("local_id"), F.col(df.columns[1]).alias("external_id"))


def lookup(df: DataFrame, key: str, as_string: bool = False) -> DataFrame:
    """The row of an id, as it is or as one string."""
    found = df.filter(F.col(df.columns[0]) == F.lit(key))
    return found.select(row_string(found).alias("row")) if as_string else found


def row_strings(df: DataFrame) -> DataFrame:
    return df.select(F.col(df.columns[0]).alias("id"), row_string(df).alias("row"))


def header(df: DataFrame) -> list[str]:
    return df.columns


def fingerprint(df: DataFrame) -> str:
    """What a table holds, whatever the order of its rows: its schema, their number, two sums of their hashes. One pass, no shuffle."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    other = F.xxhash64(F.lit("other"), row)
    sums = df.agg(F.count("*"), *[F.sum(h.cast("decimal(38,0)")) for h in (row, other)]).first()
    return hashlib.sha256(json.dumps([df.schema.jsonValue(), *map(str, sums)]).encode()).hexdigest()


def cached_table(spark: SparkSession, path: str, make: Callable[[], DataFrame], bucket_by: str | None = None, buckets: int = 0, manifest: dict | None = None) -> DataFrame:
    """The table at `path`, made and written first if it isn't complete yet. A half-written one is written anew.

    manifest: what the table is made of (fingerprints, settings). It becomes part of the path, so that tables of other contents have
    places of their own, and lies beside the data; a table whose manifest isn't the one that is asked for is written anew.
    """
    said = json.dumps(manifest, sort_keys=True) if manifest is not None else None
    if said is not None:
        path = f"{path}-{hashlib.sha256(said.encode()).hexdigest()[:16]}"
    if not complete(spark, path) or (said is not None and read_text(spark, f"{path}/_manifest.json") != said):
        df = make()
        if bucket_by:
            df = df.repartition(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), bucket_by).sortWithinPartitions(bucket_by)
        df.write.mode("overwrite").parquet(path)
        if said is not None:
            write_text(spark, f"{path}/_manifest.json", said)
    return spark.read.parquet(path)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Writes interaction logs, one directory a run."""
    log.write.mode(mode).partitionBy("run_id").parquet(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """A fixed series of intents: run_id, pos, local_id."""
    return spark.read.parquet(path).select("run_id", "pos", "local_id")


def first_of_sample(sample: DataFrame, start: int, end: int, order: str = "id") -> DataFrame:
    """Rows `start` (from 0) up to, without, `end` of a sample in order."""
    ranked = with_rank(sample, order, name="__rn").withColumn("__rn", F.col("__rn") - 1)
    return ranked.filter((F.col("__rn") >= start) & (F.col("__rn") < end)).drop("__rn")
