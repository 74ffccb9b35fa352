"""Command line.

    python -m querysmith run --data DIR --out DIR --dataset NAME --iterations N --keys N [options]
    python -m querysmith optimal --data DIR --out DIR [--least 1 --most 3 --top_k 20 --first 0 --last 1000]

DIR holds NAME/source.csv, NAME/target.csv and NAME/ground_truth.csv (for `optimal`: without NAME). A run whose results are
all there already is skipped, a half-written one is run again; fixed series are read from NAME/series.parquet (run_id, pos, local_id).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import parse, save_path
from .operators import optimal
from .plans.dataset import Dataset
from .plans.loop import play
from .sources import tables


def load(spark: SparkSession, path: str, store: str | None = None, stem: bool = True) -> Dataset:
    """The dataset in a directory of CSV files. Ids get a prefix for their side, as the files may number both sides alike."""

    def side(name: str, prefix: str) -> DataFrame:
        df = tables.read_entities(spark, f"{path}/{name}.csv")
        # Of a directory the files count in the order of their names, whichever Spark reads first.
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
        df = tables.upsert_by_id(df.withColumn("__pos", place), df.columns[0], "__pos").drop("first_pos")
        return tables.as_entities(df, df.columns[0], df.columns[1:], prefix)

    pairs = tables.read_pairs(spark, f"{path}/ground_truth.csv")
    truth = pairs.select(F.concat(F.lit("l:"), "local_id").alias("local_id"), F.concat(F.lit("e:"), "external_id").alias("external_id"))
    return Dataset(side("source", "l:"), side("target", "e:"), truth, stem=stem, store=store)


def run(spark: SparkSession, args: list[str]) -> str:
    own = argparse.ArgumentParser(add_help=False)
    own.add_argument("--data", required=True)
    own.add_argument("--out", required=True)
    own.add_argument("--store")
    own.add_argument("--findable_only", action="store_true")
    where, rest = own.parse_known_args(args)
    config = parse(rest)
    out = save_path(where.out, config)
    if tables.complete(spark, out):
        return out
    series = None
    if config.distribution in ("fixed", "uniform_fixed"):
        series = tables.read_series(spark, f"{where.data}/{config.dataset_name}/series.parquet")
    data = load(spark, f"{where.data}/{config.dataset_name}", where.store)
    tables.write_log(play(data, config, series, findable_only=where.findable_only), out, "overwrite")
    return out


def find_optimal(spark: SparkSession, args: list[str]) -> str:
    p = argparse.ArgumentParser()
    for name in ("data", "out"):
        p.add_argument(f"--{name}", required=True)
    for name, default in (("least", 1), ("most", 3), ("top_k", 20), ("first", 0), ("last", 0)):
        p.add_argument(f"--{name}", type=int, default=default)
    o = p.parse_args(args)
    data = load(spark, o.data)
    sample = tables.first_of_sample(data.local.select("id"), o.first, o.last) if o.last else None
    found = optimal.optimal_queries(data.local_signals, data.truth, data.external_signals, data.weighted, o.least, o.most, o.top_k, sample)
    for size, best in found.items():
        best.write.mode("overwrite").parquet(f"{o.out}/length={size}")
    return o.out


def main(args: list[str]) -> int:
    verbs = {"run": run, "optimal": find_optimal}
    if not args or args[0] not in verbs:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("querysmith").getOrCreate()
    print(verbs[args[0]](spark, args[1:]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
