"""Equi-depth buckets and one-hot membership."""

from __future__ import annotations

from math import ceil, floor, isfinite, log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import with_rank

Buckets = list[tuple[float, float]]


def quantile_edges(values: DataFrame, col: str, size: int) -> list[float]:
    """Exact quantile edges (linear interpolation), repeats dropped; size + 1 numbers at most reach the driver.

    Values are counted before they are ranked, and ranks are running sums over range partitions, so no task holds all values.
    """
    counted = values.select(F.col(col).cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    ranks = with_rank(counted, "v", value=F.col("n"), total="upto").select("v", "upto").persist()
    n = ranks.agg(F.max("upto")).first()[0]
    edges = set()
    if n:
        places = [(n - 1) * i / size for i in range(size + 1)]
        at = sorted({f(p) for p in places for f in (floor, ceil)})
        found = ranks.agg(*[F.min(F.when(F.col("upto") > p, F.col("v"))).alias(f"p{p}") for p in at]).first()
        for p in places:
            low, high = floor(p), ceil(p)
            edges.add(found[f"p{low}"] if low == high else (high - p) * found[f"p{low}"] + (p - low) * found[f"p{high}"])
    ranks.unpersist()
    return sorted(edges)


def _rounded(x: float, precision: int) -> float:
    """Decimals for the part behind the point; for numbers below one, significant digits."""
    if not isfinite(x) or x == 0:
        return x
    whole = int(x)
    digits = precision if whole else -int(floor(log10(abs(x)))) - 1 + precision
    return round(x, digits)


def labels(edges: list[float], precision: int = 3) -> Buckets:
    """(low, high] intervals between edges as they are labelled: rounded, at the first precision that keeps edges apart, the
    lowest moved down by one unit so that the least value is inside."""
    if len(edges) < 2:
        return []
    for p in range(precision, 20):
        names = [_rounded(e, p) for e in edges]
        if len(set(names)) == len(names):
            break
    names[0] = _rounded(names[0] - 10.0**-p, p)
    return list(zip(names, names[1:], strict=False))


def find_buckets(values: DataFrame, col: str, size: int) -> Buckets:
    return labels(quantile_edges(values, col, size))


def one_hot(value: Column, buckets: Buckets) -> list[Column]:
    """For each bucket 1 if low < value <= high, else 0; a value outside of all gets zeros."""
    return [F.when((value > lo) & (value <= hi), 1.0).otherwise(0.0) for lo, hi in buckets]


def bucket_of(value: Column, buckets: Buckets) -> Column:
    """The bucket's number from 0, or null."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(buckets):
        out = F.when((value > lo) & (value <= hi), F.lit(i)).otherwise(out)
    return out


def counts(values: DataFrame, col: str, buckets: Buckets) -> DataFrame:
    """(bucket, n): occupancy; values outside of all buckets are left out."""
    return values.select(bucket_of(F.col(col), buckets).alias("bucket")).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))
