"""Top-k search that reads no more of a posting list than can matter.

A term's postings are in order of their weight and cut into tiers, each with twice the postings of the one before; a tier is dealt out
by a hash of the document into blocks of about `size` postings, so that one document of a tier is looked up in one block. The largest
weight in a tier bounds what a document can get from it.

A search (of all queries at once, in a fixed number of steps)

1. reads the first tiers of all terms and takes each query's k-th best sum as a threshold that results have to reach;
2. reads on, tier by tier over all terms of a query, until a document in none of what was read can't reach the threshold: the largest
   weights that are left add up to less. Rare words so are read to their end first, and of a frequent one mostly the first tiers;
3. drops documents that can't reach the (now better) threshold even with the largest weights of the terms that they weren't seen in,
   and looks the others up in the blocks that they would be in.

Results are those of `search.search`. Ties are by document, so tiers are ordered by weights as they are ranked, then by document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import settled
from .ranking import with_rank_within
from .search import ranked

#: Scores are rounded to six digits, so bounds have to be apart by more than that.
_ROUNDING = 1e-6


@dataclass(frozen=True)
class BlockIndex:
    """blocks: (keyword, tier, sub, n, postings: (id, w)); tiers: (keyword, tier, n, top, next_top)."""

    blocks: DataFrame
    tiers: DataFrame
    size: int


def block_rows(weighted: DataFrame, size: int = 128) -> DataFrame:
    """The blocks of postings (keyword, id, w): (keyword, tier, sub, n, top, postings). Long lists are ordered over many partitions."""
    rows = with_rank_within(weighted.withColumn("__w", -F.round("w", 6)), "keyword", "__w", "id", name="__rank")
    # Tier t has the ranks (from 0) of size * (2^t - 1) up to, without, size * (2^(t+1) - 1).
    tier = (F.length(F.bin(F.floor((F.col("__rank") - 1) / size) + 1)) - 1).alias("tier")
    rows = rows.select("keyword", tier, "id", "w", (-F.col("__w")).alias("top"))
    sub = F.pmod(F.xxhash64("id"), F.expr("shiftleft(1L, tier)")).alias("sub")
    return rows.select("keyword", "tier", sub, "id", "w", "top").groupBy("keyword", "tier", "sub").agg(F.count("*").alias("n"), F.max("top").alias("top"), F.collect_list(F.struct("id", "w")).alias("postings"))


def tier_rows(blocks: DataFrame) -> DataFrame:
    """(keyword, tier, n, top, next_top) of blocks; next_top is 0 after the last tier."""
    tiers = blocks.groupBy("keyword", "tier").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    return tiers.withColumn("next_top", F.coalesce(F.lead("top").over(Window.partitionBy("keyword").orderBy("tier")), F.lit(0.0)))


def build(weighted: DataFrame, size: int = 128) -> BlockIndex:
    """The index of postings (keyword, id, w), w at least 0, written so that a keyword's blocks lie together."""
    blocks = block_rows(weighted, size)
    n = int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = settled(blocks.repartitionByRange(n, "keyword", "tier", "sub").sortWithinPartitions("keyword", "tier", "sub"), "blocks")
    return BlockIndex(blocks, settled(tier_rows(blocks), "tiers"), size)


def _threshold(sums: DataFrame, k: int) -> DataFrame:
    """(intent_id, least): the k-th best sum; queries with fewer documents aren't there."""
    place = F.row_number().over(Window.partitionBy("intent_id").orderBy(F.desc("sum")))
    return sums.withColumn("__place", place).filter(F.col("__place") == k).select("intent_id", F.round("sum", 6).alias("least"))


def _reach(bound: Column, least: Column, alone: Column) -> Column:
    """Whether a sum of at most `bound` may be among the best. A single term's postings are in the order of the results."""
    return least.isNull() | F.when(alone, bound > least).otherwise(bound + _ROUNDING >= least)


def _postings(units: DataFrame, index: BlockIndex) -> DataFrame:
    """(intent_id, keyword, id, w) of tiers (intent_id, keyword, tier)."""
    there = index.blocks.select("keyword", "tier", "postings")
    return units.select("intent_id", "keyword", "tier").join(there, ["keyword", "tier"]).select("intent_id", "keyword", F.inline("postings"))


def search(queries: DataFrame, index: BlockIndex, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """((intent_id, external_id, score, rank), (intent_id, postings_read, postings)) of queries (intent_id, keyword).

    The second table says how many postings a query's terms have and how many of them were in what was read for it.
    """
    first = max(1, (-(-k // index.size)).bit_length())  # tiers with k postings or more
    terms = queries.select("intent_id", "keyword").distinct()
    units = settled(terms.join(index.tiers, "keyword"), "units")
    start = settled(_postings(units.filter(F.col("tier") < first), index), "postings")
    least = _threshold(start.groupBy("intent_id", "id").agg(F.sum("w").alias("sum")), k)

    # What is left of a query before each of its next tiers is read: the largest weights that its terms have beyond.
    query = Window.partitionBy("intent_id")
    order = query.orderBy("tier", "n", "keyword").rowsBetween(Window.unboundedPreceding, -1)
    alone = (F.size(F.collect_set("keyword").over(query)) == 1).alias("alone")
    rest = units.select("*", alone).filter(F.col("tier") >= first)
    left = F.sum(F.when(F.col("tier") == first, F.col("top")).otherwise(0.0)).over(query) - F.coalesce(F.sum(F.col("top") - F.col("next_top")).over(order), F.lit(0.0))
    rest = rest.withColumn("left", left).join(least, "intent_id", "left")
    rest = settled(rest.select("intent_id", "keyword", "tier", "n", "top", "alone", _reach(F.col("left"), F.col("least"), F.col("alone")).alias("read")), "rest")
    rows = settled(start.unionByName(_postings(rest.filter("read"), index)), "postings")

    # Documents with what they have and the most that they can have beyond.
    beyond = rest.filter("not read").groupBy("intent_id", "keyword").agg(F.max("top").alias("most"))
    sums = rows.join(beyond, ["intent_id", "keyword"], "left").groupBy("intent_id", "id").agg(F.sum("w").alias("sum"), F.sum(F.coalesce("most", F.lit(0.0))).alias("seen"), F.collect_set("keyword").alias("words"))
    every = beyond.groupBy("intent_id").agg(F.sum("most").alias("all"))
    sums = settled(sums.join(every, "intent_id", "left").withColumn("missing", F.greatest(F.coalesce("all", F.lit(0.0)) - F.col("seen"), F.lit(0.0))), "sums")
    kept = sums.join(_threshold(sums, k), "intent_id", "left").filter(F.col("least").isNull() | (F.col("sum") + F.col("missing") + _ROUNDING >= F.col("least")))
    kept = settled(kept.select("intent_id", "id", "sum", "words", "missing"), "kept")

    unread = rest.filter("not read").select("intent_id", "keyword", "tier")
    asked = kept.filter("missing > 0").join(unread, "intent_id").filter(~F.array_contains("words", F.col("keyword")))
    asked = asked.select("intent_id", "id", "keyword", "tier", F.pmod(F.xxhash64("id"), F.expr("shiftleft(1L, tier)")).alias("sub"))
    asked = settled(asked.join(index.blocks.select("keyword", "tier", "sub", "n", "postings"), ["keyword", "tier", "sub"]).select("intent_id", "id", "keyword", "tier", "sub", "n", F.filter("postings", lambda p: p["id"] == F.col("id"))["w"].alias("ws")), "asked")
    found = asked.select("intent_id", "id", F.explode("ws").alias("w")).groupBy("intent_id", "id").agg(F.sum("w").alias("more"))
    scored = kept.join(found, ["intent_id", "id"], "left").select("intent_id", F.col("id").alias("external_id"), F.round(F.col("sum") + F.coalesce("more", F.lit(0.0)), 6).alias("score"))

    looked = asked.select("intent_id", "keyword", "tier", "sub", "n").distinct().select("intent_id", "n", F.lit(True).alias("read"))
    counted = units.filter(F.col("tier") < first).select("intent_id", "n", F.lit(True).alias("read")).unionByName(rest.select("intent_id", "n", "read"))
    of = counted.withColumn("there", F.col("n")).unionByName(looked.withColumn("there", F.lit(0).cast("long")))
    read = of.groupBy("intent_id").agg(F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)).alias("postings_read"), F.sum("there").alias("postings"))
    return ranked(scored, k, ["intent_id"]), read
