"""How many sales are open at a time, and when the most money is: a sweep over moments by lazy segment trees.

Starts and ends are summed by (nation, moment) before anything is sorted, so what is swept are moments, not sales. Moments are
dealt out by range, so that one nation may fill many partitions; a task takes its rows batch by batch, and each nation's rows of
a batch are a chunk with two segment trees (counts, cents) over its compressed moments. A change is a range added from its moment
on, what the chunk begins with is one range over all; point values, the prefix maximum and the root give the rows. What a
partition begins with isn't known to its task: sums and maxima of (partition, nation), two rows a partition and one a nation,
are added afterwards by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

#: A client with more than one in so many sales is looked up in a broadcast, of as many rows at most.
HOT = 256

#: Rows without a key, or with one that was looked up already, are dealt out over so many keys.
SPREAD = 4096

#: Stands for the nation of all sales, and for one that isn't known.
ALL, UNKNOWN = -2, -1

_LOW = -(1 << 62)


class RangeAddTree:
    """A lazy range-add, maximum segment tree over n places; updates and queries of many places are done level by level.

    A node keeps what was added to its whole range and isn't pushed down; its maximum includes that, but not its ancestors'.
    """

    def __init__(self, n: int):
        import numpy as np

        self.n, self.leaves = n, 1 << max(n - 1, 0).bit_length()
        self.lazy = np.zeros(2 * self.leaves, np.int64)

    def add(self, low, high, value) -> None:
        """Adds value[i] to the places low[i] up to, without, high[i]."""
        import numpy as np

        low, high = np.asarray(low) + self.leaves, np.asarray(high) + self.leaves
        value = np.broadcast_to(np.asarray(value, np.int64), low.shape)
        while (inside := low < high).any():
            left = inside & (low & 1 == 1)
            np.add.at(self.lazy, low[left], value[left])
            low = low + left
            right = inside & (high & 1 == 1)
            high = high - right
            np.add.at(self.lazy, high[right], value[right])
            low, high = low >> 1, high >> 1

    def query(self):
        """(value of each place, maximum of the places up to each, maximum of all)."""
        import numpy as np

        top = self.lazy.copy()
        top[self.leaves + self.n :] = _LOW
        level = self.leaves >> 1
        while level:
            top[level : 2 * level] += np.maximum(top[2 * level : 4 * level : 2], top[2 * level + 1 : 4 * level : 2])
            level >>= 1
        path, before = self.lazy[1:2], np.array([_LOW])
        level = 1
        while level < self.leaves:
            over, left = np.repeat(path, 2), top[2 * level : 4 * level : 2]
            first = np.repeat(before, 2)
            first[1::2] = np.maximum(first[1::2], path + left)
            path, before, level = over + self.lazy[2 * level : 4 * level], first, 2 * level
        return path[: self.n], np.maximum(before, path)[: self.n], int(top[1])


def seconds(col: str, kind: str, grid: int) -> Column:
    """UTC seconds since 1970, down to a multiple of `grid`; times without a zone are UTC, whatever the session's zone is."""
    c = F.col(col)
    if kind == "timestamp_ntz":
        at = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c))
    else:
        at = F.unix_seconds(c.cast("timestamp"))
    return at - F.pmod(at, F.lit(grid))


def _apart(absent: Column, *of: str) -> Column:
    """0, or where `absent` holds a number from 1 to SPREAD: a second key that deals such rows out and lets them meet nothing."""
    return F.when(absent, 1 + F.pmod(F.xxhash64(*of), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))


def _together(key: str) -> Column:
    """The second key of rows that are joined by `key`: 0, but not as a constant, which Spark would take out of the join's keys."""
    return F.pmod(F.xxhash64(key), F.lit(1))


def _with_nation(sales: DataFrame, clients: DataFrame) -> DataFrame:
    """Sales with `nation`, null if it isn't known."""
    known = clients.select("client_id", "nation_id").filter("client_id is not null").groupBy("client_id").agg(F.min("nation_id").cast("int").alias("nation"))
    counts = sales.filter("client_id is not null").groupBy("client_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    often = counts.join(F.broadcast(total)).filter(F.col("n") * HOT > F.col("total")).select("client_id")  # fewer than HOT rows
    hot = F.broadcast(often).join(known, "client_id", "left").select(F.col("client_id").alias("hot_id"), F.col("nation").alias("hot_nation"))
    rows = sales.join(F.broadcast(hot), F.col("client_id") == F.col("hot_id"), "left")
    rows = rows.withColumn("apart", _apart(F.col("client_id").isNull() | F.col("hot_id").isNotNull(), "sale_id", "start", "cents"))
    rows = rows.join(known.withColumn("apart", _together("client_id")), ["client_id", "apart"], "left")
    return rows.withColumn("nation", F.coalesce("hot_nation", "nation")).drop("hot_id", "hot_nation", "apart")


def intervals(sales: DataFrame, lines: DataFrame, clients: DataFrame, grid: int = 60, days: int = 7) -> DataFrame:
    """(nation, start, end, cents): each sale that is open for a while; end is null for ever."""
    kinds, at = dict(sales.dtypes), dict(lines.dtypes)
    ends = lines.select("sale_id", seconds("shipped_at", at["shipped_at"], grid).alias("at")).filter("sale_id is not null and at is not null")
    ends = ends.groupBy("sale_id").agg((F.min("at") + days * 86400).alias("end"))
    amount = 100 * F.col("total").cast("double") + 0.5
    cents = F.when(F.abs(amount) < float(1 << 62), F.floor(amount)).otherwise(F.lit(0))
    rows = sales.select("sale_id", "client_id", seconds("sold_at", kinds["sold_at"], grid).alias("start"), cents.cast("long").alias("cents")).filter("start is not null")
    rows = _with_nation(rows, clients).withColumn("apart", _apart(F.col("sale_id").isNull(), "client_id", "start", "cents"))
    rows = rows.join(ends.withColumn("apart", _together("sale_id")), ["sale_id", "apart"], "left").filter("end is null or end > start")
    return rows.select(F.coalesce("nation", F.lit(UNKNOWN)).alias("nation"), "start", "end", "cents")


def changes(rows: DataFrame) -> DataFrame:
    """(nation, at, opened, cents): what changes at a moment, of each nation and of all; moments without a change are left out."""
    first = F.struct(F.col("start").alias("at"), F.lit(1).cast("long").alias("opened"), F.col("cents"))
    last = F.struct(F.col("end").alias("at"), F.lit(-1).cast("long").alias("opened"), (-F.col("cents")).alias("cents"))
    both = rows.select("nation", F.explode(F.array(first, last)).alias("e")).select("nation", "e.*").filter("at is not null")
    sums = [F.sum("opened").alias("opened"), F.sum("cents").alias("cents")]
    own = both.select(F.explode(F.array("nation", F.lit(ALL))).alias("nation"), "at", "opened", "cents")
    return own.groupBy("nation", "at").agg(*sums).filter("opened <> 0 or cents <> 0")


_SWEPT = "slot long, nation int, from_s long, to_s long, n long, cents long, high long"


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted changes to rows with values since the partition began; `to_s` is null for the partition's last row of a nation."""
    import numpy as np

    slot, held = TaskContext.get().partitionId(), None
    carried: tuple[int | None, int, int, int] = (None, 0, 0, _LOW)
    for batch in batches:
        if not len(batch):
            continue
        nation, at = batch["nation"].to_numpy(), batch["at"].to_numpy()
        opened, cents = batch["opened"].to_numpy(), batch["cents"].to_numpy()
        new = np.flatnonzero(nation[1:] != nation[:-1]) + 1
        parts = []
        for low, high in zip([0, *new.tolist()], [*new.tolist(), len(nation)], strict=True):
            own, size = int(nation[low]), high - low
            if carried[0] != own:
                carried = (own, 0, 0, _LOW)
            count, money = RangeAddTree(size), RangeAddTree(size)
            places, end = np.arange(size), np.full(size, size)
            for tree, change, base in ((count, opened, carried[1]), (money, cents, carried[2])):
                tree.add([0], [size], [base])
                tree.add(places, end, change[low:high])
            n, highest, top = count.query()
            c = money.query()[0]
            parts.append((n, c, np.maximum(highest, carried[3])))
            carried = (own, int(n[-1]), int(c[-1]), max(carried[3], top))
        n, c, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        out = pd.DataFrame({"slot": slot, "nation": nation, "from_s": at, "to_s": pd.array([None] * len(at), "Int64"), "n": n, "cents": c, "high": high})
        out = out if held is None else pd.concat([held, out], ignore_index=True)
        follows = out["nation"].shift(-1) == out["nation"]
        out["to_s"] = out["from_s"].astype("Int64").shift(-1).where(follows)
        held = out.iloc[-1:]
        yield out.iloc[:-1]
    if held is not None:
        yield held


def peaks(moments: DataFrame) -> DataFrame:
    """Rows of `changes` to (nation_id, from_s, to_s, n_open, open_cents, high_open, is_peak)."""
    dealt = moments.repartitionByRange(shuffle_partitions(moments.sparkSession), "nation", "at").sortWithinPartitions("nation", "at")
    rows = written(dealt.select(F.col("nation").cast("int").alias("nation"), "at", "opened", "cents").mapInPandas(_sweep, _SWEPT), "swept")
    pieces = rows.groupBy("slot", "nation").agg(F.min("from_s").alias("first"), F.max_by("n", "from_s").alias("n"), F.max_by("cents", "from_s").alias("c"), F.max("high").alias("high"), F.max("cents").alias("top"))
    order = Window.partitionBy("nation").orderBy("slot")  # a row for each partition that the nation is in
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("n", "c")]
    pieces = pieces.select("slot", "nation", "high", "top", F.lead("first").over(order).alias("following"), *sums)
    highest = F.max(F.col("high") + F.col("n_before")).over(before).alias("high_before")
    peak = F.max(F.col("top") + F.col("c_before")).over(Window.partitionBy("nation")).alias("peak")
    pieces = pieces.select("slot", "nation", "following", "n_before", "c_before", highest, peak)
    out = rows.join(pieces.hint("shuffle_hash"), ["slot", "nation"])  # no broadcast: pieces are a row a nation at least
    return out.select(
        F.col("nation").alias("nation_id"), "from_s", F.coalesce("to_s", "following").alias("to_s"), (F.col("n") + F.col("n_before")).alias("n_open"),
        (F.col("cents") + F.col("c_before")).alias("open_cents"), F.greatest(F.col("high") + F.col("n_before"), "high_before").alias("high_open"),
        (F.col("cents") + F.col("c_before") == F.col("peak")).alias("is_peak"),
    )


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame, grid: int = 60, days: int = 7) -> DataFrame:
    """A row for each nation and moment at which the number or the cents of its open sales change.

    Columns: nation_id, from_s, to_s, n_open, open_cents, high_open, is_peak. A sale is open from sold_at until `days` after its first
    shipped_at; its nation is its client's (-1 if that isn't known), and every sale counts for nation -2 too.

    Nulls: sales without sold_at take no part; a null sale_id has no lines and a null client_id no client; a null total, one that isn't
    finite or too large for a long counts 0. Of a client that repeats the smallest nation holds; repeated sales count each. Changes
    that cancel out give no row. Empty tables give no rows (without lines all sales stay open). Other columns are ignored.
    """
    return peaks(changes(intervals(sales, lines, clients, grid, days)))
