"""Mixing sources to target weights by entropy balancing.

Document rates r maximise entropy relative to the corpus (sum of size * (r log r - r + 1) is least) under one
constraint a source: its tokens, at these rates, are its target. The convex dual has one multiplier a source and the
solution is the exponential tilt r = exp(lambda) (target over size, as there is no other constraint). Newton's method on the dual needs, per iteration, each source's tokens
at the current rates (gradient) and the same sum as its curvature: a distributed aggregation over the documents, which
are pre-aggregated to a histogram (source, size), so that no hot source costs more than its distinct sizes.

Rates are then rounded into copies. Whole parts go to every document; the rest is given out from large documents to small
ones, each size taking what is still missing, so that a source ends within about its smallest document of its target.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, ranked, written

#: Sub-groups of documents of one source and size, so that copies of one text are ranked in many tasks.
SALTS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code-point order, null last, weigh `weights` in turn and share all tokens; a target stops at `most` times its
    source's size and the excess is shared again by weight until none is above. Each sharing is a sum over the sources; only
    the level reaches the driver, so there may be any number of them. Sources of size 0 get 0.
    """
    ordered = sources.withColumn("__null", F.col("source").isNull()).withColumn("__bytes", F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    rows = ranked(ordered, "__null", "__bytes").withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = written(rows.select("source", "source_size", "w", "cap"), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") < F.lit(level) * F.col("w")
        now = rows.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(above, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if now["n"] == capped or not now["w"]:
            break
        # The level only rises, so a source that is above its cap stays there, and each round but the last caps one more.
        capped, level = now["n"], (total - now["cap"]) / now["w"]
    return rows.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def balance(cells: DataFrame, goals: DataFrame, most: float = 3.0, rounds: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """(key, rate) by Newton's method on the dual; cells: (key, size, n), goals: (key, source_size, target).

    Each round is one distributed aggregation: tokens at the current rates by source, joined to the targets, and a Newton
    step on the multipliers. Only the largest relative residual comes back to the driver. A source whose target is 0 has rate 0.
    """
    state = written(goals.select("key", "target", F.lit(0.0).alias("lam")), "multipliers")
    for _ in range(rounds):
        at = cells.join(state, "key").groupBy("key").agg(F.first("target").alias("target"), F.first("lam").alias("lam"), F.sum(F.col("size") * F.col("n") * F.exp("lam")).alias("mass"))
        residual = (F.col("mass") - F.col("target")) / F.greatest("target", F.lit(1e-300))
        # Gradient and curvature of the dual are mass - target and mass; a step is held to one power of e.
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - F.col("mass")) / F.greatest("mass", F.lit(1e-300))))
        moved = F.when(F.col("target") > 0, F.col("lam") + step).otherwise(F.col("lam"))
        state = written(at.select("key", "target", moved.alias("lam"), F.when(F.col("target") > 0, F.abs(residual)).otherwise(0.0).alias("off")), "multipliers")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError(f"rates have not settled after {rounds} rounds: off by {worst}")
    return state.select("key", "target", F.when(F.col("target") > 0, F.least(F.exp("lam"), F.lit(float(most)))).otherwise(0.0).alias("rate"))


def _give_out(cells: pd.DataFrame) -> pd.DataFrame:
    """One source's cells (size, n, rate): how many documents of each size get one copy more, from the largest size down.

    Its rows are the distinct sizes of one source, which the longest text bounds, not the number of documents.
    """
    cells = cells.sort_values("size", ascending=False)
    more, missing = [], 0.0
    for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
        base = int(rate + 1e-9)
        missing += (rate - base) * size * n
        extra = min(n, max(0, int(missing / size + 0.5))) if size and rate - base > 1e-9 else 0
        missing -= extra * size
        more.append(extra)
    return cells.assign(base=[int(r + 1e-9) for r in cells["rate"]], more=more)[["key", "size", "base", "more"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, keep: list[str] | None = None, out: str = "mix") -> DataFrame:
    """The columns `keep` of `docs` (by default `id_col`) with `out`: a struct of source, size, source_size, target, rate, copies, taken.

    size: words of the text (null text: 0, which are never needed and get no copies beyond the whole part of their source's
    rate). Null sources form a source, ordered last. Null ids are documents too, dealt out by their texts. Ties in size are broken by a hash of the id,
    then the id, then a hash of the text; rows that repeat in all three are alike, so it doesn't matter which of them gets a
    copy more, and reruns give the same rows. An empty table gives no rows. A column named as `out` is replaced.
    """
    kept = [c for c in keep or [id_col] if c.lower() != out.lower()]
    name, dealt = F.struct(F.col(f"`{source_col}`").isNull().alias("null"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("name")), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text "), F.xxhash64(F.col(f"`{text_col}`")).cast("string")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{source_col}`").cast("string").alias("source"), name.alias("key"), word_count(F.col(f"`{text_col}`")).alias("size"),
        F.xxhash64(F.lit("mix"), dealt).alias("h"), F.col(f"`{id_col}`").cast("string").alias("tie"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie2"),
    ).withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))
    if text_col not in kept:
        rows = written(rows, "sizes")  # texts are read once; with texts among the kept columns, counting again is less than writing them
    fine = written(rows.groupBy("key", "source", "size", "salt").agg(F.count("*").alias("n")), "histogram")
    goals = targets(fine.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    goals = goals.withColumn("key", F.struct(F.col("source").isNull().alias("null"), F.coalesce("source", F.lit("")).alias("name")))
    goals = written(goals, "targets")
    cells = fine.groupBy("key", "size").agg(F.sum("n").alias("n"))
    rates = balance(cells, goals, most)
    given = cells.join(rates, "key").groupBy("key").applyInPandas(_give_out, "key struct<null: boolean, name: string>, size long, base int, more long")
    # The rank of a sub-group in its cell: how many documents the sub-groups before it hold.
    ahead = F.sum("n").over(Window.partitionBy("key", "size").orderBy("salt")) - F.col("n")
    plan = fine.select("key", "size", "salt", "n", ahead.alias("ahead")).join(given, ["key", "size"]).select("key", "size", "salt", "base", F.greatest(F.lit(0), F.least("n", F.col("more") - F.col("ahead"))).alias("take"))
    plan = plan.join(goals.select("key", "source_size", "target"), "key").join(rates.select("key", "rate"), "key")
    rank = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("h", "tie", "tie2"))
    found = rows.withColumn("rank", rank).join(plan, ["key", "size", "salt"])
    copies = (F.col("base") + (F.col("rank") <= F.col("take")).cast("int")).cast("long")
    return found.select("row.*", F.struct("source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken")).alias(out))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix: all columns of `docs`, each row as often as it has copies."""
    name, copy = fresh(docs, "mix"), fresh(docs, "copy")
    rows = mix(docs, keep=docs.columns, out=name, **how).filter(F.col(f"{name}.copies") > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{name}.copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
