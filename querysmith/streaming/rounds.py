"""Intents as a stream: each micro-batch is a round of interactions.

Event order inside a micro-batch is by interaction number. The log is appended by batch id, so that a batch that is replayed
after a failure replaces its own rows. What was learned is written as a version by batch id too, before Spark counts the batch as
done: a stream that is started again, by another driver or after a failure inside a batch, goes on from the version before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import snapshots
from ..plans.loop import Loop


def start(stream: DataFrame, loop: Loop, log_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Plays a stream of (interaction, local_id) and writes the log below `log_path`, one directory a batch.

    The loop may be a new one: with a checkpoint of an earlier start it takes what was learned until then.
    """
    root, new, held = f"{checkpoint}/learned", loop.snapshot(), -1

    def play(batch: DataFrame, batch_id: int) -> None:
        nonlocal held
        if held != batch_id - 1 or not batch_id:
            before = [v for v in snapshots.versions(loop.spark, root) if v < batch_id]
            if before:
                snapshots.load(loop, root, before[-1])
            else:
                loop.restore(*new)
        held = -2  # if the batch fails, what is in memory counts no more
        size, path = loop.run.batch, f"{log_path}/batch_id={batch_id}"
        numbers = [r["interaction"] for r in batch.select("interaction").orderBy("interaction").collect()]  # of one micro-batch
        for at in range(0, len(numbers), size):
            part = batch.filter(F.col("interaction").between(numbers[at], numbers[min(at + size, len(numbers)) - 1])).select("interaction", "local_id")
            loop.round(part, numbers[at]).write.mode("append" if at else "overwrite").parquet(path)
        snapshots.save(loop, root, batch_id)
        held = batch_id

    writer = stream.writeStream.foreachBatch(play).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def last_rr(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """(local_id, rr, interaction): each entity's latest reciprocal rank, kept as state per entity. stream: (ts, local_id, interaction, rr)."""

    def latest(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (-1, 0.0)
        for rows in batches:
            top = rows.loc[rows["interaction"].idxmax()]
            best = max(best, (int(top["interaction"]), float(top["rr"])))
        state.update(best)
        yield pd.DataFrame({"local_id": [key[0]], "interaction": [best[0]], "rr": [best[1]]})

    return stream.withWatermark("ts", watermark).groupBy("local_id").applyInPandasWithState(latest, "local_id string, interaction long, rr double", "interaction long, rr double", "update", "NoTimeout")


def windows(stream: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Mean reciprocal rank by time window; late rows are dropped behind the watermark."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", size, slide)).agg(F.avg("rr").alias("mrr"), F.count("*").alias("n"))
