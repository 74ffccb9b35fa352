"""Mixture-controlled packing by deficit round-robin, in closed form.

A deficit round-robin scheduler gives every source queue a quantum of credit per round
(here: one window times the source's target share) and serves a queue's next item as soon
as its credit covers it. While a queue is backlogged, its deficit after r rounds is
r * quantum - tokens served, so the item that ends at token e of its queue is served in
round ceil(e / quantum). That needs no sequential scan: the position in the queue is a
prefix sum, the round follows from it, and ordering items by (round, source, position)
*is* the scheduler's output. Deficits so carry over windows and over partitions exactly.

Documents are cut into segments (the scheduler's items), so that long ones don't hold
several windows for themselves; the ordered stream is cut into windows.
The tail that doesn't fill a window is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import json
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Stands for a null source; a real one has a mark before it, so that no name can be taken for it.
_NULL, _NAMED = "null", "="


def _encoder(path: str):
    """The byte-level BPE of a tokenizers file as a faster encoder for the same ids; kept for the process."""
    kept = sys.modules.setdefault("_querysmith_kept", types.ModuleType("_querysmith_kept")).__dict__
    if path not in kept:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # The byte alphabet of byte-level BPE: printable Latin-1 stands for itself, the rest for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        kept[path] = tiktoken.Encoding(base64.b64encode(path.encode()).decode(), pat_str=split, mergeable_ranks=ranks, special_tokens=special)
    return kept[path]


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, row, encode = TaskContext.get().partitionId(), 0, _encoder(path).encode
        served: dict[str, int] = {}
        for batch in batches:
            sources = batch.column("source").to_pylist()
            ids, n, before = [], [], []
            for text, source in zip(batch.column("text"), sources, strict=True):
                own = encode(text.as_py() or "", allowed_special="all")
                own.append(end)
                ids.append(np.array(own, dtype="<u4" if end > 65535 or max(own) > 65535 else "<u2").tobytes())
                n.append(len(own))
                before.append(served.get(source, 0))
                served[source] = before[-1] + len(own)
            size = len(n)
            wide = [len(b) // k for b, k in zip(ids, n, strict=True)]
            yield pa.record_batch({
                "rid": pa.array([(part << 33) + row + i for i in range(size)], pa.int64()), "part": pa.array([part] * size, pa.int64()), "id": batch.column("id"), "source": batch.column("source"),
                "n": pa.array(n, pa.int64()), "before": pa.array(before, pa.int64()), "width": pa.array(wide, pa.int32()), "ids": pa.array(ids, pa.binary()),
            })
            row += size

    return run


def tokenized(docs: DataFrame, tokenizer: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Writes each document's token ids once, in the shared folder.

    Columns: rid (unique), part, id, source (marked, so that null has a name of its own), n (ids with the end id), before (ids of the
    same source and partition that precede it), width (bytes an id), ids. Null texts have the end id alone.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.concat(F.lit(_NAMED), F.col(f"`{source_col}`").cast("string")), F.lit(_NULL)).alias("source"))
    out = "rid long, part long, id long, source string, n long, before long, width int, ids binary"
    return written(rows.mapInArrow(_tokenize(tokenizer, end), out), "tokens")


def _positions(rows: DataFrame, order: list[str], size: str, out: str) -> DataFrame:
    """Adds the exclusive prefix sum of `size` in a global order: range partitions, a sum in each, then offsets of partitions."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(rows.repartitionByRange(n, *order).withColumn("slot", F.spark_partition_id()), "stream")
    sums = dealt.groupBy("slot").agg(F.sum(size).alias("own"))
    offsets = sums.select("slot", (F.sum("own").over(Window.orderBy("slot")) - F.col("own")).alias("base"))
    inside = F.sum(size).over(Window.partitionBy("slot").orderBy(*order)) - F.col(size)
    return dealt.join(offsets, "slot").withColumn(out, F.col("base") + inside).drop("slot", "base")


def _tail(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the sequences after the last full window: the powers of two of what is left."""
    at, out = total // window * window, []
    for k in range(window.bit_length(), -1, -1):
        if total % window >> k & 1:
            out.append((at, 1 << k))
            at += 1 << k
    return out


def _sequence(at: Column, total: int, window: int) -> Column:
    """The sequence of a stream position and where it starts."""
    out = F.struct((at / window).cast("long").alias("id"), ((at / window).cast("long") * window).alias("first"))
    for i, (first, _) in enumerate(_tail(total, window)):
        out = F.when(at >= first, F.struct(F.lit(total // window + i).cast("long").alias("id"), F.lit(first).cast("long").alias("first"))).otherwise(out)
    return out


def plan(tokens: DataFrame, window: int = 2048, segment: int = 256, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of documents with their sequence and offset: rid, start, length, sequence_id, offset.

    weights: target token proportions by source (None: the null source); by default each source's share of all
    tokens, so that every queue lasts to the last window. A source that isn't named keeps its own share. Queues
    that run out leave their credit to the others; nothing is dropped.
    """
    parts = tokens.groupBy("source", "part").agg(F.sum("n").alias("own"))
    queues = Window.partitionBy("source")
    parts = parts.select("source", "part", (F.sum("own").over(queues.orderBy("part")) - F.col("own")).alias("base"), F.sum("own").over(queues).alias("total"))
    parts = written(parts, "queues")
    total = parts.select("source", "total").distinct().agg(F.sum("total")).first()[0]
    if not total:
        return tokens.select("rid", F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    share = F.col("total") / F.lit(float(total))
    for source, weight in (weights or {}).items():
        share = F.when(F.col("source") == F.lit(_NULL if source is None else _NAMED + source), F.lit(float(weight))).otherwise(share)
    items = (
        tokens.select("rid", "source", "part", "n", "before").join(parts, ["source", "part"])
        .select("rid", "source", (F.col("base") + F.col("before")).alias("head"), "n", (F.lit(float(window)) * share).alias("quantum"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(segment).cast("long"))).alias("start"))
        .select("rid", "source", "start", F.least(F.lit(segment).cast("long"), F.col("n") - F.col("start")).alias("length"), (F.col("head") + F.col("start")).alias("place"), "quantum")
        .select("rid", "source", "start", "length", "place", F.ceil((F.col("place") + F.col("length")) / F.greatest("quantum", F.lit(1e-9))).alias("round"))
    )
    stream = _positions(items, ["round", "source", "place"], "length", "at")
    to = F.col("at") + F.col("length")
    full = F.transform(F.sequence((F.col("at") / window).cast("long") + 1, (to / window).cast("long") + 1), lambda k: k * window)
    tail = F.array(*[F.lit(first).cast("long") for first, _ in _tail(total, window)], F.lit(-1).cast("long"))
    edges = F.array_sort(F.array_union(F.array("at"), F.filter(F.array_union(full, tail), lambda c: (c > F.col("at")) & (c < to))))
    pieces = stream.withColumn("edges", edges).withColumn("to", to).select("rid", "start", "at", "to", "edges", F.posexplode("edges").alias("i", "from"))
    upto = F.when(F.col("i") + 1 < F.size("edges"), F.get("edges", F.col("i") + 1)).otherwise(F.col("to"))
    pieces = pieces.select("rid", (F.col("start") + F.col("from") - F.col("at")).alias("start"), (upto - F.col("from")).alias("length"), "from", _sequence(F.col("from"), total, window).alias("cut"))
    return pieces.select("rid", "start", "length", F.col("cut.id").alias("sequence_id"), (F.col("from") - F.col("cut.first")).alias("offset"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, source, n, width, ids, pieces) to one row a piece; neighbours in a sequence become one piece."""
    import numpy as np

    names = ["id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            ids, merged = np.frombuffer(row["ids"], f"<u{row['width']}"), []
            for p in sorted(row["pieces"], key=lambda p: p["start"]):
                if merged and merged[-1][2] == p["sequence_id"] and merged[-1][3] + merged[-1][1] == p["offset"]:
                    merged[-1][1] += p["length"]
                else:
                    merged.append([p["start"], p["length"], p["sequence_id"], p["offset"]])
            out += [(row["id"], row["source"], start, length, ids[start : start + length].astype("<u4").tobytes(), row["n"], seq, offset) for start, length, seq, offset in merged]
        yield pa.record_batch([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, segment: int = 256, end: int = 1, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Packs whole documents into sequences of `window` tokens, one row a piece.

    Columns: `id_col`, source, start and length (in the document's ids, which finish with `end`), ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset (gapless from 0). Only sequences that start after the last full window
    are shorter, and those have a power of two of tokens: there is no padding at all.

    Nulls: a null text is empty and gives the end id alone; null sources are a queue of their own; null ids stay null.
    Repeated rows are packed once each. An empty table gives no rows. Other columns are ignored, whatever their names.
    Results for the same stored table are the same; the order inside a queue follows the table's partitions.
    """
    tokens = tokenized(docs, tokenizer, end, id_col, text_col, source_col)
    pieces = plan(tokens, window, segment, weights).groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    rows = tokens.join(pieces, "rid").select("id", "source", "n", "width", "ids", "pieces")
    out = rows.mapInArrow(_cut, "id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.select(F.col("id").alias(id_col), F.when(F.col("source") != F.lit(_NULL), F.substring("source", len(_NAMED) + 1, 1 << 30)).alias("source"), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
