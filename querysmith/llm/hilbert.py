"""Nearest neighbours by shifted Hilbert curves, completed exactly.

Unit vectors are projected, several times and at different shifts, to a few dimensions and ordered along a Hilbert curve.
Spark range-partitions each ordering; a query's candidates are its neighbours within a window of keys on every curve, across
the borders of partitions too. The windows' best are merged and ranked by their exact cosine.

On vectors without structure no few projections keep neighbourhoods: windows alone then find a small part of the true
neighbours. So a second pass makes the result exact. The first curve's ordering cuts the vectors into blocks, each with a
bound on the angle to its centre; a query is multiplied with a block only if that bound lets it hold something better than
what the windows found: the first curve's window, made as wide as the bound asks. Queries go in groups of bounded bytes against
all blocks, and a task keeps a query's best only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, shuffle_partitions, written

#: Curves, dimensions of each, bits a dimension, rows on either side of a query, vectors a block, rows of a product.
CURVES, DIMS, BITS, WINDOW, BLOCK, ROWS = 4, 8, 7, 64, 256, 8192
#: Bytes of query vectors that go along at once.
BYTES = 16 << 20
#: Scores closer than this are compared again by exact sums.
SLACK = 1e-11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along a Hilbert curve of integer points (n, d) with `bits` bits a dimension.

    Gray-code form: going from the highest bit down, each coordinate either inverts or swaps the lower bits of the first one;
    the transposed code is then undone by exclusive ors and its bits interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for i in range(d):
            up = (x[i] & high) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | x[i] >> level & 1
    return key


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosines in double precision, sums taken from left to right."""
    left = lambda m: np.cumsum(m, axis=1)[:, -1]
    return np.clip(left(a * b) / np.sqrt(left(a * a) * left(b * b)), -1.0, 1.0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k best ids: highest score on a grid of SLACK, then smallest id. An id that repeats counts once, with its best."""
    order = np.lexsort((-score, ids, row))
    again = (row[order[1:]] == row[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]])
    if again.any():
        order = order[np.concatenate([[True], ~again])]
    order = order[np.lexsort((ids[order], -np.round(score[order] / SLACK), row[order]))]
    if not len(order):
        return order
    row = row[order]
    first = np.concatenate([[True], row[1:] != row[:-1]])
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order[np.arange(len(row)) - start < k]


def _pack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("vec").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            top = np.abs(x).max(axis=1, keepdims=True) if len(x) else x
            with np.errstate(over="ignore", under="ignore"):
                norm = (x * x).sum(axis=1, keepdims=True)
            x = np.where((norm > 1e290) | (norm < 1e-290), x / np.where(top > 0, top, 1), x)  # else squares over- or underflow
            yield pa.record_batch({"id": batch.column("id"), "query": batch.column("query"), "vec": pa.array([r.tobytes() for r in x], pa.binary())})

    return run


def _order(dim: int, curves: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from math import erf

        rng = np.random.default_rng(seed)
        d = min(DIMS, dim)
        turns = [np.linalg.qr(rng.normal(size=(dim, d)))[0] for _ in range(curves)]
        shifts = [rng.random(d) for _ in range(curves)]
        grid = np.linspace(-6, 6, 4097)
        share = np.array([0.5 * (1 + erf(g / 2**0.5)) for g in grid])
        for batch in batches:
            x = _matrix(batch.column("vec"), dim)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            for c in range(curves):
                # A coordinate of a unit vector is about normal with variance 1 / dim: its share of the mass fills the grid evenly.
                place = np.interp(unit @ turns[c] * dim**0.5, grid, share)
                cells = np.minimum(((place + shifts[c]) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
                yield pa.record_batch({"curve": pa.array(np.full(len(x), c, np.int32)), "key": pa.array(hilbert_keys(cells, BITS)), "id": batch.column("id"), "query": batch.column("query"), "vec": batch.column("vec")})

    return run


@dataclass
class _Rows:
    """Neighbours along the curves, as arrays."""

    curve: np.ndarray
    ids: np.ndarray
    query: np.ndarray
    vec: np.ndarray

    def __getitem__(self, at) -> _Rows:
        return _Rows(self.curve[at], self.ids[at], self.query[at], self.vec[at])

    def __add__(self, other: _Rows) -> _Rows:
        return _Rows(*(np.concatenate(p) for p in zip((self.curve, self.ids, self.query, self.vec), (other.curve, other.ids, other.query, other.vec), strict=True)))


_KINDS = {"kind": pa.string(), "slot": pa.int64(), "curve": pa.int32(), "a": pa.int64(), "b": pa.int64(), "score": pa.float64(), "query": pa.bool_(), "ids": pa.binary(), "vecs": pa.binary()}
_FOUND = "kind string, slot long, curve int, a long, b long, score double, query boolean, ids binary, vecs binary"


def _table(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns[c], _KINDS[c]) if c in columns else pa.nulls(n, _KINDS[c]) for c in _KINDS], list(_KINDS))


def _window(rows: _Rows, ask: np.ndarray, k: int, window: int) -> pa.RecordBatch | None:
    """The k best of each asking row's window of the same curve."""
    near = np.arange(-window, window + 1)
    unit = rows.vec / np.linalg.norm(rows.vec, axis=1, keepdims=True)
    a, b = [], []
    for i in range(0, len(ask), 256):
        own = ask[i : i + 256]
        at = own[:, None] + near
        inside = (at >= 0) & (at < len(rows.ids))
        at = np.clip(at, 0, len(rows.ids) - 1)
        inside &= (rows.curve[at] == rows.curve[own][:, None]) & (rows.ids[at] != rows.ids[own][:, None])
        score = np.einsum("qd,qwd->qw", unit[own], unit[at])
        q, w = np.nonzero(inside)
        best = _best(q, score[q, w], rows.ids[at[q, w]], k)
        a.append(own[q[best]])
        b.append(at[q[best], w[best]])
    if not a:
        return None
    a, b = np.concatenate(a), np.concatenate(b)
    return _table(kind=["pair"] * len(a), a=rows.ids[a], b=rows.ids[b], score=cosines(rows.vec[a], rows.vec[b])) if len(a) else None


def _along(dim: int, k: int, window: int):
    """Sorted rows of a range partition to: pairs of its windows, the rows at both its ends, and blocks of the first curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, rows, done, first, block = TaskContext.get().partitionId(), None, 0, None, None

        def blocks(part: _Rows):
            for i in range(0, len(part.ids), BLOCK):
                own = part[slice(i, i + BLOCK)]
                yield _table(kind=["block"], ids=[own.ids.tobytes()], vecs=[own.vec.tobytes()])

        def ends(part: _Rows, kind: str):
            yield _table(kind=[kind] * len(part.ids), slot=np.full(len(part.ids), slot), curve=part.curve, a=part.ids, b=np.arange(len(part.ids)), query=part.query, vecs=[v.tobytes() for v in part.vec])

        def ask(last: bool):
            nonlocal rows, done
            upto = len(rows.ids) if last else max(done, len(rows.ids) - window)
            wanted = done + np.flatnonzero(rows.query[done:upto])
            if len(wanted) and (found := _window(rows, wanted, k, window)):
                yield found
            keep = max(0, upto - window)
            rows, done = rows[slice(keep, None)], upto - keep

        for batch in batches:
            new = _Rows(batch.column("curve").to_numpy(), batch.column("id").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False).astype(bool), _matrix(batch.column("vec"), dim))
            if first is None or len(first.ids) < window:
                first = (new if first is None else first + new)[slice(0, window)]
            zero = new[new.curve == 0]
            block = zero if block is None else block + zero
            whole = len(block.ids) // BLOCK * BLOCK
            yield from blocks(block[slice(0, whole)])
            block = block[slice(whole, None)]
            rows = new if rows is None else rows + new
            yield from ask(False)
        if rows is not None:
            yield from ask(True)
            yield from blocks(block)
            yield from ends(first, "head")
            yield from ends(rows[slice(max(0, len(rows.ids) - window), None)], "tail")

    return run


def _borders(dim: int, k: int, window: int):
    """Rows around one border, the earlier partition's first, to pairs across it."""

    def run(border: pa.Table) -> pa.Table:
        border = border.sort_by([("side", "ascending"), ("b", "ascending")])
        rows = _Rows(border["curve"].to_numpy(), border["a"].to_numpy(), border["query"].to_numpy().astype(bool), _matrix(border["vecs"].combine_chunks(), dim))
        found = _window(rows, np.flatnonzero(rows.query), k, window) if rows.query.any() else None
        names = ["a", "b", "score"]
        return pa.table({n: found.column(n) for n in names} if found else {n: pa.array([], _KINDS[n]) for n in names})

    return run


def _complete(packed, dim: int, k: int):
    """Blocks of vectors against a group of queries: what may stand among a query's k best and the windows didn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_ids, raw_vecs, raw_least = packed.value
        qid, least = np.frombuffer(raw_ids, np.int64), np.frombuffer(raw_least, np.float64).copy()
        original = np.frombuffer(raw_vecs, np.float64).reshape(-1, dim)
        unit = original / np.linalg.norm(original, axis=1, keepdims=True)
        # The best so far of each query: row, id, score, vector.
        kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty((0, dim)))

        def settle(new: list):
            nonlocal kept
            row, ids, score, vec = (np.concatenate(p) for p in zip(kept, *new, strict=True))
            best = _best(row, score, ids, k)
            kept = row[best], ids[best], score[best], vec[best]
            full = np.bincount(kept[0], minlength=len(qid)) == k
            worst = np.full(len(qid), np.inf)
            np.minimum.at(worst, kept[0], kept[2])
            least[full] = np.maximum(least[full], worst[full])

        found, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = np.frombuffer(batch.column("ids")[i].as_py(), np.int64), np.frombuffer(batch.column("vecs")[i].as_py(), np.float64).reshape(-1, dim)
                block = x / np.linalg.norm(x, axis=1, keepdims=True)
                centre = block.mean(axis=0)
                length = np.linalg.norm(centre)
                may = np.arange(len(qid))
                if length > 1e-6:
                    spread = np.arccos(np.clip((block @ (centre / length)).min(), -1, 1))
                    bound = np.cos(np.maximum(0.0, np.arccos(np.clip(unit @ (centre / length), -1, 1)) - spread))
                    may = np.flatnonzero(bound >= least - 1e-9)
                if not len(may):
                    continue
                for some in (may[at : at + ROWS] for at in range(0, len(may), ROWS)):
                    score = unit[some] @ block.T
                    q, v = np.nonzero(score >= least[some][:, None] - SLACK)
                    own = qid[some[q]] != ids[v]
                    q, v = q[own], v[own]
                    if len(q):
                        best = _best(q, score[q, v], ids[v], k)
                        q, v = q[best], v[best]
                        found.append((some[q], ids[v], score[q, v], x[v]))
                        size += len(q)
                    if size > 1 << 16:
                        settle(found)
                        found, size = [], 0
        if found:
            settle(found)
        for i in range(0, len(kept[0]), 1 << 14):
            row, ids, _, vec = (p[i : i + (1 << 14)] for p in kept)
            yield pa.record_batch({"a": pa.array(qid[row]), "b": pa.array(ids), "score": pa.array(cosines(original[row], vec))})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES, window: int = WINDOW, exact: bool = True, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by cosine of every row where `queries` holds, ties to the smaller id.

    exact=False returns what the windows (`window` rows on either side, on `curves` curves) found, without the completing pass.
    Vectors that are null, zero, hold a null or a non-finite component, have no id, or are of another length than most vectors
    take no part. Rows that repeat a query's id are its own row; repeats of another id count once. Of an id with several vectors
    the nearest pair counts, whichever side it is on; repeated rows are removed before they take places in windows and blocks. A table without two usable
    vectors gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(sound)
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["dim"]
    packed_rows = rows.filter(F.size("vec") == dim).mapInArrow(_pack(dim), "id long, query boolean, vec binary")
    clean = written(packed_rows.groupBy("id", "vec").agg(F.max("query").alias("query")).select("id", "query", "vec"), "vectors")
    n = shuffle_partitions(spark)
    ordered = clean.mapInArrow(_order(dim, curves, seed), "curve int, key long, id long, query boolean, vec binary")
    found = written(ordered.repartitionByRange(n, "curve", "key", "id").sortWithinPartitions("curve", "key", "id").mapInArrow(_along(dim, k, window), _FOUND), "curves")
    ends = found.filter(F.col("kind").isin("head", "tail"))
    # A border is named by the partition before it; its two sides hold `window` rows at most.
    border = ends.select(F.when(F.col("kind") == "tail", F.col("slot")).otherwise(F.col("slot") - 1).alias("border"), F.when(F.col("kind") == "tail", 0).otherwise(1).alias("side"), "curve", "a", "b", "query", "vecs")
    across = border.groupBy("border").applyInArrow(_borders(dim, k, window), "a long, b long, score double")
    windows = written(found.filter("kind = 'pair'").select("a", "b", "score").union(across), "windows")
    if exact:
        best = windows.groupBy("a", "b").agg(F.max("score").alias("score")).groupBy("a").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k).alias("s"))
        least = best.select("a", F.when(F.size("s") == k, F.element_at("s", k)).otherwise(-2.0).alias("least"))
        asking = clean.filter("query").join(least, F.col("id") == F.col("a"), "left").select("id", "vec", F.coalesce("least", F.lit(-2.0)).alias("least"))
        # Groups by rank have a size that is known; what is sent along so is bounded in bytes whatever the vectors' length.
        most = max(1, BYTES // (8 * dim))
        asking = written(ranked(asking, "id", "vec").withColumn("group", F.floor((F.col("rank") - 1) / most)).drop("rank"), "queries")
        parts = [windows]
        for g in range((asking.agg(F.max("group")).first()[0] or 0) + 1):
            own = asking.filter(F.col("group") == g).collect()
            if own:
                own.sort(key=lambda r: r["id"])
                packed = spark.sparkContext.broadcast((np.array([r["id"] for r in own], np.int64).tobytes(), b"".join(bytes(r["vec"]) for r in own), np.array([r["least"] for r in own]).tobytes()))
                parts.append(written(found.filter("kind = 'block'").select("ids", "vecs").mapInArrow(_complete(packed, dim, k), "a long, b long, score double"), "completed"))
                packed.unpersist()
        windows = parts[0]
        for part in parts[1:]:
            windows = windows.union(part)
    pairs = windows.groupBy("a", "b").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return pairs.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select(F.col("a").alias("query_id"), "rank", F.col("b").alias("vec_id"), "score")
