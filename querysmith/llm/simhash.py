"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits share a variant: one word within two
flips of the first and within one flip of the second. If a 64-bit word is seen as two halves,
at most one flip of the three falls in one of them. So the variants with at most one flip are
emitted and dealt out by that half: what meets in a task are all fingerprints whose half is
equal up to one flip. The second flips, all in the other half, change nothing about the deal
and are made after the shuffle, where variants are matched as whole 64-bit words.

A half may be common to very many fingerprints. Where a key could gather more than 33 BLOCK rows,
its rows make their second flips before the shuffle instead and are dealt out by whole words,
of which none can have more than some hundred different fingerprints around it.

Fingerprints that share a variant form a star around one of them, never all pairs; every link
is verified by its number of differing bits. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, scratch_path, shuffle_partitions, written

#: Distance of a link, fixed by the scheme of halves: up to one flip in a half, up to two more in the other.
RADIUS = 3
#: Fingerprints (own rows of a half) that are handled at once in a task. A half that this many fingerprints have is crowded.
BLOCK = 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's shingles of `width` words, each occurrence counted; 0 without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    hashes = np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            own = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.record_batch({"id": batch.column("id"), "th": batch.column("th"), "fp": pa.array(own.view(np.int64))})

    return run


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint and half: itself, and its variants by a flip in that half. Rows (half, key, fp)."""
    import numpy as np

    flips = np.uint64(1) << np.arange(32, dtype=np.uint64)
    for batch in batches:
        for i in range(0, batch.num_rows, 1 << 14):
            fp = batch.column("fp").to_numpy(zero_copy_only=False)[i : i + (1 << 14)].view(np.uint64)
            for half in (0, 1):
                own = fp >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
                keys = np.concatenate([own[:, None], own[:, None] ^ flips[None, :]], axis=1)
                yield pa.record_batch({"half": pa.array(np.full(keys.size, half, np.int32)), "key": pa.array(keys.ravel().view(np.int64)), "fp": pa.array(np.repeat(fp, 33).view(np.int64))})


def _stars(keys, fps, half: int):
    """Links (a, b) among rows of one half whose keys are all here: numpy arrays of both ends."""
    import numpy as np

    one = np.uint64(1)
    at = np.uint64(32 * half)
    rest = [one << np.uint64(k) for k in range(64) if k // 32 != half]
    own = (fps >> at & np.uint64(0xFFFFFFFF)) == keys  # not flipped
    base = fps ^ (((fps >> at & np.uint64(0xFFFFFFFF)) ^ keys) << at)  # the variant
    if not own.any():
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    mine = fps[own]
    # Words to meet: the emitted variants, and of unflipped rows those with a flip in the other half. A row's rank tells
    # which may stand in the middle of a star: unflipped ones (at most one flip), before flipped ones.
    words = np.concatenate([base, *(mine ^ f for f in rest)])
    nodes = np.concatenate([fps, np.tile(mine, len(rest))])
    rank = np.concatenate([~own, np.zeros(len(mine) * len(rest), bool)])
    order = np.lexsort((nodes, rank, words))
    words, nodes = words[order], nodes[order]
    first = np.concatenate([[True], words[1:] != words[:-1]])
    centre = nodes[np.flatnonzero(first)][np.cumsum(first) - 1]
    a, b = [centre[centre != nodes]], [nodes[centre != nodes]]
    # Second flips of unflipped rows, looked up among those words; a table of bits tells most misses.
    words, centre = words[first], nodes[first]
    bits = max(16, int(len(words)).bit_length() + 4)
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    there = np.zeros(1 << bits, bool)
    there[words * mix >> shift] = True
    for i, f in enumerate(rest):
        for j in range(i + 1, len(rest)):
            probe = mine ^ (f | rest[j])
            hit = np.flatnonzero(there[probe * mix >> shift])
            if len(hit):
                place = np.minimum(np.searchsorted(words, probe[hit]), len(words) - 1)
                hit, place = hit[words[place] == probe[hit]], place[words[place] == probe[hit]]
                a.append(centre[place])
                b.append(mine[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    near = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    a, b = a[near], b[near]
    # As signed numbers, so that "smaller" means the same here and in Spark.
    pairs = np.unique(np.stack([np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (half, key) to links; keys stay together, and as many of them as BLOCK fingerprints need go at once."""
    import numpy as np

    def out(half, key, fp):
        for h in (0, 1):
            if (half == h).any():
                a, b = _stars(key[half == h].view(np.uint64), fp[half == h].view(np.uint64), h)
                if len(a):
                    yield pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    kept: list = []
    size = 0
    for batch in batches:
        kept.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("half", "key", "fp")])
        size += batch.num_rows
        if size < 33 * BLOCK:
            continue
        half, key, fp = (np.concatenate(x) for x in zip(*kept, strict=True))
        cut = int(np.flatnonzero((half != half[-1]) | (key != key[-1])).max(initial=-1)) + 1  # the last key may go on
        if cut:
            yield from out(half[:cut], key[:cut], fp[:cut])
        kept, size = [[half[cut:], key[cut:], fp[cut:]]], len(half) - cut
    if size:
        yield from out(*(np.concatenate(x) for x in zip(*kept, strict=True)))


def crowded(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Keys (half, key) within one flip of a half that at least `block` of the distinct fingerprints have. All other keys gather
    fewer than 33 `block` rows."""
    halves = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    common = fps.select(F.posexplode(halves).alias("half", "own")).groupBy("half", "own").count().filter(F.col("count") >= block)
    flipped = F.array(F.col("own"), *[F.col("own").bitwiseXOR(F.lit(1 << k)) for k in range(32)])
    return common.select("half", F.explode(flipped).alias("key")).distinct()


def _emit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row (half, key, fp): its variant, and of unflipped rows also those by one or two flips in the other half.
    Rows (word, far, fp); far: by two flips."""
    import numpy as np

    one = np.uint64(1)
    flips = []
    for half in (0, 1):
        rest = [one << np.uint64(k) for k in range(64) if k // 32 != half]
        flips.append(np.array([0, *rest, *(f | g for i, f in enumerate(rest) for g in rest[i + 1 :])], np.uint64))
    far = np.arange(len(flips[0])) > 32
    for batch in batches:
        half, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("half", "key", "fp"))
        key, fp, at = key.view(np.uint64), fp.view(np.uint64), half.astype(np.uint64) * np.uint64(32)
        turned = (fp >> at & np.uint64(0xFFFFFFFF)) ^ key
        words = fp ^ (turned << at)
        out = turned != 0
        yield pa.record_batch({"word": pa.array(words[out].view(np.int64)), "far": pa.array(np.zeros(out.sum(), bool)), "fp": pa.array(fp[out].view(np.int64))})
        for h in (0, 1):
            mine = fp[~out & (half == h)]
            for i in range(0, len(mine), 1 << 9):
                some = mine[i : i + (1 << 9)]
                yield pa.record_batch({"word": pa.array((some[:, None] ^ flips[h][None, :]).ravel().view(np.int64)), "far": pa.array(np.tile(far, len(some))), "fp": pa.array(np.repeat(some, len(far)).view(np.int64))})


def _meet_at_words(rows: DataFrame) -> DataFrame:
    """Links (a, b) of rows (half, key, fp), dealt out by whole words. The middle of a word's star is at most one flip away from it,
    so that no other is more than RADIUS from the middle; words that are two flips from all that have them join none."""
    around = Window.partitionBy("word").orderBy("far", "fp")  # at most some hundred different fingerprints
    stars = rows.mapInArrow(_emit_words, "word long, far boolean, fp long").distinct()
    stars = stars.withColumn("middle", F.first(F.struct("far", "fp")).over(around)).filter(~F.col("middle.far")).select("fp", F.col("middle.fp").alias("middle"))
    near = stars.filter((F.col("fp") != F.col("middle")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))) <= RADIUS))
    return near.select(F.least("fp", "middle").alias("a"), F.greatest("fp", "middle").alias("b"))


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b), a < b, between the distinct fingerprints `fp`: enough that every two within RADIUS bits are connected.

    Keys that could gather 33 `block` rows or more are dealt out by whole words, all others by themselves; the links found are
    verified alike. An empty table has no links.
    """
    n = shuffle_partitions(fps.sparkSession)
    emitted = fps.select("fp").mapInArrow(_emit, "half int, key long, fp long")
    hot = written(crowded(fps, block), "crowded")
    apart = None
    if not hot.isEmpty():
        apart = _meet_at_words(emitted.join(hot, ["half", "key"], "left_semi"))
        emitted = emitted.join(hot, ["half", "key"], "left_anti")
    met = emitted.repartition(n, "half", "key").sortWithinPartitions("half", "key").mapInArrow(_meet, "a long, b long")
    return (met.union(apart) if apart is not None else met).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable. Distributed, in rounds.

    Rounds of large-star and small-star (both keep the components and shorten paths) until nothing changes; each round is a
    written table of links, so nothing is gathered and lost executors cost one round at most.
    """
    spark = edges.sparkSession
    table, path = edges.select("a", "b"), None
    table = written(table, "links")
    last = None
    for _ in range(most):
        both = table.union(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        small_m = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(small_m, "b")
        small = joined.select(F.col("m").alias("a"), "b").union(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a < b").distinct()
        new = scratch_path(spark, "round")
        small.write.option("compression", "zstd").parquet(new)
        table = spark.read.schema(small.schema).parquet(new)
        # A fixed point: as many links as nodes that aren't roots, and the same sums as before.
        now = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if path:
            drop_written(spark, path)
        path = new
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"links have not settled after {most} rounds")
    return table.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _rooted(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, th, fp, root, component_id) of every row: a hash of the text, the fingerprint, and two names of its component, of
    which only root (a fingerprint) tells components apart where ids repeat."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("th", _text_hash(F.col("text")))
    rows = written(rows.select("id", "th", "text").mapInArrow(_fingerprints(width), "id long, th long, fp long"), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    nodes = written(nodes, "nodes")
    roots = written(components(links(nodes)), "roots")
    nodes = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(named, "root").select("fp", "root", "component_id")
    # Many documents may share a fingerprint: the larger side is split where a key is hot.
    return rows.join(nodes, "fp")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row a document: `id_col`, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Documents are linked if their fingerprints differ in three bits or fewer. Texts that are null, empty or white space have
    fingerprint zero and are linked like any others; texts of fewer words than `width` are one shingle. Null ids are rows too:
    they link others, keep a null id, and never name a component unless it has no other id (then null). Repeated rows and tied
    fingerprints share a component. An empty table gives no rows. Other columns are ignored.
    """
    out = _rooted(docs, id_col, text_col, width)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The documents of `docs` that stay, with all columns: of each component the row with the smallest id.

    If ids repeat, of those rows the one with the smallest hash of its text stays; so of an id with two unlike texts both can.
    Rows that repeat id and text differ in other columns at most: the one that is least as JSON stays. Rows without an id can't be
    named, so they all stay. An empty table stays empty.
    """
    rows = _rooted(docs, id_col, text_col, width).filter("id IS NOT NULL")
    least = rows.groupBy("root").agg(F.min(F.struct("id", "th")).alias("kept"))
    kept = written(least.select("kept.id", "kept.th").distinct(), "kept")
    # Rows that repeat are few or many; only those that repeat a kept one are gone through again.
    again = written(rows.join(kept, ["id", "th"], "left_semi").groupBy("id", "th").agg(F.count("*").alias("n")).filter("n > 1").select("id", "th"), "repeated")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # out of the way of ours
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    mine = (F.col(names[id_col]).cast("long") == F.col("id")) & (_text_hash(F.col(names[text_col]).cast("string")) == F.col("th"))
    stay = own.join(kept, mine, "left_semi")
    once = stay.join(again, mine, "left_anti")
    whole = F.struct(*names.values())
    repeated = stay.join(again, mine).groupBy("id", "th").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    out = once.unionByName(repeated).unionByName(own.filter(F.col(names[id_col]).isNull()))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
