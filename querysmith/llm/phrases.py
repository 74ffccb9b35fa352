"""Phrases that hang together: frequent n-grams by level-wise passes, cuts scored from the levels' tables.

A phrase can only be frequent if its two parts that are a word shorter are (Apriori), so pass k counts only phrases of k words whose
overlapping parts of k - 1 words came out frequent of the pass before. Those are sent along to the tasks: as sorted numbers while they
have at most BOUND bytes, and beyond that as a table of bits of BOUND bytes, in which none is missing and a few others are counted
in vain. Counts are exact either way, as what was counted in vain fails the threshold.

The first pass counts words. Frequent ones get a number, of their language each, and the texts are written once as numbers, with
breaks where a piece ends or a word isn't frequent; the passes for longer phrases read those. If the dictionary is larger than BOUND,
it goes through the texts part by part. Tasks count block by block and hand over sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, written

#: Language of texts without one.
NONE = "und"

#: Bytes of a dictionary or of frequent phrases that are sent along at a time, and of the table of bits that stands for more.
BOUND = 1 << 25

#: Numbers that are counted together, sums that a task holds back, words that it counts before it hands them over.
BLOCK, HELD, WORDS = 1 << 19, 1 << 20, 1 << 18

#: Bits of one of Spark's bitmaps.
_BITS = 1 << 15

#: A-Z in lower case; what separates pieces as line ends (_PIECES) or as spaces (_WORDS), tabs as spaces.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PIECES = bytes(10 if b in _ENDS else 32 if b == 9 else _LOWER[b] for b in range(256))
_WORDS = bytes(32 if b in _ENDS or b == 9 else _LOWER[b] for b in range(256))


def _texts(batch: pa.RecordBatch, table: bytes) -> Iterator[tuple[str, bytes]]:
    for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
        yield lang.as_py(), text.as_py().encode().translate(table)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            words = pa.array(list(own), pa.binary()).cast(pa.string())
            yield pa.record_batch([pa.array([lang] * len(own), pa.string()), words, pa.array(list(own.values()), pa.int64())], ["lang", "phrase", "f"])
        counts.clear()

    for batch in batches:
        for lang, text in _texts(batch, _WORDS):
            words = text.split(b" ")
            counts.setdefault(lang, Counter()).update(words)
            counts[lang].pop(b"", None)
            if sum(map(len, counts.values())) > WORDS:
                yield from rows()
    yield from rows()


def _number(part: Broadcast, first: bool, last: bool):
    """Texts to numbers of the words in a part of the dictionary, beside those of the parts before; -1 for others and where a piece ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        # An empty word is between two spaces and is left out.
        known = {lang: dict(zip([*words, b""], [*numbers, -2], strict=True)).get for lang, (words, numbers) in part.value.items()}
        none = {b"": -2}.get
        for batch in batches:
            out = []
            for i, (lang, text) in enumerate(_texts(batch, _PIECES)):
                words = text.replace(b"\n", b" \n ").split(b" ")
                x = np.fromiter(map(known.get(lang, none), words, repeat(-1)), np.int32, len(words))
                x = np.append(x[x != -2], np.int32(-1))
                out.append((x if first else np.maximum(x, np.frombuffer(batch.column("x")[i].as_py(), np.int32))).tobytes())
            columns = {"x": pa.array(out, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns if last else {"lang": batch.column("lang"), "text": batch.column("text"), **columns})

    return run


def _mix(values, seed):
    """Spark's xxhash64 of whole numbers."""
    import numpy as np

    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = (np.asarray(seed, np.uint64) + p5 + np.uint64(8)) ^ (turn(values.astype(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def _keys(words: list) -> list:
    """Numbers of a phrase's words as one or two keys."""
    return [(words[i] << 32) | words[i + 1] if i + 1 < len(words) else words[i] for i in range(0, len(words), 2)]


class _Frequent:
    """Which phrases of a level are frequent: by sorted keys, or by bits."""

    def __init__(self, sent: dict):
        self.keys, self.bits, self.size = sent.get("keys"), sent.get("bits"), sent.get("size", 0)

    def has(self, words: list):
        """For each place whether the phrase there is; words: numbers of its first, second, ... word."""
        import numpy as np

        keys = _keys(words)
        if self.bits is not None:
            h = np.uint64(42)
            for key in keys:
                h = _mix(key, h)
            at = (h & np.uint64((1 << 63) - 1)) % np.uint64(self.size)
            return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(self.keys[0]))
        for own, key in zip(self.keys, keys, strict=True):
            # Keys are sorted by the first, then the second: the rows of a first key are a range, in which the second is searched.
            low, high = _range(own, key, low, high)
        return low < high


def _range(own, key, low, high):
    """Where a sorted part [low, high) of `own` has a key: its first place and the one after its last."""
    import numpy as np

    ends = []
    for side in (0, 1):
        a, b = low.copy(), high.copy()
        while (todo := a < b).any():
            mid = (a + b) >> 1
            less = todo & ((own[np.minimum(mid, len(own) - 1)] < key) if side == 0 else (own[np.minimum(mid, len(own) - 1)] <= key))
            a, b = np.where(less, mid + 1, a), np.where(todo & ~less, mid, b)
        ends.append(a)
    return ends


def _count(k: int, sent: list[Broadcast]):
    """Sums of the phrases of k words whose parts are frequent: their keys p and q (0 for two words) and how often they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        levels = [_Frequent(level.value) for level in sent]
        held: list[tuple] = []

        def phrases(x):
            at = np.flatnonzero((x[:-1] >= 0) & (x[1:] >= 0))
            for size in range(2, k):
                at = at[levels[size - 2].has([x[at + i] for i in range(size)])]
                at = at[:-1][at[1:] == at[:-1] + 1]
            return _keys([x[at + i] for i in range(k)])

        def sums(p, q, n):
            order = np.lexsort((q, p))
            p, q, n = p[order], q[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])) if len(p) else np.zeros(0, np.int64)
            return p[new], q[new], np.add.reduceat(n, new) if len(new) else n

        def block(parts: list[bytes]) -> None:
            keys = phrases(np.frombuffer(b"".join(parts), np.int32).astype(np.int64))
            if k == 2:
                p, n = np.unique(keys[0], return_counts=True)
                held.append((p, np.zeros(len(p), np.int64), n))
            else:
                held.append(sums(*keys, np.ones(len(keys[0]), np.int64)))

        def together() -> tuple:
            return held[0] if len(held) == 1 else sums(*(np.concatenate(c) for c in zip(*held, strict=True)))

        def rows(found: tuple) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(found[0]), 1 << 16):
                yield pa.record_batch([pa.array(c[at : at + (1 << 16)], pa.int64()) for c in found], ["p", "q", "f"])

        open_, size = [], 0
        for batch in batches:
            for x in batch.column("x"):
                open_.append(x.as_py())
                size += len(open_[-1])
                if size >= 4 * BLOCK:
                    block(open_)
                    open_, size = [], 0
                    if sum(len(h[0]) for h in held) > HELD:
                        held = [together()]
                        if 2 * len(held[0][0]) > HELD:
                            yield from rows(held[0])
                            held = []
        if open_:
            block(open_)
        if held:
            yield from rows(together())

    return run


def _sent(level: DataFrame, k: int, bound: int) -> Broadcast:
    """A level's frequent phrases (p, q) for the tasks: their sorted keys if those have few bytes, else bits at their hashes."""
    import numpy as np

    spark: SparkSession = level.sparkSession
    columns = ["p", "q"][: (k + 1) // 2]
    if level.count() * 8 * len(columns) <= bound:
        table = level.select(*columns).toArrow()
        keys = [table.column(c).to_numpy() for c in columns]
        order = np.lexsort(keys[::-1])
        return spark.sparkContext.broadcast({"keys": [key[order] for key in keys]})
    total = max(bound * 8 // _BITS, 1) * _BITS
    bit = F.pmod(F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1)), F.lit(total))
    maps = level.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / _BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % _BITS).alias("bits"))
    bits = np.zeros(total // 8, np.uint8)
    for r in maps.toLocalIterator():  # of fixed size, whatever the input
        bits[r["part"] * (_BITS // 8) : (r["part"] + 1) * (_BITS // 8)] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast({"bits": bits, "size": total})


def _numbered(texts: DataFrame, words: DataFrame, bound: int) -> DataFrame:
    """Texts as numbers of frequent words (lang, phrase, number), a part of at most `bound` bytes of the dictionary at a time."""
    spark: SparkSession = texts.sparkSession
    size = words.agg(F.coalesce(F.sum(F.octet_length("phrase") + 64), F.lit(0)), F.coalesce(F.max("number"), F.lit(0))).first()
    parts = max(1, -(-size[0] // bound))
    width, rows = size[1] // parts + 1, texts
    for i in range(parts):
        own: dict[str, tuple[list, list]] = {}
        for r in words.filter(F.col("number").between(i * width, (i + 1) * width - 1)).toLocalIterator():
            of = own.setdefault(r["lang"], ([], []))
            of[0].append(r["phrase"].encode())
            of[1].append(r["number"])
        part = spark.sparkContext.broadcast(own)
        last = i == parts - 1
        rows = written(rows.mapInArrow(_number(part, i == 0, last), "x binary" if last else "lang string, text string, x binary"), "numbers")
        part.destroy()
    return rows


def levels(docs: DataFrame, most: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang", bound: int = BOUND) -> tuple[list[DataFrame], DataFrame]:
    """([(lang, phrase, f)] of frequent phrases of 1 to `most` words (4 at most), (lang, n) of all words)."""
    if not 2 <= most <= 4:
        raise ValueError("phrases have two to four words")
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NONE)).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text <> ''")
    words = written(texts.mapInArrow(_count_words, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    first = written(ranked(words.filter(F.col("f") >= least), "lang", "phrase", name="number").withColumn("number", F.col("number") - 1), "phrases1")
    x = _numbered(texts, first, bound)
    found: list[DataFrame] = []
    sent: list[Broadcast] = []
    for k in range(2, most + 1):
        counted = x.mapInArrow(_count(k, sent), "p long, q long, f long").groupBy("p", "q").agg(F.sum("f").alias("f"))
        found.append(written(counted.filter(F.col("f") >= least), f"phrases{k}"))
        if k < most:
            sent.append(_sent(found[-1], k, bound))
    for level in sent:
        level.destroy()  # what was counted is written
    return [first.select("lang", "phrase", "f"), *_spelled(found, first)], totals


def _spelled(found: list[DataFrame], words: DataFrame) -> list[DataFrame]:
    """Phrases (p, q, f) of 2, 3, ... words as (lang, phrase, f)."""
    low = F.lit((1 << 32) - 1)
    of = lambda key: [F.shiftright(key, 32), F.col(key).bitwiseAND(low)]
    every = None
    for k, level in enumerate(found, 2):
        numbers = [*of("p"), *(of("q") if k == 4 else [F.col("q")] * (k - 2))]
        rows = level.select(F.lit(k).alias("k"), "p", "q", "f", F.posexplode(F.array(*numbers)).alias("pos", "number"))
        every = rows if every is None else every.unionByName(rows)
    named = every.join(words.select("number", "lang", F.col("phrase").alias("word")), "number")
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ")
    spelt = written(named.groupBy("k", "p", "q").agg(F.first("lang").alias("lang"), F.first("f").alias("f"), spelled.alias("phrase")), "spelled")
    return [spelt.filter(F.col("k") == k).select("lang", "phrase", "f") for k in range(2, len(found) + 2)]


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def scored(tables: list[DataFrame], cover: int = 80) -> DataFrame:
    """(lang, phrase, a, l, r, score): candidates with their lowest-scoring cut, without those that a longer candidate covers."""
    every = tables[0]
    for level in tables[1:]:
        every = every.unionByName(level)
    candidates = tables[1]
    for level in tables[2:]:
        candidates = candidates.unionByName(level)
    candidates = candidates.withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))
    size = F.size("words")
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS LONG)")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    # Every shorter phrase inside a candidate, with the largest count of those that it is in.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    covers = candidates.filter(size > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(covers, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * _wide("longer") < cover * _wide("a")))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def best(rows: DataFrame, most: int = 2000) -> DataFrame:
    """The first `most` of each language by score, count and phrase, with their rank; no language is gathered in one task."""
    order = rows.withColumn("__score", -F.col("score")).withColumn("__a", -F.col("a"))
    all_ranked = ranked(order, "lang", "__score", "__a", "phrase", name="__rank").drop("__score", "__a")
    first = all_ranked.groupBy("lang").agg(F.min("__rank").alias("__first"))
    return all_ranked.join(first, "lang").withColumn("rank", F.col("__rank") - F.col("__first") + 1).filter(F.col("rank") <= most).drop("__rank", "__first")


def collocations(docs: DataFrame, most: int = 2000, longest: int = 4, least: int = 30, cover: int = 80, text_col: str = "text", lang_col: str = "lang", bound: int = BOUND) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null language is 'und'. A language without a frequent phrase has no row, an empty table gives none.
    Repeated rows count each. Ties in score go to the larger count, then to the phrase in byte order. Other columns are ignored.
    """
    tables, totals = levels(docs, longest, least, text_col, lang_col, bound)
    rows = best(scored(tables, cover), most).join(totals, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
