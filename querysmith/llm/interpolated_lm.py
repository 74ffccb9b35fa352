"""A word bigram model by deleted interpolation.

A token's probability is a mix of maximum-likelihood estimates: of the pair with the token before it, of the token alone, and a
uniform share for words never seen. The weights depend on how often the context was seen (buckets of its frequency) and are
learned by expectation-maximisation on held-out counts: a tenth of the training documents is kept out of the estimates while
the weights are learned, then all training documents make the final ones.

Counts cover the whole corpus. So that they need not be shuffled token by token, documents are gathered in blocks
(as they are read), each with its distinct words and pairs. A block sends sorted hashes with its own counts, packed, to the
task that owns their range; that task sums them over all blocks and answers with the totals in the same order. However frequent
a word or a pair is, each block mentions it once.

Both the number of blocks and that of ranges grow with the corpus, so a row for each block and range would make their product.
Beyond FANOUT ranges the way therefore has levels: a block sends FANOUT rows, each to a node that sums up about FANOUT blocks
within one coarse range and sends FANOUT rows on, of finer ranges; totals come back the same way. A node holds about as much as a
block at every level, and rows grow with tokens times levels (one more level for each factor of FANOUT).

Words are known by 64-bit hashes, pairs by 56-bit ones; counts are exact but for collisions. Of n distinct pairs one shares its
hash with another with odds of n / 2**56: 1.4e-8 at 10**9 pairs, 1.4e-5 at 10**12. EM reads the held-out estimates in steps of a
quarter octave, so each is off by 9 % at most while weights are learned (not in scores).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

#: Tokens after which a block is closed; share (one in) of training documents that is held out; entries that one task sums.
BLOCK, HELD, ENTRIES = 1_000_000, 10, 4_000_000
#: Rows that a block, or a node that sums up blocks, sends at most.
FANOUT = 512
#: Context-frequency buckets (powers of two), steps an octave of the held-out histogram, rounds of EM.
BUCKETS, STEPS, ROUNDS = 33, 4, 60
#: Strings that no word can be: words hold no space.
END, BEGIN = b" ", b"  "
#: Roles of documents: scored only, training, training but held out while weights are learned.
ONLY, FIT, EM = 0, 1, 2


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed: high planes of small numbers vanish."""
    raw = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = pa.decompress(packed[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()


def _pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """56-bit hashes of word pairs from the words' 64-bit hashes."""
    x = before * np.uint64(0x9E3779B97F4A7C15) ^ (word >> np.uint64(29) ^ word) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(30)) >> np.uint64(8)


class _Block:
    """Documents of a block: ids, roles, lengths, their tokens as places in a list of distinct word hashes (the end is place 0)."""

    def __init__(self, seq, lengths, roles, hashes):
        from xxhash import xxh64_intdigest

        self.lengths, self.roles = lengths.astype(np.int64), roles.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.words, self.place = np.unique(hashes, return_inverse=True)
        self.word = self.place[seq]  # of each token, among the sorted distinct words
        before = np.concatenate([[0], self.word[:-1]])
        context = self.words[before]
        context[self.first] = np.uint64(xxh64_intdigest(BEGIN))
        self.before, self.starts = before, np.zeros(len(seq), bool)
        self.starts[self.first] = True
        self.pairs, self.pair = np.unique(_pairs(context, self.words[self.word]), return_inverse=True)
        self.role = np.repeat(self.roles, self.lengths)

    def own(self, kind: int, role: int) -> np.ndarray:
        where, n = ((self.word, len(self.words)), (self.pair, len(self.pairs)))[kind]
        return np.bincount(where[self.role == role], minlength=n).astype(np.uint64)


def _blocks(most: int):
    """Rows of (id, text, role) to blocks. Documents of role EM get blocks of their own; a block is closed after `most` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        part, made = TaskContext.get().partitionId(), 0
        kept = {held: ([], [], [], [], {END: 0}) for held in (False, True)}
        size = {False: 0, True: 0}

        def close(held: bool):
            nonlocal made
            seqs, lengths, ids, roles, words = kept[held]
            seq = np.concatenate(seqs)
            hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
            row = {
                "block": pa.array([part << 24 | made], pa.int64()), "held": pa.array([held]), "ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([np.array(lengths, "<u8").tobytes()], pa.binary()),
                "roles": pa.array([np.array(roles, np.uint8).tobytes()], pa.binary()), "seq": pa.array([_pack(seq)], pa.binary()), "words": pa.array([hashes.astype("<u8").tobytes()], pa.binary()),
                "tokens": pa.array([len(seq)], pa.int64()), "trained": pa.array([sum(n for n, r in zip(lengths, roles, strict=True) if r != ONLY)], pa.int64()), "fitted": pa.array([sum(n for n, r in zip(lengths, roles, strict=True) if r == FIT)], pa.int64()),
                "docs": pa.array([sum(r != ONLY for r in roles)], pa.int64()), "fit_docs": pa.array([sum(r == FIT for r in roles)], pa.int64()),
            }
            made += 1
            kept[held], size[held] = ([], [], [], [], {END: 0}), 0
            return pa.record_batch(row)

        for batch in batches:
            roles, ids = batch.column("role").to_pylist(), batch.column("id").to_pylist()
            for i, text in enumerate(batch.column("text")):
                held = roles[i] == EM
                seqs, lengths, own_ids, own_roles, words = kept[held]
                found = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                seq = [words.setdefault(w, len(words)) for w in found]
                seq.append(0)
                seqs.append(np.array(seq, np.uint32))
                lengths.append(len(seq))
                own_ids.append(ids[i])
                own_roles.append(roles[i])
                size[held] += len(seq)
                if size[held] >= most:
                    yield close(held)
        for held in (False, True):
            if size[held]:
                yield close(held)

    return run


def _open(row: dict) -> _Block:
    return _Block(_unpack(row["seq"]).astype(np.int64), np.frombuffer(row["lengths"], "<u8"), np.frombuffer(row["roles"], np.uint8), np.frombuffer(row["words"], "<u8"))


_REQUEST = {"kind": pa.int32(), "range": pa.int64(), "node": pa.int64(), "names": pa.binary(), "fit": pa.binary(), "held": pa.binary()}
_ASKED = "kind int, range long, node long, names binary, fit binary, held binary"
_BITS = (64, 56)


def _requests(kind: int, node: int, names: np.ndarray, fit: np.ndarray, held: np.ndarray, within: int, fan: int, level: int) -> list[tuple]:
    """Sorted names of range `within` of the level before, dealt out to the `fan` ranges that it is cut into at this level."""
    parts = fan**level
    edges = np.array([((within * fan + r) << _BITS[kind]) // parts for r in range(1, fan)], np.uint64)
    cuts = [0, *np.searchsorted(names, edges).tolist(), len(names)]
    return [(kind, within * fan + r, node, _pack(np.diff(names[a:b], prepend=np.uint64(0))), _pack(fit[a:b]), _pack(held[a:b])) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def _ask(fan: int):
    """Blocks to requests: for each range of hashes the block's own, in order, with its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _open(row)
                for kind, names in ((0, block.words), (1, block.pairs)):
                    out = _requests(kind, row["block"], names, block.own(kind, FIT), block.own(kind, EM), 0, fan, 1)
                    yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(_REQUEST.values())], list(_REQUEST))

    return run


def _summed(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct names of requests for one range, each request's places among them, and their sums as [fit, held]."""
    names = [np.cumsum(_unpack(r["names"]), dtype=np.uint64) for r in rows]
    ends = np.cumsum([len(n) for n in names])
    distinct, place = np.unique(np.concatenate(names), return_inverse=True)
    del names
    sums = [np.bincount(place, weights=np.concatenate([_unpack(r[what]) for r in rows]).astype(np.float64), minlength=len(distinct)).astype(np.uint64) for what in ("fit", "held")]
    return distinct, [place[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], sums


def _pass_on(fan: int, level: int):
    """All requests of a node to its own, for the ranges of this level."""

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        kind, within, group = (k.as_py() for k in key)
        distinct, _, (fit, held) = _summed(asked.to_pylist())
        out = _requests(kind, group, distinct, fit, held, within, fan, level)
        return pa.table([pa.array([o[i] for o in out], k) for i, k in enumerate(_REQUEST.values())], list(_REQUEST))

    return run


def _told(rows: list[dict], places: list[np.ndarray], totals: list[np.ndarray], trained: int) -> pa.Table:
    return pa.table({
        "kind": pa.array([r["kind"] for r in rows], pa.int32()), "range": pa.array([r["range"] for r in rows], pa.int64()), "node": pa.array([r["node"] for r in rows], pa.int64()),
        "fit": pa.array([_pack(totals[0][p]) for p in places], pa.binary()), "held": pa.array([_pack(totals[1][p]) for p in places], pa.binary()), "trained": pa.array([trained] + [0] * (len(rows) - 1), pa.int64()),
    })


_ANSWERED = "kind int, range long, node long, fit binary, held binary, trained long"


def _answer(asked: pa.Table) -> pa.Table:
    """All requests of one kind and range to answers: totals in the order of each request's names, and how many names were trained on."""
    rows = asked.to_pylist()
    _, places, totals = _summed(rows)
    return _told(rows, places, totals, int(((totals[0] + totals[1]) > 0).sum()))


def _hand_down(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """A node's requests and the answers to those that it sent on, to answers to the former."""
    rows = asked.to_pylist()
    _, places, _ = _summed(rows)
    above = sorted(answers.select(["range", "fit", "held"]).to_pylist(), key=lambda r: r["range"])
    return _told(rows, places, [np.concatenate([_unpack(r[what]) for r in above]) for what in ("fit", "held")], 0)


def _exchange(content: DataFrame, blocks: int, ranges: int) -> tuple[DataFrame, int]:
    """(kind, range, block, fit, held): totals in the order of each block's names, by ranges in order; and the number of words trained on."""
    levels = next(n for n in range(1, 65) if FANOUT**n >= ranges)
    fan = next(f for f in range(max(1, int(ranges ** (1 / levels)) - 1), ranges + 1) if f**levels >= ranges)
    asked = content.mapInArrow(_ask(fan), _ASKED)
    groups, below = blocks, []
    for level in range(2, levels + 1):
        groups = max(1, -(-groups // fan))
        asked = written(asked.withColumn("group", F.pmod(F.xxhash64("node"), F.lit(groups))), f"requests-{level}")
        below.append(asked)
        asked = asked.groupBy("kind", "range", "group").applyInArrow(_pass_on(fan, level), _ASKED)
    if below:
        asked = written(asked, "requests")
    answers = written(asked.groupBy("kind", "range").applyInArrow(_answer, _ANSWERED), "answers")
    types = answers.filter("kind = 0").agg(F.coalesce(F.sum("trained"), F.lit(0))).first()[0]
    for asked in reversed(below):
        told = answers.select("kind", F.floor(F.col("range") / fan).alias("within"), F.col("node").alias("group"), "range", "fit", "held")
        answers = written(asked.groupBy("kind", "range", "group").cogroup(told.groupBy("kind", "within", "group")).applyInArrow(_hand_down, _ANSWERED), "answers")
    return answers.select("kind", "range", F.col("node").alias("block"), "fit", "held"), types


def _totals(answers: pa.Table) -> list[list[np.ndarray]]:
    """[words, pairs], each as [fit, held] in the order of the block's names."""
    rows = sorted(answers.select(["kind", "range", "fit", "held"]).to_pylist(), key=lambda r: (r["kind"], r["range"]))
    return [[np.concatenate([_unpack(r[what]) for r in rows if r["kind"] == kind]).astype(np.float64) for what in ("fit", "held")] for kind in (0, 1)]


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(count + 1)).astype(np.int64), BUCKETS - 1)


def _histogram(fit_tokens: int, fit_docs: int):
    """Held-out blocks to how often each (bucket of the context, step of the pair's estimate, step of the word's) occurs; -1: never seen."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        counts = np.zeros(0, np.int64)
        for row in blocks.to_pylist():
            block = _open(row)
            (word, _), (pair, _) = _totals(answers)
            context = np.where(block.starts, float(fit_docs), word[block.before])
            with np.errstate(divide="ignore", invalid="ignore"):
                two = np.where(pair[block.pair] > 0, np.round(-STEPS * np.log2(pair[block.pair] / context)), -1)
                one = np.where(word[block.word] > 0, np.round(-STEPS * np.log2(word[block.word] / fit_tokens)), -1)
            counts = np.concatenate([counts, _bucket(context) << 32 | (two.astype(np.int64) + 1) << 16 | one.astype(np.int64) + 1])
        keys, n = np.unique(counts, return_counts=True)
        return pa.table({"cell": pa.array(keys, pa.int64()), "n": pa.array(n.astype(np.int64), pa.int64())})

    return run


def learn_weights(cells: list[tuple[int, int]], types: int) -> np.ndarray:
    """Weights (bucket; pair, word, uniform) by EM on the held-out histogram. Buckets without held-out tokens borrow those below."""
    out = np.tile(np.array([0.4, 0.5, 0.1]), (BUCKETS, 1))
    out[0] = [0.0, 0.9, 0.1]
    if not cells:
        return out
    cell, n = np.array(cells, np.int64).T
    bucket, two, one = cell >> 32, (cell >> 16 & 0xFFFF) - 1, (cell & 0xFFFF) - 1
    p = np.stack([np.where(two >= 0, 2.0 ** (-two / STEPS), 0.0), np.where(one >= 0, 2.0 ** (-one / STEPS), 0.0), np.full(len(n), 1.0 / (types + 1))], axis=1)
    for _ in range(ROUNDS):
        part = out[bucket] * p
        part *= (n / part.sum(axis=1))[:, None]
        # A little of the start is kept, so that no weight vanishes on few tokens.
        fresh = np.stack([np.bincount(bucket, weights=part[:, i], minlength=BUCKETS) for i in range(3)], axis=1) + 0.01 * np.array([0.4, 0.5, 0.1])
        fresh[0, 0] = 0.0
        out = fresh / fresh.sum(axis=1, keepdims=True)
    seen = np.bincount(bucket, weights=n, minlength=BUCKETS)
    for b in range(2, BUCKETS):
        if not seen[b]:
            out[b] = out[b - 1]
    return out


def _score(tokens: int, docs: int, types: int, weights: list[list[float]]):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        mix = np.array(weights)
        out: list[pa.Table] = []
        for row in blocks.to_pylist():
            block = _open(row)
            word, pair = (fit + held for fit, held in _totals(answers))
            context = np.where(block.starts, float(docs), word[block.before])
            own = word[block.word]
            base = np.log10((own + 1) / (tokens + types + 1))
            m = mix[_bucket(context)]
            p = m[:, 0] * pair[block.pair] / np.maximum(context, 1) + m[:, 1] * own / max(tokens, 1) + m[:, 2] / (types + 1)
            total = lambda x: np.add.reduceat(x, block.first)  # noqa: E731, B023
            out.append(pa.table({"id": pa.array(row["ids"], pa.int64()), "role": pa.array(block.roles, pa.int32()), "n_tokens": pa.array(block.lengths), "n_known": pa.array(total((own > 0).astype(np.int64))), "base_score": pa.array(total(base)), "score": pa.array(total(np.log10(p)))}))
        return pa.concat_tables(out)

    return run


def score_text(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, learned (the model learned from it), n_tokens, n_known, train_tokens, base_score, score of every document.

    Tokens are the words (A-Z lower-cased, split at ASCII white space), then one end. score is the model's log10 probability of
    the text, base_score that of add-one unigrams. Null and empty texts are one end token. If nothing can be learned from, both
    scores are those of a uniform choice among one type. A null id is kept; repeated rows are counted and scored each; an empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    role = F.when(~F.coalesce(learn, F.lit(False)), ONLY).when(F.pmod(F.xxhash64(F.lit("held out"), name), F.lit(HELD)) == 0, EM).otherwise(FIT)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), role.cast("int").alias("role"))
    blocks = written(rows.mapInArrow(_blocks(BLOCK), "block long, held boolean, ids array<long>, lengths binary, roles binary, seq binary, words binary, tokens long, trained long, fitted long, docs long, fit_docs long"), "blocks")
    size = blocks.agg(F.count("*").alias("blocks"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "trained", "fitted", "docs", "fit_docs")]).first()
    ranges = max(2 * shuffle_partitions(spark), -(-size["tokens"] // ENTRIES))
    content = blocks.select("block", "held", "ids", "lengths", "roles", "seq", "words")
    told, types = _exchange(content.select("block", "lengths", "roles", "seq", "words"), size["blocks"], ranges)
    held = content.filter("held")
    cells = held.groupBy("block").cogroup(told.join(held.select("block"), "block", "left_semi").groupBy("block")).applyInArrow(_histogram(size["fitted"], size["fit_docs"]), "cell long, n long")
    weights = learn_weights([(r["cell"], r["n"]) for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()], types)
    scored = content.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(size["trained"], size["docs"], types, weights.tolist()), "id long, role int, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), (F.col("role") != ONLY).alias("learned"), "n_tokens", "n_known", F.lit(size["trained"]).cast("long").alias("train_tokens"), "base_score", "score")
