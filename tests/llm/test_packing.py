import zlib

import numpy as np
import pandas as pd
import pytest

from querysmith.llm import packing
from querysmith.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, extra int, source_size int"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def texts():
    rng = np.random.default_rng(1)
    words = ["the", "of", "naïve", "größe", "42", "don't", "<|endoftext|>", "  ", "\n", "x" * 40, "ß", "日本", "…", "🙂"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 120))), ["a", "b", "c"][i % 3] if i % 5 else "a", i, 0) for i in range(60)]
    return [*rows, (100, None, "a", None, None), (101, "", None, 1, 1), (102, "word " * 9000, "b", 1, 1), (None, "no id", "c", 1, 1), (3, "again", "a", 1, 1), (3, "again", "a", 1, 1)]


def check(rows, pieces, tokenizer, window):
    encoded = [np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows]
    assert pieces.length.sum() == sum(map(len, encoded))
    for key in {r[0] for r in rows}:
        own = [e for r, e in zip(rows, encoded, strict=True) if r[0] == key]
        found = pieces[pieces.doc_id.isna()] if key is None else pieces[pieces.doc_id == key]
        if len(own) == 1:
            found = found.sort_values("start")
            assert b"".join(found.ids) == own[0].tobytes() and (found.start == found.length.cumsum() - found.length).all()
        else:
            assert sorted(b"".join(found.ids)) == sorted(b"".join(o.tobytes() for o in own))
    sizes = []
    for _, seq in pieces.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset == seq.length.cumsum() - seq.length).all()
        sizes.append(int(seq.length.sum()))
    assert all(s == window or s & (s - 1) == 0 for s in sizes) and max(sizes) <= window
    assert sorted(pieces.sequence_id.unique()) == list(range(len(sizes)))


def test_round_trip(spark, tokenizer):
    rows = texts()
    pieces = packing.pack(spark.createDataFrame(rows, DOCS), tokenizer_path(), window=256, segment=64).toPandas()
    check(rows, pieces, tokenizer, 256)


def test_same_ids_as_tokenizers(tokenizer):
    encoder = packing._encoder(tokenizer_path())
    for _, text, *_ in texts():
        assert encoder.encode(text or "", allowed_special="all") == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_proportions_carry_over(spark):
    rows = [(i, "one two three four five", "a" if i % 4 else "b", 0, 0) for i in range(800)]
    pieces = packing.pack(spark.createDataFrame(rows, DOCS).repartition(7), tokenizer_path(), window=128, segment=8).toPandas()
    by = pieces.groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0).cumsum()
    share = by["b"] / by.sum(axis=1)
    assert ((share - 0.25).abs() * by.sum(axis=1) <= 16).all()  # never further from the target than a few items


def test_given_weights_come_first(spark):
    rows = [(i, "one two three four five", "a" if i % 2 else "b", 0, 0) for i in range(400)]
    pieces = packing.pack(spark.createDataFrame(rows, DOCS), tokenizer_path(), window=64, segment=8, weights={"a": 0.75, "b": 0.25}).toPandas()
    early = pieces[pieces.sequence_id < 8].groupby("source").length.sum()
    assert abs(early["a"] / early.sum() - 0.75) < 0.05
    assert pieces.length.sum() == 400 * len(packing._encoder(tokenizer_path()).encode("one two three four five")) + 400


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


def test_checksum_matches(spark):
    from pyspark.sql import functions as F

    pieces = packing.pack(spark.createDataFrame(texts(), DOCS), tokenizer_path()).withColumn("crc", F.crc32("ids")).toPandas()
    assert all(zlib.crc32(i) == c for i, c in zip(pieces.ids, pieces.crc, strict=True))
    assert isinstance(pieces, pd.DataFrame)


def test_sources_that_look_like_null(spark):
    rows = [(i, "one two three", s, 0, 0) for i, s in enumerate([None, "null", "=null", "", "\x00null", "=", None])]
    pieces = packing.pack(spark.createDataFrame(rows, DOCS), tokenizer_path()).toPandas()
    got = {int(r.doc_id): r.source for r in pieces.itertuples()}
    assert {i: None if s is None or s != s else s for i, s in got.items()} == {i: s for i, _, s, *_ in rows}


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, "c": 0.2}])
def test_against_a_round_robin_loop(spark, weights):
    """The closed form gives the items in the order of a scheduler that goes round by round with deficits."""
    draw = np.random.default_rng(6)
    rows = [(i, " ".join(["one", "two", "three"][k] for k in draw.integers(0, 3, draw.integers(1, 90))), "abc"[i % 7 % 3], 0, 0) for i in range(80)]
    window, segment = 64, 8
    tokens = packing.tokenized(spark.createDataFrame(rows, DOCS).coalesce(1), tokenizer_path())
    queues: dict[str, list] = {}
    for r in sorted(tokens.collect(), key=lambda r: r.rid):
        for start in range(0, r.n, segment):
            queues.setdefault(r.source, []).append((r.rid, start, min(segment, r.n - start)))
    whole = sum(n for q in queues.values() for *_, n in q)
    quantum = {s: window * (weights[s.removeprefix("=")] if weights else sum(n for *_, n in q) / whole) for s, q in queues.items()}
    order, deficit = [], dict.fromkeys(queues, 0.0)
    while any(queues.values()):
        for s in sorted(queues):
            if queues[s]:
                deficit[s] += quantum[s]
                while queues[s] and queues[s][0][2] <= deficit[s] + 1e-9:
                    deficit[s] -= queues[s][0][2]
                    order.append(queues[s].pop(0))
    pieces = sorted(packing.plan(tokens, window, segment, weights).collect(), key=lambda p: (p.sequence_id, p.offset))
    ids = lambda parts: [(rid, at) for rid, start, n in parts for at in range(start, start + n)]
    assert ids((p.rid, p.start, p.length) for p in pieces) == ids(order)
