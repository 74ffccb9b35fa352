import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from querysmith.llm import interpolated_lm as lm


def corpus(n=80):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    return [(i, " ".join(draw.choices(words, weights=[1 / (k + 1) for k in range(40)], k=draw.randint(0, 60))).capitalize()) for i in range(n)]


def tokens(text):
    return [*(text or "").encode().lower().split(), lm.END]


@pytest.mark.parametrize(("block", "entries", "fanout"), [(50, 4_000_000, 512), (3_000_000, 4_000_000, 512), (50, 100, 5), (200, 60, 3)])
def test_against_brute_force(spark, monkeypatch, block, entries, fanout):
    """One block and many; one level and several (2 of 25 ranges, 4 of 81)."""
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "ENTRIES", entries)
    monkeypatch.setattr(lm, "FANOUT", fanout)
    rows = [*corpus(), (200, None), (201, ""), (None, "no id w1"), (304, "w1 w2"), (304, "w1 w2"), (302, "unseen w1 é")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, score int").repartition(3)
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 7 != 2
    seen: list = []
    monkeypatch.setattr(lm, "learn_weights", lambda cells, types, keep=lm.learn_weights: seen.append(keep(cells, types)) or seen[-1])
    out = lm.score_text(df, learn).collect()
    assert len(out) == len(rows)
    train = [t for i, t in rows if (i or 0) % 7 != 2]
    one = Counter(w for t in train for w in tokens(t))
    two = Counter(p for t in train for p in zip([lm.BEGIN, *tokens(t)], tokens(t), strict=False))
    n, v = sum(one.values()), len(one)
    weights = seen[0]

    def score(text):
        total = 0.0
        for before, word in zip([lm.BEGIN, *tokens(text)], tokens(text), strict=False):
            c = len(train) if before == lm.BEGIN else one[before]
            a, b, u = weights[min(int(math.log2(c + 1)), lm.BUCKETS - 1)]
            total += math.log10(a * two[before, word] / max(c, 1) + b * one[word] / n + u / (v + 1))
        return total

    texts = {i: t for i, t in rows}
    for r in out:
        t = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.learned) == (len(t), sum(one[w] > 0 for w in t), n, (r.doc_id or 0) % 7 != 2)
        assert abs(r.base_score - sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)) < 1e-9
        assert abs(r.score - score(texts[r.doc_id])) < 1e-9


def test_weights_sum_to_one_and_raise_likelihood():
    draw = np.random.default_rng(0)
    cells = [(int(draw.integers(0, 6)) << 32 | int(draw.integers(0, 30)) << 16 | int(draw.integers(0, 60)), int(draw.integers(1, 50))) for _ in range(300)]
    w = lm.learn_weights(cells, 1000)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w[0, 0] == 0


def test_rows_grow_with_tokens(spark, monkeypatch):
    """Three sizes: the rows of requests over all levels grow with the blocks, not with blocks times ranges."""
    monkeypatch.setattr(lm, "BLOCK", 100)
    monkeypatch.setattr(lm, "ENTRIES", 150)
    monkeypatch.setattr(lm, "FANOUT", 6)
    rows, draw, keep = [], random.Random(8), lm.written
    tables: list = []
    monkeypatch.setattr(lm, "written", lambda df, label: (tables.append((label, out := keep(df, label))), out)[1])
    for size in (50, 200, 800):
        texts = [" ".join(f"x{draw.randrange(10**6)}" for _ in range(50)) for _ in range(size)]
        tables.clear()
        lm.score_text(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4), F.lit(True))
        assert sum(df.count() for label, df in tables if label == "blocks") > size / 3
        rows.append(sum(df.count() for label, df in tables if label.startswith("requests")) / size)
    assert rows[0] > 0 and rows[2] < 4 * rows[0]  # a row for each block and range would be 16 times as many a document


def test_very_long_text(spark):
    text = "w1 w2 " * 200_000
    row = lm.score_text(spark.createDataFrame([(1, text), (2, "w1")], "doc_id long, text string"), F.lit(True)).filter("doc_id = 1").first()
    assert row.n_tokens == 400_001 and row.n_known == row.n_tokens and math.isfinite(row.score)


def test_steps_of_em_hardly_matter():
    """Weights from estimates in quarter octaves against the same from unrounded ones."""
    draw = np.random.default_rng(1)
    p = [(2.0 ** -draw.uniform(0, 6), 2.0 ** -draw.uniform(4, 14)) for _ in range(2000)]
    cells = [(3 << 32 | (round(-lm.STEPS * math.log2(a)) + 1 if i % 3 else 0) << 16 | round(-lm.STEPS * math.log2(b)) + 1, 1) for i, (a, b) in enumerate(p)]
    got, w = lm.learn_weights(cells, 1000)[3], np.array([0.4, 0.5, 0.1])
    exact = np.array([[a if i % 3 else 0.0, b, 1 / 1001] for i, (a, b) in enumerate(p)])
    for _ in range(lm.ROUNDS):
        part = exact * w
        w = (part / part.sum(axis=1, keepdims=True)).sum(axis=0)
        w /= w.sum()
    assert np.abs(got - w).max() < 0.01


def test_packing_numbers():
    for numbers in ([], [0], [2**63, 5, 2**64 - 1], list(range(1000))):
        assert lm._unpack(lm._pack(np.array(numbers, np.uint64))).tolist() == numbers


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lm.score_text(df, F.lit(False)).first()
    assert row.n_known == 0 and row.train_tokens == 0 and math.isfinite(row.score)
    assert lm.score_text(df.limit(0), F.lit(True)).count() == 0
