import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from querysmith.llm import hilbert as h


@pytest.mark.parametrize(("d", "bits"), [(2, 3), (3, 2), (2, 1), (4, 2)])
def test_curve_visits_neighbours(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    keys = h.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(1 << bits * d))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(rows, k):
    best = {}
    for i, v in rows:
        if i % 5 == 0:
            own = sorted(((-float(h.cosines(np.array([v]), np.array([w]))[0]), j) for j, w in rows if j != i))[:k]
            best[i] = [(j, -s) for s, j in own]
    return best


def data(n=400, d=16, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=d).round(3).tolist()) for i in range(n)]


def found(df, **how):
    out: dict = {}
    for r in sorted(h.nearest(df, F.col("vec_id") % 5 == 0, k=5, **how).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_exact(spark):
    rows = data()
    rows += [(400 + i, rows[7][1]) for i in range(20)] + [(500 + i, (np.array(rows[3][1]) * 2).tolist()) for i in range(6)]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)), brute(rows, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]


def test_windows_alone_find_clusters(spark):
    """On vectors with structure the curves' windows find most neighbours themselves."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 8))
    rows = [(i, (centres[i % 60] + 0.01 * rng.normal(size=8)).tolist()) for i in range(1800)]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), exact=False), brute(rows, 5)
    recall = np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 5 for q in want])
    assert recall > 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (None, [1.0, 0.0], 1), (10, [1e200, 1e200], 1), (10, [1e200, 1e200], 1), (15, [-1e-200, 0.0], None)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"))
    assert {q: [j for j, _ in v] for q, v in got.items()} == {0: [1, 10, 15], 10: [1, 0, 15], 15: [1, 10, 0]} or {q: [j for j, _ in v] for q, v in got.items()} == {0: [1, 10, 15], 10: [1, 0, 15], 15: [10, 1, 0]}
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert h.nearest(empty, F.lit(True)).count() == 0


def test_fewer_candidates_than_k(spark):
    got = found(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>"))
    assert [j for j, _ in got[0]] == [1]


def test_repeated_rows_take_no_places(spark):
    """A clustered table whose rows are all there six times, and ids that have several vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.02 * rng.normal(size=8)).tolist()) for i in range(360)]
    near = [(1000 + i % 3, (np.array(rows[0][1]) + 0.001 * rng.normal(size=8)).tolist()) for i in range(24)]
    for once, times in ((rows, 6), (rows + near, 2)):
        want = {}
        for i, v in once:
            for j, w in once if i % 5 == 0 else ():
                if i != j:
                    own = want.setdefault(i, {})
                    own[j] = max(own.get(j, -2), float(h.cosines(np.array([v]), np.array([w]))[0]))
        table = once * times
        got = found(spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(5))
        assert got.keys() == want.keys()
        for q, own in want.items():
            best = sorted((-s, j) for j, s in own.items())[:5]
            assert [j for j, _ in got[q]] == [j for _, j in best]
            assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in best], abs=1e-12)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
@pytest.mark.parametrize(("sf", "curves", "least"), [("sf0.01", 4, 0.8), ("sf0.01", 16, 0.99), ("sf0.1", 4, 0.4), ("sf0.1", 16, 0.88)])
def test_recall_of_the_windows_on_vectors_without_structure(spark, sf, curves, least):
    """What the curves find by themselves; the default (4 curves) needs the completing pass, which finds all."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    unit, ids = np.stack([v / np.linalg.norm(v) for _, v in rows]), np.array([i for i, _ in rows])
    got: dict = {}
    for r in h.nearest(df, F.col("vec_id") % 50 == 0, exact=False, curves=curves).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        score[q] = -2
        hits.append(len(got[ids[q]] & set(ids[np.argsort(-score)[:5]].tolist())) / 5)
    assert np.mean(hits) >= least


def test_groups_of_queries_are_bounded_in_bytes(spark, monkeypatch):
    rows = data(300, 8, 2)
    monkeypatch.setattr(h, "BYTES", 8 * 8 * 20)  # 20 queries a group, of 60
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)), brute(rows, 5)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
