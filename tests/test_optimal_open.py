"""Queries that the heads of their terms leave open."""

import random

import pytest

from querysmith.operators import index, optimal, search


def rows(df):
    return sorted((x.local_id, tuple(x.query), round(x.rr, 9)) for x in df.collect())


def written(spark, make):
    """Records that a job's stages shuffled."""
    spark.sparkContext.setJobGroup(name := f"open-{random.random()}", name)
    make()
    spark.sparkContext.setJobGroup("rest", "rest")
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def case(spark, words, docs, entities, seed, values):
    r = random.Random(seed)
    names = [f"w{i:02d}" for i in range(words)]
    weighted = [(w, f"d{d}", r.choice(values)) for w in names for d in range(docs) if r.random() < 0.9]
    overlap = [(f"l{e}", w) for e in range(entities) for w in names]
    truth = [(f"l{e}", f"d{r.randrange(docs)}") for e in range(entities) for _ in range(3)] * 2
    schemas = "local_id string, keyword string", "keyword string, id string, w double", "local_id string, external_id string"
    return [spark.createDataFrame(*x) for x in zip((overlap, weighted, truth), schemas, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_and_groups_give_the_same_ranks(spark, monkeypatch, seed):
    # Weights of few values, zero among them: ties between documents, and matches that score nothing.
    overlap, weighted, truth = case(spark, 8, 50, 3, seed, [0.0, 0.5, 1.0, 1.25])
    monkeypatch.setattr(optimal, "BLOCK", 40)
    monkeypatch.setattr(optimal, "PACKED", 600)
    sets = optimal.combinations(overlap, 1).union(optimal.combinations(overlap, 2)).union(optimal.combinations(overlap, 3)).persist()
    expected = optimal.measured_by_join(sets, weighted, truth, 5).persist()
    assert rows(optimal.reciprocal_ranks(sets, weighted, truth, 5, 5)) == rows(expected)
    best = optimal.reciprocal_ranks(sets, weighted, truth, 5, 5, best_only=True)
    assert rows(optimal.best_queries(best, 10_000)) == rows(optimal.best_queries(expected, 10_000)) and best.count() < sets.count()


def test_open_queries_are_not_multiplied_by_postings(spark):
    # Documents that are high on one word each, and matches that are fairly high on all: first everywhere, but under the sum of the words' heads.
    names = [f"w{i:02d}" for i in range(12)]
    weighted = [(w, f"d{d}", 1.5 if d < 2 else 2.0 if d % 12 == i else 0.5) for i, w in enumerate(names) for d in range(400)]
    frames = [spark.createDataFrame(*x) for x in (([(f"l{e}", w) for e in range(2) for w in names], "local_id string, keyword string"), (weighted, "keyword string, id string, w double"), ([("l0", "d0"), ("l1", "d1")], "local_id string, external_id string"))]
    sets, found = optimal.combinations(frames[0], 3), []
    n = written(spark, lambda: found.extend(optimal.reciprocal_ranks(sets, *frames[1:], 20, 20).collect()))
    assert sorted({(r.local_id, r.rr) for r in found}) == [("l0", 1.0), ("l1", 0.5)] and len(found) == 440
    assert n < 40_000, n  # 440 sets of three terms with 400 postings each are 528,000


def test_words_that_are_not_asked_for_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(index, "FEW", 3)
    lists = spark.createDataFrame([(f"d{i}", [f"x{j}" for j in range(500)] + ["a", "b", "c", "d", "d"]) for i in range(40)], "id string, words array<string>")
    asked = spark.createDataFrame([(w,) for w in "abcdz"], "keyword string")
    found = []
    n = written(spark, lambda: found.extend(index.postings_of(lists, asked)))
    assert sorted((x.keyword, x.tf, x.dl) for x in found[0].collect()) == sorted([(w, 1 + (w == "d"), 505) for w in "abcd"] * 40)
    assert n < 1_000, n  # 20,000 words


def test_postings_are_not_shuffled_for_their_frequencies(spark):
    posts = spark.createDataFrame([(f"w{j}", f"d{i}", 1, 50) for i in range(60) for j in range(50)], "keyword string, id string, tf long, dl long")
    totals, found = spark.createDataFrame([(60, 50.0)], "n long, avgdl double"), []
    n = written(spark, lambda: found.extend(search.weighted_postings(posts, "tfidf", totals).collect()))
    assert len(found) == 3_000 and {r.w for r in found} == {0.0}
    assert n < 1_000, n  # 3,000 postings
