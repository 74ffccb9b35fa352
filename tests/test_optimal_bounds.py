"""Sets of three and four terms: the best ones are those of measuring all, of fewer sets."""

import random

import pytest

from querysmith.operators import optimal


def case(spark, seed):
    r = random.Random(seed)
    words = [f"w{i:02d}" for i in range(14)]
    overlap = [(f"l{e}", w) for e in range(4) for w in r.sample(words, r.randint(2, 9))]
    weighted = [(w, f"d{d}", r.choice([0.5, 1.0, round(r.random() * 3, 2), r.random() * 3])) for w in words for d in r.sample(range(60), r.randint(4, 50))]
    truth = [(f"l{e}", f"d{r.randrange(60)}") for e in range(4) for _ in range(r.randint(1, 3))] + [("l0", "d1"), ("l0", "d1"), ("l9", "d2")]
    return [spark.createDataFrame(rows, schema).repartition(3) for rows, schema in ((overlap, "local_id string, keyword string"), (weighted, "keyword string, id string, w double"), (truth, "local_id string, external_id string"))]


@pytest.mark.parametrize("seed,size", [(1, 3), (2, 3), (3, 4)])
def test_best_sets_are_those_of_all(spark, seed, size):
    overlap, weighted, truth = case(spark, seed)
    best = lambda sets: sorted((r.local_id, tuple(r.query), r.rr) for r in optimal.best_queries(optimal.reciprocal_ranks(sets, weighted, truth, 5)).collect())
    every = optimal.combinations(overlap, size)
    cut = optimal.bounded_sets(overlap, weighted, truth, size, 5, seeds=3)
    assert best(cut) == best(every) and best(every)
    assert cut.join(every, ["local_id", "query"], "left_anti").count() == 0 and cut.count() == cut.distinct().count()
    assert cut.count() < 0.8 * every.count()


def test_few_terms_make_no_sets(spark):
    overlap, weighted, truth = case(spark, 4)
    few = overlap.groupBy("local_id").agg({"keyword": "min"}).withColumnRenamed("min(keyword)", "keyword")
    assert optimal.bounded_sets(few, weighted, truth, 3).count() == 0
    assert optimal.bounded_sets(overlap.limit(0), weighted, truth, 3).count() == 0
