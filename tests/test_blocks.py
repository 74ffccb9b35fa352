"""Search by blocks: the rows of the plain search, from a part of the postings."""

import random

import pytest
from pyspark.sql import functions as F

from querysmith.config import RunConfig
from querysmith.operators import blocks, index, search
from querysmith.operators.ranking import with_rank_within
from querysmith.plans.dataset import Dataset
from querysmith.plans.loop import play


def postings(spark, seed, documents):
    """Lists of all lengths, weights that repeat, a word in every document."""
    r = random.Random(seed)
    rows = []
    for word, share in (("every", 1.0), ("most", 0.6), ("some", 0.1), ("few", 12 / documents), ("one", 0.0)):
        own = range(documents) if share == 1 else r.sample(range(documents), max(1, int(share * documents)))
        rows += [(word, f"d{i}", r.choice([0.25, 0.5, round(r.random(), 3), r.random()]) * (1 if word in ("every", "most") else 4)) for i in own]
    return spark.createDataFrame(rows, "keyword string, id string, w double").repartition(5)


QUERIES = [(1, "every"), (2, "one"), (3, "every"), (3, "few"), (4, "every"), (4, "most"), (5, "some"), (5, "most"), (5, "few"), (5, "every"), (6, "none"), (7, "every"), (7, "none"), (7, "every"), (8, "some"), (8, "some")]


@pytest.mark.parametrize("seed,k,size", [(1, 5, 8), (2, 20, 8), (3, 1, 64), (4, 3000, 16)])
def test_rows_are_those_of_the_plain_search(spark, seed, k, size):
    weighted = postings(spark, seed, 1500).persist()
    queries = spark.createDataFrame([(str(i), w) for i, w in QUERIES], "intent_id string, keyword string")
    found, read = blocks.search(queries, blocks.build(weighted, size), k)
    rows = lambda df: sorted((r.intent_id, r["rank"], r.external_id, r.score) for r in df.collect())
    assert rows(found) == rows(search.search(queries, weighted, k))
    there = {r.intent_id: (r.postings_read, r.postings) for r in read.collect()}
    counts = {r.keyword: r["n"] for r in weighted.groupBy("keyword").agg(F.count("*").alias("n")).collect()}
    wanted = {}
    for i, w in set(QUERIES):
        wanted[str(i)] = wanted.get(str(i), 0) + counts.get(w, 0)
    assert {i: n for i, (_, n) in there.items()} == {i: n for i, n in wanted.items() if n}
    if k <= 5:
        # A word in every document isn't read whole, alone or beside a rare one.
        assert there["1"][0] <= 4 * size + k and there["3"][0] < 0.5 * there["3"][1]
    weighted.unpersist()


def test_more_documents_are_read_less(spark):
    shares = []
    for documents in (500, 8000):
        queries = spark.createDataFrame([("3", "every"), ("3", "few")], "intent_id string, keyword string")
        _, read = blocks.search(queries, blocks.build(postings(spark, 9, documents), 8), 5)
        shares.append(read.selectExpr("postings_read / postings AS s").first().s)
    assert shares[1] < 0.25 * shares[0]


def test_blocks_hold_every_posting_once(spark):
    weighted = postings(spark, 5, 700)
    built = blocks.build(weighted, 16)
    held = built.blocks.select("keyword", "tier", "sub", F.inline("postings"))
    assert sorted(map(tuple, held.select("keyword", "id", "w").collect())) == sorted(map(tuple, weighted.collect()))
    assert held.filter(F.pmod(F.xxhash64("id"), F.expr("shiftleft(1L, tier)")) != F.col("sub")).count() == 0
    tiers = sorted(map(tuple, built.tiers.filter("keyword = 'every'").select("tier", "n", "top", "next_top").collect()))
    assert [n for _, n, _, _ in tiers] == [16, 32, 64, 128, 256, 204] and [t[3] for t in tiers] == [t[2] for t in tiers[1:]] + [0.0]
    assert built.blocks.agg(F.max("n")).first()[0] <= 16 * 3


def test_ranks_within_groups_over_many_partitions(spark):
    df = spark.createDataFrame([("a", i % 7, i) for i in range(300)] + [("b", 1, 1), (None, 2, 2)], "g string, x int, y int")
    ranks = {(r.g, r.y): r.rn for r in with_rank_within(df, "g", "x", "y").filter("g IS NOT NULL").collect()}
    assert [ranks["a", y] for y in sorted(range(300), key=lambda y: (y % 7, y))] == list(range(1, 301)) and ranks["b", 1] == 1


def test_nothing(spark):
    weighted = postings(spark, 6, 50)
    none = spark.createDataFrame([], "intent_id string, keyword string")
    for queries, rows in ((none, weighted), (none, weighted.limit(0)), (spark.createDataFrame([("1", "every")], none.schema), weighted.limit(0))):
        found, read = blocks.search(queries, blocks.build(rows), 5)
        assert found.count() == 0 and read.count() == 0


def test_a_run_with_skipping_has_the_same_log(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)) + " all"
    local = spark.createDataFrame([(f"l{i}", text(4)) for i in range(6)], "id string, text string")
    external = spark.createDataFrame([(f"e{i}", text(8)) for i in range(80)], "id string, text string")
    truth = spark.createDataFrame([(f"l{i}", f"e{i}") for i in range(6)], "local_id string, external_id string")
    logs = [play(Dataset(local, external, truth, skipping=s), RunConfig(interactions=6, query_length=2, batch=3, top_k_size=5)).orderBy("interaction").collect() for s in (False, True)]
    assert logs[0] == logs[1]


def test_index_of_signals(spark):
    docs = spark.createDataFrame([("d1", "x y"), ("d2", "x x z w"), ("d3", "q")], "id string, t string")
    weighted = search.weighted_postings(index.postings(index.signals(index.occurrences(docs, stop=False))), "tfidf")
    queries = spark.createDataFrame([("i", "x"), ("i", "z"), ("j", "q")], "intent_id string, keyword string")
    got = blocks.search(queries, blocks.build(weighted), 20)[0]
    assert sorted(map(tuple, got.select("intent_id", "external_id", "score", "rank").collect())) == sorted(map(tuple, search.search(queries, weighted).select("intent_id", "external_id", "score", "rank").collect()))
