"""What is kept: stored tables by their contents, tables in memory no longer than they are needed."""

import pytest
from pyspark.sql import functions as F

from querysmith.config import RunConfig
from querysmith.operators import index, optimal, search
from querysmith.plans.dataset import Dataset, contained
from querysmith.plans.loop import play
from querysmith.sources import tables
from querysmith.sources.store import read_text, write_text


def held(spark) -> int:
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def sides(spark, local: str, external: str):
    schema = "id string, text string"
    return spark.createDataFrame([("l:1", local)], schema), spark.createDataFrame([("e:1", external), ("e:2", "apple sea")], schema), spark.createDataFrame([("l:1", "e:1")], "local_id string, external_id string")


def test_datasets_and_settings_share_a_folder(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    first, second = sides(spark, "red apple pie", "apple pie"), sides(spark, "blue whale sea", "whale sea")
    terms = lambda d: {r.keyword for r in d.local_signals.collect()}
    weights = lambda d: {(r.keyword, r.id): round(r.w, 6) for r in d.weighted.collect()}
    assert terms(Dataset(*first, store=store)) == {"red", "apple", "pie"}
    assert terms(Dataset(*second, store=store)) == {"blue", "whale", "sea"}
    for how in ({}, {"scorer": "tfidf"}, {"scorer": "overlap_count"}):
        for tables_ in (first, second):
            assert weights(Dataset(*tables_, store=store, **how)) == weights(Dataset(*tables_, **how))
    stemmed = (spark.createDataFrame([("l:1", "running runs")], "id string, text string"), *first[1:])
    assert terms(Dataset(*stemmed, store=store)) == {"running", "runs"} and terms(Dataset(*stemmed, store=store, stem=True)) == {"run"}


def test_what_is_stored_is_read_and_not_made_again(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/t"
    for manifest, times in (({"a": 1}, 1), ({"a": 1}, 1), ({"a": 2}, 2), ({"a": 1}, 2)):
        assert tables.cached_table(spark, path, make, manifest=manifest).count() == 3 and len(made) == times
    # A table that says to be something else is written anew, and so is one without a manifest.
    at = next(p for p in tmp_path.iterdir() if (p / "_manifest.json").read_text() == '{"a": 1}')
    write_text(spark, f"file://{at}/_manifest.json", '{"a": 3}')
    assert tables.cached_table(spark, path, make, manifest={"a": 1}).count() == 3 and len(made) == 3
    assert read_text(spark, f"file://{at}/_manifest.json") == '{"a": 1}' and read_text(spark, f"file://{at}/_none") is None


def test_fingerprints(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), ("b", "x"), (None, "")], "id string, text string")
    same = tables.fingerprint(df)
    assert tables.fingerprint(df.repartition(3).sort("text")) == same
    others = [df.distinct(), df.fillna(""), df.withColumnRenamed("text", "t"), df.limit(0), df.withColumn("text", F.col("text").cast("binary")), spark.createDataFrame([("a", None), ("b", "x"), ("x", "b"), (None, "")], df.schema)]
    assert len({same, *map(tables.fingerprint, others)}) == len(others) + 1


def test_a_version_spares_the_pass(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    first, second = sides(spark, "red apple", "pie"), sides(spark, "blue whale", "sea")
    assert Dataset(*first, store=store, version="1").local_signals.count() == 2
    # Contents are vouched for by the user: another dataset needs another version.
    assert {r.keyword for r in Dataset(*second, store=store, version="2").local_signals.collect()} == {"blue", "whale"}


@pytest.mark.parametrize("how", ["contained", "optimal", "play"])
def test_no_table_stays_in_memory(spark, how):
    local, external, truth = sides(spark, "ab apple", "ab apple pie")
    before = held(spark)
    if how == "contained":
        assert contained(local.union(spark.createDataFrame([("l:2", "ab")], local.schema)), external).count() == 2
    elif how == "optimal":
        sig = index.signals(index.occurrences(external))
        found = optimal.optimal_queries(index.signals(index.occurrences(local)), truth, sig, search.weighted_postings(index.postings(sig)), 1, 3)
        assert [found[n].count() for n in (1, 2, 3)] == [1, 1, 0]
    else:
        data = Dataset(local, external, truth)
        assert play(data, RunConfig(interactions=4, query_length=1, batch=2)).count() == 4
        data.close()
    assert held(spark) == before
