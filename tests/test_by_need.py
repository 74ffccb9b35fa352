"""Postings of the asked words alone: the same results, without an index of all words."""

import random

from pyspark.sql import functions as F

from querysmith.config import PolicyConfig, RunConfig
from querysmith.functions import text as txt
from querysmith.operators import evaluate, index, optimal
from querysmith.plans.dataset import Dataset, contained
from querysmith.plans.loop import play
from querysmith.sources.tables import as_entities


def sides(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["the", "Cannot", "Gimme", "a--b"]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 30)))) for i in range(200)] + [(7, "w1 w2 w3"), (300, None), (301, "the")]
    local = [(i, docs[i * 3][1][:60]) for i in range(30)]
    return as_entities(spark.createDataFrame(local, "k long, text string"), "k", ["text"], "b:"), as_entities(spark.createDataFrame(docs, "k long, text string"), "k", ["text"], "d:")


def test_search_by_need_is_that_of_the_index(spark):
    local, external = sides(spark)
    truth = contained(local, external).persist()
    full, part = Dataset(local, external, truth), Dataset(local, external, truth, by_need=True)
    queries = full.local_signals.select(F.col("id").alias("intent_id"), "keyword").filter("keyword < 'w3'")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(part.search(queries)) == rows(full.search(queries)) != []
    assert {"external_occ", "weighted"}.isdisjoint(vars(part.prepare()))
    named = truth.select(F.col("external_id").alias("id"))
    assert rows(part.matched_signals) == rows(full.external_signals.join(named, "id", "left_semi"))


def test_tokens_are_written_once_and_matches_are_told_by_postings(spark, monkeypatch):
    local, external = sides(spark)
    passes, real = [], index.term_lists
    monkeypatch.setattr(index, "term_lists", lambda *a: passes.append(1) or real(*a))
    part = Dataset(local, external, contained(local, external).persist(), by_need=True)
    queries = part.local_signals.select(F.col("id").alias("intent_id"), "keyword", F.lit("text").alias("attr"), F.col("ord").alias("pos")).filter("keyword < 'w3'")
    first, held = part.searched(queries)
    part.searched(queries.filter("keyword < 'w2'"))[0].collect()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert len(passes) == 1 and "matched_signals" not in vars(part)
    assert rows(evaluate.rewards(queries, first, part.truth, held)) == rows(evaluate.rewards(queries, first, part.truth, part.matched_signals))
    assert {r.y > 0 for r in evaluate.rewards(queries, first, part.truth, held).collect()} == {True, False}


def test_borrowing_reads_matched_texts_alone(spark):
    local, external = sides(spark)
    truth = contained(local, external).persist()
    policy = PolicyConfig(supervised_term_borrowing=True, external_feat_specific=True)
    run = RunConfig(interactions=12, query_length=2, distribution="uniform", model="dataset_level", batch=6, policy=policy)
    logs = []
    for by_need in (False, True):
        data = Dataset(local, external, truth, by_need=by_need)
        logs.append(sorted((r.interaction, r.local_id, tuple(q.keyword for q in r.query), r.n_matches, round(r.rr, 9)) for r in play(data, run).collect()))
    assert logs[0] == logs[1] and any(x[-1] > 0 for x in logs[0])
    assert "matched_occ" not in vars(data)


def test_many_words_are_joined(spark, monkeypatch):
    local, external = sides(spark)
    part = Dataset(local, external, contained(local, external).persist(), by_need=True)
    rows = lambda few: (monkeypatch.setattr(index, "FEW", few), [sorted(map(tuple, df.collect())) for df in index.postings_of(part.term_lists, part.local_signals)])[1]
    assert rows(1_000) == rows(3) != [[], []]


def test_texts_are_looked_up_by_tokens(spark):
    r = random.Random(5)
    words = ["Alpha", "beta,", "«gamma»", "can--not", "cannot", "the", "--", "...", "d'e", "Σας", "x", "naïve", "I", "gonna!"]
    space = [" ", "\n", "\t ", "  "]
    docs = [(f"d:{i}", "".join(w for _ in range(r.randint(0, 40)) for w in (r.choice(words), r.choice(space)))) for i in range(80)] + [("d:1", "the beta, x"), ("d:n", None)]
    local = [(f"b:{i}", t[s : s + r.randint(0, 40)]) for i in range(120) for t in [docs[r.randrange(80)][1]] for s in [r.randint(0, len(t))]] + [("b:n", None)]
    frames = [spark.createDataFrame(rows, "id string, text string") for rows in (local, docs)]
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(contained(*frames, lists=index.term_lists(frames[1])))
    assert got == sorted({(a, d) for a, t in local for d, u in docs if t and u and t in u}) and len(got) > 200


def test_contractions_in_one_pass(spark):
    t = "cannot CANNOT gimmE gonna gotta lemme wanna cannots acannot can-not cannot-gonna x---y a--b ----"
    row = spark.createDataFrame([(t,)], "t string").select(txt.prepared(F.col("t"))).first()[0]
    assert row == "can not CAN NOT gim mE gon na got ta lem me wan na cannots acannot can-not can not-gon na x -- -y a -- b  --  -- "


def test_ranks_on_heads_are_those_of_all_postings(spark):
    r = random.Random(3)
    words = [f"w{i:02d}" for i in range(12)]
    weighted = [(w, f"d{d}", r.choice([0.5, 1.0, round(r.random() * 3, 2)])) for w in words for d in r.sample(range(60), r.randint(3, 50))]
    sets = [(f"l{e}", sorted(r.sample(words, n))) for e in range(3) for n in (1, 2, 2, 2, 3, 3, 3, 3)]
    truth = [(f"l{e}", f"d{r.randrange(60)}") for e in range(3) for _ in range(6)] * 2
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((sets, "local_id string, query array<string>"), (weighted, "keyword string, id string, w double"), (truth, "local_id string, external_id string"))]
    rows = lambda df: sorted((x.local_id, tuple(x.query), round(x.rr, 9)) for x in df.collect())
    frames[0] = frames[0].distinct()
    expected = rows(optimal.measured_by_join(*frames, 10))
    for head in (10, 20, 400):
        assert rows(optimal.reciprocal_ranks(*frames, 10, head)) == expected
    assert len({x[2] for x in expected}) > 2
