import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from querysmith.operators import bandit, buckets, evaluate, features, feedback, index, neural, optimal, sampling, search, selection
from querysmith.operators.ranking import with_rank


def entities(spark):
    return spark.createDataFrame([("1", "runner run", "run run"), ("2", "zeta", None), ("3", "", "")], "id string, title string, body string")


def test_index(spark):
    occ = index.occurrences(entities(spark))
    split = {(r.id, r.keyword, r.attr): (r.tf_attr, r.tf_total) for r in index.split_by_attribute(occ).collect()}
    assert split == {("1", "runner", "title"): (1, 1), ("1", "run", "title"): (1, 3), ("1", "run", "body"): (2, 3), ("2", "zeta", "title"): (1, 1)}
    weights = {r.keyword: r.idf for r in index.idf(index.signals(occ), entities(spark)).collect()}
    assert weights == {"runner": 1.0, "run": 1.0, "zeta": 1.0}
    same = spark.createDataFrame([("1", "a1"), ("2", "a1")], "id string, t string")
    assert index.idf(index.signals(index.occurrences(same)), same).first().idf == 0
    nested = index.nested_signals(occ).filter("keyword = 'run'").first()
    assert [tuple(o) for o in nested.origins] == [("run", "title", 1), ("run", "body", 2)] and nested.tf == 3
    assert index.origin_columns(index.nested_signals(occ)).filter("keyword = 'run'").first().counts == [1, 2]
    a = index.nested_signals(occ).alias("a").join(index.nested_signals(occ).alias("b"), index.same_signal()).count()
    assert a == 3
    assert {r.id: r.dl for r in index.lengths(index.signals(occ)).collect()} == {"1": 4, "2": 1}
    assert index.nested_postings(index.signals(occ)).filter("keyword = 'run'").first().docs[0].tf == 3


def test_stemming_joins_forms(spark):
    df = spark.createDataFrame([("1", "running runs ran")], "id string, t string")
    assert {r.keyword: r.tf for r in index.signals(index.occurrences(df, stem=True)).collect()} == {"run": 2, "ran": 1}


@pytest.mark.parametrize("values, size", [([0, 0, 0.1, 0.12345, 0.2, 0.31234, 0.5, 0.7, 0.9, 1, 1, 1], 6), ([4, 653, 1059, 1475.5, 2245, 3795, 33047], 6), ([1, 2, 2, 2, 3], 4), ([0.1234567, 0.1234568, 0.1234569, 5], 3)])
def test_buckets_are_those_of_quantile_labels(spark, values, size):
    want = [(i.left, i.right) for i in pd.qcut(pd.Series(values, dtype=float), size, duplicates="drop").cat.categories]
    got = buckets.find_buckets(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", size)
    assert np.array(got) == pytest.approx(np.array(want))


def test_one_hot(spark):
    b = [(0.0, 1.0), (1.0, 2.0)]
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (3.0,)], "v double")
    rows = df.select(*buckets.one_hot(F.col("v"), b)).collect()
    assert [tuple(r) for r in rows] == [(0, 0), (1, 0), (1, 0), (0, 1), (0, 0)]
    assert {r.bucket: r.n for r in buckets.counts(df, "v", b).collect()} == {0: 2, 1: 1}


def test_search_against_formula(spark):
    docs = spark.createDataFrame([("d1", "x y"), ("d2", "x x z w"), ("d3", "q")], "id string, t string")
    sig = index.signals(index.occurrences(docs, stop=False))
    got = {r.external_id: (r.score, r["rank"]) for r in search.search(spark.createDataFrame([("i", "x"), ("i", "x"), ("i", "z")], "intent_id string, keyword string"), search.weighted_postings(index.postings(sig))).collect()}

    def w(tf, df, dl):
        return math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (7 / 3)))

    assert got["d2"] == (pytest.approx(w(2, 2, 4) + w(1, 1, 4), abs=1e-6), 1) and got["d1"] == (pytest.approx(w(1, 2, 2), abs=1e-6), 2)
    for scorer in search.SCORERS:
        assert search.search(spark.createDataFrame([("i", "x")], "intent_id string, keyword string"), search.weighted_postings(index.postings(sig), scorer), 1).count() == 1


def test_evaluation(spark):
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "b"), ("a", "x")], "local_id string, external_id string")
    pairs = spark.createDataFrame([("a", "x"), ("x", "a"), ("a", "b"), ("b", "c")], "a string, b string")
    assert {(r.a, r.b): r.matched for r in evaluate.is_match(pairs, truth).collect()} == {("a", "x"): True, ("x", "a"): True, ("a", "b"): False, ("b", "c"): True}
    n = evaluate.total_true(spark.createDataFrame([("a",), ("b",), ("z",)], "id string"), truth)
    assert {r.id: r.n_true for r in n.collect()} == {"a": 3, "b": 1, "z": 0}
    results = spark.createDataFrame([("a", "x", 1.0, 1), ("a", "q", 0.9, 2), ("a", "p", 0.8, 3), ("a", "y", 0.7, 4)], "intent_id string, external_id string, score double, rank long")
    queries = spark.createDataFrame([("a", 1, "t", "f"), ("a", 2, "u", "f")], "intent_id string, pos long, keyword string, attr string")
    ext = spark.createDataFrame([("y", "t"), ("x", "u"), ("y", "u")], "id string, keyword string")
    assert {r.keyword: r.y for r in evaluate.rewards(queries, results, truth, ext).collect()} == {"t": 0.125, "u": 0.625}
    m = evaluate.metrics(spark.createDataFrame([("a",), ("n",)], "intent_id string"), results, truth)
    assert {r.intent_id: (r.rr, r.precision, r.recall) for r in m.collect()} == {"a": (1.0, 0.5, pytest.approx(2 / 3)), "n": (0.0, 0.0, 0.0)}
    assert evaluate.indexed_truth(truth, ext.select("id").distinct()).count() == 3
    assert sorted(r.external_id for r in evaluate.real_matches(truth, "c").collect()) == ["b"]


def log(spark, rr, who=None):
    return spark.createDataFrame([(i + 1, (who or ["e"] * len(rr))[i], v) for i, v in enumerate(rr)], "interaction long, local_id string, rr double")


def test_hybrid_trigger(spark):
    assert evaluate.hybrid_trigger(log(spark, [0.5, 0.5, 1.0, 0.0]), 2).count() == 1
    assert evaluate.hybrid_trigger(log(spark, [0.4, 0.4, 1.0, 0.0]), 2).count() == 0
    assert evaluate.hybrid_trigger(log(spark, [0.5, 0.5, 0.0, 1.0]), 2).count() == 0  # its last try was good
    assert [r.running_rr for r in evaluate.running_mean(log(spark, [1.0, 0.0, 0.5])).orderBy("interaction").collect()] == [1.0, 0.5, 0.5]


def test_selection(spark):
    df = spark.createDataFrame([("i", f"t{k}", "a", k, 0, 0.0) for k in range(3)], "id string, keyword string, attr string, ord long, attr_ord long, score double")
    assert [r.keyword for r in selection.probability_mass(df, 3, 0.5).orderBy("pos").collect()] == ["t0", "t1"]
    assert [r.keyword for r in selection.top_terms(df, 2).orderBy("pos").collect()] == ["t0", "t1"]
    twice = df.union(df.withColumn("attr", F.lit("b")))
    assert selection.top_terms(twice, 2).select("keyword").distinct().count() == 1
    assert selection.top_terms(twice, 2, dedupe_keywords=True).select("keyword").distinct().count() == 2


def test_bandit(spark):
    m = bandit.LinUCB(0.2)
    assert m.fit(np.array([[1.0, 0.0]]), np.array([1.0])) == 1
    assert m.b.tolist() == [1, 0] and m.a.tolist() == [[2, 0], [0, 1]] and m.theta.tolist() == [0.5, 0]
    m.remove(np.array([[1.0, 0.0]]), np.array([1.0]))
    assert m.a.tolist() == [[1, 0], [0, 1]] and m.b.tolist() == [0, 0]
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 3)), rng.random(50)
    df = spark.createDataFrame([(f"e{i % 3}", r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id string, x array<double>, y double").repartition(3)
    a, b = bandit.collect_gram(bandit.gram(df), 3)
    assert np.allclose(a, x.T @ x) and np.allclose(b, x.T @ y)
    m = bandit.LinUCB(0.3)
    m.add(a, b)
    assert np.allclose(m.a @ m.inverse, np.eye(3))
    got = sorted(r[0] for r in df.select(bandit.score_column(m, F.col("x"), 3)).collect())
    assert np.allclose(got, sorted(m.predict(x)))
    own = bandit.LinUCB(0.3)
    own.fit(x[:5], y[:5])
    rows = df.select("id", "x", bandit.score_by_key({"e1": own}, m, F.col("id"), F.col("x"), 3).alias("s")).collect()
    assert all(np.isclose(r.s, (own if r.id == "e1" else m).predict(np.array([r.x]))[0]) for r in rows)
    cold = df.select("x", bandit.cold_score(F.col("x"), 0.3).alias("s")).collect()
    assert all(np.isclose(r.s, bandit.LinUCB(0.3).predict(np.array([r.x]))[0]) for r in cold)


def test_feedback(spark):
    local = spark.createDataFrame([("l", f"k{i}") for i in range(10)], "id string, keyword string")
    ext = spark.createDataFrame([("m", "k1", 1), ("m", "new", 2), ("o", "k1", 4)], "id string, keyword string, tf long")
    pairs = spark.createDataFrame([("l", "m"), ("l", "o")], "local_id string, external_id string")
    assert [(r.keyword, r.external_id) for r in feedback.borrow(pairs, ext, local, "supervised").collect()] == [("new", "m")]
    start = local.select(F.col("id").alias("local_id"), "keyword", F.lit(False).alias("sent"))
    for n, done in ((6, False), (7, True)):
        sent = feedback.mark_sent(start, spark.createDataFrame([("l", f"k{i}") for i in range(n)], "intent_id string, keyword string"))
        assert feedback.exhausted(sent).first().exhausted == done
        assert feedback.borrow_unsupervised(pairs, sent, ext, local).count() == int(done)
    assert {r.keyword: r.external_tf for r in features.external_frequency(pairs, ext).collect()} == {"k1": 0.75, "new": 0.5}
    borrowed = feedback.borrow(pairs, ext, local, "unsupervised")
    merged = feedback.merge_borrowed(borrowed, feedback.borrow(pairs, ext, local, "supervised")).collect()
    assert [r.mode for r in merged] == ["supervised"]
    assert feedback.new_pairs(pairs, pairs.limit(1)).count() == 1
    assert {(r.external_id): r.max_tf for r in feedback.external_tf(pairs, ext)[1].collect()} == {"m": 2, "o": 4}


def test_sampling(spark):
    ids = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, place int")
    w = sampling.zipf_weights(ids)
    assert [round(r.weight, 9) for r in w.orderBy("rn").collect()] == [round(x / 11, 9) for x in (6, 3, 2)]
    draws = sampling.zipf_draws(w, 4000, 3).groupBy("local_id").count().collect()
    assert sum(r["count"] for r in draws) == 4000 and all(abs(r["count"] / 4000 - dict(a=6 / 11, b=3 / 11, c=2 / 11)[r.local_id]) < 0.05 for r in draws)
    assert sampling.uniform_draws(ids, 500, 1).count() == 500
    scored = spark.createDataFrame([("e", float(-i), i) for i in range(6)], "id string, score double, ord long")
    assert [r.ord for r in sampling.epsilon_greedy(scored, 3, 0.0, 1).orderBy("pos").collect()] == [0, 1, 2]
    assert len({r.ord for r in sampling.epsilon_greedy(scored, 6, 1.0, 1).collect()}) == 6
    assert sampling.replay_sample(scored, 4, 1).count() == 4
    assert [r.rn for r in with_rank(spark.range(100).repartition(5), "id").orderBy("id").collect()] == list(range(1, 101))


def test_optimal(spark):
    local = spark.createDataFrame([("l", "p"), ("l", "q"), ("l", "z")], "id string, keyword string")
    docs = spark.createDataFrame([("m", "p q r"), ("n", "p p"), ("o", "q q"), ("x", "z")], "id string, t string")
    sig = index.signals(index.occurrences(docs))
    weighted = search.weighted_postings(index.postings(sig), "overlap_count")
    truth = spark.createDataFrame([("l", "m")], "local_id string, external_id string")
    found = optimal.optimal_queries(local, truth, sig, weighted, 1, 3)
    assert {tuple(r.query): r.rr for r in found[1].collect()} == {("p",): 1.0, ("q",): 1.0}
    assert [tuple(r.query) for r in found[2].collect()] == [("p", "q")]
    assert [tuple(r.query) for r in found[3].collect()] == [("p", "q", "z")]
    assert [tuple(r.query) for r in optimal.optimal_queries(local.filter("keyword <> 'q'"), truth, sig, weighted, 2, 2)[2].collect()] == [("p", "z")]
    many = spark.createDataFrame([("l", [f"q{i:03d}"], 1.0) for i in range(150)], "local_id string, query array<string>, rr double")
    assert optimal.best_queries(many).count() == 100


def test_network_gradient():
    net = neural.Network((3, 4, 4), seed=1)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 3)), rng.random(5)
    _, grads = net.gradient(x, y)
    flat = [p for layer in net.layers for p in layer]
    for p, g in zip(flat, grads, strict=True):
        at = tuple(0 for _ in p.shape)
        old = p[at]
        p[at] = old + 1e-6
        up = net.gradient(x, y)[0]
        p[at] = old - 1e-6
        down = net.gradient(x, y)[0]
        p[at] = old
        assert abs((up - down) / 2e-6 - g[at]) < 1e-6
    replay = neural.Replay(neural.Network((3, 8), rate=0.01, seed=1), size=4, sample=3)
    for _ in range(10):
        replay.add(x, y)
        first = replay.fit()
    assert len(replay.buffer) == 4
    for _ in range(300):
        last = replay.fit()
    assert last < first
    split = neural.Replay(neural.Network((3, 8), seed=1), split=True)
    split.add(x, y)
    assert split.fit() == pytest.approx(neural.Network((3, 8), seed=1).gradient(x, y)[0])


def test_preparation(spark):
    e = spark.createDataFrame([("i", [5, 6, 7, 5, 6])], "id string, sequence array<int>")
    t = spark.createDataFrame([("i", "k", [5, 6]), ("i", "gone", [9])], "id string, keyword string, pattern array<int>")
    p = neural.prepare(e, t)
    assert [(r.keyword, r.positions) for r in p.collect()] == [("k", [0, 1, 3, 4])]
    v = spark.createDataFrame([("i", n, [float(n), 1.0]) for n in range(5)], "id string, pos int, vector array<double>")
    assert neural.mean_pool(v, p).first().vector == [2.0, 1.0]
    assert neural.attribute_ids(["x", "y"]) == {"x": 0, "y": 1}


def test_short_texts_are_found_without_comparing_all(spark):
    from querysmith.plans.dataset import contained

    local = [(str(i), t) for i, t in enumerate(["ab", "b c", "one two three", "x", " ", "", None, "ü w", "zz zz", "two", "cd ", "e\tf"])]
    docs = [(f"d{i}", t) for i, t in enumerate(["ab cd e", "cab cd", "say one two three", "one  two three", "x", "", None, "grüß wü walt", "b c", "two words", "zz zzz", "e\tf", "ex zz"])]
    got = contained(spark.createDataFrame(local, "id string, text string"), spark.createDataFrame(docs, "id string, text string")).collect()
    assert {(r.local_id, r.external_id) for r in got} == {(i, j) for i, t in local for j, d in docs if t and d is not None and t in d}


def test_quantile_edges_against_numpy(spark):
    draw = np.random.default_rng(2)
    for values in (draw.normal(size=501).round(1).tolist(), [3.0], [1.0, 2.0], [5.0] * 9):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
        want = sorted({float(q) for q in np.quantile(values, [i / 7 for i in range(8)])})
        assert np.allclose(buckets.quantile_edges(df, "v", 7), want)
    assert buckets.quantile_edges(df.limit(0), "v", 7) == []


def test_running_mean_of_one_log(spark):
    rows = [(i, float(i % 7)) for i in range(1, 200)]
    out = evaluate.running_mean(spark.createDataFrame(rows, "interaction long, rr double").repartition(5), every=10).collect()
    assert len(out) == 19 and all(abs(r.running_rr - sum(v for i, v in rows[: r.interaction]) / r.interaction) < 1e-12 for r in out)


def test_neural_inputs(spark):
    """Attributes, vectors of terms from sub-words, and short vectors of borrowed terms side by side."""
    from querysmith.config import PolicyConfig
    from querysmith.plans.policies import make

    candidates = spark.createDataFrame([("e", "run", "a", False, [1.0, 2.0, 3.0]), ("e", "far", "b", False, [4.0, 5.0, 6.0]), ("e", "say", "a", True, [7.0])], "id string, keyword string, attr string, is_external boolean, x array<double>")
    plain = make("neural", PolicyConfig(attribute_encoding=True))
    assert {r.keyword: r.x for r in plain.inputs(candidates).collect()} == {"run": [1, 0, 1, 2, 3], "far": [0, 1, 4, 5, 6], "say": [1, 0, 7, 0, 0]}
    sequences = spark.createDataFrame([("e", [5, 6, 7, 5])], "id string, sequence array<int>")
    patterns = spark.createDataFrame([("e", "run", [5]), ("e", "far", [6, 7]), ("e", "say", [9])], "id string, keyword string, pattern array<int>")
    places = spark.createDataFrame([("e", i, [float(i), 1.0]) for i in range(4)], "id string, pos int, vector array<double>")
    deep = make("neural", PolicyConfig(attribute_encoding=False), subwords=(sequences, patterns, places))
    assert {r.keyword: r.x for r in deep.inputs(candidates).collect()} == {"run": [1.5, 1, 1, 2, 3], "far": [1.5, 1, 4, 5, 6]}


def test_subwords_of_a_tokenizer_file(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    texts = [("e", "the runner runs far, the runner"), ("n", None), ("z", ""), ("é", "naïve 漢字 " * 3000)]
    terms = [("e", "runner"), ("e", "absent"), ("é", "漢字"), ("n", "runner"), ("z", "runner")]
    entities = spark.createDataFrame(texts, "id string, text string").repartition(3)
    sequences, patterns = neural.tokenized(entities, spark.createDataFrame(terms, "id string, keyword string"), path)
    own = tokenizers.Tokenizer.from_file(path)
    ids = {i: own.encode(" " + t, add_special_tokens=False).ids if t else [] for i, t in texts}
    assert {r.id: r.sequence for r in sequences.collect()} == ids
    assert {(r.id, r.keyword): r.pattern for r in patterns.collect()} == {(i, k): own.encode(" " + k, add_special_tokens=False).ids for i, k in terms}
    found = {(r.id, r.keyword): r.positions for r in neural.prepare(sequences, patterns).collect()}
    assert found.keys() == {("e", "runner"), ("é", "漢字")}
    at = found["e", "runner"]
    assert own.decode([ids["e"][i] for i in at]).split() == ["runner", "runner"]
    empty = neural.tokenized(entities.limit(0), patterns.limit(0).select("id", "keyword"), path)
    assert [df.count() for df in empty] == [0, 0]


def test_draws_depend_on_nothing_but_their_seed(spark):
    ids = spark.createDataFrame([(f"e{i}", i, i / 10) for i in range(30)], "id string, ord int, score double")
    one, two = (sampling.uniform_draws(ids.repartition(n), 200, 7).orderBy("interaction").collect() for n in (1, 6))
    assert one == two and 15 < len({r.local_id for r in one}) and one != sampling.uniform_draws(ids, 200, 8).orderBy("interaction").collect()
    assert sampling.replay_sample(ids.repartition(5), 4, 1).collect() == sampling.replay_sample(ids.coalesce(1), 4, 1).collect()
    many = ids.select(F.lit("k").alias("id"), "ord", "score")
    first = [r.ord for r in sampling.epsilon_greedy(many, 30, 0.5, 3).orderBy("pos").collect()]
    assert sorted(first) == list(range(30)) and first != list(range(29, -1, -1))


@pytest.mark.parametrize("parts", [1, 7])
def test_draws_are_those_of_a_search_in_the_running_weights(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        w = sampling.zipf_weights(sampling.permutation(spark.createDataFrame([(f"e{i}",) for i in range(3000)], "id string"), 2))
        rows = w.orderBy("rn").collect()
        draws = {r.interaction: r.u for r in sampling.interactions(spark, 500, 9).collect()}
        at = np.searchsorted([r.upto for r in rows], [draws[i] for i in sorted(draws)])
        got = {r.interaction: r.local_id for r in sampling.zipf_draws(w, 500, 9).collect()}
        assert [got[i] for i in sorted(draws)] == [rows[min(k, 2999)].id for k in at] and len(got) == 500
        # Weights that don't add up to one: what is beyond goes to the last entity.
        half = spark.createDataFrame([("a", 1, 0.1, 0.1), ("b", 2, 0.0, 0.1), ("c", 3, 0.2, 0.3)], "id string, rn long, weight double, upto double")
        assert {r.local_id: u for r in sampling.zipf_draws(half, 300, 9).collect() for u in [draws[r.interaction]]}.keys() == {"a", "c"}
        assert all(r.local_id == ("a" if draws[r.interaction] <= 0.1 else "c") for r in sampling.zipf_draws(half, 300, 9).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lemmas(spark):
    from querysmith.operators.lemmas import lemmas

    lexicon = spark.createDataFrame([("dog", "noun", 7), ("dog", "verb", 1), ("box", "noun", 10), ("city", "noun", 3), ("make", "verb", 49), ("run", "verb", 41), ("go", "verb", 30), ("man", "noun", 11), ("fine", "adj", 5), ("better", "adj", 2), ("good", "adj", 21), ("s", "noun", 1), ("bus", "noun", 3)], "form string, pos string, n_senses long")
    exceptions = spark.createDataFrame([("went", "verb", "go"), ("better", "adj", "good"), ("mice", "noun", "mouse")], "form string, pos string, lemma string")
    forms = ["dogs", "boxes", "cities", "making", "runs", "went", "men", "finer", "better", "s", "ing", "mice", "buses", "bus", "nothing", "", "dogs"]
    got = {(r.form, r.pos): (r.lemma, r.n_senses) for r in lemmas(spark.createDataFrame([(f,) for f in forms], "form string").distinct(), lexicon, exceptions).collect()}
    assert got == {("dogs", "noun"): ("dog", 7), ("dogs", "verb"): ("dog", 1), ("boxes", "noun"): ("box", 10), ("cities", "noun"): ("city", 3), ("making", "verb"): ("make", 49), ("runs", "verb"): ("run", 41), ("went", "verb"): ("go", 30),
                   ("men", "noun"): ("man", 11), ("finer", "adj"): ("fine", 5), ("better", "adj"): ("good", 21), ("s", "noun"): ("s", 1), ("buses", "noun"): ("bus", 3), ("bus", "noun"): ("bus", 3)}
    assert lemmas(spark.createDataFrame([("better",)], "form string"), lexicon).first().lemma == "better"


def test_inflected_forms_have_senses(spark):
    occ = index.occurrences(spark.createDataFrame([("1", "dogs making unknowns")], "id string, t string"))
    lexicon = spark.createDataFrame([("dog", "noun", 3), ("dog", "verb", 1), ("make", "verb", 2)], "form string, pos string, n_senses long")
    got = {r.keyword: (r.noun, r.verb) for r in features.pos_shares(occ, lexicon).collect()}
    assert got == {"dogs": (0.75, 0.25), "making": (0.0, 1.0), "unknowns": (0.0, 0.0)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_terms_with_several_forms(spark):
    """Senses of a term are those of its forms in the attribute, each form once; counts by entity need one shuffle."""
    rows = [("1", "run", "runs", "t", 1, 0), ("1", "run", "Runs", "t", 1, 1), ("1", "run", "running", "t", 2, 2), ("1", "run", "run", "b", 1, 3), ("1", "odd", "odd", "b", 1, 4), ("2", "run", "RUN", "t", 1, 0)]
    occ = spark.createDataFrame(rows, "id string, keyword string, token string, attr string, cnt long, ord long").repartition(3, "id")
    lexicon = spark.createDataFrame([("run", "verb", 3), ("run", "noun", 1), ("running", "noun", 1)], "form string, pos string, n_senses long")
    weights = spark.createDataFrame([("run", 0.5)], "keyword string, idf double")
    layout = features.Layout(("t", "b"))
    df = features.featurize(occ, weights, layout, lexicon)
    got = {(r.id, r.keyword, r.attr): dict(zip(layout.names, r.x, strict=True)) for r in df.collect()}
    t, b, odd, two = got["1", "run", "t"], got["1", "run", "b"], got["1", "odd", "b"], got["2", "run", "t"]
    assert len(got) == 4 and (t["noun"], t["verb"], b["noun"], b["verb"]) == (0.4, 0.6, 0.25, 0.75) and not any(odd[p] for p in features.POS)
    assert (t["share_t"], t["share_b"], t["norm_tf"], odd["norm_tf"]) == (0.8, 0.0, 1.0, 0.2) and (t["title"], t["upper"], b["title"], two["upper"]) == (1, 0, 0, 1)
    bare = features.featurize(occ, weights, layout)
    assert plan(bare).count("hashpartitioning(id#") == 1
    assert features.featurize(occ.limit(0), weights, layout, lexicon).count() == 0


def test_rewards_use_results_once(spark):
    results = spark.range(1, 4).select(F.lit("q").alias("intent_id"), F.concat(F.lit("d"), "id").alias("external_id"), F.col("id").cast("int").alias("rank"))
    queries = spark.createDataFrame([("q", 1, "a", "t"), ("q", 2, "b", "t"), ("none", 1, "a", "t")], "intent_id string, pos int, keyword string, attr string")
    truth = spark.createDataFrame([("q", "d1"), ("d3", "q")], "local_id string, external_id string")
    terms = spark.createDataFrame([("d1", "a"), ("d3", "a"), ("d2", "b"), ("d3", "c")], "id string, keyword string")
    df = evaluate.rewards(queries, results, truth, terms)
    assert plan(df).count("Range (") == 1
    assert {(r.intent_id, r.keyword): r.y for r in df.collect()} == {("q", "a"): (1 + 1 / 3) / 2, ("q", "b"): 0.0, ("none", "a"): 0.0}
