import numpy as np
import pytest
from pyspark.sql import functions as F

from querysmith.config import PolicyConfig, RunConfig
from querysmith.operators.bandit import LinUCB, collect_gram, gram
from querysmith.operators.neural import Network, Replay
from querysmith.plans import loop as L
from querysmith.plans.dataset import Dataset, contained
from querysmith.plans.policies import HybridPolicy, make
from querysmith.sources.store import settled


@pytest.fixture(scope="module")
def data(spark):
    local = spark.createDataFrame([("b:1", "alpha beta common"), ("b:2", "gamma common delta"), ("b:3", "lonely words")], "id string, text string")
    external = spark.createDataFrame([("d:1", "say alpha beta common again"), ("d:2", "gamma common delta"), ("d:3", "common things"), ("d:4", "common alpha")], "id string, text string")
    truth = spark.createDataFrame([("b:1", "d:1"), ("b:2", "d:2")], "local_id string, external_id string")
    return Dataset(local, external, truth)


SERIES = [(1, 1, "b:1"), (1, 2, "b:2"), (1, 3, "b:1"), (1, 4, "b:3")]


def play(spark, data, **how):
    config = {k: how.pop(k) for k in list(how) if hasattr(PolicyConfig(), k)}
    extra = {k: how.pop(k) for k in ("hidden",) if k in how}
    run = RunConfig(interactions=4, distribution="fixed", policy=PolicyConfig(**config), **({"query_length": 2} | how))
    return L.play(data, run, spark.createDataFrame(SERIES, "run_id int, pos int, local_id string"), **extra).orderBy("interaction").collect()


def test_truth_by_containment(spark, data):
    got = contained(data.local, data.external).collect()
    assert {(r.local_id, r.external_id) for r in got} == {("b:1", "d:1"), ("b:2", "d:2")}


def test_idf_policy(spark, data):
    log = play(spark, data, model="idf", batch=4)
    assert [r.rr for r in log] == [1.0, 1.0, 1.0, 0.0] and all(len(r.query) == 2 for r in log)
    assert log[0].recall == 1.0 and log[3].n_returned == 0 and log[3].precision == 0


def test_one_by_one_is_the_sequential_order(spark, data):
    """Rounds of one interaction learn what a plain loop over the same vectors and rewards learns."""
    log = play(spark, data, model="dataset_level", batch=1)
    run = RunConfig(interactions=4, query_length=2, distribution="fixed", policy=PolicyConfig())
    shared = L.Loop(data, make("dataset_level", run.policy), run)
    vectors = {(r.id, r.keyword): r.x for r in shared.candidates(data.local.select("id")).collect()}
    order = {(r.id, r.keyword): r.ord for r in data.local_signals.collect()}
    model, terms = LinUCB(0.2), {("d:1"): "say alpha beta common again".split(), "d:2": "gamma common delta".split()}
    match = {"b:1": "d:1", "b:2": "d:2"}
    for r in log:
        own = [k for k in vectors if k[0] == r.local_id]
        score = dict(zip(own, model.predict(np.array([vectors[k] for k in own])), strict=True))
        best = sorted(own, key=lambda k: (-score[k], order[k]))[:2]
        assert [k for _, k in best] == [q.keyword for q in r.query]
        y = [r.rr if k in terms.get(match.get(r.local_id), []) else 0.0 for _, k in best]
        assert model.fit(np.array([vectors[k] for k in best]), np.array(y)) == pytest.approx(r.loss)


@pytest.mark.parametrize("how", [{"model": "hybrid", "window_size": 1, "rr_threshold": 1.0}, {"model": "neural", "hidden": (8,)}, {"model": "dataset_level", "supervised_term_borrowing": True, "external_feat_specific": True}, {"model": "dataset_level", "unsupervised_term_borrowing": True, "external_feat_specific_unsupervised": True, "p_thresh": 0.4},
                                 {"model": "hybrid", "window_size": 1, "rr_threshold": 1.0, "unsupervised_term_borrowing": True, "supervised_term_borrowing": True, "query_length": 3}, {"model": "neural", "hidden": (8,), "unsupervised_term_borrowing": True, "external_feat_specific_unsupervised": True, "query_length": 3}])
def test_other_policies_run(spark, data, how):
    log = play(spark, data, batch=2, **how)
    assert [r.interaction for r in log] == [1, 2, 3, 4] and all(0 <= r.rr <= 1 and len(r.query) >= 1 for r in log)


SAMPLE = "interaction long, id string, pos int, keyword string, is_external boolean, x array<double>, y double"


def test_hybrid_moves_samples(spark):
    p = HybridPolicy(PolicyConfig(window_size=1, rr_threshold=0.5))
    rows = [(1, "e", 1, "k", False, [1.0, 2.0], 0.0), (2, "f", 1, "k", False, [0.0, 1.0], 1.0), (3, "e", 1, "k", True, [1.0], 0.0), (4, "e", 1, "k", True, [1.0], 0.0)]
    p.update(spark.createDataFrame(rows, SAMPLE))
    p.split(spark.createDataFrame([("e",), ("f",)], "id string"))
    known = {r.id: r for r in p.entities.collect()}
    assert {i for i, r in known.items() if r.own} == {"e"} and np.allclose(p.local.a, np.eye(2) + np.outer([0, 1], [0, 1]))
    assert np.allclose(np.reshape(known["e"].gram, (2, 2)), np.outer([1, 2], [1, 2]))


class Sequential:
    """The hybrid policy over plain rows, one after the other, everything in memory."""

    def __init__(self, c):
        self.c, self.shared, self.loose, self.own, self.kept, self.last, self.windows, self.open = c, LinUCB(c.alpha), LinUCB(c.alpha), {}, {}, {}, [], []

    def split(self, ids):
        for i in ids:
            if i not in self.own and self.last.get(i, 9) <= self.c.rr_threshold and len(self.windows) > 1 and self.windows[-2] >= self.windows[-1]:
                self.own[i] = LinUCB(self.c.alpha)
                for x, y in self.kept.pop(i, []):
                    self.own[i].fit(x, y)
                    self.shared.remove(x, y)

    def update(self, rows):
        losses, groups = [], {}
        for r in rows:
            groups.setdefault((r[4], r[1] if r[1] in self.own and not r[4] else None), []).append(r)
        for (external, i), part in groups.items():
            x, y = np.array([r[5] for r in part]), np.array([r[6] for r in part])
            losses.append((self.loose if external else self.own[i] if i else self.shared).fit(x, y))
            if not external and not i:
                for r in part:
                    self.kept.setdefault(r[1], []).append((np.array([r[5]]), np.array([r[6]])))
        for n in sorted({r[0] for r in rows}):
            part = [r for r in rows if r[0] == n]
            self.open.append(max(r[6] for r in part))
            if len(self.open) == self.c.window_size:
                self.windows, self.open = [*self.windows, float(np.mean(self.open))], []
            if self.windows:
                self.last[part[0][1]] = max(r[6] for r in part)
        return float(np.mean(losses))


def test_hybrid_against_the_sequential_rule(spark):
    """Rounds of all sizes, some entities far more often than others: sums, splits, scores and losses are those of a plain loop."""
    draw = np.random.default_rng(4)
    config = PolicyConfig(window_size=4, rr_threshold=0.4)
    ours, plain, at = HybridPolicy(config), Sequential(config), 0
    candidates = [(f"e{i}", f"k{j}", j % 3 == 2, (draw.random(2) if j % 3 == 2 else draw.random(3)).tolist()) for i in range(5) for j in range(4)]
    offered = spark.createDataFrame(candidates, "id string, keyword string, is_external boolean, x array<double>").repartition(3)
    for size in (3, 7, 1, 12, 6, 9):
        rows = []
        for at in range(at + 1, at + size + 1):
            i = int(draw.choice(5, p=[0.6, 0.1, 0.1, 0.1, 0.1]))
            rows += [(at, f"e{i}", j, f"k{j}", j == 2, (draw.random(2) if j == 2 else draw.random(3)).tolist(), float(draw.choice([0.0, 0.1, 0.5, 1.0]))) for j in range(int(draw.integers(1, 4)))]
        assert ours.update(spark.createDataFrame(rows, SAMPLE).repartition(3)) == pytest.approx(plain.update(rows))
        assert np.allclose(ours.windows, plain.windows[-2:]) and ours.open == pytest.approx(sum(plain.open))
        scores = {(r.id, r.keyword): r.score for r in ours.score(offered).collect()}
        plain.split(sorted({c[0] for c in candidates}))
        known = {r.id: r for r in ours.entities.collect()}
        assert {i for i, r in known.items() if r.own} == set(plain.own) and {i: r["last"] for i, r in known.items() if r["last"] is not None} == pytest.approx(plain.last)
        assert np.allclose(ours.local.a, plain.shared.a) and np.allclose(ours.local.b, plain.shared.b)
        for i, model in plain.own.items():
            assert np.allclose(np.reshape(known[i].gram, (3, 3)) + np.eye(3), model.a) if known[i].gram else np.allclose(model.start(3).a, np.eye(3))
        for i, k, external, x in candidates:
            model = plain.loose if external else plain.own.get(i, plain.shared)
            assert scores[i, k] == pytest.approx(model.predict(np.array([x]))[0], abs=1e-8)
    assert plain.own and set(plain.own) != {f"e{i}" for i in range(5)}


@pytest.mark.parametrize("how", [{"model": "dataset_level", "supervised_term_borrowing": True}, {"model": "hybrid", "window_size": 1, "rr_threshold": 1.0}])
def test_a_stream_that_is_started_again_goes_on(spark, data, tmp_path, how, monkeypatch):
    """A new loop, after an end and after a failure inside of a batch, plays what an uninterrupted stream plays."""
    from querysmith.plans import snapshots
    from querysmith.streaming import rounds

    config = {k: v for k, v in how.items() if k != "model"}
    run = RunConfig(interactions=6, query_length=2, distribution="fixed", model=how["model"], batch=2, policy=PolicyConfig(**config))
    intents = [(i + 1, who) for i, who in enumerate(["b:1", "b:2", "b:1", "b:3", "b:2", "b:1"])]
    parts = [spark.createDataFrame(intents[i : i + 2], "interaction long, local_id string").coalesce(1) for i in range(0, 6, 2)]

    def start(name, *new):
        for part in new:
            part.write.mode("append").parquet(f"{tmp_path}/{name}/in")
        stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
        rounds.start(stream, L.Loop(data, make(run.model, run.policy), run), f"{tmp_path}/{name}/log", f"{tmp_path}/{name}/cp").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{name}/log").orderBy("interaction").drop("batch_id").collect()

    whole = start("whole", *parts)
    start("cut", parts[0])
    save, fails = snapshots.save, [True]

    def once_broken(*args, **more):
        if fails.pop() if fails else False:
            raise OSError("lost")
        return save(*args, **more)

    monkeypatch.setattr(snapshots, "save", once_broken)
    with pytest.raises(Exception, match="lost"):
        start("cut", parts[1])
    assert start("cut", parts[2]) == whole
    assert len(snapshots.versions(spark, f"{tmp_path}/cut/cp/learned")) == 2


def test_sent_share_and_borrowing(spark, data):
    """Words of an entity are its own and, once offered, those it borrowed without supervision: b:1 has sent 2 of 3 after one query
    of two terms, all 3 after one of three; then the two terms it borrowed from d:1 count too."""
    for length, borrowed in ((2, None), (3, {"b:1"})):
        run = RunConfig(interactions=4, query_length=length, distribution="fixed", batch=1, policy=PolicyConfig(unsupervised_term_borrowing=True, external_feat_specific_unsupervised=True))
        loop = L.Loop(data, make("dataset_level", run.policy), run)
        batch = spark.createDataFrame([(1, "b:1")], "interaction long, local_id string")
        loop.round(batch, 1)
        found = loop.state.unsupervised
        assert (found and {r.local_id for r in found.collect()}) == borrowed
        assert {r.keyword: r.sent for r in loop.state.sent.collect()} == {k: True for k in ("alpha", "beta", "common")} if length == 3 else sum(r.sent for r in loop.state.sent.collect()) == 2
    offered = loop.candidates(spark.createDataFrame([("b:1",)], "id string"))
    assert {r.keyword for r in offered.filter("is_external").collect()} == {"say"} or {r.keyword for r in offered.filter("is_external").collect()} == {"say", "again"}
    loop.round(batch, 2)
    sent = {r.keyword: r.sent for r in loop.state.sent.collect()}
    assert sent.keys() > {"alpha", "beta", "common"} and all(sent[k] for k in ("alpha", "beta", "common")) and loop.policy.external.is_fitted


def test_distributed_sums_are_those_of_the_samples(spark):
    draw = np.random.default_rng(0)
    x, y = draw.random((40, 3)), draw.random(40)
    rows = [(i, f"e{i}", 1, "k", i % 2 == 0, x[i].tolist() if i % 2 else x[i, :2].tolist(), float(y[i])) for i in range(40)]
    policy = make("dataset_level", PolicyConfig())
    df = spark.createDataFrame(rows, "interaction long, id string, pos int, keyword string, is_external boolean, x array<double>, y double").repartition(4)
    one, two = LinUCB(0.2), LinUCB(0.2)
    for _ in range(2):
        got = policy.update(df)
        want = np.mean([one.fit(x[1::2], y[1::2]), two.fit(x[::2, :2], y[::2])])
        assert got == pytest.approx(want)
    assert np.allclose(policy.local.theta, one.theta) and np.allclose(policy.external.theta, two.theta)


def test_a_neural_policy_goes_on_from_its_values():
    """Weights, optimizer and buffer through JSON: both learn the same afterwards."""
    import json

    draw = np.random.default_rng(1)
    rows = [(draw.random((3, 4)), draw.random(3)) for _ in range(8)]
    one, two = (make("neural", PolicyConfig(buffer_size=3, buffer_sample_size=2)) for _ in range(2))
    one.replay = Replay(Network((4, 8), one.config.learning_rate), 3, 2)
    for x, y in rows[:5]:
        one.replay.add(x, y)
        one.replay.fit()
    one.width, one.attrs = 4, ["a"]
    two.restore(json.loads(json.dumps(one.snapshot()[0])), {})
    for x, y in rows[5:]:
        losses = []
        for p in (one, two):
            p.replay.add(x, y)
            losses.append(p.replay.fit())
        assert losses[0] == losses[1]
    assert two.width == 4 and two.attrs == ["a"] and all(np.array_equal(a, b) for p, q in zip(one.replay.network.layers, two.replay.network.layers, strict=True) for a, b in zip(p, q, strict=True))


def test_repetitions_at_once_are_those_one_by_one(spark, data):
    """Runs with numbers and seeds of their own, played together: the log of each is that of the run alone."""
    how = {"interactions": 6, "query_length": 1, "distribution": "uniform", "model": "dataset_level", "batch": 3}
    both = L.play(data, RunConfig(runs=(2, 5), seeds=(11, 12), **how)).orderBy("run_id", "interaction").collect()
    alone = [r for i, seed in ((2, 11), (5, 12)) for r in L.play(data, RunConfig(runs=(i,), seeds=(seed,), **how), at_once=1).orderBy("interaction").collect()]
    assert both == alone and len(both) == 12


def test_metrics_of_rounds_need_no_jobs(spark, data):
    """Counts and means of a round are observed as its tables are written: learning takes one job for each side's sums, no more."""
    run = RunConfig(interactions=4, query_length=2, distribution="fixed", model="dataset_level", batch=2)
    loop = L.Loop(data, make(run.model, run.policy), run)
    log = loop.play(spark.createDataFrame([(p, i) for _, p, i in SERIES], "interaction long, local_id string")).collect()
    for i, m in enumerate(loop.metrics):
        part = [r for r in log if 2 * i < r.interaction <= 2 * i + 2]
        assert m["interactions"] == 2 and m["mrr"] == pytest.approx(np.mean([r.rr for r in part])) and m["loss"] == pytest.approx(part[0].loss)
        assert (m["returned"], m["matches"]) == (sum(r.n_returned for r in part), sum(r.n_matches for r in part))
    rows = spark.createDataFrame([(1, "e", 1, "k", False, [1.0, 2.0], 0.5), (1, "e", 2, "l", True, [1.0], 0.5)], SAMPLE)
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for name, work in (("write", lambda: settled(rows, "samples")), ("gram", lambda: collect_gram(gram(rows.filter("NOT is_external")), 2)), ("update", lambda: loop.policy.update(rows))):
        spark.sparkContext.setJobGroup(name, name)
        if name == "update":
            loop.policy = make("dataset_level", run.policy)
        work()
        jobs[name] = len(tracker.getJobIdsForGroup(name))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs["update"] == jobs["write"] + 2 * jobs["gram"]


def test_draws_and_progress(spark, data):
    for distribution in ("uniform", "zipfian"):
        run = RunConfig(interactions=30, query_length=1, distribution=distribution, model="idf", batch=30, average_runs=2)
        log = L.play(data, run, findable_only=True)
        assert log.count() == 60 and {r.local_id for r in log.select("local_id").distinct().collect()} <= {"b:1", "b:2"}
        assert L.progress(log, 10).count() == 6


def test_stream_gives_the_same_log(spark, data, tmp_path):
    from querysmith.streaming import rounds

    intents = spark.createDataFrame([(p, i) for _, p, i in SERIES], "interaction long, local_id string")
    intents.coalesce(1).write.parquet(f"{tmp_path}/in")
    run = RunConfig(interactions=4, query_length=2, distribution="fixed", model="dataset_level", batch=2)
    stream = spark.readStream.schema(intents.schema).parquet(f"{tmp_path}/in")
    loop = L.Loop(data, make(run.model, run.policy), run)
    rounds.start(stream, loop, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/log").orderBy("interaction").collect()
    want = play(spark, data, model="dataset_level", batch=2)
    assert [(r.interaction, [q.keyword for q in r.query], r.rr) for r in got] == [(r.interaction, [q.keyword for q in r.query], r.rr) for r in want]


def test_stateful_stream(spark, tmp_path):
    from querysmith.streaming import rounds

    rows = spark.createDataFrame([(i, f"e{i % 2}", i / 10) for i in range(6)], "interaction long, local_id string, rr double").withColumn("ts", F.timestamp_seconds(F.col("interaction") * 4000))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("last", rounds.last_rr(stream), "update"), ("windows", rounds.windows(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r.local_id: r.rr for r in spark.table("last").collect()} == {"e0": 0.4, "e1": 0.5}
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 6
