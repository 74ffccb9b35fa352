"""Interactions in rounds: intents, queries, search, rewards, feedback, learning.

Updates of the models are sums, so a round of B interactions learns what B single ones would; only the queries inside a round
don't see each other's lessons. With B = 1 the order is the sequential one. A round is a few Spark jobs over the whole index.
Intents, what was matched and sent, samples and the log are tables throughout; what a round brings to the driver are a model's
sums (the square of a vector's length), and for policies that learn in order (hybrid, neural) the round's own samples.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import evaluate, features, feedback, index
from ..operators.sampling import permutation, series_draws, uniform_draws, zipf_draws, zipf_weights
from ..sources.store import exists, scratch, settled
from .dataset import Dataset
from .policies import Policy, make

LOG = "run_id long, interaction long, local_id string, query array<struct<keyword:string,attr:string,score:double>>, n_returned long, n_matches long, rr double, precision double, recall double, loss double"


def intents(data: Dataset, run: RunConfig, run_id: int, series: DataFrame | None = None) -> DataFrame:
    """(interaction, local_id) of a run by its distribution; entities without any term aren't drawn."""
    entities = data.local_signals.select("id").distinct()
    seed = run.seed(run_id)
    if run.distribution == "uniform":
        return uniform_draws(entities, run.interactions, seed)
    if run.distribution == "zipfian":
        return zipf_draws(zipf_weights(permutation(entities, seed)), run.interactions, seed + 1)
    if series is None:
        raise ValueError(f"{run.distribution} needs a series of intents")
    return series_draws(series, run_id).filter(F.col("interaction") <= run.interactions)


@dataclass
class State:
    """What a run has learned about entities, as tables: pairs that matched, those of them that are borrowed from without
    supervision (None while there are none), and words that were offered, with whether they were sent."""

    matched: DataFrame | None = None
    unsupervised: DataFrame | None = None
    sent: DataFrame | None = None


def _added(known: DataFrame | None, new: DataFrame) -> DataFrame | None:
    """Pairs with those that weren't known, or None if there are none yet."""
    new = new if known is None else feedback.new_pairs(new, known)
    out = settled((new if known is None else known.unionByName(new)).distinct(), "pairs")
    return None if known is None and out.isEmpty() else out


class Loop:
    def __init__(self, data: Dataset, policy: Policy, run: RunConfig, run_id: int = 1):
        self.data, self.policy, self.run, self.run_id, self.state = data, policy, run, run_id, State()
        self.spark: SparkSession = data.local.sparkSession
        c = run.policy
        base = data.layout
        self.layout = features.Layout(base.attrs, base.idf, base.length, base.tf, borrowed=c.supervised_term_borrowing, external=c.external_feat_specific or c.external_feat_specific_unsupervised, unsupervised=c.external_feat_specific_unsupervised)
        self._static: DataFrame | None = None
        self._read: tuple = (None, None, None)
        #: Of each round: interactions, their mean reciprocal rank, documents returned, matches, the loss. Taken as the log is written.
        self.metrics: list[dict] = []

    def snapshot(self) -> tuple[dict, dict[str, DataFrame]]:
        """All that the run has learned: values for JSON, and tables."""
        values, tables = self.policy.snapshot()
        state = {f"state-{name}": df for name, df in vars(self.state).items() if df is not None}
        return values, tables | state

    def restore(self, values: dict, tables: dict[str, DataFrame]) -> None:
        """Goes on from what `snapshot` gave."""
        self.policy.restore(values, tables)
        self.state = State(**{name.removeprefix("state-"): df for name, df in tables.items() if name.startswith("state-")})

    def close(self) -> None:
        """Gives up what is held in memory; the loop can go on."""
        if self._static is not None:
            self._static.unpersist()
            self._static = None

    def _pairs(self, pairs: DataFrame | None) -> DataFrame:
        return self.spark.createDataFrame([], "local_id string, external_id string") if pairs is None else pairs

    def candidates(self, asked: DataFrame) -> DataFrame:
        """The candidate terms of some entities (id), with features as of now."""
        data, c = self.data, self.run.policy
        with_idf = lambda df: index.with_idf(df, data.idf)
        matched_matters = (c.external_feat_specific or c.supervised_term_borrowing) and self.state.matched is not None
        changing = matched_matters or self.state.unsupervised is not None
        if self._static is None:
            self._static = with_idf(features.featurize(data.local_occ, data.idf, self.layout, data.lexicon)).withColumn("is_external", F.lit(False)).persist()
        if not changing:
            return self._static.join(asked, "id", "left_semi")
        ids = asked.select(F.col("id").alias("local_id"))
        matched = self._pairs(self.state.matched).join(ids, "local_id", "left_semi")
        occ = self._matched_occ()
        signals = index.signals(occ)
        frequency = features.external_frequency(matched, signals)
        extra = frequency.select(F.col("local_id").alias("id"), "keyword", F.col("external_tf") if c.external_feat_specific else F.lit(None).cast("double").alias("external_tf"))
        freely = self._pairs(self.state.unsupervised).join(ids, "local_id", "left_semi")
        loose = features.external_frequency(freely, signals)
        extra = extra.join(loose.select(F.col("local_id").alias("id"), "keyword", F.col("external_tf").alias("unsupervised_tf")), ["id", "keyword"], "full_outer").withColumn("is_borrowed", F.lit(False))
        own = data.local_occ.join(asked, "id", "left_semi")
        parts = [with_idf(features.featurize(own, data.idf, self.layout, data.lexicon, extra=extra)).withColumn("is_external", F.lit(False))]
        known = data.local_signals.select("id", "keyword").join(asked, "id", "left_semi")
        order = F.lit(1 << 60)
        if c.supervised_term_borrowing and self.state.matched is not None:
            terms = self._borrowed(matched, known, occ)
            parts.append(with_idf(features.featurize(terms, data.idf, self.layout, data.lexicon, is_local=False, extra=extra.withColumn("is_borrowed", F.lit(True)))).withColumn("is_external", F.lit(False)).withColumn("ord", F.col("ord") + order))
            known = known.union(terms.select("id", "keyword").distinct())
        if self.state.unsupervised is not None:
            terms = self._borrowed(freely, known, occ)
            short = features.featurize_external(terms.select("id", "keyword").distinct(), data.idf, self.layout, loose if c.external_feat_specific_unsupervised else None)
            rows = index.split_by_attribute(terms).join(short, ["id", "keyword"])
            parts.append(with_idf(rows.select("id", "keyword", "attr", (F.col("ord") + order).alias("ord"), "attr_ord", F.lit(False).alias("is_local"), "x")).withColumn("is_external", F.lit(True)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _matched_occ(self) -> DataFrame:
        """Occurrences in external entities that were matched so far; each is read once, in the round after which it is known."""
        matched, freely = self.state.matched, self.state.unsupervised
        if self._read[0] is not matched or self._read[1] is not freely:
            ids = self._pairs(matched).union(self._pairs(freely)).select(F.col("external_id").alias("id")).distinct()
            before = self._read[2]
            new = settled(ids if before is None else ids.join(before.select("id"), "id", "left_anti"), "matched-ids")
            if before is None or not new.isEmpty():
                occ = self.data.occurrences_in(new)
                before = settled(occ if before is None else before.unionByName(occ), "matched-occ")
            self._read = (matched, freely, before)
        return self._read[2]

    def _borrowed(self, pairs: DataFrame, known: DataFrame, occ: DataFrame) -> DataFrame:
        """Occurrences of terms of matched documents that an entity lacks, as if they were its own; a term of several documents
        comes from the first."""
        rows = pairs.join(occ.withColumnRenamed("id", "external_id"), "external_id").withColumnRenamed("local_id", "id").join(known, ["id", "keyword"], "left_anti")
        first = rows.groupBy("id", "keyword").agg(F.min("external_id").alias("external_id"))
        return rows.join(first, ["id", "keyword", "external_id"], "left_semi").select("id", "keyword", "token", "attr", "cnt", "ord")

    def round(self, batch: DataFrame, first: int) -> DataFrame:
        """Runs the interactions of a batch (interaction, local_id) with one state of the model; returns their log. `first` is the
        number of the first of them."""
        data, run, c = self.data, self.run, self.run.policy
        asked = batch.select(F.col("local_id").alias("id")).distinct()
        # Written, not kept in memory: plans stay small, and lost executors take nothing along.
        offered = settled(self.candidates(asked), "offered")
        query = settled(self.policy.query(offered, run.query_length, run.seed(self.run_id) * 100_003 + first).withColumn("intent_id", F.col("id")), "query")
        results, held = data.searched(query, run.top_k_size)
        results = settled(results, "results")
        y = evaluate.rewards(query.select("intent_id", "pos", "keyword", "attr"), results, data.truth, held)
        terms = settled(query.join(y.select("intent_id", "pos", "y"), ["intent_id", "pos"]).select("id", "pos", "keyword", "attr", "score", "is_external", "x", "y"), "terms")
        found = evaluate.metrics(asked.select(F.col("id").alias("intent_id")), results, data.truth)
        nested = terms.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "keyword", "attr", "score"))), lambda t: F.struct(t["keyword"], t["attr"], t["score"].cast("double"))).alias("query"))
        log = batch.join(found.withColumnRenamed("intent_id", "local_id"), "local_id").join(nested.withColumnRenamed("id", "local_id"), "local_id", "left")
        seen = Observation()
        log = log.select("interaction", "local_id", F.coalesce("query", F.array()).alias("query"), "n_returned", "n_matches", "rr", "precision", "recall")
        log = log.observe(seen, F.count("*").alias("interactions"), F.avg("rr").alias("mrr"), F.sum("n_returned").alias("returned"), F.sum("n_matches").alias("matches"))
        log = settled(log, "measured")
        before = (self.state.matched, self.state.unsupervised)
        if c.supervised_term_borrowing or c.unsupervised_term_borrowing or c.external_feat_specific:
            self._remember(asked, offered, terms, evaluate.matches(results, data.truth).select(F.col("intent_id").alias("local_id"), "external_id").distinct())
        loss = None
        if self.policy.learns:
            samples = batch.join(terms.withColumnRenamed("id", "local_id"), "local_id")
            # Feedback comes before learning, so a model sees vectors as they are after it.
            if self.policy.fresh and before != (self.state.matched, self.state.unsupervised):
                now = self.candidates(asked).select(F.col("id").alias("local_id"), "keyword", "attr", "is_external", F.col("x").alias("now"))
                samples = samples.join(now, ["local_id", "keyword", "attr", "is_external"], "left").withColumn("x", F.coalesce("now", "x")).drop("now")
            loss = self.policy.update(samples.select("interaction", F.col("local_id").alias("id"), "pos", "keyword", "is_external", "x", "y"))
        self.metrics.append(seen.get | {"loss": loss})
        names = [f.split()[0] for f in LOG.replace("struct<keyword:string,attr:string,score:double>", "").split(", ")]
        return log.withColumn("run_id", F.lit(self.run_id).cast("long")).withColumn("loss", F.lit(loss).cast("double")).select(*names)

    def _remember(self, asked: DataFrame, offered: DataFrame, terms: DataFrame, pairs: DataFrame) -> None:
        state = self.state
        state.matched = _added(state.matched, pairs)
        if not self.run.policy.unsupervised_term_borrowing:
            return
        # Of an entity count its own words, those borrowed without supervision once they were offered, and whatever was sent.
        own = self.data.local_signals.join(asked, "id", "left_semi").select("id", "keyword").union(offered.filter("is_external").select("id", "keyword"))
        own = own.distinct().select(F.col("id").alias("local_id"), "keyword", F.lit(False).alias("sent"))
        known = own if state.sent is None else own.unionByName(state.sent).groupBy("local_id", "keyword").agg(F.bool_or("sent").alias("sent"))
        state.sent = settled(feedback.mark_sent(known, terms.withColumnRenamed("id", "intent_id")), "sent")
        done = feedback.exhausted(state.sent).filter("exhausted").select("local_id")
        state.unsupervised = _added(state.unsupervised, pairs.join(done, "local_id", "left_semi"))

    def play(self, drawn: DataFrame, path: str | None = None) -> DataFrame:
        """All interactions of a run (numbered from 1), in rounds; the log, which each round appends to the table at `path`."""
        path, size = path or scratch(self.spark, "log"), self.run.batch
        drawn = settled(drawn.select("interaction", "local_id").withColumn("round", F.floor((F.col("interaction") - 1) / size)), "intents")
        for r in sorted(drawn.groupBy("round").agg(F.min("interaction").alias("first")).collect(), key=lambda r: r["round"]):
            self.round(drawn.filter(F.col("round") == r["round"]).select("interaction", "local_id"), r["first"]).write.mode("append").parquet(path)
        out = self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(out.schema).parquet(path) if exists(self.spark, path) else out


def play(data: Dataset, run: RunConfig, series: DataFrame | None = None, findable_only: bool = False, at_once: int = 4, **how) -> DataFrame:
    """The logs of all repetitions of a run, each with models and state of its own.

    Up to `at_once` are played at the same time: their jobs share the executors, and the dataset's structures are built once.
    """
    if findable_only:
        data = data.only(evaluate.findable(data.local.select("id"), data.truth))
    if series is not None:
        data = data.only(evaluate.in_series(data.local.select("id"), series))

    def repetition(run_id: int) -> DataFrame:
        loop = Loop(data, make(run.model, run.policy, **how), run, run_id)
        try:
            return loop.play(intents(data, run, run_id, series))
        finally:
            loop.close()

    data.prepare()
    with ThreadPoolExecutor(min(at_once, len(run.run_ids))) as pool:
        logs = list(pool.map(repetition, run.run_ids))
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


def progress(log: DataFrame, every: int = 500) -> DataFrame:
    """(run_id, interaction, running_rr, running_length): means to date, at every so many interactions."""
    rows = evaluate.running_mean(log.withColumn("length", F.size("query")), "rr", by=["run_id"])
    return evaluate.running_mean(rows, "length", by=["run_id"], every=every).select("run_id", "interaction", "running_rr", "running_length")
