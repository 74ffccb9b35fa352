"""Query policies. A policy scores an entity's candidate terms and learns from the rewards of those it sent."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import PolicyConfig
from ..operators import bandit, neural
from ..operators.ranking import with_rank
from ..operators.sampling import epsilon_greedy
from ..operators.selection import probability_mass, top_terms
from ..sources.store import settled


class Policy(ABC):
    """Candidates come as (id, keyword, attr, ord, attr_ord, is_external, idf, x); queries leave as the same with score and pos."""

    name = "policy"
    learns = True
    #: Whether vectors of samples are those after feedback (rather than those that were scored).
    fresh = True

    def __init__(self, config: PolicyConfig):
        self.config = config

    @abstractmethod
    def score(self, candidates: DataFrame) -> DataFrame:
        """Candidates with `score`."""

    def query(self, candidates: DataFrame, n: int, seed: int = 0) -> DataFrame:
        scored = self.score(candidates)
        if self.config.p_thresh is not None:
            return probability_mass(scored, n, self.config.p_thresh)
        return top_terms(scored, n, self.config.dedupe_keywords)

    def update(self, samples: DataFrame) -> float | None:
        """Learns from a round's samples: interaction, id, pos, keyword, is_external, x, y of each sent term. Returns the loss."""
        return None

    def is_fitted(self) -> bool:
        return True

    def weights(self) -> np.ndarray | None:
        return None

    def snapshot(self) -> tuple[dict, dict[str, DataFrame]]:
        """All that was learned: values for JSON, and tables."""
        return {}, {}

    def restore(self, values: dict, tables: dict[str, DataFrame]) -> None:
        """Takes what `snapshot` gave back."""


class IdfPolicy(Policy):
    """The rarest terms; learns nothing."""

    name, learns = "idf", False

    def score(self, candidates: DataFrame) -> DataFrame:
        return candidates.withColumn("score", F.col("idf"))


def in_order(samples: DataFrame) -> list[dict]:
    """A round's samples (its interactions times the query length) on the driver, for what learns one by one."""
    return [r.asDict() for r in samples.orderBy("interaction", "pos").collect()]


def _arrays(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([s["x"] for s in rows]), np.array([s["y"] for s in rows])


class DatasetPolicy(Policy):
    """One model for all entities' own terms and one for terms borrowed without supervision, whose vectors are shorter.

    Samples stay where they are: each partition sends its sums."""

    name = "dataset_level"

    def __init__(self, config: PolicyConfig):
        super().__init__(config)
        self.local, self.external = bandit.LinUCB(config.alpha), bandit.LinUCB(config.alpha)

    def _sided(self, candidates: DataFrame, score) -> DataFrame:
        """Scores own and borrowed terms apart; score: (rows, side, dimension) to a column. Rounded, so that the order of a sum
        can't change a ranking."""
        sizes = {r["is_external"]: r["d"] for r in candidates.groupBy("is_external").agg(F.max(F.size("x")).alias("d")).collect()}
        parts = [candidates.filter(F.col("is_external") == side).withColumn("score", F.round(score(side, d), 9)) for side, d in sorted(sizes.items())]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else candidates.withColumn("score", F.lit(0.0))

    def score(self, candidates: DataFrame) -> DataFrame:
        return self._sided(candidates, lambda side, d: bandit.score_column(self.external if side else self.local, F.col("x"), d))

    @staticmethod
    def _written(samples: DataFrame) -> tuple[DataFrame, dict]:
        """Samples as a table, with what was observed while it was written: n, yy (of squared rewards) and d (length of a vector) of own
        terms (n0, ...) and of borrowed ones (n1, ...)."""
        seen, counts = Observation(), []
        for i, side in enumerate((~F.col("is_external"), F.col("is_external"))):
            counts += [F.count_if(side).alias(f"n{i}"), F.sum(F.when(side, F.col("y") * F.col("y"))).alias(f"yy{i}"), F.max(F.when(side, F.size("x"))).alias(f"d{i}")]
        return settled(samples.observe(seen, *counts), "samples"), seen.get

    def update(self, samples: DataFrame) -> float | None:
        samples, seen = self._written(samples)
        losses = []
        for i, model in enumerate((self.local, self.external)):
            if seen[f"n{i}"]:
                sums = bandit.collect_gram(bandit.gram(samples.filter(F.col("is_external") == bool(i))), seen[f"d{i}"])
                losses.append(model.learn(*sums, seen[f"n{i}"], seen[f"yy{i}"]))
        return float(np.mean(losses)) if losses else None

    def is_fitted(self) -> bool:
        return self.local.is_fitted

    def weights(self) -> np.ndarray | None:
        return self.local.weights()

    def snapshot(self) -> tuple[dict, dict[str, DataFrame]]:
        return {side: [m.a.tolist(), m.b.tolist()] for side, m in (("local", self.local), ("external", self.external)) if m.is_fitted}, {}

    def restore(self, values: dict, tables: dict[str, DataFrame]) -> None:
        for side in ("local", "external"):
            model = bandit.LinUCB(self.config.alpha)
            if side in values:
                a, b = (np.array(v) for v in values[side])
                model.add(a - np.eye(len(b)), b)
            setattr(self, side, model)


class HybridPolicy(DatasetPolicy):
    """The shared model, and models of their own for entities that do poorly while the shared one makes no progress.

    An entity's own model knows all its samples and nothing else, and the shared model all samples of the other entities. A new
    model so is the sum of samples that were kept, and the shared model loses exactly what it gains. Terms borrowed without
    supervision have shorter vectors and one model for all entities.

    What is known of entities is a table (`entities`: own, whether it has a model; last, its last reciprocal rank; and the sums of its
    samples), merged with a round's sums by entity and written. Models are made of the sums where an entity's candidates are. On the
    driver are the shared model and what tells progress: the means of the last two windows and the sum of the one that is open.
    """

    name = "hybrid"

    def __init__(self, config: PolicyConfig):
        super().__init__(config)
        self.entities: DataFrame | None = None
        self.windows: list[float] = []
        self.seen, self.open = 0, 0.0

    def stuck(self) -> bool:
        return len(self.windows) > 1 and self.windows[-2] >= self.windows[-1]

    def split(self, asked: DataFrame) -> None:
        """Gives models to the entities (id) that ask for one now."""
        if self.entities is None or not self.stuck():
            return
        poor = (~F.col("own")) & (F.col("last") <= self.config.rr_threshold)
        new = settled(self.entities.filter(poor).join(asked, "id", "left_semi"), "split")
        d = new.agg(F.max(F.size("moment"))).first()[0]
        if d is None:
            return
        if d > 0:
            gram, moment = bandit.collect_gram(bandit.total_gram(new.filter("moment IS NOT NULL")), d)
            self.local.add(-gram, -moment)
        rest = self.entities.join(new.select("id"), "id", "left_anti")
        self.entities = settled(rest.unionByName(new.withColumn("own", F.lit(True))), "entities")

    def score(self, candidates: DataFrame) -> DataFrame:
        self.split(candidates.select("id").distinct())
        if self.entities is None:
            return super().score(candidates)
        own = self.entities.filter("own").join(candidates.select("id").distinct(), "id", "left_semi")
        special = (~F.col("is_external")) & F.col("__own")
        rows = settled(candidates.join(own.select("id", F.lit(True).alias("__own")), "id", "left").withColumn("__own", F.coalesce("__own", F.lit(False))), "candidates")
        d = rows.filter(special).agg(F.max(F.size("x"))).first()[0]
        if d is None:
            return super().score(candidates)
        mine = bandit.score_by_entity(rows.filter(special).drop("__own"), own, d, self.config.alpha).withColumn("score", F.round("score", 9))
        return super().score(rows.filter(~special).drop("__own")).unionByName(mine)

    def _observe(self, samples: DataFrame) -> DataFrame:
        """Takes in a round's reciprocal ranks in their order; (id, last) of entities whose last one counts, those after the first window."""
        size = self.config.window_size
        turns = with_rank(samples.groupBy("interaction").agg(F.first("id").alias("id"), F.greatest(F.max("y"), F.lit(0.0)).alias("rr")), "interaction", name="place")
        turns = settled(turns.withColumn("place", F.col("place") + self.seen), "turns")
        window = F.floor((F.col("place") - 1) / size)
        sums = turns.groupBy(window.alias("w")).agg(F.sum("rr").alias("rr"), F.count("*").alias("n")).orderBy(F.desc("w")).limit(3).collect()
        first, opened, open_ = self.seen // size, self.seen % size, self.open
        self.open = 0.0
        for r in sorted(sums, key=lambda r: r["w"]):
            total, n = (r["rr"] + open_, r["n"] + opened) if r["w"] == first else (r["rr"], r["n"])
            if n == size:
                self.windows = [*self.windows[-1:], total / size]
            else:
                self.open = total
        self.seen = turns.agg(F.max("place")).first()[0] or self.seen
        return turns.filter(F.col("place") >= size).groupBy("id").agg(F.max_by("rr", "place").alias("last"))

    def update(self, samples: DataFrame) -> float | None:
        samples, seen = self._written(samples)
        last = self._observe(samples)
        new = settled(bandit.sums_by_id(samples.filter("NOT is_external")), "sums")
        known = self.entities if self.entities is not None else samples.sparkSession.createDataFrame([], f"{bandit.SUMS}, own boolean, last double")
        flags = known.select("id", "own", F.col("last").alias("before")).join(last, "id", "full_outer")
        flags = flags.select("id", F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("last", "before").alias("last"))
        merged = bandit.merged_sums(known.select("id", "n", "yy", "gram", "moment"), new).join(flags, "id", "full_outer").withColumn("own", F.coalesce("own", F.lit(False)))
        owners = known.filter("own")
        losses = bandit.losses_by_entity(owners, new, self.config.alpha).agg(F.sum("loss").alias("loss"), F.count("*").alias("n")).first()
        loss, models = losses["loss"] or 0.0, losses["n"]
        shared = new.join(owners.select("id"), "id", "left_anti")
        borrowed = samples.filter("is_external").select("x", "y")
        sizes = shared.agg(F.sum("n").alias("n"), F.sum("yy").alias("yy"), F.max(F.size("moment")).alias("d")).first(), {c: seen[f"{c}1"] for c in ("n", "yy", "d")}
        for model, cells, r in ((self.local, bandit.total_gram(shared), sizes[0]), (self.external, bandit.gram(borrowed), sizes[1])):
            if r["n"]:
                loss += model.learn(*bandit.collect_gram(cells, r["d"]), r["n"], r["yy"])
                models += 1
        self.entities = settled(merged, "entities")
        return loss / models if models else None

    def snapshot(self) -> tuple[dict, dict[str, DataFrame]]:
        values, tables = super().snapshot()
        return values | {"windows": self.windows, "seen": self.seen, "open": self.open}, tables | ({} if self.entities is None else {"entities": self.entities})

    def restore(self, values: dict, tables: dict[str, DataFrame]) -> None:
        super().restore(values, tables)
        self.windows, self.seen, self.open, self.entities = list(values["windows"]), values["seen"], values["open"], tables.get("entities")


class NeuralPolicy(Policy):
    """A network over term vectors and characteristics, with epsilon-greedy choice and replay.

    vectors: (keyword, vector). subwords, instead: a frozen model's output, as tables of sequences (id, sequence), terms' patterns
    (id, keyword, pattern) and the vectors of each place (id, pos, vector); a term's vector is the mean over its places, and terms
    that aren't found in their sequence are no candidates. A learned prefix before a frozen model needs that model and isn't here.
    """

    name, fresh = "neural", False

    def __init__(self, config: PolicyConfig, vectors: DataFrame | None = None, hidden: tuple[int, ...] = (512, 512), seed: int = 0, subwords: tuple[DataFrame, DataFrame, DataFrame] | None = None):
        super().__init__(config)
        self.vectors, self.hidden, self.seed, self.found_only = vectors, hidden, seed, subwords is not None
        if subwords:
            sequences, patterns, places = subwords
            self.vectors = settled(neural.mean_pool(places, neural.prepare(sequences, patterns)), "vectors")
        self.replay: neural.Replay | None = None
        self.width = 0

    def inputs(self, candidates: DataFrame) -> DataFrame:
        """Candidates with the network's inputs for x: a term's vector if there are any, its attribute if attributes are encoded,
        its characteristics. The shorter ones of borrowed terms are filled up with zeros."""
        rows, parts = candidates, []
        if self.vectors is not None:
            d = self.vectors.select(F.size("vector").alias("d")).first()["d"]
            keys = [c for c in ("id", "keyword") if c in self.vectors.columns]
            rows = rows.join(self.vectors.select(*keys, "vector"), keys, "inner" if self.found_only else "left")
            parts.append(F.coalesce(F.col("vector").cast("array<double>"), F.array_repeat(F.lit(0.0), d)))
        if self.config.attribute_encoding:
            # One input an attribute: the first layer's weights of it are the attribute's embedding, learned with all others.
            self.attrs = getattr(self, "attrs", None) or sorted(r["attr"] for r in candidates.select("attr").distinct().collect())
            ids = neural.attribute_ids(self.attrs)
            parts.append(F.array(*[F.when(F.col("attr") == a, 1.0).otherwise(0.0) for a in ids]))
        self.width = max(self.width, candidates.agg(F.max(F.size("x"))).first()[0] or 0)
        filled = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(self.width) - F.size("x")))
        return rows.withColumn("x", F.concat(*parts, filled)).drop("vector")

    def score(self, candidates: DataFrame) -> DataFrame:
        rows = self.inputs(candidates)
        first = rows.select(F.size("x").alias("d")).first()
        if self.replay is None and first is not None:
            self.replay = neural.Replay(neural.Network((first["d"], *self.hidden), self.config.learning_rate, self.seed), self.config.buffer_size, self.config.buffer_sample_size, self.config.split_sample, self.seed)
        return rows.withColumn("score", F.round(neural.score_column(self.replay.network, F.col("x")), 9) if first is not None else F.lit(0.0))

    def query(self, candidates: DataFrame, n: int, seed: int = 0) -> DataFrame:
        return epsilon_greedy(self.score(candidates), n, self.config.epsilon, seed)

    def update(self, samples: DataFrame) -> float | None:
        turns: dict[int, list[dict]] = {}
        for s in in_order(samples):
            turns.setdefault(s["interaction"], []).append(s)
        loss = None
        for rows in turns.values():
            self.replay.add(*_arrays(rows))
            loss = self.replay.fit()
        return loss

    def snapshot(self) -> tuple[dict, dict[str, DataFrame]]:
        if self.replay is None:
            return {}, {}
        values = self.replay.values() | {"width": self.width}
        return values | ({"attrs": self.attrs} if hasattr(self, "attrs") else {}), {}

    def restore(self, values: dict, tables: dict[str, DataFrame]) -> None:
        if values:
            c = self.config
            self.replay = neural.Replay.of(values, c.learning_rate, c.buffer_size, c.buffer_sample_size, c.split_sample, self.seed)
            self.width = values["width"]
            if "attrs" in values:
                self.attrs = values["attrs"]


def make(name: str, config: PolicyConfig, **how) -> Policy:
    return {p.name: p for p in (IdfPolicy, DatasetPolicy, HybridPolicy, NeuralPolicy)}[name](config, **how)
