"""LinUCB: scores in Arrow batches, sufficient statistics as distributed sums, small inverses on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


@dataclass
class LinUCB:
    """A = I + sum x x', b = sum y x, theta = inverse(A) b; made when the first vectors tell the dimension."""

    alpha: float = 0.2
    a: np.ndarray | None = None
    b: np.ndarray | None = None
    inverse: np.ndarray | None = field(default=None, repr=False)
    theta: np.ndarray | None = field(default=None, repr=False)

    def start(self, d: int) -> LinUCB:
        if self.a is None:
            self.a, self.b = np.eye(d), np.zeros(d)
            self._solve()
        return self

    def _solve(self) -> None:
        self.inverse = np.linalg.inv(self.a)
        self.theta = self.inverse @ self.b

    @property
    def is_fitted(self) -> bool:
        return self.a is not None

    def weights(self) -> np.ndarray | None:
        return self.theta

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Expected reward and the bonus for what is little known."""
        self.start(x.shape[1])
        return x @ self.theta + self.alpha * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, self.inverse, x), 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> float:
        """Adds samples; returns the mean squared error before."""
        self.start(x.shape[1])
        loss = float(np.mean((x @ self.theta - y) ** 2))
        self.add(x.T @ x, x.T @ y)
        return loss

    def add(self, gram: np.ndarray, moment: np.ndarray) -> None:
        """Adds sums that were taken elsewhere."""
        self.start(len(moment))
        self.a, self.b = self.a + gram, self.b + moment
        self._solve()

    def learn(self, gram: np.ndarray, moment: np.ndarray, n: int, yy: float) -> float:
        """Adds the sums of n samples (yy: of squared rewards) and returns their mean squared error before, which the sums tell."""
        self.start(len(moment))
        loss = float(self.theta @ gram @ self.theta - 2 * self.theta @ moment + yy) / n
        self.add(gram, moment)
        return max(loss, 0.0)

    def remove(self, x: np.ndarray, y: np.ndarray) -> None:
        self.add(-(x.T @ x), -(x.T @ y))


def score_column(model: LinUCB, x: Column, d: int) -> Column:
    """The model's scores as a column; sent along are theta and the inverse, d * (d + 1) numbers."""
    model.start(d)
    theta, inverse, alpha = model.theta, model.inverse, model.alpha

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        m = np.stack(xs.to_numpy()) if len(xs) else np.empty((0, d))
        return pd.Series(m @ theta + alpha * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", m, inverse, m), 0)))

    return score(x)


def score_by_key(models: dict[str, LinUCB], other: LinUCB, key: Column, x: Column, d: int) -> Column:
    """Scores by a model of the row's key, or the other model. Sent along are the models given, so give those of a round."""
    ready = {k: (m.start(d).theta, m.inverse) for k, m in models.items()}
    rest, alpha = (other.start(d).theta, other.inverse), other.alpha

    @F.pandas_udf("double")
    def score(keys: pd.Series, xs: pd.Series) -> pd.Series:
        out = np.empty(len(xs))
        for k in keys.unique():
            theta, inverse = ready.get(k, rest)
            m = np.stack(xs[keys == k].to_numpy())
            out[(keys == k).to_numpy()] = m @ theta + alpha * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", m, inverse, m), 0))
        return pd.Series(out)

    return score(key, x)


def cold_score(x: Column, alpha: float = 0.2) -> Column:
    """Scores before the first update, by built-in functions: alpha times the vector's length."""
    return F.lit(alpha) * F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def gram(samples: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(i, j, v): sums of x_i x_j, and of y x_i at j = -1. Each partition sends one row a cell, whatever its size."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                m = np.stack(batch[x].to_numpy())
                own = np.column_stack([m.T @ m, m.T @ batch[y].to_numpy(float)])
                total = own if total is None else total + own
        if total is not None:
            d = len(total)
            i, j = np.divmod(np.arange(d * (d + 1)), d + 1)
            yield pd.DataFrame({"i": i, "j": np.where(j == d, -1, j), "v": total.ravel()})

    return samples.select(x, y).mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


#: What an entity's samples add up to: their number, squared rewards, sum of x x' (row by row) and of y x.
SUMS = "id string, n long, yy double, gram array<double>, moment array<double>"


def sums_by_id(samples: DataFrame) -> DataFrame:
    """SUMS of samples (id, x, y). Each task sends a row for each entity in it, so an entity with very many samples is no large group."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, own in batch.groupby("id"):
                m, y = np.stack(own["x"].to_numpy()), own["y"].to_numpy(float)
                rows.append((key, len(y), float(y @ y), (m.T @ m).ravel(), m.T @ y))
            yield pd.DataFrame(rows, columns=["id", "n", "yy", "gram", "moment"])

    parts = samples.select("id", "x", "y").mapInPandas(partial, SUMS)
    return parts.groupBy("id").agg(F.sum("n").alias("n"), F.sum("yy").alias("yy"), vector_sum("gram"), vector_sum("moment"))


def vector_sum(c: str) -> Column:
    """The sum of arrays of one length in a group of a few rows, in an order that doesn't depend on how they arrive."""
    lists = F.array_sort(F.collect_list(c))
    return F.aggregate(F.slice(lists, 2, 1 << 30), F.element_at(lists, 1), lambda a, b: F.zip_with(a, b, lambda u, v: u + v)).alias(c)


def merged_sums(known: DataFrame, new: DataFrame) -> DataFrame:
    """SUMS of both tables, entity by entity."""
    a, b = known.alias("a"), new.alias("b")
    both = lambda c: F.when(F.col(f"a.{c}").isNull(), F.col(f"b.{c}")).when(F.col(f"b.{c}").isNull(), F.col(f"a.{c}"))
    vectors = [both(c).otherwise(F.zip_with(f"a.{c}", f"b.{c}", lambda u, v: u + v)).alias(c) for c in ("gram", "moment")]
    return a.join(b, "id", "full_outer").select("id", *[(F.coalesce(f"a.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0))).alias(c) for c in ("n", "yy")], *vectors)


def total_gram(sums: DataFrame) -> DataFrame:
    """(i, j, v) as of `gram`: what rows of SUMS add up to. Each task sends one row a cell."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for g, m in zip(batch["gram"], batch["moment"], strict=True):
                own = np.column_stack([np.reshape(g, (len(m), len(m))), m])
                total = own if total is None else total + own
        if total is not None:
            d = len(total)
            i, j = np.divmod(np.arange(d * (d + 1)), d + 1)
            yield pd.DataFrame({"i": i, "j": np.where(j == d, -1, j), "v": total.ravel()})

    return sums.select("gram", "moment").mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def from_sums(gram, moment, d: int, alpha: float) -> LinUCB:
    """The model of what was summed; none of it if there is nothing."""
    model = LinUCB(alpha).start(d)
    if moment is not None:
        model.add(np.reshape(gram, (d, d)), np.asarray(moment))
    return model


def score_by_entity(rows: DataFrame, sums: DataFrame, d: int, alpha: float) -> DataFrame:
    """Candidates (id, x, ...) with `score` by their entity's own model, made from its sums where its candidates are."""

    def score(candidates: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates):
            return candidates.assign(score=pd.Series(dtype=float))
        model = from_sums(own["gram"].iloc[0], own["moment"].iloc[0], d, alpha) if len(own) else from_sums(None, None, d, alpha)
        return candidates.assign(score=model.predict(np.stack(candidates["x"].to_numpy())))

    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    return rows.groupBy("id").cogroup(sums.select("id", "gram", "moment").groupBy("id")).applyInPandas(score, schema)


def losses_by_entity(known: DataFrame, new: DataFrame, alpha: float) -> DataFrame:
    """(loss): mean squared errors of new samples' sums under the models before, for each entity in both tables."""

    def loss(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                d = len(r.moment)
                model = from_sums(r.g, r.m, d, alpha)
                out.append(model.learn(np.reshape(r.gram, (d, d)), np.asarray(r.moment), r.n, r.yy))
            yield pd.DataFrame({"loss": out}, dtype=float)

    before = known.select("id", F.col("gram").alias("g"), F.col("moment").alias("m"))
    return new.join(before, "id").mapInPandas(loss, "loss double")


def collect_gram(cells: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums as arrays: d * (d + 1) numbers."""
    a, b = np.zeros((d, d)), np.zeros(d)
    for r in cells.collect():
        if r["j"] < 0:
            b[r["i"]] = r["v"]
        else:
            a[r["i"], r["j"]] = r["v"]
    return a, b


def mse(samples: DataFrame, prediction: str = "score", y: str = "y") -> DataFrame:
    return samples.agg(F.avg(F.pow(F.col(prediction) - F.col(y), F.lit(2.0))).alias("loss"))
