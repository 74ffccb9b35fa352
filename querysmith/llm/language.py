"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed subwords (byte 2- to 4-grams of letters, word ends
included); a linear softmax over that average gives the language. Embeddings and softmax are trained by
stochastic gradient descent in numpy. A held-back part of the training rows calibrates the scores (one
temperature) and sets what a text needs to be accepted.

A softmax divides its mass among what it has learned and is as sure of foreign texts as of others. So there is a second
measure: the mean log share of a text's subwords in the likeliest language, against what is usual there, in units of the
spread that a text of so many subwords has. A text is rejected if either is below what held-back texts reach.

Fitting uses a bounded sample of the labelled rows; predicting covers every whole text.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .subwords import counts, has_letter, letters

#: Of the model and its fit. SAMPLE: most labelled rows a language that are fitted on, taken by a hash of their id and text.
BUCKETS, DIM, SAMPLE, EPOCHS, RATE = 4096, 16, 400, 30, 0.5
#: Labelled rows over all languages; so as many languages are learned at most, the most frequent.
TOTAL = 4096
#: Share of a calibration set's rightly labelled texts that either measure of rejection may cost; added to shares before their logarithm.
REJECT, RARE = 0.001, 1e-5
#: Temperatures that calibration chooses from; texts whose products are computed together.
TEMPERATURES, TEXTS = np.geomspace(1 / 64, 64, 61), 256


@dataclass
class Model:
    names: list[str]
    embed: np.ndarray  # buckets x dim
    soft: np.ndarray  # dim x languages
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    profile: np.ndarray | None = None  # languages x buckets: log shares
    centre: np.ndarray | None = None  # what is usual of each language
    fit_least: float = -np.inf

    def logits(self, average: np.ndarray) -> np.ndarray:
        return average @ self.embed @ self.soft + self.bias

    def proba(self, average: np.ndarray) -> np.ndarray:
        z = self.logits(average) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fits(self, average: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How usual texts are for languages `k`; the spread of a mean goes with the root of its squared weights."""
        return ((average * self.profile[k]).sum(axis=1) - self.centre[k]) / np.sqrt((average * average).sum(axis=1) + 1e-12)


def average(text: str) -> np.ndarray:
    """Shares of the hashed subwords, damped by a square root so that a repeated word doesn't decide alone."""
    x = np.sqrt(counts(letters(text), BUCKETS).astype(np.float32))
    return x / max(float(x.sum()), 1e-9)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [average(t.as_py()).astype("<f2").tobytes() for t in batch.column("text")]
        yield pa.record_batch({"lang": batch.column("lang"), "h": batch.column("h"), "x": pa.array(x, pa.binary())})


def train(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> Model:
    """A model fitted to four fifths of the rows; the others give its temperature.

    What rejection asks for comes from the other four fifths, each measured by a model of the rest, so that few rows tell too and no
    row gives both. With fewer than 20 rows all serve for all.
    """
    rng = np.random.default_rng(seed)
    parts = np.split(order := rng.permutation(len(x)), [len(x) * i // 5 for i in range(1, 5)]) if len(x) >= 20 else [order]
    model, odds, fits = None, [], []
    for i, held in enumerate(parts):
        own = _descend(x, y, order[~np.isin(order, held)] if len(parts) > 1 else order, names, rng)
        z = own.logits(x[held])
        if model is None:
            model = own
            model.temperature = float(min(TEMPERATURES, key=lambda t: _loss(z / t, y[held])))
        if i or len(parts) == 1:
            best = z.argmax(axis=1)
            right = best == y[held]
            odds.append(_odds(z[right] / model.temperature, best[right]))
            fits.append(own.fits(x[held][right], best[right]).astype(np.float64))
    odds, fits = np.concatenate(odds), np.concatenate(fits)
    if len(odds):
        # Odds have a longer tail below than a normal distribution; it is taken for that of a Laplace distribution.
        least = _reached(odds, np.log(2 * REJECT) * np.abs(odds - np.median(odds)).mean())
        model.least = float(1 / (1 + np.exp(-least)))
        model.fit_least = _reached(fits, NormalDist().inv_cdf(REJECT) * fits.std())
    return model


def gradient(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the weighted mean cross-entropy of a batch, by embeddings, softmax and bias."""
    hidden = x @ model.embed
    p = hidden @ model.soft + model.bias
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(x)), y] -= 1
    p *= weight[y, None] / len(x)
    return x.T @ (p @ model.soft.T), hidden.T @ p, p.sum(axis=0)


def _descend(x: np.ndarray, y: np.ndarray, rows: np.ndarray, names: list[str], rng: np.random.Generator) -> Model:
    """Stochastic gradient descent on the cross-entropy, over embeddings and softmax together."""
    k = max(len(names), 1)
    model = Model(names, rng.normal(0, 1, (BUCKETS, DIM)).astype(np.float32) * 0.3, np.zeros((DIM, k), np.float32), np.zeros(k, np.float32))
    weight = len(rows) / (k * np.maximum(np.bincount(y[rows], minlength=k), 1))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(rows), max(1, len(rows) // 16)):
            # Averages are small numbers; the scale belongs to the embeddings.
            embed, soft, bias = gradient(model, x[batch] * 30, y[batch], weight)
            model.soft -= rate * soft
            model.bias -= rate * bias
            model.embed -= rate * embed
    model.embed *= 30
    model.profile, model.centre = _profiles(x[rows], y[rows], k)
    return model


def _odds(z: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Log odds of the likeliest language, at most 500: probabilities near 1 don't tell them apart."""
    z = z.astype(np.float64)
    z -= z.max(axis=1, keepdims=True)
    others = np.exp(z)
    others[np.arange(len(z)), best] = 0
    return np.minimum(-np.log(np.maximum(others.sum(axis=1), 1e-300)), 500.0)


def _reached(values: np.ndarray, tail: float) -> float:
    """What all but REJECT of such values reach: their quantile, or `tail` from their median if they are too few to show it."""
    return float(min(np.quantile(values, REJECT), np.median(values) + tail * (1 + 1 / len(values)) ** 0.5))


def _profiles(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of subwords in each language, and the median of its rows' mean log shares, each row left out of its own."""
    profile, centre = np.full((k, x.shape[1]), np.log(RARE), np.float32), np.full(k, np.nan)
    for i in range(k):
        own = x[y == i]
        if len(own):
            total = own.sum(axis=0)
            profile[i] = np.log(total / len(own) + RARE)
        if len(own) > 1:
            centre[i] = np.median([float(r @ np.log(np.maximum(total - r, 0) / (len(own) - 1) + RARE)) for r in own])
    known = centre[~np.isnan(centre)]
    return profile, np.where(np.isnan(centre), np.median(known) if len(known) else np.log(RARE), centre)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    """Mean cross-entropy with Platt's targets: of n rows one more is taken to be wrong, or rows without an error would ask for no
    end of certainty."""
    z = z - z.max(axis=1, keepdims=True)
    logs = np.log(np.exp(z).sum(axis=1, keepdims=True)) - z
    own, wrong = logs[np.arange(len(y)), y], 1 / (len(y) + 2)
    others = (logs.sum(axis=1) - own) / max(z.shape[1] - 1, 1)
    return float(np.mean((1 - wrong) * own + wrong * others))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from at most `sample` rows a language among those where `learn` holds; None if there are none.

    Sampling is by a hash, not by position; features come from whole texts and only those (8 KB a row) reach the driver.
    All together have TOTAL rows at most: each language has its part, down to a row, and of more than TOTAL languages the
    most frequent (ties by name) are learned. What reaches the driver so has a bound, whatever the number of languages.
    """
    rows = docs.filter(learn & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").rlike(r"\p{L}"))
    rows = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(F.lit("language"), F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).alias("h"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(TOTAL).collect()
    if not sizes:
        return None
    sample = min(sample, TOTAL // len(sizes))
    # A share of each language by hash that holds about twice the sample, so that ranking moves few rows.
    top = float(2**63)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2 * sample + 50) / r["count"])) for r in sizes], "lang string, share double")
    picked = rows.join(F.broadcast(shares), "lang").filter((F.col("h").cast("double") / top + 1) / 2 <= F.col("share"))
    # Rows that repeat id and text have one hash and count once, or all copies would reach one group.
    picked = picked.groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = picked.select("lang", "text", "h").mapInArrow(_features, "lang string, h long, x binary").groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "x"))), 1, sample).alias("rows"))
    found = sorted(ranked.collect(), key=lambda r: r["lang"])
    names = [r["lang"] for r in found]
    x = np.stack([np.frombuffer(s["x"], "<f2").astype(np.float32) for r in found for s in r["rows"]])
    y = np.concatenate([np.full(len(r["rows"]), i) for i, r in enumerate(found)])
    return train(x, y, names)


def _predict(packed: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        if packed:
            saved = np.load(io.BytesIO(packed), allow_pickle=False)
            model = Model(saved["names"].tolist(), saved["embed"], saved["soft"], saved["bias"], float(saved["temperature"]), float(saved["least"]), saved["profile"], saved["centre"], float(saved["fit_least"]))
        for batch in batches:
            lang, score, accepted = ["und"] * batch.num_rows, [0.0] * batch.num_rows, [False] * batch.num_rows
            for at in range(0, batch.num_rows if model else 0, TEXTS):
                texts = batch.column("text").slice(at, TEXTS).to_pylist()
                known = [i for i, t in enumerate(texts) if has_letter(t)]
                if not known:
                    continue
                x = np.stack([average(texts[i]) for i in known])
                p = model.proba(x)
                best = p.argmax(axis=1)
                fits = model.fits(x, best)
                for i, k, own, fit in zip(known, best.tolist(), p.max(axis=1).tolist(), fits.tolist(), strict=True):
                    lang[at + i], score[at + i], accepted[at + i] = model.names[k], float(own), own >= model.least and fit >= model.fit_least
            yield pa.record_batch({"row": batch.column("row"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "accepted": pa.array(accepted, pa.bool_())})

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, out: str = "language") -> DataFrame:
    """The columns `keep` of `docs` (all by default) and `out`: a struct of lang_pred, score, accepted.

    lang_pred is the likeliest learned value, or `und` if the text is null or has no letter (score 0, not accepted; so is every
    text if nothing could be learned). accepted: the calibrated score and the fit to the language reach the model's thresholds. Nulls in other
    columns are handed through, repeated rows predicted each, ties go to the first value in order, a column named as `out`
    is replaced, an empty table stays empty. One pass without a shuffle; what is sent along is the model (under 1 MB, and 16 KB a language).
    """
    packed = None
    if model:
        np.savez_compressed(to := io.BytesIO(), names=np.array(model.names), embed=model.embed, soft=model.soft, bias=model.bias, temperature=model.temperature, least=model.least, profile=model.profile, centre=model.centre, fit_least=model.fit_least)
        packed = to.getvalue()
    kept = [c for c in keep or docs.columns if c.lower() != out.lower()]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = T.StructType.fromDDL("lang_pred string, score double, accepted boolean")
    found = rows.mapInArrow(_predict(packed), T.StructType([rows.schema["row"], *fields]))
    return found.select("row.*", F.struct("lang_pred", "score", "accepted").alias(out))
