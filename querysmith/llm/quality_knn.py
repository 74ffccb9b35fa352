"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is a bag of terms: byte trigrams, runs of character classes (lower, upper, digit, symbol, mark, separator, space, line
end) and how far it repeats itself. Trigrams are weighted by damped frequency and inverse document frequency, counted over all
documents, and projected on the leading singular vectors of a bounded sample of labelled texts. The projected, labelled sample is what is sent along; every
document is multiplied with all of it, in blocks, and its nearest labelled texts vote, each weighted by its cosine.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .subwords import counts

#: Hashed trigrams, runs of four of eight classes, bins of repetition; latent dimensions, voters, most labelled rows a label.
GRAMS, RUNS, BINS, DIM, VOTERS, SAMPLE = 2048, 4096, 24, 48, 15, 1500
#: Lengths of the three groups of terms of a text: spelling, layout, repetition. Layout counts most, as quality shows in it.
SCALE_GRAMS, SCALE_RUNS, SCALE_BINS = 1.0, 1.5, 1.2
#: The share of its bytes to which zlib's fastest level packs ordinary prose of n bytes: PACKED + SHORT / log2(n + 4) ** 1.5.
PACKED, SHORT = 0.42, 2.2
#: Texts whose products are computed together.
TEXTS = 256

_CLASS = np.full(256, 5, np.uint8)  # other punctuation
_CLASS[list(range(97, 123)) + list(range(128, 256))] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "#$%&*<>@^~_=+{}[]\\"]] = 3
_CLASS[[ord(c) for c in "!?"]] = 4
_CLASS[[32, 9, 11, 12, 13]] = 6
_CLASS[10] = 7
_CLASS[ord("|")] = 7


def terms(text: str | None) -> np.ndarray:
    """Damped term frequencies of the whole text, each group of terms on a scale of its own; zeros for an empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(GRAMS + RUNS + BINS, np.float32)
    if not raw:
        return out
    grams = np.sqrt(counts(raw, GRAMS, (3,)).astype(np.float32))
    out[:GRAMS] = SCALE_GRAMS * grams / max(float(np.linalg.norm(grams)), 1e-9)
    kinds = _CLASS[np.frombuffer(raw, np.uint8)].astype(np.int64)
    if len(kinds) >= 4:
        runs = np.zeros(RUNS, np.int64)
        for at in range(0, len(kinds), 1 << 20):
            k = kinds[at : at + (1 << 20) + 3]
            runs += np.bincount(k[:-3] << 9 | k[1:-2] << 6 | k[2:-1] << 3 | k[3:], minlength=RUNS)
        own = np.sqrt(runs.astype(np.float32))
        out[GRAMS : GRAMS + RUNS] = SCALE_RUNS * own / max(float(np.linalg.norm(own)), 1e-9)
    # Repetition: how far a text packs, for its length; spread over two neighbouring bins.
    press = zlib.compressobj(1)
    packed = sum(len(press.compress(raw[i : i + (1 << 20)])) for i in range(0, len(raw), 1 << 20)) + len(press.flush())
    expected = PACKED + SHORT / np.log2(len(raw) + 4) ** 1.5
    place = min(max((np.log2(packed / len(raw) / expected) + 4) * 4, 0), BINS - 2)
    low = int(place)
    out[GRAMS + RUNS + low], out[GRAMS + RUNS + low + 1] = SCALE_BINS * (low + 1 - place), SCALE_BINS * (place - low)
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # terms x dim
    vectors: np.ndarray  # labelled texts x dim, of length 1
    labels: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of the votes for label 1: exact cosines with every labelled vector, the nearest vote; ties to the earlier one.

        Rows are filled up to whole blocks and cosines rounded, so that a text's score doesn't depend on what it is scored with."""
        whole = np.zeros((-(-len(x) // TEXTS) * TEXTS, x.shape[1]), np.float32)
        whole[: len(x)] = x
        near = np.concatenate([self.latent(whole[i : i + TEXTS]) @ self.vectors.T for i in range(0, len(whole), TEXTS)])[: len(x)].round(5)
        top = np.argsort(-near, axis=1, kind="stable")[:, :VOTERS]
        share = np.bincount(self.labels.astype(int), minlength=2) / len(self.labels)  # labels weigh alike, however many were found
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 1e-6).astype(np.float64) ** 4 / share[self.labels[top].astype(int)]
        out = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        return np.where(np.abs(x).sum(axis=1) > 0, out, self.prior)


def train(x: np.ndarray, y: np.ndarray, prior: float, seed: int = 3, frequency: tuple[int, np.ndarray] | None = None) -> Model:
    """A randomised singular value decomposition of the labelled sample. frequency: documents, and how many of them have each
    trigram bucket (those of the sample by default)."""
    documents, having = frequency or (len(x), (x[:, :GRAMS] > 0).sum(axis=0))
    idf = np.ones(x.shape[1], np.float32)
    idf[:GRAMS] = np.log((1 + documents) / (1 + having)) + 1
    rows = x * idf
    rng = np.random.default_rng(seed)
    dim = min(DIM, *rows.shape)
    q = np.linalg.qr(rows @ rng.normal(size=(rows.shape[1], min(dim + 10, min(rows.shape)))).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(rows @ np.linalg.qr(rows.T @ q)[0])[0]
    _, _, basis = np.linalg.svd(q.T @ rows, full_matrices=False)
    model = Model(idf, np.ascontiguousarray(basis[:dim].T), np.empty((0, dim), np.float32), y.astype(np.float32), prior)
    model.vectors = model.latent(x)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [zlib.compress(terms(t.as_py()).astype("<f2").tobytes(), 1) for t in batch.column("text")]
        yield pa.record_batch({"label": batch.column("label"), "h": batch.column("h"), "x": pa.array(x, pa.binary())})


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts to how many have each trigram bucket, and how many there are (bucket -1)."""
    having, n = np.zeros(GRAMS, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            if raw := (text.as_py() or "").encode("utf-8", "surrogatepass"):
                having += counts(raw, GRAMS, (3,)) > 0
                n += 1
    yield pa.record_batch({"bucket": pa.array(np.arange(-1, GRAMS), pa.int32()), "n": pa.array([n, *having.tolist()], pa.int64())})


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Of all texts: how many there are, and how many have each trigram bucket. A task sends GRAMS numbers, and so does the sum."""
    found = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_document_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    by = {r["bucket"]: r["n"] for r in found}
    return by.get(-1, 0), np.array([by.get(i, 0) for i in range(GRAMS)])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """A model from at most `sample` rows a label (0 and 1) among labelled documents where `learn` holds; None if there are none.

    Sampling is by a hash of the id; document frequencies are those of all documents. Ids and labels that are null don't count; of several labels of an id the largest does.
    """
    known = labels.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isin(0, 1)).groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("label"))
    known = known.withColumnRenamed("__id", id_col).filter(learn).withColumn("h", F.xxhash64(F.lit("quality"), F.col(f"`{id_col}`").cast("string")))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not sizes:
        return None
    # About twice the sample by hash, so that few rows are ranked; at most that many are kept, which bounds what is broadcast.
    most = 2 * sample + 50
    share = F.when(F.col("label") == 1, F.lit(min(1.0, most / sizes.get(1, 1)))).otherwise(F.lit(min(1.0, most / sizes.get(0, 1))))
    picked = known.filter((F.col("h").cast("double") / float(2**63) + 1) / 2 <= share).select(F.col(f"`{id_col}`").alias("__id"), "label", "h")
    picked = picked.withColumn("__n", F.row_number().over(Window.partitionBy("label").orderBy("h", "__id"))).filter(F.col("__n") <= most).drop("__n")
    texts = docs.filter(learn).select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(picked), "__id")
    # Rows that repeat an id count once (the first text in order), or all copies would reach one group.
    texts = texts.groupBy("label", "h").agg(F.min("text").alias("text"))
    ranked = texts.select("label", "h", "text").mapInArrow(_features, "label int, h long, x binary").groupBy("label").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "x"))), 1, sample).alias("rows"))
    found = sorted(ranked.collect(), key=lambda r: r["label"])
    if not found:
        return None
    x = np.stack([np.frombuffer(zlib.decompress(s["x"]), "<f2").astype(np.float32) for r in found for s in r["rows"]])
    y = np.concatenate([np.full(len(r["rows"]), r["label"]) for r in found])
    return train(x, y, sizes.get(1, 0) / sum(sizes.values()), frequency=document_frequencies(docs, text_col))


def _scores(packed: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        if packed:
            saved = np.load(io.BytesIO(packed), allow_pickle=False)
            model = Model(saved["idf"], saved["basis"], saved["vectors"], saved["labels"], float(saved["prior"]))
        for batch in batches:
            texts, out = batch.column("text"), []
            for i in range(0, batch.num_rows, TEXTS):
                part = texts.slice(i, TEXTS)
                out.append(model.score(np.stack([terms(t.as_py()) for t in part])) if model else np.full(len(part), 0.5))
            yield pa.record_batch({"row": batch.column("row"), "quality_score": pa.array(np.clip(np.concatenate(out), 0, 1).astype(np.float64) if out else [], pa.float64())})

    return run


def score_quality(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all by default) and `quality_score`, from 0 to 1: the weighted share of votes for label 1.

    Null and empty texts have no neighbours and get the share of label 1 among the labels; without a model every score is 0.5.
    Of equally near texts at the last place those earlier in the model's order (label 0 first, then by hash) vote. Repeated rows are scored each; nulls in other columns are handed through; a column named `quality_score` is
    replaced; an empty table stays empty. One pass without a shuffle; what is sent along is bounded by SAMPLE (about 2 MB).
    """
    packed = None
    if model:
        np.savez_compressed(to := io.BytesIO(), idf=model.idf, basis=model.basis.astype(np.float32), vectors=model.vectors.astype(np.float32), labels=model.labels, prior=model.prior)
        packed = to.getvalue()
    kept = [c for c in keep or docs.columns if c != "quality_score"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.mapInArrow(_scores(packed), T.StructType([rows.schema["row"], T.StructField("quality_score", T.DoubleType())]))
    return out.select("row.*", "quality_score")
