import random

from pyspark.sql import functions as F

from querysmith.llm import quality_knn as q


def corpus(n=120):
    draw = random.Random(2)
    words = "river stone happy window garden little morning across bright paper winter summer".split()
    docs, labels = [], []
    for i in range(n):
        picked = draw.choices(words, k=60)
        good = i % 2
        docs.append((i, " ".join(picked).capitalize() + "." if good else "### ".join(picked) if i % 4 else "!! ".join(w.upper() for w in picked)))
        labels.append((i, good, 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = q.fit(d, lab, F.col("doc_id") % 5 != 0)
    out = {r.doc_id: r.quality_score for r in q.score_quality(d, model, keep=["doc_id"]).collect()}
    held = [(i, good) for i, good, _ in labels if i % 5 == 0]
    assert all((out[i] >= 0.3) == bool(good) for i, good in held)


def test_votes_are_those_of_brute_force(spark):
    import numpy as np

    docs, labels = corpus(60)
    model = q.train(np.stack([q.terms(t) for _, t in docs]), np.array([g for _, g, _ in labels]), 0.5)
    x = np.stack([q.terms(t) for _, t in docs[:10]])
    near = model.latent(x) @ model.vectors.T
    for i, score in enumerate(model.score(x)):
        top = sorted(range(60), key=lambda j: (-round(float(near[i, j]), 5), j))[: q.VOTERS]
        w = [max(near[i, j], 1e-6) ** 4 for j in top]
        assert abs(score - sum(a * labels[j][1] for a, j in zip(w, top, strict=True)) / sum(w)) < 1e-5


def test_cases(spark):
    docs, labels = corpus(40)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = q.fit(d, lab, F.lit(True))
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "river stone " * 40000, 3), (2, "x", 3)], "doc_id long, text string, quality_score int")
    out = q.score_quality(odd, model).collect()
    assert len(out) == 4 and all(0 <= r.quality_score <= 1 for r in out) and out[0].quality_score == out[1].quality_score
    assert q.score_quality(odd.limit(0), model).count() == 0
    assert q.fit(d, lab.limit(0), F.lit(True)) is None and q.score_quality(odd, None).first().quality_score == 0.5


def test_document_frequencies_cover_all_documents(spark):
    docs = [(i, t) for i, t in enumerate(["abcd", "abc", None, "", "xyz abc", "abc" * 50_000])] * 3
    n, having = q.document_frequencies(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    want = sum(((q.counts(t.encode(), q.GRAMS, (3,)) > 0).astype(int) for _, t in docs if t), start=0)
    assert n == 12 and (having == want).all()
    none, zero = q.document_frequencies(spark.createDataFrame([], "doc_id long, text string"))
    assert none == 0 and not zero.any()


def test_scores_don_t_depend_on_neighbours_in_a_batch(spark):
    """A text's score alone, among others, and at another place in the block; repeated labelled vectors tie at the last place."""
    import numpy as np

    docs, labels = corpus(80)
    x = np.stack([q.terms(t) for _, t in docs])
    model = q.train(np.concatenate([x, x]), np.array([g for _, g, _ in labels] * 2), 0.5)
    whole = model.score(x)
    for i in (0, 7, 41):
        assert model.score(x[i : i + 1])[0] == whole[i] == model.score(x[i:])[0]


def test_repeated_rows_count_once_in_the_sample(spark):
    docs, labels = corpus(40)
    once = q.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    more = q.fit(spark.createDataFrame(docs + [docs[0]] * 200, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    assert once.vectors.shape == more.vectors.shape == (40, 40)


def test_decomposition_against_numpy():
    """The randomised decomposition spans what the exact one does."""
    import numpy as np

    draw = np.random.default_rng(0)
    x = np.abs(draw.normal(size=(300, 5)) @ draw.normal(size=(5, q.GRAMS + q.RUNS + q.BINS))).astype(np.float32)
    model = q.train(x, np.arange(300) % 2, 0.5)
    rows = x * model.idf
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    mine, exact = np.linalg.norm(rows @ model.basis[:, :5]), np.linalg.norm(rows @ v[:5].T)
    assert abs(mine - exact) < 1e-3 * exact and np.allclose(model.basis.T @ model.basis, np.eye(model.basis.shape[1]), atol=1e-3)
