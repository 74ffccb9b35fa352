import random

import numpy as np
from pyspark.sql import functions as F

from querysmith.llm import language, subwords

WORDS = {"en": "the and of with that which from this have house water people", "de": "der und die mit dass welche aus diese haben haus wasser leute", "fr": "le et les avec que dont des cette avoir maison eau gens"}


def corpus(n=40):
    draw = random.Random(1)
    return [(i, " ".join(draw.choices(WORDS[lang].split(), k=12)), lang) for i, lang in enumerate(list(WORDS) * n)]


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = language.fit(df, F.col("doc_id") % 4 != 2)
    out = language.identify(df, model).filter("doc_id % 4 = 2").collect()
    assert sum(r.lang == r.language.lang_pred for r in out) == len(out)
    assert all(0 <= r.language.score <= 1 and r.language.accepted for r in out)


def test_cases(spark):
    df = spark.createDataFrame(corpus(8), "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True))
    odd = [(1, None, "en"), (2, "", None), (3, "123 !? 4", "xx"), (None, "der und die", None), (None, "der und die", None), (5, "the house " * 30000, "en")]
    rows = language.identify(spark.createDataFrame(odd, "doc_id long, text string, language string"), model).collect()
    assert [r.language.lang_pred for r in rows] == ["und", "und", "und", "de", "de", "en"]
    assert not any(r.language.accepted for r in rows[:3]) and rows[0].language.score == 0
    assert language.identify(df.limit(0), model).count() == 0
    assert language.fit(df.limit(0), F.lit(True)) is None
    assert {r.language.lang_pred for r in language.identify(df, None).collect()} == {"und"}


def test_counts_don_t_depend_on_blocks():
    raw = bytes(range(256)) * 20
    assert (subwords.counts(raw, 512, (2, 3), block=1 << 20) == subwords.counts(raw, 512, (2, 3), block=100)).all()


def test_unlearned_languages_and_junk_are_rejected(spark):
    draw = random.Random(2)
    model = language.fit(spark.createDataFrame(corpus(100), "doc_id long, text string, lang string"), F.lit(True))
    foreign = ["nie jest to na się że do jak ale tak co po czy już tylko być może przez który także", "ja on ei se että hän oli minä mutta kun niin mitä tämä sitten kuin joka vain ovat"]
    odd = [" ".join(draw.choices(words.split(), k=30)) for words in foreign for _ in range(30)]
    odd += [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(30)) for _ in range(30)]
    odd += ["x" * 200, "qzx " * 50, "zzzz 123 ### kkkk 55 vvvv -- wwww jjjj"]
    clean = [" ".join(draw.choices(WORDS[lang].split(), k=12)) for lang in list(WORDS) * 100]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd + clean)], "doc_id long, text string")
    accepted = {r.doc_id for r in language.identify(df, model).filter("language.accepted").collect()}
    assert not [odd[i] for i in accepted if i < len(odd)]
    assert len(accepted) >= 0.98 * len(clean)


def test_every_language_is_learned(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 12)}{w}" for w in ("ra", "so", "mi", "tu")), f"l{i % 300}") for i in range(600)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert set(model.names) == {f"l{i}" for i in range(300)}


def test_letters():
    assert all(subwords.has_letter(t) for t in ("a", "1 é", "漢", "ʰ", "_x_", "²x"))
    assert not any(subwords.has_letter(t) for t in (None, "", "12", "²", "½", "Ⅷ", "_-!", "٣", "😀", "² ½ Ⅷ 3"))


def test_gradient_against_differences(monkeypatch):
    draw = np.random.default_rng(0)
    x, y, weight = draw.random((5, 12)), np.array([0, 1, 2, 1, 0]), np.array([0.5, 1.0, 2.0])
    model = language.Model(list("abc"), draw.normal(size=(12, 4)), draw.normal(size=(4, 3)), draw.normal(size=3))

    def loss():
        z = model.logits(x)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        return float(np.mean(-np.log(p[np.arange(5), y]) * weight[y]))

    for part, found in zip((model.embed, model.soft, model.bias), language.gradient(model, x, y, weight), strict=True):
        for at in np.ndindex(part.shape):
            kept = part[at]
            part[at] = kept + 1e-6
            up = loss()
            part[at] = kept - 1e-6
            down = loss()
            part[at] = kept
            assert abs((up - down) / 2e-6 - found[at]) < 1e-6


def test_predictions_against_brute_force(spark):
    """Scores, decisions and ties of a whole batch (over several blocks) against a plain loop over each text's n-grams."""
    draw = random.Random(9)
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True))
    texts = [" ".join(draw.choices(sum((w.split() for w in WORDS.values()), []), k=draw.randint(1, 20))) for _ in range(600)] + ["", "123", "²", "x" * 5000]
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        raw = subwords.letters(r.text)
        grams: dict = {}
        for width in (2, 3, 4):
            for i in range(len(raw) - width + 1):
                code = width
                for b in raw[i : i + width]:
                    code = (code * 257 + b) % 2**32
                bucket = (code * 2654435769 % 2**32) >> (32 - 12)
                grams[bucket] = grams.get(bucket, 0) + 1
        if not any(c.isalpha() for c in r.text):
            assert (r.language.lang_pred, r.language.score, r.language.accepted) == ("und", 0.0, False)
            continue
        total = sum(n**0.5 for n in grams.values())
        z = model.bias.astype(float).copy()
        for bucket, n in grams.items():
            z += n**0.5 / total * (model.embed[bucket].astype(float) @ model.soft.astype(float))
        p = np.exp((z - z.max()) / model.temperature)
        p /= p.sum()
        assert abs(r.language.score - p.max()) < 1e-3
        if np.sort(p)[-1] - np.sort(p)[-2] > 1e-3:
            assert r.language.lang_pred == model.names[int(p.argmax())]


def test_ties_and_repeated_rows(spark):
    """Two languages with the same texts: the first name wins every tie; copies of a row count once in the sample."""
    rows = [(i // 2, f"same words {i // 2 % 5}", "ab"[i % 2]) for i in range(60)] + [(0, "same words 0", "a")] * 500
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.names == ["a", "b"]
    out = language.identify(spark.createDataFrame([(1, "same words 1")] * 3, "doc_id long, text string"), model).collect()
    assert len(out) == 3 and len({r.language for r in out}) == 1 and abs(out[0].language.score - 0.5) < 0.2
    tied = language.Model(["a", "b"], np.zeros((language.BUCKETS, 2), np.float32), np.zeros((2, 2), np.float32), np.zeros(2, np.float32), 1.0, 0.0, np.zeros((2, language.BUCKETS), np.float32), np.zeros(2))
    assert {r.language.lang_pred for r in language.identify(spark.createDataFrame([(1, "x"), (2, "y z")], "doc_id long, text string"), tied).collect()} == {"a"}


def test_unseen_scripts_are_rejected(spark):
    model = language.fit(spark.createDataFrame(corpus(100), "doc_id long, text string, lang string"), F.lit(True))
    odd = ["漢字 漢字 日本語 " * 5, "это совсем другой язык и другие буквы " * 3, "Αυτό είναι ένα άλλο κείμενο " * 3, "asdf jkl qwer uiop zxcv bnm " * 4]
    rows = language.identify(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()
    assert not any(r.language.accepted for r in rows)


def test_very_many_languages_have_a_bound(spark, monkeypatch):
    """20,000 values of lang: what is collected and learned doesn't grow with them, and the frequent ones are learned."""
    monkeypatch.setattr(language, "TOTAL", 256)
    common = [(i, text, lang) for i, text, lang in corpus(30)]
    rows = common + [(1000 + i, f"word{i} other{i}", f"x{i}") for i in range(20_000)]
    seen = []
    monkeypatch.setattr(language, "train", lambda x, y, names: seen.append((len(x), names)) or "model")
    assert language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)) == "model"
    assert seen[0][0] <= 256 and len(seen[0][1]) == 256 and set(seen[0][1]) >= {lang for *_, lang in common}
