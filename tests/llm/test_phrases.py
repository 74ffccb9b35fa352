"""Phrases against a plain count of everything, with small blocks and bounds too."""

import random
import re
from collections import Counter

import numpy as np

from querysmith.llm import phrases
from querysmith.llm.phrases import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, most=2000, longest=4, least=30, cover=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, words), longer in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * longer >= cover * found[lang, words[i : i + k]]:
                    covered.add((lang, words[i : i + k]))
    out = {}
    for (lang, words), a in found.items():
        if (lang, words) not in covered:
            cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -score) for lang, own in out.items() for i, (score, a, p, left, right) in enumerate(sorted(own)[:most], 1))


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, lang, text, 1) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, f long").repartition(3)
    return sorted(map(tuple, collocations(df, **how).select(*COLUMNS).collect()))


def made(seed, n=300):
    r = random.Random(seed)
    set_phrases = ["New York city", "as soon as possible", "in spite of", "ÉTÉ à la", "state of the art"]
    out = []
    for _ in range(n):
        words = [r.choice(["the", "of", "to", "Été", "x", "möglich", f"w{r.randrange(60)}", r.choice(set_phrases)]) for _ in range(r.randrange(60))]
        marks = [r.choice([" ", " ", " ", " ", "\t", ", ", ".", "\n", " - ", "\r\n"]) for _ in words]
        out.append((r.choice(["en", "en", "de", None, "und"]), "".join(w + m for w, m in zip(words, marks, strict=True))))
    return out + [("en", None), (None, ""), ("fr", "alone"), ("en", "same " * 400)]


def test_counts_cuts_and_covers(spark):
    rows = made(1)
    expected = plain(rows, least=12)
    assert len(expected) > 60 and {len(r[2].split()) for r in expected} == {2, 3, 4}
    assert found(spark, rows, least=12) == expected


def test_bits_instead_of_sets(spark):
    """Beyond the bound frequent phrases are bits, few enough here that others pass and are counted in vain; the dictionary goes
    through the texts in parts."""
    rows = made(2)
    assert found(spark, rows, least=12, bound=512) == plain(rows, least=12)


def test_small_blocks(spark, monkeypatch):
    rows = made(3)
    for name, value in (("BLOCK", 50), ("HELD", 40), ("WORDS", 30)):
        monkeypatch.setattr(phrases, name, value)
    assert found(spark, rows, least=12) == plain(rows, least=12)


def test_best_of_each_language(spark):
    rows = made(4)
    every = plain(rows, least=5)
    few = found(spark, rows, least=5, most=7)
    assert few == [r for r in every if r[1] <= 7]
    assert max(r[1] for r in every) > 7


def test_ties_go_to_the_phrase_in_byte_order(spark):
    rows = [("en", f"{p}. " * 3) for p in ("b z", "a z", "é z", "z z", "Z y")]
    assert found(spark, rows, least=3) == plain(rows, least=3)


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [("en", None), (None, ""), ("en", "a b. c")]) == []


def test_long_text_is_counted_whole(spark):
    rows = [("en", "Alpha beta, " * 200_000), ("en", "alpha beta gamma " * 50_000)]
    assert found(spark, rows) == plain(rows)


def test_hashes_are_those_of_spark(spark):
    r = random.Random(5)
    pairs = [(r.randrange(1 << 62), r.randrange(1 << 40)) for _ in range(50)] + [(0, 0)]
    p, q = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
    there = spark.createDataFrame(pairs, "p long, q long").selectExpr("p", "q", "xxhash64(p) AS one", "xxhash64(p, q) AS two").collect()
    found = {(a, b): (int(one), int(two)) for a, b, one, two in zip(p.tolist(), q.tolist(), phrases._mix(p, 42), phrases._mix(q, phrases._mix(p, 42)), strict=True)}
    assert all(found[t["p"], t["q"]] == (t["one"] % (1 << 64), t["two"] % (1 << 64)) for t in there)


def test_words_with_odd_bytes(spark):
    rows = [("en", "\x00a \x1cb\x85c ÀÉ\u2028x " * 40), ("en", "a\x0bb\x0cc\td " * 40)]
    assert found(spark, rows) == plain(rows)
