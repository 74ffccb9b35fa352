import os
import random
import re

import pytest

import corpus_pipeline as p
from querysmith.llm import language, quality_rules, simhash

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    kept = [r for r in rows if quality_rules.judge(r.text)[6]]
    stage = p.quality(spark, docs, DATA)
    assert sorted(r.doc_id for r in stage.collect()) == sorted(r.doc_id for r in kept) and stage.columns == docs.columns
    stage2 = p.one_language(spark, stage, DATA)
    assert {r.doc_id for r in stage2.collect()} <= {r.doc_id for r in kept} and stage2.count() >= 0.97 * len(kept)
    stage3 = p.near_duplicates(spark, stage2, DATA)
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in stage2.collect()}
    left = {r.doc_id for r in stage3.collect()}
    for a in left:
        assert not any(a != b and (fps[a] ^ fps[b]).bit_count() <= 3 for b in left)
    assert all(any((fps[a] ^ fps[b]).bit_count() <= 3 for b in fps if b != a) for a in fps.keys() - left)
    stage4 = p.mixture(spark, stage3, DATA)
    assert stage4.columns == docs.columns and {r.doc_id for r in stage4.collect()} <= left
    pieces = p.packed(spark, stage4, DATA).toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() == 2048
    assert len(p.STAGES) == 5 and language.BUCKETS


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_failing_lines_are_removed(spark):
    body = "\n".join(" ".join(f"word{i * 9 + j}" for j in range(9)) + "." for i in range(8))
    rows = [(1, "Home | News | Sport | Contact\n" + body + "\nRead more", "en", "a", 0), (2, body, "en", None, None), (3, "Home | News | Sport | Contact", "en", "a", 29)]
    got = {r.doc_id: r for r in p.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), DATA).collect()}
    assert got.keys() == {1, 2}
    assert got[1].text == got[2].text == body and got[1].n_chars == got[2].n_chars == len(body)
    assert (got[1].source, got[2].source, got[1].lang) == ("a", None, "en")


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, quality double, language string, mix string, copy int, `__kept` int, th string"


def odd_corpus():
    """Clean texts of two languages from two sources and none, with copies, repeated rows, nulls in every column, empty, short,
    letterless and very long texts, and columns named as the operators name theirs."""
    draw = random.Random(6)
    words = {"en": "the and of with that which from this have house water people river stone".split(), "de": "der und die mit dass welche aus diese haben haus wasser leute fluss stein".split()}

    def text(lang, n=60):
        return "\n".join(" ".join(draw.choice(words[lang]) + str(draw.randrange(50)) * draw.randrange(2) for _ in range(12)) + "." for _ in range(n // 12))

    rows = [(i, text(lang), lang, draw.choice(["a", "b", None]), 0) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(200, rows[0][1], "en", "a", None), (201, rows[0][1] + " end", "en", "a", 1), (3, rows[3][1], rows[3][2], rows[3][3], 0)]
    rows += [(300, None, "en", "a", 0), (301, "", "de", None, 0), (302, "123 456 " * 20, None, "a", 0), (303, "short text", "en", "b", 0), (None, text("en"), None, None, None), (304, text("en", 60_000), "en", "a", 1)]
    rows += [(305, "Home | News | Sport | Contact\n" + text("de", 120), "de", "b", 5)]
    return [(*r, 0.5, "own", None if r[0] is None else "m", 7, 8, "t") for r in rows]


def counted(rows):
    out: dict = {}
    for r in rows:
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


def test_odd_rows_and_clashing_names_through_all_stages(spark):
    """Every stage against a plain form of its rule, on the rows that the one before kept."""
    docs = spark.createDataFrame(odd_corpus(), SHAPE).repartition(4)
    shape = docs.dtypes

    kept = p.quality(spark, docs, DATA)
    want = [(r[0], j[7], r[2], r[3], len(j[7]), *r[5:]) for r in odd_corpus() if (j := quality_rules.judge(r[1]))[6]]
    assert kept.dtypes == shape and counted(kept.collect()) == counted(want)
    assert not {300, 301, 303} & {r[0] for r in want} and (304 in {r[0] for r in want}) and not any("Home |" in r[1] for r in want)

    known = p.one_language(spark, kept, DATA)
    left = counted(known.collect())
    assert known.dtypes == shape and all(left[r] == counted(want)[r] for r in left)
    assert not any(r[0] == 302 for r in left) and sum(left.values()) >= 0.95 * len(want) and any(r[0] is None for r in left)

    single = p.near_duplicates(spark, known, DATA)
    found, fps = single.collect(), {r: simhash.fingerprint(r[1]) for r in left}
    assert single.dtypes == shape and max(counted(found).values()) == 1
    for r in left:
        near = [s for s in left if (fps[r] ^ fps[s]).bit_count() <= 3 and s[0] is not None]
        if len(near) == 1 and r in near:
            assert r in counted(found)
    assert {0, 200} & {r.doc_id for r in found} == {0} and any(r.doc_id is None for r in found)
    ids = [r.doc_id for r in found]
    assert not any((fps[tuple(a)] ^ fps[tuple(b)]).bit_count() <= 3 for a in found for b in found if a.doc_id is not None and b.doc_id is not None and a.doc_id < b.doc_id)

    mixed = p.mixture(spark, single, DATA)
    copies = counted(mixed.collect())
    assert mixed.dtypes == shape and set(copies) <= {tuple(r) for r in found} and max(copies.values()) <= 3
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    own = {s: sum(size(r) for r in found if r.source == s) for s in ("a", "b", None)}
    took = {s: sum(size(r) * n for r, n in copies.items() if r[3] == s) for s in own}
    total = sum(own.values())
    level = {"a": 1, "b": 2, None: 3}
    capped = {s for s in own if total * level[s] / 6 > 3 * own[s]}
    assert all(took[s] <= 3 * own[s] for s in own) and abs(sum(took.values()) - total) <= max(size(r) for r in found)
    assert all(abs(took[s] - 3 * own[s]) <= 80 for s in capped)

    pieces = p.packed(spark, mixed, DATA).toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() == 2048 and set(pieces.doc_id.dropna().astype(int)) == {r[0] for r in copies if r[0] is not None}
    whole = pieces[pieces.start + pieces.length == pieces.doc_tokens]
    assert len(whole) == sum(copies.values()) and len(ids) == len(found)
