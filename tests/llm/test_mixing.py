import re

import numpy as np

from querysmith.llm import mixing as m


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + ([None] if None in sizes else [])
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, open_w = total - sum(most * sizes[k] for k in capped), sum(w[k] for k in names if k not in capped)
        t = {k: most * sizes[k] if k in capped else left * w[k] / open_w for k in names}
        new = {k for k in names if t[k] > most * sizes[k] + 1e-9}
        if not new:
            return t
        capped |= new


def check_targets(spark, sizes):
    got = {r.source: r.target for r in m.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-6 * max(1, want[k]) for k in want)


def test_targets(spark):
    rng = np.random.default_rng(4)
    check_targets(spark, {"a": 100, "b": 100, "c": 100})
    check_targets(spark, {"a": 10_000, "b": 10, "c": 1})  # excess is shared again
    check_targets(spark, {"a": 5, "B": 1, None: 3, "é": 1000})
    check_targets(spark, {"only": 7})
    check_targets(spark, {"a": 0, "b": 4})
    check_targets(spark, {"a": 0})
    check_targets(spark, {f"s{i}": 4**i for i in range(14)})  # capped one after the other
    for _ in range(4):
        check_targets(spark, {f"s{i}": int(rng.lognormal(4, 2)) for i in range(12)})


def rows(seed=0, n=900):
    rng = np.random.default_rng(seed)
    out = [(i, "w " * int(rng.lognormal(3, 1)), ["a", "b", "c", None][int(rng.choice(4, p=[0.6, 0.1, 0.1, 0.2]))], i) for i in range(n)]
    return [*out, (1, None, "a", 1), (None, "one two", "b", 1), (7, "same text", "a", 0), (7, "same text", "a", 0), (8, "", "zero", None)]


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string, mix int").repartition(5)
    out = m.mix(df).collect()
    assert len(out) == len(data)
    sizes: dict = {}
    for _, text, source, _ in data:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    taken: dict = {}
    for r in out:
        x = r.mix
        assert x.taken == x.copies * x.size <= 3 * x.size and x.source_size == sizes[x.source]
        assert abs(x.target - want[x.source]) < 1e-6 * max(1, want[x.source])
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in want)
    again = m.mix(df.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.mix.size, str(r.mix.source), r.mix.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_copies(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, n_chars int")
    plan = {}
    for r in m.mix(df).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.mix.copies
    got = {r.doc_id: r["count"] for r in m.mixed(df).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}
    assert m.mixed(df).columns == df.columns


def test_all_one_text(spark):
    df = spark.createDataFrame([(i, "same words here", "a" if i % 3 else "b") for i in range(600)], "doc_id long, text string, source string")
    out = m.mix(df).collect()
    by: dict = {}
    for r in out:
        by[r.mix.source] = by.get(r.mix.source, 0) + r.mix.taken
    assert abs(by["a"] - 600) <= 3 and abs(by["b"] - 1200) <= 3


def test_empty(spark):
    assert m.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def brute_copies(cells):
    """Whole parts to all, then from the largest size down as many more as are nearest to what is missing."""
    out, missing = {}, 0.0
    for size, n, rate in sorted(cells, reverse=True):
        base = int(rate + 1e-9)
        missing += (rate - base) * size * n
        more = min(n, max(0, int(missing / size + 0.5))) if size and rate - base > 1e-9 else 0
        missing -= more * size
        out[size] = base * n + more
    return out


def test_rounding_against_brute_force(spark):
    data = rows(3)
    got: dict = {}
    for r in m.mix(spark.createDataFrame(data, "doc_id long, text string, source string, n int").repartition(4)).collect():
        got.setdefault(r.mix.source, {}).setdefault(r.mix.size, []).append((r.mix.rate, r.mix.copies))
    for cells in got.values():
        want = brute_copies([(size, len(found), found[0][0]) for size, found in cells.items()])
        assert {size: sum(c for _, c in found) for size, found in cells.items()} == want


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "x", "b"), (3, "y " * 50_000, "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r.mix for r in m.mix(df).collect()}
    assert got[1].size == 300_000 and got[1].taken in (0, 300_000) and got[3].taken <= 150_000 and got[3].target == 150_003


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 1.5, 7, "k")], "doc_id long, text string, source string, mix double, copy int, size string")
    out = m.mixed(df)
    assert out.dtypes == df.dtypes and out.collect() == df.collect()


def test_unsettled_rates_are_an_error(spark):
    import pytest

    cells = spark.createDataFrame([("a", 5, 10)], "key string, size long, n long")
    goals = spark.createDataFrame([("a", 50, 1.0)], "key string, source_size long, target double")
    with pytest.raises(RuntimeError, match="settled"):
        m.balance(cells, goals, rounds=2)
    assert abs(m.balance(cells, goals).first().rate - 0.02) < 1e-9


def test_null_ids_are_dealt_out(spark):
    """Documents without an id aren't one group of the last ranking."""
    from pyspark.sql import functions as F

    rows = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("source"))
    found = m.mix(rows, keep=["text"]).select("text", "mix.*")
    taken = {r.source: (r.taken, r.target) for r in found.groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()}
    assert found.count() == 2000 and all(abs(t - goal) <= 3 for t, goal in taken.values())
    salts = rows.select(F.pmod(F.xxhash64(F.lit("mix"), F.concat(F.lit("text "), F.xxhash64("text").cast("string"))), F.lit(8))).distinct().count()
    assert salts == 8
