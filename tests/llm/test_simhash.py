import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from querysmith.llm import simhash as s


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "É A b c d\x85e f", "x y z w v " * 50])
def test_fingerprint(text):
    assert s.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("seed", range(4))
def test_links_connect_what_is_near(spark, seed):
    """Balls around a few centres, distances from 0 to far, in both halves: the same components as all pairs give."""
    rng = np.random.default_rng(seed)
    fps = [0, 2**64 - 1]
    for _ in range(12):
        centre = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            fps.append(centre ^ sum(1 << int(f) for f in flips))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = s.links(df).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in links)
    roots = {r.node: r.root for r in s.components(s.links(df)).collect()} if links else {}
    want = brute_components(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    got = [roots.get(f, f) for f in signed]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_every_distance_in_every_split(spark):
    """Pairs at distances 1 to 4, with every way to share the flips between the halves, far from each other."""
    rng = np.random.default_rng(9)
    rows = []
    for low in range(5):
        for high in range(5 - low):
            for _ in range(6):
                a = int(rng.integers(0, 2**64, dtype=np.uint64))
                flips = [*rng.choice(32, low, replace=False), *(32 + rng.choice(32, high, replace=False))]
                rows.append((a, a ^ sum(1 << int(f) for f in flips)))
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    df = spark.createDataFrame([(signed(x),) for x in {x for pair in rows for x in pair}], "fp long")
    links = {(r.a, r.b) for r in s.links(df).collect()}
    for a, b in rows:
        if a != b:
            x, y = sorted((signed(a), signed(b)))
            assert ((x, y) in links) == ((a ^ b).bit_count() <= 3)


def same_components(links, fps):
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    pairs = [(r.a, r.b) for r in links.collect()]
    assert all(a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in pairs)
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    want, got = brute_components(fps), [find(f) for f in signed]
    return len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


@pytest.mark.parametrize("block", [1, 5, 40])
def test_crowded_halves(spark, block):
    """Halves that many have, low and high, and links from them to others: the same components however many keys are crowded."""
    rng = np.random.default_rng(block)
    fps = [0, 2**64 - 1]
    for shift in (0, 32):
        half = int(rng.integers(0, 2**32)) << shift
        fps += [half ^ int(x) << (32 - shift) for x in rng.integers(0, 2**32, 40)]
        for _ in range(12):
            other = int(rng.integers(0, 2**32)) << (32 - shift)
            for _ in range(10):
                flips = rng.choice(64, rng.integers(0, 6), replace=False)
                fps.append(half ^ other ^ sum(1 << int(f) for f in flips if rng.random() < 0.7 or shift <= f < shift + 32))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    assert not s.crowded(df, block).isEmpty() and same_components(s.links(df, block), fps)


def test_a_very_common_half(spark):
    """5,000 fingerprints with one high half: none of their keys reaches a task whole, and all that is near is found."""
    rng = np.random.default_rng(3)
    high = 0xDEADBEEF << 32
    fps = {high | int(x) for x in rng.integers(0, 2**32, 5000)}
    for f in sorted(fps)[:300]:
        fps.add(f ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").repartition(4)
    hot = {(r.half, r.key) for r in s.crowded(df).collect()}
    assert hot == {(1, 0xDEADBEEF)} | {(1, 0xDEADBEEF ^ 1 << k) for k in range(32)}
    rest = df.mapInArrow(s._emit, "half int, key long, fp long").join(s.crowded(df), ["half", "key"], "left_anti")
    assert rest.groupBy("half", "key").count().agg({"count": "max"}).first()[0] < 33 * s.BLOCK
    assert same_components(s.links(df), fps)


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1300)]
    found = {r.node: r.root for r in s.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert {found[i] for i in range(1, 201)} == {0} and {found[i] for i in range(1001, 1300)} == {1000}


def test_operator(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf in the dark wood " * 3
    rows = [(5, base, 1), (2, base.upper(), 2), (9, None, 3), (8, "  ", None), (7, "alone here now", 1), (None, base, 1), (7, "alone here now", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    out = s.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in out) == sorted([("5", 2), ("2", 2), ("9", 8), ("8", 8), ("7", 7), ("7", 7), ("None", 2)])
    assert {r.fingerprint for r in out if r.doc_id in (8, 9)} == {"0" * 16}
    assert sorted(str(r.doc_id) for r in s.one_of_each(df).collect()) == ["2", "7", "8", "None"]
    assert s.near_duplicates(df.limit(0)).count() == 0 and s.one_of_each(df.limit(0)).count() == 0


def test_ids_that_repeat(spark):
    """Unlike texts of one id both stay, alike ones count once, and which row stays doesn't depend on how the table is cut."""
    draw = np.random.default_rng(1)
    long = [" ".join(f"w{k}" for k in draw.integers(0, 10**6, 80)) for _ in range(4)]
    rows = [(1, long[0], "x", 1), (1, long[1], "x", 2), (2, long[0], "y", 3), (3, long[2], "b", 4), (3, long[2], "a", 5), (3, long[2], "c", 6), (4, long[3], None, None), (4, long[3], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string, id int")
    for parts in (1, 5):
        out = s.one_of_each(df.repartition(parts))
        assert out.dtypes == df.dtypes
        assert sorted((r.doc_id, long.index(r.text), r.th, r.id) for r in out.collect() if r.doc_id < 4) == [(1, 0, "x", 1), (1, 1, "x", 2), (3, 2, "a", 5)]
        assert [tuple(r) for r in out.filter("doc_id = 4").collect()] == [(4, long[3], None, None)]


def test_very_long_text(spark):
    text = " ".join(f"w{i % 977}" for i in range(150_000))
    rows = s.near_duplicates(spark.createDataFrame([(2, text), (1, text + " end"), (3, "short")], "doc_id long, text string")).collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert got[2][0] == f"{brute_fingerprint(text):016x}" and got[2][1] == got[1][1] == 1 and got[3][1] == 3
