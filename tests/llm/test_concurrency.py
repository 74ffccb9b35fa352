"""The sweep of open sales: trees against plain arrays, rows against a loop over every nation's moments."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querysmith.llm.concurrency import RangeAddTree, open_sales

EPOCH = dt.datetime(1970, 1, 1)
SALES = "sale_id long, client_id long, total double, sold_at timestamp_ntz, nation string"
LINES = "sale_id long, shipped_at timestamp_ntz"
CLIENTS = "client_id long, nation_id int"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 40), st.integers(-9, 9)), max_size=30))
def test_tree_is_an_array(n, updates):
    updates = [(min(a, n), min(b, n), v) for a, b, v in updates]
    tree, plain = RangeAddTree(n), np.zeros(n, np.int64)
    if updates:
        tree.add(*zip(*updates, strict=True))
    for a, b, v in updates:
        plain[a:b] += v
    values, highest, top = tree.query()
    assert values.tolist() == plain.tolist()
    assert highest.tolist() == np.maximum.accumulate(plain).tolist()
    assert top == plain.max()


def minute(t):
    return int((t - EPOCH).total_seconds()) // 60 * 60


def plain(sales, lines, clients):
    nations, ends = {}, {}
    for client, nation in clients:
        if client is not None and nation is not None:
            nations[client] = min(nation, nations.get(client, nation))
    for sale, shipped in lines:
        if sale is not None and shipped is not None:
            ends[sale] = min(shipped, ends.get(sale, shipped))
    events = {}
    for sale, client, total, sold, _ in sales:
        if sold is None:
            continue
        start, end = minute(sold), minute(ends[sale]) + 7 * 86400 if sale in ends else None
        if end is not None and end <= start:
            continue
        cents = 0 if total is None or not np.isfinite(total) else int(np.floor(100 * total + 0.5))
        for nation in (nations.get(client, -1), -2):
            for at, sign in ((start, 1), (end, -1)):
                if at is not None:
                    n, c = events.setdefault(nation, {}).get(at, (0, 0))
                    events[nation][at] = (n + sign, c + sign * cents)
    out = []
    for nation, changes in events.items():
        moments = sorted(at for at, change in changes.items() if change != (0, 0))
        n = c = high = 0
        own = []
        for i, at in enumerate(moments):
            n, c = n + changes[at][0], c + changes[at][1]
            high = n if not i else max(high, n)
            own.append([nation, at, moments[i + 1] if i + 1 < len(moments) else None, n, c, high])
        out += [(*r, r[4] == max(x[4] for x in own)) for r in own]
    return sorted(out)


def swept(spark, sales, lines, clients):
    found = open_sales(spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), spark.createDataFrame(clients, CLIENTS))
    return sorted(map(tuple, found.select("nation_id", "from_s", "to_s", "n_open", "open_cents", "high_open", "is_peak").collect()))


def made(seed, n):
    r = random.Random(seed)
    day = lambda most: EPOCH + dt.timedelta(days=19700, seconds=r.randrange(most * 86400))
    clients = [(i if r.random() < 0.95 else None, r.choice([None, 1, 2, 3])) for i in range(30)] + [(3, 2), (3, 1), (3, None)]
    sales = [(i if r.random() < 0.97 else None, r.choice([None, 7, 7, 7, r.randrange(40)]), r.choice([None, 0.0, -3.25, 1.005, float("nan"), float("inf"), r.random() * 100]), None if r.random() < 0.05 else day(20), "x") for i in range(n)]
    sales += r.sample(sales, n // 10)
    lines = [(r.choice([None, 5, r.randrange(n + 20)]), None if r.random() < 0.2 else day(25)) for _ in range(2 * n)]
    return sales, lines, clients


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 400)])
def test_rows_are_those_of_a_loop(spark, seed, n):
    rows = made(seed, n)
    expected = plain(*rows)
    assert len(expected) > 30
    assert swept(spark, *rows) == expected


def test_one_nation_over_many_partitions_and_batches(spark):
    """Carries cross batches and partitions: small batches, one nation with almost all moments."""
    sales, lines, clients = made(3, 600)
    clients = [(c, 1) for c, _ in clients]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert swept(spark, sales, lines, clients) == plain(sales, lines, clients)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty_tables(spark):
    sales, lines, clients = made(4, 20)
    assert swept(spark, [], lines, clients) == []
    assert swept(spark, sales, [], []) == plain(sales, [], [])
    assert swept(spark, [], [], []) == []


def test_changes_that_cancel_and_ends_before_starts(spark):
    at = EPOCH + dt.timedelta(days=19800)
    week = dt.timedelta(days=7)
    # Sale 1 ends in the minute in which sale 2 starts with as many cents; sale 3 ends as it starts; sale 4 lies within one minute.
    sales = [(1, 1, 5.0, at, ""), (2, 1, 5.0, at + week, ""), (3, 1, 9.0, at + week, ""), (4, 1, 9.0, at + week + dt.timedelta(seconds=59), "")]
    lines = [(1, at), (3, at), (4, at + dt.timedelta(seconds=30))]
    assert swept(spark, sales, lines, [(1, 4)]) == [(-2, minute(at), None, 1, 500, 1, True), (4, minute(at), None, 1, 500, 1, True)]


def test_times_with_a_zone_are_utc(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    found = {}
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found[zone] = swept(spark, *made(5, 30))
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
    assert found["UTC"] == found["America/New_York"]
