"""Sequences in chunks against whole lists, with one user that has nine tenths of all events."""

import random

import pytest
from pyspark.sql import functions as F

from crossloom.operators import chunks as H

ORDER = ("ts", "event_id")


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(6)
    rows = [(e, 1 if rng.random() < 0.9 else rng.randrange(2, 12), rng.randrange(50), rng.randrange(9)) for e in range(1500)]
    rows += [(2000 + i, 20 + u, i, v) for u in range(3) for i, v in enumerate([4, 4, 7, 1, 4, 4, 7])]  # users of equal sequences
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts long, item_id int")
    lists = {}
    for e, u, ts, item in sorted(rows, key=lambda r: (r[2], r[0])):
        lists.setdefault(u, []).append(item)
    return df, lists


@pytest.fixture(scope="module", params=[(3, 100), (64, 100), (5000, 10**6)])
def table(request, events):
    size, hot_rows = request.param
    return H.chunked(events[0], ["user_id"], ORDER, ["item_id"], size, hot_rows).cache(), size


def test_chunks_hold_every_event_in_order(table, events):
    chunks, size = table
    found = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.user_id, r.chunk)):
        assert len(r.seq) <= size and r.first == r.chunk * size + 1
        found.setdefault(r.user_id, []).extend(e.item_id for e in r.seq)
    assert found == events[1]
    assert {r.user_id: r.length for r in H.lengths(chunks, ["user_id"]).collect()} == {u: len(x) for u, x in events[1].items()}
    rows = sorted((r.user_id, r.pos, r.item_id) for r in H.exploded(chunks, ["user_id"]).collect())
    assert rows == sorted((u, i + 1, v) for u, x in events[1].items() for i, v in enumerate(x))
    assert {(r.user_id, r.length) for r in H.with_length(chunks, ["user_id"], 5).collect()} == {(u, len(x)) for u, x in events[1].items()}


def test_borders_are_stitched(table, events):
    chunks, size = table
    got = [(r.user_id, *p) for r in H.pairs(chunks, ["user_id"], "item_id").collect() for p in r.pairs]
    assert sorted(got) == sorted((u, a, b) for u, x in events[1].items() for a, b in zip(x, x[1:]))
    for r in H.stitched(chunks, ["user_id"], 2).collect():
        rest = events[1][r.user_id][r.first - 1 + len(r.seq) :]
        assert [e.item_id for e in r.after] == rest[: min(2, size)]


def test_statistics(table, events):
    r = H.statistics(table[0], "user_id", "item_id").first()
    x = events[1]
    assert tuple(r) == (len(x), max(map(max, x.values())), max(x), min(v[-1] for v in x.values()), max(v[-1] for v in x.values()), max(map(len, x.values())))


def test_equal_sequences(table, events):
    items = F.transform("seq", lambda e: e["item_id"])
    kept = {r.user_id for r in H.distinct_sequences(table[0], "user_id", items).select("user_id").distinct().collect()}
    first = {}
    for u, x in sorted(events[1].items()):
        first.setdefault(tuple(x), u)
    assert kept == set(first.values()) and not {21, 22} & kept


def test_days_of_a_user_never_meet_those_of_another(spark):
    from datetime import datetime

    from crossloom.plans.views import Tables

    days = [datetime(1969, 1, 1), datetime(2024, 1, 1), datetime(2026, 9, 27), datetime(2031, 5, 5)]
    ev = spark.createDataFrame([(u, d) for u in (1, 2, 3) for d in days], "user_id long, ts timestamp")
    t = Tables(spark, "")
    t.__dict__["ev"] = ev
    assert t.ev_daily.select("user_id").distinct().count() == 12
