"""Order-dependent operators, with and without hot keys, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from crossloom.operators import sequences as S
from crossloom.operators.ordering import dense_index, draw, hot_keys, keyed_join, ordered_columns, top_per_key


@pytest.fixture(scope="module")
def events(spark):
    """User 1 holds most rows; many of its time stamps are equal."""
    rnd = random.Random(3)
    data = []
    for i in range(900):
        user = 1 if i % 3 else rnd.randrange(2, 12)
        ts = 0 if user == 1 and i % 2 else rnd.randrange(50)
        item = rnd.randrange(20)
        data.append((i, user, ts, item, "X" if item < 10 else "Y"))
    return spark.createDataFrame(data, "event_id long, user_id long, ts long, item_id int, domain string").repartition(5)


def by_user(events, *keys):
    groups = {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    return groups


@pytest.mark.parametrize("hot_rows", [10**9, 40])
def test_previous_next_and_position(events, rows, hot_rows):
    assert (hot_keys(events, ["user_id"], hot_rows) is None) == (hot_rows > 1000)
    got = ordered_columns(events, ["user_id"], ["ts", "event_id"], previous={"p": "item_id", "pd": "domain"},
                          following={"n": "item_id"}, position="pos", hot_rows=hot_rows)
    want = []
    for seq in by_user(events, "user_id").values():
        for i, r in enumerate(seq):
            before = seq[i - 1] if i else None
            want.append((r.event_id, before.item_id if before else None, before.domain if before else None,
                         seq[i + 1].item_id if i + 1 < len(seq) else None, i + 1))
    key = lambda t: t[0]
    assert sorted((tuple(r) for r in got.select("event_id", "p", "pd", "n", "pos").collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("hot_rows", [10**9, 40])
def test_domain_positions_and_transitions(events, rows, hot_rows):
    got = dict((r[0], (r[1], r[2], r[3])) for r in S.positions(events, hot_rows=hot_rows).select("event_id", "pos", "x_pos", "y_pos").collect())
    for seq in by_user(events, "user_id").values():
        x = y = 0
        for i, r in enumerate(seq):
            x, y = (x + 1, y) if r.domain == "X" else (x, y + 1)
            assert got[r.event_id] == (i + 1, x if r.domain == "X" else 0, y if r.domain == "Y" else 0)
    want = sorted((a.item_id, b.item_id) for s in by_user(events, "user_id", "domain").values() for a, b in zip(s, s[1:]))
    assert rows(S.transitions(events, within_domain=True, hot_rows=hot_rows), "src", "dst") == want


@pytest.mark.parametrize("hot_rows", [10**9, 40])
def test_labels_in_domain(events, hot_rows):
    history, truth = S.without_last(events, hot_rows=hot_rows), S.last_event(events)
    got = {r.event_id: r.label for r in S.next_in_domain(history, truth, hot_rows=hot_rows).collect()}
    final = {r.user_id: r for r in truth.collect()}
    labels = {}
    for (user, _), seq in by_user(history, "user_id", "domain").items():
        for i, r in enumerate(seq):
            t = final[user]
            nxt = seq[i + 1].item_id if i + 1 < len(seq) else (t.item_id if t.domain == r.domain else None)
            labels.setdefault(user, []).append((r.event_id, r.domain, nxt))
    want = {e: n for ls in labels.values() for e, _, n in ls
            if any(d == "X" and n is not None for _, d, n in ls) and any(d == "Y" and n is not None for _, d, n in ls)}
    assert got == want


def test_last_positions(events):
    got = {r.user_id: (r.x_last, r.y_last) for r in S.last_positions(events, hot_rows=40).collect()}
    for (user,), seq in by_user(events, "user_id").items():
        want = tuple(max((i - len(seq) for i, r in enumerate(seq) if r.domain == d), default=-1) for d in "XY")
        assert got[user] == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_keyed_join_with_hot_keys(spark, events, rows, how):
    small = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "user_id long, v string")
    want = rows(events.join(small, "user_id", how).select("event_id", *(["v"] if how == "inner" else [])))
    got = keyed_join(events, small, ["user_id"], how, hot_rows=40)
    assert rows(got.select("event_id", *(["v"] if how == "inner" else []))) == want
    assert S.min_activity(events, 60, hot_rows=40).count() == S.min_activity(events, 60).count() > 0


def test_top_per_key_beyond_group_limit(spark, events):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "100")
    got = top_per_key(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 1500)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
    assert got.count() == events.count()
    ranks = {r.event_id: r["rank"] for r in got.collect()}
    for seq in by_user(events, "user_id").values():
        assert [ranks[r.event_id] for r in reversed(seq)] == list(range(1, len(seq) + 1))


def test_hot_tail_is_cut_before_the_shuffle(events):
    plan = S.recent_events(events, 15)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("partitions", ["1", "4", "64"])
def test_dense_index_does_not_depend_on_partitions(spark, events, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.event_id: r.idx for r in dense_index(events.select("event_id", "ts"), ["ts", "event_id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(events.collect(), key=lambda r: (r.ts, r.event_id))
    assert got == {r.event_id: i for i, r in enumerate(order)}


def test_draw_is_spread_and_in_range(spark):
    d = spark.range(2000).select(draw(F.col("id"), F.lit(3), 7, 10).alias("d")).groupBy("d").count().collect()
    assert sorted(r.d for r in d) == list(range(10)) and min(r["count"] for r in d) > 120


def test_sequences_and_splits(spark, rows):
    data = [(i, 1, i, i) for i in range(20)] + [(100 + i, 2, i, i) for i in range(3)] + [(200 + i, 3, i, i) for i in range(2)]
    ev = spark.createDataFrame(data, "event_id long, user_id long, ts long, item_id int").withColumn("domain", F.lit("X"))
    seq = S.user_sequences(ev)
    assert rows(seq.select("user_id", F.col("seq.item_id").cast("string"))) == [(1, str(list(range(5, 20)))), (2, "[0, 1, 2]")]
    short = S.user_sequences(ev, max_len=1, least=3).select("user_id", F.col("seq.item_id").cast("string"))
    assert rows(short) == [(1, "[19]"), (2, "[2]")]
    assert S.min_activity(ev).select("user_id").distinct().count() == 2
    loo = S.leave_one_out(seq).filter("user_id = 2").select("split", F.col("seq.item_id").alias("s"), F.col("target.item_id").alias("t"))
    assert {r.split: (r.s, r.t) for r in loo.collect()} == {"train": ([0], None), "valid": ([0], 1), "test": ([0, 1], 2)}
    implicit = S.implicit_target(S.leave_one_out(seq)).filter("split = 'train'").select("user_id", "target.item_id")
    assert rows(implicit) == [(1, 17)]  # user 2 has a single training event and is skipped
    tail = spark.range(1).select(S.tail(F.array(F.lit(1), F.lit(2)), 5).alias("a"), S.head_without(F.array(F.lit(1)), 3).alias("b")).first()
    assert (tail.a, tail.b) == ([1, 2], [])


def test_every_second_row_only_when_even(spark, rows):
    assert rows(S.every_second_row(spark.range(6), ["id"])) == [(0,), (2,), (4,)]
    assert len(rows(S.every_second_row(spark.range(5), ["id"]))) == 5


def test_union_override_takes_the_later_table(spark, rows):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    assert rows(S.union_override(a, b, key=["k"])) == [(1, "a"), (2, "b"), (3, "b")]


def test_joins_with_any_number_of_hot_keys(spark, rows, monkeypatch):
    from crossloom.operators import ordering

    big = spark.range(400).select((F.col("id") % 7).alias("k"), "id").withColumn("k", F.when(F.col("id") > 100, 1).otherwise(F.col("k")))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (9, "d")], "k long, v string")
    for how in ("inner", "left"):
        want = rows(big.join(small, "k", how))
        for broadcast_keys in (0, 100):
            monkeypatch.setattr(ordering, "BROADCAST_KEYS", broadcast_keys)
            assert rows(ordering.keyed_join(big, small, ["k"], how, hot_rows=20)) == want
