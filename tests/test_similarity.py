"""Blocked searches against brute force, with limits small enough to reach every path."""

import math
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossloom.operators import grounding as G
from crossloom.operators import similarity as M


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)], "X" if i % 3 else "Y") for i in range(150)]
    data[7] = (7, [0.0] * 8, "X")
    data[9] = (9, data[10][1], data[10][2])  # an exact tie
    return spark.createDataFrame(data, "id long, embedding array<float>, domain string"), data


def brute(data, metric, k, same_domain=True):
    ids = [d[0] for d in data]
    m = np.array([d[1] for d in data], dtype=float)
    if metric == "cosine":
        u = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
        s = u @ u.T
    elif metric == "dot":
        s = m @ m.T
    else:
        if metric == "l2_columns":
            m = m / np.linalg.norm(m, axis=0, keepdims=True)
        s = -np.linalg.norm(m[:, None] - m[None], axis=2)
    out = []
    for i, a in enumerate(data):
        found = sorted((-round(float(s[i, j]), 6) + 0.0, ids[j]) for j, b in enumerate(data)
                       if i != j and (not same_domain or a[2] == b[2]))[:k]
        out += [(a[0], n, r + 1) for r, (_, n) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2", "l2_columns"])
@pytest.mark.parametrize("block_rows, strategy", [(16, "blocks"), (2048, "auto"), (16, "pivots"), (300, "pivots")])
def test_dense_topk(vectors, rows, metric, block_rows, strategy):
    df, data = vectors
    got = M.dense_topk(df, df, 4, metric=metric, exclude_self=True, by=("domain",), block_rows=block_rows, strategy=strategy)
    assert rows(got, "id", "neighbor_id", "rank") == brute(data, metric, 4)


def test_dense_topk_text_ids_few_neighbours_and_zero_vectors(spark, rows):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0])], "id string, embedding array<double>")
    got = M.dense_topk(df, df, 5, exclude_self=True)
    assert rows(got, "id", "neighbor_id", "score") == [("a", "b", 0.0), ("a", "z", 0.0), ("b", "a", 0.0), ("b", "z", 0.0), ("z", "a", 0.0), ("z", "b", 0.0)]
    assert rows(M.dense_topk(df, df, 5, exclude_self=True, drop_zero=True), "id", "neighbor_id") == [("a", "b"), ("b", "a"), ("z", "a"), ("z", "b")]


@pytest.mark.parametrize("strategy", ["blocks", "pivots"])
def test_target_rank_counts_better_items(vectors, rows, strategy):
    df, data = vectors
    q = df.filter("id < 20").withColumn("truth", F.when(F.col("domain") == "X", 10).otherwise(9).cast("long"))
    q = q.filter((F.col("domain") == "X") | (F.col("id") % 3 == 0))
    got = dict(rows(M.dense_target_rank(q, df, by=("domain",), block_rows=16, strategy=strategy), "id", "rank"))
    for i, v, d in data[:20]:
        truth = 10 if d == "X" else 9
        if data[truth][2] != d:
            continue
        score = np.dot(v, data[truth][1])
        assert got[i] == 1 + sum(np.dot(v, b[1]) > score + 1e-5 for b in data if b[2] == d)


@pytest.fixture(scope="module")
def clustered(spark):
    """Twelve clusters far apart, ids in no order of theirs."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 10
    data = [(i, [float(x) for x in centres[i * 7 % 12] + rng.normal(size=6) * 0.1]) for i in range(960)]
    return spark.createDataFrame(data, "id long, embedding array<double>"), data


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2", "l2_rows", "l2_columns"])
def test_pivots_rule_out_cells(clustered, rows, monkeypatch, metric):
    df, data = clustered
    sent, meet = [], M._meet
    monkeypatch.setattr(M, "_meet", lambda q, cells, *a: sent.append((q.select(F.explode("_cells")).count(), cells.n_cells)) or meet(q, cells, *a))
    got = M.dense_topk(df, df, 5, metric=metric, exclude_self=True, block_rows=160, strategy="pivots")
    want = M.dense_topk(df, df, 5, metric=metric, exclude_self=True, strategy="blocks")
    assert rows(got) == rows(want)
    visited, cells = sum(n for n, _ in sent), sent[0][1]
    assert cells == 24 and visited < len(data) * cells / 2


def test_target_rank_counts_whole_cells(clustered, rows, monkeypatch):
    df, data = clustered
    q = df.withColumn("truth", ((F.col("id") * 31 + 5) % 960).cast("long"))
    sent, meet = [], M._meet
    monkeypatch.setattr(M, "_meet", lambda q, cells, *a: sent.append((q.select(F.explode("_cells")).count(), cells.n_cells)) or meet(q, cells, *a))
    got = rows(M.dense_target_rank(q, df, block_rows=160, strategy="pivots"), "id", "rank")
    assert got == rows(M.dense_target_rank(q, df, strategy="blocks"), "id", "rank")
    assert sum(n for n, _ in sent) < len(data) * sent[0][1] / 2


def test_pivots_with_groups_that_have_no_partner(spark, rows):
    q = spark.createDataFrame([(1, [1.0, 0.0], "X"), (2, [0.0, 1.0], None), (3, [1.0, 1.0], "Z")], "id int, embedding array<double>, domain string")
    lib = spark.createDataFrame([(4, [1.0, 0.0], "X"), (5, [0.0, 1.0], "Y"), (6, None, "Z")], "id int, embedding array<double>, domain string")
    for strategy in ("blocks", "pivots"):
        assert rows(M.dense_topk(q, lib, 2, by=("domain",), strategy=strategy), "id", "neighbor_id") == [(1, 4)]
    assert M.dense_topk(q, lib.limit(0), 2, by=("domain",), strategy="pivots").count() == 0


def test_kernel_shift_by_blocks(vectors):
    df, data = vectors
    m = np.array([d[1] for d in data])
    x = np.array([d[2] == "X" for d in data])
    d2 = ((m[:, None] - m[None]) ** 2).sum(2)
    n = len(m)
    w = d2.sum() / (n * n - n) / 4
    k = sum(np.exp(-d2 / (w * 2**i)) for i in range(5))
    want = k[np.ix_(x, x)].mean() + k[np.ix_(~x, ~x)].mean() - 2 * k[np.ix_(x, ~x)].mean()
    for block_rows in (16, 2048):
        assert abs(M.kernel_shift(df, block_rows=block_rows).first()["shift"] - want) < 2e-6
    want_linear = ((m[x].mean(0) - m[~x].mean(0)) ** 2).sum()
    assert abs(M.linear_shift(df).first()["shift"] - want_linear) < 2e-6


@pytest.fixture(scope="module")
def sets(spark):
    """Token 0 is in nearly every set, so it is hot under a small pair budget."""
    rnd = random.Random(11)
    data = {i: {0} | {rnd.randrange(1, 40) for _ in range(rnd.randrange(0, 6))} if i % 10 else {rnd.randrange(1, 40)} for i in range(120)}
    return spark.createDataFrame([(i, t) for i, s in data.items() for t in s], "id long, token int"), data


WAYS = [("join", 10**9), ("blocks", 1), ("auto", 1), ("auto", 10**9)]


@pytest.mark.parametrize("strategy,budget", WAYS)
def test_set_topk(sets, rows, strategy, budget):
    df, data = sets
    want = []
    for a, sa in data.items():
        sims = sorted((-round(len(sa & sb) / len(sa | sb), 6), b) for b, sb in data.items() if a != b and sa & sb)[:5]
        want += [(a, b, r + 1, -s) for r, (s, b) in enumerate(sims)]
    assert rows(M.set_topk(df, 5, pair_budget=budget, strategy=strategy), "id", "neighbor_id", "rank", "score") == sorted(want)


def okapi(docs, queries, m):
    """The ranking from its definition."""
    tok = {d: re.findall("[a-z0-9]+", t.lower()) for d, t in docs.items() if t.strip()}
    n, mean = len(tok), sum(map(len, tok.values())) / len(tok)
    df = Counter(t for ts in tok.values() for t in set(ts))
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = []
    for q, text in queries.items():
        words = re.findall("[a-z0-9]+", text.lower())
        scored = []
        for d, ts in tok.items():
            tf = Counter(ts)
            if set(words) & set(ts):
                s = sum(idf.get(w, 0.0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for w in words)
                scored.append((-round(s, 6) + 0.0, d))
        out += [(q, d, r + 1) for r, (_, d) in enumerate(sorted(scored)[:m])]
    return sorted(out)


@pytest.mark.parametrize("strategy,budget", WAYS)
def test_bm25_is_exact_on_every_path(spark, rows, strategy, budget):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = {i: " ".join(["the"] * rnd.randrange(0, 3) + rnd.choices(vocabulary, k=rnd.randrange(0, 8))) for i in range(150)}
    docs[150], docs[151] = "", "  "
    queries = {i: " ".join(rnd.choices([*vocabulary, "the", "the"], k=rnd.randrange(0, 4))) for i in range(60)}
    queries |= {i: "The the" for i in range(60, 90)}  # a very common answer made of a hot token
    q = spark.createDataFrame(list(queries.items()), "q_id long, q_text string")
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert rows(G.bm25(q, d, 6, pair_budget=budget, strategy=strategy), "q_id", "doc_id", "rank") == okapi(docs, queries, 6)


def traverse(left, right, k, kind, block, floor=None):
    """``_traverse`` on two lists of {token: weight}, right rows sorted by size."""
    lr, lt, lw = (np.array(x) for x in zip(*[(i, t, w) for i, r in enumerate(left) for t, w in r.items()]))
    rr, rt, rw = (np.array(x) for x in zip(*[(i, t, w) for i, r in enumerate(right) for t, w in r.items()]))
    floor = np.full(len(left), -np.inf) if floor is None else np.array(floor, float)
    return M._traverse(lr, lt, lw, np.array([len(r) for r in left], float), floor, np.full(len(left), -1),
                       rt, rr, rw, np.array([len(r) for r in right], float), np.arange(len(right)), k, kind, block)


def scored(left, right, k, kind):
    out = []
    for i, a in enumerate(left):
        found = []
        for j, b in enumerate(right):
            if a.keys() & b.keys():
                s = sum(a[t] * b[t] for t in a.keys() & b.keys())
                s = s / (len(a) + len(b) - s) if kind == "jaccard" else s / len(a) if kind == "overlap" else s
                found.append((-round(s, 6), j))
        out += [(i, j, -s) for s, j in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("kind", ["dot", "overlap", "jaccard"])
@pytest.mark.parametrize("block", [1, 3, 16])
def test_traversal_matches_all_pairs(kind, block):
    rng = random.Random(block)
    weight = (lambda: rng.choice([0.25, 0.5, 1.0, 2.0])) if kind == "dot" else (lambda: 1.0)
    make = lambda n: [{t: weight() for t in rng.sample(range(30), rng.randrange(1, 9))} for _ in range(n)]
    left, right = make(40), sorted(make(120), key=len)
    left[0] = {t: -w for t, w in left[0].items()} if kind == "dot" else left[0]
    rows, cols, scores, _ = traverse(left, right, 4, kind, block)
    assert sorted(zip(rows.tolist(), cols.tolist(), scores.tolist())) == sorted((i, j, s) for i, j, s in scored(left, right, 4, kind))


def test_traversal_skips_blocks():
    """Topics: only the blocks of a left row's topic can reach its k-th score; a token of all rows alone never can."""
    right = [{"all": 0.1, f"t{i // 32}": 1.0, f"u{i % 7}": 0.2} for i in range(640)]
    left = [{"all": 1.0, f"t{i}": 1.0, "u3": 1.0} for i in range(20)]
    vocabulary = {t: n for n, t in enumerate(sorted({t for r in right for t in r}))}
    left, right = ([{vocabulary[t]: w for t, w in r.items()} for r in side] for side in (left, right))
    rows, cols, scores, visited = traverse(left, right, 4, "dot", 16)
    assert sorted(zip(rows.tolist(), cols.tolist(), scores.tolist())) == sorted(scored(left, right, 4, "dot"))
    assert visited == 20 * 2  # of 20 * 40
    floor = [scored(left, right, 4, "dot")[4 * i + 3][2] for i in range(20)]
    assert traverse(left, right[:320], 4, "dot", 16, floor)[3] == 10 * 2  # a known score keeps the others from any block


def test_shards_that_cannot_win_are_not_visited(spark, monkeypatch):
    """Half of the left rows have their best partners among short texts, the others among long ones."""
    right = [(i, t, 1.0 / (1 + i % 2), 2 if i < 600 else 200) for i in range(1200) for t in ("all", f"{'s' if i < 600 else 'l'}{i % 4}")]
    left = [(i, t, w, 2) for i in range(40) for t, w in (("all", 0.01), (f"{'sl'[i % 2]}{i % 4}", 1.0))]
    left = spark.createDataFrame(left, "l_id long, token string, w double, l_size int")
    index = M.block_index(spark.createDataFrame(right, "r_id long, token string, w double, r_size int"), shard_rows=300)
    shipped, visit = [], M._visit
    monkeypatch.setattr(M, "_visit", lambda terms, *a: shipped.append(terms.select("l_id", "shard").distinct().count()) or visit(terms, *a))
    got = M.block_topk(left, index, 3, few=1)
    bounds = M.shard_bounds(left, index, "dot").count()
    assert index.shards * 40 == bounds >= 160
    assert sum(shipped) <= bounds / 2  # no row visits the shards of the other sizes
    want = M._by_pairs(left, index.rows, 3, "dot", False)
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("budget", [10**9, 1])
def test_overlap_ranking(spark, rows, budget):
    q = spark.createDataFrame([(1, "red red ball"), (2, "!!"), (3, "ball")], "q_id int, q_text string")
    d = spark.createDataFrame([(1, "a red ball"), (2, "blue ball"), (3, "red"), (4, "")], "doc_id int, text string")
    assert rows(G.token_overlap(q, d, 2, pair_budget=budget), "q_id", "doc_id", "score") == [(1, 1, 1.0), (1, 2, 0.5), (3, 1, 1.0), (3, 2, 1.0)]


def refine_inputs(spark):
    items = spark.createDataFrame([(1, "Red Ball", "Entertainment"), (2, "Blue Ball", "Education"), (3, "red ball", "Art"), (4, "Green Cube", "Office")],
                                  "item_id int, title string, domain string")
    preds = spark.createDataFrame(
        [(1, " RED ball ", "Art"), (2, "blue ball", "Art"), (3, "", "Art"), (4, "zzz", "Art"), (5, "green cube", "education")],
        "user_id int, prediction string, target_domain string")
    fallback = spark.createDataFrame([(2, 1, 3), (2, 2, 1)], "user_id int, rank int, item_id int")
    return items, preds, fallback


def test_refine(spark):
    from crossloom.operators.catalogue import title_index

    items, preds, fallback = refine_inputs(spark)
    out = {r.user_id: r for r in G.refine(preds, items, title_index(items), fallback).collect()}
    assert out[1].prediction.lower() == "red ball" and out[1].refined and not out[1].fallback
    assert (out[2].prediction, out[2].grounded_item_id, out[2].fallback) == ("red ball", 3, True)
    assert out[2].top_k_candidates == ["red ball", "Red Ball"] and out[2].prediction_original == "blue ball"
    assert (out[3].prediction, out[3].refined, out[3].grounded) == ("", False, False)
    assert (out[4].prediction, out[4].refined) == ("zzz", False)
    assert out[5].prediction == "Green Cube" and out[5].grounded_score >= 1.0
    counters = G.refine_counters(G.refine(preds, items, title_index(items), None)).first()
    assert counters.asDict() == {"total": 5, "grounded": 3, "in_domain": 2, "fallback": 0, "not_refined": 3}


def test_exact_title_keeps_place_or_is_inserted(spark, rows):
    hits = spark.createDataFrame([(1, 5, 0.4, 1), (1, 7, 0.3, 2), (2, 5, 0.4, 1), (2, 6, 0.3, 2)], "q_id int, item_id int, score double, rank int")
    queries = spark.createDataFrame([(1, "Seven"), (2, "seven ")], "q_id int, q_text string")
    titles = spark.createDataFrame([("seven", 7)], "title_key string, item_id int")
    out = G.exact_title_boost(hits, queries, titles, 2)
    assert rows(out, "q_id", "rank", "item_id", "score") == [(1, 1, 5, 0.4), (1, 2, 7, 1.0), (2, 1, 7, 1.0), (2, 2, 5, 0.4)]
    top = G.exact_title_boost(hits, queries, titles, 2, boost_to_top=True)
    assert rows(top.filter("rank = 1"), "q_id", "item_id") == [(1, 7), (2, 7)]


def test_zero_and_missing_vectors_lose_nobody(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, [0.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0, None])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    for k in (2, 3, 4):
        for metric in ("l2_rows", "cosine", "l2"):
            got = M.dense_topk(v, v, k, metric=metric, exclude_self=True).collect()
            assert {r.id for r in got} == {1, 2, 3, 4, 5} and len(got) == 5 * min(k, 4)
            assert {r.neighbor_id for r in got if r.id == 1 and r["rank"] == 1} == {2}


def test_exclude_self_with_text_ids(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    got = M.dense_topk(v, v, 1, exclude_self=True).collect()
    assert {(r.id, r.neighbor_id) for r in got} == {("a", "b"), ("b", "a"), ("c", "b")}


def test_all_ways_agree_at_the_rounding_border(spark, rows):
    """Sums that lie on a border of the rounding, added in different orders on every way."""
    rng = random.Random(4)
    weights = [0.1, 0.2, 0.3, 0.0000005, 0.0000015, 1 / 3, 0.7]
    data = [(i, t, rng.choice(weights)) for i in range(60) for t in rng.sample(range(12), 7)]
    left = spark.createDataFrame(data, "l_id int, token int, w double").withColumn("l_size", F.lit(7))
    right = left.toDF("r_id", "token", "w", "r_size")
    results = {(strategy, n): rows(M.sparse_topk(left.repartition(n), right.repartition(n), 5, strategy=strategy)) for strategy in ("blocks", "join") for n in (1, 3)}
    first = next(iter(results.values()))
    assert all(r == first for r in results.values()) and len(first) == 300


def _task_of(cells, queries, how):
    """The function that ``Cells`` maps over batches, without a session."""

    class Captured:
        schema = T.StructType([T.StructField("id", T.LongType())])

        def mapInArrow(self, task, schema):
            return task

    return cells._map(Captured(), how, "_cells array<int>")(iter([queries]))


def test_lists_of_cells_are_bounded_in_memory():
    """2048 cells that every one of 4000 queries reaches: lists leave in slices and are never Python numbers."""
    rng = np.random.default_rng(2)
    groups = {(): (0, rng.normal(size=(2048, 4)), np.full(2048, 100.0), np.ones(2048, np.int64))}
    cells = M.Cells(None, SimpleNamespace(value=([], "dot", groups)), 2048)
    floor = pa.array([0.0] * 4000)
    queries = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(rng.normal(size=(4000, 4)).tolist()), floor], ["id", "embedding", "_floor"])
    tracemalloc.start()
    seen, most = 0, 0
    for b in _task_of(cells, queries, "reaching"):
        lists = b.column(3)
        assert lists[0].as_py() == list(range(2048)) and len(lists.flatten()) == 2048 * b.num_rows
        seen, most = seen + b.num_rows, max(most, len(lists.flatten()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 4000 and most <= M.CELLS and peak < 150 << 20


def test_best_with_and_without_a_floor():
    """Entries that round to the k-th score count as equal; a floor the k best reach does not change the rows."""
    rng = np.random.default_rng(4)
    scores = np.round(rng.normal(size=(50, 400)), 2) + rng.normal(size=(50, 400)) * 1e-7
    scores[3, 5] = np.nan
    allowed = rng.random(scores.shape) < 0.9
    allowed[7] = False
    want = []
    for i in range(50):
        cells = [(-(np.round(s, 6) + 0.0), j) for j, s in enumerate(scores[i]) if allowed[i, j] and not np.isnan(s)]
        want += [(i, j, -s) for s, j in sorted(cells)[:5]]
    kth = {i: s for i, _, s in want}
    floor = np.array([kth.get(i, np.nan) if i % 3 else np.nan for i in range(50)])
    for f in (None, floor):
        assert list(zip(*(x.tolist() for x in M._best(scores, allowed, 5, f)))) == want


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2", "l2_rows"])
def test_single_precision_leaves_no_best_entry_out(metric, monkeypatch):
    """Ties, near copies and long vectors: the entries of ``_best``, although few pairs are scored in double precision."""
    rng = np.random.default_rng(12)
    b = rng.normal(size=(3000, 16)) * rng.choice([1e-3, 1.0, 50.0], size=(3000, 1))
    b[1500:1700] = b[:200]
    b[1700:1900] = b[:200] + rng.normal(size=(200, 16)) * 1e-7
    b[5] = 0
    a = b[:400]
    left, right = np.arange(400), np.arange(3000) % 2900
    a, b = M._placed(a, metric), M._placed(b, metric)
    direct = -np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)) if metric.startswith("l2") else a @ b.T
    want = M._best(direct, left[:, None] != right, 4, None)
    scored, pairs = [], M._pair_scores
    monkeypatch.setattr(M, "_pair_scores", lambda a, b, rows, *rest: scored.append(len(rows)) or pairs(a, b, rows, *rest))
    kth = np.full(400, np.nan)
    kth[want[0]] = want[2]
    for floor in (np.full(400, np.nan), np.where(np.arange(400) % 3, kth, np.nan)):
        got = M._k_best(a, b, metric, 4, floor, left, right)
        assert [x.tolist() for x in got] == [x.tolist() for x in want]
    assert sum(scored) < a.shape[0] * b.shape[0] / 10  # of two runs
    few = M._k_best(a, b[:3], metric, 4, np.full(400, np.nan), left, right[:3])
    assert [x.tolist() for x in few] == [x.tolist() for x in M._best(direct[:, :3], left[:, None] != right[:3], 4, None)]


def test_dense_topk_of_very_large_and_undefined_components(spark, rows):
    data = [(1, [1e30, 0.0]), (2, [2e30, 1.0]), (3, [float("nan"), 1.0]), (4, [1.0, 2.0])]
    df = spark.createDataFrame(data, "id long, embedding array<double>")
    got = rows(M.dense_topk(df, df, 1, metric="l2", exclude_self=True), "id", "neighbor_id")
    assert got == [(1, 4), (2, 1), (4, 1)] or got == [(1, 2), (2, 1), (4, 1)]


def _jaccard(data, others, k):
    want = []
    for a, sa in data.items():
        sims = sorted((-math.floor(len(sa & sb) / len(sa | sb) * 1e6 + 0.5) / 1e6, b) for b, sb in others.items() if a != b and (sa & sb) - {None})[:k]
        want += [(a, b, r + 1, -s) for r, (s, b) in enumerate(sims)]
    return sorted(want)


def _set_rows(spark, data):
    return spark.createDataFrame([(i, t) for i, s in data.items() for t in s], "id long, token int").repartition(3)


@pytest.mark.parametrize("query_rows,set_rows", [(8192, 1 << 20), (100, 90)])
def test_set_matrix(spark, rows, monkeypatch, query_rows, set_rows):
    """Tokens of several words of bits, copies (ties go to the smaller id) and NULL tokens, over few and many blocks."""
    monkeypatch.setattr(M, "QUERY_ROWS", query_rows)
    monkeypatch.setattr(M, "SET_ROWS", set_rows)
    rnd = random.Random(13)
    data = {i: {rnd.randrange(150) for _ in range(rnd.randrange(1, 20))} for i in range(500)}
    data.update({i: data[i - 400] for i in range(500, 560)})
    data[3] = data[3] - {None} | {0, 63, 64, 127, 128}
    for i in (600, 601):  # a NULL counts in the size and matches nothing
        data[i] = {1, 2, i}
    nulls = _set_rows(spark, {i: s for i, s in data.items()}).unionByName(spark.createDataFrame([(600, None), (700, None), (None, 5)], "id long, token int"))
    data[600] = {1, 2, 600, None}
    assert rows(M.set_topk(nulls, 6, strategy="matrix"), "id", "neighbor_id", "rank", "score") == _jaccard(data, data, 6)
    others = {i: {rnd.randrange(100, 900) for _ in range(30)} for i in range(200)}
    del data[600]
    got = M.set_topk(_set_rows(spark, data), 6, _set_rows(spark, others), strategy="matrix")
    assert rows(got, "id", "neighbor_id", "rank", "score") == _jaccard(data, others, 6)


def test_sets_that_all_share_tokens_skip_the_index(spark, rows, monkeypatch):
    def index(*args, **kwargs):
        raise AssertionError("an index rules nothing out here")

    monkeypatch.setattr(M, "block_topk", index)
    rnd = random.Random(14)
    data = {i: set(rnd.sample(range(30), 8)) for i in range(300)}
    assert rows(M.set_topk(_set_rows(spark, data), 5, pair_budget=1000), "id", "neighbor_id", "rank", "score") == _jaccard(data, data, 5)
