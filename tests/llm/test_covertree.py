import numpy as np
import pytest
from llm_helpers import roots
from pyspark.sql import functions as F

from crossloom.llm import covertree

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(e, label):
    return label is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)


def brute(rows, threshold=0.98):
    links, edges = [0] * len(rows), []
    for i, (a, x, g) in enumerate(rows):
        for j, (b, y, h) in enumerate(rows[:i]):
            if g == h and usable(x, g) and usable(y, h) and len(x) == len(y):
                u, v = np.array(x, float), np.array(y, float)
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    edges.append((a, b))
    top = roots(edges)
    return sorted((a, n, top.get(a, a), top.get(a, a) == a) for (a, _, _), n in zip(rows, links))


def clusters(seed, dim=16):
    r = np.random.default_rng(seed)
    rows = []
    for label in (1, 2, None):
        for _ in range(12):
            c = r.standard_normal(dim)
            rows += [(c + r.standard_normal(dim) * r.choice([0.02, 0.1, 0.2]), label) for _ in range(r.integers(1, 9))]
    c = r.standard_normal(dim)
    rows += [(c, 2)] * 6 + [(2 * c, 2)] * 3
    order = r.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in rows[j][0]], rows[j][1]) for i, j in enumerate(order)]


@pytest.mark.parametrize("options", [{}, {"block": 8, "cell_rows": 4}, {"block": 3, "cell_rows": 1}])
def test_matches_brute_force(spark, options):
    rows = clusters(1)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("unit", F.lit("clash"))
    assert sorted(map(tuple, covertree.near_vectors(table, **options).collect())) == brute(rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [0.0, 0.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 1), (8, [3e38, 0.0], 1),
            (9, [1e-40, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (12, [1.0, -0.0], 1), (13, [1.0, 0.0], 2), (14, [-1.0, 0.0], 1)]
    got = sorted(map(tuple, covertree.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows) and dict((r[0], r[1]) for r in got)[7] == 3
    twice = covertree.near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], SCHEMA)).collect()
    assert [r.n_links for r in twice] == [2, 2, 2] and {r.component for r in twice} == {1}
    assert covertree.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_traversal_leaves_no_pair_out():
    r = np.random.default_rng(5)
    x = r.standard_normal((400, 8))
    x[100:] = x[r.integers(0, 40, 300)] + r.standard_normal((300, 8)) * 0.08
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, near = covertree.Tree(x), x @ x.T >= 0.98
    i, j = covertree.pairs(tree, tree)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(np.triu(near, 1))))) and (i < j).all()
    a, b = covertree.Tree(x[:150]), covertree.Tree(x[150:])
    i, j = covertree.pairs(a, b)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(a.tolist() for a in np.nonzero(near[:150, 150:]))))


def test_separated_points_are_compared_at_once(monkeypatch):
    r = np.random.default_rng(7)
    x = r.standard_normal((600, 64))
    x[::50] = x[1::50] + r.standard_normal((12, 64)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    calls, close = [], covertree._close
    monkeypatch.setattr(covertree, "_close", lambda *args: calls.append(1) or close(*args))
    a, b = covertree.Tree(x[::2]), covertree.Tree(x[1::2])
    i, j = covertree.pairs(a, b)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(k.tolist() for k in np.nonzero(x[::2] @ x[1::2].T >= 0.98)))) and len(i) == 12
    assert len(calls) < 10  # not once for each point


def test_covers_are_those_of_one_centre_after_the_other(monkeypatch):
    monkeypatch.setattr(covertree, "CENTRES", 7)
    r = np.random.default_rng(8)
    x = r.standard_normal((90, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, rows = covertree.Tree(x), np.arange(3, 90)
    want, left = [], rows
    while len(left):
        near = np.linalg.norm(x[left] - x[left[0]], axis=1) <= 0.7
        want.append((int(left[0]), left[near].tolist()))
        left = left[~near]
    assert [(int(c), k.tolist()) for c, k in tree._covers(rows, 0.7)] == want


def test_radii_halve_and_nest():
    r = np.random.default_rng(6)
    x = np.repeat(r.standard_normal((20, 6)), 30, axis=0) + r.standard_normal((600, 6)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def walk(node):
        center, radius, rows, kids = node
        assert np.linalg.norm(x[rows] - x[center], axis=1).max() <= radius + 1e-7 and center in rows
        if kids:
            assert sorted(np.concatenate([k[2] for k in kids]).tolist()) == sorted(rows.tolist())
            return 1 + max(map(walk, kids))
        return 1

    assert walk(covertree.Tree(x).root) > 2


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, covertree.query(spark, sf).collect())) == brute(rows)
