import random

import numpy as np
from llm_helpers import roots

from crossloom.llm.components import components, forest


def test_forest_matches_union_find():
    r = random.Random(1)
    for n in (1, 2, 30, 200):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(n)]
        a, b = (np.array(x) for x in zip(*edges))
        want = {**{i: i for i in range(n)}, **roots(edges)}
        assert forest(a, b, n).tolist() == [want[i] for i in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(500, 800)] + [(9, 9), (3, 2), (3, 2)]
    edges += [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)]
    r.shuffle(edges)
    got = components(spark.createDataFrame([*edges, (None, 5), (5, None)], "u long, v long")).collect()
    want = roots([e for e in edges if e[0] != e[1]])
    assert len(got) == len(want) and dict(map(tuple, got)) == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_few_links_take_few_tasks(spark, monkeypatch):
    """A round of few links is one task, whatever the shuffle partitions; many tasks give the same components."""
    from crossloom.llm import components as module

    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100 + i, 100) for i in range(30)]
    table = spark.createDataFrame(edges, "u long, v long").repartition(7)
    parts, kept = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: parts.append((out := kept(df)).rdd.getNumPartitions()) or out)
    few = sorted(map(tuple, components(table).collect()))
    assert len(parts) > 2 and set(parts[1:]) == {1}
    monkeypatch.setattr(module, "PART_LINKS", 1)
    assert sorted(map(tuple, components(table).collect())) == few
    assert dict(few) == {**{i: i // 20 * 20 for i in range(60)}, **{100 + i: 100 for i in range(30)}}
