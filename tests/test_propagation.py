"""Feature propagation in blocks against the plain product, with a hub."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossloom.operators import graph as G


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(300)} | {(i, 7) for i in range(60)} | {(7, i) for i in range(60)}
    edges |= {(3, 900), (901, 4)}  # a target and a source without a vector
    edges = [(a, b, rng.random()) for a, b in sorted(edges)]
    vectors = {i: [rng.random() for _ in range(5)] for i in range(60)}
    return (spark.createDataFrame(edges, "src long, dst long, weight double").repartition(3), edges,
            spark.createDataFrame(list(vectors.items()), "node long, embedding array<double>"), vectors)


@pytest.mark.parametrize("limits", [(8192, 1 << 16), (10, 16), (7, 1)])
def test_matches_the_plain_product(graph, limits):
    df, edges, features, vectors = graph
    now, total = {k: np.array(v) for k, v in vectors.items()}, {k: np.array(v) for k, v in vectors.items()}
    for _ in range(3):
        after = {}
        for a, b, w in edges:
            if b in now:
                after[a] = after.get(a, 0) + w * now[b]
        now = after
        for k, v in now.items():
            if k in total:
                total[k] = total[k] + v
    got = {r.node: r.embedding for r in G.propagate(df, features, 3, *limits).collect()}
    assert set(got) == set(vectors)
    for k, v in got.items():
        assert np.allclose(v, total[k] / 4)


def test_a_hub_is_spread_over_chunks(graph):
    df, edges, _, _ = graph
    packed, _ = G.edge_blocks(df, 4, 16)
    rows = packed.select("block", "chunk", F.size("edges").alias("n"), F.exists("edges", lambda e: e["dst"] == 7).alias("hub")).collect()
    assert sum(r.n for r in rows) == len(edges) and max(r.n for r in rows) <= 40
    assert len({(r.block, r.chunk) for r in rows if r.hub}) > 3


def test_vectors_are_summed_across_batches(spark):
    parts = spark.range(3000).select((F.col("id") % 7).alias("node"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = {r.node: r.embedding for r in G.sum_vectors(parts).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {k: [float(sum(range(k, 3000, 7))), float(len(range(k, 3000, 7)))] for k in range(7)}
    assert G.sum_vectors(parts.limit(0)).count() == 0
