"""Connected components of links that never leave the cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.session import materialize

PART_LINKS = 100_000  # links that one task of a round takes at least; every task of a shuffle leaves files, however few its links


def forest(a, b, n):
    """Smallest row number reachable from each of ``n`` rows over the pairs (a, b), for use inside a task."""
    import numpy as np

    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]  # heads of their trees, which point to themselves
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:  # until every row points to a head again
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable.

    Alternating large and small stars: each round links neighbours to the
    smallest node they know of, until nothing changes; the number of rounds
    grows with the logarithm of the longest path. Minima combine before the
    shuffle, and the joins behind them are plain equi-joins, which the
    adaptive planner splits where a node has very many links. Every round is
    written to the checkpoint folder. Loops and NULL ends count for nothing.
    """
    u, v = F.col("u"), F.col("v")
    ends = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"), (u.isNotNull() & v.isNotNull()).alias("_ok"))
    now = materialize(ends.filter(F.col("_ok") & (u != v)).select("u", "v").distinct())
    seen = _mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        parts = math.ceil(seen[0] / PART_LINKS)
        now = _packed(now, parts)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = _packed(_packed(both.join(low, "u").filter(v > u).select(v.alias("u"), F.col("_m").alias("v")), parts).distinct(), parts)
        low = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(u, F.col("_m").alias("v")), F.struct(v.alias("u"), F.col("_m").alias("v")))).alias("e"))
        now = materialize(_packed(_packed(small.select("e.u", "e.v").filter(u != v), parts).distinct(), parts))
        was, seen = seen, _mark(now)
        if was == seen:
            break
    else:
        raise RuntimeError("the components did not settle")
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(u.alias("node"), v.alias("root")).unionByName(tops.select("node", F.col("node").alias("root")))


def _packed(df: DataFrame, parts: int) -> DataFrame:
    """``df`` in at most ``parts`` partitions, if these are fewer than a shuffle makes."""
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum; equal marks mean equal sets of links."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first())
