"""Exact near-duplicate vectors by dual traversal of cover trees.

Unit vectors of a label are dealt into cells of a grid over a few fixed
directions, whose width is the link distance; a vector is also shown to the
neighbouring cells that could hold a partner. Inside a task each block of
vectors becomes a cover tree of nested levels with halving radii, and pairs of
nodes are left out as soon as their centres are farther apart than their
covering radii allow.
"""

from __future__ import annotations

from itertools import product
from math import ceil, log, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.llm.components import components, forest
from crossloom.llm.common import written

THRESHOLD = 0.98
BLOCK = 2048  # vectors of a cell in one block
CELL_ROWS = 2048  # wanted per cell
MAX_AXES = 5
LEAF = 24  # vectors below which a node is not split
CENTRES = 256  # rows looked through for centres at once
PAIRS = 1 << 20  # distances of centres held at once
SLACK = 1e-9  # for rounding in the bounds; links are decided without it


class Tree:
    """Nested nodes over the rows of a matrix: (center, radius, rows, children). Level i covers with radius 2 / 2**i."""

    def __init__(self, x):
        import numpy as np

        self.x = x
        self.root = self._node(0, np.arange(len(x)), 2.0) if len(x) else None

    def _node(self, center, rows, reach):
        import numpy as np

        far = np.sqrt(np.maximum(0, 2 - 2 * (self.x[rows] @ self.x[center])))
        radius = float(far.max())
        if len(rows) <= LEAF or radius < SLACK:
            return center, radius, rows, ()
        while reach / 2 > radius:
            reach /= 2
        kids = self._covers(rows, reach / 2)
        if len(kids) > LEAF and max(len(r) for _, r in kids) == 1:
            return center, radius, rows, ()  # points apart from each other: nothing to nest
        return center, radius, rows, tuple(self._node(c, r, reach / 2) if len(r) > 1 else (c, 0.0, r, ()) for c, r in kids)

    def _covers(self, rows, radius):
        """[(center, rows)]: in the order of ``rows`` a row that no earlier centre covers is a centre; a row goes to the first that covers it."""
        import numpy as np

        kids, left = [], rows
        while len(left):
            head = self.x[left[:CENTRES]]
            near = np.sqrt(np.maximum(0, 2 - 2 * (head @ head.T))) <= radius
            covered, centres = np.zeros(len(head), bool), []
            for i in range(len(head)):
                if not covered[i]:
                    centres.append(i)
                    covered |= near[i]
            near = np.sqrt(np.maximum(0, 2 - 2 * (head[centres] @ self.x[left].T))) <= radius
            near[np.arange(len(centres)), centres] = True
            owner = np.where(near.any(axis=0), near.argmax(axis=0), len(centres))
            owner[centres] = np.arange(len(centres))
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(len(centres) + 1))
            kids += [(left[c], left[order[ends[k] : ends[k + 1]]]) for k, c in enumerate(centres)]
            left = left[order[ends[-1] :]]
        return kids


def pairs(a: Tree, b: Tree, threshold: float = THRESHOLD):
    """Row numbers (i, j) with cosine >= threshold: of ``a`` and ``b``, or i < j within ``a`` if they are the same."""
    import numpy as np

    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if a.root is None or b.root is None:
        return left[0], right[0]
    same, reach = a is b, sqrt(2 - 2 * threshold)
    stack = [(a.root, b.root)]
    while stack:
        p, q = stack.pop()
        if p[3] or q[3]:
            # both sides are split at once; within one tree a node against itself into pairs of its children once
            own, others = p[3] or (p,), q[3] or (q,)
            for i, j, linked in _close(a, own, b, others, reach, threshold, same and p is q):
                stack += [(own[m], others[n]) for m, n in zip(i[~linked].tolist(), j[~linked].tolist())]
                i, j = (np.array([n[0] for n in nodes], np.int64)[k[linked]] for nodes, k in ((own, i), (others, j)))
                left.append(np.minimum(i, j) if same else i)
                right.append(np.maximum(i, j) if same else j)
            continue
        step = max(1, (1 << 22) // len(q[2]))
        for at in range(0, len(p[2]), step):
            rows = p[2][at : at + step]
            i, j = np.nonzero(a.x[rows] @ b.x[q[2]].T >= threshold)
            i, j = rows[i], q[2][j]
            if same and p is q:
                i, j = i[i < j], j[i < j]
            elif same:
                i, j = np.minimum(i, j), np.maximum(i, j)
            left.append(i)
            right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _close(a, nodes, b, others, reach, threshold, once):
    """(i, j, linked) in slices: numbers of the nodes whose covering balls come within ``reach`` of each other.

    Two single vectors are decided here: they are ``linked`` or left out. ``once``: the nodes are the same on both sides, i <= j.
    """
    import numpy as np

    left, right = a.x[[n[0] for n in nodes]], b.x[[n[0] for n in others]]
    radius, wide = np.array([n[1] for n in nodes]), np.array([n[1] for n in others])
    single, alone = np.array([len(n[2]) == 1 for n in nodes]), np.array([len(n[2]) == 1 for n in others])
    step = max(1, PAIRS // len(others))
    for at in range(0, len(nodes), step):
        part = slice(at, at + step)
        dots = left[part] @ right.T
        i, j = np.nonzero(np.sqrt(np.maximum(0, 2 - 2 * dots)) <= radius[part, None] + wide[None] + reach + SLACK)
        if once:
            keep = i + at <= j
            i, j = i[keep], j[keep]
        two = single[i + at] & alone[j]
        keep = ~two | ((dots[i, j] >= threshold) & ((i + at < j) | (not once)))
        yield i[keep] + at, j[keep], two[keep]


def directions(dim: int, count: int):
    """Orthonormal directions, the same in every run."""
    import numpy as np

    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, min(dim, count))))[0].T


def _cells(vectors: DataFrame, threshold: float) -> DataFrame:
    """(label, dim, cell, id, times, visits, unit): every vector in its own cell and, as a visitor, in later ones near it."""
    reach = sqrt(2 - 2 * threshold)

    def task(batches):
        import numpy as np
        import pyarrow as pa

        known: dict = {}
        names = ["label", "dim", "cell", "id", "times", "visits", "unit"]
        for b in batches:
            dims, counts = (b.column(c).to_numpy() for c in ("dim", "axes"))
            for dim, axes in sorted(set(zip(dims.tolist(), counts.tolist()))):
                if (dim, axes) not in known:
                    known[dim, axes] = directions(dim, axes)
                part = b.take(pa.array(np.flatnonzero((dims == dim) & (counts == axes))))
                at = part.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1) @ known[dim, axes].T
                own = np.floor(at / reach).astype(np.int32)
                for move in product((-1, 0, 1), repeat=axes):
                    m = np.array(move, np.int32)
                    if move < (0,) * axes:
                        continue
                    gap = np.where(m > 0, (own + 1) * reach - at, np.where(m < 0, at - own * reach, 0))
                    rows = np.flatnonzero((gap * gap).sum(axis=1) <= (reach + SLACK) ** 2)  # all of them in the own cell
                    cell = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * axes), pa.array((own[rows] + m).ravel()))
                    there = part.take(pa.array(rows))
                    visits = pa.array(np.full(len(rows), any(move)))
                    yield pa.RecordBatch.from_arrays([*(there.column(c) for c in ("label", "dim")), cell, *(there.column(c) for c in ("id", "times")), visits, there.column("unit")], names)

    rows = vectors.select("label", "dim", "axes", "id", "times", "unit")
    return rows.mapInArrow(task, "label bigint, dim int, cell array<int>, id bigint, times bigint, visits boolean, unit array<double>")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 block: int = BLOCK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, n_links, component, kept) per row of ``vectors``.

    Only vectors of the same label and length are compared. A NULL label or
    vector, a NULL or non-finite component, or length zero links with nothing.
    Equal vectors are one point, so copies make no pairs; repeated rows count
    as vectors of their own. Ids are integers; NULL ids come last. ``threshold`` is above 0.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    x = F.col(vector_col)
    real = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(x, lambda v: v.cast("double")).alias("v"))
    real = real.withColumn("id", F.coalesce("id", F.lit((1 << 63) - 1)))
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    scale = F.array_max(F.transform("v", lambda v: F.abs(v)))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & (scale > 0), F.lit(False))
    real = written(real.withColumn("usable", usable), "vectors")

    points = real.filter("usable").groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"))
    # scaled by the largest component first, so that no square over- or underflows
    # (a divisor is paired with the components: inside a lambda it would be computed again for each of them)
    shares = lambda x, d: F.zip_with(x, F.array_repeat(d, F.size(x)), lambda v, w: v / w)
    points = points.withColumn("s", shares(F.col("v"), F.array_max(F.transform("v", lambda w: F.abs(w)))))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda total, v: total + v * v))
    points = points.withColumn("norm", norm).select("label", "v", "id", "times", F.size("v").alias("dim"), shares(F.col("s"), F.col("norm")).alias("unit"))
    points = written(points, "points")
    counts = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    axes = F.least(F.lit(MAX_AXES), F.ceil(F.log(F.greatest(F.lit(1.0), F.col("n") / cell_rows)) / log(4))).cast("int")
    dealt = points.join(counts.select("label", "dim", F.least(axes, F.col("dim")).alias("axes")), ["label", "dim"])
    cells = written(_cells(dealt, threshold), "cells")

    key = ["label", "dim", "cell"]
    sizes = cells.groupBy(*key).agg(
        F.ceil(F.sum((~F.col("visits")).cast("int")) / block).cast("int").alias("h"), F.ceil(F.sum(F.col("visits").cast("int")) / block).cast("int").alias("w")
    )
    joined = cells.join(sizes.filter("h > 0"), key)
    mine = F.when(F.col("visits"), F.pmod(F.xxhash64("id"), F.col("w"))).otherwise(F.pmod(F.xxhash64("id"), F.col("h"))).cast("int")
    joined = joined.withColumn("mine", mine)
    others = F.sequence(F.lit(0), F.col("h") - 1)
    # blocks of the cell's own vectors meet each other once, and blocks of visitors meet all of these
    inner = F.transform(others, lambda t: F.struct(F.least(t, F.col("mine")).alias("a"), F.greatest(t, F.col("mine")).alias("b")))
    outer = F.when(F.col("w") > 0, F.transform(F.sequence(F.lit(1), F.greatest("w", F.lit(1))), lambda t: F.struct(F.col("mine").alias("a"), (-t).alias("b")))).otherwise(
        F.array().cast("array<struct<a:int,b:int>>")
    )
    visit = F.transform(others, lambda t: F.struct(t.alias("a"), (-F.col("mine") - 1).alias("b")))
    meets = joined.select(*key, "id", "times", "visits", "mine", "unit", F.explode(F.when(F.col("visits"), visit).otherwise(F.concat(inner, outer))).alias("m"))
    meets = meets.select(*key, "m.a", "m.b", "id", "times", ((F.col("m.a") != F.col("mine")) | F.col("visits")).alias("second"), "unit")

    def task(table):
        import numpy as np
        import pyarrow as pa

        unit = table.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        ids, times = table.column("id").to_numpy(), table.column("times").to_numpy()
        second = table.column("second").to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, second))  # the same tree in every run
        ids, times, unit, second = ids[order], times[order], unit[order], second[order]
        cut = int((~second).sum())
        first = Tree(unit[:cut])
        inside = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        i, j = pairs(first, first if inside else Tree(unit[cut:]), threshold)
        if not inside:
            j = j + cut
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, i, times[j])
        np.add.at(n, j, times[i])
        root = forest(i, j, len(ids))
        hit = np.flatnonzero(n)
        return pa.table({"id": ids[hit], "n": n[hit], "root": ids[root[hit]]})

    found = written(meets.groupBy(*key, "a", "b").applyInArrow(task, "id bigint, n bigint, root bigint"), "links")
    groups = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("id").agg(F.sum("n").alias("n")).join(groups, F.col("id") == F.col("node"), "left")
    named = points.select("label", "v", "id", "times").join(linked.select("id", "n", "root"), "id", "left").select(
        F.lit(True).alias("usable"), "label", "v", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component")
    )
    out = real.join(named, ["usable", "label", "v"], "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component"))
    return out.withColumn("kept", F.col("id") == F.col("component"))


def query(spark, sf_dir):
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS n, vec_id AS m FROM v UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.n),
c AS (SELECT n AS vec_id, min(m) AS component_id FROM r GROUP BY n),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""
