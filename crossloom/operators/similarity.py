"""Top-k similarity joins, dense and sparse.

Both sides are cut into blocks of bounded size. Spark ships pairs of blocks to
one group, numpy scores them there, and only the best k of each query leave the
group. Pairs are never emitted, and no side has to fit anywhere as a whole.
Bounds keep pairs apart that cannot give one of the best k: dense vectors lie in
cells around pivots, token lists in ranges of size with their largest weights.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossloom import constants as C
from crossloom.functions import vectors as V
from crossloom.operators.ordering import bounded, top_per_key
from crossloom.session import discarded, written

BLOCK_BYTES = 8 << 20  # of vectors in one block; larger blocks are shipped less often
KERNEL_BYTES, KERNEL_ROWS, KERNEL_COLUMNS = 32 << 20, 256, 1024  # vectors in one block of kernel sums; pairs computed at once, which stay in a cache
BLOCK_PAIRS = 64  # pairs of blocks that all meet; beyond them pivots rule pairs out
MAX_PIVOTS, PIVOT_BYTES = 2048, 32 << 20
PACK_BLOCKS = 4  # blocks of near cells that a query is sent to once
QUERY_ROWS, MAX_QUERY_ROWS = 8192, 65536  # queries that meet a pack of cells at once; more of them where there are tasks enough
ROUND_COPIES = 8  # copies of a vector that a round of a search ships on average
MAX_TASKS = 2000
SLICE = 8192  # columns of a slice of scores
LARGE = 1e15  # components whose squares single precision still adds up
CELLS = 1 << 20  # scores computed at once inside a task; a few arrays of them are what a task holds
PAIR_BUDGET = 1_000_000
BLOCK_TERMS = 500_000  # terms of left rows that meet a shard at once
SHARD_ROWS, MIN_SHARD_ROWS = 4096, 256  # right rows of one shard of the token index
BLOCK_ROWS = 16  # right rows whose largest weights bound their scores together
VISIT_TERMS = 8192
FEW_SHARDS = 64
MATRIX_TOKENS = 512  # sets over at most so many tokens can be rows of a matrix
TOKENS_PER_MATCH = 3000  # columns of a matrix that cost as much as a shared token met in an index
SET_ROWS = 1 << 20  # sets of the right side that a block of the left side meets at once
MARGIN = 2e-6  # above the rounding of a score
SCORE_DIGITS = 6
FIXED = 2.0**40  # weight products are summed as multiples of 1 / FIXED, so a sum does not depend on its order


# ---------------------------------------------------------------- helpers inside tasks

def _matrix(column):
    import numpy as np

    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def _best(scores, allowed, k, floor=None):
    """Row numbers, column numbers and rounded scores of the k best allowed entries per row; equal ones keep column order.

    ``floor`` is, per row, a rounded score that the k best reach (NaN: unknown). Only entries that can round to it, or
    to the k-th best of a row without one, are rounded and sorted.
    """
    import numpy as np

    allowed = allowed & ~np.isnan(scores)
    limit = np.full(len(scores), -np.inf) if floor is None else np.where(np.isnan(floor), -np.inf, floor)
    free = np.flatnonzero(np.isneginf(limit))
    if len(free) and scores.shape[1] > k:
        some = slice(None) if len(free) == len(scores) else free
        limit[some] = np.partition(np.where(allowed[some], scores[some], -np.inf), -k, axis=1)[:, -k]
    slack = MARGIN + 1e-14 * np.abs(np.where(np.isfinite(limit), limit, 0.0))
    rows, cols = np.nonzero((scores >= (limit - slack)[:, None]) & allowed)
    values = np.round(scores[rows, cols], SCORE_DIGITS) + 0.0
    order = np.lexsort((cols, -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], cols[keep], values[keep]


def _score_blocks(a, b, metric):
    """Similarity of all rows of two blocks of placed vectors; distances are negated so that large is near."""
    import numpy as np

    if metric in ("cosine", "dot"):
        return a @ b.T
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return -np.sqrt(np.maximum(squared, 0.0))


def _merge(values, columns, rows, found, scores):
    """Enter the entries (row, column, score) into the best of each row, which fall by score and rise by column; in place."""
    import numpy as np

    touched, k = np.unique(rows), values.shape[1]
    rows = np.concatenate([np.repeat(touched, k), rows])
    found, scores = np.concatenate([columns[touched].ravel(), found]), np.concatenate([values[touched].ravel(), scores])
    order = np.lexsort((found, -scores, rows))
    keep = order[np.arange(len(rows)) - np.searchsorted(rows[order], rows[order]) < k]
    values[touched], columns[touched] = scores[keep].reshape(-1, k), found[keep].reshape(-1, k)


def _growing(n: int, first: int):
    """Ranges of columns that start small, so that few of the later entries are above the best seen."""
    at = 0
    while at < n:
        end = min(n, at + min(max(first, at), SLICE))
        yield at, end
        at = end


def _k_best(a, b, metric, k, floor, left=None, right=None):
    """Row numbers, column numbers and rounded scores of the k best entries per row, as ``_best``; for finite vectors of moderate size.

    One product in single precision, raised by its error bound, leaves out what stays below the best seen; only what is
    left is scored in double precision. Entries of equal codes (``left``, ``right``) are not allowed.
    """
    import numpy as np

    flat = metric in ("cosine", "dot")
    na, nb = (a * a).sum(1), (b * b).sum(1)
    # the product is the score, or grows with it: (|a|² - d²) / 2; its last columns add what single precision may lose of a pair
    loss = (a.shape[1] + 10) * 2.0**-23
    p, q = [a, loss * np.sqrt(na)], [b, np.sqrt(nb)]
    if not flat:
        p, q = [*p, np.ones(len(a))], [*q, -nb / 2 * (1 - loss)]
    p, q = np.column_stack(p).astype(np.float32), np.column_stack(q).astype(np.float32)
    most = 2 * loss * (np.sqrt(na * nb.max()) + (0 if flat else nb.max() / 2))
    values, columns = np.full((len(a), k), -np.inf), np.full((len(a), k), -1)
    floor = np.where(np.isnan(floor), -np.inf, floor)
    for at, end in _growing(len(b), max(256, 4 * k)):
        for lo, hi in _slices(len(a), end - at):
            near = p[lo:hi] @ q[at:end].T
            limit = np.maximum(floor[lo:hi], values[lo:hi, -1])
            free = np.flatnonzero(np.isneginf(limit))
            if len(free) and at == 0 and end > k:
                some = near[free]
                if left is not None:
                    some[left[lo:hi][free, None] == right[None, :end]] = -np.inf
                kth = np.partition(some, -k, axis=1)[:, -k].astype(np.float64) - most[lo:hi][free]
                limit[free] = kth if flat else -np.sqrt(np.maximum(na[lo:hi][free] - 2 * kth, 0.0))
            least = limit - (MARGIN + 1e-14 * np.abs(np.where(np.isfinite(limit), limit, 0.0)))
            least = (least if flat else (na[lo:hi] - least * least) / 2) - 1e-12
            hit = np.flatnonzero(near >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
            rows, found = lo + hit // (end - at), at + hit % (end - at)
            if left is not None:
                other = left[rows] != right[found]
                rows, found = rows[other], found[other]
            if len(rows):
                _merge(values, columns, rows, found, np.round(_pair_scores(a, b, rows, found, flat), SCORE_DIGITS) + 0.0)
    rows, place = np.nonzero(values > -np.inf)
    return rows, columns[rows, place], values[rows, place]


def _pair_scores(a, b, rows, columns, flat):
    """Scores of pairs of rows of two blocks, in slices."""
    import numpy as np

    out, step = np.empty(len(rows)), max(1, CELLS // max(1, a.shape[1]))
    for at in range(0, len(rows), step):
        x, y = a[rows[at : at + step]], b[columns[at : at + step]]
        out[at : at + step] = np.einsum("ij,ij->i", x, y) if flat else -np.sqrt(((x - y) ** 2).sum(1))
    return out


# ---------------------------------------------------------------- dense vectors

def _slices(n_left: int, n_right: int):
    """Ranges of left rows whose scores against the right rows stay within the bound."""
    step = max(1, CELLS // max(1, n_right))
    return ((at, min(n_left, at + step)) for at in range(0, n_left, step))


def _blocks(df: DataFrame, block_rows: int | None, wanted: int, block_bytes: int = BLOCK_BYTES) -> int:
    """Enough blocks to bound their bytes (or rows, where given); more while they stay worth a task."""
    rows, width = df.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    block_rows = block_rows or max(256, block_bytes // (8 * max(1, width or 1)))
    return max(1, math.ceil(rows / block_rows), min(wanted, math.ceil(rows / 256)))


def _numbers(n: int) -> Column:
    """One copy per block number."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _known(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull()))


def _fresh(df: DataFrame) -> DataFrame:
    """New column identities, so that both sides of a join may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _pair_blocks(queries: DataFrame, library: DataFrame, block_rows: int | None):
    library = _fresh(library)
    wanted = queries.sparkSession.sparkContext.defaultParallelism
    nq, nl = _blocks(queries, block_rows, wanted), _blocks(library, block_rows, 1)
    q = queries.withColumn("_qb", F.pmod(F.xxhash64("id"), F.lit(nq))).withColumn(
        "_lb", _numbers(nl))
    lib = library.withColumn("_lb", F.pmod(F.xxhash64("id"), F.lit(nl))).withColumn(
        "_qb", _numbers(nq))
    return q, lib


def scale_columns(vectors: DataFrame) -> DataFrame:
    """Every dimension divided by its norm over the whole table. The norms are as small as one vector."""
    norms = (
        vectors.select(F.posexplode("embedding").alias("pos", "v"))
        .groupBy("pos").agg(F.sqrt(F.sum(F.col("v").cast("double") * F.col("v"))).alias("n"))
    )
    scale = [r["n"] for r in norms.orderBy("pos").collect()]
    scaled = F.zip_with(V.doubles(F.col("embedding")), F.array(*[F.lit(s) for s in scale]), lambda x, n: x / n)
    return vectors.withColumn("embedding", scaled)


def dense_topk(
    queries: DataFrame,
    library: DataFrame,
    k: int,
    *,
    metric: str = "cosine",
    exclude_self: bool = False,
    drop_zero: bool = False,
    by: Sequence[str] = (),
    block_rows: int | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Best ``k`` library rows per query: ``(*by, id, neighbor_id, score, rank)``, exact.

    Rows without a vector, or with a NULL in it, find nothing and are not found.

    Both sides have ``id``, ``embedding`` and the ``by`` columns; rows only
    meet within equal ``by`` values. Metrics: cosine, dot, l2, l2_rows,
    l2_columns. Scores are rounded; equal ones go to the smaller id.

    Few blocks all meet (``strategy`` blocks). Beyond ``BLOCK_PAIRS`` pairs the library is dealt to pivots, and
    a query meets only cells whose centre and radius allow a score among its best (pivots).
    """
    if metric == "l2_columns":
        queries, library, metric = scale_columns(queries), scale_columns(library), "l2"
    cols = ["id", "embedding", *by]
    queries, library = _known(queries.select(*cols)), _known(library.select(*cols))
    by = list(by)
    search = _searcher(by, metric, k, exclude_self, drop_zero)
    schema = T.StructType([queries.schema[c] for c in by] + [
        T.StructField("id", queries.schema["id"].dataType),
        T.StructField("neighbor_id", library.schema["id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    order = [F.desc("score"), F.asc("neighbor_id")]
    cells = None
    if strategy == "pivots" or (strategy == "auto" and _block_pairs(queries, library, block_rows) > BLOCK_PAIRS):
        cells = Cells.of(library, by, metric, block_rows)
    if cells is None:
        q, lib = _pair_blocks(queries, library, block_rows)
        keys = [*by, "_qb", "_lb"]
        return top_per_key(q.groupBy(*keys).cogroup(lib.groupBy(*keys)).applyInArrow(search, schema), [*by, "id"], order, k)

    queries = queries.withColumn("_floor", F.lit(None).cast("double"))
    near = written(cells.choose(queries, "nearest", k + exclude_self), "nearest-cells")
    best = lambda met: top_per_key(met, [*by, "id"], order, k)
    found = _in_rounds(near, cells, by, search, schema, "nearest-found")
    kth = best(found).filter(F.col("rank") == k).select(*by, "id", F.col("score").alias("_floor"))
    rest = near.drop("_floor").withColumnRenamed("_cells", "_seen").join(kth, [*by, "id"], "left")
    rest = cells.choose(rest, "reaching").withColumn("_cells", F.array_except("_cells", "_seen")).drop("_seen")
    rest = written(rest.filter(F.size("_cells") > 0), "reaching-cells")
    discarded(near)
    more = _in_rounds(rest, cells, by, search, schema, "reaching-found", lambda met: best(met).drop("rank"))
    out = written(best(found.unionByName(more)), "found")
    discarded(found, rest, more, cells.dealt)
    return out


def _searcher(by, metric, k, exclude_self, drop_zero):
    """Function for a group of queries and library rows: the k best of each query; the key starts with the ``by`` values."""

    def search(key, left, right):
        import numpy as np
        import pyarrow as pa

        names = [*by, "id", "neighbor_id", "score"]
        right = right.sort_by("id")
        if left.num_rows == 0 or right.num_rows == 0:
            empty = [right.schema.field(c).type for c in by]
            types = [*empty, left.schema.field("id").type, right.schema.field("id").type, pa.float64()]
            return pa.table([pa.array([], t) for t in types], names=names)
        a, b = _matrix(left["embedding"]), _matrix(right["embedding"])
        qid, lid = left["id"].combine_chunks(), right["id"].combine_chunks()
        codes = pa.chunked_array([qid, lid]).combine_chunks().dictionary_encode().indices.to_numpy() if exclude_self else None
        own, other = (codes[: len(qid)], codes[len(qid) :]) if exclude_self else (None, None)
        some = (np.abs(b).sum(axis=1) > 0)[None, :]
        a, b = _placed(a, metric), _placed(b, metric)
        floor = left["_floor"].to_numpy().astype(float) if "_floor" in left.schema.names else np.full(len(a), np.nan)
        if np.abs(a).max(initial=0) < LARGE and np.abs(b).max(initial=0) < LARGE:
            right_rows = np.flatnonzero(some[0]) if drop_zero else np.arange(len(b))
            rows, found, scores = _k_best(a, b[right_rows], metric, k, floor, own, other if other is None else other[right_rows]) if len(right_rows) else [np.empty(0, int)] * 3
            found = right_rows[found]
        else:  # infinite, undefined or very large components
            parts = []
            for at, end in _slices(len(a), len(b)):
                scores = _score_blocks(a[at:end], b, metric)
                allowed = np.ones(scores.shape, dtype=bool)
                if exclude_self:
                    allowed &= own[at:end, None] != other[None]
                if drop_zero:
                    allowed &= some
                rows, found, values = _best(scores, allowed, k, floor[at:end])
                parts.append((rows + at, found, values))
            rows, found, scores = (np.concatenate(x) for x in zip(*parts))
        groups = [pa.array([key[i].as_py()] * len(rows), right.schema.field(c).type) for i, c in enumerate(by)]
        return pa.table([*groups, qid.take(pa.array(rows)), lid.take(pa.array(found)), pa.array(scores, pa.float64())], names=names)

    return search


# ---------------------------------------------------------------- pivot cells

def _block_pairs(queries: DataFrame, library: DataFrame, block_rows: int | None) -> int:
    return _blocks(queries, block_rows, 1) * _blocks(library, block_rows, 1)


def _placed(vectors, metric):
    """Vectors in the space where the metric is a dot product or a distance."""
    import numpy as np

    if metric == "cosine":
        return vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + C.NORM_EPSILON)
    if metric == "l2_rows":
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), C.NORM_EPSILON)
    return vectors


def _reach(a, centres, radii, metric):
    """(score of the centres, lowest and highest score in the cells) for placed vectors; widened by the error of the arithmetic."""
    import numpy as np

    if metric in ("cosine", "dot"):
        middle = a @ centres.T
        spread = np.linalg.norm(a, axis=1)[:, None] * radii[None, :]
    else:
        middle = -np.sqrt(np.maximum((a * a).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (a @ centres.T), 0.0))
        spread = radii[None, :]
    slack = MARGIN + 1e-6 * (np.abs(middle) + spread)
    low, high = middle - spread - slack, middle + spread + slack
    return middle, low, high if metric in ("cosine", "dot") else np.minimum(high, slack)


class Cells:
    """A library dealt to pivots: ``rows(*by, _cell, _sub, id, embedding)`` and, per cell, centre, radius and size.

    Pivots are library rows drawn by a hash of the id, at most ``MAX_PIVOTS`` and ``PIVOT_BYTES`` of them, so
    the list of cells is bounded whatever the library. A cell of many rows is cut into sub-blocks by a hash;
    near cells of few rows are a pack, to which a query is sent once with the list of those that it visits.
    """

    def __init__(self, rows, groups, n_cells, dealt=None, packs=(), held=(), subs=()):
        self.rows, self.groups, self.n_cells = rows, groups, n_cells
        self.dealt, self.packs, self.held, self.subs = dealt, packs, held, subs  # the table under ``rows``; pack of each cell; rows and blocks of each pack

    @classmethod
    def of(cls, library: DataFrame, by: Sequence[str], metric: str, block_rows: int | None = None):
        """None if there are more values of ``by`` than there can be pivots."""
        spark, by = library.sparkSession, list(by)
        width = library.agg(F.max(F.size("embedding"))).first()[0]
        most = max(1, min(MAX_PIVOTS, PIVOT_BYTES // (8 * max(1, width or 1))))
        sizes = library.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).limit(most + 1).collect()
        total = sum(r["_n"] for r in sizes)
        if not total or len(sizes) > most:
            return None
        block_rows = block_rows or max(256, BLOCK_BYTES // (8 * width))
        wanted = min(most, max(1, total // max(1, block_rows // 4)))
        share = {tuple(r[c] for c in by): max(1, wanted * r["_n"] // total) for r in sizes}
        drawn = top_per_key(library.withColumn("_h", F.xxhash64("id")), by or [F.lit(0).alias("_all")], [F.asc("_h"), F.asc("id")], max(share.values()))
        quota = spark.createDataFrame([(*g, n) for g, n in share.items()], T.StructType([*[library.schema[c] for c in by], T.StructField("_q", T.IntegerType())]))
        if by:
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
            drawn = drawn.alias("a").join(F.broadcast(quota).alias("b"), same).filter(F.col("a.rank") <= F.col("b._q")).select("a.*")
        import numpy as np

        pivots: dict = {}
        for r in drawn.select(*by, "embedding").collect():  # bounded by `most`
            pivots.setdefault(tuple(r[c] for c in by), []).append(list(r["embedding"]))
        groups, first = {}, 0
        for g, p in pivots.items():
            groups[g] = (first, _placed(np.array(p, float), metric))
            first += len(p)
        own = cls(None, spark.sparkContext.broadcast((by, metric, {g: (at, p, np.zeros(len(p)), np.zeros(len(p))) for g, (at, p) in groups.items()})), first)
        dealt = written(own._map(library, "deal", "_cell int, _distance double"), "dealt")
        radius, size = np.full(first, -1.0), np.zeros(first, np.int64)
        for r in dealt.groupBy("_cell").agg(F.max("_distance").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # a row per pivot
            radius[r["_cell"]], size[r["_cell"]] = r["r"], r["n"]
        table = {g: (at, p, radius[at : at + len(p)], size[at : at + len(p)]) for g, (at, p) in groups.items()}
        packs = _packs(list(groups.values()), size, PACK_BLOCKS * block_rows)
        held = np.bincount(packs, size).astype(np.int64).tolist()
        subs = [max(1, math.ceil(n / (PACK_BLOCKS * block_rows))) for n in held]  # a pack of one crowded cell has more than one
        rows = dealt.drop("_distance").withColumn("_pack", _at(packs.tolist(), F.col("_cell"))).withColumn("_sub", F.pmod(F.xxhash64("id"), _at(subs, F.col("_pack"))))
        return cls(rows, spark.sparkContext.broadcast((by, metric, table)), first, dealt, packs, held, subs)

    def choose(self, queries: DataFrame, how: str, enough: int = 0) -> DataFrame:
        """``queries`` with ``_cells``: the nearest ones that hold ``enough`` rows, or all that can reach the score ``_floor``."""
        return self._map(queries, how, "_cells array<int>", enough)

    def sure(self, queries: DataFrame) -> DataFrame:
        """``queries`` with ``_cells`` that must be counted row by row, and ``_sure``, the rows of cells that surely beat ``_floor``."""
        return self._map(queries, "count", "_cells array<int>, _sure bigint")

    def _map(self, df: DataFrame, how: str, new: str, enough: int = 0) -> DataFrame:
        shared = self.groups

        def placed(b, by, metric, groups):
            """The new columns of a slice of rows: a cell and a distance, or a list of cells and a count."""
            import numpy as np
            import pyarrow as pa

            a = _placed(_matrix(pa.chunked_array([b.column("embedding")])), metric)
            keys = list(zip(*(b.column(c).to_pylist() for c in by))) if by else [()] * b.num_rows
            floor = b.column("_floor").to_numpy(zero_copy_only=False).astype(float) if "_floor" in b.schema.names else None
            cell, number = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.float64 if how == "deal" else np.int64)
            owners, lists = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for g in set(keys) & set(groups):
                rows = np.flatnonzero([key == g for key in keys])
                at, centres, radii, sizes = groups[g]
                if how == "deal":
                    nearest = (-_reach(a[rows], centres, radii, "l2")[0]).argmin(axis=1)
                    cell[rows], number[rows] = at + nearest, np.linalg.norm(a[rows] - centres[nearest], axis=1)
                    continue
                middle, low, high = _reach(a[rows], centres, radii, metric)
                if how == "nearest":
                    order = np.argsort(-np.where(sizes > 0, middle, -np.inf), axis=1, kind="stable")
                    held = np.cumsum(sizes[order], axis=1)
                    take = np.minimum((held < enough).sum(axis=1) + 1, int((sizes > 0).sum()))
                    i, j = np.nonzero(np.arange(len(sizes)) < take[:, None])
                    j = order[i, j]
                else:
                    limit = np.where(np.isnan(floor[rows]), -np.inf, floor[rows])[:, None]
                    if how == "count":
                        wins = low > limit
                        number[rows] = (wins * sizes).sum(axis=1)
                        i, j = np.nonzero(~wins & (high > limit) & (sizes > 0))
                    else:
                        i, j = np.nonzero((high >= limit) & (sizes > 0))
                owners.append(rows[i])
                lists.append((at + j).astype(np.int32))
            if how == "deal":
                return [pa.array(cell), pa.array(number)]
            owner, chosen = np.concatenate(owners), np.concatenate(lists)
            ends = np.cumsum(np.bincount(owner, minlength=b.num_rows))
            cells = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(chosen[np.argsort(owner, kind="stable")]))
            return [cells, pa.array(number)] if how == "count" else [cells]

        names = [f.name for f in T._parse_datatype_string(new).fields]

        def task(batches):
            import pyarrow as pa

            by, metric, groups = shared.value
            step = max(1, CELLS // max(len(g[1]) for g in groups.values()))  # rows whose bounds and lists are held at once
            for whole in batches:
                for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                    yield pa.RecordBatch.from_arrays([*b.columns, *placed(b, by, metric, groups)], [*b.schema.names, *names])

        return df.mapInArrow(task, T.StructType([*df.schema.fields, *T._parse_datatype_string(new).fields]))


def _packs(groups, size, rows: int):
    """Number of a pack for every cell: cells of one group around a first one, ``rows`` rows together at most, or one crowded cell."""
    import numpy as np

    packs, n = np.zeros(len(size), np.int64), 0
    for at, centres in groups:
        left = np.arange(len(centres))
        while len(left):
            away = ((centres[left] - centres[left[0]]) ** 2).sum(axis=1)
            away[0] = -1.0  # the first one comes first, even where components are not finite
            left = left[np.argsort(away, kind="stable")]
            many = max(1, int((np.cumsum(size[at + left]) <= rows).sum()))
            packs[at + left[:many]] = n
            left, n = np.sort(left[many:]), n + 1
    return packs


def _at(values: Sequence[int], place: Column) -> Column:
    """The entry of a bounded list at a place that is counted from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int")).cast("long")


def _sent(queries: DataFrame, cells: Cells) -> DataFrame:
    """``queries`` once for every pack ``_pack`` that holds some of its ``_cells``, with the list of these."""
    packs = cells.packs

    def task(batches):
        import numpy as np
        import pyarrow as pa

        step = max(1, MAX_QUERY_ROWS // (int(packs.max()) + 1))  # rows that are copied at once
        for whole in batches:
            for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                lists = b.column("_cells")
                owner, chosen = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
                order = np.lexsort((packs[chosen], owner))
                owner, chosen = owner[order], chosen[order]
                pack = packs[chosen]
                first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pack[1:] != pack[:-1]))) if len(owner) else np.empty(0, np.int64)
                own = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), pa.array(chosen.astype(np.int32)))
                rows = b.take(pa.array(owner[first]))
                kept = [c for c in b.schema.names if c != "_cells"]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), own, pa.array(pack[first])], [*kept, "_cells", "_pack"])

    kept = [f for f in queries.schema.fields if f.name != "_cells"]
    return queries.mapInArrow(task, T.StructType([*kept, queries.schema["_cells"], T.StructField("_pack", T.LongType())]))


def _cell_by_cell(function):
    """``function`` on every cell of a group's library rows and the queries that visit it."""

    def meet(key, left, right):
        import numpy as np
        import pyarrow as pa

        lists = left["_cells"].combine_chunks()
        owner, chosen = np.repeat(np.arange(left.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        cell = right["_cell"].to_numpy()
        rows, columns = np.argsort(chosen, kind="stable"), np.argsort(cell, kind="stable")
        parts = []
        for c in np.intersect1d(chosen, cell).tolist():
            here = rows[np.searchsorted(chosen, c, sorter=rows) : np.searchsorted(chosen, c, "right", sorter=rows)]
            there = columns[np.searchsorted(cell, c, sorter=columns) : np.searchsorted(cell, c, "right", sorter=columns)]
            parts.append(function(key, left.take(pa.array(owner[here])), right.take(pa.array(there))))
        return pa.concat_tables(parts) if parts else function(key, left.slice(0, 0), right.slice(0, 0))

    return meet


def _visits(queries: DataFrame, cells: Cells) -> list[int]:
    """Queries that visit each pack."""
    n = {r["_pack"]: r["n"] for r in _sent(queries.select("_cells"), cells).groupBy("_pack").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [n.get(p, 0) for p in range(len(cells.subs))]


def _chunks(spark, visits: Sequence[int], subs: Sequence[int], rounds: int = 1) -> list[int]:
    """Chunks of the queries of each pack: small enough for several groups per core, else large, because a group takes a copy of its library rows."""
    groups = 4 * spark.sparkContext.defaultParallelism
    step = min(MAX_QUERY_ROWS, max(QUERY_ROWS, sum(n * s for n, s in zip(visits, subs)) // rounds // groups))
    return [math.ceil(n / rounds / step) for n in visits]


def _meet(queries: DataFrame, cells: Cells, by: Sequence[str], function, schema: T.StructType, chunks: Sequence[int]) -> DataFrame:
    """``function`` on every cell and the queries that chose it. A group is a block of a pack of cells and a chunk of its queries."""
    sent = _sent(queries, cells).withColumn("_chunk", F.pmod(F.xxhash64("id"), _at(chunks, F.col("_pack"))))
    sent = sent.withColumn("_sub", F.explode(F.sequence(F.lit(0).cast("long"), _at(cells.subs, F.col("_pack")) - 1)))
    lib = cells.rows.withColumn("_chunks", _at(chunks, F.col("_pack"))).filter("_chunks > 0")
    lib = lib.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).drop("_chunks")
    keys = [*by, "_pack", "_sub", "_chunk"]
    tasks = min(MAX_TASKS, max(1, sum(n * s for n, s in zip(chunks, cells.subs))))  # groups are alike in bytes but not in work
    left, right = (side.repartition(tasks, *keys).groupBy(*keys) for side in (sent, _fresh(lib)))
    return left.cogroup(right).applyInArrow(_cell_by_cell(function), schema)


def _in_rounds(queries: DataFrame, cells: Cells, by: Sequence[str], function, schema: T.StructType, name: str, last=lambda met: met) -> DataFrame:
    """The rows of ``_meet`` as a written table. Where it ships many copies of the vectors, parts of the queries take turns.

    The shuffle of a round is gone when its rows are written, so the disk grows with the vectors and not with the pairs of blocks.
    """
    spark, visits = queries.sparkSession, _visits(queries, cells)
    shipped = sum(n * s + c * h for n, s, c, h in zip(visits, cells.subs, _chunks(spark, visits, cells.subs), cells.held))
    rounds = max(1, math.ceil(shipped / max(1, ROUND_COPIES * (queries.count() + sum(cells.held)))))
    chunks = _chunks(spark, visits, cells.subs, rounds)
    turn, out = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(rounds)), None
    for i in range(rounds):
        part = queries.filter(turn == i) if rounds > 1 else queries
        part = written(last(_meet(part, cells, by, function, schema, chunks)), name)
        out = part if out is None else out.unionByName(part)
    return out


def dense_target_rank(queries: DataFrame, library: DataFrame, tolerance: float = C.RANK_TOLERANCE,
                      by: Sequence[str] = (), block_rows: int | None = None, strategy: str = "auto") -> DataFrame:
    """``(id, rank)``: 1 + library rows whose dot product beats the query's ``truth`` item by more than the tolerance.

    ``queries(id, embedding, truth, *by)``. Only counts leave a group of blocks. With pivots, cells that lie
    wholly above or below the truth's score are counted by their size.
    """
    truth = library.select(F.col("id").alias("truth"), F.col("embedding").alias("_t"), *by)
    q = queries.join(truth, ["truth", *by]).withColumn("truth_score", V.dot(F.col("embedding"), F.col("_t")))
    q = q.select("id", "embedding", "truth_score", *by)
    library = library.select("id", "embedding", *by)
    schema = T.StructType([T.StructField("id", queries.schema["id"].dataType), T.StructField("better", T.LongType())])

    def count_better(key, left, right):
        import numpy as np
        import pyarrow as pa

        better = pa.array([], pa.int64())
        if left.num_rows and right.num_rows:
            a, b = _matrix(left["embedding"]), _matrix(right["embedding"])
            limit = left["truth_score"].to_numpy()[:, None] + tolerance
            better = pa.array(np.concatenate([(a[at:end] @ b.T > limit[at:end]).sum(axis=1) for at, end in _slices(len(a), len(b))]))
        ids = left["id"].combine_chunks() if len(better) else pa.array([], left.schema.field("id").type)
        return pa.table([ids, better], names=["id", "better"])

    cells = None
    if strategy == "pivots" or (strategy == "auto" and _block_pairs(q, library, block_rows) > BLOCK_PAIRS):
        cells = Cells.of(_known(library), by, "dot", block_rows)
    if cells is None:
        q, lib = _pair_blocks(q, library, block_rows)
        keys = [*by, "_qb", "_lb"]
        parts = q.groupBy(*keys).cogroup(lib.groupBy(*keys)).applyInArrow(count_better, schema)
    else:
        chosen = written(cells.sure(_known(q).withColumn("_floor", F.col("truth_score") + tolerance)), "counted-cells")
        chunks = _chunks(chosen.sparkSession, _visits(chosen, cells), cells.subs)
        parts = _meet(chosen.drop("_floor", "_sure"), cells, list(by), count_better, schema, chunks)
        parts = parts.unionByName(chosen.select("id", F.col("_sure").alias("better")))
    return parts.groupBy("id").agg((F.sum("better") + 1).alias("rank"))


def retrieve_users(
    queries: DataFrame, library: DataFrame, k_train: int = C.K_TRAIN, k_test: int = C.K_TEST,
    metric: str = "cosine", splits: Sequence[str] = ("train", "test"),
) -> DataFrame:
    """Similar users per split: ``(split, user_id, rank, neighbor_id, score)``.

    ``queries(split, user_id, domain, x_vec, y_vec)``, ``library(user_id, x_vec, y_vec)``.
    Only the vector of the user's target domain is compared (missing: X).
    Train users do not find themselves.
    """
    on_y = F.coalesce(F.col("domain"), F.lit("X")) == "Y"
    q = queries.select("split", F.col("user_id").alias("id"), F.when(on_y, "Y").otherwise("X").alias("domain"),
                       F.when(on_y, F.col("y_vec")).otherwise(F.col("x_vec")).alias("embedding"))
    both = F.explode(F.array(F.struct(F.lit("X").alias("domain"), F.col("x_vec").alias("embedding")),
                             F.struct(F.lit("Y").alias("domain"), F.col("y_vec").alias("embedding"))))
    lib = library.select(F.col("user_id").alias("id"), both.alias("_v")).select("id", "_v.*")
    found = None
    for split in splits:
        part = dense_topk(q.filter(F.col("split") == split), lib, k_train if split == "train" else k_test,
                          metric=metric, exclude_self=split == "train", by=("domain",))
        part = part.select(F.lit(split).alias("split"), F.col("id").alias("user_id"), "rank", "neighbor_id", "score")
        found = part if found is None else found.unionByName(part)
    return found


def neighbour_items(users: DataFrame, item_vectors: DataFrame, items: DataFrame, k: int = C.NEIGHBOUR_ITEMS) -> DataFrame:
    """Nearest items in X and in Y per user with title: ``(user_id, domain, rank, item_id, title, score)``."""
    both = F.explode(F.array(F.struct(F.lit("X").alias("domain"), F.col("x_vec").alias("embedding")),
                             F.struct(F.lit("Y").alias("domain"), F.col("y_vec").alias("embedding"))))
    q = users.select(F.col("user_id").alias("id"), both.alias("_v")).select("id", "_v.*")
    near = dense_topk(q, item_vectors.select(F.col("item_id").alias("id"), "embedding", "domain"), k, by=("domain",))
    near = near.select(F.col("id").alias("user_id"), "domain", "rank", F.col("neighbor_id").alias("item_id"), "score")
    titles = items.select("item_id", F.col("title").alias("_title"))
    return near.join(titles, "item_id", "left").withColumn(
        "title", F.coalesce("_title", F.col("item_id").cast("string"))).drop("_title")


def refresh_pairs(pairs: DataFrame, vectors: DataFrame, digits: int = 4) -> DataFrame:
    """Similarity of given pairs from new vectors; a pair with an unknown side keeps its old value."""
    a = vectors.select(F.col("id").alias("user_id"), F.col("embedding").alias("_a"))
    b = vectors.select(F.col("id").alias("similar_id"), F.col("embedding").alias("_b"))
    fresh = F.round(V.cosine(F.col("_a"), F.col("_b")), digits)
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return pairs.join(a, "user_id", "left").join(b, "similar_id", "left").withColumn(
        "similarity", F.when(known, fresh).otherwise(F.col("similarity"))).drop("_a", "_b")


# ---------------------------------------------------------------- distribution distance

def mean_vectors(vectors: DataFrame, by: str) -> DataFrame:
    """Mean vector per group. Values are summed per dimension, so a large group is combined before the shuffle."""
    per_dim = vectors.select(by, F.posexplode("embedding").alias("pos", "v")).groupBy(by, "pos").agg(
        F.avg(F.col("v").cast("double")).alias("v"))
    packed = F.sort_array(F.collect_list(F.struct("pos", "v")))  # as long as one vector
    return per_dim.groupBy(by).agg(F.transform(packed, lambda e: e["v"]).alias("embedding"))


def linear_shift(vectors: DataFrame) -> DataFrame:
    """Squared distance of the mean vectors of X and Y."""
    means = mean_vectors(vectors, "domain").agg(
        F.max_by("embedding", F.col("domain") == "X").alias("x"), F.min_by("embedding", F.col("domain") == "X").alias("y"))
    return means.select(F.round(V.squared_distance(F.col("x"), F.col("y")), SCORE_DIGITS).alias("shift"))


def _exponents(x, y, width):
    """Both sides with two more columns, so that a product of rows is the negative squared distance over the width."""
    import numpy as np

    width = np.float64(width)
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    return np.column_stack([x * (2 / width), -nx / width, np.ones(len(x))]), np.column_stack([y, np.ones(len(y)), -ny / width])


def _kernel_total(x, y, kernels, ratio):
    """Sum over all pairs of rows of the kernels whose exponents are the product and its multiples by powers of ``ratio``.

    At a ratio of 2 a kernel is the square of the next wider one, so that a pair takes one exponential.
    """
    import numpy as np

    total = 0.0
    for at in range(0, len(y), KERNEL_COLUMNS):
        columns = y[at : at + KERNEL_COLUMNS].T
        for lo in range(0, len(x), KERNEL_ROWS):
            exponent = x[lo : lo + KERNEL_ROWS] @ columns
            np.minimum(exponent, 0.0, out=exponent)
            value = np.exp(exponent, out=exponent if ratio == 2.0 else None)
            total += float(value.sum()) if kernels else 0.0
            for i in range(1, kernels):
                if ratio == 2.0:
                    total += float(np.vdot(value, value))
                    if i + 1 < kernels:
                        np.multiply(value, value, out=value)
                else:
                    total += float(np.exp(exponent * ratio**i).sum())
    return total


def kernel_shift(vectors: DataFrame, kernels: int = 5, ratio: float = 2.0, block_rows: int | None = None) -> DataFrame:
    """Kernel distance of X and Y over all pairs of the pooled rows.

    The bandwidth is the mean pair distance. It follows from the sum of squared
    norms and the summed vector, so it needs no pairs. Kernel sums are taken
    block by block and only sums leave a group. A pair of different blocks is
    computed once and counts for both orders. Every pair is visited, so the work
    is quadratic; what moves is a copy of the vectors per block.
    """
    sums = vectors.select(F.posexplode("embedding").alias("pos", "v")).groupBy("pos").agg(
        F.sum(F.col("v").cast("double")).alias("s"), F.sum(F.col("v").cast("double") * F.col("v")).alias("q"))
    total = sums.agg(F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s")).alias("s2")).first()
    sizes = {r["domain"]: r["n"] for r in vectors.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    nx, ny = sizes.get("X", 0), sizes.get("Y", 0)
    n = nx + ny
    width = (2.0 * n * total["q"] - 2.0 * total["s2"]) / (n * n - n) / ratio ** (kernels // 2) * ratio ** (kernels - 1)

    slim = vectors.select("id", "embedding", "domain")
    blocks = _blocks(slim, block_rows, slim.sparkSession.sparkContext.defaultParallelism, KERNEL_BYTES)
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    a = slim.withColumn("_qb", own).withColumn("_lb", F.explode(F.sequence(F.col("_qb"), F.lit(blocks - 1).cast("long"))))
    b = _fresh(slim.withColumn("_lb", own).withColumn("_qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lb")))))

    def kernel_sums(key, left, right):
        import numpy as np
        import pyarrow as pa

        kinds, out = [], []
        if left.num_rows and right.num_rows:
            x, y = _matrix(left["embedding"]), _matrix(right["embedding"])
            lx = np.asarray(left["domain"].to_pylist()) == "X"
            rx = np.asarray(right["domain"].to_pylist()) == "X"
            twice = key[0].as_py() != key[1].as_py()
            x, y = _exponents(x, y, width)
            for kind, rows, cols in (("XX", lx, rx), ("YY", ~lx, ~rx), ("XY", lx, ~rx), ("YX", ~lx, rx)):
                total = _kernel_total(x[rows], y[cols], kernels, ratio)
                kinds += [kind, kind[::-1]] if twice else [kind]
                out += [total, total] if twice else [total]
        return pa.table([pa.array(kinds, pa.string()), pa.array(out, pa.float64())], names=["kind", "value"])

    # few rows and much work in a group: a partition for each, which is not merged with others by its bytes
    dealt = [side.repartition(blocks * (blocks + 1) // 2, "_qb", "_lb").groupBy("_qb", "_lb") for side in (a, b)]
    parts = dealt[0].cogroup(dealt[1]).applyInArrow(kernel_sums, "kind string, value double")
    of = lambda kind, size: F.sum(F.when(F.col("kind") == kind, F.col("value"))) / F.lit(float(size))
    shift = of("XX", nx * nx) + of("YY", ny * ny) - of("XY", nx * ny) - of("YX", nx * ny)
    return parts.agg(F.round(shift, SCORE_DIGITS).alias("shift"))


# ---------------------------------------------------------------- sparse token vectors

def _products(a: Column, b: Column) -> Column:
    """Sum of products in multiples of ``1 / FIXED``."""
    return F.sum(F.floor(a * b * F.lit(FIXED) + 0.5))


def _finish(total: Column, left_size: Column, right_size: Column, kind: str) -> Column:
    """Score from a sum of ``_products``, rounded as the blocks round theirs."""
    total = total / F.lit(FIXED)
    if kind == "dot":
        score = total
    elif kind == "overlap":
        score = total / F.greatest(left_size, F.lit(1))
    elif kind == "jaccard":
        score = total / (left_size + right_size - total)
    else:
        raise ValueError(f"unknown kind {kind}")
    return F.floor(score * F.lit(10.0**SCORE_DIGITS) + 0.5) / F.lit(10.0**SCORE_DIGITS)


def sparse_topk(left: DataFrame, right: DataFrame, k: int, *, kind: str = "dot", exclude_self: bool = False, pairs: int | None = None,
                right_sizes: DataFrame | None = None, pair_budget: int = PAIR_BUDGET, strategy: str = "auto") -> DataFrame:
    """Best ``k`` right rows per left row that share a token: ``(l_id, r_id, score, rank)``, exact.

    ``left(l_id, token, w, l_size)``, ``right(r_id, token, w, r_size)``, one row per id and token; right
    weights are not negative. The score adds ``w * w`` over shared tokens (kinds dot, overlap, jaccard).
    ``pairs`` (rows a join by token would make) and ``right_sizes(r_size)`` (a row per right id) save a pass where known.

    Up to ``pair_budget`` pairs are joined. Beyond it the index of ``block_index`` is traversed. Products are
    summed in fixed point and rounded alike, so both ways give the same rows. ``strategy`` (auto, join,
    blocks) can fix the choice.
    """
    if strategy == "auto":
        if pairs is None:
            n = right.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
            nl = left.groupBy("token").agg(F.count(F.lit(1)).alias("_nl"))
            pairs = nl.join(n, "token").agg(F.sum(F.col("_nl") * F.col("n"))).first()[0] or 0
        strategy = "blocks" if pairs > pair_budget else "join"
    if strategy == "join":
        return _by_pairs(left, right, k, kind, exclude_self)
    known = right.join(bounded(left.select("token").distinct()), "token", "left_semi")
    return block_topk(left, block_index(known, right_sizes), k, kind=kind, exclude_self=exclude_self)


def _by_pairs(left, right, k, kind, exclude_self) -> DataFrame:
    r = right.select("r_id", "token", F.col("w").alias("_w2"), "r_size")
    pairs = left.join(r, "token")
    if exclude_self:
        pairs = pairs.filter(F.col("l_id") != F.col("r_id"))
    pairs = pairs.groupBy("l_id", "r_id").agg(
        _products(F.col("w"), F.col("_w2")).alias("_s"), F.max("l_size").alias("l_size"), F.max("r_size").alias("r_size"))
    scored = pairs.select("l_id", "r_id", _finish(F.col("_s"), F.col("l_size"), F.col("r_size"), kind).alias("score"))
    return top_per_key(scored, ["l_id"], [F.desc("score"), F.asc("r_id")], k)


# ---------------------------------------------------------------- block-max postings

def _size_class(size: Column) -> Column:
    """Classes of about equal sizes, in rising order."""
    return F.floor(F.log2(size.cast("double") + 1) * 8).cast("int")


class Postings(NamedTuple):
    """``rows(shard, token, r_id, w, r_size)``: shards are ranges of sizes with about equal numbers of ids."""

    rows: DataFrame
    shards: int


def block_index(right: DataFrame, sizes: DataFrame | None = None, shard_rows: int = SHARD_ROWS) -> Postings:
    """Postings by shard. Ids of equal size lie together, because weights fall with the size of a text.

    A large class of sizes is dealt over several shards by a hash of the id, small neighbouring classes share a
    shard. ``sizes(r_size)``, a row per id, saves an estimate. More than a few shards are written once.
    """
    size_class = _size_class(F.col("r_size")).alias("_class")
    # one row per class of sizes, of which there are some hundreds at most; estimates only move the work
    if sizes is None:
        counts = right.groupBy(size_class).agg(F.approx_count_distinct("r_id").alias("n")).collect()
    else:
        counts = sizes.groupBy(size_class).agg(F.count(F.lit(1)).alias("n")).collect()
    wanted = max(MIN_SHARD_ROWS, min(shard_rows, sum(n for _, n in counts) // right.sparkSession.sparkContext.defaultParallelism))
    room, total, shards = 0, 0, []
    for c, n in sorted(counts):
        several = math.ceil(n / wanted)
        if n > room:
            first, room, total = total, max(n, wanted), total + several
        shards.append((c, first, several))
        room = room - n if several == 1 else 0
    place = F.create_map(*[F.lit(x) for c, at, n in shards for x in (c, (at << 20) + n)]) if shards else F.create_map(F.lit(0), F.lit(1))
    place = F.try_element_at(place, _size_class(F.col("r_size"))).cast("long")  # first shard and number of shards in one
    shard = F.shiftright(place, 20) + F.pmod(F.xxhash64("r_id"), place.bitwiseAND((1 << 20) - 1))
    rows = right.select(shard.alias("shard"), "token", "r_id", "w", "r_size")
    return Postings(written(rows, "postings") if total > FEW_SHARDS else rows, total)


def _bound(total: Column, l_size: Column, r_min: Column, r_max: Column, kind: str) -> Column:
    """The highest score of a sum of at most ``total`` with a right row of ``r_min`` to ``r_max`` tokens."""
    if kind == "dot":
        return total
    if kind == "overlap":
        return total / F.greatest(l_size, F.lit(1))
    shared = F.least(total, r_max)
    return shared / (l_size + F.greatest(r_min, shared) - shared)


def shard_bounds(left: DataFrame, index: Postings, kind: str) -> DataFrame:
    """``(l_id, shard, bound)``: no right row of the shard scores higher, for all shards that share a token."""
    largest = index.rows.groupBy("token", "shard").agg(F.max("w").alias("_w"), F.min("r_size").alias("_min"), F.max("r_size").alias("_max"))
    met = left.join(largest, "token").groupBy("l_id", "shard").agg(
        F.sum(F.greatest(F.col("w"), F.lit(0.0)) * F.col("_w")).alias("_t"), F.max("l_size").alias("_l"), F.min("_min").alias("_min"), F.max("_max").alias("_max"))
    return met.select("l_id", "shard", _bound(F.col("_t"), F.col("_l"), F.col("_min"), F.col("_max"), kind).alias("bound"))


def block_topk(left: DataFrame, index: Postings, k: int, *, kind: str = "dot", exclude_self: bool = False, few: int = FEW_SHARDS) -> DataFrame:
    """``sparse_topk`` over an index of ``block_index``.

    Inside a shard, blocks of ``BLOCK_ROWS`` ids are visited by falling bound until none can reach the k-th
    score (``_traverse``). A ``few`` shards are visited by all left rows. Of many, every left row first visits
    the one of its highest bound; that fixes a score its k best reach, and only shards whose bounds
    reach it too are visited next.
    """
    left = left.select("l_id", "token", "w", "l_size")
    order = [F.desc("score"), F.asc("r_id")]
    if index.shards <= few:
        chunks = max(1, math.ceil(left.count() / BLOCK_TERMS))
        everywhere = left.select("*", _numbers(max(1, index.shards)).alias("shard"), F.lit(None).cast("double").alias("floor"))
        return top_per_key(_visit(everywhere, index.rows, k, kind, exclude_self, chunks), ["l_id"], order, k)
    left = written(left, "terms")
    chunks = max(1, math.ceil(left.count() / BLOCK_TERMS))
    bounds = written(shard_bounds(left, index, kind), "bounds")
    first = written(top_per_key(bounds, ["l_id"], [F.desc("bound"), F.asc("shard")], 1).select("l_id", "shard", F.lit(None).cast("double").alias("floor")), "first-shards")
    found = written(_visit(left.join(first, "l_id"), index.rows, k, kind, exclude_self, chunks), "first-found")
    floors = top_per_key(found, ["l_id"], order, k).filter(F.col("rank") == k).select("l_id", F.col("score").alias("floor"))
    rest = bounds.join(first, ["l_id", "shard"], "left_anti").join(floors, "l_id", "left")
    rest = written(rest.filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - MARGIN)).select("l_id", "shard", "floor"), "next-shards")
    both = found.unionByName(_visit(left.join(rest, "l_id"), index.rows, k, kind, exclude_self, chunks))
    return top_per_key(both, ["l_id"], order, k)


def _visit(terms: DataFrame, postings: DataFrame, k: int, kind: str, exclude_self: bool, chunks: int) -> DataFrame:
    """The best k of the left rows in the shards they are sent to; a shard meets the left rows in chunks of bounded size."""
    terms = terms.withColumn("_chunk", F.pmod(F.xxhash64("l_id"), F.lit(chunks)))
    wanted = terms.select("shard", "_chunk").distinct()
    postings = _fresh(postings.join(bounded(wanted), "shard") if chunks > 1 else postings.withColumn("_chunk", F.lit(0).cast("long")))
    schema = T.StructType([
        T.StructField("l_id", terms.schema["l_id"].dataType), T.StructField("r_id", postings.schema["r_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])

    def search(key, a, b):
        import numpy as np
        import pyarrow as pa

        l_type, r_type = a.schema.field("l_id").type, b.schema.field("r_id").type
        if a.num_rows == 0 or b.num_rows == 0:
            return pa.table([pa.array([], l_type), pa.array([], r_type), pa.array([], pa.float64())], names=["l_id", "r_id", "score"])

        def codes(*columns):
            """Values of all columns, and numbers of the values for each column."""
            encoded = pa.chunked_array([c for column in columns for c in column.chunks]).combine_chunks().dictionary_encode()
            ends = np.cumsum([len(c) for c in columns])[:-1]
            return encoded.dictionary, np.split(encoded.indices.to_numpy(), ends)

        def number(table, name):
            return table[name].to_numpy().astype(float)

        _, (l_token, r_token) = codes(a["token"], b["token"])
        l_names, (l_row,) = codes(a["l_id"])
        r_names, (ri,) = codes(b["r_id"])
        first = np.unique(l_row, return_index=True)[1]
        size = number(b, "r_size")[np.unique(ri, return_index=True)[1]]
        by_name = np.empty(len(r_names), np.int64)
        by_name[pa.compute.array_sort_indices(r_names).to_numpy()] = np.arange(len(r_names))
        order = np.lexsort((by_name, size))  # neighbours in size share a block
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        own = np.full(len(l_names), -1)
        if exclude_self:
            same = pa.compute.index_in(l_names, r_names)
            own[same.is_valid().to_numpy(zero_copy_only=False)] = place[same.drop_null().to_numpy()]
        floor = number(a, "floor")[first]
        rows, cols, scores, _ = _traverse(
            l_row, l_token, number(a, "w"), number(a, "l_size")[first], np.where(np.isnan(floor), -np.inf, floor), own,
            r_token, place[ri], number(b, "w"), size[order], by_name[order], k, kind)
        return pa.table([l_names.take(pa.array(rows)), r_names.take(pa.array(order[cols])), pa.array(scores)], names=["l_id", "r_id", "score"])

    return terms.groupBy("shard", "_chunk").cogroup(postings.groupBy("shard", "_chunk")).applyInArrow(search, schema)


def _spread(starts, counts):
    """(owner, place): the places ``starts[i] … starts[i] + counts[i] - 1`` of all i, one after the other."""
    import numpy as np

    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]


def _traverse(l_row, l_token, l_weight, l_size, floor, own, r_token, r_row, r_weight, r_size, names, k, kind, block=BLOCK_ROWS):
    """Best k right rows per left row of one shard: (left rows, right rows, scores, blocks scored).

    Rows are numbered from 0, right rows by rising size; ``names`` gives the order of their ids. ``floor``
    is a score that the best k reach already, ``own`` the right row that is the left row itself (or -1).
    """
    import numpy as np

    n_left, n_right = len(l_size), len(r_size)
    n_blocks = -(-n_right // block)
    order = np.argsort(r_token.astype(np.int64) * n_right + r_row, kind="stable")
    r_token, r_row, r_weight = r_token[order].astype(np.int64), r_row[order], r_weight[order]
    cell = r_token * n_blocks + r_row // block  # postings of one token in one block
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    cells, size = cell[start], np.diff(np.append(start, len(cell)))
    largest = np.maximum.reduceat(r_weight, start)
    low = r_size[np.minimum(np.arange(n_blocks) * block, n_right - 1)]
    high = r_size[np.minimum((np.arange(n_blocks) + 1) * block, n_right) - 1]

    order = np.argsort(l_row, kind="stable")
    l_row, l_token, l_weight = l_row[order], l_token[order].astype(np.int64), l_weight[order]
    begin = np.searchsorted(l_row, np.arange(n_left + 1))
    floor, scored, parts, lo = floor.copy(), 0, [], 0
    while lo < n_left:
        # left rows whose bounds and terms stay within the limits
        hi = min(n_left, lo + max(1, CELLS // n_blocks))
        hi = max(lo + 1, min(hi, int(np.searchsorted(begin, begin[lo] + VISIT_TERMS, "right")) - 1))
        rows, terms = np.arange(lo, hi), slice(begin[lo], begin[hi])
        at = np.searchsorted(cells, l_token[terms] * n_blocks)
        owner, entry = _spread(at, np.searchsorted(cells, (l_token[terms] + 1) * n_blocks) - at)
        place = (l_row[terms][owner] - lo) * n_blocks + cells[entry] % n_blocks
        total = np.bincount(place, np.maximum(l_weight[terms][owner], 0.0) * largest[entry], minlength=len(rows) * n_blocks).reshape(len(rows), n_blocks)
        met = np.bincount(place, minlength=len(rows) * n_blocks).reshape(len(rows), n_blocks) > 0
        if kind == "jaccard":
            shared = np.minimum(total, high)
            total = shared / np.maximum(l_size[rows, None] + np.maximum(low, shared) - shared, 1e-300)
        elif kind == "overlap":
            total = total / np.maximum(l_size[rows, None], 1)
        total = np.where(met, total, -np.inf)
        by_bound = np.argsort(-total, axis=1, kind="stable")
        total = np.take_along_axis(total, by_bound, axis=1)
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        cut, width = 0, 1
        while cut < n_blocks:
            window = total[:, cut : cut + width]
            i, j = np.nonzero((window >= floor[rows, None] - MARGIN) & (window > -np.inf))
            if not len(i):
                break
            scored += len(i)
            found = _score_cells(i + lo, by_bound[i, cut + j], begin, l_token, l_weight, cells, start, size, n_blocks, r_row, r_weight, block)
            pair, right, value = found
            left = i[pair] + lo
            if kind == "overlap":
                value = value / np.maximum(l_size[left], 1)
            elif kind == "jaccard":
                value = value / (l_size[left] + r_size[right] - value)
            value = np.floor(value * 10.0**SCORE_DIGITS + 0.5) / 10.0**SCORE_DIGITS
            other = own[left] != right
            best = [np.concatenate([x, y[other]]) for x, y in zip(best, (left, right, value))]
            by = np.lexsort((names[best[1]], -best[2], best[0]))
            best = [x[by] for x in best]
            rank = np.arange(len(by)) - np.searchsorted(best[0], best[0])
            best = [x[rank < k] for x in best]
            kth = best[0][rank[rank < k] == k - 1], best[2][rank[rank < k] == k - 1]
            floor[kth[0]] = np.maximum(floor[kth[0]], kth[1])
            cut, width = cut + width, min(2 * width, 16)
        parts.append(best)
        lo = hi
    rows, cols, scores = (np.concatenate(x) for x in zip(*parts))
    return rows, cols, scores, scored


def _score_cells(left, blocks, begin, l_token, l_weight, cells, start, size, n_blocks, r_row, r_weight, block):
    """(pair, right row, sum of products) of all right rows that share a token, for pairs of a left row and a block."""
    import numpy as np

    pair, term = _spread(begin[left], begin[left + 1] - begin[left])
    wanted = l_token[term] * n_blocks + blocks[pair]
    entry = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
    hit = cells[entry] == wanted
    pair, term, entry = pair[hit], term[hit], entry[hit]
    owner, at = _spread(start[entry], size[entry])
    spot = pair[owner] * block + r_row[at] % block
    product = np.floor(l_weight[term][owner] * r_weight[at] * FIXED + 0.5)
    upper = np.floor(product / 2.0**26)  # both halves stay whole numbers below 2**53
    n = len(left) * block
    sums = np.bincount(spot, upper, minlength=n).astype(np.int64) * 2**26 + np.bincount(spot, product - upper * 2.0**26, minlength=n).astype(np.int64)
    shared = np.flatnonzero(np.bincount(spot, minlength=n))
    return shared // block, blocks[shared // block] * block + shared % block, sums[shared] / FIXED


def set_topk(sets: DataFrame, k: int, others: DataFrame | None = None, pair_budget: int = PAIR_BUDGET,
             strategy: str = "auto") -> DataFrame:
    """Most similar sets by Jaccard, only above 0: ``(id, neighbor_id, score, rank)`` from ``sets(id, token)``, exact.

    Sets over few tokens, where most share some, are multiplied as rows of zeros and ones (``strategy`` matrix); others
    go to ``sparse_topk``.
    """

    def sized(df: DataFrame) -> DataFrame:
        d = df.select("id", "token").distinct()
        return written(d.join(d.groupBy("id").agg(F.count(F.lit(1)).alias("size")), "id"), "sized-sets")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("id").alias(f"{name}_id"), "token", F.lit(1.0).alias("w"), F.col("size").alias(f"{name}_size"))

    own = sized(sets)
    other = own if others is None else sized(others)
    pairs = None
    if strategy in ("auto", "matrix"):
        shared = own.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).join(other.groupBy("token").agg(F.count(F.lit(1)).alias("_m")), "token")
        tokens, pairs = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_n") * F.col("_m")), F.lit(0))).first()
        dense = strategy == "matrix"
        if not dense and tokens <= MATRIX_TOKENS and pairs > pair_budget:
            n, m = own.select("id").distinct().count(), other.select("id").distinct().count()
            dense = pairs * TOKENS_PER_MATCH >= n * m * tokens
        if dense and tokens > MATRIX_TOKENS:
            raise ValueError(f"a matrix has {MATRIX_TOKENS} tokens at most")
        if dense:
            return _set_matrix(own, other, [r["token"] for r in shared.select("token").collect()], k)
        strategy = "auto"
    found = sparse_topk(side(own, "l"), side(other, "r"), k, kind="jaccard",
                        exclude_self=True, pairs=pairs, pair_budget=pair_budget, strategy=strategy)
    return found.select(F.col("l_id").alias("id"), F.col("r_id").alias("neighbor_id"), "score", "rank")


def _set_matrix(own: DataFrame, other: DataFrame, tokens: list, k: int) -> DataFrame:
    """``set_topk`` of ``(id, token, size)`` rows over the few ``tokens`` that both sides have.

    A set is a bit per token. Blocks of sets meet in one task, which multiplies them in slices, by rising id, and looks
    only at pairs that share as many tokens as their sizes need for a higher score than the k-th best of the slices before.
    """
    spark, words = own.sparkSession, -(-len(tokens) // 64)
    signed = lambda bit: (1 << bit) - (1 << 64) if bit == 63 else 1 << bit
    place = T.StructType([T.StructField("token", own.schema["token"].dataType), T.StructField("_word", T.IntegerType()), T.StructField("_bit", T.LongType())])
    places = F.broadcast(spark.createDataFrame([(t, i // 64, signed(i % 64)) for i, t in enumerate(tokens)], place))

    def bits(df: DataFrame) -> DataFrame:
        of = [F.coalesce(F.bit_or(F.when(F.col("_word") == w, F.col("_bit"))), F.lit(0).cast("long")).alias(f"_w{w}") for w in range(words)]
        return df.join(places, "token").groupBy("id").agg(F.max("size").alias("size"), *of)

    left = written(bits(own), "set-bits")
    right = left if other is own else written(bits(other), "set-bits")
    wanted, n, m = spark.sparkContext.defaultParallelism, left.count(), right.count()
    nq, nl = max(1, math.ceil(n / QUERY_ROWS), min(wanted, math.ceil(n / 256))), max(1, math.ceil(m / SET_ROWS))
    q = left.withColumn("_qb", F.pmod(F.xxhash64("id"), F.lit(nq))).withColumn("_lb", _numbers(nl))
    lib = _fresh(right.withColumn("_lb", F.pmod(F.xxhash64("id"), F.lit(nl))).withColumn("_qb", _numbers(nq)))
    width = len(tokens)

    def search(key, a, b):
        import numpy as np
        import pyarrow as pa

        def ones(part):
            flags = np.ascontiguousarray(part).astype("<i8").view(np.uint8).reshape(len(part), -1)
            return np.unpackbits(flags, axis=1, bitorder="little")[:, :width].astype(np.float32)

        def numbers(table):
            return np.column_stack([table[f"_w{w}"].to_numpy() for w in range(words)]), table["size"].to_numpy()

        l_ids = a["id"].combine_chunks()
        b = b.sort_by("id")
        r_ids = b["id"].combine_chunks()
        values, columns = np.full((len(l_ids), k), -np.inf), np.full((len(l_ids), k), -1)
        if len(l_ids) and len(r_ids):
            same = pa.compute.index_in(l_ids, value_set=r_ids).fill_null(-1).to_numpy()
            (l_bits, l_size), (r_bits, r_size) = numbers(a), numbers(b)
            x = ones(l_bits)
            for at, end in _growing(len(r_ids), max(64, 4 * k)):
                by = at + np.argsort(r_size[at:end], kind="stable")
                y = ones(r_bits[by])
                sizes, begin = np.unique(r_size[by], return_index=True)
                ends = np.append(begin[1:], end - at)
                for lo, hi in _slices(len(x), end - at):
                    higher = values[lo:hi, -1, None] + 0.5 / 10.0**SCORE_DIGITS - 1e-12  # ids rise, so an equal score does not come in
                    least = np.ceil(np.maximum(higher, 0.0) * (l_size[lo:hi, None] + sizes) / (1 + np.maximum(higher, 0.0)) - 1e-9)
                    least = np.maximum(least, 1).astype(np.float32)
                    shared = x[lo:hi] @ y.T
                    above = np.empty(shared.shape, bool)
                    for g, (first, last) in enumerate(zip(begin, ends)):
                        np.greater_equal(shared[:, first:last], least[:, g, None], out=above[:, first:last])
                    hit = np.flatnonzero(above)
                    rows, found = lo + hit // (end - at), by[hit % (end - at)]
                    count = shared.ravel()[hit].astype(np.float64)
                    other_id = same[rows] != found
                    rows, found, count = rows[other_id], found[other_id], count[other_id]
                    if len(rows):
                        score = count / (l_size[rows] + r_size[found] - count)
                        _merge(values, columns, rows, found, np.floor(score * 10.0**SCORE_DIGITS + 0.5) / 10.0**SCORE_DIGITS)
        rows, spot = np.nonzero(values > -np.inf)
        return pa.table([l_ids.take(pa.array(rows)), r_ids.take(pa.array(columns[rows, spot])), pa.array(values[rows, spot])], names=["id", "neighbor_id", "score"])

    schema = T.StructType([T.StructField("id", left.schema["id"].dataType), T.StructField("neighbor_id", right.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    found = q.groupBy("_qb", "_lb").cogroup(lib.groupBy("_qb", "_lb")).applyInArrow(search, schema)
    return top_per_key(found, ["id"], [F.desc("score"), F.asc("neighbor_id")], k)
