"""Order-dependent building blocks that stay safe when one key holds a large share of all rows.

* ``top_per_key`` relies on the group limit Spark puts before the shuffle, so
  a hot key sends at most ``k`` rows per map task.
* ``ordered_columns`` gives previous/next value and position. Keys with more
  than ``hot_rows`` rows are cut into ranges of the order key, computed range
  by range and stitched at the borders, so no task ever holds a whole hot key.
* ``dense_index`` numbers rows in sort order without a one-partition window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossloom.session import materialize

HOT_ROWS = 2_000_000
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
SALTS = 1024
DETECT = object()  # look for hot keys; a caller that has looked already passes its finding (None: there are none)
BROADCAST_KEYS = 100_000
COPIES = 32  # sub-keys of a hot key where its partners are too many to be sent around


def exploded(df: DataFrame, values: Column, out: str, *keep: str) -> DataFrame:
    """One row per array entry; entries must not be NULL.

    The outer form with a filter behind it: for the plain form the optimizer
    adds a size check below, which computes an expensive array twice more.
    """
    return df.select(*keep, F.explode_outer(values).alias(out)).filter(F.col(out).isNotNull())


def fits_broadcast(df: DataFrame, max_bytes: int = 64 << 20) -> bool:
    """Is the measured text size of ``df`` small enough to send it to every executor?"""
    width = sum((F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) + 16 for f in df.schema.fields), F.lit(0))
    return (df.agg(F.sum(width)).first()[0] or 0) <= max_bytes


def bounded(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is measured to be small, else unchanged."""
    return F.broadcast(df) if fits_broadcast(df) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to all cores by ``keys`` if its source has fewer splits than there are cores; what moves is at most that many splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key in the given order, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if k > int(df.sparkSession.conf.get(GROUP_LIMIT, "1000")):
        # beyond the planner's limit nothing is cut before the shuffle, so cut within salted sub-groups first
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        rows = F.xxhash64(*[F.col(c) for c in df.columns if c not in keys])
        df = (
            df.withColumn("_salt", F.pmod(rows, F.lit(SALTS)))
            .withColumn("_r", F.row_number().over(salted))
            .filter(F.col("_r") <= k)
            .drop("_salt", "_r")
        )
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last one by the order columns."""
    return top_per_key(df, keys, [F.desc(c) for c in order], 1, "_r").drop("_r")


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame, int] | None:
    """Keys with more than ``hot_rows`` rows, or None. At most ``rows / hot_rows`` keys can qualify."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).drop("_n")
    n = counts.count()
    return (materialize(counts), n) if n else None


def keyed_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS,
               hot=DETECT) -> DataFrame:
    """Join with a side that has at most one row per key, safe for hot keys even when the same keys are grouped next.

    (The adaptive skew join stays away in that case, because splitting would
    break the partitioning the grouping relies on.) Rows of hot keys do not
    move: the few matching rows of the small side are sent to them.
    """
    if hot is DETECT:
        hot = hot_keys(big, keys, hot_rows)
    if hot is None:
        return big.join(small, list(keys), how)
    if not (hot[1] <= BROADCAST_KEYS and fits_broadcast(hot[0])):
        return _salted(big, small, keys, how, hot[0])
    side = F.broadcast(hot[0])
    few = small.join(side, list(keys), "left_semi")
    if not fits_broadcast(few):
        return _salted(big, small, keys, how, hot[0])
    few = F.broadcast(few)
    cold = big.join(side, list(keys), "left_anti").join(small, list(keys), how)
    return cold.unionByName(big.join(side, list(keys), "left_semi").join(few, list(keys), how))


def _salted(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str, hot: DataFrame) -> DataFrame:
    """The same for any number of hot keys: their rows are spread over sub-keys, their partners copied to each of these."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(COPIES)).cast("int")
    marked = hot.withColumn("_hot", F.lit(True))
    wide = big.join(marked, list(keys), "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    few = small.join(marked, list(keys), "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return wide.join(few, [*keys, "_salt"], how).drop("_salt")


def ordered_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    position: str | None = None,
    hot_rows: int = HOT_ROWS,
    hot=DETECT,
) -> DataFrame:
    """Add previous/next values (``{new column: source column}``) and the 1-based position within each key.

    ``order`` must be a total order within a key.
    """
    previous, following = dict(previous or {}), dict(following or {})

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        for out, src in previous.items():
            part = part.withColumn(out, F.lag(src).over(w))
        for out, src in following.items():
            part = part.withColumn(out, F.lead(src).over(w))
        return part.withColumn(position, F.row_number().over(w).cast("long")) if position else part

    if hot is DETECT:
        hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return plain(df)
    hot_df, n_hot = hot
    side = F.broadcast(hot_df) if n_hot <= BROADCAST_KEYS else hot_df
    cold = plain(df.join(side, list(keys), "left_anti"))
    warm = _by_ranges(df.join(side, list(keys), "left_semi"), keys, order, previous, following, position)
    return cold.unionByName(warm)


def _by_ranges(df, keys, order, previous, following, position) -> DataFrame:
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_chunk", F.spark_partition_id())
    fixed = materialize(ranged)  # the chunk of a row must not change if a task is run again

    values = sorted(set(previous.values()) | set(following.values()))
    at = F.struct(*order)
    packed = F.struct(*[F.col(v) for v in values], F.lit(0).alias("_pad"))
    edges = fixed.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(packed, at).alias("_first"), F.max_by(packed, at).alias("_last")
    )
    we = Window.partitionBy(*keys).orderBy("_chunk")
    edges = edges.select(
        *keys, "_chunk", "_n",
        F.lag("_last").over(we).alias("_before"),
        F.lead("_first").over(we).alias("_after"),
        F.coalesce(F.sum("_n").over(we.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_skip"),
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    out = fixed.withColumn("_rn", F.row_number().over(w))
    for name, src in previous.items():
        out = out.withColumn(name, F.lag(src).over(w))
    for name, src in following.items():
        out = out.withColumn(name, F.lead(src).over(w))
    out = out.join(edges, [*keys, "_chunk"])
    for name, src in previous.items():
        out = out.withColumn(name, F.when(F.col("_rn") == 1, F.col("_before")[src]).otherwise(F.col(name)))
    for name, src in following.items():
        out = out.withColumn(name, F.when(F.col("_rn") == F.col("_n"), F.col("_after")[src]).otherwise(F.col(name)))
    if position:
        out = out.withColumn(position, (F.col("_rn") + F.col("_skip")).cast("long"))
    return out.drop("_chunk", "_rn", "_n", "_before", "_after", "_skip")


def dense_index(df: DataFrame, order: Sequence[str], out: str = "idx") -> DataFrame:
    """0-based place of each row in the sort order. Ranges are numbered in parallel, then shifted."""
    fixed = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # one count per range, so there are no more rows here than partitions
    sizes = sorted(fixed.groupBy("_range").count().collect())
    skips = [0, *accumulate(n for _, n in sizes)]
    offsets = df.sparkSession.createDataFrame([(r, skip) for (r, _), skip in zip(sizes, skips)], "_range int, _skip long")
    w = Window.partitionBy("_range").orderBy(*order)
    return (
        fixed.withColumn("_rn", F.row_number().over(w))
        .join(F.broadcast(offsets), "_range")
        .withColumn(out, (F.col("_rn") - 1 + F.col("_skip")).cast("long"))
        .drop("_range", "_rn", "_skip")
    )


def draw(key: Column, slot: Column, seed: int, below: Column | int) -> Column:
    """Reproducible pseudo-random integer in ``[0, below)`` from two integers: two rounds of a Lehmer generator.

    Independent of partitioning, so a lost task draws the same numbers again.
    """
    m = F.lit(2147483647).cast("long")
    x = F.pmod(key.cast("long") * 16807 + slot.cast("long") * 69621 + F.lit(seed).cast("long"), m)
    x = F.pmod((x + 1) * 48271, m)
    x = F.pmod((x + 1) * 39373, m)
    return F.pmod(x, below if isinstance(below, Column) else F.lit(below).cast("long"))
