"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources share a number of words by weight. A source whose share exceeds
``max_epochs`` times its size is clamped there, and what it leaves is shared
again by weight among the others until no share is too large. A source's share
is then met by whole repetitions of all its documents and one repetition of a
seeded random part of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossloom.llm.common import WORD
from crossloom.operators.ordering import bounded, dense_index
from crossloom.session import materialize

MAX_EPOCHS = 3
SEED = 17
BUCKET_ROWS = 256  # documents of a source per bucket of the draw
MAX_BUCKETS = 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: str, seed: int) -> Column:
    """60 random bits of an id, the same in every run."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def source_key(source_col: str) -> Column:
    """The source as a join key that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(_k, weight): sources by code point, NULL last, weigh the numbers of the cycle in turn. ``sources``: (_k)."""
    placed = dense_index(sources.withColumn("_last", F.col("_k") == ""), ["_last", "_k"], "_place")
    numbers = F.array(*[F.lit(x) for x in cycle])
    return placed.select("_k", F.element_at(numbers, (F.col("_place") % len(cycle) + 1).cast("int")).cast("double").alias("weight"))


def targets(sizes: DataFrame, total: float | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to (_k, size, weight). ``total`` words are shared (default: all there are).

    Weights are not negative; what even all caps together cannot take is left
    over. The level only rises, so the rounds end; each is one small aggregate.
    """
    cap, none = F.col("size") * F.lit(float(max_epochs)), F.lit(0.0)
    held = materialize(sizes)
    first = held.agg(F.sum("size"), F.sum("weight")).first()
    total = float(first[0] or 0) if total is None else float(total)
    level, clamped = total / first[1] if first[1] else 0.0, -1
    while True:
        over = cap < F.col("weight") * F.lit(level)
        taken, free, n = held.agg(
            F.sum(F.when(over, cap).otherwise(none)), F.sum(F.when(over, none).otherwise(F.col("weight"))), F.sum(over.cast("long"))
        ).first()
        if not free or n == clamped:
            break
        level, clamped = (total - taken) / free, n
    return held.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def plan(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, max_epochs: float = MAX_EPOCHS,
         seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents: id, _k, size, v) and (sources: _k, source_size, target, whole, buckets, b, cut).

    ``weights`` is (source, weight), default 1, 2, 3 in turn; a source without
    a weight takes no part. The partial repetition holds the documents first in
    the order of their draw: those in buckets before ``b``, and in bucket ``b``
    those up to ``cut``. Every bucket is small, so a source of any size is
    cut without sorting it as a whole.
    """
    docs = materialize(docs.select(F.col(id_col).alias("id"), source_key(source_col).alias("_k"), word_count(F.col(text_col).cast("string")).alias("size"), draw(id_col, seed).alias("v")))
    sizes = materialize(docs.groupBy("_k").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    if weights is None:
        weights = cyclic_weights(sizes.select("_k"))
    else:
        weights = weights.select(source_key("source").alias("_k"), F.col("weight").cast("double").alias("weight"))
    share = targets(sizes.join(weights, "_k"), total, max_epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    share = share.withColumn("whole", whole).withColumn("quota", F.col("target") - F.col("whole") * F.col("size"))
    buckets = F.least(F.ceil(F.col("n") / BUCKET_ROWS), F.lit(MAX_BUCKETS)).cast("long")
    share = materialize(share.select("_k", F.col("size").alias("source_size"), "target", "whole", "quota", buckets.alias("buckets")))

    dealt = docs.join(bounded(share.select("_k", "quota", "buckets")), "_k").withColumn("b", bucket())
    filled = dealt.groupBy("_k", "b", "quota").agg(F.sum("size").alias("words"))
    up_to = F.sum("words").over(Window.partitionBy("_k").orderBy("b"))
    edge = filled.withColumn("upto", up_to).filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("words") < F.col("quota")))
    edge = materialize(edge.select("_k", "b", (F.col("quota") - (F.col("upto") - F.col("words"))).alias("rest")))
    place = Window.partitionBy("_k").orderBy("v", "id", "size")
    last = dealt.join(bounded(edge), ["_k", "b"]).withColumn("upto", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    last = last.filter(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest")).groupBy("_k").agg(F.max(F.struct("v", "id")).alias("cut"))
    cuts = share.drop("quota").join(edge.select("_k", "b"), "_k", "left").join(last, "_k", "left")
    return docs, materialize(cuts)


def bucket() -> Column:
    """Bucket of a draw ``v`` among ``buckets``, in the order of the draw."""
    return F.shiftright(F.shiftright(F.col("v"), 20) * F.col("buckets"), 40)


def repetitions() -> Column:
    """How often a document with (v, id) of a source with (whole, buckets, b, cut) is taken."""
    part = (bucket() < F.col("b")) | ((bucket() == F.col("b")) & F.coalesce(F.struct("v", "id") <= F.col("cut"), F.lit(False)))
    return F.col("whole") + F.coalesce(part, F.lit(False)).cast("long")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """(id, size, source_size, target, repetitions, taken) per document of a weighted source.

    NULL and empty texts have size 0; NULL is a source of its own; a source
    without words has target 0. Repeated rows of an id are drawn together.
    """
    rows, sources = plan(docs, **options)
    out = rows.join(bounded(sources), "_k").withColumn("repetitions", repetitions())
    return out.select("id", "size", "source_size", "target", "repetitions", (F.col("repetitions") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. Texts do not move."""
    _, sources = plan(docs, seed=seed, id_col=id_col, source_col=source_col, **options)
    own = docs.columns
    held = docs.select(F.struct(*own).alias("_row"), F.col(id_col).alias("id"), source_key(source_col).alias("_k"), draw(id_col, seed).alias("v"))
    times = held.join(bounded(sources), "_k").select("_row", repetitions().alias("times")).filter(F.col("times") > 0)
    copies = times.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return copies.select(*[F.col("_row").getField(c).alias(c) for c in own])


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 15))::BIGINT AS v
  FROM documents),
s AS (
  SELECT source, source IS NULL AS last, sum(size)::BIGINT AS size,
         ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, 3.0::DOUBLE * size AS cap, (SELECT sum(size) FROM s)::DOUBLE AS total,
         coalesce(sum(3.0::DOUBLE * size) OVER w, 0) AS before, (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS free
  FROM s WINDOW w AS (ORDER BY 3.0::DOUBLE * size / weight, last, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap < weight * ((total - before) / free) AS clamped FROM o),
l AS (
  SELECT (max(total) - coalesce(sum(cap) FILTER (WHERE clamped), 0)) / sum(weight) FILTER (WHERE NOT clamped) AS level FROM c),
t AS (
  SELECT source, size AS source_size, CASE WHEN clamped THEN cap ELSE least(cap, weight * level) END AS target FROM c, l),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS quota,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.v, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN quota > 0 AND 2 * upto - size <= 2 * quota THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""
