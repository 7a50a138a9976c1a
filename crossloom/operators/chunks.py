"""Sequences of any length as tables of chunks.

A chunk is ``(*keys, chunk, first, seq)``: up to ``size`` consecutive events of
a key as an ordered array, with the chunk's number and the 1-based place of
its first event. A key with any number of events is that many rows; no group
and no array holds more than a chunk, and chunks of one key lie in any task.
What crosses a border is fetched from the next chunk by a join on its number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossloom.operators.ordering import DETECT, HOT_ROWS, keyed_join, ordered_columns

CHUNK = 1024


def chunked(events: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], size: int = CHUNK,
            hot_rows: int = HOT_ROWS, hot=DETECT) -> DataFrame:
    """Chunks of all events per key in the given (total) order; entries hold ``order`` and ``fields``."""
    entry = [*order, *[f for f in fields if f not in order]]
    slim = events.select(*keys, *[c for c in entry if c not in keys])
    placed = ordered_columns(slim, keys, order, position="_pos", hot_rows=hot_rows, hot=hot)
    chunk = F.floor((F.col("_pos") - 1) / size).cast("long")
    packed = F.sort_array(F.collect_list(F.struct(*entry))).alias("seq")  # as long as a chunk
    return placed.groupBy(*keys, chunk.alias("chunk")).agg(F.min("_pos").alias("first"), packed).select(*keys, "chunk", "first", "seq")


def lengths(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, length)``: events per key."""
    return chunks.groupBy(*keys).agg(F.max(F.col("first") + F.size("seq") - 1).alias("length"))


def with_length(chunks: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Chunks with the number of events of their key."""
    return keyed_join(chunks, lengths(chunks, keys), keys, hot_rows=hot_rows)


def stitched(chunks: DataFrame, keys: Sequence[str], n: int = 1) -> DataFrame:
    """Chunks with ``after``: the first ``n`` (at most a chunk) events of the next chunk of the key, none behind the last."""
    heads = chunks.select(*keys, (F.col("chunk") - 1).alias("chunk"), F.slice("seq", 1, n).alias("after"))
    joined = chunks.join(heads, [*keys, "chunk"], "left")
    return joined.withColumn("after", F.coalesce("after", F.slice("seq", 1, 0)))


def pairs(chunks: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """Chunks with ``pairs``: ``[value, next value]`` of consecutive events, the one across the border included."""
    values = F.transform(F.concat("seq", "after"), lambda e: e[field])
    n = F.size(values) - 1
    both = F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), lambda a, b: F.array(a, b))
    return stitched(chunks, keys).select(*keys, "chunk", both.alias("pairs"))


def digests(chunks: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """``(*keys, digest)``: equal for keys with equal sequences of ``value`` (a column of each chunk); 128 bits and the length.

    Sums over chunks combine before the shuffle, so a key of very many chunks is no hot group.
    """
    low = F.xxhash64(F.col("chunk"), value)
    high = F.xxhash64(F.lit(1), value, F.col("chunk"))
    return chunks.groupBy(*keys).agg(F.struct(
        F.sum(F.size("seq")).alias("n"), F.bit_xor(low).alias("x"), F.sum(high.cast("decimal(20,0)")).alias("s")).alias("digest"))


def distinct_sequences(chunks: DataFrame, key: str, value: Column) -> DataFrame:
    """The chunks of the smallest key of every set of keys with equal sequences of ``value``."""
    first = digests(chunks, [key], value).groupBy("digest").agg(F.min(key).alias(key)).select(key)
    return chunks.join(first, key, "left_semi")


def statistics(chunks: DataFrame, key: str, field: str, by: Sequence[str] = ()) -> DataFrame:
    """Lines, largest value and key, smallest and largest last value, longest sequence, per value of ``by``."""
    values = F.transform("seq", lambda e: e[field])
    per_key = chunks.groupBy(key, *by).agg(
        F.max(F.array_max(values)).alias("_max"), F.max_by(F.element_at(values, -1), F.col("chunk")).alias("_border"),
        F.max(F.col("first") + F.size("seq") - 1).alias("_n"))
    return per_key.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"), F.max("_max").alias("max_item"), F.max(key).alias("max_user"),
        F.min("_border").alias("min_border"), F.max("_border").alias("max_border"), F.max("_n").cast("int").alias("max_length"))


def exploded(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, pos, fields…)``: one row per event again."""
    rows = chunks.select(*keys, "first", F.posexplode("seq").alias("_at", "_e"))
    return rows.select(*keys, (F.col("first") + F.col("_at")).alias("pos"), "_e.*")
