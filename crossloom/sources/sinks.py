"""Writers: Parquet tables, optionally partitioned, JSON exports, and tables laid out by user.

A laid-out table is bucketed and sorted by its key, so that joins and groups by
that key need no shuffle, and comes with a manifest of counts and checksums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossloom.session import released

BUCKETS = 64


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Write one table. ``by`` makes folders, e.g. one per split; mode ``replace`` only overwrites the folders that the rows belong to."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") if mode == "replace" else df.write.mode(mode)
    writer = writer.format(fmt)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_tables(tables: dict[str, DataFrame], folder: str, by: dict[str, Sequence[str]] | None = None, fmt: str = "parquet") -> None:
    """Write several named tables below one folder."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", (by or {}).get(name, ()), fmt=fmt)


def append_answers(df: DataFrame, path: str) -> None:
    """Add answers to an answer table; earlier rows stay."""
    df.write.mode("append").parquet(path)


def content(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, rows, checksum)``: the checksum depends on all columns of all rows but not on their order."""
    line = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(line.cast("decimal(20,0)")).cast("string").alias("checksum"))


def export_table(df: DataFrame, name: str, path: str, key: str = "user_id", order: Sequence[str] = (), by: Sequence[str] = (),
                 buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` as catalogue table ``name`` below ``path``, bucketed by ``key`` and sorted by it and ``order``; returns it as read back.

    ``by`` makes folders besides. Rows are dealt out by bucket first, so a bucket is one file per folder, whatever
    the number of tasks before.
    """
    dealt = df.repartition(buckets, key)
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key, *order).option("path", path)
    with released(df.sparkSession):  # the next table has the disk to itself
        (writer.partitionBy(*by) if by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def export_tables(tables: dict[str, DataFrame], folder: str, prefix: str = "", key: str = "user_id", by: dict[str, Sequence[str]] | None = None,
                  buckets: int = BUCKETS) -> DataFrame:
    """Lay out several tables and return their manifest ``(name, rows, checksum)``, which is written beside them."""
    manifest = None
    for name, df in tables.items():
        back = export_table(df, prefix + name, f"{folder}/{name}", key, by=(by or {}).get(name, ()), buckets=buckets)
        line = content(back).select(F.lit(name).alias("name"), "rows", "checksum")
        manifest = line if manifest is None else manifest.unionByName(line)
    write_table(manifest, f"{folder}/manifest")
    return manifest.sparkSession.read.parquet(f"{folder}/manifest")


def changed(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Names of the exported tables that no longer hold what their manifest says."""
    lines = spark.read.parquet(f"{folder}/manifest").collect()  # a line per table
    return [r["name"] for r in lines if tuple(content(spark.table(prefix + r["name"])).first()) != (r["rows"], r["checksum"])]
