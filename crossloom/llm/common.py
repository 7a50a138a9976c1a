"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossloom.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"  # a word; bytes.split() cuts UTF-8 at the same six bytes


def raw_text(df: DataFrame, *keep: str, text: str = "text", out: str = "_raw") -> DataFrame:
    """The columns ``keep`` and the text as UTF-8 bytes (NULL: empty); any other column is left behind."""
    return df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias(out))


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a NULL id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which the driver and all executors reach."""
    ensure_checkpoint_dir(spark)
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_batches(batches, rows: int = 256):
    """Arrow batches cut into pieces of few rows, so that very long texts are not all Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, parted by the columns ``by``: computed once, there when an executor is lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        files = table.inputFiles()
        if files:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
