"""Answer jobs in shards that survive a killed run.

Rows are numbered in the order of their key and cut into shards. A wave of
shards is answered, written to one folder per shard and attempt (which
replaces whatever a killed run left there), counted again from the files, and
only then marked in the table of commits. Rows of unmarked folders do not
count. A later run answers shards without a mark, and the failed rows of the
others as a further attempt; of the old answers it reads those shards alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossloom.operators.instructions import call_model
from crossloom.operators.ordering import dense_index

SHARD_ROWS = 4000
FILE_ROWS = 2000
WAVE = 16  # shards between two commits
COMMIT = "shard long, attempt int, rows long, failed long, checksum long"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, attempt, rows, failed, checksum)`` of everything that was finished."""
    return spark.read.schema(COMMIT).parquet(f"{path}/commits") if _exists(spark, f"{path}/commits") else spark.createDataFrame([], COMMIT)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _checksum(key: str):
    return F.coalesce(F.bit_xor(F.xxhash64(F.col(key), "prediction", "error")), F.lit(0)).alias("checksum")


def run_shards(todo: DataFrame, path: str, model: Callable[[list[str]], list[str]], key: str, prompt: str = "prompt", *,
               shard_rows: int = SHARD_ROWS, file_rows: int = FILE_ROWS, wave: int = WAVE, max_waves: int | None = None,
               retries: int = 3) -> DataFrame:
    """Answer what the folder does not hold yet, at most ``max_waves`` waves of it; returns the commits.

    ``todo`` has one row per key and is the same in every run. A failed row is tried in up to ``retries`` later runs.
    """
    spark = todo.sparkSession
    shard = F.floor(F.col("_row") / shard_rows).cast("long")
    rows = dense_index(todo, [key], "_row").withColumn("shard", shard).drop("_row")
    last = {r["shard"]: r for r in commits(spark, path).groupBy("shard").agg(
        F.max("attempt").alias("attempt"), F.max_by("failed", "attempt").alias("failed")).collect()}  # one row per shard
    n = rows.agg(F.max("shard")).first()[0]
    plan = [(s, 0) for s in range(0 if n is None else n + 1) if s not in last]
    plan += [(s, r["attempt"] + 1) for s, r in sorted(last.items()) if r["failed"] and r["attempt"] < retries]
    schema = T.StructType([*todo.schema.fields, T.StructField("prediction", T.StringType()), T.StructField("error", T.StringType()),
                           T.StructField("shard", T.LongType()), T.StructField("attempt", T.IntegerType())])
    for at in range(0, len(plan), wave)[:max_waves]:
        part = plan[at : at + wave]
        attempt = F.create_map(*[F.lit(x) for s, a in part for x in (s, a)])
        some = rows.filter(F.col("shard").isin([s for s, _ in part])).withColumn("attempt", attempt[F.col("shard")])
        again = [s for s, a in part if a]
        if again:
            old = spark.read.schema(schema).parquet(f"{path}/rows").filter(F.col("shard").isin(again))  # prunes the folders
            failed = _current(old, commits(spark, path)).filter(F.col("error").isNotNull()).select(key)
            some = some.filter("attempt = 0").unionByName(some.filter("attempt > 0").join(failed, key, "left_semi"))
        cores = spark.sparkContext.defaultParallelism
        spread = some.repartition(max(cores, len(part)), "shard", key)
        answered = call_model(spread, model, prompt).select(*schema.names)
        answered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", file_rows).partitionBy(
            "shard", "attempt").parquet(f"{path}/rows")
        written = spark.read.schema(schema).parquet(f"{path}/rows").filter(F.col("shard").isin([s for s, _ in part]))
        marks = written.filter(F.col("attempt") == attempt[F.col("shard")]).groupBy("shard", "attempt").agg(
            F.count(F.lit(1)).alias("rows"), F.count("error").alias("failed"), _checksum(key))
        marks.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return commits(spark, path)


def _current(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Committed rows; a failed one only from the last attempt of its shard."""
    known = marks.select("shard", "attempt", F.max("attempt").over(Window.partitionBy("shard")).alias("_last"))
    return rows.join(known, ["shard", "attempt"]).filter(F.col("error").isNull() | (F.col("attempt") == F.col("_last"))).drop("_last")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """The answers of all finished shards, one row per key; rows that still fail have their last error."""
    rows = spark.read.parquet(f"{path}/rows").withColumn("shard", F.col("shard").cast("long"))
    return _current(rows, commits(spark, path)).drop("shard", "attempt")


def damaged(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Commits whose rows are no longer what was committed (lost or changed files)."""
    now = spark.read.parquet(f"{path}/rows").groupBy(F.col("shard").cast("long").alias("shard"), "attempt").agg(
        F.count(F.lit(1)).alias("_rows"), _checksum(key).alias("_checksum"))
    found = commits(spark, path).join(now, ["shard", "attempt"], "left")
    return found.filter(~F.col("rows").eqNullSafe(F.col("_rows")) | ~F.col("checksum").eqNullSafe(F.col("_checksum"))).select("shard", "attempt")
