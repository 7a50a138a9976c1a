"""Session helpers: local sessions for tests, and lineage cuts that survive executor loss."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", checkpoint_dir: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark. A cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("crossloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if checkpoint_dir is not None:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local master may fall back to a temp folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="crossloom-checkpoint-")
    sc.setCheckpointDir(shared)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it from there.

    Used where a column must not change when a task is run again (partition
    ids, sampled range bounds) and between rounds of an iteration.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of this application below the checkpoint folder, which the driver and all executors reach."""
    return f"{_job_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _job_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/crossloom-{spark.sparkContext.applicationId}"


@contextlib.contextmanager
def released(spark: SparkSession):
    """Shuffle files of what is written inside are deleted when it is written, not when the driver next collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder: computed once, read by column, there when an executor is lost."""
    path = shared_folder(df.sparkSession, name)
    with released(df.sparkSession):
        df.write.option("compression", "snappy").parquet(path)  # read a few times and then gone: quick beats small
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in sorted({file.rpartition("/")[0] for file in table.inputFiles()}):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_written(spark: SparkSession) -> None:
    """Delete all tables this application has written by ``written``; results that still read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_job_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
