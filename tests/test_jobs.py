"""Sharded answer jobs that are stopped, killed and repaired, and laid-out tables."""

import shutil
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from crossloom.operators import jobs as J
from crossloom.sources import sinks as O

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import this file


def shout(prompts):
    if any("bad" in p for p in prompts):
        raise RuntimeError("no answer")
    return [p.upper() for p in prompts]


def well(prompts):
    return [p.upper() for p in prompts]


def never(prompts):
    raise AssertionError("nothing is left to do")


@pytest.fixture
def todo(spark):
    return spark.createDataFrame([(i, "bad" if i % 7 == 0 else f"p{i}") for i in range(50)], "id long, prompt string").repartition(3)


def test_a_stopped_job_goes_on(spark, todo, tmp_path):
    path = str(tmp_path / "job")
    first = J.run_shards(todo, path, shout, "id", shard_rows=10, file_rows=4, wave=2, max_waves=1).collect()
    assert sorted((r.shard, r.attempt, r.rows, r.failed) for r in first) == [(0, 0, 10, 2), (1, 0, 10, 1)]
    assert sorted(r.id for r in J.answers(spark, path).collect()) == list(range(20))
    files = sorted((tmp_path / "job" / "rows" / "shard=0").rglob("*.parquet"))
    assert files and all(spark.read.parquet(str(f)).count() <= 4 for f in files)
    J.run_shards(todo, path, shout, "id", shard_rows=10, wave=2)
    got = {r.id: (r.prediction, r.error) for r in J.answers(spark, path).collect()}
    assert got == {i: (None, "RuntimeError: no answer") if i % 7 == 0 else (f"P{i}", None) for i in range(50)}
    J.run_shards(todo, path, well, "id", shard_rows=10)  # failed rows are tried again, and only they
    assert {r.id: r.prediction for r in J.answers(spark, path).collect()} == {i: "BAD" if i % 7 == 0 else f"P{i}" for i in range(50)}
    assert J.answers(spark, path).count() == 50 and J.damaged(spark, path, "id").count() == 0
    marks = J.commits(spark, path).count()
    assert J.run_shards(todo, path, never, "id", shard_rows=10).count() == marks


def test_rows_without_a_commit_do_not_count(spark, todo, tmp_path):
    path = str(tmp_path / "job")
    J.run_shards(todo, path, well, "id", shard_rows=10, max_waves=1, wave=2)
    # what a killed run may leave: rows of a shard without its commit, some of them missing
    half = spark.createDataFrame([(20, "p20", "stale", None, 2, 0)], "id long, prompt string, prediction string, error string, shard long, attempt int")
    half.write.mode("append").partitionBy("shard", "attempt").parquet(f"{path}/rows")
    assert sorted(r.id for r in J.answers(spark, path).collect()) == list(range(20))
    J.run_shards(todo, path, well, "id", shard_rows=10)
    got = {r.id: r.prediction for r in J.answers(spark, path).collect()}
    assert len(got) == 50 and got[20] == "P20" and J.answers(spark, path).count() == 50


def test_lost_files_are_seen(spark, todo, tmp_path):
    path = str(tmp_path / "job")
    J.run_shards(todo, path, well, "id", shard_rows=10)
    shutil.rmtree(tmp_path / "job" / "rows" / "shard=3")
    assert [r.shard for r in J.damaged(spark, path, "id").collect()] == [3]


def test_an_empty_job(spark, todo, tmp_path):
    assert J.run_shards(todo.limit(0), str(tmp_path / "job"), never, "id").count() == 0


def test_laid_out_tables_join_without_a_shuffle(spark, tmp_path):
    a = spark.range(500).select((F.col("id") % 90).alias("user_id"), F.col("id").alias("v"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"))
    b = spark.range(90).select(F.col("id").alias("user_id"), (F.col("id") * 2).alias("w"))
    manifest = {r["name"]: r["rows"] for r in O.export_tables({"events": a, "users": b}, str(tmp_path / "x"), "laid_", by={"events": ["split"]}, buckets=4).collect()}
    assert manifest == {"events": 500, "users": 90} and O.changed(spark, str(tmp_path / "x"), "laid_") == []
    assert {p.name for p in Path(tmp_path / "x" / "events").iterdir() if p.is_dir()} == {"split=train", "split=test"}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("laid_events").join(spark.table("laid_users"), "user_id").groupBy("user_id").agg(F.sum(F.col("v") + F.col("w")).alias("s"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        want = a.join(b, "user_id").groupBy("user_id").agg(F.sum(F.col("v") + F.col("w")).alias("s"))
        assert sorted(joined.collect()) == sorted(want.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    next(iter(sorted((tmp_path / "x" / "users").glob("*.parquet")))).unlink()
    spark.catalog.refreshTable("laid_users")
    assert O.changed(spark, str(tmp_path / "x"), "laid_") == ["users"]
    for name in ("laid_events", "laid_users"):
        spark.sql(f"DROP TABLE {name}")


def test_only_the_folders_of_the_rows_are_replaced(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    O.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "split string, k int"), path, by=["split"])
    O.write_table(spark.createDataFrame([("b", 3)], "split string, k int"), path, by=["split"], mode="replace")
    assert rows(spark.read.parquet(path), "split", "k") == [("a", 1), ("b", 3)]
