"""What the findings of round 4 were about, and the rows that must still come out."""

import io
import os
import time
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossloom.operators import similarity as M
from crossloom.session import SHUFFLE_CLEANUP, ensure_checkpoint_dir, released
from crossloom.sources import sinks as S


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


@pytest.mark.parametrize("kernels, ratio", [(5, 2.0), (1, 2.0), (2, 2.0), (4, 3.0), (0, 2.0)])
def test_kernels_of_a_pair_take_one_exponential(kernels, ratio, monkeypatch):
    """at a ratio of 2 the other kernels are squares; sums are as from the definition, over any slices."""
    r = np.random.default_rng(4)
    x, y, width = r.normal(size=(37, 6)), r.normal(size=(29, 6)), 50.0
    d2 = ((x[:, None] - y[None]) ** 2).sum(2)
    want = sum(np.exp(-d2 / (width / ratio**i)).sum() for i in range(kernels))
    monkeypatch.setattr(M, "KERNEL_ROWS", 8)
    monkeypatch.setattr(M, "KERNEL_COLUMNS", 10)
    done, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda a, **options: done.append(a.size) or exp(a, **options))
    assert M._kernel_total(*M._exponents(x, y, width), kernels, ratio) == pytest.approx(want, rel=1e-12)
    assert ratio != 2.0 or sum(done) == d2.size


def test_pairs_of_blocks_are_not_merged_into_few_tasks(spark):
    """a pair of blocks has few bytes and much work, so the planner must not join tasks by their bytes."""
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).tolist(), "XY"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, domain string")
    got = M.kernel_shift(df, block_rows=40)
    assert plan(got).count("hashpartitioning(_qb") == plan(got).count(", 15), REPARTITION_BY_NUM") == 2
    whole = M.kernel_shift(df).first()["shift"]
    assert got.first()["shift"] == pytest.approx(whole, abs=1e-6)


@pytest.fixture(scope="module")
def clouds(spark):
    r = np.random.default_rng(6)
    rows = [(i, (r.normal(size=6) + 4 * (i % 5)).tolist(), "XY"[i % 2]) for i in range(600)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, domain string")


def test_a_query_is_sent_once_to_a_pack(spark, clouds):
    """near cells are a pack; a query takes a copy per pack and not per cell, with the list of the cells that it visits."""
    cells = M.Cells.of(clouds, ["domain"], "cosine", 40)
    assert len(cells.packs) > 2 * len(cells.subs) and sum(cells.held) == 600
    assert all(n <= M.PACK_BLOCKS * 40 or list(cells.packs).count(p) == 1 for p, n in enumerate(cells.held))
    queries = cells.choose(clouds.withColumn("_floor", F.lit(-9.0)), "reaching")
    sent = M._sent(queries, cells).collect()
    assert len({(r["id"], r["_pack"]) for r in sent}) == len(sent) == sum(M._visits(queries, cells))
    got = sorted((r["id"], c) for r in sent for c in r["_cells"])
    assert got == sorted((r["id"], c) for r in queries.collect() for c in r["_cells"]) and len(got) > 2 * len(sent)
    assert all(cells.packs[c] == r["_pack"] for r in sent for c in r["_cells"])


@pytest.mark.parametrize("options", [{}, {"ROUND_COPIES": 0.3}, {"PACK_BLOCKS": 1, "QUERY_ROWS": 30}])
def test_rounds_and_packs_give_the_same_rows(clouds, rows, monkeypatch, options):
    """rounds over parts of the queries, packs of any size and chunks of any size only move work."""
    want = rows(M.dense_topk(clouds, clouds, 4, exclude_self=True, by=("domain",), strategy="blocks"))
    for name, value in options.items():
        monkeypatch.setattr(M, name, value)
    assert rows(M.dense_topk(clouds, clouds, 4, exclude_self=True, by=("domain",), strategy="pivots", block_rows=40)) == want


def files(folder, part):
    return sorted(os.path.join(top, x) for top, _, names in os.walk(folder) for x in names if part in os.path.join(top, x))


def test_a_search_leaves_only_its_result(spark, clouds):
    """tables of the steps are deleted when the result is written."""
    ensure_checkpoint_dir(spark)
    folder = M.written(spark.range(1), "probe").inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0]
    before = set(os.listdir(folder))
    found = M.dense_topk(clouds, clouds, 4, by=("domain",), strategy="pivots", block_rows=40)
    assert [x.rpartition("-")[0].rsplit("-", 4)[0] for x in sorted(set(os.listdir(folder)) - before)] == ["found"]
    assert found.count() == 2400


def test_shuffles_of_written_tables_are_deleted(spark):
    """the setting holds while a table is written, and not after it."""
    spark.conf.unset(SHUFFLE_CLEANUP)
    seen = []
    with released(spark):
        seen.append(spark.conf.get(SHUFFLE_CLEANUP))
        with released(spark):
            seen.append(spark.conf.get(SHUFFLE_CLEANUP))
        seen.append(spark.conf.get(SHUFFLE_CLEANUP))
    assert seen == ["true"] * 3 and spark.conf.get(SHUFFLE_CLEANUP, None) is None


def test_an_exported_table_leaves_no_shuffle(spark, tmp_path):
    """shuffle files of an export are gone before the next one takes the disk."""
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    spark._jvm.System.gc()
    time.sleep(2)
    before = set(files(local, "shuffle_"))
    spark.sql("DROP TABLE IF EXISTS r04_export")
    S.export_table(spark.range(5000).withColumnRenamed("id", "user_id"), "r04_export", str(tmp_path / "t"), buckets=4)
    for _ in range(50):  # the files are deleted in the background
        if not set(files(local, "shuffle_")) - before:
            break
        time.sleep(0.1)
    left = set(files(local, "shuffle_")) - before
    assert not left and spark.table("r04_export").count() == 5000
    spark.sql("DROP TABLE r04_export")
