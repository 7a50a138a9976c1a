"""Records of files that are read in very small splits, against the standard parsers."""

import csv
import io
import json
import random

import pytest

from crossloom.sources import readers as I
from crossloom.sources.records import read_records

NASTY = ['plain', 'a,b', '"quoted"', 'back\\slash', '\\"', 'line\nbreak', '[{', '}],', 'é日🙂', '', '\\\\', '",{"x":1}', "it's", '"", ""']


@pytest.fixture(params=[29, 64, 1 << 20])
def splits(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def values(seed, n=30):
    r = random.Random(seed)
    return [{"id": i, "t": r.choice(NASTY) + r.choice(NASTY), "l": [r.choice(NASTY) for _ in range(r.randrange(3))], "o": {"k": r.choice(NASTY)}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 1])
def test_arrays(spark, tmp_path, splits, indent):
    rows = values(1)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "b.json").write_text(json.dumps(rows[:1], indent=indent))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text(json.dumps(rows[3], indent=indent))  # a single object
    (tmp_path / "e.json").write_text("")
    got = read_records(spark, str(tmp_path), "array").collect()
    of = lambda name: [json.loads(r.value) for r in sorted(got, key=lambda r: r.pos) if r.file.endswith(name)]
    assert of("a.json") == rows and of("b.json") == rows[:1] and of("d.json") == [rows[3]]
    assert len(got) == len(rows) + 2
    if splits < 100:
        assert read_records(spark, str(tmp_path / "a.json"), "array").count() == len(rows)


@pytest.mark.parametrize("indent", [None, 2])
def test_keyed(spark, tmp_path, splits, indent, rows):
    table = {f"{r['id']},{r['t']}": r["l"] for r in values(2)}
    (tmp_path / "k.json").write_text(json.dumps(table, indent=indent))
    got = {r.id: r.value for r in I.read_keyed(spark, str(tmp_path / "k.json"), "array<string>").collect()}
    assert got == table


def test_catalogue(spark, tmp_path, splits):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["idBefore", "item_title", "idAfter"])
    titles = {f"A{i}": NASTY[i % len(NASTY)].replace("\\", "/").strip() for i in range(40)}
    for i, (k, title) in enumerate(titles.items()):
        w.writerow([k, title, i])
    (tmp_path / "x.csv").write_text(out.getvalue())
    got = {r.item_id: (r.title or "", r.idx) for r in I.read_catalogue(spark, {"X": str(tmp_path / "x.csv")}).collect()}
    assert got == {k: (v, i) for i, (k, v) in enumerate(titles.items())}


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps([{"id": i, "t": "x" * 50} for i in range(400)]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = read_records(spark, str(tmp_path / "big.json"), "array")
        from pyspark.sql import functions as F

        tasks = found.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks >= 6
