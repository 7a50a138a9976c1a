import duckdb

from crossloom.llm import mixing
from llm_helpers import ODD, doc


def test_same_as_sql(spark, sf):
    got = sorted(tuple(r) for r in mixing.query(spark, sf).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        assert got == sorted(con.execute(mixing.SQL).fetchall())


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10, 1.0), ("b", 1000, 1.0), ("c", 100, 8.0), ("d", 0, 3.0)], "_k string, size long, weight double")
    got = {r._k: r.target for r in mixing.targets(sizes).collect()}
    assert got == {"a": 30.0, "b": 780.0, "c": 300.0, "d": 0.0}
    got = {r._k: r.target for r in mixing.targets(sizes, total=10**9).collect()}  # beyond all caps
    assert got == {"a": 30.0, "b": 3000.0, "c": 300.0, "d": 0.0}


def test_parts_come_near_their_targets(documents):
    rows = [doc(i, "w " * (i % 50 + 1), source="big" if i % 3 else f"s{i % 7}") for i in range(4000)]
    got = mixing.mixed(documents(rows)).collect()
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    by, source = {}, {r[0]: r[3] for r in rows}
    for r in got:
        x = by.setdefault((source[r.id], r.target), [r.source_size, 0, 0])
        x[1] += r.taken
        x[2] = max(x[2], r.size)
    assert len(by) == 8 and all(abs(taken - target) <= longest / 2 + 1e-6 and target <= 3 * size for (_, target), (size, taken, longest) in by.items())
    assert sorted(got) == sorted(mixing.mixed(documents(rows)).collect())


def test_mixture_holds_the_rows_as_often_as_planned(documents):
    rows = [doc(i, "w " * (i + 1), source="ab"[i % 2]) for i in range(40)]
    table = documents(rows)
    want = {r.id: r.repetitions for r in mixing.mixed(table).collect() if r.repetitions}
    out = mixing.mixture(table)
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want and out.columns == table.columns


def test_given_weights(documents, spark):
    weights = spark.createDataFrame([("a", 1.0), (None, 1.0)], "source string, weight double")
    rows = [doc(1, "a b c d", source="a"), doc(2, "a b c d", source=None), doc(3, "x", source="b")]
    assert sorted(r.id for r in mixing.mixed(documents(rows), weights=weights).collect()) == [1, 2]


def test_odd_and_empty(documents):
    got = mixing.mixed(documents(ODD)).collect()
    assert len(got) == len(ODD) and {r.source_size for r in got} == {30008, 4}
    assert mixing.mixed(documents([])).collect() == []
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mixed(documents([doc(1, None), doc(2, "")])).collect())


def test_no_python_in_the_plan(spark, sf):
    plan = mixing.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), plan
