"""Matrices of every order and type, and of more than 2 GB."""

import numpy as np
import pytest

from crossloom.sources import matrix as M


@pytest.mark.parametrize("dtype", ["<f8", "<f4", ">f4", "<i2"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_ranges_of_rows(spark, tmp_path, dtype, order):
    data = np.asarray(np.arange(700 * 3).reshape(700, 3), dtype=dtype, order=order)
    np.save(tmp_path / "a.npy", data)
    got = M.read_matrix(spark, str(tmp_path), task_bytes=500).orderBy("row").collect()
    assert [r.row for r in got] == list(range(700)) and [r.embedding for r in got] == data.astype(float).tolist()
    assert M.read_matrix(spark, str(tmp_path), task_bytes=500).rdd.getNumPartitions() >= 9


def test_other_shapes(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.array([1.5, 2.5]))
    np.save(tmp_path / "none.npy", np.zeros((0, 4)))
    (tmp_path / "notes.txt").write_text("no matrix")
    assert [(r.row, r.embedding) for r in M.read_matrix(spark, str(tmp_path)).collect()] == [(0, [1.5, 2.5])]
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(ValueError):
        M.header(str(tmp_path / "cube.npy"))


def test_more_than_two_gigabytes(tmp_path):
    """A sparse file: only what is read takes memory and disk."""
    path, rows, columns = tmp_path / "big.npy", 9_000_000, 64
    with open(path, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (rows, columns)})
        start = f.tell()
        f.seek(start + (rows - 1) * columns * 4)
        f.write(np.arange(columns, dtype="<f4").tobytes())
    assert path.stat().st_size > 2 << 30
    reader = M.MatrixReader({"path": str(path)})
    parts = reader.partitions()
    assert len(parts) > 30 and parts[0].first == 0 and parts[-1].last == rows and all(a.last == b.first for a, b in zip(parts, parts[1:]))
    last = list(reader.read(parts[-1]))
    assert max(b.num_rows for b in last) * columns * 4 <= M.SLICE_BYTES
    assert last[-1].column(1)[-1].as_py() == rows - 1 and last[-1].column(2)[-1].as_py() == list(range(columns))


def test_written_and_read_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(230, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "row long, embedding array<double>").repartition(7)
    files = sorted((r.first, r.rows) for r in M.write_matrix(df, str(tmp_path / "m"), 100).collect())
    assert files == [(0, 100), (100, 100), (200, 30)]
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == [f"part-{n:012d}.npy" for n in (0, 100, 200)]
    assert np.array_equal(np.concatenate([np.load(tmp_path / "m" / f"part-{n:012d}.npy") for n in (0, 100, 200)]), data)


def test_a_short_file_is_refused(tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((100, 4)))
    with open(tmp_path / "a.npy", "r+b") as f:
        f.truncate(1000)
    with pytest.raises(ValueError):
        M.header(str(tmp_path / "a.npy"))
