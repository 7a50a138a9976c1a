"""Matrices in ``.npy`` files as tables, by ranges of rows.

The header is parsed on the driver and gives every task its range, so a file
of any size is read by many tasks, a few thousand rows at a time, in row-major
or column-major order. Files are opened by Arrow's file systems (local,
hdfs, s3, gs).
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TASK_BYTES = 64 << 20
SLICE_BYTES = 4 << 20
FILE_ROWS = 1 << 18
MAGIC = b"\x93NUMPY"


def _opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if ":/" not in path:
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    names = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".npy") and not f.base_name.startswith((".", "_")))
    return [path.rstrip("/") + name[len(inner.rstrip("/")) :] for name in names]


def header(path: str):
    """(offset of the data, dtype, rows, columns, column-major); a list of numbers is one row."""
    import numpy as np

    system, inner = _opened(path)
    with system.open_input_file(inner) as f:
        start = f.read(12)
        if start[:6] != MAGIC:
            raise ValueError(f"{path} is no .npy file")
        wide = start[6] > 1
        size = int.from_bytes(start[8:12] if wide else start[8:10], "little")
        offset = (12 if wide else 10) + size
        f.seek(offset - size)
        text = ast.literal_eval(f.read(size).decode("utf-8"))
        dtype, shape = np.dtype(text["descr"]), text["shape"]
        if dtype.hasobject or dtype.fields or len(shape) not in (1, 2):
            raise ValueError(f"{path} holds no matrix of numbers")
        rows, columns = (1, *shape) if len(shape) == 1 else shape
        if f.size() < offset + rows * columns * dtype.itemsize:
            raise ValueError(f"{path} is cut short")
    return offset, dtype.str, rows, columns, bool(text["fortran_order"]) and len(shape) == 2


@dataclass
class Range(InputPartition):
    file: str
    offset: int
    dtype: str
    rows: int
    columns: int
    by_column: bool
    first: int
    last: int


class MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.task_bytes = options["path"], int(options.get("taskbytes", TASK_BYTES))

    def partitions(self):
        import numpy as np

        out = []
        for file in _files(self.path):
            offset, dtype, rows, columns, by_column = header(file)
            step = max(1, self.task_bytes // max(1, columns * np.dtype(dtype).itemsize))
            out += [Range(file, offset, dtype, rows, columns, by_column, at, min(rows, at + step)) for at in range(0, rows, step)]
        return out or [Range("", 0, "<f4", 0, 0, False, 0, 0)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        p = partition
        if p.first == p.last:
            return
        dtype = np.dtype(p.dtype)
        system, inner = _opened(p.file)
        step = max(1, SLICE_BYTES // max(1, p.columns * dtype.itemsize))
        with system.open_input_file(inner) as f:
            for at in range(p.first, p.last, step):
                n = min(step, p.last - at)
                if p.by_column:
                    part = np.empty((n, p.columns), dtype)
                    for c in range(p.columns):
                        f.seek(p.offset + (c * p.rows + at) * dtype.itemsize)
                        part[:, c] = np.frombuffer(f.read(n * dtype.itemsize), dtype)
                else:
                    f.seek(p.offset + at * p.columns * dtype.itemsize)
                    part = np.frombuffer(f.read(n * p.columns * dtype.itemsize), dtype).reshape(n, p.columns)
                part = part.astype(np.float32)
                offsets = np.arange(0, part.size + 1, p.columns, dtype=np.int32) if p.columns else np.zeros(n + 1, np.int32)
                vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([p.file] * n, pa.string()), pa.array(np.arange(at, at + n)), vectors], names=["file", "row", "embedding"])


class MatrixSource(DataSource):
    """``spark.read.format("npy").load(path)``; option ``taskBytes`` is the size of a task's range."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "file string, row bigint, embedding array<float>"

    def reader(self, schema):
        return MatrixReader(self.options)


def read_matrix(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``(file, row, embedding)`` of the matrices in a file or below a folder; the row number in the file is the key."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("npy").option("taskBytes", task_bytes).load(path)


def write_matrix(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write ``(row, embedding)``, rows numbered from 0, as one file per ``file_rows`` rows: ``part-<first row>.npy``.

    Returns ``(file, first, rows)``, a line per file. A file appears under its name when it is complete, so a
    task that is run again does no harm.
    """

    def task(batches):
        import uuid

        import numpy as np
        import pyarrow as pa

        def done(number, rows):
            data = np.asarray(rows, np.float32)
            name = f"part-{number * file_rows:012d}.npy"
            system, inner = _opened(path)
            system.create_dir(inner, recursive=True)
            hidden = f"{inner}/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as f:
                np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": data.shape})
                f.write(data.tobytes())
            system.move(hidden, f"{inner}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([number * file_rows]), pa.array([len(data)])], ["file", "first", "rows"])

        now, rows = None, []
        for b in batches:
            for number, vector in zip(b.column(0).to_pylist(), b.column(1)):
                if number != now and rows:
                    yield done(now, rows)
                    rows = []
                now = number
                rows.append(vector.values.to_numpy(zero_copy_only=False))
        if rows:
            yield done(now, rows)

    number = F.floor(F.col("row") / file_rows).cast("long")
    dealt = df.select(number.alias("_f"), "row", F.col("embedding").cast("array<float>").alias("embedding")).repartition(F.xxhash64("_f")).sortWithinPartitions("_f", "row")
    files = dealt.select("_f", "embedding").mapInArrow(task, "file string, first bigint, rows bigint").collect()  # a line per file
    return df.sparkSession.createDataFrame(files, "file string, first bigint, rows bigint")
