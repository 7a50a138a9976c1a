"""Records of files whose borders are no line ends: JSON arrays, JSON objects keyed by id, CSV with quoted line breaks.

Spark's text source cuts any file into splits, at commas for JSON and at line
ends for CSV, and tells each piece's file and split. Whether a comma or line
end parts two records depends on quotes and brackets before it, so there are
two passes: the first sums up each split for both cases, that it starts inside
a quoted text or outside; a walk over the splits of a file then gives the
true start of each; the second pass cuts the records. What lies across a
border leaves as fragments, two a split at most, which are joined per file.
One large file is read by as many tasks as it has splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = {"array": ",", "keyed": ",", "csv": "\n"}
PIECES = 1 << 16  # pieces scanned together


def _marks(buf: bytes, kind: str, inside: bool, depth: int):
    """(separators outside of quotes, depth at each of them, whether the end is inside quotes, depth at the end)."""
    import numpy as np

    b = np.frombuffer(buf, np.uint8)
    quote = b == 34
    if kind != "csv":
        slash = b == 92
        if slash.any():  # a character behind an odd number of backslashes is escaped
            at = np.arange(len(b))
            last = np.maximum.accumulate(np.where(slash, -1, at))  # last place that is no backslash
            odd = np.concatenate([[False], (at - last)[:-1] % 2 == 1])
            quote &= ~odd
    within = (np.cumsum(quote) + inside) % 2 == 1
    parts = np.flatnonzero((b == ord(SEPARATOR[kind])) & ~within)
    if kind == "csv":
        return parts, np.ones(len(parts), np.int64), bool(within[-1]), 1
    step = np.zeros(len(b), np.int64)
    step[((b == 91) | (b == 123)) & ~within] = 1
    step[((b == 93) | (b == 125)) & ~within] = -1
    level = np.cumsum(step) + depth
    return parts, level[parts], bool(within[-1]), int(level[-1])


def _runs(batches):
    """(file, split, text as bytes, is this the last piece of the split) for stretches of pieces of one split, separators put back in later."""
    held = None
    for b in batches:
        for at in range(0, b.num_rows, PIECES):
            part = b.slice(at, PIECES)
            files, splits, values = (part.column(i).to_pylist() for i in range(3))
            lo = 0
            for i in range(1, len(files) + 1):
                if i == len(files) or splits[i] != splits[lo] or files[i] != files[lo]:
                    if held is not None:
                        yield (*held, (held[0], held[1]) != (files[lo], splits[lo]))
                    held, lo = (files[lo], splits[lo], values[lo:i]), i
    if held is not None:
        yield (*held, True)


def read_records(spark: SparkSession, path: str, kind: str, **options: str) -> DataFrame:
    """``(file, pos, value)``: the text of every record. Kinds: array (elements of a JSON array; a single object is
    one record), keyed (``"key": value`` of a JSON object), csv (lines outside of quotes, the header line included).

    ``pos`` rises within a file. Blank records are left out. ``options`` go to the text source.
    """
    if kind not in SEPARATOR:
        raise ValueError(f"unknown kind {kind}")
    sep = SEPARATOR[kind].encode()
    pieces = spark.read.options(lineSep=SEPARATOR[kind], **options).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))

    def sums(batches):
        import pyarrow as pa

        state, opener = None, None
        for file, split, values, last in _runs(batches):
            buf = sep.join(values) + sep
            if state is None:
                state, opener = [(False, 0), (True, 0)], buf.lstrip()[:1].decode("latin-1")
            state = [_marks(buf, kind, inside, depth)[2:] for inside, depth in state]
            if last:
                cols = [[file], [split], [opener], *([x] for s in state for x in s)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["file", "split", "opener", "out", "out_depth", "in", "in_depth"])
                state = None

    found = pieces.mapInArrow(sums, "file string, split bigint, opener string, out boolean, out_depth bigint, in boolean, in_depth bigint")
    starts, state = {}, {}
    for r in found.orderBy("file", "split").toLocalIterator():  # one row per split of the files
        opener, inside, depth = state.get(r["file"], (r["opener"], False, 0))
        starts[r["file"], r["split"]] = (opener, inside, depth)
        state[r["file"]] = (opener, r["in" if inside else "out"], depth + r["in_depth" if inside else "out_depth"])
    shared = spark.sparkContext.broadcast(starts)

    def cut(batches):
        import pyarrow as pa

        now, rows, rest, n = None, [], [], 0
        for file, split, values, last in _runs(batches):
            if now is None:
                opener, inside, depth = shared.value[file, split]
                now, rest, n, whole = (inside, depth), [], 0, kind == "array" and opener == "{"
            buf = sep.join(values) + sep
            places, level, *now = _marks(buf, kind, *now)
            at, rows = 0, []
            for place in ([] if whole else places[level == 1].tolist()):
                # the first record of a split may have begun in the one before
                rows.append((file, split, n, "whole" if n else "head", b"".join([*rest, buf[at:place]])))
                at, rest, n = place + 1, [], n + 1
            rest.append(buf[at:])
            if last:
                rows.append((file, split, n, "tail" if n else "middle", b"".join(rest)))
                now = None
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, kinds)], ["file", "split", "n", "part", "value"])

    def join(key, fragments):
        """Records across borders, the first and the last of the file among them, which carry its brackets."""
        import pyarrow as pa

        out, held, pos = [], b"", 0
        for r in sorted(fragments.to_pylist(), key=lambda r: (r["split"], r["n"])):
            if r["part"] == "head":
                out.append((pos, held + r["value"]))
            elif r["part"] == "middle":
                held += r["value"]
            else:
                held, pos = r["value"], r["split"] + r["n"]
        out.append((pos, held.rstrip().removesuffix(sep).rstrip()))
        first = out[0][1].lstrip()
        if kind == "keyed" or (kind == "array" and first[:1] == b"["):
            out[0] = (out[0][0], first[1:])
            out[-1] = (out[-1][0], out[-1][1][:-1])
        return pa.table({"file": pa.array([key[0].as_py()] * len(out), pa.string()), "pos": pa.array([p for p, _ in out], pa.int64()),
                         "value": pa.array([v for _, v in out], pa.binary())})

    parts = pieces.mapInArrow(cut, "file string, split bigint, n bigint, part string, value binary")
    inner = parts.filter("part = 'whole'").select("file", (F.col("split") + F.col("n")).alias("pos"), "value")  # a record has a separator at least
    across = parts.filter("part <> 'whole'").groupBy("file").applyInArrow(join, "file string, pos bigint, value binary")
    return inner.unionByName(across).select("file", "pos", F.col("value").cast("string").alias("value")).filter(F.regexp_like("value", F.lit(r"\S")))
