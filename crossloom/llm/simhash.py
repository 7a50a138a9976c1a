"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is cut into segments; the numbers of set bits per segment
are a point on a grid. Two fingerprints that differ in d bits are at most d
apart there by Manhattan distance, so every partner lies in one of the few
cells within ``max_bits``: a range join on the grid finds all candidates, and
the fingerprints themselves decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossloom.llm.common import raw_text, text_batches
from crossloom.llm.components import components, forest
from crossloom.session import materialize

WIDTHS = (7, 7, 7, 7, 6, 6, 6, 6, 6, 6)  # bits per segment, 64 together
HOT_CELL = 1024  # fingerprints in a cell beyond which its pairs are compared in blocks
HASHES = 1 << 16  # shingle hashes held at once


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a text in UTF-8: majority of the XXH64 of all its word shingles. No word: 0."""
    import numpy as np
    import xxhash

    words = raw.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, n, HASHES):
        h = np.array([digest(b" ".join(words[i : i + shingle]), seed) for i in range(at, min(n, at + HASHES))], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) per row. NULL text counts as empty; a text of fewer words than a shingle is one shingle."""

    def task(batches):
        import pyarrow as pa

        for b in text_batches(batches):
            fps = [fingerprint(x, shingle, seed) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return raw_text(docs, F.col(id_col).alias("id"), text=text_col).mapInArrow(task, f"id {kind}, fp bigint")


def cell(fp: Column) -> Column:
    """Grid cell of a fingerprint: one hexadecimal digit per segment, 2 added so that neighbours never borrow."""
    out, at = F.lit(0).cast("long"), 0
    for k, width in enumerate(WIDTHS):
        ones = F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1))
        out, at = out + F.shiftleft(ones.cast("long") + 2, 4 * k), at + width
    return out


def offsets(max_bits: int) -> list[int]:
    """Differences between cells within ``max_bits`` by Manhattan distance, one of each opposite pair, and 0."""
    unit = [s * 16**k for k in range(len(WIDTHS)) for s in (1, -1)]
    found = {0}
    for _ in range(max_bits):
        found |= {x + d for x in found for d in unit}
    return sorted(x for x in found if x >= 0)


def links(fps: DataFrame, max_bits: int = 2, hot_cell: int = HOT_CELL) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that differ in at most ``max_bits`` (up to 2) bits.

    Between fingerprints of cells with at most ``hot_cell`` members every link
    is returned. Larger cells are cut into blocks, and of the links between
    two blocks only enough are returned to keep connected what is connected.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    home = fps.select("fp", cell(F.col("fp")).alias("cell"))
    probe = home.select(F.col("fp").alias("p"), F.explode(F.array(*[F.col("cell") + F.lit(d) for d in offsets(max_bits)])).alias("cell"))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("p"))) <= max_bits) & (F.col("fp") != F.col("p"))
    hot = materialize(home.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_cell))
    if hot.isEmpty():
        return probe.join(home, (probe["cell"] == home["cell"]) & near).select(F.col("p").alias("u"), F.col("fp").alias("v"))
    key = hot.select("cell")
    cold_p, cold_h = probe.join(key, "cell", "left_anti"), home.join(key, "cell", "left_anti")
    cold = cold_p.join(cold_h, (cold_p["cell"] == cold_h["cell"]) & near).select(F.col("p").alias("u"), F.col("fp").alias("v"))
    return cold.unionByName(_block_links(home.join(hot, "cell"), probe.join(hot, "cell"), max_bits, hot_cell))


def _block_links(home: DataFrame, probe: DataFrame, max_bits: int, block: int) -> DataFrame:
    """Members and visitors of crowded cells, dealt into blocks; each pair of blocks is one group."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    # a cell of n members has about 2n visitors per neighbour; visitors are dealt into four times as many blocks
    mine = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    h = home.select("cell", mine("fp", blocks).alias("i"), F.explode(F.sequence(F.lit(0), 4 * blocks - 1)).alias("j"), "fp", F.lit(False).alias("visits"))
    p = probe.select("cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), mine("p", 4 * blocks).alias("j"), F.col("p").alias("fp"), F.lit(True).alias("visits"))

    def task(pdf):
        import numpy as np
        import pandas as pd

        x = pdf["fp"].to_numpy(np.int64)
        v = pdf["visits"].to_numpy(bool)
        a, b = np.flatnonzero(v), np.flatnonzero(~v)
        left, right = [], []
        for at in range(0, len(a), 512):
            part = a[at : at + 512]
            d = np.bitwise_count(x[part, None].view(np.uint64) ^ x[None, b].view(np.uint64))
            i, j = np.nonzero((d <= max_bits))
            left.append(part[i])
            right.append(b[j])
        if not left:
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        values, code = np.unique(x, return_inverse=True)
        root = forest(code[np.concatenate(left)], code[np.concatenate(right)], len(values))
        odd = root != np.arange(len(values))
        return pd.DataFrame({"u": values[odd], "v": values[root[odd]]})

    return h.unionByName(p).groupBy("cell", "i", "j").applyInPandas(task, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, shingle: int = 3) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most ``max_bits`` bits.

    Equal fingerprints are one node, so copies make no pairs; texts without a
    word share fingerprint 0. NULL ids are members but never name a component
    (a component of NULL ids alone has NULL). Repeated rows stay repeated.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle))
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")))
    found = components(links(nodes.select("fp"), max_bits))
    joined = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component"))
    named = joined.join(lows, "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
