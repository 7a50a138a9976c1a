"""Repeated passages by prefix-partitioned suffix trees.

A passage is a window of ``window`` consecutive words; every word that lies in
a window whose words also start earlier is removed. Suffixes of the corpus are
dealt into groups by a prefix of theirs, and each group's subtree is built in
one task:

1. The prefix is the word gram with the smallest hash in a window, so it is
   fixed by the window's words alone and starts only about every seventh suffix.
   Prefixes that occur once in the corpus cannot head a repeat; their suffixes
   are left out before any text moves.
2. Consecutive windows that share their prefix are kept as one stretch of text.
   Equal stretches are one leaf with its earliest place, so a passage with
   very many copies is a single leaf.
3. A task sorts the suffixes of its groups, which gives their subtrees from
   left to right. Suffixes that agree to the depth of the window hang below
   one internal node: the earliest is kept, the others are repeats. Prefixes
   with too many leaves are prolonged to the full window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from crossloom.llm.common import discarded, raw_text, text_batches, written

WINDOW = 20
GRAM = 8
LEAVES = 20_000  # leaves of one prefix beyond which it is prolonged
TASK_WORDS = 1_000_000  # words of the subtrees that a task sorts at once
WORDS_AT_ONCE = 1 << 17  # words hashed at once


class _Hasher:
    """Word and gram hashes of a text in UTF-8. They only choose prefixes; texts are compared by their words."""

    def __init__(self, window, gram):
        import numpy as np

        r = np.random.default_rng(20)
        self.window, self.gram = window, gram
        self.byte = r.integers(0, 1 << 64, 256, np.uint64)
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.byte[self.blank] = 0
        self.power = r.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)

    def words(self, raw):
        """(starts, ends, hashes) of the words."""
        import numpy as np

        b = np.frombuffer(raw, np.uint8)
        edge = np.diff(np.concatenate([[0], (~self.blank[b]).view(np.int8), [0]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out = np.empty(len(start), np.uint64)
        for at in range(0, len(start), WORDS_AT_ONCE):
            s, hi = start[at : at + WORDS_AT_ONCE], end[min(at + WORDS_AT_ONCE, len(end)) - 1]
            lo = s[0]
            inside = np.arange(hi - lo) - np.repeat(s - lo, np.diff(np.append(s, hi)))
            out[at : at + WORDS_AT_ONCE] = np.add.reduceat(self.byte[b[lo:hi]] * self.power[inside & 63], s - lo)
        return start, end, out

    def anchors(self, x):
        """From word hashes: the hash of every word gram, and for each window the place of its smallest one (the first, if equal)."""
        import numpy as np

        n = len(x) - self.gram + 1
        h = np.zeros(n, np.uint64)
        for j in range(self.gram):
            h = (h ^ x[j : n + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        low, at, wide, have = h, np.arange(n), self.window - self.gram + 1, 1
        while have < wide:  # minima over twice as many grams, until a window's are covered
            by = min(have, wide - have)
            less = low[by:] < low[:-by]
            low, at, have = np.where(less, low[by:], low[:-by]), np.where(less, at[by:], at[:-by]), have + by
        return h, at


def _prefixes(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(g, d, n): prefixes of each document and how often they start there."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        hasher = _Hasher(window, gram)
        for b in text_batches(batches):
            gs, ds, ns = [], [], []
            for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = hasher.words(raw)[2]
                if len(x) < window:
                    continue
                h, at = hasher.anchors(x)
                g, n = np.unique(h[at[np.concatenate([[True], at[1:] != at[:-1]])]], return_counts=True)
                gs.append(g)
                ns.append(np.minimum(n, 2))
                ds.append(np.full(len(g), d, np.int64))
            if gs:
                cols = np.concatenate(gs).view(np.int64), np.concatenate(ds), np.concatenate(ns).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["g", "d", "n"])

    return docs.select("d", "_raw").mapInArrow(task, "g bigint, d bigint, n tinyint")


def _stretches(flagged: DataFrame, window: int, gram: int) -> DataFrame:
    """Stretches of windows that share a repeated prefix; the text only of the first equal one in a document."""

    def task(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        hasher = _Hasher(window, gram)
        for b in text_batches(batches, 64):
            numbers, hs, bodies = [], [], []
            for k, d, raw, gs in zip(*(b.column(i).to_pylist() for i in range(4))):
                start, end, x = hasher.words(raw)
                h, at = hasher.anchors(x)
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                n = np.diff(np.append(first, len(at)))
                g = h[at[first]].view(np.int64)
                own = np.isin(g, np.array(gs, np.int64))
                g, first, n = g[own], first[own], n[own]
                numbers.append(np.stack([g, np.full(len(g), k), np.full(len(g), d), first, n]))
                seen = set()
                for i, j in zip(start[first].tolist(), end[first + n + window - 2].tolist()):
                    text = b" ".join(raw[i:j].split())
                    x = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                    hs.append(x)
                    bodies.append(None if x in seen else text)
                    seen.add(x)
            if hs:
                g, k, d, at, n = np.concatenate(numbers, axis=1)
                cols = [pa.array(g), pa.array(hs, pa.int64()), pa.array(k), pa.array(d), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["g", "h", "k", "d", "at", "n", "body"])

    return flagged.select("k", "d", "_raw", "gs").mapInArrow(task, "g bigint, h bigint, k bigint, d bigint, at int, n int, body binary")


def _subtree(leaves, window):
    """For each leaf (k, d, at, n, body): [from, to, ...] of the places whose window has an earlier equal one.

    The suffixes are sorted by their words to the depth of the window, which
    lists the subtree's leaves from left to right; neighbours that agree to
    that depth hang below one deep node, whose earliest suffix stays.
    """
    suffixes, places = [], []
    for i, (k, d, at, n, body) in enumerate(leaves):
        ends = [0]
        for word in body.split(b" "):
            ends.append(ends[-1] + len(word) + 1)
        suffixes += [body[ends[j] : ends[j + window] - 1] for j in range(n)]
        places += [(k, d, at + j, i) for j in range(n)]
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    out: list[list[int]] = [[] for _ in leaves]
    later, at = [], 0
    while at < len(order):
        end = at + 1
        while end < len(order) and suffixes[order[end]] == suffixes[order[at]]:
            end += 1
        if end > at + 1:
            later += sorted(places[x] for x in order[at:end])[1:]
        at = end
    for _, _, place, i in sorted(later):
        own = out[i]
        if own and own[-1] == place - 1:
            own[-1] = place
        else:
            own += [place, place]
    return out


def _subtrees(leaves: DataFrame, window: int) -> DataFrame:
    """(g, h, k, d, at, ranges) of all leaves, each prefix ranked within one task."""

    def task(batches):
        import pyarrow as pa

        def done(rows):
            ranges = _subtree([r[2:] for r in rows], window)
            cols = list(zip(*[(*r[:5], x) for r, x in zip(rows, ranges)]))
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["g", "h", "k", "d", "at", "ranges"])

        rows, size = [], 0
        for b in text_batches(batches, 4096):
            for row in zip(*(b.column(i).to_pylist() for i in range(7))):
                if size > TASK_WORDS and row[0] != rows[-1][0]:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(row)
                size += row[5] + window - 1
        if rows:
            yield done(rows)

    # by an expression of the prefix: a plain repartition is dropped behind a join on the prefix, which may then leave it in several tasks
    dealt = leaves.select("g", "h", "k", "d", "at", "n", "body").repartition(F.xxhash64("g")).sortWithinPartitions("g")
    return dealt.mapInArrow(task, "g bigint, h bigint, k bigint, d bigint, at int, ranges array<int>")


def _prolonged(leaves: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(table of the suffixes, the same for prefixes with too many leaves): each suffix is grouped by all words of its window."""

    def task(batches):
        import pyarrow as pa

        for b in text_batches(batches, 1024):
            rows = []
            for g, h, k, d, at, n, body in zip(*(b.column(i).to_pylist() for i in range(7))):
                words = body.split()
                rows += [(g, h, k, d, at, at + i, b" ".join(words[i : i + window])) for i in range(n)]
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["g", "h", "k", "d", "at", "place", "words"])

    suffixes = leaves.select("g", "h", "k", "d", "at", "n", "body").mapInArrow(task, "g bigint, h bigint, k bigint, d bigint, at int, place int, words binary")
    suffixes = written(suffixes, "suffixes")
    first = suffixes.groupBy("words").agg(F.min(F.struct("k", "d", "place")).alias("first"))
    later = suffixes.join(first, "words").select("g", "h", "place", (F.struct("k", "d", "place") != F.col("first")).alias("later"))
    ranges = later.groupBy("g", "h").agg(F.sort_array(F.collect_list(F.when(F.col("later"), F.col("place")))).alias("p"))
    ranges = ranges.select("g", "h", F.flatten(F.transform("p", lambda x: F.array(x, x))).alias("ranges"))
    return suffixes, leaves.select("g", "h", "k", "d", "at").join(ranges, ["g", "h"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
            leaves_per_prefix: int = LEAVES) -> tuple[DataFrame, DataFrame]:
    """(texts with a repeated prefix: k, d, _raw; removals: k, d, ranges of window starts), both tables in the shared folder.

    ``k`` is the id (NULL ids come last), ``d`` a hash of id and text: rows
    that share an id but not the text are ordered by it, equal rows are one.
    Tables of the steps between are deleted.
    """
    if window < gram:
        raise ValueError("the window is shorter than the gram")
    rows = keyed(docs, id_col, text_col)
    prefixes = written(_prefixes(rows, window, gram), "prefixes")
    known = prefixes.groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") > 1).select("g")
    wanted = prefixes.select("g", "d").join(known, "g").groupBy("d").agg(F.collect_set("g").alias("gs"))
    flagged = written(rows.join(wanted, "d").select("k", "d", "_raw", "gs"), "flagged")
    discarded(prefixes)
    places = written(_stretches(flagged, window, gram), "stretches")
    leaves = places.filter(F.col("body").isNotNull()).groupBy("g", "h", "body").agg(F.min(F.struct("k", "d", "at")).alias("p"), F.max("n").alias("n"))
    leaves = written(leaves.select("g", "h", "p.k", "p.d", "p.at", "n", "body"), "leaves")
    crowded = leaves.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > leaves_per_prefix).select("g")
    crowded = written(crowded, "crowded")
    own = [places, leaves, crowded]
    if crowded.isEmpty():
        found = _subtrees(leaves, window)
    else:
        suffixes, prolonged = _prolonged(leaves.join(crowded, "g", "left_semi"), window)
        found = _subtrees(leaves.join(crowded, "g", "left_anti"), window).unionByName(prolonged)
        own.append(suffixes)
    found = found.select("g", "h", F.struct("k", "d", "at").alias("p"), "ranges")
    removed = places.join(found, ["g", "h"]).select(
        "k", "d", F.when(F.struct("k", "d", "at") == F.col("p"), F.col("ranges")).otherwise(F.array("at", F.col("at") + F.col("n") - 1)).alias("r")
    )
    removed = written(removed.filter(F.size("r") > 0).groupBy("k", "d").agg(F.flatten(F.collect_list("r")).alias("ranges")), "removed")
    discarded(*own)
    return flagged, removed


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, d, _raw) of the rows."""
    k = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    return raw_text(docs, k.alias("k"), text=text_col).select("k", F.xxhash64("k", "_raw").alias("d"), "_raw")


def _kept(raw: bytes, ranges, window: int) -> tuple[int, bytes]:
    """How many words lie in the windows that start in the ranges, and the other words joined by one space."""
    import numpy as np

    words = raw.split()
    edge = np.zeros(len(words) + 1, np.int64)
    r = np.array(ranges).reshape(-1, 2)
    np.add.at(edge, r[:, 0], 1)
    np.add.at(edge, r[:, 1] + window, -1)
    keep = np.cumsum(edge)[:-1] == 0
    return int((~keep).sum()), b" ".join([words[i] for i in np.flatnonzero(keep)])


def cuts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """(k, d, n_removed, kept) of the texts that lose words; kept has the rest, joined by one space, as bytes."""
    flagged, removed = repeats(docs, id_col, text_col, window, **options)

    def task(batches):
        import pyarrow as pa

        for b in text_batches(batches):
            rows = [(k, d, *_kept(raw, ranges, window)) for k, d, raw, ranges in zip(*(b.column(i).to_pylist() for i in range(4)))]
            if rows:
                kinds = [pa.int64()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["k", "d", "n_removed", "kept"])

    texts = flagged.select("k", "d", "_raw").dropDuplicates(["k", "d"]).join(removed, ["k", "d"])
    return texts.mapInArrow(task, "k bigint, d bigint, n_removed bigint, kept binary")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """The rows of ``docs`` with a column ``kept``: what is left of the text as bytes, words joined by one space; NULL if it loses nothing.

    The places of the removals are brought to the rows, so that a row moves once and no copy of its text is joined to it.
    """
    flagged, removed = repeats(docs, id_col, text_col, window, **options)
    discarded(flagged)

    def task(batches):
        import pyarrow as pa

        for b in text_batches(batches):
            kept = [None if ranges is None else _kept(raw, ranges, window)[1] for raw, ranges in zip(*(b.column(i).to_pylist() for i in (1, 2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], ["row", "kept"])

    row = docs.select(F.struct(*docs.columns).alias("row"))
    raw = F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).cast("binary")
    rows = row.withColumn("k", F.coalesce(F.col("row")[id_col].cast("long"), F.lit((1 << 63) - 1))).withColumn("d", F.xxhash64("k", raw))
    rows = rows.join(removed, ["k", "d"], "left").select("row", F.when(F.col("ranges").isNotNull(), raw).alias("raw"), "ranges")
    return rows.mapInArrow(task, StructType([*row.schema.fields, StructField("kept", BinaryType())])).select("row.*", "kept")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row of ``docs``.

    NULL and empty texts have no words; texts shorter than the window lose
    none. Repeated rows (same id and text) are judged as one document and
    stay repeated.
    """

    def task(batches):
        import hashlib

        import pyarrow as pa

        for b in text_batches(batches):
            words = [x.split() for x in b.column(3).to_pylist()]
            whole = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            cols = [*(b.column(i) for i in range(3)), pa.array([len(w) for w in words], pa.int64()), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "k", "d", "n_words", "whole"])

    k = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    rows = raw_text(docs, F.col(id_col).alias("id"), k.alias("k"), text=text_col)
    rows = rows.select("id", "k", F.xxhash64("k", "_raw").alias("d"), "_raw")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = rows.mapInArrow(task, f"id {kind}, k bigint, d bigint, n_words bigint, whole string")
    lost = cuts(docs, id_col, text_col, **options).select("k", "d", "n_removed", F.sha2("kept", 256).alias("rest"))
    return rows.join(lost, ["k", "d"], "left").select(
        "id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("rest", "whole").alias("kept_sha256")
    )


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS place FROM k),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM f, (SELECT unnest(range(20)) AS j) WHERE place > 1),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_where(w, list_transform(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p))) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
