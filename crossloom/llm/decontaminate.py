"""Benchmark decontamination: word windows of test items looked up in every document.

Texts are lower-cased (A-Z only) and cut into words of ASCII letters, digits
and non-ASCII characters. An item gives its windows of ``window`` words, a
shorter item itself. The distinct windows are numbered by the words of the
benchmark, hashed, and broadcast as sorted hashes with their words; a task
slides over the numbers of its documents, looks the hashes up and verifies
every hit word by word. Documents never move.

The broadcast is bounded: beyond ``max_bytes`` of windows the same hits come
from a join of the windows of both sides, which costs a shuffle of all
document windows but has no limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.llm.common import raw_text, text_batches, written

WINDOW = 10
MAX_BYTES = 64 << 20  # words of the distinct windows and names of their items that may be broadcast
BATCH_WORDS = 1 << 17
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b in SEPARATORS else b for b in range(256))
SPANS = "array<struct<start:bigint,length:bigint>>"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(PLAIN).split()


def item_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(words, item): distinct windows of each item, words joined by one space. Items without a word have none."""

    def task(batches):
        import pyarrow as pa

        for b in text_batches(batches):
            items, found = [], []
            for item, raw in zip(*(b.column(i).to_pylist() for i in range(2))):
                words = words_of(raw)
                own = {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else ()
                items += [item] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(items, pa.string())], ["words", "item"])

    rows = raw_text(bench, F.col(id_col).cast("string").alias("item"), text=text_col)
    return rows.mapInArrow(task, "words binary, item string").distinct()


class Index:
    """Windows by length: sorted hashes, their words as numbers, and the items they occur in."""

    def __init__(self, pairs):
        import numpy as np

        self.names = sorted({item for _, item in pairs if item is not None})  # numbered in the order of their strings
        number = {name: i for i, name in enumerate(self.names)}
        items: dict = {}
        for words, item in pairs:
            items.setdefault(words, []).append(number.get(item, -1))
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in items for w in x.split()}))}
        sizes: dict = {}
        for x in items:
            sizes.setdefault(x.count(b" ") + 1, []).append(x)
        self.parts = []
        for size, found in sorted(sizes.items()):
            rows = np.array([[self.vocabulary[w] for w in x.split()] for x in found], np.int64)
            for seed in range(1, 1000):  # a seed that gives every window its own hash
                h = self.hashes(rows.T, seed)
                order = np.argsort(h)
                if (np.diff(h[order]) > 0).all():
                    break
            else:
                raise RuntimeError("no seed separates the windows")
            owners = [sorted(items[found[i]]) for i in order]
            ends = np.cumsum([len(o) for o in owners])
            self.parts.append((size, seed, h[order], rows[order], np.array([i for o in owners for i in o]), ends))

    @staticmethod
    def hashes(columns, seed):
        import numpy as np

        h = np.full(len(columns[0]), seed, np.uint64)
        for c in columns:
            h = (h ^ (c.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def hits(self, ids):
        """(start, length, part, window) of every occurrence in ``ids``, where -1 is no word of the benchmark."""
        import numpy as np

        edge = np.where(ids < 0, np.arange(len(ids)), len(ids))
        known = np.minimum.accumulate(edge[::-1])[::-1] - np.arange(len(ids))  # known words from here on
        out = []
        for part, (size, seed, hashes, rows, _, _) in enumerate(self.parts):
            at = np.flatnonzero(known >= size)
            h = self.hashes([ids[at + j] for j in range(size)], seed) if len(at) else np.empty(0, np.uint64)
            slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[slot] == h
            at, slot = at[same], slot[same]
            equal = (ids[at[:, None] + np.arange(size)] == rows[slot]).all(axis=1)
            at, slot = at[equal], slot[equal]
            out.append((at, np.full(len(at), size), np.full(len(at), part), slot))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4

    def items_of(self, part, slots):
        """Numbers of the items of some windows of a part, each once."""
        import numpy as np

        owners, ends = self.parts[part][4:]
        found = [owners[(ends[s - 1] if s else 0) : ends[s]] for s in slots.tolist()]
        return np.unique(np.concatenate(found))


def _ranges(covered):
    """(start, length) of the stretches where ``covered`` is positive."""
    import numpy as np

    edge = np.diff(np.concatenate([[0], (covered > 0).astype(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def _scan(rows: DataFrame, index, with_text: bool) -> DataFrame:
    """``rows`` (id, _raw) with n_words, spans and items from a broadcast index."""
    kind = rows.schema["id"].dataType.simpleString()
    kept = ["id", "_raw"] if with_text else ["id"]

    def task(batches):
        from itertools import repeat

        import numpy as np
        import pyarrow as pa

        own = Index.__new__(Index)
        own.__dict__.update(index.value)
        number = own.vocabulary.get
        span = pa.struct([("start", pa.int64()), ("length", pa.int64())])

        def done(ids, sizes, codes):
            x = np.concatenate([*codes, [-1]])
            size = np.array(sizes)
            begin = np.cumsum(size + 1) - size - 1  # behind every text stands a -1
            at, length, part, slot = own.hits(x)
            covered = np.zeros(len(x) + 1, np.int64)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + length, -1)
            start, long_ = _ranges(np.cumsum(covered)[:-1])
            spans, items = [[] for _ in sizes], [set() for _ in sizes]
            text = np.searchsorted(begin, start, "right") - 1
            for t, a, n in zip(text.tolist(), (start - begin[text]).tolist(), long_.tolist()):
                spans[t].append({"start": a, "length": n})
            for p in np.unique(part).tolist():
                mine = part == p
                pairs = np.unique(np.stack([np.searchsorted(begin, at[mine], "right") - 1, slot[mine]]), axis=1)
                for t in np.unique(pairs[0]).tolist():
                    items[t].update(own.items_of(p, pairs[1][pairs[0] == t]).tolist())
            names = [[own.names[i] for i in sorted(s) if i >= 0] for s in items]
            cols = [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(names, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([*(pa.concat_arrays(c) for c in zip(*ids)), *cols], [*kept, "n_words", "spans", "items"])

        ids, sizes, codes, n = [], [], [], 0
        for b in text_batches(batches, 32):
            ids.append([b.column(i) for i in range(len(kept))])
            for raw in b.column(1).to_pylist():
                words = words_of(raw)
                sizes.append(len(words))
                codes += [np.fromiter(map(number, words, repeat(-1)), np.int64, len(words)), [-1]]
                n += len(words)
            if n >= BATCH_WORDS:
                yield done(ids, sizes, codes)
                ids, sizes, codes, n = [], [], [], 0
        if ids:
            yield done(ids, sizes, codes)

    return rows.mapInArrow(task, f"id {kind}, {'_raw binary, ' if with_text else ''}n_words bigint, spans {SPANS}, items array<string>")


def _joined(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """The same from a join of the windows of both sides."""
    sizes = sorted(r.n for r in windows.select((F.size(F.split(F.col("words").cast("string"), " "))).alias("n")).distinct().collect())  # at most `window` numbers
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa

        for b in text_batches(batches, 16):
            for d, raw in zip(*(b.column(i).to_pylist() for i in range(2))):
                words = words_of(raw)
                own = [(i, n) for n in sizes for i in range(len(words) - n + 1)]
                for at in range(0, len(own), 1 << 16):
                    some = own[at : at + (1 << 16)]
                    cols = [pa.array([d] * len(some), pa.int64()), pa.array([i for i, _ in some], pa.int64()), pa.array([n for _, n in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([b" ".join(words[i : i + n]) for i, n in some], pa.binary())], ["d", "start", "length", "words"])

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        for b in text_batches(batches):
            sizes, spans = [], []
            for raw, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                n = len(words_of(raw))
                covered = np.zeros(n + 1, np.int64)
                for hit in hits or ():
                    covered[hit["start"]] += 1
                    covered[hit["start"] + hit["length"]] -= 1
                sizes.append(n)
                spans.append([{"start": s, "length": k} for s, k in zip(*(c.tolist() for c in _ranges(np.cumsum(covered)[:-1])))])
            span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
            cols = [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), b.column(3)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "_raw", "n_words", "spans", "items"])

    keyed = rows.withColumn("d", F.xxhash64("_raw"))  # equal texts have equal hits; a document's hits are bounded by its words
    places = keyed.select("d", "_raw").dropDuplicates(["d"]).mapInArrow(cut, "d bigint, start bigint, length bigint, words binary")
    hits = written(places.join(windows, "words").select("d", "start", "length", "item"), "window-hits")
    spans = hits.groupBy("d").agg(F.collect_set(F.struct("start", "length")).alias("hits"), F.sort_array(F.collect_set("item")).alias("items"))
    full = keyed.join(spans, "d", "left").select("id", "_raw", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return full.mapInArrow(merge, f"id {kind}, _raw binary, n_words bigint, spans {SPANS}, items array<string>")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES, with_text: bool = False) -> DataFrame:
    """(id, n_words, spans, items) per document row, on request with its text as bytes (_raw): stretches of hit words (counted from 0), and the items hit, sorted as strings.

    NULL and empty texts have no words and no hit; so have items without a
    word. An item without an id is searched for but not listed; texts under
    one item id are one item. Repeated rows are judged each for itself; other
    columns are left behind. An empty benchmark hits nothing.
    """
    windows = written(item_windows(bench, item_col, item_text, window), "item-windows")
    rows = raw_text(docs, F.col(id_col).alias("id"), text=text_col)
    size = windows.agg(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
    if size > max_bytes:
        found = _joined(rows, windows)
        return found if with_text else found.drop("_raw")
    index = Index([(bytes(r.words), r.item) for r in windows.collect()])  # of measured size
    return _scan(rows, docs.sparkSession.sparkContext.broadcast(vars(index)), with_text)


def cleaned(docs: DataFrame, bench: DataFrame, remove: str = "spans", max_hit: int = 0, **options) -> DataFrame:
    """(id, text) without the hit words (``spans``), or without documents of more than ``max_hit`` hit words (``documents``).

    What lies between two hit words of a stretch goes with them; all other
    characters stay as they are.
    """
    found = contamination(docs, bench, with_text=True, **options)
    if remove == "documents":
        total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
        return found.filter(total <= max_hit).select("id", F.col("_raw").cast("string").alias("text"))
    if remove != "spans":
        raise ValueError(f"remove spans or documents, not {remove}")

    def task(batches):
        import re

        import pyarrow as pa

        for b in text_batches(batches):
            out = []
            for raw, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if spans:
                    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(PLAIN))]
                    left, at = [], 0
                    for s in spans:
                        left.append(raw[at : places[s["start"]][0]])
                        at = places[s["start"] + s["length"] - 1][1]
                    raw = b"".join([*left, raw[at:]])
                out.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "text"])

    kind = found.schema["id"].dataType.simpleString()
    return found.select("id", "_raw", "spans").mapInArrow(task, f"id {kind}, text binary").select("id", F.col("text").cast("string").alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query from the rows of ``contamination``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def query(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return digests(contamination(docs, bench))


SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents, low),
i AS (SELECT item_id, regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, low WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS words
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS words
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw USING (words)),
cover AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN item USING (doc_id)
"""
