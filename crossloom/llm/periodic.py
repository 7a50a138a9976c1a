"""Periodic runs of words by an enhanced suffix array, and texts without the repeats in them.

A run is a stretch of words with smallest period q, long enough, that no
neighbouring word extends. Texts are grouped into batches; words are numbered
per text, so that no suffix agrees with one of another text.

1. Prefix doubling sorts the suffixes. The ranks of every round stay: two
   places have equal ranks in round l when their next 2^l words are equal.
   The longest common prefixes of neighbours follow from them.
2. Every place r of the LCP array parts its interval of depth D into the
   suffixes on both sides. Those of the smaller side are tested: i and i + D
   (or i - D) on different sides are a branching square, whose two halves are
   equal and which the next word ends. The intervals are ranges of the
   array; no tree is built.
3. A square is rotated to the left as long as it stays one, by 2^l places at
   a time. That is the whole run; squares of a multiple of its period cover
   the same words and are merged into it.

The smaller sides add up to n log n suffixes at most. A task holds one batch:
about 4 * (8 + log2 of the longest repeat) bytes a word, for a text longer
than ``BATCH_WORDS`` in proportion to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossloom.llm.common import raw_text, text_batches

MIN_LENGTH = 6
MIN_EXPONENT = 4
BATCH_WORDS = 1 << 18  # words whose suffixes are sorted together
TESTS_AT_ONCE = 1 << 21


def _suffixes(x):
    """(suffixes in order, ranks by 2^l words for l = 0, 1, …); a rank list ends with -1 for the place behind the last word."""
    import numpy as np

    n = len(x)
    order = np.argsort(x, kind="stable")
    key = x[order]
    slots, levels, rank, width = np.arange(n), [], np.full(n + 1, -1, np.int64), 0
    while True:
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[order[slots]] = np.maximum.accumulate(np.where(head, slots, 0))
        levels.append(rank)
        slots = slots[~(head & np.append(head[1:], True))]  # suffixes that still share their rank
        if not len(slots):
            return order, levels
        width = 2 * width or 1
        s = order[slots]
        key = rank[s] * (n + 1) + rank[np.minimum(s + width, n)] + 1
        by = np.argsort(key, kind="stable")
        order[slots], key = s[by], key[by]


def _common(order, levels):
    """Number of equal leading words of neighbours in the suffix order."""
    import numpy as np

    a, b = order[:-1].copy(), order[1:].copy()
    size = np.zeros(len(a), np.int64)
    for l in reversed(range(len(levels))):
        step = (levels[l][a] == levels[l][b]) * (1 << l)
        a += step
        b += step
        size += step
    return size


def _sides(lcp):
    """For every place r of ``lcp``: first slot of the left side and last slot of the right side of its interval."""
    import numpy as np

    e = np.concatenate([[-1], lcp, [-1]])
    before, after = np.arange(len(e)) - 1, np.arange(len(e)) + 1
    inner = np.flatnonzero(e > 0)
    open_ = inner[e[before[inner]] >= e[inner]]
    while len(open_):
        before[open_] = before[before[open_]]
        open_ = open_[e[before[open_]] >= e[open_]]
    open_ = inner[e[after[inner]] > e[inner]]
    while len(open_):
        after[open_] = after[after[open_]]
        open_ = open_[e[after[open_]] > e[open_]]
    return before[1:-1], after[1:-1] - 1


def _squares(order, isa, lcp, at, lo, hi):
    """(start, half) of the branching squares of the intervals parted at the places ``at``."""
    import numpy as np

    n = len(order)
    left = at - lo + 1 <= hi - at
    first, size = np.where(left, lo, at + 1), np.minimum(at - lo + 1, hi - at)
    other_lo, other_hi = np.where(left, at + 1, lo), np.where(left, hi, at)
    starts, halves = [], []
    ends = np.cumsum(size)
    cut = 0
    while cut < len(at):
        upto = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + TESTS_AT_ONCE, "right")))
        part = size[cut:upto]
        own = np.repeat(np.arange(cut, upto), part)
        i = order[first[own] + np.arange(len(own)) - np.repeat(np.cumsum(part) - part, part)]
        d = lcp[at[own]]
        for start, mate in ((i, np.minimum(i + d, n)), (i - d, np.where(i >= d, i - d, n))):
            slot = isa[mate]
            hit = (slot >= other_lo[own]) & (slot <= other_hi[own])
            starts.append(start[hit])
            halves.append(d[hit])
        cut = upto
    return (np.concatenate(starts), np.concatenate(halves)) if starts else (np.empty(0, np.int64),) * 2


def word_runs(texts, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT):
    """For each list of words its runs (start, length, period), sorted."""
    from itertools import count

    import numpy as np

    codes, base, sizes = [], 0, []
    for words in texts:
        sizes.append(len(words) if len(words) >= min_length else 0)
        if sizes[-1]:
            number = dict(zip(dict.fromkeys(words), count(base)))
            codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            base += len(number)
    out = [[] for _ in texts]
    if not codes:
        return out
    size, x = np.array(sizes), np.concatenate(codes)
    order, levels = _suffixes(x)
    lcp = _common(order, levels)
    lo, hi = _sides(lcp)
    whole = np.repeat(size, size)[order[:-1]]
    at = np.flatnonzero((lcp > 0) & (min_exponent * lcp <= whole))
    s, d = _squares(order, levels[-1], lcp, at, lo[at], hi[at])
    start = s.copy()
    for l in reversed(range(len(levels))):
        to = start - (1 << l)
        place = np.maximum(to, 0)
        start = np.where((to >= 0) & (levels[l][place] == levels[l][place + d]), to, start)
    end = s + 2 * d
    by = np.lexsort((d, end, start))
    start, end, d = start[by], end[by], d[by]
    if len(by):
        new = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
        start, end, d = start[new], end[new], d[new]
    long_ = end - start >= np.maximum(min_length, min_exponent * d)
    start, end, d = start[long_], end[long_], d[long_]
    begin = np.cumsum(size) - size
    text = np.searchsorted(begin, start, "right") - 1
    for t, a, b, q in zip(text.tolist(), (start - begin[text]).tolist(), (end - begin[text]).tolist(), d.tolist()):
        out[t].append((a, b - a, q))
    return [sorted(r) if len(r) > 1 else r for r in out]


def _kept(words, runs):
    """The words that are in no run behind its first period."""
    out, at = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        if a > at:
            out += words[at:a]
        at = max(at, b)
    return out + words[at:]


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT, batch_words: int = BATCH_WORDS) -> DataFrame:
    """(id, n_words, runs, kept) per row: runs as (start, length, period) sorted, kept with the remaining words as bytes, joined by one space.

    Words are counted from 0. NULL and empty texts have no words and no run.
    Every row stands for itself, so repeated rows and repeated or missing ids
    change nothing; other columns are left behind. Equal exponents, nested
    and overlapping runs are all listed.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("a run holds its period twice at least")
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches):
        import pyarrow as pa

        row = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

        def done(ids, texts):
            found = word_runs(texts, min_length, min_exponent)
            runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found], pa.list_(row))
            kept = pa.array([b" ".join(_kept(w, rs)) for w, rs in zip(texts, found)], pa.binary())
            cols = [pa.concat_arrays(ids), pa.array([len(w) for w in texts], pa.int64()), runs, kept]
            return pa.RecordBatch.from_arrays(cols, ["id", "n_words", "runs", "kept"])

        ids, texts, n = [], [], 0
        for b in text_batches(batches, 32):
            ids.append(b.column(0))
            texts += [t.split() for t in b.column(1).to_pylist()]
            n = sum(map(len, texts[-b.num_rows :])) + n
            if n >= batch_words:
                yield done(ids, texts)
                ids, texts, n = [], [], 0
        if texts:
            yield done(ids, texts)

    rows = raw_text(docs, F.col(id_col).alias("id"), text=text_col)
    return rows.mapInArrow(task, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept binary")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first by start, then period. NULL if there is none."""

    def order(a, b):
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        place = F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
        return F.signum(F.when(x != y, y - x).otherwise(place)).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text); in one document of ten the words from a place on are a repetition of the first of them.

    Split into steps, so that neither the words nor the places are computed again for every word.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "")  # \s has the six characters that part words
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.pmod("h", F.lit(10)) == 0, words))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n")))
    rows = rows.withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.pmod("g", F.lit(8)) + 3)) + 1)
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))
    repeated = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query from the rows of ``collapsed``."""
    best = found.withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return best.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(collapsed(planted(docs)))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, doc_id::VARCHAR AS s FROM documents),
bits AS (SELECT range::INT AS b FROM range(8)),
bytes AS (SELECT range::INT AS v, list_reduce(list_prepend(range, [x::BIGINT FOR x IN range(8)]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256)),
crc AS (SELECT list(c ORDER BY v) AS tab FROM bytes),
h AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(s, '')]), lambda c, x: xor(c // 256, tab[1 + xor(c % 256, x) % 256])), 4294967295) AS h FROM t, crc),
g AS (SELECT *, h // 10 AS g FROM h),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g),
p AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))] ELSE w[1 + i] END) ELSE w END AS w FROM a),
x AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM p),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
      FROM x JOIN x AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i),
r AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY ALL),
s AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY doc_id),
b AS (SELECT DISTINCT ON (doc_id) doc_id, start, length, period FROM (SELECT *, 1000000000000 * length // period AS e FROM u) ORDER BY doc_id, e DESC, start, period),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM u),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN s USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""
