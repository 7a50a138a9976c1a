"""Filter interaction audit: what every filter removes in every order, by relations of failing ids.

Each filter has a table of the ids that fail it. The removals of a filter
after any set of others are its ids, found by a left-semi join of the
documents, less those of the earlier filters by left-anti joins; the
survivors of a set are all documents by left-anti joins alone. One join
serves all sets: before it a row is copied, once for the sets without the
filter and once for those with it, and the join condition holds the set. So
k filters need k joins for the survivors and k for the removals of each
filter, all on one key, and only counts by part and set leave them. Any
order of the filters is a chain of such sets.

Joins are on a row key (id, hash of text and part), never on text. Equal
texts are found by their SHA-256.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossloom.llm.common import written

MAX_FILTERS = 6  # all orders are listed: 720 a part
KEY = ["r", "h"]
NO_ID = (1 << 63) - 1


def quality_filters(text: str = "text") -> dict[str, Column]:
    """Failure conditions on whole texts (NULL: empty); words are parted by the six characters of ``\\s``."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, r"\s+"), "")
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(t, F.lit("[A-Z]")).cast("long") * 100 > F.length(t).cast("long") * 3,
        "D": t.rlike(r"[#$%&*|]"),
    }


def documents(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], id_col: str = "doc_id", text_col: str = "text",
              part: Column | None = None) -> DataFrame:
    """One row per document row: its key, part, digest of the text, names of the filters it fails, and labels. The only step that reads texts.

    A document is good or toxic if a label row of its id says so.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    part = F.coalesce(F.col("lang"), F.lit("")) if part is None else part
    fails = F.filter(F.array(*[F.when(failed, F.lit(name)) for name, failed in filters.items()]), lambda x: x.isNotNull())
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("r"), F.xxhash64(raw, part, F.col(id_col).isNull()).alias("h"),
        F.col(id_col).isNull().alias("no_id"), part.alias("part"), F.unhex(F.sha2(raw, 256)).alias("digest"), fails.alias("fails"))
    rows = written(rows, "audit-documents")
    kinds = labels.groupBy(F.col("doc_id").cast("long").alias("r")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    named = rows.filter(~F.col("no_id")).join(kinds, "r", "left")
    none = rows.filter("no_id").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return named.unionByName(none).select(*KEY, "no_id", "part", "digest", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def later_copies(rows: DataFrame) -> DataFrame:
    """Keys of the rows whose text also has a smaller id. Rows without an id fail nothing here and are no one's original."""
    ids = rows.filter(~F.col("no_id"))
    first = ids.groupBy("digest").agg(F.min("r").alias("first"), F.max("r").alias("last")).filter(F.col("first") < F.col("last"))
    return ids.join(first, "digest").filter(F.col("r") > F.col("first")).select(*KEY)


def failing(rows: DataFrame, names: Sequence[str], copies: str | None) -> dict[str, DataFrame]:
    """A written table of failing keys for every filter; ``copies`` names the filter on equal texts."""
    listed = rows.select(*KEY, F.explode("fails").alias("filter"))
    if copies is not None:
        listed = listed.unionByName(later_copies(rows).withColumn("filter", F.lit(copies)))
    tables = written(listed, "audit-fails", "filter")
    return {name: tables.filter(F.col("filter") == name).select(*KEY) for name in names}


def _after(rows: DataFrame, fails: Mapping[str, DataFrame], bits: Mapping[str, int]) -> DataFrame:
    """``rows`` once for every set of the filters (``done``, as bits) that leaves them."""
    rows = rows.withColumn("done", F.lit(0))
    for name, table in fails.items():
        bit = bits[name]
        sets = rows.withColumn("done", F.explode(F.array(F.col("done"), F.col("done") + bit))).alias("s")
        gone = table.alias("f")
        same = (F.col("s.r") == F.col("f.r")) & (F.col("s.h") == F.col("f.h"))
        rows = sets.join(gone, same & (F.col("s.done") >= bit), "left_anti")  # bits come in rising order
    return rows


def interactions(rows: DataFrame, fails: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(part, done, kept) for every set of filters, and (part, filter, done, removed, good, toxic) for every filter after every set of others.

    Sets without a row are left out; ``done`` has a bit for each filter, in the order of ``fails``.
    """
    bits = {name: 1 << i for i, name in enumerate(fails)}
    rows = rows.select(*KEY, "part", "good", "toxic")
    kept = _after(rows, fails, bits).groupBy("part", "done").agg(F.count(F.lit(1)).alias("kept"))
    removed = []
    for name, table in fails.items():
        own = rows.join(table, KEY, "left_semi")
        left = _after(own, {k: v for k, v in fails.items() if k != name}, bits)
        removed.append(left.groupBy("part", "done").agg(
            F.count(F.lit(1)).alias("removed"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")).withColumn("filter", F.lit(name)))
    out = removed[0]
    for more in removed[1:]:
        out = out.unionByName(more)
    return kept, out


def report(parts: DataFrame, kept: DataFrame, removed: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row per part, order of the filters and step, zeros included."""
    k = len(names)
    bits = {name: 1 << i for i, name in enumerate(names)}
    steps = []
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(name).alias("filter"),
                                  F.lit(before).alias("before"), F.lit(before | bits[name]).alias("after")))
            before |= bits[name]
    weight = F.lit(0)
    for n in range(k):  # orders in which exactly these n filters come first
        weight = F.when(F.bit_count("done") == n, factorial(n) * factorial(k - 1 - n)).otherwise(weight)
    full = (1 << k) - 1
    alone = F.lit(full) - F.element_at(F.create_map(*[F.lit(x) for name in names for x in (name, bits[name])]), F.col("filter"))
    totals = removed.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("done") == 0, F.col("removed")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("done") == alone, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(weight * F.col("removed")).alias("shapley"))
    grid = parts.select("part", F.explode(F.array(*steps)).alias("s")).select("part", "s.*")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return (
        grid.join(kept.withColumnRenamed("done", "after"), ["part", "after"], "left")
        .join(removed.withColumnRenamed("done", "before"), ["part", "filter", "before"], "left")
        .join(totals, ["part", "filter"], "left")
        .select("part", "filter_order", "step", zero("kept").alias("kept"), zero("removed").alias("removed"),
                (zero("fails") - zero("removed")).alias("redundant"), zero("unique_fails").alias("unique_fails"),
                zero("good").alias("good_lost"), zero("toxic").alias("toxic_lost"), zero("shapley").alias("shapley"))
    )


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], copies: str | None = "E", **options) -> DataFrame:
    """The report of ``filters`` (name: failure condition on a row of ``docs``) and of the filter on copies, in all orders.

    Repeated rows are counted each. A NULL id has no labels and fails no
    copy filter; a condition that is NULL is no failure. Rows of a repeated
    id are told apart by text and part. Documents of no part and those of
    the empty one are one part. An empty table has no part and no row.
    """
    names = [*filters, *([copies] if copies else [])]
    if not names or len(names) > MAX_FILTERS or any(len(n) != 1 for n in names) or len(set(names)) < len(names):
        raise ValueError(f"one to {MAX_FILTERS} filters, each named by another letter")
    rows = written(documents(docs, labels, filters, **options), "audit-rows")
    kept, removed = interactions(rows, failing(rows, names, copies))
    kept, removed = written(kept, "audit-kept"), written(removed, "audit-removed")
    return report(rows.select("part").distinct(), kept, removed, names)


def query(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return audit(docs, labels, quality_filters())


SQL = r"""
WITH first AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
w AS (SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents d),
f AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * len(regexp_extract_all(w.t, '[A-Z]')) > 3 * length(w.t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
      FROM w JOIN first ON first.t = w.t LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
g AS (SELECT part, filter_order, step, filter_order[step] AS filter, fails, n, good, toxic,
        regexp_matches(fails, '[' || filter_order[1:step] || ']') AS gone, step > 1 AND regexp_matches(fails, '[' || filter_order[1:step - 1] || '!]') AS earlier,
        contains(fails, filter_order[step]) AS failed FROM c, s),
r AS (SELECT part, filter_order, step, filter, sum(CASE WHEN gone THEN 0 ELSE n END) AS kept, sum(CASE WHEN failed AND NOT earlier THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN failed AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN failed AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failed AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
      FROM g GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
