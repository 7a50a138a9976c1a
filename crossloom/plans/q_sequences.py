"""Sequences, splits, order-dependent columns, id mapping and catalogue joins."""

from pyspark.sql import functions as F

from crossloom.functions import text as T
from crossloom.operators import catalogue as K
from crossloom.operators import chunks as H
from crossloom.operators import sequences as S
from crossloom.operators.ordering import dense_index
from crossloom.plans.registry import query


def ids(seq):
    return F.concat_ws(",", F.transform(seq, lambda e: e["item_id"].cast("string")))


@query("user_sequences", "A1 P1 W1 D2", """
SELECT user_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY ts, event_id) AS items,
  CAST(sum(CASE WHEN domain = 'X' THEN 1 ELSE 0 END) AS BIGINT) AS n_x
FROM ranked WHERE back <= 15 GROUP BY user_id HAVING count(*) >= 3""")
def _(t):
    seq = F.col("seq")
    return S.user_sequences(t.ev).select(
        "user_id", F.size(seq).cast("long").alias("n"), ids(seq).alias("items"),
        F.size(F.filter(seq, lambda e: e["domain"] == "X")).cast("long").alias("n_x"))


@query("user_sequences_by_day", "A1 P1", """
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY ts, event_id) AS items
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM ev_daily) WHERE b <= 15
GROUP BY user_id HAVING count(*) >= 3""")
def _(t):
    return S.user_sequences(t.ev_daily).select("user_id", ids(F.col("seq")).alias("items"))


@query("min_activity", "P1", """
SELECT event_id FROM ev WHERE (user_id, item_id) IN (SELECT (user_id, item_id) FROM ev GROUP BY user_id, item_id HAVING count(*) >= 3)""")
def _(t):
    return S.min_activity(t.ev, keys=("user_id", "item_id")).select("event_id")


@query("recent_events", "W1 F12 W9", """
SELECT user_id, event_id, item_id, back FROM ranked WHERE back <= 10""")
def _(t):
    return S.recent_events(t.ev, 10).select("user_id", "event_id", "item_id", F.col("back").cast("long").alias("back"))


_SEQ = """@ s AS (SELECT user_id, list(item_id ORDER BY ts, event_id) AS seq FROM ranked WHERE back <= 15 GROUP BY user_id HAVING count(*) >= 3),
loo AS (SELECT 'train' AS split, user_id, seq[1:len(seq)-2] AS seq, CAST(NULL AS INT) AS tgt FROM s
 UNION ALL SELECT 'valid', user_id, seq[1:len(seq)-2], seq[len(seq)-1] FROM s
 UNION ALL SELECT 'test', user_id, seq[1:len(seq)-1], seq[len(seq)] FROM s) @
"""


@query("leave_one_out", "P7 D6", _SEQ + """
SELECT split, user_id, array_to_string(seq, ',') AS items, tgt AS target_item FROM loo""")
def _(t):
    return S.leave_one_out(S.user_sequences(t.ev)).select(
        "split", "user_id", ids(F.col("seq")).alias("items"), F.col("target.item_id").alias("target_item"))


@query("leave_one_out_presplit", "P8", _SEQ + """
SELECT sp AS split, user_id, array_to_string(CASE WHEN sp = 'test' THEN seq[1:len(seq)-1] ELSE seq[1:len(seq)-2] END, ',') AS items,
 CASE sp WHEN 'test' THEN seq[len(seq)] WHEN 'valid' THEN seq[len(seq)-1] END AS target_item
FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS sp FROM s)""")
def _(t):
    split = F.when(F.col("user_id") % 3 == 0, "train").when(F.col("user_id") % 3 == 1, "valid").otherwise("test")
    return S.leave_one_out_presplit(S.user_sequences(t.ev).withColumn("split", split)).select(
        "split", "user_id", ids(F.col("seq")).alias("items"), F.col("target.item_id").alias("target_item"))


@query("implicit_target", "P9", _SEQ + """
SELECT split, user_id, array_to_string(CASE WHEN tgt IS NULL THEN seq[1:len(seq)-1] ELSE seq END, ',') AS items,
 coalesce(tgt, seq[len(seq)]) AS target_item FROM loo WHERE tgt IS NOT NULL OR len(seq) >= 2""")
def _(t):
    return S.implicit_target(S.leave_one_out(S.user_sequences(t.ev))).select(
        "split", "user_id", ids(F.col("seq")).alias("items"), F.col("target.item_id").alias("target_item"))


@query("latest_event", "P7", "SELECT user_id, event_id, item_id, domain FROM target")
def _(t):
    return t.target.select("user_id", "event_id", "item_id", "domain")


@query("previous_item", "W2 J13", """
SELECT * FROM (SELECT event_id, lag(item_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, item_id AS dst FROM ev) WHERE src IS NOT NULL""")
def _(t):
    return S.transitions(t.ev).select("event_id", "src", "dst")


@query("previous_item_in_domain", "W2 J13", """
SELECT * FROM (SELECT event_id, lag(item_id) OVER (PARTITION BY user_id, domain ORDER BY ts, event_id) AS src, item_id AS dst FROM ev) WHERE src IS NOT NULL""")
def _(t):
    return S.transitions(t.ev, within_domain=True).select("event_id", "src", "dst")


@query("sequence_positions", "W3", """
SELECT event_id, pos, CASE WHEN domain = 'X' THEN dpos ELSE 0 END AS x_pos, CASE WHEN domain = 'Y' THEN dpos ELSE 0 END AS y_pos
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY ts, event_id) AS dpos FROM ranked)""")
def _(t):
    return S.positions(t.ev).select("event_id", "pos", "x_pos", "y_pos")


@query("next_item_labels", "W4", """
SELECT event_id, next_item, CAST(CASE WHEN nd = 'X' THEN 1 ELSE 0 END AS INT) AS x_mask, CAST(CASE WHEN nd = 'Y' THEN 1 ELSE 0 END AS INT) AS y_mask
FROM (SELECT event_id, lead(item_id) OVER w AS next_item, lead(domain) OVER w AS nd FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE next_item IS NOT NULL""")
def _(t):
    return S.next_labels(t.ev).select("event_id", "next_item", "x_mask", "y_mask")


@query("next_item_in_domain", "W5", """
@ lab AS (SELECT h.user_id, h.event_id, h.domain, coalesce(lead(h.item_id) OVER (PARTITION BY h.user_id, h.domain ORDER BY h.ts, h.event_id),
   CASE WHEN h.domain = t.domain THEN t.item_id END) AS label FROM hist h LEFT JOIN target t ON t.user_id = h.user_id) @
SELECT event_id, label FROM lab WHERE user_id IN (SELECT user_id FROM lab GROUP BY user_id
 HAVING count(CASE WHEN domain = 'X' THEN label END) > 0 AND count(CASE WHEN domain = 'Y' THEN label END) > 0)""")
def _(t):
    return S.next_in_domain(t.hist, t.target).select("event_id", "label")


@query("last_domain_positions", "W6", """
SELECT user_id, coalesce(max(CASE WHEN domain = 'X' THEN pos END) - max(pos) - 1, -1) AS x_last,
 coalesce(max(CASE WHEN domain = 'Y' THEN pos END) - max(pos) - 1, -1) AS y_last FROM ranked GROUP BY user_id""")
def _(t):
    return S.last_positions(t.ev)


@query("domain_by_threshold", "P2", "SELECT domain, count(*) AS n, min(item_id) AS lo, max(item_id) AS hi FROM ev GROUP BY domain")
def _(t):
    d = S.domain_by_threshold(F.col("item_id"), 50)
    return t.ev.groupBy(d.alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("lo"), F.max("item_id").alias("hi"))


@query("domain_aliases", "P3", """
@ a AS (SELECT p_partkey AS item_id, CASE p_partkey % 7 WHEN 0 THEN ' Entertainment' WHEN 1 THEN 'art' WHEN 2 THEN 'EDUCATION ' WHEN 3 THEN 'office'
  WHEN 4 THEN lower(p_type) WHEN 5 THEN 'Education' ELSE '' END AS d FROM part) @
SELECT item_id, CASE lower(trim(d)) WHEN 'entertainment' THEN 'Art' WHEN 'art' THEN 'Art' WHEN 'education' THEN 'Office' WHEN 'office' THEN 'Office'
   ELSE upper(substr(trim(d),1,1)) || lower(substr(trim(d),2)) END AS label,
 CASE WHEN lower(trim(d)) IN ('education','office','y') THEN 'Y' ELSE 'X' END AS axis,
 CASE d WHEN 'Education' THEN 'Office' WHEN 'Entertainment' THEN 'Art' WHEN '' THEN 'Item' ELSE d END AS shown FROM a""")
def _(t):
    k = F.col("p_partkey") % 7
    d = (F.when(k == 0, " Entertainment").when(k == 1, "art").when(k == 2, "EDUCATION ").when(k == 3, "office")
         .when(k == 4, F.lower("p_type")).when(k == 5, "Education").otherwise(""))
    return t.table("part").select(F.col("p_partkey").alias("item_id"), T.normalise_domain(d).alias("label"),
                                  T.domain_axis(d).alias("axis"), T.domain_label(d, "Item").alias("shown"))


@query("mapped_events", "P4", """
SELECT event_id, item_id, CAST(item_id AS BIGINT) AS idx FROM ev WHERE item_id IN (SELECT p_partkey FROM part) AND user_id IN
 (SELECT user_id FROM ev WHERE item_id IN (SELECT p_partkey FROM part) AND item_id < (SELECT count(*) FROM embeddings) GROUP BY user_id HAVING count(*) >= 3)""")
def _(t):
    id_map = dense_index(t.items.select("item_id"), ["item_id"])
    return S.mapped_only(t.ev, id_map, feature_rows=t.table("embeddings").count()).select("event_id", "item_id", "idx")


@query("every_second_row", "P5", """
SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n FROM ev) WHERE n % 2 = 1 OR r % 2 = 0""")
def _(t):
    return S.every_second_row(t.ev.select("event_id", "user_id", "ts"), ["ts", "event_id"]).select("event_id", "user_id")


@query("vector_override", "P6", """
SELECT u.user_id, CAST(64 AS INT) AS dim, coalesce(round(list_sum(CAST(e.embedding AS DOUBLE[])), 4), 0.0) AS total
FROM (SELECT c_custkey AS user_id FROM customer) u LEFT JOIN embeddings e ON e.vec_id = u.user_id""")
def _(t):
    given = t.table("embeddings").select(F.col("vec_id").alias("user_id"), "embedding")
    out = S.override_vectors(t.customers, given, 64)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return out.select("user_id", F.size("embedding").alias("dim"), F.round(total, 4).alias("total"))


@query("head_percentage_split", "P10", """
SELECT doc_id, CASE WHEN r < n * 10 // 100 THEN 'valid' ELSE 'train' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)""")
def _(t):
    return S.head_percentage(t.table("documents").select("doc_id"), ["doc_id"], 10)


_DRAW = "(((((k * 16807 + s * 69621 + {seed}) % 2147483647 + 1) * 48271) % 2147483647 + 1) * 39373) % 2147483647"


@query("shuffled_cap", "P10", f"""
@ r AS (SELECT event_id, {_DRAW.format(seed=2040)} % 2147483647 AS h FROM (SELECT event_id, event_id AS k, 0 AS s FROM ev)) @
SELECT event_id FROM r ORDER BY h, event_id LIMIT 500""")
def _(t):
    return S.shuffled_cap(t.ev.select("event_id"), "event_id", 500)


@query("identical_sequences", "U3", """
SELECT min(user_id) AS user_id, items FROM (SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY ts, event_id) AS items
 FROM ev_daily GROUP BY user_id) GROUP BY items""")
def _(t):
    first = H.distinct_sequences(t.daily_chunks, "user_id", ids(F.col("seq")))
    parts = F.sort_array(F.collect_list(F.struct("chunk", ids(F.col("seq")).alias("items"))))  # the text of a line of the result
    return first.groupBy("user_id").agg(F.array_join(parts["items"], ",").alias("items"))


@query("union_override", "U2", """
SELECT p_partkey AS item_id, CASE WHEN p_size > 25 THEN 'y:' || p_name ELSE 'x:' || p_name END AS title FROM part""")
def _(t):
    part = t.table("part")
    key = F.col("p_partkey").alias("item_id")
    x = part.select(key, F.concat(F.lit("x:"), "p_name").alias("title"))
    y = part.filter("p_size > 25").select(key, F.concat(F.lit("y:"), "p_name").alias("title"))
    return S.union_override(x, y, key=["item_id"])


@query("union_domains", "U1", "SELECT event_id, item_id, domain FROM ev")
def _(t):
    both = t.ev.drop("domain")
    return S.union_domains(both.filter("item_id < 50"), both.filter("item_id >= 50")).select("event_id", "item_id", "domain")


@query("id_mapping", "T5 D5", """
SELECT item_id, domain, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id, domain FROM items)""")
def _(t):
    return K.id_mapping(t.items)


@query("distinct_items", "A2 U6", "SELECT DISTINCT domain, item_id FROM ev")
def _(t):
    return K.distinct_items(t.ev)


@query("catalogue_counts", "A3 D5", """
SELECT coalesce(domain, 'all') AS domain, count(DISTINCT item_id) AS num_items FROM ev GROUP BY ROLLUP (domain)""")
def _(t):
    return K.catalogue_counts(t.ev)


@query("titled_events", "J1", """
SELECT e.event_id, coalesce(i.title, CAST(e.item_id AS VARCHAR)) AS title, coalesce(i.domain, 'Unknown') AS domain
FROM ev e LEFT JOIN items i USING (item_id)""")
def _(t):
    return K.with_titles(t.ev, t.items).select("event_id", "title", "domain")


@query("event_attributes", "J2", """
SELECT e.event_id, a.attribute FROM ev e LEFT JOIN item_attributes a USING (item_id)""")
def _(t):
    return K.with_attributes(t.ev, t.item_attributes).select("event_id", "attribute")


@query("index_to_item", "J3", """
SELECT user_id, rank, CASE WHEN item_id IN (SELECT s_suppkey FROM supplier) THEN 'item-' || item_id ELSE CAST(item_id AS VARCHAR) END AS item_key FROM preds""")
def _(t):
    number = F.col("s_suppkey").cast("int")  # fewer numbers than items, so some stay as they are
    id_map = t.table("supplier").select(number.alias("idx"), F.concat(F.lit("item-"), number).alias("item_id"))
    out = K.index_to_id(t.preds.withColumnRenamed("item_id", "idx"), id_map)
    return out.select("user_id", F.col("rank").cast("long").alias("rank"), "item_key")


@query("title_index", "J10 P14", """
SELECT lower(short_title) AS title_key, max(item_id) AS item_id FROM items WHERE trim(short_title) <> '' GROUP BY 1""")
def _(t):
    return K.title_index(t.items.drop("title").withColumnRenamed("short_title", "title")).select("title_key", "item_id")


@query("resume_left_over", "J7 L15", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return K.resume(t.table("documents").select("doc_id", "n_chars"), t.table("labels"), "doc_id")
