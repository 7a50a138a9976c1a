"""Model-input queries."""

from pyspark.sql import functions as F

from crossloom.operators import features as X
from crossloom.operators import sequences as S
from crossloom.operators.ordering import top_per_key
from crossloom.plans.registry import query


def draw_sql(key, slot, seed, below):
    return f"((((({key}) * 16807 + ({slot}) * 69621 + {seed}) % 2147483647 + 1) * 48271) % 2147483647 + 1) * 39373 % 2147483647 % ({below})"


def texts(df, keep=()):
    """Arrays as comma separated texts."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "array":
            cols.append(F.concat_ws(",", F.col(f.name).cast("array<string>")).alias(f.name))
        else:
            cols.append(F.col(f.name).cast("long").alias(f.name))
    return df.select(*cols)


def padded(expr, pad, order="pos", n=15):
    """SQL: left-padded text of an aggregated list."""
    return (f"array_to_string(list_concat(list_resize([]::BIGINT[], greatest({n} - count(*), 0)::BIGINT, {pad}::BIGINT), list(({expr})::BIGINT ORDER BY {order})), ',')")


@query("evaluation_features", "L1 W3 W6 D15", f"""
@ h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM hist),
 s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, row_number() OVER (PARTITION BY user_id, domain ORDER BY ts, event_id) AS dp FROM h WHERE b <= 15),
 a AS (SELECT user_id, {padded('item_id', 100)} AS seq, {padded("CASE WHEN domain='X' THEN item_id ELSE 100 END", 100)} AS xd, {padded("CASE WHEN domain='Y' THEN item_id ELSE 100 END", 100)} AS yd,
  {padded('pos', 0)} AS position, {padded("CASE WHEN domain='X' THEN dp ELSE 0 END", 0)} AS x_pos, {padded("CASE WHEN domain='Y' THEN dp ELSE 0 END", 0)} AS y_pos,
  coalesce(max(CASE WHEN domain='X' THEN pos END) - max(pos) - 1, -1) AS x_last, coalesce(max(CASE WHEN domain='Y' THEN pos END) - max(pos) - 1, -1) AS y_last FROM s GROUP BY user_id) @
SELECT a.*, CAST(CASE WHEN t.domain = 'Y' THEN 1 ELSE 0 END AS BIGINT) AS flag, CAST(CASE WHEN t.domain = 'Y' THEN t.item_id - 50 ELSE t.item_id END AS BIGINT) AS target FROM a JOIN target t USING (user_id)""")
def _(t):
    return texts(X.evaluation_features(t.hist, t.target, 50, 50))


TRAINING = f"""
@ h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM SOURCE),
 s0 AS (SELECT *, row_number() OVER w AS pos, lead(item_id) OVER w AS ground, lead(domain) OVER w AS gd,
   lead(item_id) OVER (PARTITION BY user_id, domain ORDER BY ts, event_id) AS label, row_number() OVER (PARTITION BY user_id, domain ORDER BY ts, event_id) AS dp
   FROM h WHERE b <= 16 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s1 AS (SELECT * FROM s0 WHERE b > 1),
 s AS (SELECT *, domain = 'X' AND label IS NOT NULL AS lx, domain = 'Y' AND label IS NOT NULL AS ly FROM s1 WHERE user_id IN
   (SELECT user_id FROM s1 GROUP BY 1 HAVING count(CASE WHEN domain = 'X' THEN label END) > 0 AND count(CASE WHEN domain = 'Y' THEN label END) > 0)) @
SELECT user_id, {padded('item_id', 100)} AS seq, {padded('pos', 0)} AS position, {padded('ground', 100)} AS ground,
 {padded('CASE WHEN lx THEN item_id ELSE 100 END', 100)} AS xd, {padded('CASE WHEN ly THEN item_id ELSE 100 END', 100)} AS yd,
 {padded('CASE WHEN lx THEN dp ELSE 0 END', 0)} AS x_pos, {padded('CASE WHEN ly THEN dp ELSE 0 END', 0)} AS y_pos,
 {padded("CASE WHEN gd = 'X' THEN ground ELSE 50 END", 50)} AS share_x, {padded("CASE WHEN gd = 'X' THEN 50 ELSE ground - 50 END", 50)} AS share_y,
 {padded('CASE WHEN lx THEN label ELSE 50 END', 50)} AS x_label, {padded('CASE WHEN ly THEN label - 50 ELSE 50 END', 50)} AS y_label,
 {padded('1', 0)} AS mask, {padded("CASE WHEN gd = 'X' THEN 1 ELSE 0 END", 0)} AS share_x_mask, {padded("CASE WHEN gd = 'X' THEN 0 ELSE 1 END", 0)} AS share_y_mask,
 {padded('CASE WHEN lx THEN 1 ELSE 0 END', 0)} AS x_mask, {padded('CASE WHEN ly THEN 1 ELSE 0 END', 0)} AS y_mask,
 {padded("CASE WHEN domain = 'X' THEN item_id ELSE 50 + " + draw_sql('user_id', 'pos', 2040, '50') + " END", 100)} AS corrupt_x,
 {padded("CASE WHEN domain = 'X' THEN " + draw_sql('user_id', 'pos', 2041, '50') + " ELSE item_id END", 100)} AS corrupt_y
FROM s GROUP BY user_id"""


@query("training_features", "L2 L4 W3 W4 W5 D15", TRAINING.replace("SOURCE", "ev"))
def _(t):
    return texts(X.training_features(t.ev, 50, 50))


@query("training_features_by_day", "L2 L4", TRAINING.replace("SOURCE", "ev_daily"))
def _(t):
    return texts(X.training_features(t.ev_daily, 50, 50))


@query("negative_samples", "L3", f"""
@ x AS (SELECT user_id, CASE WHEN domain = 'Y' THEN item_id - 50 ELSE item_id END AS l FROM target),
 d AS (SELECT user_id, l, i, {draw_sql('user_id', 'i', 2040, '49')} AS v FROM x, (SELECT unnest(range(999)) AS i)) @
SELECT user_id, string_agg(CAST(CASE WHEN v >= l THEN v + 1 ELSE v END AS VARCHAR), ',' ORDER BY i) AS negatives FROM d GROUP BY user_id""")
def _(t):
    return texts(X.negatives(t.target, 50, 50))


@query("shuffled_batches", "L5", f"""
@ o AS (SELECT event_id, row_number() OVER (ORDER BY {draw_sql('event_id', '0', 2040, '2147483647')}, event_id) - 1 AS i, count(*) OVER () AS n FROM ev),
 f AS (SELECT event_id, i FROM o UNION ALL SELECT event_id, i + n FROM o WHERE i < (256 - n % 256) % 256) @
SELECT event_id, i // 256 AS batch, i % 256 AS slot FROM f""")
def _(t):
    return X.batches(t.ev.select("event_id"), "event_id", 256)


@query("rectangular_candidates", "T8", """
@ l AS (SELECT user_id, list(item_id ORDER BY rank) AS c FROM preds GROUP BY user_id), m AS (SELECT max(len(c)) AS m FROM l) @
SELECT user_id, array_to_string(list_resize(c, m, 0), ',') AS items FROM l, m""")
def _(t):
    lists = S.collect_ordered(t.preds, ["user_id"], ["rank"], ["item_id"], "l").select("user_id", F.col("l.item_id").alias("items"))
    return texts(X.rectangular(lists, "items"))


@query("packed_tokens", "L16", """
@ s AS (SELECT user_id, list(item_id ORDER BY ts, event_id) AS k FROM ranked_daily GROUP BY user_id) @
SELECT user_id, array_to_string(list_resize(k[1:12], 12, 0), ',') AS input_ids, array_to_string(list_resize(list_transform(k[1:12], lambda x: 1), 12, 0), ',') AS attention,
 array_to_string(list_resize(k, 20, -100), ',') AS labels FROM s""")
def _(t):
    k = _tokens(t).select("user_id", X.pack_tokens(F.col("k"), 12).alias("p"), X.pack_tokens(F.col("k"), 20).alias("q"))
    return texts(k.select("user_id", "p.input_ids", "p.attention", "q.labels"))


def _tokens(t):
    """The first 20 items, which is all that the packed forms hold."""
    first = top_per_key(t.ev_daily, ["user_id"], [F.asc(c) for c in S.ORDER], 20, "_r")
    return S.collect_ordered(first, ["user_id"], S.ORDER, ["item_id"], "seq").select("user_id", F.col("seq.item_id").alias("k"))


@query("prompt_masked_tokens", "L16", """
@ s AS (SELECT user_id, list(item_id ORDER BY ts, event_id) AS k FROM ranked_daily GROUP BY user_id),
 e AS (SELECT user_id, CASE WHEN len(k) < 20 AND k[len(k)] <> 7 THEN list_append(k, 7) ELSE k[1:20] END AS ids, k[1:4] AS p FROM s),
 m AS (SELECT user_id, ids, CASE WHEN p[len(p)] = 7 THEN len(p) - 1 ELSE len(p) END AS n FROM e) @
SELECT user_id, array_to_string(ids, ',') AS input_ids, array_to_string(list_concat(list_resize([]::INT[], n, -100), ids[n+1:len(ids)]), ',') AS labels FROM m""")
def _(t):
    s = _tokens(t).select("user_id", X.pack_with_prompt(F.slice("k", 1, 4), F.col("k"), 7, 20).alias("p"))
    return texts(s.select("user_id", "p.*"))
