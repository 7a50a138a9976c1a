"""Dataset statistics and display tables."""

from pyspark.sql import functions as F

from crossloom.operators import catalogue as K
from crossloom.operators import chunks as H
from crossloom.operators import evaluation as E
from crossloom.operators import instructions as N
from crossloom.operators import reporting as R
from crossloom.operators import sequences as S
from crossloom.operators.ordering import top_per_key
from crossloom.plans.q_evaluation import CANDS, FUZZY, LIST_RANKS, METRICS, OOD, lists, local_candidates
from crossloom.plans.q_sources import logs
from crossloom.plans.registry import query
from crossloom.session import materialize


@query("dataset_statistics", "A9 D2", """
SELECT domain, count(DISTINCT item_id) AS num_items, count(*) AS num_interactions, (SELECT count(DISTINCT user_id) FROM ev) AS num_users,
 (SELECT round(avg(n), 1) FROM (SELECT count(*) AS n FROM ev GROUP BY user_id)) AS avg_sequence_length FROM ev GROUP BY domain""")
def _(t):
    return R.dataset_statistics(t.ev)


@query("feature_statistics", "A8 D7", """
SELECT split, domain, count(DISTINCT id) AS rows, CAST(64 AS INT) AS dim, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std
FROM (SELECT id, domain, CASE WHEN id % 10 = 0 THEN 'test' ELSE 'train' END AS split, unnest(embedding) AS v FROM vectors) GROUP BY split, domain""")
def _(t):
    split = F.when(F.col("id") % 10 == 0, "test").otherwise("train").alias("split")
    return R.feature_statistics(t.vectors.select("*", split), ["split", "domain"])


@query("sequence_statistics", "A10", """
SELECT CASE WHEN user_id % 3 = 0 THEN 'valid' ELSE 'train' END AS split, count(*) AS lines, max(mi) AS max_item, max(user_id) AS max_user, min(b) AS min_border, max(b) AS max_border, CAST(max(n) AS INT) AS max_length
FROM (SELECT user_id, max(item_id) AS mi, max(CASE WHEN back = 1 THEN item_id END) AS b, count(*) AS n FROM ranked_daily GROUP BY user_id) GROUP BY 1""")
def _(t):
    split = F.when(F.col("user_id") % 3 == 0, "valid").otherwise("train").alias("split")
    return H.statistics(t.daily_chunks.select("*", split), "user_id", "item_id", ["split"])


@query("kind_histogram", "A15", "SELECT event_type, count(*) AS n FROM ev GROUP BY event_type")
def _(t):
    return R.histogram(t.ev, "event_type")


POOL = """@ shown AS (SELECT c_custkey AS user_id FROM customer ORDER BY c_custkey LIMIT 160),
 first AS (SELECT user_id, domain, user_id AS line FROM target JOIN shown USING (user_id) JOIN text_preds USING (user_id)
  WHERE user_id IN (SELECT user_id FROM ranked WHERE back BETWEEN 2 AND 15 GROUP BY user_id HAVING count(*) >= 2) ORDER BY user_id LIMIT 120),
 demo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY line) AS r FROM first) WHERE r <= 12),
 s AS (SELECT DISTINCT user_id, lower(title) AS title FROM ranked JOIN items USING (item_id) JOIN (SELECT user_id FROM first) USING (user_id) WHERE back <= 15),
 n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1),
 j AS (SELECT a.user_id, b.user_id AS similar_id, count(*) AS i FROM s a JOIN s b ON a.title = b.title AND a.user_id <> b.user_id GROUP BY ALL),
 sim AS (SELECT d.user_id, f.user_id AS similar_id, f.line, coalesce(round(j.i::DOUBLE / (x.n + y.n - j.i), 6), 0.0) AS score FROM demo d JOIN first f ON f.user_id <> d.user_id
  JOIN n x ON x.user_id = d.user_id JOIN n y ON y.user_id = f.user_id LEFT JOIN j ON j.user_id = d.user_id AND j.similar_id = f.user_id),
 pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, line) AS place FROM sim) WHERE place <= 15) @
"""


def demo(t):
    """Prompts for all customers, answers only for those with events, and the display rules on both."""
    test = S.leave_one_out(S.user_sequences(t.ev)).filter("split = 'test'")
    texts = N.history_texts(test, t.items)
    prompt = F.concat(F.lit("intro\n=== Interaction History ===\n"), F.coalesce("history", F.lit("")), F.lit("\n\n=== Preference Summary ===\n"))
    rows = t.customers.join(texts, "user_id", "left").join(t.target.select("user_id", "domain"), "user_id", "left")
    rows = rows.select("user_id", "domain", F.col("user_id").alias("line"), prompt.alias("input"))
    # at most 160 rows that are read several times; their prompts join the whole catalogue, which is sent around once that way
    return R.display_pool(materialize(R.eligible_users(rows, t.text_preds.select("user_id", "prediction"))))


@query("display_users", "P11 J5", POOL + "SELECT user_id, domain FROM demo")
def _(t):
    return demo(t)[1].select("user_id", "domain")


@query("display_pool", "T6 X6 P11", POOL + "SELECT user_id, place, similar_id, round(score, 4) AS similarity, place <= 5 AS selected FROM pool")
def _(t):
    pool, users = demo(t)
    titles = S.recent_events(t.ev).join(t.items.select("item_id", F.lower("title").alias("title")), "item_id").select("user_id", "title")
    out = R.pool_with_fill(users, pool, titles)
    return out.withColumn("place", F.col("place").cast("long"))


@query("display_pool_titles", "T6 P12", POOL.strip().rstrip("@").rstrip() + """,
 shown_titles AS (SELECT user_id, string_agg(title, '|' ORDER BY pos) AS titles FROM (SELECT user_id, title, pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k
  FROM ranked JOIN items USING (item_id) WHERE back BETWEEN 2 AND 15) WHERE k <= 3 GROUP BY 1) @
SELECT p.user_id, p.place, p.similar_id, p.place <= 5 AS selected, coalesce(h.titles, '') AS titles FROM pool p LEFT JOIN shown_titles h ON h.user_id = p.similar_id""")
def _(t):
    """The retrieval pool of the demo users with the first titles of every similar user's history."""
    pool, users = demo(t)
    recent = S.recent_events(t.ev)
    named = recent.join(t.items.select("item_id", "title"), "item_id")
    places = R.pool_with_fill(users, pool, named.select("user_id", F.lower("title").alias("title")))
    history = named.filter("back >= 2").select("user_id", (-F.col("back")).alias("back"), "title")
    first = top_per_key(history, ["user_id"], [F.asc("back")], 3).select("user_id", "rank", "title")
    out = R.pool_titles(places, first)
    return out.select("user_id", F.col("place").cast("long").alias("place"), "similar_id", "selected", F.concat_ws("|", "titles").alias("titles"))


@query("display_titles", "P12 T7", """
SELECT user_id, string_agg(left(title, 12), '|' ORDER BY pos) FILTER (pos <= 8) AS history, string_agg(title, '|' ORDER BY pos) FILTER (pos <= 3) AS recent
FROM ranked JOIN items USING (item_id) GROUP BY user_id""")
def _(t):
    first = top_per_key(t.ev, ["user_id"], [F.asc("ts"), F.asc("event_id")], 8).join(t.items.select("item_id", "title"), "item_id")
    return R.truncated_titles(first).select("user_id", F.concat_ws("|", "history").alias("history"), F.concat_ws("|", "recent").alias("recent"))


_DRAW = "(((((user_id * 16807 + 0 * 69621 + 2040) % 2147483647 + 1) * 48271) % 2147483647 + 1) * 39373) % 2147483647 % 2147483647"


@query("display_sample", "P13", f"""
SELECT user_id, item_id, score FROM scores WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM scores) ORDER BY {_DRAW}, user_id LIMIT 100)""")
def _(t):
    return R.sample_rows(t.scores.select("user_id", "item_id", "score"), "user_id", 100)


@query("metric_snapshot", "S13", LIST_RANKS + "SELECT round(COLUMNS(* EXCLUDE n), 4) FROM m")
def _(t):
    return R.metric_snapshot(E.ranking_metrics(lists(t)))


_WIDE = "SELECT '{part}' AS part, metric, round(value::DOUBLE, 4) AS value FROM (UNPIVOT (SELECT {cols} FROM {rows}) ON COLUMNS(*) INTO NAME metric VALUE value)"


@query("dashboard_metrics", "S13 M19", POOL.strip().rstrip("@").rstrip() + f""",
 ex AS (SELECT {METRICS} FROM (SELECT list_position(CASE WHEN user_id % 4 <> 0 THEN list_transform(candidates, lambda x: lower(trim(x)))
  ELSE [lower(trim(prediction))] END, lower(trim(ground_truth))) AS rank FROM text_preds JOIN title_lists USING (user_id))),
 fz AS (SELECT round(avg(CASE WHEN s >= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS fuzzy_hr_1, round(avg(s::DOUBLE), 6) AS partial_hr_1,
  round(avg(CASE WHEN lower(trim(p)) = lower(trim(t)) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS exact_hr_1
  FROM (SELECT *, {FUZZY} AS s FROM (SELECT user_id, prediction AS p, ground_truth AS t FROM text_preds))),
 od AS (SELECT round(sum(w::DOUBLE) / count(*), 6) AS ood_rate, sum(w::DOUBLE) AS ood_count, count(*)::DOUBLE AS total FROM {OOD}),
 si AS (SELECT avg(n) AS mean_similar_users FROM (SELECT user_id, count(*)::DOUBLE AS n FROM pool WHERE score > 0 AND place <= 5 GROUP BY 1)) @
""" + " UNION ALL ".join(_WIDE.format(part=p, cols="*", rows=r) for p, r in (("snapshot", "ex"), ("fuzzy", "fz"), ("out_of_domain", "od"), ("similar", "si"))))
def _(t):
    """Expanded metrics win over exact ones; with the figures shown beside them."""
    c = t.title_lists.select("user_id", F.when(F.col("user_id") % 4 != 0, F.col("candidates")).alias("top_k"))
    wide = E.single_answer_lists(t.text_preds.join(c, "user_id"), candidates="top_k")
    expanded = E.ranking_metrics(E.list_ranks(wide, target="ground_truth"))
    exact = E.ranking_metrics(E.list_ranks(E.single_answer_lists(t.text_preds), target="ground_truth"))
    pool, users = demo(t)
    titles = S.recent_events(t.ev).join(t.items.select("item_id", F.lower("title").alias("title")), "item_id").select("user_id", "title")
    near = R.pool_with_fill(users, pool, titles).filter("selected AND similarity > 0")
    similar = near.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean_similar_users"))
    return R.dashboard_metrics(R.metric_snapshot(exact, expanded), fuzzy=E.fuzzy_metrics(t.text_preds), out_of_domain=E.out_of_domain_rate(t.text_preds, K.title_index(t.items)), similar=similar)


@query("dashboard_baseline", "S13 M8 S9", CANDS.strip().rstrip("@").rstrip() + f""",
 base AS (SELECT {METRICS} FROM cranks WHERE item_id IN (SELECT s_suppkey FROM supplier)),
 logs AS (SELECT user_id AS run, event_id AS step, value AS loss FROM ranked_daily WHERE event_type <> 'view' AND value IS NOT NULL) @
""" + _WIDE.format(part="baseline", cols="hr_1, hr_5, hr_10, hr_20, mrr", rows="base") + """
 UNION ALL SELECT 'training ' || run, 'loss ' || step, round(loss, 4) FROM logs""")
def _(t):
    """The candidate baseline and the training curves, which the dashboard shows beside its metrics."""
    suppliers = t.table("supplier").select(F.col("s_suppkey").cast("int").alias("item_id"))
    base = E.baseline_metrics(E.shifted_candidates(local_candidates(t), 50), t.target, suppliers)
    rows = R.dashboard_metrics(base.select("hr_1", "hr_5", "hr_10", "hr_20", "mrr")).withColumn("part", F.lit("baseline"))
    return rows.unionByName(R.curve_metrics(R.training_curve(logs(t)[0])))
