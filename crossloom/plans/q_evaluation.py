"""Evaluation queries."""

from pyspark.sql import functions as F

from crossloom.functions import ranking as R
from crossloom.operators import chunks as H
from crossloom.operators import catalogue as K
from crossloom.operators import evaluation as E
from crossloom.operators.ordering import top_per_key
from crossloom.plans.registry import query

KS = (1, 5, 10, 20)
METRICS = ", ".join(
    [f"coalesce(round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0.0 END), 6), 0.0) AS hr_{k}" for k in KS]
    + [f"coalesce(round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0.0 END), 6), 0.0) AS ndcg_{k}" for k in KS]
    + ["coalesce(round(avg(coalesce(1.0::DOUBLE / rank, 0.0)), 6), 0.0) AS mrr"]
)
LIST_RANKS = """@ list_ranks AS (SELECT user_id, domain, list_position(list_transform(candidates, lambda x: lower(trim(x))), lower(trim(target_title))) AS rank FROM title_lists),
m AS (SELECT count(*) AS n, {} FROM list_ranks) @
""".format(METRICS)
FUZZY = """CASE WHEN lower(trim(p)) = lower(trim(t)) THEN 1.0
  WHEN contains(lower(trim(t)), lower(trim(p))) OR contains(lower(trim(p)), lower(trim(t))) THEN 0.5
  WHEN len(list_intersect(list_distinct(string_split(lower(trim(p)),' ')), list_distinct(string_split(lower(trim(t)),' '))))::DOUBLE
   / greatest(len(list_distinct(string_split(lower(trim(p)),' '))), len(list_distinct(string_split(lower(trim(t)),' ')))) > 0.5 THEN 0.3 ELSE 0.0 END"""
OOD = """(SELECT t.*, CASE WHEN k.domain IS NULL THEN 0.5 WHEN k.domain <> t.target_domain THEN 1.0 ELSE 0.0 END AS w FROM text_preds t LEFT JOIN
 (SELECT lower(title) AS tk, arg_max(domain, item_id) AS domain FROM items GROUP BY 1) k ON k.tk = lower(trim(t.prediction)))"""
TRUTH = """@ truth AS (SELECT t.user_id, t.item_id AS truth_item, s.score AS truth_score FROM target t JOIN scores s ON s.user_id = t.user_id AND s.item_id = t.item_id) @
"""


def lists(t):
    return E.list_ranks(t.title_lists)


@query("ranking_metrics", "M1 M2 M3 M4", LIST_RANKS + "SELECT * FROM m")
def _(t):
    return E.ranking_metrics(lists(t))


@query("ranking_metrics_by_domain", "A14 M4", LIST_RANKS + f"""
SELECT coalesce(domain, 'all') AS domain, count(*) AS n, {METRICS} FROM list_ranks GROUP BY ROLLUP (domain)""")
def _(t):
    return E.ranking_metrics(lists(t), by="domain")


@query("target_ranks", "M1 F1", LIST_RANKS + "SELECT user_id, CAST(rank AS BIGINT) AS rank FROM list_ranks")
def _(t):
    return lists(t).select("user_id", F.col("rank").cast("long").alias("rank"))


@query("single_answer_metrics", "M1 M19", f"""
SELECT count(*) AS n, {METRICS} FROM (SELECT CASE WHEN lower(trim(prediction)) = lower(trim(ground_truth)) THEN 1 END AS rank FROM text_preds)""")
def _(t):
    rows = E.single_answer_lists(t.text_preds)
    return E.ranking_metrics(E.list_ranks(rows, target="ground_truth"))


@query("expanded_metrics", "M19", f"""
SELECT count(*) AS n, {METRICS} FROM (SELECT list_position(CASE WHEN user_id % 4 <> 0 THEN list_transform(candidates, lambda x: lower(trim(x)))
  ELSE [lower(trim(prediction))] END, lower(trim(ground_truth))) AS rank FROM text_preds JOIN title_lists USING (user_id))""")
def _(t):
    c = t.title_lists.select("user_id", F.when(F.col("user_id") % 4 != 0, F.col("candidates")).alias("top_k"))
    rows = E.single_answer_lists(t.text_preds.join(c, "user_id"), candidates="top_k")
    return E.ranking_metrics(E.list_ranks(rows, target="ground_truth"))


@query("fuzzy_scores", "M5 F4 F5 U4", f"SELECT user_id, CAST(s AS DOUBLE) AS score FROM (SELECT user_id, {FUZZY} AS s FROM (SELECT user_id, prediction AS p, ground_truth AS t FROM text_preds))")
def _(t):
    return t.text_preds.select("user_id", R.fuzzy_score(F.col("prediction"), F.col("ground_truth")).alias("score"))


@query("fuzzy_metrics", "M6", f"""
SELECT round(avg(CASE WHEN s >= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS fuzzy_hr_1, round(avg(s::DOUBLE), 6) AS partial_hr_1,
 round(avg(CASE WHEN lower(trim(p)) = lower(trim(t)) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS exact_hr_1
FROM (SELECT *, {FUZZY} AS s FROM (SELECT user_id, prediction AS p, ground_truth AS t FROM text_preds))""")
def _(t):
    return E.fuzzy_metrics(t.text_preds)


@query("cold_warm_metrics", "M7 A14", LIST_RANKS.replace("m AS (", "sl AS (SELECT r.rank, CASE WHEN coalesce(h.n, 0) < 3 THEN 'cold' ELSE 'warm' END AS slice FROM customer c LEFT JOIN list_ranks r ON r.user_id = c.c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM hist GROUP BY 1) h ON h.user_id = c.c_custkey), m AS (") + f"""
SELECT coalesce(slice, 'all') AS slice, count(*) AS n, {METRICS} FROM sl GROUP BY ROLLUP (slice)""")
def _(t):
    """Customers without events are the cold ones; nothing is recommended to them."""
    return E.cold_warm_metrics(t.customers.join(lists(t), "user_id", "left"), t.hist)


@query("out_of_domain_rate", "M9 J10", f"""
SELECT round(sum(w::DOUBLE) / count(*), 6) AS ood_rate, sum(w::DOUBLE) AS ood_count, count(*) AS total FROM {OOD}""")
def _(t):
    return E.out_of_domain_rate(t.text_preds, K.title_index(t.items))


@query("rank_with_tolerance", "W7", TRUTH + """
SELECT s.user_id, count(CASE WHEN s.score > t.truth_score + 1e-5 THEN 1 END) + 1 AS rank FROM scores s JOIN truth t USING (user_id) GROUP BY s.user_id""")
def _(t):
    return E.rank_by_score(t.scores, t.target, tolerance=1e-5)


@query("rank_by_order", "W8", TRUTH + """
SELECT user_id, rank FROM (SELECT s.user_id, s.item_id, row_number() OVER (PARTITION BY s.user_id ORDER BY score DESC, item_id) AS rank FROM scores s)
 JOIN truth USING (user_id) WHERE item_id = truth_item""")
def _(t):
    return E.rank_by_score(t.scores, t.target)


@query("run_scores", "M11 W7", TRUTH + f"""
SELECT mrr, ndcg_5, ndcg_10, hr_1, hr_5, hr_10 FROM (SELECT {METRICS} FROM (
 SELECT s.user_id, count(CASE WHEN s.score > t.truth_score + 1e-5 THEN 1 END) + 1 AS rank FROM scores s JOIN truth t USING (user_id) GROUP BY s.user_id))""")
def _(t):
    return E.run_scores(E.rank_by_score(t.scores, t.target, tolerance=1e-5))


CANDS = """@ local AS (SELECT s.user_id, s.domain, CASE WHEN s.domain = 'Y' THEN s.item_id - 50 ELSE s.item_id END AS item,
  row_number() OVER (PARTITION BY s.user_id ORDER BY s.score DESC, s.item_id) AS rank
  FROM scores s JOIN target t ON t.user_id = s.user_id AND t.domain = s.domain),
cranks AS (SELECT t.user_id, t.domain, t.item_id, c.rank FROM target t LEFT JOIN local c ON c.user_id = t.user_id AND c.rank <= 10000
  AND t.item_id = CASE WHEN c.domain = 'Y' THEN c.item + 50 ELSE c.item END WHERE t.user_id IN (SELECT user_id FROM local)) @
"""


def local_candidates(t):
    own = t.scores.join(t.target.select("user_id", "domain"), ["user_id", "domain"])
    ranked = top_per_key(own, ["user_id"], [F.desc("score"), F.asc("item_id")], 10_000)
    return ranked.withColumn("item_id", F.when(F.col("domain") == "Y", F.col("item_id") - 50).otherwise(F.col("item_id")))


@query("candidate_list", "T2 D8 V5", CANDS + "SELECT user_id, domain, item AS item_id, rank FROM local")
def _(t):
    return local_candidates(t).select("user_id", "domain", "item_id", F.col("rank").cast("long").alias("rank"))


@query("candidate_hits_by_domain", "M12 P2", CANDS + f"""
SELECT coalesce(domain, 'all') AS domain, count(*) AS n, {METRICS} FROM cranks GROUP BY ROLLUP (domain)""")
def _(t):
    ranks = E.candidate_ranks(E.shifted_candidates(local_candidates(t), 50), t.target)
    return E.ranking_metrics(ranks.join(t.target.select("user_id", "domain"), "user_id"), by="domain")


@query("baseline_metrics", "M8", CANDS + f"SELECT count(*) AS n, {METRICS} FROM cranks WHERE item_id IN (SELECT s_suppkey FROM supplier)")
def _(t):
    return E.baseline_metrics(E.shifted_candidates(local_candidates(t), 50), t.target, t.table("supplier").select(F.col("s_suppkey").cast("int").alias("item_id")))


@query("set_precision", "M14 U4 U5 U6", """
@ p AS (SELECT user_id, list_distinct(list(item_id)) AS g FROM preds GROUP BY 1),
 f AS (SELECT user_id, list_distinct(list(item_id)) AS t FROM ev GROUP BY 1),
 c AS (SELECT user_id, len(list_intersect(g, t))::DOUBLE AS tp, len(g) AS ng, len(t) AS nt FROM p JOIN f USING (user_id)) @
SELECT user_id, CASE WHEN tp > 0 THEN round(tp / ng, 6) ELSE 0.0 END AS "precision", CASE WHEN tp > 0 THEN round(tp / nt, 6) ELSE 0.0 END AS recall,
 CASE WHEN tp > 0 THEN round(2 * tp / (ng + nt), 6) ELSE 0.0 END AS f1 FROM c""")
def _(t):
    return E.set_precision(t.preds, t.ev, "user_id", "item_id")


@query("recall_and_gain", "M15", """
@ r AS (SELECT t.user_id, p.rank FROM target t LEFT JOIN preds p ON p.user_id = t.user_id AND p.item_id = t.item_id) @
SELECT round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_10, round(avg(CASE WHEN rank <= 10 THEN (2^1 - 1) / log2(rank + 1) ELSE 0 END), 6) AS ndcg_10 FROM r""")
def _(t):
    m = E.ranking_metrics(E.candidate_ranks(t.preds, t.target), cutoffs=(10,))
    return m.select(F.col("hr_10").alias("recall_10"), "ndcg_10")


@query("label_accuracy", "M16 UD3", """
SELECT round(sum(CASE WHEN toxic = quality THEN w ELSE 0 END) / sum(w), 6) AS accuracy, round(sum(CASE WHEN toxic = quality THEN w ELSE 0 END), 6) AS matches
FROM (SELECT *, CAST(doc_id % 5 + 1 AS DOUBLE) AS w FROM labels)""")
def _(t):
    return E.accuracy(t.table("labels").withColumn("w", F.col("doc_id") % 5 + 1), "toxic", "quality", "w")


@query("next_token_accuracy", "M17", """
@ p AS (SELECT user_id, item_id, lag(item_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM ev_daily) @
SELECT round(avg(CASE WHEN item_id // 10 = (prev + 5) // 10 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy, count(*) AS places FROM p WHERE prev IS NOT NULL""")
def _(t):
    seq = H.stitched(t.daily_chunks, ["user_id"]).select(
        F.transform(F.concat("seq", "after"), lambda e: F.floor(e["item_id"] / 10)).alias("tokens"),
        F.transform("seq", lambda e: F.floor((e["item_id"] + 5) / 10)).alias("guess"))
    return E.next_token_accuracy(seq, "guess", "tokens")


@query("perplexity", "M17 F13", """
SELECT event_type, round(exp(avg(value) / 20), 4) AS perplexity FROM ev GROUP BY event_type""")
def _(t):
    loss = t.ev.groupBy("event_type").agg(F.avg("value").alias("loss"))
    return loss.select("event_type", F.round(E.perplexity(F.col("loss") / 20), 4).alias("perplexity"))


@query("comparison_table", "M18", LIST_RANKS.rstrip()[:-1] + f""",
 one AS (SELECT {METRICS} FROM (SELECT CASE WHEN lower(trim(prediction)) = lower(trim(ground_truth)) THEN 1 END AS rank FROM text_preds)) @
SELECT 'answers' AS method, hr_1, hr_5, hr_10, mrr FROM one UNION ALL SELECT 'lists', hr_1, hr_5, hr_10, mrr FROM m""")
def _(t):
    answers = E.ranking_metrics(E.list_ranks(E.single_answer_lists(t.text_preds), target="ground_truth"))
    return E.comparison_table({"answers": answers, "lists": E.ranking_metrics(lists(t))})


@query("best_run", "M20", """
@ r AS (SELECT domain, user_id % 10 AS run, round(avg(value), 6) AS metric FROM ev GROUP BY ALL) @
SELECT domain, arg_max(run, (metric, -run)) AS run, max(metric) AS metric FROM r GROUP BY domain""")
def _(t):
    runs = t.ev.groupBy("domain", (F.col("user_id") % 10).alias("run")).agg(F.round(F.avg("value"), 6).alias("metric"))
    return E.best_run(runs, "run", "metric", by="domain")


@query("metric_curve", "M21", LIST_RANKS + """
SELECT 1 AS k, hr_1 AS hr, ndcg_1 AS ndcg FROM m UNION ALL SELECT 5, hr_5, ndcg_5 FROM m UNION ALL SELECT 10, hr_10, ndcg_10 FROM m UNION ALL SELECT 20, hr_20, ndcg_20 FROM m""")
def _(t):
    return E.metric_curve(E.ranking_metrics(lists(t)))


@query("metric_report", "S12", LIST_RANKS + f"""
SELECT 'exact' AS section, metric, value FROM (SELECT CAST(n AS DOUBLE) AS n, * EXCLUDE n FROM m) UNPIVOT (value FOR metric IN (n, hr_1, hr_5, hr_10, hr_20, ndcg_1, ndcg_5, ndcg_10, ndcg_20, mrr))
UNION ALL SELECT 'ood', metric, value FROM (SELECT round(sum(w::DOUBLE) / count(*), 6) AS ood_rate, sum(w::DOUBLE) AS ood_count, count(*)::DOUBLE AS total FROM {OOD})
 UNPIVOT (value FOR metric IN (ood_rate, ood_count, total))""")
def _(t):
    return E.metric_report({
        "exact": E.ranking_metrics(lists(t)), "expanded": None,
        "ood": E.out_of_domain_rate(t.text_preds, K.title_index(t.items)),
    })
