"""Text ranking, answer refinement and text function queries."""

from pyspark.sql import functions as F

from crossloom.functions import text as T
from crossloom.operators import catalogue as K
from crossloom.operators import evaluation as E
from crossloom.operators import grounding as G
from crossloom.operators.ordering import top_per_key
from crossloom.plans.q_evaluation import METRICS
from crossloom.plans.registry import query


def bm25_sql(docs: str, queries: str, m: int) -> str:
    """WITH parts giving ``hits(q_id, doc_id, score, rank)`` from ``docs(doc_id, text)`` and ``queries(q_id, q_text)``."""
    return f"""
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM ({docs}) WHERE trim(text) <> ''),
dn AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM d) GROUP BY ALL),
dfq AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfq, dn),
idf AS (SELECT token, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT q_id, token, count(*) AS qtf FROM (SELECT q_id, unnest(regexp_extract_all(lower(q_text), '[a-z0-9]+')) AS token FROM ({queries})) GROUP BY ALL),
sc AS (SELECT q_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) + 0.0 AS score
  FROM qt JOIN idf USING (token) JOIN tf USING (token), dn GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= {m})"""


def ranked(df, *cols):
    return df.select(*cols, F.col("rank").cast("long").alias("rank"))


def corpus(t):
    q = t.table("benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("q_text"))
    return q, t.table("documents").select("doc_id", "text")


@query("inverted_index", "X1 F2", """
SELECT doc_id, token, count(*) AS tf, any_value(dl) AS doc_len FROM (SELECT doc_id, CAST(len(t) AS INT) AS dl, unnest(t) AS token FROM
 (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents WHERE trim(text) <> '')) GROUP BY doc_id, token""")
def _(t):
    return G.postings(t.table("documents").select("doc_id", "text"))


@query("bm25_documents", "X2 J9", "@" + bm25_sql("SELECT doc_id, text FROM documents", "SELECT item_id AS q_id, text AS q_text FROM benchmark", 5) + "@ SELECT q_id, doc_id, score, rank FROM hits")
def _(t):
    q, d = corpus(t)
    return ranked(G.bm25(q, d, 5), "q_id", "doc_id", "score")


@query("overlap_documents", "X3 J9", """
@ q AS (SELECT item_id AS q_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
 qx AS (SELECT q_id, len(t) AS n, unnest(t) AS token FROM q),
 dx AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents),
 s AS (SELECT q_id, doc_id, round(count(*)::DOUBLE / any_value(n), 6) AS score FROM qx JOIN dx USING (token) GROUP BY ALL) @
SELECT q_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def _(t):
    q, d = corpus(t)
    return ranked(G.token_overlap(q, d, 5), "q_id", "doc_id", "score")


GROUNDED = "@" + bm25_sql("SELECT item_id AS doc_id, title AS text FROM items", "SELECT user_id AS q_id, prediction AS q_text FROM text_preds", 20) + """,
ex AS (SELECT p.user_id AS q_id, k.item_id FROM text_preds p JOIN (SELECT lower(title) AS tk, max(item_id) AS item_id FROM items GROUP BY 1) k ON k.tk = lower(trim(p.prediction))),
boosted AS (SELECT q_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY place) AS rank FROM (
  SELECT h.q_id, h.doc_id AS item_id, CASE WHEN h.doc_id = ex.item_id THEN greatest(h.score, 1.0) ELSE h.score END AS score, h.rank AS place FROM hits h LEFT JOIN ex USING (q_id)
  UNION ALL SELECT q_id, item_id, 1.0, 0 FROM ex WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.q_id = ex.q_id AND h.doc_id = ex.item_id))) WHERE rank <= 20),
chk AS (SELECT b.q_id, i.domain = p.target_domain AS in_domain FROM boosted b JOIN items i USING (item_id) JOIN text_preds p ON p.user_id = b.q_id WHERE b.rank = 1),
lst AS (SELECT b.q_id, list(i.title ORDER BY b.rank) AS titles, arg_min(i.item_id, b.rank) AS item, arg_min(b.score, b.rank) AS score FROM boosted b JOIN items i USING (item_id) GROUP BY 1),
fb AS (SELECT user_id, list(i.title ORDER BY rank) AS titles, arg_min(i.item_id, rank) AS item FROM preds JOIN items i USING (item_id) GROUP BY 1),
refined AS (SELECT p.*, l.q_id IS NOT NULL AS grounded, coalesce(c.in_domain, false) AS inside, l.titles AS lt, l.item AS li, l.score AS ls, fb.titles AS ft, fb.item AS fi
  FROM text_preds p LEFT JOIN lst l ON l.q_id = p.user_id LEFT JOIN chk c ON c.q_id = p.user_id LEFT JOIN fb ON fb.user_id = p.user_id) @
"""


def grounded(t, m=20):
    q = t.text_preds.select(F.col("user_id").alias("q_id"), F.col("prediction").alias("q_text"))
    hits = G.bm25(q, t.items.select("item_id", F.col("title").alias("text")), m, doc="item_id")
    return G.exact_title_boost(hits, q, K.title_index(t.items), m)


@query("grounded_titles", "X4 X2 P14", GROUNDED + "SELECT q_id, item_id, score, rank FROM boosted")
def _(t):
    return ranked(grounded(t), "q_id", "item_id", "score")


@query("domain_check", "X5 P3", GROUNDED + "SELECT q_id, in_domain FROM chk")
def _(t):
    return G.domain_check(grounded(t), t.text_preds.withColumnRenamed("user_id", "q_id"), t.items)


def refined(t):
    return G.refine(t.text_preds, t.items, K.title_index(t.items), t.preds.select("user_id", "rank", "item_id"))


@query("refined_answers", "X7 J12 J11 D13", GROUNDED + """
SELECT user_id, CASE WHEN inside THEN lt[1] WHEN grounded THEN ft[1] ELSE prediction END AS prediction, CASE WHEN grounded THEN prediction END AS prediction_original,
 CASE WHEN inside THEN li WHEN grounded THEN fi END AS grounded_item_id, CASE WHEN inside THEN ls END AS grounded_score,
 array_to_string(CASE WHEN grounded AND NOT inside THEN ft ELSE lt END, '|') AS candidates, grounded AS refined, grounded AND NOT inside AS fallback FROM refined""")
def _(t):
    return refined(t).select(
        "user_id", "prediction", "prediction_original", "grounded_item_id", "grounded_score",
        F.when(F.col("top_k_candidates").isNotNull(), F.concat_ws("|", "top_k_candidates")).alias("candidates"), "refined", "fallback")


@query("refine_counters", "A13", GROUNDED + """
SELECT count(*) AS total, count(CASE WHEN grounded THEN 1 END) AS grounded, count(CASE WHEN inside THEN 1 END) AS in_domain,
 count(CASE WHEN grounded AND NOT inside THEN 1 END) AS fallback, count(CASE WHEN NOT grounded THEN 1 END) AS not_refined FROM refined""")
def _(t):
    return G.refine_counters(refined(t))


@query("refined_metrics", "M19 M4", GROUNDED + f"""
SELECT count(*) AS n, {METRICS} FROM (SELECT list_position(list_transform(CASE WHEN grounded THEN CASE WHEN inside THEN lt ELSE ft END ELSE [prediction] END, lambda x: lower(trim(x))), lower(trim(ground_truth))) AS rank FROM refined)""")
def _(t):
    return E.ranking_metrics(E.list_ranks(E.single_answer_lists(refined(t), candidates="top_k_candidates"), target="ground_truth"))


@query("refined_out_of_domain", "M19 M9", GROUNDED + """
SELECT round(sum(w) / count(*), 6) AS ood_rate, sum(w) AS ood_count, count(*) AS total FROM (SELECT CASE WHEN k.domain IS NULL THEN 0.5::DOUBLE WHEN k.domain <> r.target_domain THEN 1.0 ELSE 0.0 END AS w
 FROM (SELECT *, CASE WHEN inside THEN lt[1] WHEN grounded THEN ft[1] ELSE prediction END AS answer FROM refined) r
 LEFT JOIN (SELECT lower(title) AS tk, arg_max(domain, item_id) AS domain FROM items GROUP BY 1) k ON k.tk = lower(trim(r.answer)))""")
def _(t):
    return E.out_of_domain_rate(refined(t), K.title_index(t.items))


@query("best_scored_item", "T3 V8", """
SELECT user_id, arg_max(item_id, (score, -item_id)) AS item_id FROM scores GROUP BY user_id""")
def _(t):
    return top_per_key(t.scores, ["user_id"], [F.desc("score"), F.asc("item_id")], 1).select("user_id", "item_id")


# ---------------------------------------------------------------- text functions over whole tables

@query("normalised_answers", "F3", r"""
@ b AS (SELECT doc_id, regexp_replace(lower(text), '[!-/:-?\x40\[-`{-~‘’´]', ' ', 'g') AS t FROM documents),
 c AS (SELECT doc_id, regexp_replace(t, '(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g') AS t FROM b),
 e AS (SELECT doc_id, regexp_replace(t, '(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g') AS t FROM c) @
SELECT doc_id, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS h FROM e""")
def _(t):
    return t.table("documents").select("doc_id", F.md5(T.normalise_answer(F.col("text")).cast("binary")).alias("h"))


@query("token_counts", "F2 F4 P14", r"""
SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INT) AS tokens,
 CAST(len(list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS INT) AS words FROM documents""")
def _(t):
    return t.table("documents").select(
        "doc_id", F.size(T.alnum_tokens(F.col("text"))).alias("tokens"), F.size(T.word_set(F.col("text"))).alias("words"))


@query("answer_lines", "F6 F7 F8", r"""
SELECT conv_id, turn, md5(string_split(trim(regexp_replace('Output: ' || text, '^Output:\s*', '')), chr(10))[1]) AS line,
 md5(trim(text)) AS clean, md5(trim(text)) AS tail FROM conversations""")
def _(t):
    c = t.table("conversations")
    made = F.concat(F.lit("  output: "), F.col("text"))
    marked = F.concat(F.lit("<s> "), F.col("text"), F.lit("</s>"))
    reply = F.concat(F.lit("x\n### Response:\n"), F.col("text"))
    return c.select("conv_id", "turn", F.md5(T.first_answer_line(made)).alias("line"),
                    F.md5(T.strip_special_tokens(marked)).alias("clean"), F.md5(T.after_marker(reply)).alias("tail"))
