"""Vector and set similarity queries."""

from pyspark.sql import functions as F

from crossloom.functions import vectors as V
from crossloom.operators import evaluation as E
from crossloom.operators import similarity as M
from crossloom.plans.registry import query

COS = "list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-8) * (sqrt(list_dot_product({b}, {b})) + 1e-8))"


def cos(a, b):
    return COS.format(a=a, b=b)


TOP = """SELECT id, neighbor_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbor_id) AS rank FROM
 (SELECT a.id, b.id AS neighbor_id, round({score}, 6) + 0.0 AS score FROM {a} a JOIN {b} b ON {on})) WHERE rank <= {k}"""


def top(df):
    return df.select("id", "neighbor_id", "score", F.col("rank").cast("long").alias("rank"))


@query("cosine_neighbours", "V1 V6 UD2 J8 T1", TOP.format(score=cos("a.embedding", "b.embedding"), a="vectors", b="vectors", on="a.domain = b.domain AND a.id <> b.id", k=3))
def _(t):
    return top(M.dense_topk(t.vectors, t.vectors, 3, exclude_self=True, by=("domain",)))


@query("dot_neighbours", "V2", TOP.format(score="list_dot_product(a.embedding, b.embedding)", a="vectors", b="vectors", on="a.id <> b.id", k=3))
def _(t):
    return top(M.dense_topk(t.vectors, t.vectors, 3, metric="dot", exclude_self=True))


@query("l2_neighbours", "V2 T3", TOP.format(score="-list_distance(a.embedding, b.embedding)", a="vectors", b="vectors", on="a.id <> b.id", k=1))
def _(t):
    return top(M.dense_topk(t.vectors, t.vectors, 1, metric="l2", exclude_self=True))


@query("l2_unit_neighbours", "V2", """
@ u AS (SELECT id, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS embedding FROM vectors) @
""" + TOP.format(score="-list_distance(a.embedding, b.embedding)", a="u", b="u", on="a.id <> b.id", k=2))
def _(t):
    return top(M.dense_topk(t.vectors, t.vectors, 2, metric="l2_rows", exclude_self=True))


@query("l2_column_neighbours", "V2", """
@ e AS (SELECT id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM vectors),
 n AS (SELECT pos, sqrt(sum(v * v)) AS n FROM e GROUP BY pos),
 u AS (SELECT id, list(v / n ORDER BY pos) AS embedding FROM e JOIN n USING (pos) GROUP BY id) @
""" + TOP.format(score="-list_distance(a.embedding, b.embedding)", a="u", b="u", on="a.id <> b.id", k=2))
def _(t):
    return top(M.dense_topk(t.vectors, t.vectors, 2, metric="l2_columns", exclude_self=True))


RETRIEVAL = """@ q AS (SELECT s.split, u.user_id, t.domain, CASE WHEN t.domain = 'Y' THEN y_vec ELSE x_vec END AS v FROM user_vec u JOIN target t USING (user_id), (VALUES ('train'), ('test')) s(split)),
 l AS (SELECT user_id AS nid, 'X' AS domain, x_vec AS v FROM user_vec UNION ALL SELECT user_id, 'Y', y_vec FROM user_vec),
 r AS (SELECT *, row_number() OVER (PARTITION BY split, user_id ORDER BY score DESC, neighbor_id) AS rank FROM
  (SELECT q.split, q.user_id, l.nid AS neighbor_id, round(%s, 6) + 0.0 AS score FROM q JOIN l ON l.domain = q.domain AND (q.split = 'test' OR l.nid <> q.user_id))),
 retrieval AS (SELECT * FROM r WHERE rank <= CASE WHEN split = 'train' THEN 2 ELSE 3 END) @
""" % cos("q.v", "l.v")


def retrieved(t, splits=("train", "test"), k_train=2):
    users = t.user_vec.join(t.target.select("user_id", "domain"), "user_id")
    q = users.select("*", F.explode(F.array(*[F.lit(s) for s in splits])).alias("split"))
    return M.retrieve_users(q, t.user_vec, k_train=k_train, splits=splits)


@query("similar_users", "V6 V5 D9 P3 J8", RETRIEVAL + "SELECT split, user_id, neighbor_id, score, rank FROM retrieval")
def _(t):
    return retrieved(t).select("split", "user_id", "neighbor_id", "score", F.col("rank").cast("long").alias("rank"))


@query("neighbour_items", "V7 J3", """
@ l AS (SELECT user_id, 'X' AS domain, x_vec AS v FROM user_vec UNION ALL SELECT user_id, 'Y', y_vec FROM user_vec),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY score DESC, item_id) AS rank FROM
 (SELECT l.user_id, l.domain, i.item_id, round(%s, 6) + 0.0 AS score FROM l JOIN item_vec i ON i.domain = l.domain)) @
SELECT r.user_id, r.domain, r.rank, r.item_id, coalesce(i.title, CAST(r.item_id AS VARCHAR)) AS title, r.score FROM r LEFT JOIN items i USING (item_id) WHERE r.rank <= 5""" % cos("l.v", "i.embedding"))
def _(t):
    out = M.neighbour_items(t.user_vec, t.item_vec, t.items)
    return out.select("user_id", "domain", F.col("rank").cast("long").alias("rank"), "item_id", "title", "score")


@query("vector_target_rank", "W7 V8 D8", """
@ q AS (SELECT u.user_id, t.domain, t.item_id AS truth, CASE WHEN t.domain = 'Y' THEN y_vec ELSE x_vec END AS v FROM user_vec u JOIN target t USING (user_id)),
 s AS (SELECT q.user_id, q.truth, i.item_id, list_dot_product(q.v, i.embedding) AS score FROM q JOIN item_vec i USING (domain)) @
SELECT s.user_id AS id, CAST(count(CASE WHEN s.score > t.score + 1e-5 THEN 1 END) + 1 AS BIGINT) AS rank
FROM s JOIN (SELECT user_id, score FROM s WHERE item_id = truth) t USING (user_id) GROUP BY s.user_id""")
def _(t):
    q = t.user_vec.join(t.target, "user_id").select(
        F.col("user_id").alias("id"), "domain", F.col("item_id").alias("truth"),
        F.when(F.col("domain") == "Y", F.col("y_vec")).otherwise(F.col("x_vec")).alias("embedding"))
    return M.dense_target_rank(q, t.item_vec.withColumnRenamed("item_id", "id"), by=("domain",))


@query("vector_candidates", "V8 T7 J1", """
@ q AS (SELECT u.user_id, t.domain, CASE WHEN t.domain = 'Y' THEN y_vec ELSE x_vec END AS v FROM user_vec u JOIN target t USING (user_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM
  (SELECT q.user_id, i.item_id, round(list_dot_product(q.v, i.embedding), 6) + 0.0 AS score FROM q JOIN item_vec i USING (domain))) @
SELECT r.user_id, r.rank, i.title, r.score FROM r JOIN items i USING (item_id) WHERE r.rank <= 20""")
def _(t):
    q = t.user_vec.join(t.target, "user_id").select(
        F.col("user_id").alias("id"), "domain",
        F.when(F.col("domain") == "Y", F.col("y_vec")).otherwise(F.col("x_vec")).alias("embedding"))
    best = M.dense_topk(q, t.item_vec.withColumnRenamed("item_id", "id"), 20, metric="dot", by=("domain",))
    return best.join(t.items.select(F.col("item_id").alias("neighbor_id"), "title"), "neighbor_id").select(
        F.col("id").alias("user_id"), F.col("rank").cast("long").alias("rank"), "title", "score")


@query("vector_stats", "A7", """
SELECT vec_id AS id, round(list_avg(e), 6) + 0.0 AS mean, round(list_stddev_pop(e), 6) AS std, round(list_max(e), 6) AS "max", round(list_min(e), 6) AS "min", round(sqrt(list_dot_product(e, e)), 6) AS l2_norm
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def _(t):
    s = t.vectors.select("id", V.vector_stats(F.col("embedding")).alias("s"))
    return s.select("id", *[(F.round(f"s.{c}", 6) + 0.0).alias(c) for c in ("mean", "std", "max", "min", "l2_norm")])


@query("given_pair_similarity", "V9 J14 V1", """
@ p AS (SELECT user_id, rank, CAST(item_id * 7 AS BIGINT) AS similar_id FROM preds) @
SELECT p.user_id, p.similar_id, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 0.5 ELSE round(%s, 4) + 0.0 END AS similarity
FROM p LEFT JOIN vectors a ON a.id = p.user_id LEFT JOIN vectors b ON b.id = p.similar_id""" % cos("a.embedding", "b.embedding"))
def _(t):
    pairs = t.preds.select("user_id", (F.col("item_id") * 7).cast("long").alias("similar_id"), F.lit(0.5).alias("similarity"))
    out = M.refresh_pairs(pairs, t.vectors)
    return out.select("user_id", "similar_id", (F.col("similarity") + 0.0).alias("similarity"))


@query("pooled_vectors", "V3 V4 V5", """
SELECT user_id, round(list_sum(list_transform(list_zip(x_vec, y_vec), lambda z: (z[1] + z[2]) / 2 * z[1])), 6) + 0.0 AS pooled,
 round(list_sum(list_transform(list_zip(x_vec, y_vec), lambda z: (z[1] + z[2]) * z[1])), 6) + 0.0 AS added,
 round(list_sum(list_transform(list_zip(x_vec, y_vec), lambda z: (0.75 * z[1] + 0.25 * z[2]) * z[1])), 6) + 0.0 AS blended FROM user_vec""")
def _(t):
    x, y = F.col("x_vec"), F.col("y_vec")
    return t.user_vec.select(
        "user_id", (F.round(V.dot(V.midpoint(x, y), x), 6) + 0.0).alias("pooled"),
        (F.round(V.dot(V.add(x, y), x), 6) + 0.0).alias("added"),
        (F.round(V.dot(V.blend(x, y, F.lit(0.25)), x), 6) + 0.0).alias("blended"))


@query("linear_shift", "A17", """
@ m AS (SELECT pos, avg(v) FILTER (domain = 'X') - avg(v) FILTER (domain = 'Y') AS d FROM
 (SELECT domain, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM vectors) GROUP BY pos) @
SELECT round(sum(d * d), 6) AS shift FROM m""")
def _(t):
    return M.linear_shift(t.vectors)


@query("kernel_shift", "A18", """
@ p AS (SELECT a.domain || b.domain AS kind, list_distance(a.embedding, b.embedding) ^ 2 AS d2 FROM vectors a, vectors b),
 w AS (SELECT sum(d2) / (count(*) - sqrt(count(*))) / 4 AS w FROM p),
 k AS (SELECT kind, avg(exp(-d2 / w) + exp(-d2 / (2*w)) + exp(-d2 / (4*w)) + exp(-d2 / (8*w)) + exp(-d2 / (16*w))) AS m FROM p, w GROUP BY kind) @
SELECT round(sum(CASE WHEN kind IN ('XX','YY') THEN m ELSE -m END), 6) AS shift FROM k""")
def _(t):
    return M.kernel_shift(t.vectors)


@query("similar_item_sets", "X6 U4 T1", """
@ s AS (SELECT DISTINCT user_id, item_id FROM ranked WHERE back <= 15), n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.user_id AS id, b.user_id AS neighbor_id, count(*) AS i FROM s a JOIN s b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY ALL),
 j AS (SELECT p.id, p.neighbor_id, round(i::DOUBLE / (x.n + y.n - i), 6) AS score FROM p JOIN n x ON x.user_id = p.id JOIN n y ON y.user_id = p.neighbor_id) @
SELECT id, neighbor_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbor_id) AS rank FROM j) WHERE rank <= 15""")
def _(t):
    from crossloom.operators.sequences import recent_events

    sets = recent_events(t.ev).select(F.col("user_id").alias("id"), F.col("item_id").alias("token"))
    return top(M.set_topk(sets, 15))


@query("user_hit_rate", "M10 J6", RETRIEVAL.rstrip()[:-1] + """, h AS (SELECT r.user_id, min(CASE WHEN e.user_id IS NOT NULL THEN r.rank END) AS f FROM retrieval r JOIN target t ON t.user_id = r.user_id
  LEFT JOIN (SELECT DISTINCT user_id, item_id FROM hist) e ON e.user_id = r.neighbor_id AND e.item_id = t.item_id WHERE r.split = 'train' GROUP BY 1) @
SELECT round(avg(CASE WHEN f <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS uhr_1, round(avg(CASE WHEN f <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS uhr_3,
 round(avg(CASE WHEN f <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS uhr_5, count(*) AS evaluated_users FROM h""")
def _(t):
    return E.user_hit_rate(retrieved(t, ("train",)), t.target, t.hist)


@query("retrieval_quality", "M13 A16", RETRIEVAL + """
SELECT count(*) AS n, round(avg(hit::DOUBLE), 6) AS hit_rate, round(avg(len::DOUBLE), 6) AS mean_len, round(sum(hit)::DOUBLE / sum(len), 6) AS hit_per_len,
 count(CASE WHEN best > 0.2 THEN 1 END) AS confident, coalesce(round(avg(CASE WHEN best > 0.2 THEN hit::DOUBLE END), 6), 0.0) AS confident_hit_rate FROM (
 SELECT r.user_id, max(CASE WHEN EXISTS (SELECT 1 FROM hist e WHERE e.user_id = r.neighbor_id AND e.item_id = t.item_id) THEN 1 ELSE 0 END) AS hit,
  sum((SELECT count(*) FROM hist e WHERE e.user_id = r.neighbor_id)) AS len, max(CASE WHEN r.rank = 1 THEN r.score END) AS best
 FROM retrieval r JOIN target t ON t.user_id = r.user_id WHERE r.split = 'train' AND r.rank <= 1 GROUP BY 1)""")
def _(t):
    return E.retrieval_quality(retrieved(t, ("train",)), t.target, t.hist, n=1, confident=0.2)
