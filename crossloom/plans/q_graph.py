"""Graph queries."""

from pyspark.sql import functions as F

from crossloom.functions import vectors as V
from crossloom.operators import chunks as H
from crossloom.operators import graph as G
from crossloom.plans.registry import query

EDGES = """@ tr AS (SELECT lag(item_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, item_id AS dst FROM ev),
 edges AS (SELECT src, dst, count(*) AS weight FROM tr WHERE src IS NOT NULL GROUP BY ALL),
 norm AS (SELECT src, dst, weight::DOUBLE / sum(weight) OVER (PARTITION BY src) AS weight FROM edges) @
"""


@query("transition_graph", "G1 D10", EDGES + "SELECT src, dst, weight FROM edges")
def _(t):
    return G.transition_graph(t.ev)


@query("transition_graph_within_domain", "G2", """
SELECT src, dst, count(*) AS weight FROM (SELECT lag(item_id) OVER (PARTITION BY user_id, domain ORDER BY ts, event_id) AS src, item_id AS dst FROM ev) WHERE src IS NOT NULL GROUP BY ALL""")
def _(t):
    return G.transition_graph(t.ev, within_domain=True)


@query("normalised_graph", "G4", EDGES + "SELECT src, dst, round(weight, 6) AS weight FROM norm")
def _(t):
    return G.normalise_rows(G.transition_graph(t.ev)).withColumn("weight", F.round("weight", 6))


TOKENS = """@ ut0 AS (SELECT DISTINCT t.user_id, a.attribute AS token FROM ev t JOIN item_attributes a USING (item_id)),
 ut AS (SELECT * FROM ut0 UNION ALL SELECT user_id, unnest(['Game', 'Movie']) FROM (SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM ut0))),
 it AS (SELECT DISTINCT i.item_id, i.domain, attribute AS token FROM item_attributes JOIN items i USING (item_id)),
 fq AS (SELECT token, count(CASE WHEN k = 'U' THEN 1 END) AS users, count(CASE WHEN k = 'X' THEN 1 END) AS x_items, count(CASE WHEN k = 'Y' THEN 1 END) AS y_items
  FROM (SELECT token, 'U' AS k FROM ut UNION ALL SELECT token, domain FROM it) GROUP BY token),
 kept AS (SELECT * FROM fq WHERE x_items > 1 OR y_items > 1),
 nodes AS (SELECT *, row_number() OVER (ORDER BY token) - 1 + (SELECT count(*) FROM items) + (SELECT count(*) FROM customer) AS node FROM kept),
 g AS (SELECT it.item_id, it.domain, nodes.* FROM it JOIN nodes USING (token)) @
"""


def user_tokens(t):
    seen = t.ev.select("user_id", "item_id").distinct()
    own = seen.join(t.item_attributes, "item_id").select("user_id", F.col("attribute").alias("token")).distinct()
    return G.default_tokens(t.customers, own)


def item_tokens(t):
    return t.item_attributes.join(t.items.select("item_id", "domain"), "item_id").select("item_id", "domain", F.col("attribute").alias("token"))


@query("default_user_tokens", "G7", TOKENS + "SELECT user_id, token FROM ut")
def _(t):
    return user_tokens(t)


@query("token_frequency", "A11 U6", TOKENS + "SELECT token, users, x_items, y_items FROM fq")
def _(t):
    return G.token_frequency(user_tokens(t), item_tokens(t))


@query("kept_tokens", "A12", TOKENS + "SELECT token, users, x_items, y_items FROM kept WHERE users > 1")
def _(t):
    return G.kept_tokens(G.token_frequency(user_tokens(t), item_tokens(t)), ignore_users=False)


@query("attribute_graph", "G3 T5", TOKENS + """
SELECT 'full' AS graph, CAST(item_id AS BIGINT) AS src, node AS dst, 1.0::DOUBLE AS weight FROM g UNION ALL SELECT 'full', node, item_id, 1.0 FROM g
UNION ALL SELECT 'source', node, item_id, 1.0 FROM g WHERE domain = 'X' AND x_items > 1 UNION ALL SELECT 'target', item_id, node, 1.0 FROM g WHERE domain = 'Y' AND y_items > 1""")
def _(t):
    kept = G.kept_tokens(G.token_frequency(user_tokens(t), item_tokens(t)))
    return G.attribute_graph(item_tokens(t), G.attribute_nodes(kept, t.items.count(), t.customers.count()))


@query("attribute_graph_normalised", "G3 G4 T5", TOKENS.replace("SELECT count(*) FROM items", "SELECT count(*) + 1 FROM items").rstrip().rstrip("@").rstrip() + """,
 num AS (SELECT item_id AS id, row_number() OVER (ORDER BY item_id) - 1 AS item_id FROM items),
 gg AS (SELECT num.item_id AS item, g.* EXCLUDE (item_id) FROM g JOIN num ON num.id = g.item_id),
 e AS (SELECT 'full' AS graph, item AS src, node AS dst FROM gg UNION ALL SELECT 'full', node, item FROM gg
  UNION ALL SELECT 'source', node, item FROM gg WHERE domain = 'X' AND x_items > 1 UNION ALL SELECT 'target', item, node FROM gg WHERE domain = 'Y' AND y_items > 1) @
SELECT graph, src, dst, round(1.0::DOUBLE / count(*) OVER (PARTITION BY graph, src), 6) AS weight FROM e""")
def _(t):
    """Node numbers without a gap: items, a blank item, users, attributes; weights per source node of each graph."""
    kept = G.kept_tokens(G.token_frequency(user_tokens(t), item_tokens(t)))
    numbers, n_items = G.numbered_items(t.items.select("item_id"))
    tokens = item_tokens(t).join(numbers, "item_id").select(F.col("number").alias("item_id"), "domain", "token")
    edges = G.attribute_graph(tokens, G.attribute_nodes(kept, n_items, t.customers.count()))
    return G.normalise_rows(edges, by=("graph",)).withColumn("weight", F.round("weight", 6))


@query("answer_tokens", "A11 F3 F4", r"""
@ b AS (SELECT item_id, regexp_replace(lower(replace(title, '_', ' ')), '[[:punct:]]', ' ', 'g') AS x FROM (SELECT item_id, 'The ' || title || ', a_new an item.' AS title FROM items)) @
SELECT DISTINCT item_id, token FROM (SELECT item_id, unnest(string_split_regex(trim(x), '\s+')) AS token FROM b) WHERE token NOT IN ('', 'a', 'an', 'the')""")
def _(t):
    made = t.items.select("item_id", F.concat(F.lit("The "), "title", F.lit(", a_new an item.")).alias("answer"))
    return G.answer_tokens(made, "item_id", "answer")


@query("feature_propagation", "G5", EDGES.rstrip()[:-1] + """,
 f0 AS (SELECT item_id AS node, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM item_vec),
 f1 AS (SELECT src AS node, pos, sum(weight * v) AS v FROM norm JOIN f0 ON f0.node = norm.dst GROUP BY ALL),
 f2 AS (SELECT src AS node, pos, sum(weight * v) AS v FROM norm JOIN f1 ON f1.node = norm.dst GROUP BY ALL),
 o AS (SELECT node, pos, sum(v) / 3 AS v FROM (SELECT node, pos, v FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY ALL) @
SELECT node, CAST(count(*) AS INT) AS dim, round(sum(v * pos), 6) + 0.0 AS total FROM o GROUP BY node""")
def _(t):
    edges = G.normalise_rows(G.transition_graph(t.ev))
    out = G.propagate(edges, t.item_vec.select(F.col("item_id").alias("node"), "embedding"))
    weights = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    return out.select("node", F.size("embedding").alias("dim"), (F.round(V.dot(F.col("embedding"), weights), 6) + 0.0).alias("total"))


@query("edge_list_import", "G6", EDGES.replace("FROM ev)", "FROM ev_daily)") + """
SELECT src, dst, count(*) AS n, (SELECT CAST(max(greatest(src, dst)) + 1 AS BIGINT) FROM edges) AS nodes FROM tr WHERE src IS NOT NULL GROUP BY src, dst""")
def _(t):
    """Lists of all pairs of a user, one per chunk; pairs recur, and every recurrence counts."""
    lines = H.pairs(t.daily_chunks, ["user_id"], "item_id").select(F.to_json("pairs").alias("value"))
    edges = G.parse_edge_lists(lines.select("value"))
    nodes = G.node_count(edges).first()["nodes"]
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).withColumn("nodes", F.lit(nodes).cast("long"))
