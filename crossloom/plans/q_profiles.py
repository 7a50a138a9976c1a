"""User profile queries."""

from pyspark.sql import functions as F

from crossloom.functions import text as T
from crossloom.functions import vectors as V
from crossloom.operators import profiles as P
from crossloom.operators import similarity as M
from crossloom.plans.registry import query

COUNTED = "string_agg(value || '(' || n || ')', ', ' ORDER BY rank)"
PREF = """cnt AS (SELECT e.user_id, a.attribute AS value, count(*) AS n, min((e.ts, e.event_id, a.pos)) AS f FROM ev e JOIN item_attributes a USING (item_id) GROUP BY ALL),
 attr AS (SELECT user_id, string_agg(value || '(' || n || ')', ', ' ORDER BY rank) FILTER (rank <= 10) AS top_attributes, count(*) AS attribute_diversity FROM
   (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rank FROM cnt) GROUP BY user_id),
 ccnt AS (SELECT e.user_id, i.category AS value, count(*) AS n, min((e.ts, e.event_id)) AS f FROM ev e JOIN items i USING (item_id) GROUP BY ALL),
 cats AS (SELECT user_id, string_agg(value || '(' || n || ')', ', ' ORDER BY rank) FILTER (rank <= 5) AS top_categories, count(*) AS category_diversity FROM
   (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rank FROM ccnt) GROUP BY user_id),
 beh AS (SELECT user_id, count(*) AS total, count(CASE WHEN domain = 'X' THEN 1 END) AS x_count, count(CASE WHEN domain = 'Y' THEN 1 END) AS y_count FROM ev GROUP BY 1)"""


def attributes(t):
    return t.item_attributes.withColumnRenamed("attribute", "value")


def categories(t):
    return t.items.select("item_id", F.lit(0).alias("pos"), F.col("category").alias("value"))


@query("behaviour_profile", "A4 F12 D11", """
@ u AS (SELECT c_custkey AS user_id FROM customer) @
SELECT u.user_id, coalesce(total, 0) AS total, coalesce(x_count, 0) AS x_count, coalesce(y_count, 0) AS y_count, coalesce(ratio, 0.0) AS cross_ratio, coalesce(recent, '') AS recent FROM u LEFT JOIN (
SELECT user_id, count(*) AS total, count(CASE WHEN domain = 'X' THEN 1 END) AS x_count, count(CASE WHEN domain = 'Y' THEN 1 END) AS y_count,
 round(1.0::DOUBLE - abs(count(CASE WHEN domain = 'X' THEN 1 END) - count(CASE WHEN domain = 'Y' THEN 1 END)) / count(*), 6) AS ratio,
 string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY pos) FILTER (b <= 5) AS recent
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM ev) GROUP BY user_id) USING (user_id)""")
def _(t):
    out = P.behaviour(t.ev, t.table("customer").select(F.col("c_custkey").alias("user_id")))
    return out.select("user_id", "total", "x_count", "y_count", F.round("cross_ratio", 6).alias("cross_ratio"),
                      F.concat_ws(",", F.col("recent_items").cast("array<string>")).alias("recent"))


@query("preferred_attributes", "A5 T4 W10 F11 J2", "@" + PREF + "@ SELECT user_id, top_attributes, attribute_diversity FROM attr")
def _(t):
    p = P.preferences(t.ev, attributes(t), 10)
    return p.select("user_id", T.counted_text(F.col("preferred")).alias("top_attributes"), F.col("diversity").alias("attribute_diversity"))


@query("preferred_categories", "A5 T4 W10", "@" + PREF + "@ SELECT user_id, top_categories, category_diversity FROM cats")
def _(t):
    p = P.preferences(t.ev, categories(t), 5)
    return p.select("user_id", T.counted_text(F.col("preferred")).alias("top_categories"), F.col("diversity").alias("category_diversity"))


@query("mean_item_vectors", "A6", """
@ v AS (SELECT e.user_id, e.domain, unnest(i.embedding) AS v, generate_subscripts(i.embedding, 1) AS pos FROM ev e JOIN item_vec i USING (item_id)),
 m AS (SELECT user_id, domain, pos, avg(v) AS v FROM v GROUP BY ALL),
 u AS (SELECT DISTINCT user_id FROM ev) @
SELECT u.user_id, coalesce(round(sum(CASE WHEN domain = 'X' THEN v * pos END), 6), 0.0) + 0.0 AS x_sum, coalesce(round(sum(CASE WHEN domain = 'Y' THEN v * pos END), 6), 0.0) + 0.0 AS y_sum
FROM u LEFT JOIN m USING (user_id) GROUP BY u.user_id""")
def _(t):
    means = P.user_mean_pairs(t.ev, t.item_vec, 64)
    weights = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    return means.select("user_id", *[(F.round(V.dot(F.col(f"{d}_vec"), weights), 6) + 0.0).alias(f"{d}_sum") for d in "xy"])


@query("compact_profile_text", "L8 F10", "@" + PREF + """,
 rec AS (SELECT user_id, string_agg(title, ', ' ORDER BY pos) AS r FROM ranked JOIN items USING (item_id) WHERE back <= 5 GROUP BY 1) @
SELECT user_id, 'Total interactions: ' || total || chr(10) || 'Domain distribution: Entertainment(' || x_count || '), Education(' || y_count || ')' || chr(10) || 'Recent items: ' || r AS profile_text
FROM beh JOIN rec USING (user_id)""")
def _(t):
    return P.compact_texts(P.behaviour(t.ev), t.ev, t.items)


NEAR_TITLES = """ nl AS (SELECT user_id, 'X' AS domain, x_vec AS v FROM user_vec UNION ALL SELECT user_id, 'Y', y_vec FROM user_vec),
 nr AS (SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY score DESC, item_id) AS rank FROM
 (SELECT nl.user_id, nl.domain, i.item_id, round(list_dot_product(nl.v, i.embedding) / ((sqrt(list_dot_product(nl.v, nl.v)) + 1e-8) * (sqrt(list_dot_product(i.embedding, i.embedding)) + 1e-8)), 6) AS score FROM nl JOIN item_vec i ON i.domain = nl.domain)),
 near AS (SELECT user_id, string_agg(title, ', ' ORDER BY nr.domain, rank) AS near_titles FROM (SELECT nr.*, coalesce(i.title, CAST(nr.item_id AS VARCHAR)) AS title FROM nr LEFT JOIN items i USING (item_id)) nr WHERE rank <= 3 GROUP BY 1)"""


@query("detailed_profile_text", "L8 D11 F10 F11 J1 V7", "@" + PREF + "," + NEAR_TITLES + """,
 rec AS (SELECT user_id, string_agg('  [' || i.domain || '] ' || title, chr(10) ORDER BY pos) AS r FROM ranked JOIN items i USING (item_id) WHERE back <= 10 GROUP BY 1) @
SELECT user_id, 'User Behavior Summary:' || chr(10) || '- Total interactions: ' || total || chr(10) || '- Entertainment domain: ' || x_count || ' items' || chr(10) || '- Education domain: ' || y_count || ' items' || chr(10)
 || '- Cross-domain ratio: ' || printf('%.1f', (1.0::DOUBLE - abs(x_count - y_count) / total) * 100) || '%' || chr(10) || chr(10) || 'Top Preferred Attributes: ' || top_attributes || chr(10) || 'Top Preferred Categories: ' || top_categories || chr(10) || chr(10)
 || 'Similar Items (based on embedding): ' || coalesce(near_titles, 'N/A') || chr(10) || chr(10) || 'Recent Interaction Sequence:' || chr(10) || r AS profile_text, attribute_diversity, category_diversity
FROM beh JOIN attr USING (user_id) JOIN cats USING (user_id) JOIN rec USING (user_id) LEFT JOIN near USING (user_id)""")
def _(t):
    near = M.neighbour_items(t.user_vec, t.item_vec, t.items)
    return P.profiles(t.ev, t.items, attributes(t), categories(t), near).select(
        "user_id", "profile_text", "attribute_diversity", "category_diversity")
