"""Source parser queries. The text lines are derived from the tables, so they grow with them."""

from pyspark.sql import functions as F

from crossloom.functions import text as T
from crossloom.operators import chunks as H
from crossloom.operators import evaluation as E
from crossloom.operators import instructions as N
from crossloom.operators import reporting as R
from crossloom.operators.ordering import dense_index
from crossloom.plans.registry import query
from crossloom.sources import readers as I


@query("parsed_interactions", "S1 D1", """
SELECT event_id, CASE WHEN event_id % 7 = 3 THEN '' ELSE CAST(user_id AS VARCHAR) END AS user_id, CAST(item_id AS VARCHAR) AS item_id,
 CASE WHEN event_id % 5 = 2 THEN 0 ELSE event_id END AS ts, domain FROM ev WHERE event_type <> 'error' AND value >= 1 AND event_id % 11 NOT IN (4, 7)""")
def _(t):
    e = F.col("event_id")
    user, item = F.col("user_id").cast("string"), F.col("item_id").cast("string")
    user = F.when(e % 7 != 3, user)
    ts = F.when(e % 5 != 2, e)
    plain = F.to_json(F.struct(user.alias("user_id"), item.alias("item_id"), F.concat(ts.cast("string"), F.lit("")).alias("timestamp")))
    alias = F.to_json(F.struct(user.alias("reviewerID"), item.alias("asin"), ts.alias("unixReviewTime")))
    alias = F.when(e % 3 == 0, F.regexp_replace(alias, r'(Time":\d+)', "$1.0")).otherwise(alias)  # times come as numbers, decimals and texts
    # some records arrive blank or broken
    plain = F.when(e % 11 == 4, F.translate(plain, '"', "'")).otherwise(plain)
    alias = F.when(e % 11 == 4, F.translate(alias, '"', "'")).otherwise(alias)
    line = F.when(F.col("value") < 1, "  ").when(F.col("event_type") == "error", '{"user_id": broken').when(e % 2 == 0, plain).otherwise(alias)
    line = F.when(e % 11 == 7, F.concat(line, F.lit(" trailing"))).otherwise(line)
    return I.parse_interactions(t.ev.select("event_id", F.col("domain").alias("d"), line.alias("value")), F.col("d")).drop("d")


@query("parsed_items", "S2 D3", """
@ l AS (SELECT p_partkey, 0 AS dup FROM part UNION ALL SELECT p_partkey, 1 FROM part WHERE p_size > 40),
 d AS (SELECT p.*, l.dup FROM part p JOIN l USING (p_partkey)) @
SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name || CASE WHEN dup = 1 THEN ' again' ELSE '' END AS title, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_type ELSE p_name END AS description,
 CASE WHEN p_partkey % 4 = 0 THEN p_type || '|' || p_brand WHEN p_partkey % 4 = 1 THEN p_type || '|' || p_brand ELSE p_type END AS category, p_brand AS brand, 'X' AS domain
FROM d WHERE dup = 1 OR p_size <= 40""")
def _(t):
    k = F.col("p_partkey")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    dup = F.explode(F.when(F.col("p_size") > 40, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("dup")
    rows = t.table("part").select("*", dup)
    title = F.concat("p_name", F.when(F.col("dup") == 1, " again").otherwise(""))
    description = F.when(k % 3 == 0, F.concat(F.lit("["), text(F.col("p_name")), F.lit(","), text(F.col("p_type")), F.lit("]"))).otherwise(text(F.col("p_name")))
    flat = F.concat(F.lit("["), text(F.col("p_type")), F.lit(","), text(F.col("p_brand")), F.lit("]"))
    category = F.when(k % 4 == 0, F.concat(F.lit("["), flat, F.lit("]"))).when(k % 4 == 1, flat).otherwise(text(F.col("p_type")))
    value = F.concat(F.lit('{"asin": '), text(k.cast("string")), F.lit(', "title": '), text(title), F.lit(', "description": '), description,
                     F.lit(', "categories": '), category, F.lit(', "brand": '), text(F.col("p_brand")), F.lit("}"))
    out = I.parse_items(rows.select("dup", value.alias("value")), "X", ["dup"])
    return out.withColumn("category", F.concat_ws("|", "category"))


@query("parsed_catalogue", "S3", """
SELECT 'A' || p_partkey AS item_id, p_name || ', "' || p_type || '"' AS title, CAST(p_partkey AS INT) AS idx, 'X' AS domain FROM part WHERE p_size <= 40""")
def _(t):
    k = F.col("p_partkey")
    idx = F.when(F.col("p_size") > 40, "n/a").otherwise(k.cast("string"))
    line = F.concat(F.lit("A"), k.cast("string"), F.lit(',"'), "p_name", F.lit(', ""'), "p_type", F.lit('""",'), idx)
    return I.parse_catalogue(t.table("part").select(line.alias("value")), "X")


PACKED = """@ p AS (SELECT user_id, item_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM ev_daily) @
"""


def packed_lines(t):
    """All events of a user and day as packed lines, one per chunk; one cell per line is too short and every line ends with a tab."""
    seq = H.with_length(t.daily_chunks, ["user_id"])
    cells = F.transform("seq", lambda e, i: F.concat_ws("|", e["item_id"].cast("string"), (i + F.col("first")).cast("string"), e["event_id"].cast("string")))
    line = F.concat_ws("\t", F.col("user_id").cast("string"), F.col("length").cast("string"), F.lit("5|6"), F.concat_ws("\t", cells), F.lit(""))
    return seq.select(line.alias("value"))


@query("packed_sequences", "S4 D2", PACKED + "SELECT CAST(user_id AS VARCHAR) AS user_id, n AS border, CAST(item_id AS BIGINT) AS item, pos, event_id AS ts FROM p")
def _(t):
    return I.parse_packed(packed_lines(t))


@query("packed_ground_truth", "S5", PACKED + "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS BIGINT) AS item, CAST(CASE WHEN item_id >= 50 THEN 1 ELSE 0 END AS INT) AS flag, pos AS at FROM p WHERE pos = n")
def _(t):
    events = I.parse_packed(packed_lines(t))
    _, truth = I.split_ground_truth(events)
    last = I.last_as_truth(events, 50)
    return last.join(truth.select("user_id", "item", F.col("pos").alias("at")), ["user_id", "item"])


@query("packed_history", "S5", PACKED + "SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM p WHERE pos < n GROUP BY 1")
def _(t):
    history, _ = I.split_ground_truth(I.parse_packed(packed_lines(t)))
    return history.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


def response_texts(t):
    """One chat completion per part, in three content forms; some contents are empty, some ids unmapped."""
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    json_list = F.to_json(F.concat(words, F.array(F.lower("p_type"))))
    content = (F.when(k % 97 == 5, "").when(k % 3 == 0, json_list)
               .when(k % 3 == 1, F.concat(F.lit("INTRODUCTION: nice\nATTRIBUTES: "), json_list))
               .otherwise(F.concat(F.lit("see ["), F.concat_ws(", ", words), F.lit("] ok"))))
    message = F.struct(F.lit("assistant").alias("role"), content.alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    qqid = F.when(k % 98 == 7, k + 1_000_000_000).otherwise(k)
    body = F.to_json(F.array(F.struct(F.lit("c").alias("id"), F.array(choice).alias("choices"), qqid.alias("qqid"))))
    return t.table("part").select(body.alias("value"))


LISTS = """@ c AS (SELECT p_partkey, CASE WHEN p_partkey % 98 = 7 THEN p_partkey + 1000000000 ELSE p_partkey END AS qqid, CASE WHEN p_partkey % 97 = 5 THEN [] WHEN p_partkey % 3 = 2 THEN string_split(p_name, ' ')
  ELSE list_append(string_split(p_name, ' '), lower(p_type)) END AS l FROM part) @
"""


@query("parsed_responses", "S6 D14", """
SELECT CAST(0 AS INT) AS pos, CASE WHEN p_partkey % 98 = 7 THEN p_partkey + 1000000000 ELSE p_partkey END AS qqid, p_partkey % 97 = 5 AS is_empty FROM part""")
def _(t):
    return I.parse_responses(response_texts(t)).select("pos", "qqid", (F.col("content") == "").alias("is_empty"))


@query("loose_lists", "F9", LISTS + "SELECT qqid, array_to_string(l, '|') AS attributes FROM c")
def _(t):
    return I.parse_responses(response_texts(t)).select("qqid", F.concat_ws("|", T.loose_list(F.col("content"))).alias("attributes"))


@query("attribute_answers", "F9", LISTS + "SELECT qqid, array_to_string(l, '|') AS attributes, CASE WHEN p_partkey % 97 <> 5 AND p_partkey % 3 = 1 THEN 'nice' ELSE '' END AS intro FROM c")
def _(t):
    a = I.parse_responses(response_texts(t)).select("qqid", T.attribute_answer(F.col("content")).alias("a"))
    return a.select("qqid", F.concat_ws("|", "a.attributes").alias("attributes"), F.col("a.intro").alias("intro"))


@query("response_attributes", "L14 J3 D4", LISTS + "SELECT 'item-' || qqid AS item_id, array_to_string(l, '|') AS attributes FROM c WHERE len(l) > 0 AND qqid < 1000000000")
def _(t):
    ids = t.table("part").select(F.col("p_partkey").alias("idx"), F.concat(F.lit("item-"), F.col("p_partkey").cast("string")).alias("item_id"))
    out = N.response_attributes(I.parse_responses(response_texts(t)), ids)
    return out.withColumn("attributes", F.concat_ws("|", "attributes"))


@query("keyed_objects", "S7", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_size AS size FROM part")
def _(t):
    rows = t.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return I.parse_keyed(I.to_keyed(rows), "struct<name:string,size:int>")


@query("matrix_cells", "S8 D8", """
SELECT row, CAST(idx - 1 AS INT) AS idx, round(score::DOUBLE, 6) + 0.0 AS score FROM (SELECT vec_id AS row, unnest(embedding) AS score, generate_subscripts(embedding, 1) AS idx FROM embeddings)""")
def _(t):
    cells = I.long_scores(t.table("embeddings").select(F.col("vec_id").alias("row"), "embedding"))
    return cells.withColumn("score", F.round(F.col("score").cast("double"), 6) + 0.0)


LOGS = """@ e AS (SELECT user_id AS run, event_id AS step, back, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  CASE WHEN event_type <> 'view' THEN value END AS loss, CASE WHEN event_type = 'view' THEN value / 3 END AS eval_loss FROM ranked_daily) @
"""


def logs(t):
    seq = t.daily_chunks
    entry = F.transform("seq", lambda e: F.struct(
        e["event_id"].alias("step"), F.when(e["event_type"] != "view", e["value"]).alias("loss"),
        F.when(e["event_type"] == "view", e["value"] / 3).alias("eval_loss"), F.lit(0.00001).alias("learning_rate"), F.lit(1.0).alias("epoch")))
    best = F.when(F.col("user_id") % 2 == 0, F.lit(0.25))
    body = F.to_json(F.struct(entry.alias("log_history"), best.alias("best_metric"),
                              F.when(best.isNotNull(), F.lit(7)).alias("best_global_step"), F.lit(99).alias("global_step")))
    return I.parse_training_logs(seq.select(F.col("user_id").alias("run"), body.alias("value"), "first"), first="first")


@query("training_curve", "S9 F13", LOGS + "SELECT run, step, round(loss, 4) AS loss, 0.00001::DOUBLE AS learning_rate, 1.0::DOUBLE AS epoch, CAST(NULL AS DOUBLE) AS eval_loss FROM e WHERE loss IS NOT NULL")
def _(t):
    return R.training_curve(logs(t)[0])


@query("training_summary", "S9 M20", LOGS + """
SELECT run, CAST(CASE WHEN run % 2 = 0 THEN 7 ELSE coalesce(arg_max(step, pos) FILTER (eval_loss IS NOT NULL), 99) END AS BIGINT) AS best_step,
 CASE WHEN run % 2 = 0 THEN 0.25::DOUBLE ELSE coalesce(round(arg_max(eval_loss, pos) FILTER (eval_loss IS NOT NULL), 4), 0.0) END AS best_eval_loss, CAST(99 AS BIGINT) AS total_steps,
 coalesce(round(arg_max(loss, pos) FILTER (loss IS NOT NULL), 4), 0.0) AS final_loss FROM e GROUP BY run""")
def _(t):
    return R.training_summary(*logs(t))


@query("answer_log", "S10", "SELECT doc_id AS idx, md5(trim(text)) AS answer FROM documents WHERE lang <> 'de'")
def _(t):
    k = F.col("doc_id")
    record = F.when(F.col("lang") == "de", F.col("lang")).otherwise(F.concat(F.lit("\n"), k.cast("string"), F.lit("@@"), "text", F.lit("\n")))
    out = I.parse_answers(t.table("documents").select(record.alias("value")))
    return out.select("idx", F.md5(F.col("answer").cast("binary")).alias("answer"))


@query("candidate_rows", "J11", """
@ q AS (SELECT event_id AS row_idx, user_id, item_id AS gt FROM ev WHERE item_id < 50) @
SELECT user_id, max(row_idx) AS row_idx, arg_max(gt, row_idx) AS gt FROM q GROUP BY user_id""")
def _(t):
    """Of several query rows per user the last one whose truth lies in X."""
    return E.query_rows(t.ev.select(F.col("event_id").alias("row_idx"), "user_id", F.col("item_id").alias("gt")), 50)


@query("row_index", "T5", "SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS idx FROM documents")
def _(t):
    return dense_index(t.table("documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"]).drop("n_chars")
