"""Instruction, prompt and model-call queries."""

import string

from pyspark.sql import functions as F

from crossloom import constants as C
from crossloom.functions import text as T
from crossloom.operators import instructions as N
from crossloom.operators import profiles as P
from crossloom.operators import sequences as S
from crossloom.operators import similarity as M
from crossloom.operators.ordering import top_per_key
from crossloom.plans.q_profiles import NEAR_TITLES, PREF, attributes, categories
from crossloom.plans.q_sequences import _SEQ
from crossloom.plans.q_similarity import RETRIEVAL, retrieved
from crossloom.plans.registry import query
from crossloom.session import written


def fill_sql(template, **parts):
    """The SQL expression that fills a template."""
    out = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            out.append("'" + literal.replace("'", "''") + "'")
        if name:
            out.append(f"CAST({parts[name]} AS VARCHAR)")
    return " || ".join(out)


def with_parts(text):
    """The WITH parts of an SQL text written as ``@ parts @``."""
    return text.strip().strip("@").strip()


SPLITS = with_parts(_SEQ) + """,
 ins AS (SELECT split, user_id, CASE WHEN tgt IS NULL THEN seq[1:len(seq)-1] ELSE seq END AS seq, coalesce(tgt, seq[len(seq)]) AS tgt FROM loo WHERE tgt IS NOT NULL OR len(seq) >= 2),
 hl AS (SELECT split, user_id, string_agg('  [' || i.domain || '] ' || i.title, chr(10) ORDER BY p) AS history FROM
  (SELECT split, user_id, unnest(seq[greatest(len(seq)-14,1):len(seq)]) AS item_id, generate_subscripts(seq[greatest(len(seq)-14,1):len(seq)], 1) AS p FROM ins) JOIN items i USING (item_id) GROUP BY 1, 2)"""
FEW = with_parts(RETRIEVAL) + """,
 nl5 AS (SELECT user_id AS neighbor_id, 'There is a similar user who has interacted with: ' || string_agg(i.domain || ': ' || i.title, ' | ' ORDER BY pos) AS line FROM ranked JOIN items i USING (item_id) WHERE back <= 5 GROUP BY 1),
 few AS (SELECT user_id, string_agg(line, chr(10) ORDER BY rank) AS few_shot FROM retrieval JOIN nl5 USING (neighbor_id) WHERE split = 'test' GROUP BY 1)"""
PROFILE_SQL = "'Total interactions: ' || total || chr(10) || 'Domain distribution: Art(' || x_count || '), Office(' || y_count || ')' || chr(10) || 'Top attributes: ' || top_attributes || chr(10) || 'Top categories: ' || top_categories"


def instruction_sql(template, known=True, few=False):
    parts = dict(
        target_domain="ti.domain", interaction_sequence="hl.history", user_profile_text=f"({PROFILE_SQL})" if known else "'N/A'",
        preferred_attributes="top_attributes", preferred_categories="top_categories", similar_items="coalesce(near_titles, 'N/A')",
        retrieved_users_text="coalesce(few_shot, '(no similar users available)')")
    body = fill_sql(template, **parts)
    return f"""@ {SPLITS}, {PREF}, {NEAR_TITLES}, {FEW} @
SELECT ins.split, 'Based on the user''s interaction history and profile, recommend a new ' || ti.domain || ' item.' AS instruction,
 trim(replace(replace({body}, 'Instruction:', ''), 'Input:', ''), ' ' || chr(10)) AS input, ti.title AS output, ins.user_id, ins.tgt AS target_item_id, ti.domain AS target_domain
FROM ins JOIN hl USING (split, user_id) JOIN items ti ON ti.item_id = ins.tgt JOIN beh USING (user_id) JOIN attr USING (user_id) JOIN cats USING (user_id)
 LEFT JOIN near USING (user_id) LEFT JOIN few USING (user_id)"""


def splits(t):
    return S.leave_one_out(S.user_sequences(t.recent))


def profile_table(t, once=True):
    """Profiles of all users; written once, unless the caller's plan drops them unused."""
    near = M.neighbour_items(t.user_vec, t.item_vec, t.items)
    out = P.profiles(t.ev, t.items, attributes(t), categories(t), near)
    return written(out, "profiles") if once else out


def test_retrieval(t):
    return retrieved(t, ("test",))


def few_shot(t):
    return written(N.few_shot_texts(test_retrieval(t), t.recent, t.items), "few-shot")


@query("few_shot_texts", "L6", f"@ {FEW} @ SELECT user_id, few_shot FROM few")
def _(t):
    return few_shot(t)


@query("history_texts", "L7", f"@ {SPLITS} @ SELECT split, user_id, history FROM hl")
def _(t):
    return N.history_texts(S.implicit_target(splits(t)), t.items, keys=("split", "user_id"))


@query("instructions_base", "L9 D12 J4", instruction_sql(C.RECOMMEND_BASE, known=False))
def _(t):
    return N.instruction_rows(splits(t), profile_table(t, once=False), t.items, template="base")


@query("instructions_profile", "L9 D12 J4", instruction_sql(C.RECOMMEND_PROFILE))
def _(t):
    return N.instruction_rows(splits(t), profile_table(t), t.items, template="profile")


@query("instructions_cot", "L9", instruction_sql(C.RECOMMEND_COT))
def _(t):
    return N.instruction_rows(splits(t), profile_table(t), t.items, template="cot")


@query("instructions_retrieval", "L9 L6 J4", instruction_sql(C.RECOMMEND_RETRIEVAL))
def _(t):
    return N.instruction_rows(splits(t), profile_table(t), t.items, few_shot(t), template="profile")


def light_instructions(t):
    """Instruction-like rows straight from the documents, for the row-wise conversions."""
    return t.table("documents").select(
        F.col("doc_id").alias("user_id"), F.lit("Recommend an item.").alias("instruction"), F.col("text").alias("input"),
        F.col("lang").alias("output"), F.col("doc_id").alias("target_item_id"), F.col("source").alias("target_domain"))


@query("chat_messages", "L10 D12", """
SELECT doc_id AS user_id, 3 AS n, md5('Recommend an item.' || chr(10) || chr(10) || text) AS user_message, lang AS answer, length(text) + 20 AS user_chars FROM documents""")
def _(t):
    c = N.chat_rows(light_instructions(t))
    content = lambda i: F.element_at("messages", i)["content"]
    return c.select("user_id", F.size("messages").alias("n"), F.md5(content(2).cast("binary")).alias("user_message"),
                    content(3).alias("answer"), F.length(content(2)).cast("long").alias("user_chars"))


@query("chat_prompts", "L11", "SELECT doc_id AS user_id, md5('Recommend an item.' || chr(10) || chr(10) || text) AS prompt FROM documents")
def _(t):
    out = N.chat_prompts(N.chat_rows(light_instructions(t)))
    return out.select("user_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query("conversation_openings", "L11", """
SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r = 1""")
def _(t):
    users = t.table("conversations").filter("role = 'user'")
    return top_per_key(users, ["conv_id"], [F.asc("turn")], 1).select("conv_id", "turn", "text")


@query("plain_prompts", "L11 F10", """
SELECT doc_id AS user_id, md5('### Instruction:' || chr(10) || 'Recommend an item.' || chr(10) || chr(10) || '### Input:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10)) AS prompt,
 md5('Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.' || chr(10) || chr(10)
  || '### Instruction:' || chr(10) || 'Recommend an item.' || chr(10) || chr(10) || '### Input:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) || lang) AS alpaca FROM documents""")
def _(t):
    plain = N.plain_prompts(light_instructions(t)).withColumnRenamed("prompt", "plain")
    both = N.alpaca_prompts(plain, label="output")
    return both.select("user_id", F.md5(F.col("plain").cast("binary")).alias("prompt"), F.md5(F.col("prompt").cast("binary")).alias("alpaca"))


@query("budgeted_neighbour_text", "L12", f"""@ {with_parts(RETRIEVAL)},
 p AS (SELECT r.user_id, r.neighbor_id, 400 + r.user_id % 100 AS base FROM retrieval r WHERE split = 'test' AND rank = 1),
 w AS (SELECT e.user_id AS neighbor_id, e.pos, ' ' || CASE WHEN e.domain = 'X' THEN 'art:' ELSE 'office:' END || i.title || ' |' AS piece,
  coalesce(sum(len(string_split(i.title, ' ')) + 1) OVER (PARTITION BY e.user_id ORDER BY e.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked e JOIN items i USING (item_id)) @
SELECT p.user_id, 'There is another similar user who has played arts or office before:' || coalesce(string_agg(piece, '' ORDER BY pos) FILTER (base + 12 + before < 512), '') AS few_shot
FROM p JOIN w USING (neighbor_id) GROUP BY p.user_id""")
def _(t):
    pairs = test_retrieval(t).filter("rank = 1").select("user_id", "neighbor_id", (F.lit(400) + F.col("user_id") % 100).alias("base_words"))
    return N.budgeted_neighbour_text(pairs, t.ev, t.items)


def _attribute_sql():
    parts = {"title": "title", "description": "''", "category": "category"}
    return f"SELECT item_id, domain, {fill_sql(C.ATTRIBUTE_EN, **parts)} AS prompt FROM (SELECT p_partkey AS item_id, CASE WHEN p_partkey < 50 THEN 'X' ELSE 'Y' END AS domain, p_name AS title, p_type AS category FROM part)"


@query("attribute_prompts", "L13 F10", _attribute_sql())
def _(t):
    part = t.table("part").select(
        F.col("p_partkey").alias("item_id"), S.domain_by_threshold(F.col("p_partkey"), 50).alias("domain"),
        F.col("p_name").alias("title"), F.lit("").alias("description"), F.col("p_type").alias("category"))
    return N.attribute_prompts(part)


def echo_model(prompts):
    """A deterministic stand-in for a model: fails on prompts with an odd number of words."""
    if any(len(p.split(" ")) % 2 for p in prompts):
        raise ValueError("odd prompt")
    return [p[:20].upper() for p in prompts]


@query("model_answers", "UD1 L15", """
SELECT item_id, CASE WHEN len(string_split(prompt, ' ')) % 2 = 0 THEN upper(left(prompt, 20)) END AS prediction, CASE WHEN len(string_split(prompt, ' ')) % 2 = 1 THEN 'ValueError: odd prompt' END AS error
FROM (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN 'Item ' || p_name ELSE 'An item ' || p_name || ' ' || p_type END AS prompt FROM part)""")
def _(t):
    made = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Item "), "p_name")).otherwise(
        F.concat(F.lit("An item "), "p_name", F.lit(" "), "p_type"))
    rows = t.table("part").select(F.col("p_partkey").alias("item_id"), made.alias("prompt"))
    return N.call_model(rows, echo_model).drop("prompt")


@query("prompt_history", "F14 P12", f"@ {SPLITS} @" + """
SELECT split, user_id, string_agg('X' || i.title, '|' ORDER BY p) AS titles, count(*) AS n FROM (SELECT split, user_id, unnest(seq[greatest(len(seq)-14,1):len(seq)]) AS item_id,
 generate_subscripts(seq[greatest(len(seq)-14,1):len(seq)], 1) AS p FROM ins) JOIN items i USING (item_id) GROUP BY 1, 2""")
def _(t):
    rows = S.implicit_target(splits(t))
    history = N.history_texts(rows, t.items, keys=("split", "user_id"))
    text = F.concat(F.lit("intro\n=== Interaction History ===\n"), "history", F.lit("\n\n=== Preference Summary ===\n  [X] no"))
    parsed = history.select("split", "user_id", T.history_events(text).alias("h"))
    return parsed.select("split", "user_id", F.concat_ws("|", F.transform("h", lambda e: F.concat(F.lit("X"), e["title"]))).alias("titles"),
                         F.size("h").cast("long").alias("n"))
