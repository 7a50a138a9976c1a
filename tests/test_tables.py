"""Feature tables, instructions, graphs, reports, model calls."""

import pytest
from pyspark.sql import functions as F

from crossloom import constants as C
from crossloom.operators import features as X
from crossloom.operators import graph as G
from crossloom.operators import instructions as N
from crossloom.operators import profiles as P
from crossloom.operators import reporting as R

EXAMPLE = [0, 28442, 1, 22560, 2, 18805, 3, 20729, 4, 21806, 5, 6, 7, 8, 22212]
NX, NY = 18639, 19757
PAD = NX + NY


def events(spark, items, user=1):
    data = [(i, user, i, item, "X" if item < NX else "Y") for i, item in enumerate(items)]
    return spark.createDataFrame(data, "event_id long, user_id long, ts long, item_id int, domain string")


def test_padded_training_example(spark):
    """The worked trace of a sequence of 15 events padded to 30."""
    r = X.training_features(events(spark, EXAMPLE), NX, NY, maxlen=30).first()
    lead = [PAD] * 16
    assert r.seq == lead + EXAMPLE[:-1]
    assert r.ground == lead + EXAMPLE[1:]
    assert r.xd == lead + [0, PAD, 1, PAD, 2, PAD, 3, PAD, 4, PAD, 5, 6, 7, PAD]
    assert r.yd == lead + [PAD, 28442, PAD, 22560, PAD, 18805, PAD, 20729, PAD, 21806, PAD, PAD, PAD, PAD]
    assert r.position == [0] * 16 + list(range(1, 15))
    assert r.x_pos == [0] * 16 + [1, 0, 2, 0, 3, 0, 4, 0, 5, 0, 6, 7, 8, 0]
    assert r.y_pos == [0] * 16 + [0, 1, 0, 2, 0, 3, 0, 4, 0, 5, 0, 0, 0, 0]
    assert r.share_x == [NX] * 17 + [1, NX, 2, NX, 3, NX, 4, NX, 5, 6, 7, 8, NX]
    assert r.share_y == [NY] * 16 + [9803, NY, 3921, NY, 166, NY, 2090, NY, 3167, NY, NY, NY, NY, 3573]
    assert r.x_label == [NX] * 16 + [1, NX, 2, NX, 3, NX, 4, NX, 5, NX, 6, 7, 8, NX]
    assert r.y_label == [NY] * 17 + [3921, NY, 166, NY, 2090, NY, 3167, NY, 3573, NY, NY, NY, NY]
    assert r.mask == [0] * 16 + [1] * 14
    assert r.share_x_mask == [0] * 17 + [1, 0, 1, 0, 1, 0, 1, 0, 1, 1, 1, 1, 0]
    assert r.x_mask == [0] * 16 + [1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 1, 1, 0]
    assert r.y_mask == [0] * 17 + [1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 0, 0, 0]
    slots = EXAMPLE[:-1]
    for given, x, y in zip(slots, r.corrupt_x[16:], r.corrupt_y[16:]):
        assert (x == given and 0 <= y < NX) if given < NX else (y == given and NX <= x < PAD)


def test_users_without_label_in_one_domain_are_left_out(spark):
    only_x = events(spark, [1, 2, 3, 4])
    late_y = events(spark, [1, 20000, 2, 3], user=2)  # its only Y slot has no Y item after it
    fine = events(spark, [1, 20000, 2, 20001], user=3)
    got = X.training_features(only_x.unionByName(late_y).unionByName(fine), NX, NY, maxlen=5)
    assert [r.user_id for r in got.collect()] == [3]


def test_evaluation_features(spark):
    ev = events(spark, [5, 20000, 6])
    target = spark.createDataFrame([(1, 20001, "Y")], "user_id long, item_id int, domain string")
    r = X.evaluation_features(ev, target, NX, NY, maxlen=5).first()
    assert (r.seq, r.position, r.x_pos) == ([PAD, PAD, 5, 20000, 6], [0, 0, 1, 2, 3], [0, 0, 1, 0, 2])
    assert (r.x_last, r.y_last, r.flag, r.target) == (-1, -2, 1, 20001 - NX)
    long = X.evaluation_features(events(spark, list(range(40))), target, NX, NY, maxlen=15).first()
    assert long.seq == list(range(25, 40)) and long.y_last == -1


def test_negatives_never_hit_the_target(spark):
    t = spark.createDataFrame([(u, u % 3, "X") for u in range(30)] + [(99, 4, "Y")], "user_id long, item_id int, domain string")
    for r in X.negatives(t, 3, 3).collect():
        target = 1 if r.user_id == 99 else r.user_id % 3
        assert len(r.negatives) == C.NEGATIVES and set(r.negatives) == {0, 1, 2} - {target}


@pytest.mark.parametrize("n,size,want", [(10, 4, 12), (8, 4, 8), (3, 10, 3)])
def test_batches_wrap_around(spark, n, size, want):
    got = X.batches(spark.range(n), "id", size).collect()
    assert len(got) == want and {r.id for r in got} == set(range(n))
    per = {}
    for r in got:
        per.setdefault(r.batch, set()).add(r.slot)
    assert all(slots == set(range(min(size, n))) for slots in per.values())


def test_token_packing(spark):
    a = lambda *v: F.array(*[F.lit(x) for x in v])
    p = spark.range(1).select(X.pack_tokens(a(5, 6), 4).alias("p"), X.pack_tokens(a(5, 6, 7), 2).alias("q")).first()
    assert (p.p.input_ids, p.p.attention, p.p.labels) == ([5, 6, 0, 0], [1, 1, 0, 0], [5, 6, -100, -100])
    assert p.q.input_ids == [5, 6]
    m = spark.range(1).select(X.pack_with_prompt(a(1, 2), a(1, 2, 3), 9, 5).alias("m"), X.pack_with_prompt(a(1), a(1, 2, 3), 9, 3).alias("c")).first()
    assert (m.m.input_ids, m.m.labels) == ([1, 2, 3, 9], [-100, -100, 3, 9])
    assert (m.c.input_ids, m.c.labels) == ([1, 2, 3], [-100, 2, 3])


def test_graph(spark, rows):
    ev = events(spark, [1, 2, 1, 2, 20000])
    edges = G.transition_graph(ev)
    assert rows(edges) == [(1, 2, 2), (2, 1, 1), (2, 20000, 1)]
    norm = G.normalise_rows(edges)
    assert all(abs(r[0] - 1) < 1e-12 for r in norm.groupBy("src").agg(F.sum("weight")).select("sum(weight)").collect())
    f = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (20000, [2.0, 2.0]), (7, [3.0, 0.0])], "node int, embedding array<double>")
    got = {r.node: r.embedding for r in G.propagate(norm, f, layers=1).collect()}
    assert got == {1: [0.5, 0.5], 2: [0.75, 1.0], 20000: [1.0, 1.0], 7: [1.5, 0.0]}


def test_attribute_graph(spark, rows):
    items = spark.createDataFrame([(0, "X", "a"), (1, "X", "a"), (2, "Y", "a"), (3, "Y", "b"), (4, "Y", "b"), (0, "X", "c")], "item_id int, domain string, token string")
    users = G.default_tokens(spark.createDataFrame([(1,), (2,)], "user_id int"), spark.createDataFrame([(1, "a")], "user_id int, token string"))
    assert rows(users) == [(1, "a"), (2, "Game"), (2, "Movie")]
    fq = G.token_frequency(users, items)
    assert rows(G.kept_tokens(fq), "token", "users", "x_items", "y_items") == [("a", 1, 2, 1), ("b", 0, 0, 2)]
    assert rows(G.kept_tokens(fq, ignore_users=False)) == []
    g = G.attribute_graph(items, G.attribute_nodes(G.kept_tokens(fq), 5, 2))
    assert rows(g.filter("graph = 'source'"), "src", "dst") == [(7, 0), (7, 1)]
    assert rows(g.filter("graph = 'target'"), "src", "dst") == [(3, 8), (4, 8)]
    assert g.filter("graph = 'full'").count() == 10


def test_preferences_break_ties_by_first_occurrence(spark, rows):
    ev = events(spark, [3, 1, 2, 1])
    values = spark.createDataFrame([(3, 0, "z"), (3, 1, "y"), (1, 0, "a"), (2, 0, "b")], "item_id int, pos int, value string")
    r = P.preferences(ev, values, 3).first()
    assert [tuple(e) for e in r.preferred] == [("a", 2), ("z", 1), ("y", 1)] and r.diversity == 4


def test_behaviour_of_unknown_users(spark):
    out = {r.user_id: r for r in P.behaviour(events(spark, [1, 2, 20000]), spark.createDataFrame([(1,), (5,)], "user_id long")).collect()}
    assert out[1].recent_items == [1, 2, 20000] and abs(out[1].cross_ratio - 2 / 3) < 1e-12
    assert (out[5].total, out[5].cross_ratio, out[5].recent_items) == (0, 0.0, [])


def test_display_pool_is_filled(spark, rows):
    users = spark.createDataFrame([(i, "X", i) for i in range(20)], "user_id long, domain string, line long")
    titles = spark.createDataFrame([(0, "a"), (0, "b"), (3, "a"), (4, "b"), (4, "a")] + [(i, f"t{i}") for i in range(5, 20)], "user_id long, title string")
    pool, demo = R.display_pool(users)
    out = R.pool_with_fill(demo.filter("user_id = 0"), pool, titles).orderBy("place").collect()
    assert [(r.similar_id, r.similarity) for r in out[:3]] == [(4, 1.0), (3, 0.5), (1, 0.0)]
    assert len(out) == 15 and [r.selected for r in out] == [True] * 5 + [False] * 10


def instruction_inputs(spark):
    items = spark.createDataFrame([(1, "One", "Entertainment"), (2, "Two", "Education")], "item_id int, title string, domain string")
    e = "struct<item_id:int,domain:string>"
    splits = spark.createDataFrame(
        [("train", 1, [(1, "Entertainment"), (2, "Education"), (7, "Education")], None), ("test", 2, [(1, "Entertainment")], (2, "Education")), ("train", 3, [(1, "Entertainment")], None)],
        f"split string, user_id int, seq array<{e}>, target {e}")
    profile = spark.createDataFrame(
        [(1, 3, 1, 2, [("a", 2)], [], "N/A")],
        "user_id int, total long, x_count long, y_count long, preferred_attributes array<struct<value:string,n:long>>, preferred_categories array<struct<value:string,n:long>>, similar_items string")
    return items, splits, profile


def test_instruction_rows(spark):
    items, splits, profile = instruction_inputs(spark)
    out = {r.user_id: r for r in N.instruction_rows(splits, profile, items).collect()}
    assert set(out) == {1, 2}  # user 3 is too short
    assert (out[1].output, out[1].target_domain) == ("7", "Office") and "  [Art] One\n  [Office] Two\n" in out[1].input
    assert "Top attributes: a(2)\nTop categories: None" in out[1].input and "Instruction:" not in out[1].input
    assert out[2].output == "Two" and "=== User Profile ===\nN/A" in out[2].input
    few = spark.createDataFrame([(2, "line")], "user_id int, few_shot string")
    got = {r.user_id: r.input for r in N.instruction_rows(splits, profile, items, few, template="cot").collect()}
    assert "=== Similar Users ===\nline" in got[2] and "Think step by step" in got[1]
    base = {r.user_id: r.input for r in N.instruction_rows(splits, profile, items, template="base").collect()}
    assert base[1].startswith("Based on the user's interaction history") and "\nN/A\n" in base[1]


def test_chat_and_prompts(spark):
    items, splits, profile = instruction_inputs(spark)
    ins = N.instruction_rows(splits, profile, items)
    chat = N.chat_rows(ins).filter("user_id = 2").first()
    assert [m.role for m in chat.messages] == ["system", "user", "assistant"] and chat.messages[2].content == "Two"
    assert N.chat_prompts(N.chat_rows(ins)).filter("user_id = 2").first().prompt == chat.messages[1].content
    rows = spark.createDataFrame([("do", "in", "out"), ("do", "", "out")], "instruction string, input string, output string")
    got = [r.prompt for r in N.alpaca_prompts(rows, "output").collect()]
    assert got[0].endswith("### Input:\nin\n\n### Response:\nout") and got[1].endswith("### Instruction:\ndo\n\n### Response:\nout")


def test_few_shot_without_events(spark):
    items = spark.createDataFrame([(1, "One", "Art"), (2, "Two", None)], "item_id int, title string, domain string")
    ev = events(spark, [1, 2, 9])
    found = spark.createDataFrame([(5, 1, 1), (6, 1, 77)], "user_id int, rank int, neighbor_id long")
    out = {r.user_id: r.few_shot for r in N.few_shot_texts(found, ev, items, n=3).collect()}
    assert out[5] == C.SIMILAR_USER_PREFIX + "Art: One | Item: Two | Item: 9" and out[6] == C.NO_SIMILAR_USERS_FOUND


def test_model_calls_isolate_failures(spark):
    def model(prompts):
        if "bad" in prompts:
            raise RuntimeError("no answer")
        return [p.upper() for p in prompts]

    todo = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id int, prompt string").coalesce(1)
    out = {r.id: (r.prediction, r.error) for r in N.call_model(todo, model).collect()}
    assert out == {1: ("A", None), 2: (None, "RuntimeError: no answer"), 3: ("C", None)}


def test_rectangular_lists(spark, rows):
    df = spark.createDataFrame([(1, [5]), (2, [6, 7, 8])], "k int, v array<int>")
    assert [r.v for r in X.rectangular(df, "v").orderBy("k").collect()] == [[5, 0, 0], [6, 7, 8]]


def test_one_answer_at_ninety_percent(spark, rows):
    """A very frequent answer is counted before it is joined, and hits reach all of its rows."""
    from crossloom.operators import grounding as G

    old = spark.conf.get("spark.sql.adaptive.skewJoin.enabled")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        q = spark.range(1000).select(F.col("id").alias("q_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("blue hat "), F.col("id").cast("string"))).otherwise("red shoe").alias("q_text"))
        docs = spark.createDataFrame([(1, "red shoe"), (2, "blue hat"), (3, "  "), (4, "shoe of blue"), (5, "...")], "doc_id long, text string")
        got = G.bm25(q, docs, 2)
        assert {(r.doc_id, r.n) for r in got.filter("rank = 1").groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {(1, 900), (2, 100)}
        assert rows(G.postings(docs), "doc_id", "token", "tf", "doc_len") == [
            (1, "red", 1, 2), (1, "shoe", 1, 2), (2, "blue", 1, 2), (2, "hat", 1, 2), (4, "blue", 1, 3), (4, "of", 1, 3), (4, "shoe", 1, 3)]
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", old)


def test_rows_of_the_display_are_computed_once(spark, tmp_path):
    """Pool and demo users are read from what was written; no later step goes through events and catalogue again."""
    from crossloom.plans.q_reporting import demo
    from crossloom.plans.views import Tables

    spark.createDataFrame([(i, f"2024-01-{1 + i % 28:02d} 10:00:00", i % 6, "view", 1.0, f'{{"k": {i * 7 % 90}}}') for i in range(60)],
                          "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i,) for i in range(9)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, f"thing {i}", "b", "t") for i in range(100)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    t = Tables(spark, str(tmp_path))
    pool, users = demo(t)
    for df in (pool, users):
        assert df.count() == 6 and not df.inputFiles()
    titles = t.ev.join(t.items.select("item_id", "title"), "item_id").select("user_id", "title")
    out = R.pool_with_fill(users, pool, titles)
    assert out.count() == 6 * 5 and not any(str(tmp_path) in f for f in out.inputFiles())
