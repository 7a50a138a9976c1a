"""Column functions and per-row metrics on hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from crossloom import constants as C
from crossloom.functions import ranking as R
from crossloom.functions import text as T
from crossloom.functions import vectors as V
from crossloom.operators import evaluation as E


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("fn,value,want", [
    (T.normalise, "\t Red  Ball\n", "red  ball"),
    (T.normalise_answer, "The  cat_sat, on a`the’ MAT!", "cat sat on mat"),
    (T.normalise_answer, "theatre an éa a", "theatre éa"),
    (T.alnum_tokens, "Ab-1 é x_y x_y", ["ab", "1", "x", "y", "x", "y"]),
    (T.words, "  a  b\ta ", ["a", "b", "a"]),
    (T.words, "   ", []),
    (T.word_set, "a b a", ["a", "b"]),
    (T.first_answer_line, "  OUTPUT:  Red ball \nmore", "Red ball"),
    (T.strip_special_tokens, "<s> x</s> ", "x"),
    (T.after_marker, "p ### Response: \n answer", "answer"),
    (T.after_marker, "no marker", ""),
    (T.loose_list, '["a", "", " b "]', ["a", "b"]),
    (T.loose_list, 'see ["a", "b"] ok', ["a", "b"]),
    (T.loose_list, "see [a, 'b', \"c\",] ok [d]", ["a", "b", "c"]),
    (T.loose_list, "nothing", []),
    (T.loose_list, "", []),
    (T.normalise_domain, " ENTERTAINMENT ", "Art"),
    (T.normalise_domain, "toys AND games", "Toys and games"),
    (T.normalise_domain, "", ""),
    (T.domain_axis, "Education", "Y"),
    (T.domain_axis, "anything", "X"),
])
def test_text(spark, fn, value, want):
    assert one(spark, fn(F.col("c")), c=value) == want


def test_attribute_answer(spark):
    a = one(spark, T.attribute_answer(F.col("c")), c='INTRODUCTION: a film\nATTRIBUTES: ["x", " y "]')
    assert (a.intro, a.attributes) == ("a film", ["x", "y"])
    assert one(spark, T.attribute_answer(F.col("c")), c='介绍: 好\n属性: ["甲"]').attributes == ["甲"]
    assert one(spark, T.attribute_answer(F.col("c")), c="I think [one, 'two']").attributes == ["one", "two"]


def test_history_events(spark):
    text = "=== User ===\n  [A] no\n=== Interaction History ===\n  [X] One \nskip\n [Y] Two [2]\n\n=== Preference Summary ===\n [X] no"
    assert [tuple(r) for r in one(spark, T.history_events(F.col("c")), c=text)] == [(1, "X", "One"), (2, "Y", "Two [2]")]
    assert one(spark, T.history_events(F.col("c")), c="nothing here") == []


def test_templates_fill_every_place(spark):
    assert one(spark, T.fill("a {x}-{y} {{z}}", x=F.lit(1), y="b")) == "a 1-b {z}"
    assert one(spark, T.percent(F.lit(0.1234))) == "12.3%"
    empty = F.array().cast("array<struct<value:string,n:int>>")
    assert one(spark, T.counted_text(empty)) == "None"


@pytest.mark.parametrize("p,t,want", [
    (" Red Ball", "red ball ", 1.0), ("ball", "red ball", 0.5), ("", "red ball", 0.5),
    ("red big ball", "ball big blue red", 0.3), ("a b", "b c", 0.0), ("zzz", "red ball", 0.0),
])
def test_fuzzy_score(spark, p, t, want):
    assert one(spark, R.fuzzy_score(F.col("p"), F.col("t")), p=p, t=t) == want


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.cosine(a, b)) == 0.0
    assert abs(one(spark, V.cosine(a, a)) - 1.0) < 1e-7
    assert one(spark, V.pair_similarity(a, b, "l2")) == -5.0
    s = one(spark, V.vector_stats(a))
    assert (s.mean, s.std, s.max, s.min, s.l2_norm) == (3.5, 0.5, 4.0, 3.0, 5.0)
    assert one(spark, V.midpoint(a, b)) == [1.5, 2.0] and one(spark, V.blend(a, b, F.lit(0.25))) == [2.25, 3.0]


def test_reciprocal_rank_example(spark):
    """Lists [3,1,2,4], [1,2,3,4], [4,2,3,1] with truths 2, 1, 3."""
    df = spark.createDataFrame([([3, 1, 2, 4], 2), ([1, 2, 3, 4], 1), ([4, 2, 3, 1], 3)], "l array<int>, t int")
    m = E.ranking_metrics(df.select(F.array_position("l", F.col("t")).alias("rank"))).first()
    assert m.mrr == round(5 / 9, 6)


def test_accuracy_examples(spark):
    df = spark.createDataFrame(zip([0, 1, 1, 2, 1, 0], [0, 1, 2, 0, 1, 2], [0.5, 2.0, 0.7, 0.5, 9.0, 0.4]), "p int, r int, w double")
    assert tuple(E.accuracy(df, "p", "r").first()) == (0.5, 3.0)
    assert E.accuracy(df, "p", "r", "w").first().accuracy == 0.877863


def test_metrics_of_nothing_are_zero(spark):
    empty = spark.createDataFrame([], "rank int")
    m = E.ranking_metrics(empty).first().asDict()
    assert set(m.values()) == {0}


def test_metric_invariants(spark):
    ranks = spark.range(500).select(F.when(F.col("id") % 7 != 0, F.col("id") % 30 + 1).alias("rank"))
    m = E.ranking_metrics(ranks).first()
    hits = [m[f"hr_{k}"] for k in C.CUTOFFS]
    assert hits == sorted(hits) and all(m[f"ndcg_{k}"] <= m[f"hr_{k}"] for k in C.CUTOFFS) and m.ndcg_1 == m.hr_1


def test_out_of_domain_counts(spark):
    from crossloom.operators.catalogue import title_index

    items = spark.createDataFrame([(1, "A", "art"), (2, "a", "office"), (3, "b", "Education"), (4, " ", "art")], "item_id int, title string, domain string")
    rows = spark.createDataFrame([("a", "Office"), ("A ", "Entertainment"), ("b", "office"), ("?", "art")], "prediction string, target_domain string")
    assert tuple(E.out_of_domain_rate(rows, title_index(items)).first()) == (0.375, 1.5, 4)


def test_perplexity_overflow(spark):
    assert one(spark, E.perplexity(F.lit(1000.0))) == math.inf
    assert abs(one(spark, E.perplexity(F.lit(1.0))) - math.e) < 1e-12


def test_set_precision(spark):
    i = lambda *v: F.array(*[F.lit(x) for x in v])
    s = one(spark, R.set_precision(i(1, 2, 3), i(2, 3, 4, 4)))
    assert (round(s.precision, 6), round(s.recall, 6), round(s.f1, 6)) == (0.666667, 0.666667, 0.666667)
    assert tuple(one(spark, R.set_precision(i(1), i(2)))) == (0.0, 0.0, 0.0)


def test_hit_rate_and_quality(spark):
    events = spark.createDataFrame([(10, 1), (10, 2), (11, 3), (12, 9)], "user_id int, item_id int")
    truth = spark.createDataFrame([(1, 3), (2, 5)], "user_id int, item_id int")
    found = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.2), (2, 1, 12, 0.1)], "user_id int, rank int, neighbor_id int, score double")
    assert tuple(E.user_hit_rate(found, truth, events).first()) == (0.0, 0.5, 0.5, 2)
    q = E.retrieval_quality(found, truth, events, n=2).first()
    assert (q.n, q.hit_rate, q.mean_len, q.confident, q.confident_hit_rate) == (2, 0.5, 2.0, 1, 1.0)
