"""Shape of the plans that the findings of round 3 were about, and the rows they must still give."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from crossloom.operators import grounding as G
from crossloom.operators import profiles as P


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_user_means_keep_one_row_per_user_and_domain(spark, rows):
    """no row per dimension; NULL vectors and NULL components count as before."""
    events = spark.createDataFrame([(1, "X", 1), (1, "X", 1), (1, "X", 2), (1, "Y", 3), (2, "X", 4), (3, "X", 9), (4, "X", 5), (None, "X", 1)], "user_id long, domain string, item_id int")
    items = [(1, [1.0, 2.0]), (2, [4.0, None]), (3, [0.0, 1.0]), (4, None), (5, [None, None])]
    vectors = spark.createDataFrame(items, "item_id int, embedding array<float>")
    means = P.user_means(events, vectors)
    assert "posexplode" not in plan(means)
    want = [(1, "X", [2.0, 4.0 / 3]), (1, "Y", [0.0, 1.0]), (4, "X", [None, None]), (None, "X", [1.0, 2.0])]
    as_key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([tuple(r) for r in means.collect()], key=as_key) == want
    unlike = vectors.unionByName(spark.createDataFrame([(9, [7.0, 8.0, 9.0])], vectors.schema))
    got = P.user_means(events, unlike)
    assert sorted([tuple(r) for r in got.collect()], key=as_key) == sorted([*want, (3, "X", [7.0, 8.0, 9.0])], key=as_key)
    assert P.user_means(events, vectors.limit(0)).collect() == []


def test_counts_of_tokens_are_not_shuffled(spark, rows):
    """texts of many splits move, by id; their counts do not. Rows that share an id are one text where their lengths agree."""
    texts = [(1, "a b a"), (2, "B c"), (2, "b d"), (3, " "), (4, "!"), (None, "a a"), (None, "a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(20)
    counted = G._counted(docs, "doc_id", "text")
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, token", plan(counted))
    got = rows(G.postings(docs).filter(F.col("doc_id").isNotNull()), "doc_id", "token", "tf", "doc_len")
    assert got == [(1, "a", 2, 3), (1, "b", 1, 3), (2, "b", 2, 2), (2, "c", 1, 2), (2, "d", 1, 2)]
    assert rows(G.postings(docs).filter(F.col("doc_id").isNull()), "token", "tf", "doc_len") == [("a", 1, 1), ("a", 2, 2)]
