import random

import numpy as np
from llm_helpers import ODD, doc

from crossloom.llm import toxicity


def corpus(n, seed):
    r = random.Random(seed)
    words, bad = [f"{a}{b}" for a in ("ta", "re", "mi", "sol") for b in ("ko", "na", "pu", "li", "so")], ["vileword", "badthing"]
    rows, labels = [], []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randrange(20, 90))]
        toxic = i % 4 == 0
        for _ in range(2 * toxic):
            own.insert(r.randrange(len(own)), r.choice(bad))
        rows.append(doc(i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(documents, spark):
    rows, labels = corpus(500, 1)
    table = spark.createDataFrame([*labels, (0, 1, None), (None, 1, 1), (7777, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(rows), table)
    fresh, truth = corpus(200, 2)
    got = {r.id: r.score for r in toxicity.score(documents(fresh), model).collect()}
    assert sum((got[i] >= 0.5) == bool(t) for i, _, t in truth) >= 195
    again = toxicity.train(documents(rows), table)
    assert np.allclose(model["network"].out, again["network"].out) and model["thresholds"] == again["thresholds"]


def test_score_of_a_long_text_does_not_depend_on_its_segments(monkeypatch):
    rows, labels = corpus(120, 3)
    model = toxicity.fit([(t, "en", toxicity.words_of(r[1])) for r, (_, _, t) in zip(rows, labels)])
    texts = ["tako " * 700 + "vileword badthing " + "reko " * 100, "", "tako", *[r[1] for r in rows[:20]]]
    whole = toxicity.scores(texts, dict(model))
    monkeypatch.setattr(toxicity, "SEGMENT", 5)
    assert np.allclose(whole, toxicity.scores(texts, dict(model)), atol=1e-5)


def test_odd_rows_and_no_labels(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(documents(ODD), none) is None
    one = spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.train(documents(ODD), one) is None
    assert {r.score for r in toxicity.score(documents(ODD), None).collect()} == {0.0}
    rows, labels = corpus(80, 4)
    model = toxicity.fit([(t, None, toxicity.words_of(r[1])) for r, (_, _, t) in zip(rows, labels)])
    got = toxicity.score(documents(ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(documents([]), model).collect() == []


def test_query_columns(spark, sf):
    out = toxicity.query(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 200 and all(r.predicted == int(r.score >= 0.5) for r in rows)
