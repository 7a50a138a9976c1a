import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from crossloom.llm import audit
from llm_helpers import ODD, doc

LABEL = "doc_id long, quality int, toxic int"


def fails(rows):
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        checks = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                  "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        yield d, lang or "", {k for k, v in checks.items() if v}


def brute(rows, labels):
    good, toxic = ({d for d, *x in labels if x[i] == 1} for i in range(2))
    docs = list(fails(rows))
    out = {}
    for part in {p for _, p, _ in docs}:
        own = [(d, f) for d, p, f in docs if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                failed = [x for x in own if name in x[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failed) - len(gone), sum(f == {name} for _, f in own),
                                                   sum(d in good for d, _ in gone if d is not None), sum(d in toxic for d, _ in gone if d is not None)]
    value = {}
    for (part, order, step), v in out.items():
        value[part, order[step - 1]] = value.get((part, order[step - 1]), 0) + v[1]
    return sorted((*k, *v, value[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def table(seed, n=150):
    r = random.Random(seed)
    texts = [" ".join((f"W{r.randrange(k)}" if r.random() < r.choice([0, 0.3]) else f"w{r.randrange(k)}") for _ in range(r.choice([3, 199, 200, 260])))
             + r.choice(["", "", " 5%"]) for k in (5, 50, 2000) for _ in range(25)]
    rows = [doc(i, r.choice(texts), r.choice(["en", "de", "", None])) for i in range(n)]
    rows += [doc(3, "another text under a known id"), doc(4, rows[5][1]), doc(4, rows[5][1]), doc(None, rows[6][1]), doc(None, rows[6][1]), *ODD]
    return rows, [(r.randrange(n), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(n)] + [(None, 1, 1)]


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("threshold", [None, "-1"])
def test_matches_brute_force(spark, documents, threshold):
    """Also without any broadcast, as on tables that are too large for one."""
    rows, labels = table(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if threshold:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = audit.audit(documents(rows).withColumn("good", F.lit("clash")), spark.createDataFrame(labels, LABEL), audit.quality_filters())
        got = sorted(tuple(r) for r in found.select(*COLUMNS).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute(rows, labels)


def test_shares_of_a_filter_add_up(spark, sf):
    got = audit.query(spark, sf).collect()
    last = [r for r in got if r.step == 5]
    assert len(got) == len(last) * 5 and len(last) % 120 == 0
    for part in {r.part for r in last}:
        assert len({r.kept for r in last if r.part == part}) == 1  # what survives all filters does not depend on their order
        lost = {r.filter_order[r.step - 1]: r.shapley for r in got if r.part == part}
        total = sum(r.removed for r in got if r.part == part and r.filter_order == "ABCDE")
        assert sum(lost.values()) == 120 * total


def test_other_filters(spark, documents):
    rows = [doc(1, "short"), doc(2, "a longer text"), doc(3, None), doc(4, "short")]
    found = audit.audit(documents(rows), spark.createDataFrame([], LABEL), {"x": F.length("text") < 6}, copies=None, part=F.lit("all"))
    assert [tuple(r) for r in found.select(*COLUMNS).collect()] == [("all", "x", 1, 2, 2, 0, 2, 0, 0, 2)]
    with pytest.raises(ValueError):
        audit.audit(documents(rows), spark.createDataFrame([], LABEL), {"xy": F.lit(True)})


def test_empty_table(spark, documents):
    assert audit.audit(documents([]), spark.createDataFrame([], LABEL), audit.quality_filters()).collect() == []
