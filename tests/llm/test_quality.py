import random
import re
from collections import Counter

import numpy as np
from llm_helpers import ODD, doc

from crossloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = [False] * len(words)
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            inside[i : i + 5] = [True] * 5
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, sum(inside)


def test_base_counts_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = quality.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert tuple(r[n] for n in quality.NAMES[:5]) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.query(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    clean = [r.kept for r in rows if labels[r.doc_id] == 1]
    junk = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert np.mean(clean) >= 0.999 and np.mean(junk) <= 0.6


def test_distance():
    p, q = np.array([[1, 1, 0], [2, 0, 0], [0, 0, 0]], float), np.array([[2, 2, 0], [0, 5, 0], [1, 1, 1]], float)
    assert np.allclose(quality.distance(p, q), [0, 1, 0])
    r = np.random.default_rng(1)
    p, q = r.random((5, 7)), r.random((5, 7))
    for d, a, b in zip(quality.distance(p, q), p / p.sum(1, keepdims=True), q / q.sum(1, keepdims=True)):
        m = (a + b) / 2
        assert abs(d - np.sqrt((a * np.log2(a / m)).sum() / 2 + (b * np.log2(b / m)).sum() / 2)) < 1e-12


def test_odd_rows(documents):
    r = random.Random(4)
    rows = ODD + [doc(10, " ".join(r.choice("abc") for _ in range(n)) + "\n\n \n# a\n# a") for n in (3, 9, 40)] + [doc(11, "tail |", None), doc(12, "x\x0by\x0cz", "qq")]
    got = quality.judged(documents(rows)).collect()
    assert sorted(tuple(x[n] for n in quality.NAMES[:5]) for x in got) == sorted(base(x[1]) for x in rows)
    assert quality.judged(documents([])).collect() == []


def test_sums_are_the_reference(documents):
    rows = quality.measured(documents([doc(1, "the a"), doc(2, "The b"), doc(3, "der 1", "de")]))
    refs = {r.lang: r for r in quality.references(rows).collect()}
    assert refs["en"].ref_chars == [7, 1, 0, 2, 0, 0, 0, 0, 0, 0] and refs["en"].ref_common[0] == 2 and sum(refs["en"].ref_common) == 4
    assert refs["de"].ref_chars[2] == 1
