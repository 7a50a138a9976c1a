import hashlib
import random
import re

import pytest

from crossloom.llm import decontaminate
from llm_helpers import ODD, doc

ITEM = "item_id long, text string"


def plain(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, window=10):
    found = []
    for d, t in rows:
        words, hit, names = plain(t), set(), set()
        for item, text in items:
            w = plain(text)
            n = min(window, len(w))
            own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in own:
                    hit |= set(range(i, i + n))
                    names |= {str(item)} if item is not None else set()
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        found.append((d, len(words), len(hit), len(names), digest, bool(hit)))
    return sorted(found, key=str)


def table(seed, n=80):
    r = random.Random(seed)
    items = [(i if i else None, " ".join(f"w{r.randrange(12)}" for _ in range(r.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(30)]
    items += [(5, "a second text under one id, of more than ten words as it happens"), (7, items[8][1]), (31, None), (32, "!!"), (33, "Über-Maß 日本 x")]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(5)):
            words += r.choice(items)[1].upper().split() if r.random() < 0.4 and r.choice(items)[1] else [f"u{r.randrange(9)}" for _ in range(r.randrange(20))]
        rows.append(doc(i, r.choice([" ", "\n", ", ", "\x00-"]).join(words)))
    rows += [doc(n, "The üBER maß: 日本 X, and more"), doc(n + 1, items[10][1]), doc(n + 1, items[10][1]), *ODD]
    return rows, items


@pytest.mark.parametrize("options", [{}, {"max_bytes": 0}])
def test_matches_brute_force(spark, documents, options):
    rows, items = table(3)
    found = decontaminate.contamination(documents(rows), spark.createDataFrame(items, ITEM), **options)
    got = sorted((tuple(r) for r in decontaminate.digests(found).collect()), key=str)
    assert got == brute([r[:2] for r in rows], items)
    assert any(r[5] for r in got) and any(not r[5] for r in got)


def test_hot_item(spark, documents):
    """One passage in every document and in every item."""
    items = [(i, "the same ten words are found in every item here and more") for i in range(300)]
    rows = [doc(i, f"{i} The same ten words are found in every item here {i}") for i in range(400)]
    got = decontaminate.digests(decontaminate.contamination(documents(rows), spark.createDataFrame(items, ITEM))).collect()
    assert {(r.n_hit, r.n_items) for r in got} == {(10, 300)}


def test_cleaned(spark, documents):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta gamma delta")], ITEM)
    rows = [doc(1, "Keep this, Alpha -- BETA; gamma delta! and this"), doc(2, "alpha beta"), doc(None, "alpha beta gamma"), doc(3, None)]
    got = {r.id: r.text for r in decontaminate.cleaned(documents(rows), bench).collect()}
    assert got == {1: "Keep this, ! and this", 2: "alpha beta", None: "", 3: ""}
    got = {r.id for r in decontaminate.cleaned(documents(rows), bench, "documents").collect()}
    assert got == {2, 3}
    got = {r.id for r in decontaminate.cleaned(documents(rows), bench, "documents", max_hit=3).collect()}
    assert got == {2, 3, None}
    with pytest.raises(ValueError):
        decontaminate.cleaned(documents(rows), bench, "all")


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], ITEM)
    assert decontaminate.contamination(documents([]), none).count() == 0
    got = decontaminate.digests(decontaminate.contamination(documents(ODD), none)).collect()
    assert len(got) == len(ODD) and not any(r.contaminated for r in got)
