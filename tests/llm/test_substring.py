import hashlib
import random

import pytest

from crossloom.llm import substring
from llm_helpers import ODD, doc


def brute(rows, window=20):
    """One row per (id, text); equal rows are one document."""
    seen, lost = set(), {}
    for d, t in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0)):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = b" ".join(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        lost[d, t] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return sorted(((d, *lost[d, t]) for d, t in rows), key=str)


def passages(seed, n=120):
    r = random.Random(seed)
    pool = [[f"w{r.randrange(40)}" for _ in range(r.randrange(15, 70))] for _ in range(12)]
    out = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(1, 5)):
            words += r.choice(pool)[: r.randrange(10, 80)] if r.random() < 0.5 else [f"u{r.randrange(9999)}" for _ in range(r.randrange(40))]
        out.append(doc(i, r.choice([" ", "\n", "  \t"]).join(words)))
    return out + [doc(n + i, "same " * r.randrange(60)) for i in range(10)] + [doc(n + 50 + i, "a b " * r.randrange(30)) for i in range(10)]


@pytest.mark.parametrize("options", [{}, {"leaves_per_prefix": 2}, {"gram": 4}])
def test_matches_brute_force(documents, options):
    rows = passages(7)
    got = sorted((tuple(r) for r in substring.digests(documents(rows), **options).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in rows])


def test_odd_rows(documents):
    rows = ODD + [doc(7, "word " * 25), doc(None, "word " * 25)]
    got = sorted((tuple(r) for r in substring.digests(documents(rows)).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in rows])


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in substring.query(spark, sf).collect()), key=str) == brute(rows)


def test_empty_table(documents):
    assert substring.digests(documents([])).collect() == []


def test_window_shorter_than_gram(documents):
    with pytest.raises(ValueError):
        substring.repeats(documents(ODD), window=4)
