import hashlib
import random
from zlib import crc32

import pytest

from crossloom.llm import periodic
from llm_helpers import ODD, doc


def brute(words, min_length=6, min_exponent=4):
    """Stretches of equal words q apart, for every q; the smallest q of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def row(d, text):
    words = (text or "").encode().split()
    h, n = crc32(b"" if d is None else str(d).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (d, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def repetitive(seed, n=150):
    r = random.Random(seed)
    for _ in range(n):
        words = []
        for _ in range(r.randrange(6)):
            words += [str(r.randrange(r.choice([1, 2, 3, 8]))) for _ in range(r.randrange(1, 12))] * r.randrange(1, 8)
        yield words


@pytest.mark.parametrize("limits", [(6, 4), (1, 2), (2, 3), (30, 2)])
def test_word_runs_match_brute_force(limits):
    texts = list(repetitive(5))
    assert periodic.word_runs(texts, *limits) == [brute(t, *limits) for t in texts]


def test_words_of_fibonacci():
    a, b = ["a"], ["a", "b"]
    while len(b) < 1500:
        a, b = b, b + a
    assert periodic.word_runs([b], 1, 2) == [brute(b, 1, 2)]


def test_long_run_of_one_word():
    assert periodic.word_runs([["x"] * 200_000, ["x", "y"] * 50_000]) == [[(0, 200_000, 1)], [(0, 100_000, 2)]]


def test_query_rows(documents):
    rows = [doc(i, " ".join(w)) for i, w in enumerate(repetitive(9))] + ODD
    got = periodic.digests(periodic.collapsed(periodic.planted(documents(rows)), batch_words=500)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((row(*r[:2]) for r in rows), key=str)


def test_kept_words(documents):
    got = {r.id: (r.n_words, bytes(r.kept)) for r in periodic.collapsed(documents([doc(1, "a b " * 5 + "c"), doc(2, "x " * 5), doc(3, None)])).collect()}
    assert got == {1: (11, b"a b c"), 2: (5, b"x x x x x"), 3: (0, b"")}


def test_empty_table_and_limits(documents):
    assert periodic.digests(periodic.collapsed(periodic.planted(documents([])))).collect() == []
    with pytest.raises(ValueError):
        periodic.collapsed(documents([]), min_exponent=1)
