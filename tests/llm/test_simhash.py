import random
import re

import numpy as np
import xxhash

from crossloom.llm import simhash
from llm_helpers import ODD, doc, roots


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [(d, plain(t)) for d, t in rows]
    edges = [(a, b) for a in {f for _, f in fp} for b in {f for _, f in fp} if (a ^ b).bit_count() <= 2]
    top = roots(edges)
    low = {}
    for d, f in fp:
        if d is not None:
            low[top[f]] = min(d, low.get(top[f], d))
    return sorted(((d, f"{f:016x}", low.get(top[f])) for d, f in fp), key=str)


def rows_of(df):
    return sorted(((r.id, f"{r.fp & (2**64 - 1):016x}", r.component) for r in df.collect()), key=str)


def texts(seed, n=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"W{r.randrange(500)}" for _ in range(r.randrange(300, 600))]
        out += [words, words]
        for _ in range(3):
            copy = list(words)
            copy[r.randrange(len(copy))] = "new"
            out.append(copy)
    return [doc(i, " ".join(w)) for i, w in enumerate(out)]


def test_matches_brute_force(documents):
    rows = texts(3) + ODD
    got = rows_of(simhash.near_duplicates(documents(rows)))
    assert got == brute([(r[0], r[1]) for r in rows])


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.query(spark, sf).collect()), key=str)
    assert got == brute(rows)


def test_crowded_cells_keep_every_link(spark):
    r = random.Random(5)
    centre = [r.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) for c in centre for _ in range(80)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = roots([(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2])
    from crossloom.llm.components import components

    for hot in (1024, 2):
        got = components(simhash.links(table, 2, hot_cell=hot)).collect()
        groups = {}
        for node, root in got:
            groups.setdefault(root, set()).add(node & (2**64 - 1))
        expected = {}
        for node, root in want.items():
            expected.setdefault(root, set()).add(node)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_cells_bound_the_distance():
    assert sum(simhash.WIDTHS) == 64
    assert len(simhash.offsets(2)) == 111 and simhash.offsets(0) == [0]


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
