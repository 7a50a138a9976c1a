import random

import pytest
from llm_helpers import ODD, doc, roots
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from crossloom.llm import langid
from crossloom.llm.queries import ORACLE, QUERIES

COLUMNS = list(pipeline.COLUMNS)


def test_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert names["pipeline"] is pipeline.run and set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_copies", "repeated_passages", "mix", "pack"]


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_odd_and_empty_tables(spark, documents, name, stage):
    out = stage(spark, documents(ODD), "")
    assert name == "pack" or out.columns == COLUMNS
    assert out.count() or name == "language"
    assert stage(spark, documents([]), "").count() == 0


def near_groups(rows):
    """Indexes of rows whose texts are linked by a Jaccard similarity of 0.8 over 5-word shingles."""
    sets = []
    for r in rows:
        w = [x.lower() for x in (r[1] or "").encode().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    edges = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[: i + 1]) if a == b or 5 * len(a & b) >= 4 * len(a | b)]
    out = {}
    for i, top in roots(edges).items():
        out.setdefault(top, []).append(i)
    return list(out.values())


def first_rows(rows):
    """One row of each group: the smallest id; any id comes before none."""
    return [min((rows[i] for i in g), key=lambda r: (r[0] is None, r[0] or 0)) for g in near_groups(rows)]


def without_repeats(rows, window=20):
    """Rows without the words of windows that start earlier; equal rows are one document, rows without an id come last."""
    seen, left = set(), {}
    for d, t in sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        left[d, t] = b" ".join(w for w, g in zip(words, gone) if not g).decode() if any(gone) else t
    return [(r[0], left[r[0], r[1]], r[2], r[3], len(left[r[0], r[1]]) if left[r[0], r[1]] != r[1] else r[4]) for r in rows]


def corpus():
    """Near copies, shared passages, rows without an id and rows under one id, in five sources."""
    r, rows = random.Random(8), []
    passage = [" ".join(f"p{k}x{i}" for i in range(60)) for k in range(3)]
    for i in range(40):
        words = [f"w{r.randrange(4000)}" for _ in range(r.randrange(30, 200))]
        rows.append(doc(i, " ".join(words), "en", f"s{i % 5}"))
        for share in (0.0, 0.005, 0.01, 0.1):
            rows.append(doc(r.choice([100 + i, 300 + len(rows), None]), " ".join("new" if r.random() < share else w for w in words), "en", f"s{i % 3}"))
        if i % 3 == 0:
            rows.append(doc(600 + i, f"{passage[i % 2]} {' '.join(reversed(words))} {passage[2]}", "en", "s1"))
    return rows


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_near_copies_and_repeats_against_brute_force(spark, documents):
    rows = corpus()
    one = [tuple(r) for r in pipeline.drop_near_copies(spark, documents(rows), "").collect()]
    want = first_rows(rows)
    assert sorted((str(r[0]) for r in one)) == sorted(str(r[0]) for r in want) and len(one) == len(near_groups(rows)) < len(rows)
    assert key(r for r in one if r[0] is not None and r[0] < 40) == key(r for r in want if r[0] is not None and r[0] < 40)
    named = [r for r in one if r[0] is not None]  # rows without an id are ordered among themselves by a hash
    assert key(pipeline.drop_repeats(spark, documents(named), "").collect()) == key(without_repeats(named))


def test_languages_against_plain_encodings(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model = langid.Model(langid.learn(langid.train_fold(docs)))
    clear = [r for r in rows if model.predict(r[1])[1] >= langid.MIN_MARGIN]
    assert key(pipeline.identify_language(spark, docs, sf).collect()) == key(clear) and len(clear) > 0.97 * len(rows)


def test_mix_repeats_rows_towards_the_targets(spark, documents):
    rows = [doc(i, "word " * (1 + i % 7), "en", "abc"[i % 3]) for i in range(900)]
    got = [tuple(r) for r in pipeline.mix_sources(spark, documents(rows), "").collect()]
    assert set(got) <= set(rows)
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "abc"}
    taken = {s: sum(len(r[1].split()) for r in got if r[3] == s) for s in "abc"}
    for s, weight in zip("abc", (1, 2, 3)):  # weights 1, 2, 3 of 6; no source is above three times its size
        target = sum(size.values()) * weight / 6
        assert target <= 3 * size[s] and abs(taken[s] - target) < 0.1 * target


def test_repeated_ids_keep_unlinked_texts(spark, documents):
    rows = [doc(1, "a b c d"), doc(1, "a b c d"), doc(2, "A b c d"), doc(3, "something else entirely"), doc(None, "a b c d"), doc(3, "and yet another text")]
    got = pipeline.drop_near_copies(spark, documents(rows), "").collect()
    assert key(got) == key([rows[0], rows[3], rows[5]])


def test_run_packs_what_the_stages_keep(spark, sf):
    out = pipeline.run(spark, sf)
    fill = {}
    for r in out.collect():
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert fill and all(n == 2048 or n & (n - 1) == 0 for n in fill.values())


def test_rows_are_judged_by_their_text(spark, documents):
    """Rows without an id, or with the id of another text, stay unless their texts are linked."""
    rows = [doc(None, "first text of nobody"), doc(None, "second text of nobody"), doc(None, "second text of nobody"), doc(7, "first text of nobody"),
            doc(8, "one text"), doc(8, "another one"), doc(9, "another one")]
    got = pipeline.drop_near_copies(spark, documents(rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, "second text of nobody"), (7, "first text of nobody"), (8, "one text"), (8, "another one")], key=str)


def test_near_copies_go_through_simhash(spark, documents, monkeypatch):
    """The classes of SimHash are what the stage starts from; what is not similar in a class stays."""
    copies = [doc(i, " ".join("new" if j == 40 * i else f"w{j}" for j in range(400))) for i in range(3)]
    rows = [*copies, doc(10, "some other text"), doc(11, "one more text of its own")]
    seen, given = [], pipeline.jaccard.components_of

    def classes(docs, **options):
        seen.append((options, docs.count()))
        keys = docs.select(options["id_col"]).distinct()
        low = keys.agg(F.min(options["id_col"]).alias("component"))  # all texts are one class
        return keys.crossJoin(low).select(F.col(options["id_col"]).alias("id"), F.lit(0).alias("fp"), "component")

    monkeypatch.setattr(pipeline.simhash, "near_duplicates", classes)
    monkeypatch.setattr(pipeline.jaccard, "components_of", lambda rows, close: seen.append(close.count()) or given(rows, close=close))
    got = pipeline.drop_near_copies(spark, documents(rows), "").collect()
    assert sorted(r.doc_id for r in got) == [0, 10, 11]
    assert seen == [({"id_col": "_d", "shingle": 5}, 5), 4]


def test_links_of_another_search_are_checked(spark):
    texts = {i: " ".join("new" if j == 40 * i else f"w{j}" for j in range(400)) for i in (1, 2)} | {3: "far away"}
    rows = spark.createDataFrame([(d, t.encode()) for d, t in texts.items()], "d long, _raw binary")
    close = spark.createDataFrame([(1, 2), (3, 2), (9, 1)], "d long, e long")
    got = {x.d: x.component for x in pipeline.jaccard.components_of(rows, close=close).collect()}
    assert got[1] == got[2] != got[3]
