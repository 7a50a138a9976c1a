"""What stages leave in the shared folder: tables of steps that are over are deleted, with the rows as before."""

import os
import random

import pytest

import corpus_pipeline as pipeline
from crossloom.llm import substring
from crossloom.session import ensure_checkpoint_dir
from llm_helpers import ODD, doc


@pytest.fixture
def left(spark):
    """Names of the tables in the shared folder that were not there when the test began."""
    ensure_checkpoint_dir(spark)
    top = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).removeprefix("file:")
    names = lambda: {x for x in os.listdir(top) if len(x.rpartition("-")[2]) == 32}
    before = names()
    return lambda: sorted(x.rpartition("-")[0] for x in names() - before)


def corpus():
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = []
    for i in range(30):
        words = [f"w{r.randrange(3000)}" for _ in range(120)]
        rows += [doc(10 * i + j, " ".join("new" if r.random() < 0.01 * j else w for w in words)) for j in range(3)]
        rows.append(doc(10 * i + 5, f"{' '.join(reversed(words))} {passage} end {i}"))
    return [*rows, *ODD, rows[3], rows[7]]


def test_near_copies_keep_only_what_the_result_reads(documents, left, spark):
    assert pipeline.drop_near_copies(spark, documents(corpus()), "").count()
    assert left() == ["equal-rows", "leads"]


def test_repeated_passages_keep_only_what_the_result_reads(documents, left, spark):
    assert pipeline.drop_repeats(spark, documents(corpus()), "").count()
    assert left() == ["removed"]


@pytest.mark.parametrize("options", [{}, {"leaves_per_prefix": 2}])
def test_texts_without_repeats_agree_with_the_cuts(documents, left, options):
    """Every row is there once, with what the cuts leave of its text; rows that lose nothing have none."""
    rows = corpus()
    got = substring.without_repeats(documents(rows), **options).collect()
    assert left() == ["removed"]
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(rows, key=str)
    cut = {(x.k, x.n_removed, bytes(x.kept)) for x in substring.cuts(documents(rows), **options).collect()}
    lost = {(x.doc_id, len((x.text or "").split()) - len(x.kept.split()), bytes(x.kept)) for x in got if x.kept is not None}
    assert lost == cut and len(cut) > 29 and all(n > 0 for _, n, _ in lost)
    assert left() == ["flagged", "removed", "removed"]
