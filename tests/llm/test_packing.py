import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import ODD, doc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crossloom.llm import packing


@pytest.mark.parametrize("seed", range(12))
def test_every_token_lies_in_one_piece(seed):
    r = random.Random(seed)
    length = r.choice([4, 8, 64, 2048])
    packer, out = packing.Packer(length, r.choice([1, 3, 4096])), []
    sizes = [r.randint(1, 3 * length if r.random() < 0.2 else length - 1) for _ in range(r.randrange(400))]
    for i, n in enumerate(sizes):
        out += packer.add(i, 0, n)
    rest = packer.rest()
    assert all(sum(b - a for _, a, b in w) == length for w in out)
    fills = [sum(b - a for _, a, b in w) for w in rest]
    assert all(f == length or f & (f - 1) == 0 for f in fills) and sum(f < length for f in fills) <= length.bit_length()
    pieces = {}
    for window in out + rest:
        for i, a, b in window:
            pieces.setdefault(i, []).append((a, b))
    for i, n in enumerate(sizes):
        own = sorted(pieces[i])
        assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:]))


@pytest.mark.parametrize("seed", range(5))
def test_level_minimises_the_sum_of_squares(seed):
    r = random.Random(seed)
    packer = packing.Packer(40)
    packer.counts[1:40] = [r.randint(0, 3) for _ in range(39)]

    def cost(level, size):
        n = packer.counts.copy()
        n[level] -= level > 0
        n[level + size] += 1
        return int((n[1:40] ** 2).sum())

    for size in range(1, 40):
        allowed = [h for h in range(41 - size) if h == 0 or packer.counts[h]]
        assert cost(packer.level_for(size), size) == min(cost(h, size) for h in allowed)


def check(rows, got, length=2048):
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append([*tokens.encode(t or "", add_special_tokens=False).ids, 1])
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert sum(r.length for r in got) == sum(len(x) for own in ids.values() for x in own)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.setdefault(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] += r.length
    assert all(n == length or n & (n - 1) == 0 and n < length for n in fill.values())


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, packing.query(spark, sf).collect())


def test_odd_rows_and_special_tokens(documents):
    rows = ODD + [doc(7, "a <|endoftext|> b"), doc(8, "x" * 30000), doc(9, "\x00\r\n\t ")]
    got = packing.pack(documents(rows)).withColumnRenamed("id", "doc_id").collect()
    check([(r[0], r[1]) for r in rows], got)


def test_ids_on_request(documents):
    got = packing.pack(documents([doc(1, "Some text"), doc(2, None)]), with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got) and got[0].ids[-1] == 1


def test_empty_table(documents):
    assert packing.pack(documents([])).filter(F.col("length") > 0).collect() == []
