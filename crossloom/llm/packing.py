"""Sum-of-squares online packing of documents into token windows.

Each task packs the documents of its partition in their order. A level array
counts the partially filled windows per fill level; a document goes where the
sum of the squared counts ends up smallest, which keeps any level from piling
up. Longer documents first fill whole windows of their own. Windows still open
at the end (or when too many are open) are cut again and filled one after the
other, and the last of them is cut at powers of two, which need no padding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.llm.common import raw_text, text_batches

LENGTH = 2048
OPEN_WINDOWS = 4096  # open windows a task holds before it cuts them again
VOCABULARY = "byte_bpe_50k"
SEPARATOR = 1


class Packer:
    """Sum-of-squares packing of items given one at a time; whole windows leave as lists of (item, from, to)."""

    def __init__(self, length: int = LENGTH, open_windows: int = OPEN_WINDOWS):
        import numpy as np

        self.length, self.limit, self.open = length, open_windows, 0
        self.counts = np.zeros(length + 1, np.int64)  # windows per level; a full window counts for nothing
        self.windows: list[list] = [[] for _ in range(length)]

    def level_for(self, size: int) -> int:
        """Level of the window that ``size`` tokens go into, 0 for a new one. Of equal sums the fullest level wins."""
        import numpy as np

        n, top = self.counts, self.length - size
        change = 2 * (n[size : size + top + 1] - n[: top + 1]) + 2
        change[0] = 2 * n[size] + 1
        change[top] -= 2 * n[self.length] + 1  # that window is full and leaves the array
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def add(self, item, start: int, size: int) -> list[list]:
        """Place ``size`` tokens of ``item`` from ``start`` on; the windows that became full."""
        full = []
        if size < 0:
            raise ValueError("a negative size")
        while size >= self.length:
            full.append([(item, start, start + self.length)])
            start, size = start + self.length, size - self.length
        if not size:
            return full
        level = self.level_for(size)
        window = self.windows[level].pop() if level else []
        window.append((item, start, start + size))
        self.counts[level] -= level > 0
        self.open -= level > 0
        if level + size == self.length:
            return [*full, window]
        self.counts[level + size] += 1
        self.windows[level + size].append(window)
        self.open += 1
        return full + (self.rest(False) if self.open > self.limit else [])

    def rest(self, last: bool = True) -> list[list]:
        """Cut the open windows again into full ones; with ``last`` also what remains, at powers of two."""
        pieces = [p for level in self.windows for w in level for p in w]
        left = sum(b - a for _, a, b in pieces)
        self.__init__(self.length, self.limit)
        out, window, room = [], [], 0
        for item, a, b in pieces:
            while a < b:
                if not room and left < self.length and not last:
                    self.windows[b - a].append([(item, a, b)])  # goes on in an open window
                    self.counts[b - a] += 1
                    self.open += 1
                    break
                if not room:
                    room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
                step = min(room, b - a)
                window.append((item, a, a + step))
                a, room, left = a + step, room - step, left - step
                if not room:
                    out.append(window)
                    window = []
        return out


def encoder(vocabulary: str = VOCABULARY):
    """Function from a text to its ids (numpy, unsigned 32 bit).

    Reads the rank file, which holds the same vocabulary as the tokenizers
    file of that name and gives the same ids several times faster. As there,
    the string of the special token in a text is that token.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": len(ranks)}
    encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY,
         with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row per piece.

    Texts stay where they are: a partition is packed in one pass, and its
    number is the high part of ``sequence_id``. A task that runs again packs
    the same rows in the same order, as long as ``docs`` reads stored files.
    NULL and empty texts are the separator alone; repeated rows are packed
    each. Open windows and the tokens in them are all that a task holds.
    """

    def task(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, packer = encoder(vocabulary), Packer(length)
        sequence = TaskContext.get().partitionId() << 32
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        kinds = [kind, *[pa.int64()] * 6] + [pa.list_(pa.int64())] * with_ids

        def rows(windows):
            nonlocal sequence
            for window in windows:
                offset = 0
                for (doc, total, base, ids), a, b in window:
                    own = ids[a - base : b - base]
                    yield (doc, a, b - a, zlib.crc32(own.tobytes()), total, sequence, offset, *([own.tolist()] if with_ids else []))
                    offset += b - a
                sequence += 1

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

        for b in text_batches(batches):
            found = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(raw.decode("utf-8", "replace")), np.uint32(SEPARATOR)).astype("<u4")
                whole = len(ids) // length * length
                found += rows(packer.add((doc, len(ids), 0, ids), 0, whole))
                found += rows(packer.add((doc, len(ids), whole, ids[whole:].copy()), whole, len(ids) - whole))
            if found:
                yield batch(found)
        found = list(rows(packer.rest()))
        if found:
            yield batch(found)

    from pyspark.sql.pandas.types import to_arrow_type

    own = docs.schema[id_col].dataType
    kind = to_arrow_type(own)
    schema = f"id {own.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return raw_text(docs, F.col(id_col).alias("id"), text=text_col).mapInArrow(task, schema + ", ids array<bigint>" * with_ids)


def query(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
