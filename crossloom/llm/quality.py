"""Quality rules: base counts and divergence from a language's reference distributions.

Every text gives a histogram of character classes and one of common words.
The references are the sums over all texts of a language. A text that is long
enough is kept if the Jensen-Shannon distances of its histograms to the
references of its language stay below the limits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.llm.common import raw_text, text_batches, written
from crossloom.operators.ordering import fits_broadcast

SYMBOLS = "#*$%&|<>"
# Frequent function words of the languages, lower case.
COMMON_WORDS = (
    "the of and to in a is that it for was on be with as by he at from his an are this which or not have but her had "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "le la les et des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son "
    "el los que y del las se con una su por para al lo como más o pero sus ya sobre este si porque esta"
).split()
CHARACTER_CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "mark", "symbol", "letter beyond ASCII", "other beyond ASCII")
MIN_CHARS = 200  # shorter texts are not judged by their characters
MIN_WORDS = 40  # nor texts of fewer words by their words
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.60


def _byte_classes():
    """Character class of every leading byte of UTF-8; -1 for the bytes that continue a character."""
    import numpy as np

    kind = np.full(256, 9)
    kind[0x80:0xC0] = -1
    kind[0xC3:0xE0] = 8
    kind[:128] = 6
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t", 3), ("\n\r\x0b\x0c", 4), (".,;:!?'\"()-", 5), (SYMBOLS, 7)):
        kind[[ord(c) for c in chars]] = k
    return kind


def repeated_words(words, width: int = 5) -> int:
    """Words in windows of ``width`` words that the text holds at least twice, the first included."""
    import numpy as np

    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict = {}
    code = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    rank = code[:n]
    for j in range(1, width):  # ranks stay below the number of windows, so no product overflows
        rank = np.unique(rank * len(known) + code[j : n + j], return_inverse=True)[1]
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[width:] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measures(raw: bytes, classes=None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, character histogram, common-word histogram)."""
    from collections import Counter

    import numpy as np

    classes = _byte_classes() if classes is None else classes
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = np.bincount(classes[classes >= 0], counts[classes >= 0], minlength=len(CHARACTER_CLASSES)).astype(np.int64)
    blank = counts[[9, 10, 11, 12, 13, 32]].sum()
    symbols = counts[[ord(c) for c in SYMBOLS]].sum()
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.split():
            seen.add(line)
    found = Counter(raw.lower().replace(b".", b" ").replace(b",", b" ").split())
    common = [found[w] for w in (x.encode() for x in _distinct())]
    return len(words), int(counts[classes >= 0].sum() - blank), int(symbols), again, repeated_words(words), chars.tolist(), [*common, max(0, found.total() - sum(common))]


def _distinct() -> list[str]:
    return list(dict.fromkeys(COMMON_WORDS))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, the measures) of every whole text; NULL counts as empty."""

    def task(batches):
        import pyarrow as pa

        classes = _byte_classes()
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
        for b in text_batches(batches):
            cols = list(zip(*[measures(x, classes) for x in b.column(2).to_pylist()])) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["id", "lang", *NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = raw_text(docs, F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), text=text_col)
    return rows.mapInArrow(task, f"id {kind}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, chars array<bigint>, common array<bigint>")


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common")


def references(rows: DataFrame) -> DataFrame:
    """(lang, ref_chars, ref_common): sums of the histograms of all texts of a language."""
    sums = [F.sum(F.col(name)[i]).alias(f"{name}{i}") for name, n in (("chars", len(CHARACTER_CLASSES)), ("common", len(_distinct()) + 1)) for i in range(n)]
    total = rows.groupBy("lang").agg(*sums)
    pick = lambda name, n: F.array(*[F.col(f"{name}{i}") for i in range(n)]).alias(f"ref_{name}")
    return total.select("lang", pick("chars", len(CHARACTER_CLASSES)), pick("common", len(_distinct()) + 1))


def distance(p, q):
    """Jensen-Shannon distances (base 2, so 0 to 1) of the rows of two count matrices; empty rows are at 0."""
    import numpy as np

    p, q = p / np.maximum(p.sum(1, keepdims=True), 1), q / np.maximum(q.sum(1, keepdims=True), 1)
    m = (p + q) / 2

    def part(x):
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1)

    d = np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))
    return np.where((p.sum(1) > 0) & (q.sum(1) > 0), d, 0.0)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
           max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """(id, the five counts, base_failed, char_distance, word_distance, kept) per row.

    A text is failed by its base counts (fewer than 10 words, or more than a
    fifth of them in repeated windows) or else by a distance above its limit;
    guards leave short texts to the base counts. Rows without a language have
    a reference of their own, and repeated rows count and are judged each.
    """
    rows = written(measured(docs, id_col, text_col, lang_col), "measures")
    refs = references(rows)
    refs = written(refs, "references")
    joined = rows.join(F.broadcast(refs) if fits_broadcast(refs) else refs, "lang")

    def task(batches):
        import numpy as np
        import pyarrow as pa

        def matrix(column):
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)

        for b in batches:
            if not b.num_rows:
                continue
            get = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            a = distance(matrix(get["chars"]), matrix(get["ref_chars"]))
            w = distance(matrix(get["common"]), matrix(get["ref_common"]))
            cols = [*(get[n] for n in ("id", *NAMES[:5])), pa.array(a), pa.array(w)]
            yield pa.RecordBatch.from_arrays(cols, ["id", *NAMES[:5], "char_distance", "word_distance"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} bigint" for n in NAMES[:5]) + ", char_distance double, word_distance double"
    out = joined.mapInArrow(task, schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = ((F.col("word_chars") < min_chars) | (F.col("char_distance") <= max_char_distance)) & ((F.col("n_words") < min_words) | (F.col("word_distance") <= max_word_distance))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & near)


def query(spark, sf_dir):
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), *NAMES[:5], "base_failed", "kept", "char_distance", "word_distance")
