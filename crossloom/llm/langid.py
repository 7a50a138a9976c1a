"""Language identification by compression.

For every language a raw-content zstandard dictionary holds sample text. A
text is encoded with each of them; the language whose dictionary makes it
smallest is chosen, and the margin to the second smallest is the score. A
narrow margin means that the text is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossloom.llm.common import crc_fold, raw_text, text_batches, written
from crossloom.operators.ordering import bounded, top_per_key

SAMPLE_ROWS = 200  # rows per language that may enter its dictionary
SAMPLE_BYTES = 8192  # of a longer text so many bytes enter a dictionary
DICTIONARY_BYTES = 1 << 16
LANGUAGES = 100  # languages with dictionaries of full size; more languages share the room of these
LEAST_BYTES = 256  # of a dictionary, however many languages there are
PIECE = 4096  # bytes encoded at once, so that a long text does not become its own dictionary
SHORT = 256  # shorter texts are repeated up to this size, as zstandard does not encode a few bytes
MIN_MARGIN = 0.004
UNKNOWN = "und"


def normalised(text: str) -> bytes:
    """Lower-cased letters; everything between them is one space."""
    import re

    return re.sub(r"[\W\d_]+", " ", text.lower()).strip().encode("utf-8", "replace")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) from a bounded sample of the labelled rows, most frequent language first.

    Every language is learned, from at most ``SAMPLE_ROWS`` rows and the first
    ``SAMPLE_BYTES`` bytes of each. Beyond ``LANGUAGES`` languages the
    dictionaries are smaller, so that all together keep to the same size
    (down to ``LEAST_BYTES`` each).
    """

    def task(batches):
        import pyarrow as pa

        for b in text_batches(batches):
            found = [((normalised(x.decode("utf-8", "ignore")) + b" ") * n)[:room] for x, n in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(found, pa.binary())], ["lang", "draw", "h", "raw"])

    text = F.col(text_col).cast("string")
    named = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(9), F.col(id_col)).alias("draw"), F.xxhash64(text).alias("h"), text.alias("text")
    )
    langs = [r.lang for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    room = max(LEAST_BYTES, DICTIONARY_BYTES * LANGUAGES // max(LANGUAGES, len(langs)))
    key = ["lang", "draw", "h"]
    # rows are drawn, not ids, so that rows that share an id or have none are bounded too
    drawn = bounded(written(top_per_key(named.select(*key), ["lang"], ["draw", "h"], SAMPLE_ROWS).groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "drawn"))
    # the first bytes as they are: a character that the cut splits is left out
    cut = F.substring(F.col("text").cast("binary"), 1, SAMPLE_BYTES).alias("raw")
    held = named.select(*key, cut).join(drawn, key).dropDuplicates(key).select(*key, "raw", "n").mapInArrow(task, "lang string, draw bigint, h bigint, raw binary")
    before = F.sum(F.octet_length("raw")).over(Window.partitionBy("lang").orderBy("draw", "h").rowsBetween(Window.unboundedPreceding, -1))
    out = {}
    for row in sorted(held.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < room).collect(), key=lambda r: (r.draw, r.h)):
        out.setdefault(row.lang, bytearray()).extend(row.raw)
    return [(lang, bytes(out[lang][:room])) for lang in langs if len(out.get(lang, b"")) >= 8]


class Model:
    """Compressors of all languages; made once per task."""

    def __init__(self, dictionaries):
        import zstandard as zstd

        # smaller tables for the smaller dictionaries of many languages
        log = max(8, 16 - (max(0, len(dictionaries) - 1) // LANGUAGES).bit_length())
        how = zstd.ZstdCompressionParameters(
            strategy=zstd.STRATEGY_GREEDY, min_match=3, window_log=17, hash_log=log, chain_log=log, search_log=3, write_content_size=0, write_checksum=0
        )
        self.by = []
        for lang, content in dictionaries:
            held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            self.by.append((lang, zstd.ZstdCompressor(dict_data=held, compression_params=how)))

    def predict(self, text: str) -> tuple[str, float]:
        """(language, margin as a share of the second size); no letter or nothing learned: unknown, 0."""
        raw = normalised(text)
        if not raw or not self.by or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        if len(raw) < SHORT:
            raw = (raw + b" ") * (SHORT // (len(raw) + 1) + 1)
        sizes = [sum(len(c.compress(raw[i : i + PIECE])) for i in range(0, len(raw), PIECE)) for _, c in self.by]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=None)
        return self.by[best][0], 1.0 if second is None else (second - sizes[best]) / second


def identify(docs: DataFrame, dictionaries, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., lang_pred, score) per row, from the whole text alone.

    NULL texts and texts without a letter are ``und`` with score 0. Equal sizes go to the more frequent language.
    """

    def task(batches):
        import pyarrow as pa

        model = Model(dictionaries)
        for b in text_batches(batches):
            n = b.num_columns - 1
            found = [model.predict(x.decode("utf-8", "replace")) for x in b.column(n).to_pylist()]
            cols = [*(b.column(i) for i in range(n)), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:n], "lang_pred", "score"])

    rows = raw_text(docs, F.col(id_col).alias("id"), *keep, text=text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(task, f"{schema}, lang_pred string, score double")


def accepted(docs: DataFrame, dictionaries, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows whose language is clear, unchanged. Rows pass through the task whole, so nothing is joined."""

    def task(batches):
        import pyarrow as pa

        model, at = Model(dictionaries), None
        for b in text_batches(batches):
            at = b.schema.get_field_index(text_col)
            found = [model.predict(x or "") for x in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and margin >= min_margin for lang, margin in found], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def train_fold(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(crc_fold(id_col, 3) != 1)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(train_fold(docs))
    rows = docs.withColumn("held_out", crc_fold("doc_id", 3) == 1)
    out = identify(rows, model, keep=("held_out",))
    return out.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")
