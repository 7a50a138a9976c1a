"""Readers. Each one is a parser on text lines plus a thin file wrapper, so the same parser serves files and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossloom.functions import text as X
from crossloom.operators.ordering import last_per_key
from crossloom.sources.matrix import read_matrix  # noqa: F401 - one of the readers
from crossloom.sources.records import read_records

REVIEW = "user_id string, reviewerID string, item_id string, asin string, timestamp string, unixReviewTime string"
META = "asin string, item_id string, title string, description string, categories string, category string, brand string"
RESPONSE = "qqid bigint, choices array<struct<index:int,message:struct<role:string,content:string>,finish_reason:string>>"
TRAINING_LOG = ("log_history array<struct<step:bigint,loss:double,eval_loss:double,learning_rate:double,epoch:double>>, "
                "best_metric double, best_global_step bigint, global_step bigint")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Text lines with their source file."""
    return spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"))


def _parsed(lines: DataFrame, schema: str, value: str) -> DataFrame:
    """Lines that are one JSON object and nothing else. Inside brackets anything behind the object breaks the array."""
    whole = F.from_json(F.concat(F.lit("["), F.col(value), F.lit("]")), f"array<struct<{_typed(schema)}>>", {"allowSingleQuotes": "false"})
    rows = lines.filter(F.startswith(X.strip(F.col(value)), F.lit("{"))).withColumn("_a", whole)
    return rows.filter((F.size("_a") == 1) & F.get("_a", F.lit(0)).isNotNull()).withColumn("_r", F.get("_a", F.lit(0))).drop("_a")


def _typed(schema: str) -> str:
    return ", ".join(part.strip().replace(" ", ": ", 1) for part in schema.split(","))


def _seconds(c: Column) -> Column:
    """A whole number from a JSON number or text; decimals are cut off."""
    return F.coalesce(c.try_cast("long"), c.try_cast("double").try_cast("long"))


def parse_interactions(lines: DataFrame, domain: str | Column, value: str = "value") -> DataFrame:
    """Interaction events from JSON lines; aliases are merged, missing values become empty.

    Broken lines are skipped, and so are times that are no number.
    """
    rows = _parsed(lines, REVIEW, value).withColumn("_t", F.coalesce("_r.timestamp", "_r.unixReviewTime", F.lit("0")))
    rows = rows.withColumn("_t", _seconds(F.col("_t"))).filter(F.col("_t").isNotNull())
    first = lambda *names: F.coalesce(*[F.col(f"_r.{n}") for n in names], F.lit(""))
    return rows.select(
        *[c for c in lines.columns if c != value], first("user_id", "reviewerID").alias("user_id"), first("item_id", "asin").alias("item_id"),
        F.col("_t").alias("ts"),
        (F.lit(domain) if isinstance(domain, str) else domain).alias("domain"))


def read_interactions(spark: SparkSession, path: str, domain: str) -> DataFrame:
    return parse_interactions(read_lines(spark, path), domain).drop("file")


def parse_items(lines: DataFrame, domain: str | Column, order: Sequence[str], value: str = "value") -> DataFrame:
    """Item metadata from JSON lines; list descriptions are joined, categories become a flat list, the last row per id stays."""
    rows = _parsed(lines, META, value)
    raw_category = F.coalesce("_r.categories", "_r.category", F.lit("[]"))
    nested = F.flatten(F.from_json(raw_category, "array<array<string>>"))
    flat = F.from_json(raw_category, "array<string>")
    category = F.when(F.startswith(F.regexp_replace(raw_category, r"\s", ""), F.lit("[[")), nested).when(
        F.startswith(F.trim(raw_category), F.lit("[")), flat).otherwise(F.array(raw_category))
    description = F.coalesce("_r.description", F.lit(""))
    joined = F.when(F.startswith(description, F.lit("[")), F.coalesce(
        F.concat_ws(" ", F.from_json(description, "array<string>")), description)).otherwise(description)
    items = rows.select(
        *order, F.coalesce("_r.asin", "_r.item_id", F.lit("")).alias("item_id"), F.coalesce("_r.title", F.lit("")).alias("title"),
        joined.alias("description"), F.coalesce(category, F.array().cast("array<string>")).alias("category"),
        F.coalesce("_r.brand", F.lit("")).alias("brand"),
        (F.lit(domain) if isinstance(domain, str) else domain).alias("domain"))
    return last_per_key(items.filter(F.col("item_id") != ""), ["item_id"], list(order)).drop(*order)


def read_items(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """Input order is file, then block, then line: ids grow along it, which is all that "last" needs."""
    lines = read_lines(spark, path).withColumn("line", F.monotonically_increasing_id())
    return parse_items(lines, domain, ["line"])


def parse_catalogue(lines: DataFrame, domain: str | Column, value: str = "value", header: bool = True) -> DataFrame:
    """Catalogue rows ``(item_id, title, idx, domain)`` from CSV lines; rows whose index is no number are dropped, header included."""
    row = F.from_csv(F.col(value), "id string, title string, idx string", {"escape": '"'})
    idx = F.col("_r.idx").try_cast("int")
    return lines.withColumn("_r", row).filter(idx.isNotNull()).select(
        F.col("_r.id").alias("item_id"), F.col("_r.title").alias("title"), idx.alias("idx"),
        (F.lit(domain) if isinstance(domain, str) else domain).alias("domain"))


def read_catalogue(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Catalogue files by domain; quoted titles may span lines."""
    schema = "id string, title string, idx string"
    out = None
    for domain, path in paths.items():
        lines = read_records(spark, path, "csv").filter(F.col("pos") > 0)  # the first one has the names
        raw = lines.select(F.from_csv(F.rtrim(F.col("value")), schema, {"escape": '"', "multiLine": "true"}).alias("_r")).select("_r.*")
        rows = raw.select(F.col("id").alias("item_id"), "title", F.col("idx").try_cast("int").alias("idx"),
                          F.lit(domain).alias("domain")).filter(F.col("idx").isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out


def parse_packed(lines: DataFrame, first_cell: int = 3, value: str = "value") -> DataFrame:
    """Events of packed sequence lines ``user⇥border⇥item|pos|ts⇥…``, one row per cell in time order.

    ``first_cell`` is the 1-based field the cells start at. Blank and short cells are dropped.
    """
    fields = F.split(F.col(value), "\t")
    cells = F.slice(fields, first_cell, F.greatest(F.size(fields) - first_cell + 1, F.lit(0)))
    parts = lines.filter(F.size(fields) >= first_cell).select(
        *[c for c in lines.columns if c != value], fields[0].alias("user_id"), fields[1].alias("_b"), F.explode(cells).alias("_c"))
    cell = F.split(F.trim("_c"), "[|]")
    return parts.filter(F.size(cell) >= 3).select(
        *[c for c in lines.columns if c != value], "user_id", F.col("_b").try_cast("long").alias("border"),
        cell[0].try_cast("long").alias("item"), cell[1].try_cast("long").alias("pos"), cell[2].try_cast("long").alias("ts"),
    ).filter(F.col("item").isNotNull())


def split_ground_truth(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(history, truth)``: the cell at the border position is the truth, all others are history."""
    at = F.col("pos") == F.col("border")
    return events.filter(~F.coalesce(at, F.lit(False))), events.filter(at)


def last_as_truth(events: DataFrame, n_x: int) -> DataFrame:
    """The last cell in position order as truth, with its domain flag."""
    return last_per_key(events, ["user_id"], ["pos", "ts"]).select("user_id", "item", (F.col("item") >= n_x).cast("int").alias("flag"))


def parse_responses(texts: DataFrame, value: str = "value") -> DataFrame:
    """``(…, pos, qqid, content)`` of texts that hold a JSON array of chat completions."""
    rows = F.from_json(F.col(value), f"array<struct<{_struct(RESPONSE)}>>")
    keep = [c for c in texts.columns if c != value]
    return texts.select(*keep, F.posexplode_outer(rows).alias("pos", "_r")).filter(F.col("pos").isNotNull()).select(
        *keep, "pos", F.col("_r.qqid").alias("qqid"), F.try_element_at("_r.choices", F.lit(1))["message"]["content"].alias("content"))


def _struct(ddl: str) -> str:
    return ", ".join(f"{p.strip().split(' ', 1)[0]}:{p.strip().split(' ', 1)[1]}" for p in _top_level(ddl))


def _top_level(ddl: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    return [*parts, ddl[start:]]


def read_responses(spark: SparkSession, path: str, name_filter: str = "GM_exat*.json") -> DataFrame:
    """Chat completions below a folder, from files whose name matches the filter: ``(file, pos, qqid, content)``."""
    texts = read_records(spark, path, "array", recursiveFileLookup="true", pathGlobFilter=name_filter)
    rows = texts.select("file", "pos", F.from_json("value", f"struct<{_struct(RESPONSE)}>").alias("_r"))
    return rows.select("file", "pos", "_r.qqid", F.try_element_at("_r.choices", F.lit(1))["message"]["content"].alias("content"))


def parse_keyed(texts: DataFrame, record: str, key: str = "id", value: str = "value") -> DataFrame:
    """Rows of texts that hold a JSON object keyed by id: ``(key, record fields…)``. ``record`` is a struct type."""
    entries = F.explode_outer(F.from_json(F.col(value), f"map<string,{record}>")).alias(key, "_v")
    rows = texts.select(entries).filter(F.col(key).isNotNull())
    return rows.select(key, "_v.*") if record.startswith("struct") else rows.select(key, F.col("_v").alias("value"))


def read_keyed(spark: SparkSession, path: str, record: str, key: str = "id") -> DataFrame:
    """Entries of files that hold one JSON object each; a large file is read by several tasks."""
    entries = read_records(spark, path, "keyed").select(F.concat(F.lit("{"), "value", F.lit("}")).alias("value"))
    return parse_keyed(entries, record, key)


def to_keyed(rows: DataFrame, key: str = "id") -> DataFrame:
    """One single-entry JSON object per row, the line form of an id-keyed file."""
    body = F.struct(*[c for c in rows.columns if c != key])
    return rows.select(F.to_json(F.create_map(F.col(key).cast("string"), body)).alias("value"))


def long_scores(matrix: DataFrame, out: str = "score") -> DataFrame:
    """Score or candidate matrix rows to ``(row, idx, score)``."""
    return matrix.select("row", F.posexplode("embedding").alias("idx", out))


def parse_training_logs(texts: DataFrame, run: str = "run", value: str = "value", first: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(entries, runs)`` of trainer state objects.

    A long log may come as several objects that each hold a part of the entries; ``first`` is then
    the column with the place of the part's first entry.
    """
    at = F.col(first) if first else F.lit(0)
    rows = texts.select(run, F.from_json(F.col(value), TRAINING_LOG).alias("_r"), at.cast("long").alias("_first"))
    entries = rows.select(run, "_first", F.posexplode("_r.log_history").alias("_at", "_e"))
    entries = entries.select(run, (F.col("_first") + F.col("_at")).alias("pos"), "_e.*")
    runs = rows.select(run, "_r.best_metric", "_r.best_global_step", "_r.global_step")
    return entries, runs.distinct() if first else runs


def read_training_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("run"))
    return parse_training_logs(texts)


# fixed values: the separators of the append-only answer log
ANSWER_END = "##@#"
ANSWER_MARK = "@@"


def parse_answers(records: DataFrame, value: str = "value") -> DataFrame:
    """``(idx, answer)`` of records ``idx@@text``; texts may hold the mark again."""
    parts = F.split(X.strip(F.col(value)), ANSWER_MARK, 2)
    idx = parts[0].try_cast("long")
    return records.filter(idx.isNotNull() & (F.size(parts) == 2)).select(
        *[c for c in records.columns if c != value], idx.alias("idx"), X.strip(parts[1]).alias("answer"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return parse_answers(spark.read.option("lineSep", ANSWER_END).text(path))
