"""Catalogue joins, id mapping and catalogue counts.

No broadcast is forced: item tables grow with the data, so the planner
decides by their measured size, and hot items are split by the adaptive
skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.functions import text as T
from crossloom.operators.ordering import dense_index, last_per_key


def with_titles(events: DataFrame, items: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Left join with the catalogue; title falls back to the id, domain to ``unknown``."""
    meta = items.select("item_id", F.col("title").alias("_title"), F.col("domain").alias("_domain"))
    return events.drop("title", "domain").join(meta, "item_id", "left").select(
        *[c for c in events.columns if c not in ("title", "domain")],
        F.coalesce("_title", F.col("item_id").cast("string")).alias("title"),
        F.coalesce("_domain", F.lit(unknown)).alias("domain"),
    )


def with_attributes(events: DataFrame, attributes: DataFrame) -> DataFrame:
    """1:N left join with the attribute rows; items without attributes keep one row with NULL."""
    return events.join(attributes, "item_id", "left")


def id_mapping(events: DataFrame) -> DataFrame:
    """``(item_id, domain, idx)``: dense 0-based index in sorted item order."""
    return dense_index(events.select("item_id", "domain").distinct(), ["item_id", "domain"], "idx")


def index_to_id(rows: DataFrame, id_map: DataFrame) -> DataFrame:
    """Item id of an index; an unknown index stays as text."""
    names = id_map.select("idx", F.col("item_id").cast("string").alias("_id"))
    return rows.join(names, "idx", "left").withColumn("item_key", F.coalesce("_id", F.col("idx").cast("string"))).drop("_id")


def distinct_items(events: DataFrame) -> DataFrame:
    return events.select("domain", "item_id").distinct()


def catalogue_counts(events: DataFrame) -> DataFrame:
    """Distinct items per domain, and for all (domain NULL shown as ``all``)."""
    return (
        distinct_items(events)
        .rollup("domain")
        .agg(F.count_distinct("item_id").alias("num_items"))
        .withColumn("domain", F.coalesce("domain", F.lit("all")))
    )


def title_index(items: DataFrame) -> DataFrame:
    """One row per normalised non-blank title; of equal titles the largest item id stays."""
    keyed = items.withColumn("title_key", T.normalise(F.col("title"))).filter(F.col("title_key") != "")
    return last_per_key(keyed, ["title_key"], ["item_id"])


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not written yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
