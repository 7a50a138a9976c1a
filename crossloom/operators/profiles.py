"""User profiles: behaviour, preferences, vectors, and their texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom import constants as C
from crossloom.functions import text as T
from crossloom.operators.ordering import top_per_key
from crossloom.operators.sequences import ORDER, collect_ordered, recent_events

WIDE = 128  # dimensions that are summed as columns; longer vectors, or of unlike length, are taken apart


def behaviour(events: DataFrame, users: DataFrame | None = None, recent: int = C.RECENT_ITEMS,
              order: Sequence[str] = ORDER) -> DataFrame:
    """Counts, balance of the two domains and the latest items per user; users without events get zeros.

    The counts are combined aggregates and the latest items a limited window, so no task holds a whole user.
    """
    x, y = F.count_if(F.col("domain") == "X"), F.count_if(F.col("domain") == "Y")
    total = F.count(F.lit(1))
    counts = events.groupBy("user_id").agg(
        total.alias("total"), x.alias("x_count"), y.alias("y_count"), (1.0 - F.abs(x - y) / total).alias("cross_ratio"))
    last = collect_ordered(recent_events(events, recent, order), ["user_id"], order, ["item_id"], "_last")
    out = counts.join(last, "user_id").withColumn("recent_items", F.col("_last.item_id")).drop("_last")
    if users is None:
        return out
    empty = F.array().cast(out.schema["recent_items"].dataType)
    return users.select("user_id").join(out, "user_id", "left").select(
        "user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "x_count", "y_count")],
        F.coalesce("cross_ratio", F.lit(0.0)).alias("cross_ratio"), F.coalesce("recent_items", empty).alias("recent_items"))


def value_counts(events: DataFrame, values: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ORDER) -> DataFrame:
    """``(user_id, *keys, value, n, first)`` of ``values(item_id, pos, value, *keys)``; ``first`` is the first occurrence."""
    return events.select("user_id", "item_id", *order).join(values.select("item_id", "pos", "value", *keys), "item_id").groupBy(
        "user_id", *keys, "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order, "pos")).alias("first"))


def preferences(events: DataFrame, values: DataFrame, top: int, keys: Sequence[str] = (), order: Sequence[str] = ORDER) -> DataFrame:
    """``(user_id, *keys, preferred, diversity)``: the most common values with counts (equal counts: first seen), and how many there are."""
    counts = value_counts(events, values, keys, order)
    group = ["user_id", *keys]
    best = top_per_key(counts, group, [F.desc("n"), F.asc("first")], top)
    lists = best.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("_l"))
    # counted through both columns, so that this branch needs the same shuffle as the lists and reuses it
    one = F.when(F.col("first").isNotNull(), F.least(F.col("n"), F.lit(1)))
    diversity = counts.groupBy(*group).agg(F.sum(one).alias("diversity"))
    return lists.join(diversity, group).select(
        *group, F.transform("_l", lambda e: F.struct(e["value"].alias("value"), e["n"].alias("n"))).alias("preferred"), "diversity")


def user_means(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean vector of the items of a user per domain; repeated items count repeatedly, unknown items are left out."""
    counts = events.groupBy("user_id", "domain", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    known = counts.join(vectors.select("item_id", "embedding"), "item_id").filter(F.col("embedding").isNotNull())
    least, most = vectors.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if most and least == most and most <= WIDE:  # a sum per dimension: one row per user and domain, not one per dimension
        group = known.groupBy("user_id", "domain")
        sums = group.agg(F.sum("_n").alias("_n"), *[F.sum(F.col("_n") * F.col("embedding")[i].cast("double")).alias(f"_{i}") for i in range(most)])
        return sums.select("user_id", "domain", F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(most)]).alias("embedding"))
    per_dim = known.select("user_id", "domain", "_n", F.posexplode("embedding").alias("pos", "v")).groupBy(
        "user_id", "domain", "pos").agg((F.sum(F.col("_n") * F.col("v").cast("double")) / F.sum("_n")).alias("v"))
    packed = F.sort_array(F.collect_list(F.struct("pos", "v")))  # as long as one vector
    return per_dim.groupBy("user_id", "domain").agg(F.transform(packed, lambda e: e["v"]).alias("embedding"))


def user_mean_pairs(events: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``(user_id, x_vec, y_vec)`` with zero vectors where a domain has no known item."""
    means = user_means(events, vectors)
    pick = lambda d: F.max(F.when(F.col("domain") == d, F.col("embedding")))
    both = means.groupBy("user_id").agg(pick("X").alias("x_vec"), pick("Y").alias("y_vec"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return events.select("user_id").distinct().join(both, "user_id", "left").select(
        "user_id", F.coalesce("x_vec", zero).alias("x_vec"), F.coalesce("y_vec", zero).alias("y_vec"))


def joined_titles(ranked: DataFrame, key: str, order: str, out: str, sep: str = ", ") -> DataFrame:
    """Titles of a short ranked list per key as one text."""
    packed = F.sort_array(F.collect_list(F.struct(order, "title")))
    return ranked.groupBy(key).agg(F.concat_ws(sep, F.transform(packed, lambda e: e["title"])).alias(out))


def compact_texts(profile: DataFrame, events: DataFrame, items: DataFrame, x_name: str = C.DOMAIN_X_NAME,
                  y_name: str = C.DOMAIN_Y_NAME) -> DataFrame:
    """Short profile text from ``behaviour`` columns."""
    titled = recent_events(events, C.RECENT_ITEMS).join(items.select("item_id", "title"), "item_id", "left").withColumn(
        "title", F.coalesce("title", F.col("item_id").cast("string"))).withColumn("_o", -F.col("back"))
    recent = joined_titles(titled, "user_id", "_o", "recent")
    text = T.fill(C.PROFILE_COMPACT, total_count=F.col("total"), domain_x_name=x_name, domain_y_name=y_name,
                  x_count=F.col("x_count"), y_count=F.col("y_count"), recent_items=F.coalesce("recent", F.lit("")))
    return profile.join(recent, "user_id", "left").select("user_id", text.alias("profile_text"))


def history_lines(events: DataFrame, items: DataFrame, n: int, order: Sequence[str] = ORDER, labelled: bool = True) -> DataFrame:
    """``(user_id, lines)``: the last ``n`` events as ``  [domain] title`` lines, oldest first."""
    meta = items.select("item_id", "title", F.col("domain").alias("_d"))
    shown = recent_events(events, n, order).join(meta, "item_id", "left")
    domain = F.coalesce("_d", F.lit("?"))
    line = F.concat(F.lit("  ["), T.domain_label(domain) if labelled else domain, F.lit("] "),
                    F.coalesce("title", F.col("item_id").cast("string")))
    packed = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("o"), line.alias("line"))))
    return shown.groupBy("user_id").agg(F.concat_ws("\n", F.transform(packed, lambda e: e["line"])).alias("lines"))


def similar_item_text(near: DataFrame, each: int = 3) -> DataFrame:
    """``(user_id, similar_items)``: the first titles of X, then of Y, from ``neighbour_items``."""
    first = near.filter(F.col("rank") <= each).withColumn("_o", F.concat("domain", F.lpad(F.col("rank").cast("string"), 6, "0")))
    return joined_titles(first, "user_id", "_o", "similar_items")


def profiles(events: DataFrame, items: DataFrame, attributes: DataFrame, categories: DataFrame,
             near: DataFrame | None = None, x_name: str = C.DOMAIN_X_NAME, y_name: str = C.DOMAIN_Y_NAME) -> DataFrame:
    """Complete profile per user with the detailed text.

    ``attributes`` and ``categories`` are ``(item_id, pos, value)`` tables,
    ``near`` comes from ``neighbour_items``.
    """
    out = behaviour(events)
    # attributes and categories are counted in one pass over the events
    values = attributes.select("item_id", "pos", "value", F.lit("attribute").alias("kind")).unionByName(
        categories.select("item_id", "pos", "value", F.lit("category").alias("kind")))
    liked = preferences(events, values, max(C.TOP_ATTRIBUTES, C.TOP_CATEGORIES), ["kind"])
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    liked = liked.groupBy("user_id").agg(
        F.slice(of("attribute", "preferred"), 1, C.TOP_ATTRIBUTES).alias("preferred_attributes"),
        of("attribute", "diversity").alias("attribute_diversity"),
        F.slice(of("category", "preferred"), 1, C.TOP_CATEGORIES).alias("preferred_categories"),
        of("category", "diversity").alias("category_diversity"))
    out = out.join(liked, "user_id", "left")
    out = out.join(history_lines(events, items, C.PROFILE_LINES, labelled=False), "user_id", "left")
    if near is None:
        out = out.withColumn("similar_items", F.lit(None).cast("string"))
    else:
        out = out.join(similar_item_text(near), "user_id", "left")
    similar = F.when(F.coalesce("similar_items", F.lit("")) == "", "N/A").otherwise(F.col("similar_items"))
    text = T.fill(
        C.PROFILE_DETAILED, total_count=F.col("total"), domain_x_name=x_name, domain_y_name=y_name,
        x_count=F.col("x_count"), y_count=F.col("y_count"), cross_ratio=T.percent(F.col("cross_ratio")),
        top_attributes=T.counted_text(F.col("preferred_attributes")), top_categories=T.counted_text(F.col("preferred_categories")),
        similar_items=similar, recent_sequence=F.coalesce("lines", F.lit(C.EMPTY_SEQUENCE)))
    return out.withColumn("similar_items", similar).withColumn("profile_text", text).drop("lines")
