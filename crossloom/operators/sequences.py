"""User sequences, splits, order-dependent columns and row-level clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossloom import constants as C
from crossloom.operators.ordering import HOT_ROWS, dense_index, draw, hot_keys, keyed_join, last_per_key, ordered_columns, top_per_key
from crossloom.session import materialize

ORDER = ("ts", "event_id")


def recent_events(events: DataFrame, n: int = C.MAX_SEQ_LEN, order: Sequence[str] = ORDER) -> DataFrame:
    """Each user's last ``n`` events; ``back`` counts from the newest (1)."""
    return top_per_key(events, ["user_id"], [F.desc(c) for c in order], n, "back")


def min_activity(events: DataFrame, least: int = C.MIN_INTERACTIONS, keys: Sequence[str] = ("user_id",),
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events of users with at least ``least`` events. The counts are combined before they are shuffled."""
    enough = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*keys)
    return keyed_join(events, enough, keys, "left_semi", hot_rows)


def collect_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], out: str) -> DataFrame:
    """Ordered array of structs per key. Only for groups that were cut to a bounded length before."""
    packed = F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return df.groupBy(*keys).agg(packed.alias(out))


def user_sequences(
    events: DataFrame,
    max_len: int = C.MAX_SEQ_LEN,
    least: int = C.MIN_INTERACTIONS,
    fields: Sequence[str] = ("item_id", "domain"),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """``(user_id, seq)``: the last ``max_len`` events of every user with at least ``least`` events."""
    if least > max_len:  # what is left after the cut no longer tells how active a user was
        kept = recent_events(min_activity(events, least), max_len, order)
        return collect_ordered(kept, ["user_id"], order, fields, "seq")
    kept = recent_events(events, max_len, order)
    # min(count, max_len) rows are left, which decides count >= least without a second pass
    return collect_ordered(kept, ["user_id"], order, fields, "seq").filter(F.size("seq") >= least)


def tail(a: Column, n: int) -> Column:
    """Last ``n`` entries (``slice`` returns nothing when asked for more than there are)."""
    return F.when(F.size(a) == 0, a).otherwise(F.slice(a, F.greatest(F.lit(-n), -F.size(a)), n))


def head_without(a: Column, n: int) -> Column:
    """All but the last ``n`` entries."""
    return F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))


def leave_one_out(sequences: DataFrame, seq: str = "seq", least: int = 3) -> DataFrame:
    """``(split, user_id, seq, target)``: last event for test, second last for valid, the rest for train."""
    s = F.col(seq)
    splits = F.array(
        F.struct(F.lit("train").alias("split"), head_without(s, 2).alias("seq"), F.element_at(s, -1).alias("target")),
        F.struct(F.lit("valid").alias("split"), head_without(s, 2).alias("seq"), F.element_at(s, -2).alias("target")),
        F.struct(F.lit("test").alias("split"), head_without(s, 1).alias("seq"), F.element_at(s, -1).alias("target")),
    )
    out = sequences.filter(F.size(s) >= least).select("user_id", F.explode(splits).alias("_s")).select(
        "_s.split", "user_id", "_s.seq", "_s.target"
    )
    return out.withColumn("target", F.when(F.col("split") != "train", F.col("target")))


def leave_one_out_presplit(sequences: DataFrame) -> DataFrame:
    """As ``leave_one_out`` for users that already carry a ``split``."""
    s = F.col("seq")
    back = F.when(F.col("split") == "test", 1).otherwise(2)
    out = sequences.filter(F.size(s) >= 3)
    target = F.when(F.col("split") == "test", F.element_at(s, -1)).when(F.col("split") == "valid", F.element_at(s, -2))
    return out.select("split", "user_id", F.slice(s, 1, F.size(s) - back).alias("seq"), target.alias("target"))


def implicit_target(splits: DataFrame) -> DataFrame:
    """Rows without target take their last event as target; rows too short for that are dropped."""
    missing = F.col("target").isNull()
    s = F.col("seq")
    return splits.filter(~missing | (F.size(s) >= 2)).select(
        *[c for c in splits.columns if c not in ("seq", "target")],
        F.when(missing, head_without(s, 1)).otherwise(s).alias("seq"),
        F.when(missing, F.try_element_at(s, F.lit(-1))).otherwise(F.col("target")).alias("target"),
    )


def last_event(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The newest event per user, found with a combined aggregate."""
    return last_per_key(events, ["user_id"], order)


def without_last(events: DataFrame, order: Sequence[str] = ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All events but the newest of each user."""
    newest = events.groupBy("user_id").agg(F.max(F.struct(*order)).alias("_newest"))
    return keyed_join(events, newest, ["user_id"], "inner", hot_rows).filter(F.struct(*order) < F.col("_newest")).drop("_newest")


def transitions(events: DataFrame, within_domain: bool = False, order: Sequence[str] = ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Consecutive pairs ``(src, dst)`` per user, over all events or inside each domain."""
    keys = ["user_id", "domain"] if within_domain else ["user_id"]
    slim = events.select("user_id", "domain", "item_id", *order)
    out = ordered_columns(slim, keys, order, previous={"src": "item_id"}, hot_rows=hot_rows)
    return out.filter(F.col("src").isNotNull()).withColumnRenamed("item_id", "dst")


def positions(events: DataFrame, order: Sequence[str] = ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Position in the sequence, and position within X and within Y (0 in slots of the other domain)."""
    hot = hot_keys(events, ["user_id"], hot_rows)
    hot_domains = hot_keys(events, ["user_id", "domain"], hot_rows) if hot else None
    out = ordered_columns(events, ["user_id"], order, position="pos", hot=hot)
    out = ordered_columns(out, ["user_id", "domain"], order, position="_dpos", hot=hot_domains)
    x = F.col("domain") == "X"
    return out.select(
        "*",
        F.when(x, F.col("_dpos")).otherwise(0).alias("x_pos"),
        F.when(x, 0).otherwise(F.col("_dpos")).alias("y_pos"),
    ).drop("_dpos")


def next_labels(events: DataFrame, order: Sequence[str] = ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Next item at every slot with masks telling which domain it belongs to; the last slot has no label."""
    out = ordered_columns(events, ["user_id"], order,
                          following={"next_item": "item_id", "next_domain": "domain"}, hot_rows=hot_rows)
    return out.filter(F.col("next_item").isNotNull()).select(
        "*",
        F.when(F.col("next_domain") == "X", 1).otherwise(0).alias("x_mask"),
        F.when(F.col("next_domain") == "Y", 1).otherwise(0).alias("y_mask"),
    )


def next_in_domain(events: DataFrame, targets: DataFrame, order: Sequence[str] = ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Next item of the same domain for every history slot.

    The last slot of a domain takes the user's final target when that is of
    the same domain, else it has no label. Users without a label in X or
    without one in Y are dropped.
    """
    hot = hot_keys(events, ["user_id"], hot_rows)
    hot_domains = hot_keys(events, ["user_id", "domain"], hot_rows) if hot else None
    out = ordered_columns(events, ["user_id", "domain"], order, following={"_next": "item_id"}, hot=hot_domains)
    final = targets.select("user_id", F.col("item_id").alias("_t_item"), F.col("domain").alias("_t_domain"))
    out = keyed_join(out, final, ["user_id"], "left", hot=hot).withColumn(
        "label", F.coalesce("_next", F.when(F.col("domain") == F.col("_t_domain"), F.col("_t_item")))
    )
    if hot:
        out = materialize(out)  # read twice below, and expensive when keys are cut into ranges
    both = (
        out.groupBy("user_id")
        .agg(
            F.count(F.when(F.col("domain") == "X", F.col("label"))).alias("_x"),
            F.count(F.when(F.col("domain") == "Y", F.col("label"))).alias("_y"),
        )
        .filter((F.col("_x") > 0) & (F.col("_y") > 0))
    )
    return keyed_join(out, both, ["user_id"], "left_semi", hot=hot).drop("_next", "_t_item", "_t_domain")


def last_positions(events: DataFrame, order: Sequence[str] = ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Index from the end (-1 = last slot) of the last X and the last Y slot; -1 when the domain is absent."""
    out = ordered_columns(events.select("user_id", "domain", *order), ["user_id"], order, position="pos", hot_rows=hot_rows)
    last = out.groupBy("user_id").agg(
        F.max("pos").alias("n"),
        F.max(F.when(F.col("domain") == "X", F.col("pos"))).alias("_x"),
        F.max(F.when(F.col("domain") == "Y", F.col("pos"))).alias("_y"),
    )
    return last.select(
        "user_id",
        F.coalesce(F.col("_x") - F.col("n") - 1, F.lit(-1)).alias("x_last"),
        F.coalesce(F.col("_y") - F.col("n") - 1, F.lit(-1)).alias("y_last"),
    )


def domain_by_threshold(idx: Column, first_y: int) -> Column:
    return F.when(idx < first_y, "X").otherwise("Y")


def mapped_only(events: DataFrame, id_map: DataFrame, feature_rows: int | None = None, least: int = 3) -> DataFrame:
    """Drop events whose item has no index (or none with a feature row), then users left with too few events."""
    usable = id_map.select("item_id", "idx")
    if feature_rows is not None:
        usable = usable.filter(F.col("idx") < feature_rows)
    return min_activity(events.join(usable, "item_id"), least)


def every_second_row(df: DataFrame, order: Sequence[str], when_even: bool | None = None) -> DataFrame:
    """Keep rows 0, 2, 4, … of the sort order. ``when_even=None`` does so only for an even row count."""
    indexed = dense_index(df, order, "_row")
    if when_even is None:
        when_even = indexed.count() % 2 == 0
    return (indexed.filter(F.col("_row") % 2 == 0) if when_even else indexed).drop("_row")


def override_vectors(users: DataFrame, given: DataFrame, dim: int) -> DataFrame:
    """Given vectors for the users that have one, zeros for all others; surplus vectors fall away."""
    return users.join(given.select("user_id", F.col("embedding").alias("_given")), "user_id", "left").select(
        *[c for c in users.columns if c != "embedding"],
        F.coalesce("_given", F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("embedding"),
    )


def head_percentage(df: DataFrame, order: Sequence[str], percent: int, out: str = "split") -> DataFrame:
    """First ``percent`` % of the rows for validation, the rest for training."""
    indexed = dense_index(df, order, "_row")
    n = indexed.count()
    return indexed.withColumn(out, F.when(F.col("_row") < n * percent // 100, "valid").otherwise("train")).drop("_row")


def shuffled_cap(df: DataFrame, key: str, cap: int, seed: int = C.SEED) -> DataFrame:
    """A reproducible random choice of at most ``cap`` rows (``key`` is unique), spread over the tasks of the sort."""
    drawn = df.select(key, draw(F.col(key), F.lit(0), seed, 2**31 - 1).alias("_draw"))
    chosen = dense_index(drawn, ["_draw", key], "_row").filter(F.col("_row") < cap).select(key)
    return df.join(chosen, key, "left_semi")


def union_override(*parts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union where a later table overrides an earlier one on an equal key."""
    both = None
    for prio, part in enumerate(parts):
        tagged = part.withColumn("_prio", F.lit(prio))
        both = tagged if both is None else both.unionByName(tagged)
    return last_per_key(both, list(key), ["_prio"]).drop("_prio")


def union_domains(x_events: DataFrame, y_events: DataFrame) -> DataFrame:
    return x_events.withColumn("domain", F.lit("X")).unionByName(y_events.withColumn("domain", F.lit("Y")))

