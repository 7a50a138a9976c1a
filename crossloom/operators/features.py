"""Model-input tables: padded sequences, labels, negatives, corrupted sequences, batches, token packing.

Every per-user step works on the user's last ``maxlen`` events only, so groups are bounded.
Items carry dense indices: X items below ``n_x``, Y items from ``n_x`` on; ``n_x + n_y`` pads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossloom import constants as C
from crossloom.operators.ordering import dense_index, draw
from crossloom.operators.sequences import ORDER, recent_events


def pad_left(values: Column, length: int, pad: Column | int) -> Column:
    p = pad if isinstance(pad, Column) else F.lit(pad)
    return F.concat(F.array_repeat(p, F.greatest(F.lit(length) - F.size(values), F.lit(0))), values)


def pad_right(values: Column, length: int | Column, pad: Column | int) -> Column:
    p = pad if isinstance(pad, Column) else F.lit(pad)
    n = length if isinstance(length, Column) else F.lit(length)
    return F.concat(values, F.array_repeat(p, F.greatest(n - F.size(values), F.lit(0))))


def rectangular(lists: DataFrame, values: str) -> DataFrame:
    """Ragged lists padded with 0 to the longest one."""
    longest = lists.agg(F.max(F.size(values))).first()[0] or 0
    return lists.withColumn(values, pad_right(F.col(values), longest, 0))


def _slots(events: DataFrame, maxlen: int, skip: int, order: Sequence[str]) -> DataFrame:
    """Newest ``maxlen`` events per user without the very newest ``skip``; positions start at 1."""
    w = Window.partitionBy("user_id")
    tail = recent_events(events, maxlen + skip, order)
    n = F.max("back").over(w)
    return tail.withColumn("pos", (n - F.col("back") + 1).cast("int")).withColumn("n", (n - skip).cast("int"))


def _with_positions(slots: DataFrame) -> DataFrame:
    wd = Window.partitionBy("user_id", "domain").orderBy("pos")
    x = F.col("domain") == "X"
    return slots.withColumn("_d", F.row_number().over(wd)).select(
        "*", F.when(x, F.col("_d")).otherwise(0).alias("x_pos"), F.when(x, 0).otherwise(F.col("_d")).alias("y_pos")).drop("_d")


def _collect(slots: DataFrame, fields: dict[str, str], maxlen: int, pads: dict[str, int]) -> list[Column]:
    packed = F.sort_array(F.collect_list(F.struct("pos", *[F.col(src).alias(out) for out, src in fields.items() if out != "pos"])))
    return [pad_left(packed.getField(out), maxlen, pads.get(out, 0)).alias(out if out != "pos" else "position")
            for out in fields]


def evaluation_features(history: DataFrame, targets: DataFrame, n_x: int, n_y: int, maxlen: int = C.PADDED_LEN,
                        order: Sequence[str] = ORDER) -> DataFrame:
    """Padded sequences with positions, last positions per domain, target flag and domain-local target."""
    pad = n_x + n_y
    slots = _with_positions(_slots(history, maxlen, 0, order))
    x = F.col("domain") == "X"
    slots = slots.withColumn("xd", F.when(x, F.col("item_id")).otherwise(pad)).withColumn("yd", F.when(x, pad).otherwise(F.col("item_id")))
    fields = {"seq": "item_id", "xd": "xd", "yd": "yd", "pos": "pos", "x_pos": "x_pos", "y_pos": "y_pos"}
    last = lambda d: F.coalesce(F.max(F.when(F.col("domain") == d, F.col("pos"))) - F.max("n") - 1, F.lit(-1))
    rows = slots.groupBy("user_id").agg(
        *_collect(slots, fields, maxlen, {"seq": pad, "xd": pad, "yd": pad}), last("X").alias("x_last"), last("Y").alias("y_last"))
    t = targets.select("user_id", (F.col("domain") == "Y").cast("int").alias("flag"), F.col("item_id").alias("_t"))
    return rows.join(t, "user_id").withColumn("target", F.col("_t") - F.col("flag") * n_x).drop("_t")


def training_features(events: DataFrame, n_x: int, n_y: int, maxlen: int = C.PADDED_LEN, seed: int = C.SEED,
                      order: Sequence[str] = ORDER) -> DataFrame:
    """Padded training rows: inputs, next-item labels (shared, X and Y) with masks, corrupted inputs.

    The newest event is the ground truth only. A domain's last slot is labelled
    by it when it is of that domain; otherwise the slot is blanked. Users
    without an X label or without a Y label are left out.
    """
    pad = n_x + n_y
    slots = _slots(events, maxlen, 1, order)
    w, wd, wu = Window.partitionBy("user_id").orderBy("pos"), Window.partitionBy("user_id", "domain").orderBy("pos"), Window.partitionBy("user_id")
    slots = (
        slots.withColumn("ground", F.lead("item_id").over(w))
        .withColumn("ground_x", F.lead("domain").over(w) == "X")
        .withColumn("label", F.lead("item_id").over(wd))
    )
    # positions are counted before the ground truth row is dropped; it is the last one of its domain
    slots = _with_positions(slots).filter(F.col("back") > 1)
    x, labelled = F.col("domain") == "X", F.col("label").isNotNull()
    slots = (
        slots.withColumn("_nx", F.count(F.when(x, F.col("label"))).over(wu)).withColumn("_ny", F.count(F.when(~x, F.col("label"))).over(wu))
        .filter((F.col("_nx") > 0) & (F.col("_ny") > 0))
    )
    y_draw = F.lit(n_x) + draw(F.col("user_id"), F.col("pos"), seed, n_y)
    x_draw = draw(F.col("user_id"), F.col("pos"), seed + 1, n_x)
    cols = {
        "xd": F.when(x & labelled, F.col("item_id")).otherwise(pad),
        "yd": F.when(~x & labelled, F.col("item_id")).otherwise(pad),
        "x_pos": F.when(labelled, F.col("x_pos")).otherwise(0),
        "y_pos": F.when(labelled, F.col("y_pos")).otherwise(0),
        "share_x": F.when(F.col("ground_x"), F.col("ground")).otherwise(n_x),
        "share_y": F.when(F.col("ground_x"), n_y).otherwise(F.col("ground") - n_x),
        "x_label": F.when(x & labelled, F.col("label")).otherwise(n_x),
        "y_label": F.when(~x & labelled, F.col("label") - n_x).otherwise(n_y),
        "mask": F.lit(1),
        "share_x_mask": F.col("ground_x").cast("int"),
        "share_y_mask": (~F.col("ground_x")).cast("int"),
        "x_mask": (x & labelled).cast("int"),
        "y_mask": (~x & labelled).cast("int"),
        "corrupt_x": F.when(x, F.col("item_id")).otherwise(y_draw.cast("int")),
        "corrupt_y": F.when(x, x_draw.cast("int")).otherwise(F.col("item_id")),
    }
    slots = slots.select("user_id", "pos", F.col("item_id").alias("seq"), "ground", *[c.alias(n) for n, c in cols.items()])
    pads = {c: pad for c in ("seq", "ground", "xd", "yd", "corrupt_x", "corrupt_y")}
    pads |= {"share_x": n_x, "x_label": n_x, "share_y": n_y, "y_label": n_y}
    fields = {c: c for c in ("seq", "pos", "ground", *cols)}
    return slots.groupBy("user_id").agg(*_collect(slots, fields, maxlen, pads))


def negatives(targets: DataFrame, n_x: int, n_y: int, count: int = C.NEGATIVES, seed: int = C.SEED) -> DataFrame:
    """``count`` domain-local items of the target's domain, never the target; repetition is allowed."""
    on_y = F.col("domain") == "Y"
    local = F.when(on_y, F.col("item_id") - n_x).otherwise(F.col("item_id")).cast("long")
    size = F.when(on_y, n_y).otherwise(n_x).cast("long")
    rows = targets.select("user_id", local.alias("_t"), size.alias("_n"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: draw(F.col("user_id"), i, seed, F.col("_n") - 1))
    return rows.select("user_id", F.transform(drawn, lambda v: F.when(v >= F.col("_t"), v + 1).otherwise(v)).alias("negatives"))


def batches(rows: DataFrame, key: str, size: int, seed: int = C.SEED) -> DataFrame:
    """Shuffled rows in batches of equal size; the last batch is filled from the start: ``(…, batch, slot)``."""
    shuffled = rows.withColumn("_h", draw(F.col(key), F.lit(0), seed, 2**31 - 1))
    indexed = dense_index(shuffled, ["_h", key], "_i").drop("_h")
    n = indexed.count()
    size = min(size, n) or 1
    fill = indexed.filter(F.col("_i") < (size - n % size) % size).withColumn("_i", F.col("_i") + n)
    both = indexed.unionByName(fill)
    return both.withColumn("batch", F.floor(F.col("_i") / size)).withColumn("slot", F.col("_i") % size).drop("_i")


def pack_tokens(tokens: Column, length: int = C.TOKEN_LENGTH, pad: int = 0) -> Column:
    """``struct(input_ids, attention, labels)`` cut and padded to ``length``; padding carries no label."""
    ids = F.slice(tokens, 1, length)
    ones = F.transform(ids, lambda _: F.lit(1))
    return F.struct(
        pad_right(ids, length, pad).alias("input_ids"), pad_right(ones, length, 0).alias("attention"),
        pad_right(ids, length, C.IGNORED_LABEL).alias("labels"))


def _with_end(tokens: Column, cutoff: int, end: int) -> Column:
    ids = F.slice(tokens, 1, cutoff)
    short = (F.size(ids) < cutoff) & (F.coalesce(F.try_element_at(ids, F.lit(-1)), F.lit(end + 1)) != end)
    return F.when(short, F.concat(ids, F.array(F.lit(end)))).otherwise(ids)


def pack_with_prompt(prompt: Column, full: Column, end: int, cutoff: int = C.TOKEN_LENGTH) -> Column:
    """``struct(input_ids, labels)``: an end token is added to short rows, and the prompt part carries no label."""
    ids = _with_end(full, cutoff, end)
    masked = F.greatest(F.size(_with_end(prompt, cutoff, end)) - 1, F.lit(0))
    labels = F.concat(F.array_repeat(F.lit(C.IGNORED_LABEL), masked), F.slice(ids, masked + 1, F.greatest(F.size(ids) - masked, F.lit(0))))
    return F.struct(ids.alias("input_ids"), labels.alias("labels"))
