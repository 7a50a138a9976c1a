"""Per-row ranking and matching functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossloom.functions import text as T


def rank_in_list(candidates: Column, target: Column) -> Column:
    """1-based place of the target in a list of titles, compared in normal form; NULL when absent."""
    place = F.array_position(F.transform(candidates, T.normalise), T.normalise(target))
    return F.when(place > 0, place)


def hit(rank: Column, k: int) -> Column:
    return F.when(rank <= k, F.lit(1.0)).otherwise(0.0)


def discounted(rank: Column, k: int) -> Column:
    """Gain of the only relevant entry; the ideal gain is 1."""
    return F.when(rank <= k, 1.0 / F.log2(rank + 1.0)).otherwise(0.0)


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1.0 / rank, F.lit(0.0))


def fuzzy_score(prediction: Column, target: Column) -> Column:
    """1.0 equal, 0.5 one contains the other, 0.3 more than half of the words shared, else 0."""
    p, t = T.normalise(prediction), T.normalise(target)
    pw, tw = T.word_set(p), T.word_set(t)
    shared = F.size(F.array_intersect(pw, tw)) / F.greatest(F.size(pw), F.size(tw))
    return (
        F.when(p == t, 1.0)
        .when(T.contained_either_way(p, t), 0.5)
        .when((F.size(pw) > 0) & (F.size(tw) > 0) & (shared > 0.5), 0.3)
        .otherwise(0.0)
    )


def set_precision(truth: Column, guess: Column) -> Column:
    """``struct(precision, recall, f1)`` of two item sets; all 0 without overlap."""
    t, g = F.array_distinct(truth), F.array_distinct(guess)
    tp = F.size(F.array_intersect(t, g)).cast("double")
    fp = F.size(F.array_except(g, t)).cast("double")
    fn = F.size(F.array_except(t, g)).cast("double")
    p, r = tp / (tp + fp), tp / (tp + fn)
    zero = F.lit(0.0)
    return F.struct(
        F.when(tp > 0, p).otherwise(zero).alias("precision"),
        F.when(tp > 0, r).otherwise(zero).alias("recall"),
        F.when(tp > 0, 2 * p * r / (p + r)).otherwise(zero).alias("f1"),
    )
