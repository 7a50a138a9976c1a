"""Dataset statistics and the tables of the display report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossloom import constants as C
from crossloom.functions import text as X
from crossloom.operators.ordering import draw, top_per_key
from crossloom.operators.similarity import set_topk
from crossloom.session import materialize


def dataset_statistics(events: DataFrame) -> DataFrame:
    """Items and interactions per domain with the overall number of users and mean sequence length."""
    per = events.groupBy("domain").agg(F.count_distinct("item_id").alias("num_items"), F.count(F.lit(1)).alias("num_interactions"))
    lengths = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    overall = lengths.agg(F.count(F.lit(1)), F.round(F.avg("n"), 1)).first()
    return per.withColumns({"num_users": F.lit(overall[0]).cast("long"), "avg_sequence_length": F.lit(overall[1])})


def feature_statistics(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, dimension, and mean and population std over all values, per key."""
    d = F.col("embedding").cast("array<double>")
    row = vectors.select(
        *keys, F.size(d).alias("dim"),
        F.aggregate(d, F.lit(0.0), lambda a, v: a + v).alias("s"), F.aggregate(d, F.lit(0.0), lambda a, v: a + v * v).alias("q"))
    n = F.sum("dim")
    mean = F.sum("s") / n
    return row.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.max("dim").alias("dim"), (F.round(mean, 6) + 0.0).alias("mean"),
        F.round(F.sqrt(F.greatest(F.sum("q") / n - mean * mean, F.lit(0.0))), 6).alias("std"))


def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def eligible_users(instructions: DataFrame, predictions: DataFrame, least: int = 2, scanned: int = 160) -> DataFrame:
    """Of the first ``scanned`` instructions by ``line`` those with an answer and at least ``least`` history items in the prompt.

    ``instructions(user_id, domain, line, input)``, ``predictions(user_id, prediction, ...)``, one row per user.
    """
    first = instructions.orderBy("line").limit(scanned)
    both = first.join(predictions.withColumn("prediction", X.strip_special_tokens(F.col("prediction"))), "user_id")
    return both.withColumn("history", X.history_events(F.col("input"))).filter(F.size("history") >= least).drop("input")


def truncated_titles(history: DataFrame, keys: Sequence[str] = ("user_id",), order: str = "rank", shown: int = 8, recent: int = 3, letters: int = 12) -> DataFrame:
    """``(keys, history, recent)``: the first titles cut to a few letters, and the very first in full. Rows: (keys, order, title)."""
    first = history.filter(F.col(order) <= shown)
    packed = F.sort_array(F.collect_list(F.struct(order, "title")))
    lists = first.groupBy(*keys).agg(packed.getField("title").alias("_t"))
    cut = F.transform("_t", lambda v: F.left(v, F.lit(letters)))
    return lists.select(*keys, cut.alias("history"), F.slice("_t", 1, recent).alias("recent"))


def dashboard_metrics(snapshot: DataFrame, **extra: DataFrame) -> DataFrame:
    """``(part, metric, value)`` of one-row tables: the snapshot and whatever else the dashboard shows, rounded."""
    out = None
    for part, df in {"snapshot": snapshot, **extra}.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 4).alias("value")) for c in df.columns])
        rows = df.select(F.lit(part).alias("part"), F.explode(pairs).alias("_p")).select("part", "_p.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def display_pool(users: DataFrame, pool: int = 120, per_domain: int = 12) -> tuple[DataFrame, DataFrame]:
    """First ``pool`` users by ``line`` and, of these, the first ones per domain."""
    first = users.orderBy("line").limit(pool)
    w = Window.partitionBy("domain").orderBy("line")
    return first, first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_domain).drop("_r")


def pool_with_fill(demo: DataFrame, pool: DataFrame, titles: DataFrame, size: int = 15, selected: int = 5) -> DataFrame:
    """Retrieval pool of the demo users: ``(user_id, place, similar_id, similarity, selected)``.

    The most similar pool users by title sets, filled with the next pool users
    at similarity 0. Both inputs are the report's pool of at most 120 users.
    """
    sets = titles.join(pool.select("user_id"), "user_id", "left_semi").select(F.col("user_id").alias("id"), F.col("title").alias("token"))
    sets = materialize(sets)  # titles of the pool, read for both sides
    own = sets.join(demo.select(F.col("user_id").alias("id")), "id", "left_semi")
    near = set_topk(own, size, sets)
    places = pool.select(F.col("user_id").alias("similar_id"), "line")
    hits = near.select(F.col("id").alias("user_id"), F.col("neighbor_id").alias("similar_id"), "score").join(places, "similar_id")
    # the first pool users, enough to fill any gap: size rows besides the user and size hits
    offer = [F.struct(F.lit(r["similar_id"]).cast(places.schema["similar_id"].dataType).alias("similar_id"), F.lit(r["line"]).cast("long").alias("line"))
             for r in places.orderBy("line").limit(2 * size + 1).collect()]
    rest = demo.select("user_id", F.explode(F.array(*offer)).alias("_o")).select("user_id", "_o.*").filter(
        F.col("user_id") != F.col("similar_id")).join(
        hits.select("user_id", "similar_id"), ["user_id", "similar_id"], "left_anti").withColumn("score", F.lit(0.0))
    both = hits.unionByName(rest.select(*hits.columns))
    out = top_per_key(both, ["user_id"], [F.desc("score"), F.asc("line")], size, "place")
    return out.select("user_id", "place", "similar_id", F.round("score", 4).alias("similarity"), (F.col("place") <= selected).alias("selected"))


def pool_titles(pool: DataFrame, history: DataFrame, n: int = 3) -> DataFrame:
    """Pool rows with the first ``n`` titles of the similar user's displayed history (``(user_id, rank, title)``), in order."""
    first = truncated_titles(history, shown=n, recent=n).select(F.col("user_id").alias("similar_id"), F.col("recent").alias("titles"))
    return pool.join(first, "similar_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


def curve_metrics(curve: DataFrame) -> DataFrame:
    """``(part, metric, value)`` of training curve rows: the losses of every run by step."""
    return curve.select(F.concat(F.lit("training "), F.col("run").cast("string")).alias("part"),
                        F.concat(F.lit("loss "), F.col("step").cast("string")).alias("metric"), F.col("loss").alias("value"))


def sample_rows(df: DataFrame, key: str, n: int = 100, seed: int = C.SEED) -> DataFrame:
    """All rows of ``n`` reproducibly chosen keys (the display sample of a large matrix)."""
    chosen = df.select(key).distinct().orderBy(draw(F.col(key), F.lit(0), seed, 2**31 - 1), F.col(key)).limit(n)
    return df.join(chosen, key, "left_semi")


def metric_snapshot(exact: DataFrame, expanded: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """Rounded metrics for display; expanded metrics win over exact ones."""
    source = exact if expanded is None else expanded
    metrics = [c for c in source.columns if c != "n"]
    return source.select(*[F.round(c, digits).alias(c) for c in metrics])


def training_curve(entries: DataFrame) -> DataFrame:
    """Log entries with a loss, rounded, from ``read_training_log`` rows."""
    return entries.filter(F.col("loss").isNotNull()).select(
        "run", "step", F.round("loss", 4).alias("loss"), F.round(F.coalesce("learning_rate", F.lit(0.0)), 8).alias("learning_rate"),
        F.round("epoch", 4).alias("epoch"), F.round("eval_loss", 4).alias("eval_loss"))


def training_summary(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Best metric and step per run: the recorded ones, else those of the last evaluated entry."""
    last = entries.filter(F.col("eval_loss").isNotNull()).groupBy("run").agg(
        F.max_by(F.struct("eval_loss", "step"), F.col("pos")).alias("_e"))
    final = entries.filter(F.col("loss").isNotNull()).groupBy("run").agg(F.max_by("loss", "pos").alias("_l"))
    recorded = F.col("best_metric").isNotNull()
    return runs.join(last, "run", "left").join(final, "run", "left").select(
        "run",
        F.coalesce(F.when(recorded, F.col("best_global_step")), F.when(~recorded, F.col("_e.step")), F.col("global_step")).alias("best_step"),
        F.round(F.coalesce("best_metric", "_e.eval_loss", F.lit(0.0)), 4).alias("best_eval_loss"),
        F.col("global_step").alias("total_steps"),
        F.round(F.coalesce("_l", F.lit(0.0)), 4).alias("final_loss"))
