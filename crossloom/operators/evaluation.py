"""Ranking, matching and classification metrics as one-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossloom import constants as C
from crossloom.functions import ranking as R
from crossloom.functions import text as T
from crossloom.operators.ordering import HOT_ROWS, keyed_join


def metric_columns(rank: Column, cutoffs: Sequence[int] = C.CUTOFFS, digits: int = 6) -> list[Column]:
    """Hit rate and gain per cutoff, and the mean reciprocal rank, from a nullable rank. No rows give zeros."""

    def mean(c: Column, name: str) -> Column:
        return F.coalesce(F.round(F.avg(c), digits), F.lit(0.0)).alias(name)

    cols = [mean(R.hit(rank, k), f"hr_{k}") for k in cutoffs]
    cols += [mean(R.discounted(rank, k), f"ndcg_{k}") for k in cutoffs]
    return [*cols, mean(R.reciprocal(rank), "mrr")]


def ranking_metrics(ranks: DataFrame, rank: str = "rank", by: str | None = None, cutoffs: Sequence[int] = C.CUTOFFS) -> DataFrame:
    """All metrics of one row per user; with ``by`` per slice and for all slices together."""
    cols = [F.count(F.lit(1)).alias("n"), *metric_columns(F.col(rank), cutoffs)]
    if by is None:
        return ranks.agg(*cols)
    return ranks.rollup(by).agg(*cols).withColumn(by, F.coalesce(by, F.lit("all")))


def list_ranks(lists: DataFrame, candidates: str = "candidates", target: str = "target_title") -> DataFrame:
    """Adds the rank of the target title in a ranked list of titles."""
    return lists.withColumn("rank", R.rank_in_list(F.col(candidates), F.col(target)))


def single_answer_lists(rows: DataFrame, prediction: str = "prediction", candidates: str | None = None) -> DataFrame:
    """A ranked list per row: the given candidates, else the single answer."""
    single = F.array(F.coalesce(F.col(prediction), F.lit("")))
    if candidates is None:
        return rows.withColumn("candidates", single)
    given = F.when(F.size(F.col(candidates)) > 0, F.col(candidates))
    return rows.withColumn("candidates", F.coalesce(given, single))


def fuzzy_metrics(rows: DataFrame, prediction: str = "prediction", target: str = "ground_truth",
                  threshold: float = C.FUZZY_THRESHOLD) -> DataFrame:
    scored = rows.select(
        R.fuzzy_score(F.col(prediction), F.col(target)).alias("s"),
        (T.normalise(F.col(prediction)) == T.normalise(F.col(target))).alias("same"),
    )

    def mean(c: Column) -> Column:
        return F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))

    return scored.agg(
        mean(F.when(F.col("s") >= threshold, 1.0).otherwise(0.0)).alias("fuzzy_hr_1"),
        mean(F.col("s")).alias("partial_hr_1"),
        mean(F.when(F.col("same"), 1.0).otherwise(0.0)).alias("exact_hr_1"),
    )


def cold_warm_metrics(ranks: DataFrame, events: DataFrame, threshold: int = C.COLD_THRESHOLD, rank: str = "rank") -> DataFrame:
    """Metrics of users with few history events, of the others, and of all."""
    lengths = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("_len"))
    sliced = ranks.join(lengths, "user_id", "left").withColumn(
        "slice", F.when(F.coalesce("_len", F.lit(0)) < threshold, "cold").otherwise("warm")
    )
    return ranking_metrics(sliced, rank, by="slice")


def out_of_domain_rate(rows: DataFrame, titles: DataFrame, prediction: str = "prediction", domain: str = "target_domain") -> DataFrame:
    """A title of another domain counts 1, an unknown title 0.5. ``titles`` comes from ``title_index``.

    Equal answers are counted before the join, so a popular one is a single row there.
    """
    known = titles.select("title_key", T.normalise_domain(F.col("domain")).alias("_found"))
    answers = rows.groupBy(T.normalise(F.col(prediction)).alias("title_key"), T.normalise_domain(F.col(domain)).alias("_wanted")).agg(F.count(F.lit(1)).alias("_n"))
    joined, wanted = answers.join(known, "title_key", "left"), F.col("_wanted")
    weight = F.when(F.col("_found").isNull(), 0.5).when(F.col("_found") != wanted, 1.0).otherwise(0.0)
    total, off = F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(weight * F.col("_n")), F.lit(0.0))
    return joined.agg(F.coalesce(F.round(off / F.nullif(total, F.lit(0)), 6), F.lit(0.0)).alias("ood_rate"), off.alias("ood_count"), total.alias("total"))


def truth_scores(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """``(user_id, truth_item, truth_score)`` for users whose target has a score."""
    t = truth.select("user_id", F.col("item_id").alias("truth_item"))
    own = scores.select("user_id", F.col("item_id").alias("truth_item"), F.col("score").alias("truth_score"))
    return t.join(own, ["user_id", "truth_item"])


def rank_by_score(scores: DataFrame, truth: DataFrame, tolerance: float | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank of the target among a user's scores by counting better ones, without sorting.

    With a tolerance only clearly larger scores count; without, equal scores
    are ordered by the smaller item id.
    """
    both = keyed_join(scores, truth_scores(scores, truth), ["user_id"], "inner", hot_rows)
    s, t = F.col("score"), F.col("truth_score")
    better = s > t + tolerance if tolerance is not None else (s > t) | ((s == t) & (F.col("item_id") < F.col("truth_item")))
    return both.groupBy("user_id").agg((F.count(F.when(better, 1)) + 1).alias("rank"))


def candidate_ranks(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Rank of the target in ``candidates(user_id, rank, item_id)``; NULL when absent, only users with candidates."""
    users = candidates.select("user_id").distinct()
    t = truth.select("user_id", "item_id").join(users, "user_id", "left_semi")
    return t.join(candidates.select("user_id", "item_id", "rank"), ["user_id", "item_id"], "left")


def baseline_metrics(candidates: DataFrame, truth: DataFrame, id_map: DataFrame) -> DataFrame:
    """Metrics of given candidate lists, averaged over users whose target is mapped."""
    mapped = truth.join(id_map.select("item_id"), "item_id", "left_semi")
    return ranking_metrics(candidate_ranks(candidates, mapped))


def shifted_candidates(candidates: DataFrame, x_items: int) -> DataFrame:
    """Catalogue index of domain-local candidates: Y indices are moved behind the X items."""
    return candidates.withColumn(
        "item_id", F.when(F.col("domain") == "Y", F.col("item_id") + x_items).otherwise(F.col("item_id"))
    )


def user_hit_rate(retrieval: DataFrame, truth: DataFrame, events: DataFrame, cutoffs: Sequence[int] = C.UHR_CUTOFFS) -> DataFrame:
    """Share of users for whom one of the first k neighbours touched the target item."""
    pairs = retrieval.join(truth.select("user_id", F.col("item_id").alias("target")), "user_id")
    owned = events.select(F.col("user_id").alias("neighbor_id"), F.col("item_id").alias("target")).distinct()
    hits = pairs.join(owned.withColumn("_hit", F.lit(1)), ["neighbor_id", "target"], "left")
    first = hits.groupBy("user_id").agg(F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("_first"))
    cols = [F.coalesce(F.round(F.avg(R.hit(F.col("_first"), k)), 6), F.lit(0.0)).alias(f"uhr_{k}") for k in cutoffs]
    return first.agg(*cols, F.count(F.lit(1)).alias("evaluated_users"))


def retrieval_quality(retrieval: DataFrame, truth: DataFrame, events: DataFrame, n: int = 1, confident: float = 0.5) -> DataFrame:
    """Do the sequences of the first n neighbours contain the target, and how long are they?

    Sequences are never put together: a length is a count, a hit a semi-join.
    """
    top = retrieval.filter(F.col("rank") <= n).join(truth.select("user_id", F.col("item_id").alias("target")), "user_id")
    lengths = events.groupBy(F.col("user_id").alias("neighbor_id")).agg(F.count(F.lit(1)).alias("_len"))
    owned = events.select(F.col("user_id").alias("neighbor_id"), F.col("item_id").alias("target")).distinct()
    per_user = (
        top.join(lengths, "neighbor_id", "left")
        .join(owned.withColumn("_hit", F.lit(1)), ["neighbor_id", "target"], "left")
        .groupBy("user_id")
        .agg(
            F.max(F.coalesce("_hit", F.lit(0))).alias("hit"),
            F.sum(F.coalesce("_len", F.lit(0))).alias("len"),
            F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"),
        )
    )
    sure = F.col("best") > confident

    def mean(c: Column) -> Column:
        return F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))

    return per_user.agg(
        F.count(F.lit(1)).alias("n"),
        mean(F.col("hit")).alias("hit_rate"),
        mean(F.col("len")).alias("mean_len"),
        F.coalesce(F.round(F.sum("hit") / F.sum("len"), 6), F.lit(0.0)).alias("hit_per_len"),
        F.count(F.when(sure, 1)).alias("confident"),
        mean(F.when(sure, F.col("hit"))).alias("confident_hit_rate"),
    )


def accuracy(rows: DataFrame, prediction: str, reference: str, weight: str | None = None) -> DataFrame:
    """Share and count of equal labels, optionally weighted."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    same = F.when(F.col(prediction) == F.col(reference), w).otherwise(0.0)
    return rows.agg(F.round(F.sum(same) / F.sum(w), 6).alias("accuracy"), F.round(F.sum(same), 6).alias("matches"))


def set_precision(guess: DataFrame, truth: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, precision, recall, f1)`` of the distinct values per key, for keys that both sides have.

    Values are counted, never collected: a key with any number of them is a few counts per task.
    """
    side = lambda df, g, t: df.select(key, value, F.lit(g).alias("_g"), F.lit(t).alias("_t"))
    pairs = side(guess, 1, 0).unionByName(side(truth, 0, 1)).filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.max("_g").alias("_g"), F.max("_t").alias("_t"))
    n = pairs.groupBy(key).agg(F.sum(F.col("_g") * F.col("_t")).alias("both"), F.sum("_g").alias("guessed"), F.sum("_t").alias("known"))
    share = lambda of, times=1: F.when(F.col("both") > 0, F.round(F.col("both") * times / of, 6)).otherwise(0.0)
    return n.filter("guessed > 0 AND known > 0").select(
        key, share(F.col("guessed")).alias("precision"), share(F.col("known")).alias("recall"), share(F.col("guessed") + F.col("known"), 2).alias("f1"))


def next_token_accuracy(rows: DataFrame, predicted: str, labels: str) -> DataFrame:
    """Prediction at a place against the label one place later, over all rows; a part of a longer row has the first label of the next."""
    size = F.greatest(F.size(labels) - 1, F.lit(0))
    same = F.zip_with(F.slice(predicted, 1, size), F.slice(labels, 2, size),
                      lambda p, l: F.when(p == l, 1).otherwise(0))
    counted = rows.select(F.aggregate(same, F.lit(0), lambda a, v: a + v).alias("hit"), F.size(same).alias("n"))
    return counted.agg(F.round(F.sum("hit") / F.sum("n"), 6).alias("accuracy"), F.sum("n").alias("places"))


def perplexity(loss: Column) -> Column:
    """``exp`` of the loss; infinity where that overflows."""
    return F.when(loss > 709.78, F.lit(float("inf"))).otherwise(F.exp(loss))


def comparison_table(parts: dict[str, DataFrame], metrics: Sequence[str] = ("hr_1", "hr_5", "hr_10", "mrr")) -> DataFrame:
    """One row per method."""
    table = None
    for method, df in parts.items():
        row = df.select(F.lit(method).alias("method"), *metrics)
        table = row if table is None else table.unionByName(row)
    return table


def query_rows(rows: DataFrame, threshold: int, user: str = "user_id", row: str = "row_idx", truth: str = "gt") -> DataFrame:
    """Of several query rows per user the last one whose true item lies below the threshold. Combined before the shuffle."""
    best = rows.filter(F.col(truth) < threshold).groupBy(user).agg(F.max(F.struct(row, truth)).alias("_b"))
    return best.select(user, f"_b.{row}", f"_b.{truth}")


def best_run(runs: DataFrame, run: str, metric: str, by: str | None = None) -> DataFrame:
    """Run with the largest metric; of equal ones the smaller run id."""
    place = F.max(F.struct(F.col(metric).alias("m"), (-F.col(run)).alias("r"))).alias("_b")
    best = runs.groupBy(by).agg(place) if by else runs.agg(place)
    return best.select(*([by] if by else []), (-F.col("_b.r")).alias(run), F.col("_b.m").alias(metric))


def metric_curve(wide: DataFrame, cutoffs: Sequence[int] = C.CUTOFFS) -> DataFrame:
    """Wide metrics to rows ``(k, hr, ndcg)``."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hr_{k}").alias("hr"), F.col(f"ndcg_{k}").alias("ndcg")) for k in cutoffs])
    return wide.select(F.explode(rows).alias("_r")).select("_r.k", "_r.hr", "_r.ndcg")


def run_scores(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """Score line of a validation run: MRR, gain at 5 and 10, hits at 1, 5 and 10."""
    r = F.col(rank)

    def mean(c: Column, name: str) -> Column:
        return F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(name)

    return ranks.agg(
        mean(R.reciprocal(r), "mrr"), mean(R.discounted(r, 5), "ndcg_5"), mean(R.discounted(r, 10), "ndcg_10"),
        mean(R.hit(r, 1), "hr_1"), mean(R.hit(r, 5), "hr_5"), mean(R.hit(r, 10), "hr_10"),
    )


def metric_report(parts: dict[str, DataFrame]) -> DataFrame:
    """Long report ``(section, metric, value)`` from one-row metric tables; parts given as None are left out."""
    report = None
    for section, df in parts.items():
        if df is None:
            continue
        named = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
        rows = df.select(F.explode(named).alias("_m")).select(F.lit(section).alias("section"), "_m.metric", "_m.value")
        report = rows if report is None else report.unionByName(rows)
    return report


def nested_report(report: DataFrame) -> DataFrame:
    """The long report as one JSON object per section."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))
    return report.groupBy("section").agg(F.to_json(entries).alias("body"))
