"""Grounding free text in a catalogue: ranking, exact titles, domain check, fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom import constants as C
from crossloom.functions import text as T
from crossloom.operators.ordering import bounded, exploded, keyed_join, spread, top_per_key
from crossloom.operators.similarity import PAIR_BUDGET, sparse_topk
from crossloom.session import materialize, written

TEXT_PARTS = 4  # tasks that count the tokens of one split of the texts


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Inverted index of non-blank texts: ``(doc, token, tf, doc_len)``. Texts are dealt by id and counted there."""
    return _counted(docs, doc, text).filter(F.col("token") != "").drop("head")


def _counted(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Postings, with a mark (``head``) at one row of each text; a text without a token has one row with the empty token.

    Texts are dealt by their id, which takes less room than their counts; the counts are then complete where they are made.
    """
    dealt = docs.select(doc, text)
    dealt = dealt.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, TEXT_PARTS * dealt.rdd.getNumPartitions()), doc)
    rows = dealt.filter(T.strip(F.col(text)) != "").select(doc, T.alnum_tokens(F.col(text)).alias("_t"))
    rows = rows.select(doc, F.size("_t").alias("doc_len"), F.posexplode_outer("_t").alias("_p", "token"))
    counts = rows.groupBy(doc, "token", "doc_len").agg(F.count("token").alias("tf"), F.coalesce(F.min("_p"), F.lit(0)).alias("_p"))
    return counts.select(doc, F.coalesce("token", F.lit("")).alias("token"), "tf", "doc_len", (F.col("_p") == 0).alias("head"))


def distinct_queries(queries: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Queries with the same tokens are scored once: ``(rep, tokens)`` and ``(key, rep)``; a MD5 digest stands for the tokens.

    Equal texts are combined before the shuffle, so one very frequent answer is no hot group.
    """
    bag = queries.select(key, F.sort_array(T.alnum_tokens(F.col(text))).alias("tokens")).filter(F.size("tokens") > 0)
    bag = bag.withColumn("rep", F.md5(F.array_join("tokens", " ").cast("binary")))
    return bag.select("rep", "tokens").dropDuplicates(["rep"]), bag.select(key, "rep")


def bm25(queries: DataFrame, docs: DataFrame, top_m: int, *, query: str = "q_id", query_text: str = "q_text",
         doc: str = "doc_id", doc_text: str = "text", k1: float = C.BM25_K1, b: float = C.BM25_B,
         epsilon: float = C.BM25_EPSILON, pair_budget: int = PAIR_BUDGET,
         strategy: str = "auto") -> DataFrame:
    """Okapi ranking: ``(query, doc, score, rank)``; only texts that share a token with the query.

    A repeated query token counts repeatedly; a negative idf is replaced by
    ``epsilon`` times the mean idf of the vocabulary.
    """
    index = written(_counted(docs, doc, doc_text), "text-index")  # read by column; everything else follows from it
    frequency = written(index.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), "token-counts")
    n = index.filter("head").count()
    frequency = frequency.filter(F.col("token") != "")
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    stats = frequency.agg(F.sum("cf").alias("cf"), F.avg(raw).alias("idf")).first()
    mean_len = (stats["cf"] or 0) / max(n, 1)
    floor = epsilon * (stats["idf"] or 0.0)
    idf = frequency.select("token", "df", F.when(raw < 0, F.lit(floor)).otherwise(raw).alias("idf"))

    reps, members = distinct_queries(queries, query, query_text)
    terms = reps.select("rep", F.explode("tokens").alias("token")).groupBy("rep", "token").agg(F.count(F.lit(1)).alias("qtf"))
    left = written(terms.join(idf, "token").select(
        F.col("rep").alias("l_id"), "token", (F.col("qtf") * F.col("idf")).alias("w"), F.lit(1).alias("l_size"), "df"), "query-terms")
    length = F.col("doc_len") / F.lit(mean_len or 1.0)
    right = index.filter(F.col("token") != "").select(
        F.col(doc).alias("r_id"), "token",
        (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))).alias("w"), F.col("doc_len").alias("r_size"))
    pairs = left.agg(F.sum("df")).first()[0] or 0
    sizes = index.filter("head").select(F.col("doc_len").alias("r_size"))
    best = sparse_topk(left, right, top_m, kind="dot", pairs=pairs, right_sizes=sizes, pair_budget=pair_budget, strategy=strategy)
    return keyed_join(members, best.withColumnRenamed("l_id", "rep"), ["rep"]).select(
        query, F.col("r_id").alias(doc), "score", "rank")


def token_overlap(queries: DataFrame, docs: DataFrame, top_m: int, *, query: str = "q_id", query_text: str = "q_text",
                  doc: str = "doc_id", doc_text: str = "text", pair_budget: int = PAIR_BUDGET, strategy: str = "auto") -> DataFrame:
    """Ranking by the share of distinct query tokens found in the text."""
    reps, members = distinct_queries(queries, query, query_text)
    sets = reps.select("rep", F.array_distinct("tokens").alias("t"))
    left = written(sets.select(
        F.col("rep").alias("l_id"), F.explode("t").alias("token"), F.lit(1.0).alias("w"), F.size("t").alias("l_size")), "query-tokens")
    vocabulary = bounded(left.select("token").distinct())
    sets = spread(docs.select(doc, doc_text), doc).filter(T.strip(F.col(doc_text)) != "").select(
        F.col(doc).alias("r_id"), F.array_distinct(T.alnum_tokens(F.col(doc_text))).alias("t"))
    right = exploded(sets.withColumn("r_size", F.size("t")), F.col("t"), "token", "r_id", "r_size").join(
        vocabulary, "token", "left_semi").select("r_id", "token", F.lit(1.0).alias("w"), "r_size")
    right = written(right, "text-tokens")
    best = sparse_topk(left, right, top_m, kind="overlap", pair_budget=pair_budget, strategy=strategy)
    return keyed_join(members, best.withColumnRenamed("l_id", "rep"), ["rep"]).select(
        query, F.col("r_id").alias(doc), "score", "rank")


def exact_title_boost(hits: DataFrame, queries: DataFrame, titles: DataFrame, top_m: int, *, query: str = "q_id",
                      query_text: str = "q_text", doc: str = "item_id", boost_to_top: bool = False) -> DataFrame:
    """An exactly equal title scores at least 1.

    In the list it keeps its place (or moves to the top on request); otherwise
    it is put first and the list is cut to ``top_m`` again.
    """
    keyed = queries.filter(F.size(T.alnum_tokens(F.col(query_text))) > 0).select(
        query, T.normalise(F.col(query_text)).alias("title_key"))
    exact = keyed_join(keyed, titles.select("title_key", F.col(doc).alias("_exact")), ["title_key"]).select(query, "_exact")
    both = hits.select(query, doc, "score", F.col("rank").alias("_place")).unionByName(
        exact.select(query, F.col("_exact").alias(doc), F.lit(1.0).alias("score"), F.lit(0).alias("_place")))
    # an exact title that was found keeps the better score and the place it had
    merged = both.groupBy(query, doc).agg(
        F.max("score").alias("score"), (F.min if boost_to_top else F.max)("_place").alias("_place"))
    return top_per_key(merged, [query], [F.asc("_place")], top_m).drop("_place")


def domain_check(hits: DataFrame, wanted: DataFrame, items: DataFrame, *, query: str = "q_id", doc: str = "item_id",
                 mode: str = "first") -> DataFrame:
    """``(query, in_domain)`` for queries with hits: does the best hit (or every hit) lie in the wanted domain?"""
    found = hits.filter(F.col("rank") == 1) if mode == "first" else hits
    label = items.select(doc, T.normalise_domain(F.coalesce("domain", F.lit(""))).alias("_found"))
    w = wanted.select(query, T.normalise_domain(F.col("target_domain")).alias("_wanted"))
    ok = (F.coalesce("_found", F.lit("")) == "") | (F.col("_found") == F.col("_wanted"))
    return found.join(label, doc, "left").join(w, query).groupBy(query).agg(F.min(ok).alias("in_domain"))


def refine(predictions: DataFrame, items: DataFrame, titles: DataFrame, fallback: DataFrame | None = None, *,
           top_m: int = C.TOP_M, keep: int = C.KEPT_CANDIDATES, pair_budget: int = PAIR_BUDGET) -> DataFrame:
    """Replace model answers by catalogue titles.

    ``predictions(user_id, prediction, target_domain, …)`` one row per user;
    ``fallback(user_id, rank, item_id)`` ranked candidates for answers outside
    the wanted domain (None: such answers stay as they are).
    """
    m = max(top_m, keep)
    queries = predictions.select(F.col("user_id").alias("q_id"), F.col("prediction").alias("q_text"))
    docs = items.select("item_id", F.col("title").alias("text"))
    hits = bm25(queries, docs, m, doc="item_id", pair_budget=pair_budget)
    hits = materialize(exact_title_boost(hits, queries, titles, m))
    named = items.select("item_id", F.col("title").alias("_title"), T.normalise_domain(F.coalesce("domain", F.lit(""))).alias("_domain"))

    def lists(ranked: DataFrame, key: str, prefix: str) -> DataFrame:
        entry = F.struct("rank", "item_id", "_title", "_domain", "score")
        packed = ranked.filter(F.col("rank") <= keep).join(named, "item_id").groupBy(F.col(key).alias("user_id")).agg(
            F.sort_array(F.collect_list(entry)).alias(prefix))  # at most `keep` entries
        return packed.select("user_id", prefix, F.col(prefix)[0].alias(f"{prefix}1"))

    out = predictions.join(lists(hits, "q_id", "_hit"), "user_id", "left")
    grounded = F.col("_hit").isNotNull()
    found = F.col("_hit1._domain")
    inside = grounded & ((found == "") | (found == T.normalise_domain(F.col("target_domain"))))
    if fallback is None:
        outside, fb_item, fb_title, fb_titles = F.lit(False), F.lit(None), F.lit(None), F.lit(None)
    else:
        out = out.join(lists(fallback.withColumn("score", F.lit(None).cast("double")), "user_id", "_fb"), "user_id", "left")
        outside = grounded & ~inside
        fb_item, fb_title, fb_titles = F.col("_fb1.item_id"), F.coalesce("_fb1._title", F.lit("")), F.col("_fb._title")
    refined = inside | outside
    return out.select(
        *[c for c in predictions.columns if c != "prediction"],
        F.when(inside, F.col("_hit1._title")).when(outside, fb_title).otherwise(F.col("prediction")).alias("prediction"),
        F.when(refined, F.col("prediction")).alias("prediction_original"),
        F.when(inside, F.col("_hit1.item_id")).when(outside, fb_item).alias("grounded_item_id"),
        F.when(inside, F.col("_hit1.score")).alias("grounded_score"),
        F.coalesce(F.when(outside, fb_titles), F.col("_hit._title")).alias("top_k_candidates"),
        grounded.alias("grounded"),
        refined.alias("refined"),
        outside.alias("fallback"),
    )


def refine_counters(refined: DataFrame) -> DataFrame:
    return refined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("grounded").alias("grounded"),
        F.count_if(F.col("refined") & ~F.col("fallback")).alias("in_domain"),
        F.count_if("fallback").alias("fallback"),
        F.count_if(~F.col("refined")).alias("not_refined"),
    )
