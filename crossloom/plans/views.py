"""The driver tables seen as recommendation data (one method per logical table)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossloom.operators import sequences as S
from crossloom.operators.chunks import chunked
from crossloom.operators.ordering import top_per_key
from crossloom.session import materialize, written

FIRST_Y = 50  # items 0-99 occur in the events; the first half belongs to X
DAYS = 1 << 20  # day numbers of a user; half of them lie before 1970
CYCLE = 100  # further catalogue items alternate in the same way


class Tables:
    """Lazy views over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        """Interaction events of two domains."""
        item = F.regexp_extract("props", "[0-9]+", 0).cast("int")
        return self.table("events").select(
            "event_id", "user_id", "ts", item.alias("item_id"),
            S.domain_by_threshold(item, FIRST_Y).alias("domain"), "event_type", "value",
        )

    @cached_property
    def ev_daily(self) -> DataFrame:
        """The same events with a user for every pair of user and day: short and many sequences over the whole table."""
        day = F.unix_date(F.col("ts").cast("date")) + DAYS // 2  # no two pairs share a number, whatever the day
        return self.ev.withColumn("user_id", F.col("user_id") * DAYS + day)

    @cached_property
    def recent(self) -> DataFrame:
        """The last 15 events per user, written once for the queries that cut several shorter histories from them."""
        return written(S.recent_events(self.ev, 15).drop("back"), "recent")

    @cached_property
    def daily_chunks(self) -> DataFrame:
        """``(user_id, chunk, first, seq)``: all events of a user and day in chunks, whatever their number."""
        return chunked(self.ev_daily, ["user_id"], S.ORDER, ("item_id", "domain", "event_type", "value"))

    @cached_property
    def customers(self) -> DataFrame:
        """All customers; many have no event, no vector and no answer."""
        return self.table("customer").select(F.col("c_custkey").alias("user_id"))

    @cached_property
    def items(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").cast("int").alias("item_id"),
            F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"),
            F.col("p_name").alias("short_title"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
            S.domain_by_threshold(F.col("p_partkey") % CYCLE, FIRST_Y).alias("domain"),
        )

    @cached_property
    def item_attributes(self) -> DataFrame:
        """``(item_id, pos, attribute)``: words of the short title, then the category."""
        values = F.concat(F.split("short_title", " "), F.array(F.lower("category")))
        return self.items.select("item_id", F.posexplode(values).alias("pos", "attribute"))

    @cached_property
    def target(self) -> DataFrame:
        return S.last_event(self.ev)

    @cached_property
    def hist(self) -> DataFrame:
        return S.without_last(self.ev)

    @cached_property
    def preds(self) -> DataFrame:
        """The 20 most frequent history items per user, ranked."""
        # counting all events and taking the newest one off again avoids a join of the events by user
        seen = self.ev.select("user_id", "item_id", F.lit(1).cast("long").alias("w"))
        newest = self.target.select("user_id", "item_id", F.lit(-1).cast("long").alias("w"))
        counts = seen.unionByName(newest).groupBy("user_id", "item_id").agg(F.sum("w").alias("cnt")).filter("cnt > 0")
        return top_per_key(counts, ["user_id"], [F.desc("cnt"), F.asc("item_id")], 20)

    @cached_property
    def scores(self) -> DataFrame:
        """A long score table: value per user and history item."""
        return self.hist.groupBy("user_id", "item_id", "domain").agg(F.round(F.sum("value"), 4).alias("score"))

    @cached_property
    def title_lists(self) -> DataFrame:
        """``(user_id, candidates, target_title)`` with ranked titles."""
        from crossloom.operators.sequences import collect_ordered

        titled = self.preds.join(self.items.select("item_id", "title"), "item_id")
        lists = collect_ordered(titled, ["user_id"], ["rank"], ["title"], "_l")
        truth = self.target.join(self.items.select("item_id", "title"), "item_id")
        return lists.join(truth.select("user_id", F.col("title").alias("target_title"), "domain"), "user_id").select(
            "user_id", F.col("_l.title").alias("candidates"), "target_title", "domain"
        )

    @cached_property
    def text_preds(self) -> DataFrame:
        """One text answer per user, in five kinds. Written once, as the answers of a model would be."""
        t = self.target.select("user_id", F.col("item_id").alias("target_item_id"), F.col("domain").alias("target_domain"))
        i = self.items.select(F.col("item_id").alias("target_item_id"), F.col("title").alias("ground_truth"), "short_title")
        first = self.preds.filter("rank = 1").join(self.items.select("item_id", "title"), "item_id").select(
            "user_id", F.col("title").alias("_first"))
        kind = F.col("user_id") % 5
        answer = (
            F.when(kind == 0, F.concat(F.lit("  "), F.upper("ground_truth"), F.lit(" ")))
            .when(kind == 1, F.col("short_title")).when(kind == 2, F.col("_first"))
            .when(kind == 3, "").otherwise("zzz unknown thing")
        )
        return materialize(t.join(i, "target_item_id").join(first, "user_id", "left").select(
            "user_id", "target_item_id", "target_domain", "ground_truth", answer.alias("prediction")
        ))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), "embedding", F.when(F.col("label") < 5, "X").otherwise("Y").alias("domain")
        )

    @cached_property
    def user_vec(self) -> DataFrame:
        """One vector per user and domain; the Y vector is the reversed X vector."""
        users = self.ev.select("user_id").distinct()
        v = self.table("embeddings").select(F.col("vec_id").alias("user_id"), "embedding").join(users, "user_id", "left_semi")
        return v.select("user_id", F.col("embedding").alias("x_vec"), F.reverse("embedding").alias("y_vec"))

    @cached_property
    def item_vec(self) -> DataFrame:
        domain = S.domain_by_threshold(F.col("vec_id") % CYCLE, FIRST_Y)
        return self.table("embeddings").select(
            F.col("vec_id").cast("int").alias("item_id"), domain.alias("domain"),
            F.when(domain == "X", F.col("embedding")).otherwise(F.reverse("embedding")).alias("embedding"))


# The same views for the SQL side; unused ones cost nothing.
SQL_VIEWS = r"""
ev AS (SELECT event_id, user_id, ts, CAST(regexp_extract(props,'[0-9]+') AS INT) AS item_id,
  CASE WHEN CAST(regexp_extract(props,'[0-9]+') AS INT) < 50 THEN 'X' ELSE 'Y' END AS domain, event_type, value FROM events),
ev_daily AS (SELECT * REPLACE (user_id * 1048576 + (CAST(ts AS DATE) - DATE '1970-01-01') + 524288 AS user_id) FROM ev),
ranked_daily AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM ev_daily),
items AS (SELECT CAST(p_partkey AS INT) AS item_id, p_name || ' ' || p_brand || ' ' || p_type AS title,
  p_name AS short_title, p_type AS category, p_brand AS brand,
  CASE WHEN p_partkey % 100 < 50 THEN 'X' ELSE 'Y' END AS domain FROM part),
item_attributes AS (SELECT item_id, CAST(u.pos - 1 AS INT) AS pos, u.a AS attribute FROM (
  SELECT item_id, list_append(string_split(short_title,' '), lower(category)) AS l FROM items),
  LATERAL (SELECT unnest(l) AS a, generate_subscripts(l,1) AS pos) u),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM ev),
target AS (SELECT * EXCLUDE (back, pos) FROM ranked WHERE back = 1),
hist AS (SELECT * EXCLUDE (back, pos) FROM ranked WHERE back > 1),
preds AS (SELECT user_id, item_id, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, item_id) AS rank
  FROM (SELECT user_id, item_id, count(*) AS cnt FROM hist GROUP BY ALL)) WHERE rank <= 20),
scores AS (SELECT user_id, item_id, domain, round(sum(value),4) AS score FROM hist GROUP BY ALL),
title_lists AS (SELECT p.user_id, list(i.title ORDER BY p.rank) AS candidates, any_value(ti.title) AS target_title, any_value(t.domain) AS domain
  FROM preds p JOIN items i USING (item_id) JOIN target t ON t.user_id = p.user_id JOIN items ti ON ti.item_id = t.item_id GROUP BY p.user_id),
text_preds AS (SELECT t.user_id, t.item_id AS target_item_id, t.domain AS target_domain, i.title AS ground_truth,
  CASE t.user_id % 5 WHEN 0 THEN '  ' || upper(i.title) || ' ' WHEN 1 THEN i.short_title WHEN 2 THEN pi.title WHEN 3 THEN '' ELSE 'zzz unknown thing' END AS prediction
  FROM target t JOIN items i ON i.item_id = t.item_id LEFT JOIN preds p ON p.user_id = t.user_id AND p.rank = 1 LEFT JOIN items pi ON pi.item_id = p.item_id),
vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, CASE WHEN label < 5 THEN 'X' ELSE 'Y' END AS domain FROM embeddings),
user_vec AS (SELECT vec_id AS user_id, CAST(embedding AS DOUBLE[]) AS x_vec, list_reverse(CAST(embedding AS DOUBLE[])) AS y_vec
  FROM embeddings WHERE vec_id IN (SELECT user_id FROM events)),
item_vec AS (SELECT CAST(vec_id AS INT) AS item_id, CASE WHEN vec_id % 100 < 50 THEN 'X' ELSE 'Y' END AS domain,
  CASE WHEN vec_id % 100 < 50 THEN CAST(embedding AS DOUBLE[]) ELSE list_reverse(CAST(embedding AS DOUBLE[])) END AS embedding FROM embeddings)
"""
