"""Instruction rows, chat messages, prompts, and batched calls of a model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossloom import constants as C
from crossloom.functions import text as X
from crossloom.operators.ordering import last_per_key, top_per_key
from crossloom.operators.sequences import ORDER, recent_events


def few_shot_texts(retrieval: DataFrame, events: DataFrame, items: DataFrame, n: int = C.FEW_SHOT_ITEMS,
                   order: Sequence[str] = ORDER) -> DataFrame:
    """``(user_id, few_shot)``: one line per similar user with its last ``n`` items.

    The text of a neighbour is built once and then joined, however many users it serves.
    """
    meta = items.select("item_id", "title", F.col("domain").alias("_d"))
    wanted = retrieval.select(F.col("neighbor_id").alias("user_id")).distinct()
    # cut first, then filter: the other way round all events of a hot user would move into one task
    shown = recent_events(events, n, order).join(wanted, "user_id", "left_semi").join(meta, "item_id", "left")
    label = X.domain_label(F.coalesce("_d", F.lit("")), "Item")
    entry = F.concat(label, F.lit(": "), F.coalesce("title", F.col("item_id").cast("string")))
    packed = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("o"), entry.alias("e"))))
    lines = shown.groupBy(F.col("user_id").alias("neighbor_id")).agg(
        F.concat(F.lit(C.SIMILAR_USER_PREFIX), F.concat_ws(" | ", packed.getField("e"))).alias("line"))
    found = retrieval.select("user_id", "rank", "neighbor_id").join(lines, "neighbor_id", "left")
    # collect_list leaves out neighbours without events
    all_lines = F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("rank", "line"))))
    joined = F.concat_ws("\n", all_lines.getField("line"))
    return found.groupBy("user_id").agg(
        F.when(F.size(all_lines) > 0, joined).otherwise(C.NO_SIMILAR_USERS_FOUND).alias("few_shot"))


def history_texts(splits: DataFrame, items: DataFrame, n: int = C.HISTORY_LINES, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """``(keys, history)``: the last ``n`` entries of the ``seq`` array as ``  [domain] title`` lines."""
    at = F.posexplode(F.slice("seq", F.greatest(F.size("seq") - n + 1, F.lit(1)), n)).alias("_p", "_e")
    rows = splits.filter(F.size("seq") > 0).select(*keys, at).select(*keys, "_p", "_e.item_id", "_e.domain")
    titled = rows.join(items.select("item_id", "title"), "item_id", "left")
    line = F.concat(F.lit("  ["), X.domain_label(F.coalesce("domain", F.lit("?"))), F.lit("] "),
                    F.coalesce("title", F.col("item_id").cast("string")))
    packed = F.sort_array(F.collect_list(F.struct("_p", line.alias("line"))))
    return titled.groupBy(*keys).agg(F.concat_ws("\n", packed.getField("line")).alias("history"))


def instruction_rows(
    splits: DataFrame,
    profiles: DataFrame,
    items: DataFrame,
    few_shot: DataFrame | None = None,
    template: str = "profile",
    x_name: str = C.DOMAIN_X_NAME,
    y_name: str = C.DOMAIN_Y_NAME,
) -> DataFrame:
    """Instruction, input and output texts per split row.

    ``splits(split, user_id, seq, target)``; ``profiles`` as built by
    ``operators.profiles.profiles`` (users may be missing); ``few_shot(user_id, few_shot)``.
    Templates: base, profile, cot, retrieval; a retrieved text wins over the template.
    """
    from crossloom.operators.sequences import implicit_target

    rows = implicit_target(splits)
    history = history_texts(rows, items, keys=("split", "user_id"))
    meta = items.select(F.col("item_id").alias("target_item_id"), F.col("title").alias("_title"))
    p = profiles.select("user_id", "total", "x_count", "y_count", "preferred_attributes", "preferred_categories",
                        "similar_items", F.lit(True).alias("_has"))
    out = (
        rows.select("split", "user_id", F.col("target.item_id").alias("target_item_id"), F.col("target.domain").alias("_domain"))
        .join(history, ["split", "user_id"], "left").join(meta, "target_item_id", "left").join(p, "user_id", "left")
    )
    out = out.join(few_shot, "user_id", "left") if few_shot is not None else out.withColumn("few_shot", F.lit(None).cast("string"))

    has = F.coalesce("_has", F.lit(False)) if template != "base" else F.lit(False)
    attrs, cats = X.counted_text(F.col("preferred_attributes")), X.counted_text(F.col("preferred_categories"))
    profile = X.fill(C.INSTRUCTION_PROFILE, total_count=F.col("total"), domain_x_name=C.DOMAIN_LABELS.get(x_name, x_name),
                     domain_y_name=C.DOMAIN_LABELS.get(y_name, y_name), x_count=F.col("x_count"), y_count=F.col("y_count"),
                     top_attributes=attrs, top_categories=cats)
    known = lambda c: F.when(has, c).otherwise("N/A")
    domain = X.domain_label(F.coalesce("_domain", F.lit(x_name)))
    parts = dict(
        target_domain=F.col("target_domain"), interaction_sequence=F.coalesce("history", F.lit("")), user_profile_text=known(profile),
        preferred_attributes=known(attrs), preferred_categories=known(cats), similar_items=known(F.col("similar_items")),
        retrieved_users_text=F.coalesce("few_shot", F.lit(C.NO_SIMILAR_USERS_AVAILABLE)),
    )
    out = out.withColumn("target_domain", domain)
    with_retrieval = X.fill(C.RECOMMEND_RETRIEVAL, **parts)
    if template == "retrieval":
        body = with_retrieval
    else:
        chosen = {"base": C.RECOMMEND_BASE, "cot": C.RECOMMEND_COT}.get(template, C.RECOMMEND_PROFILE)
        body = F.when(F.coalesce("few_shot", F.lit("")) != "", with_retrieval).otherwise(X.fill(chosen, **parts))
    return out.select(
        "split",
        X.fill(C.INSTRUCTION_LINE, target_domain=F.col("target_domain")).alias("instruction"),
        X.strip(F.regexp_replace(body, "Instruction:|Input:", "")).alias("input"),
        F.coalesce("_title", F.col("target_item_id").cast("string")).alias("output"),
        "user_id", "target_item_id", "target_domain",
    )


def chat_rows(instructions: DataFrame) -> DataFrame:
    """System, user and assistant message per instruction row."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(
        message("system", F.lit(C.SYSTEM_MESSAGE)),
        message("user", F.concat("instruction", F.lit("\n\n"), "input")),
        message("assistant", F.col("output")),
    )
    return instructions.select(messages.alias("messages"), "user_id", "target_item_id", "target_domain")


def chat_prompts(chats: DataFrame) -> DataFrame:
    """Content of the first user message; rows without one are dropped."""
    first = F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(1))
    return chats.withColumn("prompt", first["content"]).filter(F.col("prompt").isNotNull())


def plain_prompts(instructions: DataFrame) -> DataFrame:
    """Instruction and input with the answer left open."""
    text = X.fill(C.PLAIN_PROMPT, instruction=F.col("instruction"), input=F.col("input"))
    return instructions.withColumn("prompt", text)


def alpaca_prompts(rows: DataFrame, label: str | None = None) -> DataFrame:
    """Long prompt form, with or without an input; a label column is appended when given."""
    with_input = X.fill(C.ALPACA_WITH_INPUT, instruction=F.col("instruction"), input=F.col("input"))
    without = X.fill(C.ALPACA_WITHOUT_INPUT, instruction=F.col("instruction"))
    text = F.when(F.coalesce("input", F.lit("")) != "", with_input).otherwise(without)
    return rows.withColumn("prompt", F.concat(text, F.coalesce(label, F.lit(""))) if label else text)


def budgeted_neighbour_text(pairs: DataFrame, events: DataFrame, items: DataFrame, budget: int = C.PROMPT_WORDS,
                            order: Sequence[str] = ORDER) -> DataFrame:
    """``(user_id, few_shot)``: a neighbour's items from the start while the prompt stays below the word budget.

    ``pairs(user_id, neighbor_id, base_words)``. Every item adds at least two
    words, so at most ``budget`` events of a neighbour are ever needed.
    """
    from pyspark.sql import Window

    wanted = pairs.select(F.col("neighbor_id").alias("user_id")).distinct()
    first = top_per_key(events, ["user_id"], [F.asc(c) for c in order], budget, "pos").join(wanted, "user_id", "left_semi")
    meta = items.select("item_id", "title")
    name = F.when(F.col("domain") == "X", "art:").otherwise("office:")
    piece = F.concat(F.lit(" "), name, F.coalesce("title", F.col("item_id").cast("string")), F.lit(" |"))
    shown = first.join(meta, "item_id", "left").select(F.col("user_id").alias("neighbor_id"), "pos", piece.alias("piece"))
    before = F.coalesce(F.sum(F.size(X.words(F.col("piece")))).over(
        Window.partitionBy("neighbor_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = shown.withColumn("before", before).withColumn("piece", F.struct("pos", "before", "piece"))
    # one array of at most `budget` pieces per neighbour, cut per user by the words the user's prompt has already
    lists = shown.groupBy("neighbor_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    prefix_words = len(C.NEIGHBOUR_PROMPT_PREFIX.split())
    kept = F.filter("pieces", lambda p: F.col("base_words") + prefix_words + p["before"] < budget)
    return pairs.join(lists, "neighbor_id", "left").select(
        "user_id", F.concat(F.lit(C.NEIGHBOUR_PROMPT_PREFIX), F.coalesce(F.concat_ws("", kept.getField("piece")), F.lit(""))).alias("few_shot"))


def attribute_prompts(items: DataFrame, language: str = "en") -> DataFrame:
    """One attribute prompt per catalogue row."""
    template = C.ATTRIBUTE_EN if language == "en" else C.ATTRIBUTE_ZH
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    text = X.fill(template, title=value("title"), description=value("description"), category=value("category"))
    return items.select("item_id", "domain", text.alias("prompt"))


def response_attributes(responses: DataFrame, id_map: DataFrame) -> DataFrame:
    """``(item_id, attributes)`` from ``responses(qqid, pos, content)``: unmapped ids and empty lists go, the last answer per item stays."""
    listed = responses.select("qqid", "pos", X.loose_list(F.col("content")).alias("attributes"))
    mapped = listed.join(id_map.select(F.col("idx").alias("qqid"), "item_id"), "qqid").filter(F.size("attributes") > 0)
    return last_per_key(mapped, ["item_id"], ["pos"]).select("item_id", "attributes")


def call_model(rows: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt", out: str = "prediction",
               batch_size: int = C.GENERATION_BATCH, partitions: int | None = None) -> DataFrame:
    """Run ``model(prompts) -> answers`` over all rows in small batches.

    Partitions work independently; ``partitions`` spreads the rows evenly over that many. When a batch fails its prompts are tried
    one by one, so a failure stays with its row: NULL answer and the message in ``error``.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType()), T.StructField("error", T.StringType())])

    def run(frames):
        for frame in frames:
            prompts = frame[prompt].tolist()
            answers: list = []
            errors: list = []
            for start in range(0, len(prompts), batch_size):
                part = prompts[start : start + batch_size]
                try:
                    got = list(model(part))
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} answers for {len(part)} prompts")
                    answers += got
                    errors += [None] * len(part)
                except Exception:  # noqa: BLE001 - isolate the failing prompt
                    for text in part:
                        try:
                            answers.append(model([text])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            answers.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
            yield frame.assign(**{out: answers, "error": errors})

    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, schema)
