"""Transition and item-attribute graphs as edge tables, and feature propagation over them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from crossloom import constants as C
from crossloom.functions import text as T
from crossloom.functions import vectors as V
from crossloom.operators.ordering import HOT_ROWS, bounded, dense_index, exploded
from crossloom.operators.sequences import ORDER, transitions
from crossloom.session import written

BLOCK_NODES = 8192  # vectors that are multiplied together
CHUNK_EDGES = 1 << 16


def transition_graph(events: DataFrame, within_domain: bool = False, order: Sequence[str] = ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(src, dst, weight)``: how often ``dst`` directly followed ``src``."""
    return transitions(events, within_domain, order, hot_rows).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def normalise_rows(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weights divided by the out-weight of the source, per graph where ``by`` names some. The sums are joined back, so a hub is only a skewed join side."""
    keys = [*by, "src"]
    out = edges.groupBy(*keys).agg(F.sum("weight").alias("_out"))
    return edges.join(out, keys).withColumn(
        "weight", F.when(F.col("_out") == 0, 0.0).otherwise(F.col("weight") / F.col("_out"))).drop("_out")


def answer_tokens(answers: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct tokens of normalised answers: ``(key, token)``."""
    return exploded(answers, T.word_set(T.normalise_answer(F.col(text))), "token", key)


def default_tokens(users: DataFrame, tokens: DataFrame, defaults: Sequence[str] = tuple(C.DEFAULT_USER_TOKENS)) -> DataFrame:
    """Users without any token get the default ones."""
    missing = users.select("user_id").distinct().join(tokens.select("user_id").distinct(), "user_id", "left_anti")
    filled = missing.select("user_id", F.explode(F.array(*[F.lit(d) for d in defaults])).alias("token"))
    return tokens.select("user_id", "token").unionByName(filled)


def token_frequency(user_tokens: DataFrame, item_tokens: DataFrame) -> DataFrame:
    """Per token: users, X items and Y items that contain it (each entity counted once)."""
    u = user_tokens.select("token", F.lit("U").alias("kind"), F.col("user_id").cast("string").alias("entity"))
    i = item_tokens.select("token", F.col("domain").alias("kind"), F.col("item_id").cast("string").alias("entity"))
    once = u.unionByName(i).distinct()
    return once.groupBy("token").agg(
        F.count_if(F.col("kind") == "U").alias("users"),
        F.count_if(F.col("kind") == "X").alias("x_items"),
        F.count_if(F.col("kind") == "Y").alias("y_items"),
    )


def kept_tokens(frequency: DataFrame, ignore_users: bool = True) -> DataFrame:
    """Tokens of more than one X item or more than one Y item (and of more than one user, unless ignored)."""
    items = (F.col("x_items") > 1) | (F.col("y_items") > 1)
    return frequency.filter(items if ignore_users else items & (F.col("users") > 1))


def attribute_nodes(kept: DataFrame, n_items: int, n_users: int) -> DataFrame:
    """Node numbers behind items and users, in token order."""
    return dense_index(kept, ["token"], "_i").withColumn("node", F.col("_i") + n_items + n_users).drop("_i")


def attribute_graph(item_tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(graph, src, dst, weight)``: both directions in ``full``; attribute → X item in ``source``; Y item → attribute in ``target``.

    Every edge weighs 1 until ``normalise_rows``.

    ``item_tokens(item_id, domain, token)`` with node numbers as item ids; ``nodes`` from ``attribute_nodes``.
    """
    e = item_tokens.select("item_id", "domain", "token").distinct().join(nodes, "token")
    item, attr = F.col("item_id").cast("long"), F.col("node")
    edge = lambda graph, src, dst: F.struct(F.lit(graph).alias("graph"), src.alias("src"), dst.alias("dst"))
    source = (F.col("domain") == "X") & (F.col("x_items") > 1)
    target = (F.col("domain") == "Y") & (F.col("y_items") > 1)
    edges = F.array(edge("full", item, attr), edge("full", attr, item),
                    F.when(source, edge("source", attr, item)), F.when(target, edge("target", item, attr)))
    return e.select(F.explode(edges).alias("_e")).filter(F.col("_e").isNotNull()).select("_e.*", F.lit(1.0).alias("weight"))


def numbered_items(items: DataFrame) -> tuple[DataFrame, int]:
    """Items with contiguous numbers in id order, and how many node numbers they take: one more, for the blank item behind them."""
    numbered = dense_index(items, ["item_id"], "number")
    return numbered, numbered.count() + 1


def edge_blocks(edges: DataFrame, blocks: int, chunk_edges: int = CHUNK_EDGES) -> tuple[DataFrame, DataFrame]:
    """(``(block, chunk, edges)``, ``(block, chunks)``): edges by a hash of their target, written once, in arrays of about ``chunk_edges``.

    The edges of a target that very many nodes point to are spread over the chunks of its block.
    """
    dealt = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"), _block("dst", blocks).alias("block"))
    chunks = written(dealt.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk_edges).cast("int").alias("chunks")), "chunk-counts")
    chunk = F.pmod(F.xxhash64("src", "dst"), F.col("chunks")).cast("int")
    packed = dealt.join(bounded(chunks), "block").groupBy("block", chunk.alias("chunk")).agg(F.collect_list(F.struct("src", "dst", "weight")).alias("edges"))
    return written(packed, "edge-blocks"), chunks


def _block(node: str, blocks: int):
    return F.pmod(F.xxhash64(F.col(node).cast("long")), F.lit(blocks)).cast("int")


def propagate(edges: DataFrame, features: DataFrame, layers: int = 2, block_nodes: int = BLOCK_NODES, chunk_edges: int = CHUNK_EDGES) -> DataFrame:
    """Mean over the layers 0…n of the features summed along weighted edges: ``(node, embedding)``.

    Layer 0 is the node's own vector. Edges are packed into blocks by target once. In every layer a block
    of vectors is sent to the chunks of its edges, one task multiplies and sums per source, and only one
    vector per source and chunk leaves it; nothing is taken apart by dimension. Nodes have whole numbers.
    """
    node_type = features.schema["node"].dataType
    now = features.select("node", V.doubles(F.col("embedding")).alias("embedding"))
    n = features.count()
    blocks = max(1, math.ceil(n / block_nodes), min(features.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 256)))
    packed, chunks = edge_blocks(edges, blocks, chunk_edges)
    schema = T_.StructType([T_.StructField("node", node_type), T_.StructField("embedding", T_.ArrayType(T_.DoubleType()))])

    def product(left, right):
        import numpy as np
        import pyarrow as pa

        kind = right.schema.field("node").type
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], kind), pa.array([], pa.list_(pa.float64()))], names=["node", "embedding"])
        rows = left["edges"].combine_chunks().flatten()
        src, dst, weight = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        node = right["node"].to_numpy()
        order = np.argsort(node)
        vectors = right["embedding"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)[order]
        at = np.minimum(np.searchsorted(node[order], dst), len(node) - 1)
        known = node[order][at] == dst  # a target without a vector adds nothing
        src, at, weight = src[known], at[known], weight[known]
        by = np.argsort(src, kind="stable")
        src, at, weight = src[by], at[by], weight[by]
        return _summed(src, weight[:, None] * vectors[at], kind)

    total = now
    for _ in range(layers):
        sent = now.withColumn("block", _block("node", blocks)).join(bounded(chunks), "block")
        sent = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        parts = packed.groupBy("block", "chunk").cogroup(sent.groupBy("block", "chunk")).applyInArrow(product, schema)
        now = written(sum_vectors(parts), "layer")
        total = total.unionByName(now)
    mean = sum_vectors(total.join(features.select("node"), "node", "left_semi"))
    return mean.select("node", F.transform("embedding", lambda v: v / (layers + 1)).alias("embedding"))


def _summed(keys, vectors, kind):
    """A table of one vector per key, for vectors sorted by key."""
    import numpy as np
    import pyarrow as pa

    if not len(keys):
        return pa.table([pa.array([], kind), pa.array([], pa.list_(pa.float64()))], names=["node", "embedding"])
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.add.reduceat(vectors, start, axis=0)
    offsets = np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)
    return pa.table([pa.array(keys[start], kind), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))], names=["node", "embedding"])


def sum_vectors(parts: DataFrame) -> DataFrame:
    """One vector per node from any number of ``(node, embedding)`` of equal length; rows move once, as they are."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        held = None  # the sum of the last node so far, which the next batch may go on with
        kind = None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.column(0).type
            keys = b.column(0).to_numpy()
            vectors = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
            if held is not None:
                keys, vectors = np.concatenate([held[0], keys]), np.concatenate([held[1], vectors])
            table = _summed(keys, vectors, kind)
            node = table["node"].to_numpy()
            last = table["embedding"].combine_chunks()[-1].values.to_numpy()
            held = node[-1:], last[None, :]
            yield from table.slice(0, len(node) - 1).to_batches()
        if held is not None:
            yield from _summed(*held, kind).to_batches()

    # by an expression of the node: a plain repartition is dropped behind a join on the node, and that join may then turn into one without any order
    return parts.repartition(F.xxhash64("node")).sortWithinPartitions("node").mapInArrow(task, parts.schema)


def parse_edge_lists(lines: DataFrame, value: str = "value") -> DataFrame:
    """Edges from texts holding JSON lists of pairs; multiplicity is kept."""
    pairs = F.explode(F.from_json(F.col(value), "array<array<bigint>>")).alias("_e")
    return lines.select(*[c for c in lines.columns if c != value], pairs).select(
        *[c for c in lines.columns if c != value], F.col("_e")[0].alias("src"), F.col("_e")[1].alias("dst"))


def node_count(edges: DataFrame) -> DataFrame:
    return edges.agg((F.max(F.greatest("src", "dst")) + 1).alias("nodes"), F.count(F.lit(1)).alias("edges"))
