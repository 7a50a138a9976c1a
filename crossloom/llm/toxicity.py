"""Toxicity by a convolutional text classifier in numpy.

Words and their beginnings are hashed to embeddings; filters of several widths
slide over the whole text, each keeps its largest value, and a logistic layer
reads these. A threshold per language, chosen on rows apart from those the
weights were fitted to, is moved to 0.5. The language of a text is guessed
from its own words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.llm.common import crc_fold, raw_text, text_batches
from crossloom.operators.ordering import top_per_key

TABLE = 1 << 15  # rows of the embedding table
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8  # per width
BEGINNINGS = (5, 7)  # letters of a word that are hashed besides the whole
SAMPLE_ROWS = 4000  # labelled rows per class that are fitted to, at most
SAMPLE_BYTES = 24_000_000  # of text in them, at most
EPOCHS = 6
GUESS_WORDS = 40  # frequent words per language for the guess
SEGMENT = 1 << 15  # words convolved at once
KNOWN_WORDS = 200_000  # words remembered by a task


def words_of(text: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", text.lower())


def features(word: str) -> list[int]:
    """Rows of the embedding table for a word; row 0 is left to padding."""
    import xxhash

    parts = ["=" + word, *(f"{n}:{word[:n]}" for n in BEGINNINGS)]
    return [1 + xxhash.xxh3_64_intdigest(p) % (TABLE - 1) for p in parts]


class Network:
    def __init__(self, seed: int = 3):
        import numpy as np

        r = np.random.default_rng(seed)
        self.table = (r.standard_normal((TABLE, DIM)) * 0.1).astype(np.float32)
        self.table[0] = 0
        self.filters = [(r.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = (r.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.shift = np.float32(0)

    def maps(self, x):
        """Filter values at every word; ``x`` ends with padding as long as the widest filter reaches."""
        import numpy as np

        n = len(x) - max(WIDTHS) + 1
        return np.concatenate([sum(x[j : j + n] @ f[j] for j in range(len(f))) for f in self.filters], axis=1)

    def step(self, docs, labels, weights, rate, memory):
        """One Adagrad step on documents given as arrays of table rows (words x features)."""
        import numpy as np

        pad = np.zeros((max(WIDTHS) - 1, 1 + len(BEGINNINGS)), np.int32)
        grads = {"out": np.zeros_like(self.out), "bias": np.zeros_like(self.bias), "shift": np.zeros(1, np.float32)}
        by_filter = [np.zeros_like(f) for f in self.filters]
        rows, values = [], []
        for doc, label, weight in zip(docs, labels, weights):
            ids = np.concatenate([doc, pad]) if len(doc) else np.concatenate([pad[:1], pad])
            x = self.table[ids].sum(axis=1)
            z = self.maps(x)
            at = z.argmax(axis=0)
            m = z[at, np.arange(z.shape[1])] + self.bias
            act = np.tanh(m)
            p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.shift, -30, 30)))
            d = np.float32((p - label) * weight)
            grads["out"] += d * act
            grads["shift"] += d
            dm = d * self.out * (1 - act * act)
            grads["bias"] += dm
            for k, f in enumerate(self.filters):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(len(f)):
                    places = at[own] + j
                    by_filter[k][j] += x[places].T * dm[own]
                    g = (f[j] * dm[own]).T  # filters x DIM
                    rows.append(ids[places].ravel())
                    values.append(np.repeat(g, ids.shape[1], axis=0))
        rows, values = np.concatenate(rows), np.concatenate(values)
        real = rows > 0
        used, at = np.unique(rows[real], return_inverse=True)
        total = np.zeros((len(used), DIM), np.float32)
        np.add.at(total, at, values[real])

        def move(name, value, g):
            seen = memory.setdefault(name, np.full_like(value, 1e-6))
            seen += g * g
            value -= rate * g / np.sqrt(seen)

        move("out", self.out, grads["out"])
        move("bias", self.bias, grads["bias"])
        shift = np.atleast_1d(self.shift).astype(np.float32)
        move("shift", shift, grads["shift"])
        self.shift = shift[0]
        for k, f in enumerate(self.filters):
            move(f"f{k}", f, by_filter[k])
        seen = memory.setdefault("table", np.full((TABLE, 1), 1e-6, np.float32))
        seen[used] += (total * total).mean(axis=1, keepdims=True)
        self.table[used] -= rate * total / np.sqrt(seen[used])


class Vocabulary(dict):
    """Number of a word in the task's own table of summed embeddings; 0 is padding."""

    def __init__(self, network: Network, guesses: list[set]):
        import numpy as np

        self.network, self.guesses, self.new = network, guesses, []
        self.rows = np.zeros((1, DIM), np.float32)
        self.votes = np.zeros((1, len(guesses)), np.float32)

    def __missing__(self, word):
        self.new.append(word)
        number = self[word] = len(self.rows) + len(self.new) - 1
        return number

    def grow(self):
        import numpy as np

        if self.new:
            ids = np.array([features(w) for w in self.new])
            self.rows = np.concatenate([self.rows, self.network.table[ids].sum(axis=1)])
            self.votes = np.concatenate([self.votes, np.array([[w in g for g in self.guesses] for w in self.new], np.float32).reshape(len(self.new), -1)])
            self.new = []

    def forget(self):
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.rows, self.votes = self.rows[:1], self.votes[:1]


def scores(texts, model):
    """Calibrated scores of whole texts, in order."""
    import numpy as np

    if model is None:
        return np.full(len(texts), 0.0)
    network, guesses, thresholds, common = model["network"], model["guesses"], model["thresholds"], model["threshold"]
    known = model.get("known")
    if known is None:
        known = model["known"] = Vocabulary(network, guesses)
    reach = max(WIDTHS) - 1
    codes, owner, total = [], [], np.zeros((len(texts), len(guesses)), np.float32)
    pooled = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)

    def flush():
        known.grow()
        lengths = np.array([len(c) for c in codes])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.concatenate(codes)
        z = np.concatenate([network.maps(known.rows[flat]), np.full((reach, pooled.shape[1]), -np.inf, np.float32)])
        for i in range(1, reach + 1):  # windows that start in what follows a part
            z[starts + lengths - i] = -np.inf
        np.maximum.at(pooled, owner, np.maximum.reduceat(z, starts, axis=0))
        if len(guesses):
            np.add.at(total, owner, np.add.reduceat(known.votes[flat], starts, axis=0))

    size = 0
    for i, text in enumerate(texts):
        words = [known[w] for w in words_of(text)]
        for at in range(0, max(1, len(words)), SEGMENT):
            windows = max(1, min(SEGMENT, len(words) - at))
            part = words[at : at + windows + reach]
            part += [0] * (windows + reach - len(part))
            codes.append(np.array(part, np.int64))
            owner.append(i)
            size += len(part)
            if size >= SEGMENT:
                flush()
                codes, owner, size = [], [], 0
    if codes:
        flush()
    known.forget()
    logit = np.tanh(pooled + network.bias) @ network.out + network.shift
    cut = np.full(len(texts), common, np.float64)
    if len(guesses):
        best = total.argmax(axis=1)
        cut = np.where(total.max(axis=1) > 0, np.array(thresholds)[best], common)
    return 1 / (1 + np.exp(-np.clip(logit - cut, -30, 30)))


def fit(encoded, seed: int = 3):
    """Model from [(label, language or None, words)]; None if a class is missing.

    Every fourth row of a class sets the thresholds and is not fitted to.
    """
    import numpy as np
    from collections import Counter

    if len({label for label, _, _ in encoded}) < 2:
        return None
    r = np.random.default_rng(seed)
    turn: Counter = Counter()
    fitted, kept = [], []
    for row in encoded:
        turn[row[0]] += 1
        (kept if turn[row[0]] % 4 == 0 else fitted).append(row)
    kept = kept if len({x[0] for x in kept}) == 2 else fitted

    counts: dict[str, Counter] = {}
    for _, lang, words in fitted:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(words)
    share = {}
    for g, c in counts.items():
        total = c.total()
        share[g] = Counter({w: n / total for w, n in c.items()})
    guesses = []
    for g in sorted(share):
        rest = Counter()
        for other in share:
            if other != g:
                rest |= share[other]
        lead = sorted(share[g], key=lambda w: (rest[w] - share[g][w], w))[:GUESS_WORDS]
        guesses.append({w for w in lead if share[g][w] > rest[w]})

    network, memory = Network(seed), {}
    rows = {w: features(w) for w in {w for _, _, words in fitted for w in words}}
    docs = [np.array([rows[w] for w in words], np.int32).reshape(-1, 1 + len(BEGINNINGS)) for _, _, words in fitted]
    labels = np.array([x[0] for x in fitted], np.float32)
    weights = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (1 - labels).sum())).astype(np.float32)
    for epoch in range(EPOCHS):
        order = r.permutation(len(docs))
        for at in range(0, len(order), 16):
            own = order[at : at + 16]
            network.step([docs[i] for i in own], labels[own], weights[own], 0.1 / (1 + epoch / 2), memory)

    model = {"network": network, "guesses": guesses, "thresholds": [0.0] * len(guesses), "threshold": 0.0}
    raw = scores([" ".join(words) for _, _, words in kept], model)
    logit, label = np.log(raw / (1 - raw)), np.array([x[0] for x in kept])
    known = model.pop("known")
    votes = np.array([known.votes[[known.get(w, 0) for w in words] or [0]].sum(axis=0) for _, _, words in kept]).reshape(len(kept), -1)
    model["threshold"] = _threshold(logit, label)
    for g in range(len(guesses)):
        own = (votes.argmax(axis=1) == g) & (votes.max(axis=1) > 0)
        enough = min((label[own] == 1).sum(), (label[own] == 0).sum()) >= 5
        model["thresholds"][g] = _threshold(logit[own], label[own]) if enough else model["threshold"]
    return model


def _threshold(logit, label) -> float:
    """Middle of the gap with the highest balanced accuracy; of equal ones the middle of all."""
    import numpy as np

    edges = np.unique(logit)
    mids = np.concatenate([[edges[0] - 1], (edges[1:] + edges[:-1]) / 2, [edges[-1] + 1]])
    pos, neg = np.sort(logit[label == 1]), np.sort(logit[label == 0])
    right = 1 - np.searchsorted(pos, mids) / len(pos) + np.searchsorted(neg, mids) / len(neg)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(mids[best[0]] + mids[best[-1]]) / 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic"):
    """Model from a bounded sample of the labelled rows: at most ``SAMPLE_ROWS`` per class and ``SAMPLE_BYTES`` of text.

    A document with several labels counts as toxic if one says so; NULL labels
    count for nothing. Only ids, classes and sizes travel before the choice.
    """
    one = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    drawn = top_per_key(one.withColumn("draw", F.xxhash64(F.lit(3), "id")), ["label"], ["draw", "id"], SAMPLE_ROWS).select("id", "label", "draw")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    both = rows.join(F.broadcast(drawn), "id").withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    sizes = sorted(both.groupBy("id", "label", "draw").agg(F.sum("bytes").alias("bytes")).collect(), key=lambda x: (x.draw, x.id))
    left, chosen = SAMPLE_BYTES, []
    for row in sizes:
        if row.bytes <= left:
            left -= row.bytes
            chosen.append(row.id)
    if not chosen:
        return None
    few = docs.sparkSession.createDataFrame([(x,) for x in chosen], f"id {docs.schema[id_col].dataType.simpleString()}")
    held = both.join(F.broadcast(few), "id", "left_semi").select("id", "draw", "label", "lang", "text").collect()
    held = sorted(held, key=lambda x: (x.draw, x.id, x.text or ""))
    pool: dict[str, str] = {}  # equal words are one object
    return fit([(x.label, x.lang, [pool.setdefault(w, w) for w in words_of(x.text or "")]) for x in held])


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., score) per row from its whole text; NULL counts as empty. Without a model every score is 0."""

    def task(batches):
        import pyarrow as pa

        own = dict(model) if model is not None else None
        for b in text_batches(batches):
            n = b.num_columns - 1
            found = scores([x.decode("utf-8", "replace") for x in b.column(n).to_pylist()], own)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(found, pa.float64())], [*b.schema.names[:n], "score"])

    rows = raw_text(docs, F.col(id_col).alias("id"), *keep, text=text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(task, f"{schema}, score double")


def query(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.filter(crc_fold("doc_id", 5) != 0))
    rows = docs.withColumn("held_out", crc_fold("doc_id", 5) == 0)
    out = score(rows, model, keep=("held_out",)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")
