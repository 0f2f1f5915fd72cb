"""Toxicity by logistic regression with FTRL-proximal updates.

Features are hashed words, pairs of neighbours and pairs with one word between, each counted once
in a text. The learning rate is kept per coordinate, and L1 makes most weights exactly zero, so
that the weights that go to the executors are a short sparse list. Training uses a bounded sample
of the labelled rows (``sample`` rows expected, chosen by a hash of the id), dealt by that hash to
one task for each 4,000 rows, ``shards`` at most. Each shard learns alone; a weight counts if at least half of the shards give it
one, and is their mean. Scoring reads every whole text.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weeklane.llm.common import cut, small, text_of
from weeklane.llm.minhash import MIX, mixed
from weeklane.llm.winnowing import hashes, words_of

BITS = 22
CHUNK = 65_536  # words hashed at once


def features(text: bytes) -> np.ndarray:
    """Hashed places of a text's features from 1, with repeats."""
    words = words_of(text)
    h = np.concatenate([hashes(words[i : i + CHUNK]) for i in range(0, len(words), CHUNK)]) if words else np.zeros(0, np.uint64)
    near = mixed(h[:-1] * MIX[0] + h[1:])
    skip = mixed(h[:-2] * MIX[1] + h[2:] * MIX[2])
    return (np.concatenate([h, near, skip]) >> np.uint64(64 - BITS)).astype(np.int64) + 1


def learn(rows: list, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """rows: (distinct places, label), in the order of learning. Places with a weight, and weights."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(zi, ni, first):
        w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
        if first:  # the bias, which has no L1
            w[0] = -zi[0] / ((beta + np.sqrt(ni[0])) / alpha + l2)
        return w

    for _ in range(epochs):
        for at, label in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni, True)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    at = np.r_[0, np.flatnonzero(np.abs(z[1:]) > l1) + 1]
    return at, weights(z[at], n[at], True)


def fitted(docs: DataFrame, labels: DataFrame, sample: int, shards: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> dict:
    """Weights by place; 0 is the bias. docs: doc, text. labels: doc, label."""
    labels = cut(labels.where("doc is not null and label is not null").groupBy("doc").agg(F.max("label").alias("label")), "labels")
    known = labels.count()
    rate = min(1.0, sample / max(known, 1))
    shards = max(1, min(shards, round(rate * known / 4_000)))
    order = F.xxhash64("doc", F.lit("toxicity"))
    chosen = labels.where(F.pmod(order, F.lit(1_000_000)) < int(rate * 1_000_000))
    rows = docs.join(small(chosen, 2 * sample), "doc").withColumn("order", order)

    def run(batches):
        rows: dict[int, list] = {}
        for batch in batches:
            for shard, text, label in zip(batch.column("shard").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("label").to_pylist(), strict=True):
                rows.setdefault(shard, []).append((np.r_[0, np.unique(features(text))], label))
        for own in rows.values():
            at, w = learn(own, alpha, beta, l1, l2, epochs)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "w"])

    rows = rows.withColumn("shard", F.pmod("order", F.lit(shards)).cast("int"))
    dealt = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "order", "text").select("shard", "text", "label")
    own = cut(dealt.mapInArrow(run, "at long, w double"), "weights")
    ran = own.where("at = 0").count()
    mean = own.groupBy("at").agg(F.count("*").alias("k"), F.sum("w").alias("w")).where(2 * F.col("k") >= ran)
    return {r["at"]: r["w"] / ran for r in mean.collect()}  # sparse by L1; at most 2**BITS + 1 rows


def toxicity(docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 24_000, shards: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, epochs: int = 5, columns: list | None = None, score_col: str = "score") -> DataFrame:
    """Adds the score (0 to 1) to the id column, or to all of ``columns``, one row per input row.

    training: condition over the id column; only labels that meet it are learned from. A null text
    is empty; texts without words get the bias alone. Repeated labels of an id count once, as toxic
    if one says so. Without labels every score is 0.5.
    """
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(training).withColumnRenamed(id_col, "doc")
    weights = fitted(docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text")), known, sample, shards, alpha, beta, l1, l2, epochs)
    sparse = np.array(sorted(weights), np.int64), np.array([weights[k] for k in sorted(weights)], np.float64)
    shared = docs.sparkSession.sparkContext.broadcast(sparse)
    names = columns or [id_col]
    own = docs.select(*names, F.col(text_col).alias("_text_to_score"))

    def run(batches):
        at, w = shared.value
        table = np.zeros((1 << BITS) + 1, np.float32)
        table[at] = w
        bias = float(w[0]) if len(at) and at[0] == 0 else 0.0
        for batch in batches:
            scores = []
            for text in batch.column(len(names)).cast(pa.large_binary()).to_pylist():
                f = features(text or b"")
                f = np.unique(f[table[f] != 0])
                scores.append(1 / (1 + np.exp(-np.clip(bias + float(table[f].sum()), -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*names, score_col])

    return own.mapInArrow(run, T.StructType([*own.schema.fields[:-1], T.StructField(score_col, T.DoubleType())]))
