"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output.

The model is fitted by stochastic gradient descent in numpy, in one task, on a bounded sample of labelled rows
(SAMPLE a class, chosen by a hash of the id). As the output is linear in the average of the vectors, scoring
needs one number a bucket: its vector's product with the difference of the two output vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, rowed, table, tidied

BUCKETS_LOG2 = 18
DIMENSIONS = 8
#: Labelled rows a class that the model is fitted on, at most.
SAMPLE = 2000
EPOCHS = 4
#: Features of no weight that each average holds besides, so that a few words do not decide alone.
PRIOR = 32
RATE = 30.0
_STEP = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


def buckets(text: str | None) -> np.ndarray:
    """A bucket for each word and each run of 3 and of 5 characters (code points) of the whole text."""
    flat = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for n in (3, 5):
        if len(flat) >= n:
            h = np.full(len(flat) - n + 1, n, np.uint32)
            for j in range(n):
                h += flat[j : len(flat) - n + 1 + j] * _STEP[j]
            h ^= h >> np.uint32(15)
            found.append((h * _STEP[1]) >> np.uint32(32 - BUCKETS_LOG2))
    if len(flat):
        gap = (flat == 32) | ((flat >= 9) & (flat <= 13))
        sums = np.zeros(len(flat) + 1, np.uint32)
        np.cumsum(flat * (flat + np.uint32(0x10001)), out=sums[1:], dtype=np.uint32)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        h = (sums[stop] - sums[start]) * _STEP[2] + flat[start] * _STEP[3] + flat[stop - 1] * _STEP[4] + (stop - start).astype(np.uint32)
        h ^= h >> np.uint32(15)
        found.append((h * _STEP[0]) >> np.uint32(32 - BUCKETS_LOG2))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> tuple[np.ndarray, float]:
    """The logit that each bucket adds when averaged, and the bias. rows: distinct buckets, their shares, label 0 or 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKETS_LOG2, DIMENSIONS)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (2, DIMENSIONS)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            index, share, label = rows[i]
            rate = 1 - done / steps
            done += 1
            hidden = share @ vectors[index] if len(index) else np.zeros(DIMENSIONS, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            if len(index):
                vectors[index] -= RATE * rate * share[:, None] * (p @ out)[None, :]
            out -= 0.5 * rate * np.outer(p, hidden)
            bias -= 0.05 * rate * p
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def _fit(batches):
    rows = []
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            index, n = np.unique(buckets(text), return_counts=True)
            rows.append((index, (n / (n.sum() + PRIOR)).astype(np.float32), label))
    logits, bias = train(rows) if rows else (np.zeros(1 << BUCKETS_LOG2, np.float32), 0.0)
    yield pa.record_batch([pa.array([logits.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], ["logits", "bias"])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model from the labelled rows of labels(doc_id, quality) that aren't held out; null labels and ids are left out."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    labels = labels.where(~_held_out("doc_id")).groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("_h", F.md5(F.col("doc_id").cast("string")))
    chosen = labels.where("y = 0").orderBy("_h").limit(sample).union(labels.where("y = 1").orderBy("_h").limit(sample))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("_h", "y").agg(F.min("text").alias("text"))  # 2 * sample rows, one an id
    model = rows.repartition(1).sortWithinPartitions("_h").select("text", "y").mapInArrow(tidied(_fit), "logits binary, bias double").collect()
    if not model:  # an empty table has no partition to fit in
        return np.zeros(1 << BUCKETS_LOG2, np.float32), 0.0
    model = model[0]
    n = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = [n.get(1, 0), n.get(0, 0), min(sample, n.get(0, 0)), min(sample, n.get(1, 0))]
    # The sample has other shares of the two classes than the labels have; the bias makes up for it.
    prior = float(np.log(odds[0] / odds[1] * odds[2] / odds[3])) if all(odds) else 0.0
    return np.frombuffer(bytes(model["logits"]), np.float32), model["bias"] + prior


def _held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scores(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """row, a struct of the columns of documents, and score (0 to 1, also for null and empty texts) of every row."""
    bounded_batches(documents.sparkSession)
    logits_b = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        logits, bias = logits_b.value
        means = []
        for t in texts:
            h = buckets(t)
            means.append(float(logits[h].sum(dtype=np.float64)) / (len(h) + PRIOR))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(means) + bias, -500, 500))), dtype="float64")

    return rowed(documents, score=score(F.col("text").cast("string")))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents(doc_id, text).

    Without any labelled row each score is 0.5 and each document is predicted 1. Rows that repeat an id are
    scored each, and one of their texts is fitted on; of an id's contradicting labels the lower counts. A null id is not
    held out. An empty table gives no rows. Other columns are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scores(docs, fit(docs, labels))
    return out.select("row.doc_id", _held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
