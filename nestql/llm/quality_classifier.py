"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A text's features are its words, its word pairs (a word that repeats its predecessor is one feature,
whatever the word) and its 3- and 4-byte n-grams, hashed into buckets. Every bucket has a learned vector; a
text is the average of its features' vectors and of some zero vectors, so that a few features decide little; a softmax over two classes gives the score.
Because the average and the output layer are both linear before the softmax, a trained model is folded
into one number per bucket, so that scoring is one table lookup per feature.

Training reads a bounded sample: at most `max_train` labelled rows, those with the smallest hash of the id.
Scoring reads every text whole and never uses labels, ids or other columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WordHashes, chunks_by_size, held_out

BUCKETS, DIM = 1 << 16, 16
#: Zero vectors that are averaged with a text's features.
PRIOR = 40
#: Bytes of text scored at once, which take some 50 bytes each.
CHUNK = 1 << 18


class Features:
    """Bucket numbers of many texts' features in four runs (words, pairs, 3-grams, 4-grams), and each text's part."""

    def __init__(self, texts: list[bytes]):
        w = WordHashes(texts, SPACE, lower=False)
        b = w.data.astype(np.uint32)
        three = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16)) if len(b) > 2 else np.zeros(0, np.uint32)
        four = three[:-1] | (b[3:] << np.uint32(24)) if len(b) > 3 else np.zeros(0, np.uint32)
        shift = np.uint32(16)
        one, two = w.hash[:-1], w.hash[1:]
        pairs = np.where(one == two, np.uint64(1), (one * np.uint64(31) + two) >> np.uint64(20))
        self.runs = [
            (w.hash & np.uint64(BUCKETS - 1)).astype(np.uint32),
            (pairs & np.uint64(BUCKETS - 1)).astype(np.uint32),
            (three * np.uint32(0x9E3779B1)) >> shift,
            (four * np.uint32(0x85EBCA6B)) >> shift,
        ]
        n = w.text_end - w.text_start
        self.bounds = [
            (w.first[:-1], w.first[1:]),
            (w.first[:-1], np.maximum(w.first[1:] - 1, w.first[:-1])),
            (w.text_start, w.text_start + np.maximum(n - 2, 0)),
            (w.text_start, w.text_start + np.maximum(n - 3, 0)),
        ]

    def sums(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the sum of its features' weights and their number."""
        total, count = 0.0, 0
        for run, (a, b) in zip(self.runs, self.bounds, strict=True):
            prefix = np.concatenate(([0.0], np.cumsum(weight[run], dtype=np.float64)))
            last = len(run)  # a text without features at the end may begin beyond the last one
            total = total + prefix[np.minimum(b, last)] - prefix[np.minimum(a, last)]
            count = count + (b - a)
        return total, count

    def counts(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [run[a[i] : b[i]] for run, (a, b) in zip(self.runs, self.bounds, strict=True)]
        return np.unique(np.concatenate(parts), return_counts=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 5, rate: float = 0.5, seed: int = 11) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias) of the logit of class 1, from rows of (buckets, counts, class)."""
    if not rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            buckets, counts, y = rows[r]
            if not len(buckets):
                continue
            share = (counts / (counts.sum() + PRIOR)).astype(np.float32)
            mean = share @ vectors[buckets]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            lr = np.float32(rate * (1 - step / steps))
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * p * np.float32(0.1)
            # a text's features share its gradient; scaled up, since each holds a small part of the average
            vectors[buckets] -= (lr * 20) * np.outer(np.minimum(share * 50, 1), back)
            step += 1
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score_texts(texts: list[bytes], weight: np.ndarray, bias: float) -> np.ndarray:
    parts = [np.zeros(0)]
    for i, j in chunks_by_size(texts, CHUNK):
        total, count = Features(texts[i:j]).sums(weight)
        parts.append(1 / (1 + np.exp(-(total / (count + PRIOR) + bias))))
    return np.concatenate(parts)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 2000):
    """Train on at most max_train labelled texts that are not held out; returns (weight, bias).

    Null labels and ids and null texts are not used; an id labelled twice takes its smaller label, an id with several
    texts its smallest text, so repeated rows change nothing; other columns are ignored. Without any usable row the model
    scores every text 0.5.
    """
    sample = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_train)
    )
    texts = (
        docs.where(F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(sample), "id")  # max_train rows at most
        .groupBy("id", "y")
        .agg(F.min("text").cast("binary").alias("text"))
    )

    def run(batches):
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                buckets, counts = Features([text]).counts(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([y], pa.int32()), pa.array([buckets.astype(np.uint16).tobytes()]), pa.array([counts.astype(np.uint32).tobytes()])],
                    ["y", "buckets", "counts"],
                )

    got = texts.select("id", "y", "text").orderBy("id").mapInArrow(run, "y int, buckets binary, counts binary").collect()
    return train([(np.frombuffer(r.buckets, np.uint16).astype(np.int64), np.frombuffer(r.counts, np.uint32), r.y) for r in got])


def quality_scores(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row (id, held_out, score, predicted) for each row of docs.

    Null texts score as empty ones, and those score by the bias alone. Rows are scored one by one, whole, so repeats
    stay repeats; a null id counts as held out; other columns, labels among them, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weight, bias = shared.value
        for batch in batches:
            score = score_texts([t or b"" for t in batch.column(2).to_pylist()], weight, bias)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                ["id", "held_out", "score", "predicted"],
            )

    plain = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").cast("binary"))
    kind = docs.schema[id_col].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def drop_low_quality(docs: DataFrame, model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least threshold; null texts score as empty ones."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(score_texts(texts, *shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
