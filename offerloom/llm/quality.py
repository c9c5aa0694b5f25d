"""Quality of documents: supervised subword embeddings.

Every word and every byte n-gram of a text is hashed to a slot, and each slot has a learned vector.
A document is the average of its vectors; a softmax over two classes sits on top. Vectors and the
softmax are trained together by stochastic gradient descent in numpy, on a bounded sample of
labelled documents (``per_class`` of each class, those with the smallest hash of their id). Class
weights undo the balance of the sample, so a score keeps the meaning of a probability.

Scoring reads every whole text. Because the average and the output layer are linear, the score of a
text needs one number per slot: the slot's vector times the difference of the two output rows.

Defined results: a null or empty text has no features and gets the score of the bias alone. Without
labels of both classes the score is the share of good labels (0.5 without any). Repeated rows are
scored alike, once per row; a row without doc_id is scored and never trained on. Columns beside
doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import held_out, map_texts, text_column
from offerloom.llm.texthash import grams, slots, utf8, word_hashes

BITS = 16
SIZES = (3, 5)
PER_CLASS = 1200


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text and their shares of all its features."""
    counts = np.zeros(1 << BITS, np.float32)
    for found in _slot_lists(text):
        counts += np.bincount(found, minlength=1 << BITS)
    used = np.flatnonzero(counts)
    return used.astype(np.uint16), counts[used] / max(1.0, float(counts.sum()))


def _slot_lists(text: str):
    raw = utf8(text)
    for size in SIZES:
        yield slots(grams(raw, size), BITS)
    yield slots(word_hashes(text, lower=False), BITS)


@dataclass
class QualityModel:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def slot_scores(self) -> np.ndarray:
        """What one feature adds to the difference of the two classes."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    weights: np.ndarray,
    dimensions: int = 8,
    epochs: int = 6,
    rate: float = 4.0,
    seed: int = 7,
) -> QualityModel:
    random = np.random.default_rng(seed)
    vectors = random.uniform(-0.5, 0.5, (1 << BITS, dimensions)).astype(np.float32) / dimensions
    output = random.uniform(-0.5, 0.5, (2, dimensions)).astype(np.float32)
    share = np.array([weights[labels == k].sum() for k in (0, 1)]) / weights.sum()
    bias = np.log(np.maximum(share, 1e-6)).astype(np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            used, shares = rows[i]
            step = rate * float(weights[i]) * (1 - done / steps)
            done += 1
            mean = shares @ vectors[used]
            logits = output @ mean + bias
            gap = np.exp(logits - logits.max())
            gap /= gap.sum()
            gap[labels[i]] -= 1
            down = gap @ output
            output -= 0.1 * step * np.outer(gap, mean)
            bias -= 0.01 * step * gap
            vectors[used] -= (step * 10) * np.outer(shares, down)
    return QualityModel(vectors, output, bias)


def bounded_labels(labels: DataFrame, column: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled ids of each class outside the held-out part, and the class counts."""
    usable = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    counts = {int(r["label"]): r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [
        usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)
    ]
    return chosen[0].unionByName(chosen[1]), counts


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    chosen, counts = bounded_labels(labels, "quality", per_class)
    total = sum(counts.values())
    prior = np.array([counts.get(0, 0), counts.get(1, 0)], float)

    def sparse(texts: list[str]) -> dict:
        found = [features(t) for t in texts]
        return {"slots": [a.tobytes() for a, _ in found], "shares": [b.tobytes() for _, b in found]}

    # at most 2 * per_class ids, so the broadcast is bounded
    sample = documents.select("doc_id", text_column().alias("text")).join(F.broadcast(chosen), "doc_id")
    taken = map_texts(sample.select("text", "label"), sparse, "slots binary, shares binary").toPandas()
    known = np.array(taken.label, dtype=int)
    if len(set(known)) < 2:
        share = prior[1] / total if total else 0.5
        bias = np.log(np.clip([1 - share, share], 1e-6, 1)).astype(np.float32)
        return QualityModel(np.zeros((1 << BITS, 1), np.float32), np.zeros((2, 1), np.float32), bias)
    sampled = np.bincount(known, minlength=2)
    weight = (prior / total) / (sampled / sampled.sum())
    rows = [
        (np.frombuffer(a, np.uint16), np.frombuffer(b, np.float32)) for a, b in zip(taken.slots, taken.shares)
    ]
    # the model hangs on no task order
    order = sorted(range(len(rows)), key=lambda i: (known[i], len(rows[i][0]), taken.slots[i], taken.shares[i]))
    return train([rows[i] for i in order], known[order], weight[known[order]])


def score(documents: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model.slot_scores(), model.offset()))  # 2 ** BITS numbers

    def scored(texts: list[str]) -> dict:
        per_slot, offset = shared.value
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            total, count = 0.0, 0
            for found in _slot_lists(text):
                total += float(per_slot[found].sum(dtype=np.float64))
                count += len(found)
            out[i] = 1 / (1 + np.exp(-np.clip(offset + total / max(1, count), -500, 500)))
        return {"score": out}

    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_column().alias("text"))
    return map_texts(rows, scored, "score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify_quality(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    return score(documents, fit(documents, labels, per_class))
