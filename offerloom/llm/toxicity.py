"""Toxicity of documents: byte n-grams scaled by naive Bayes log-count ratios, linear classifier.

Features are the presence of byte n-grams of the lower-cased text. From a bounded sample of labelled
documents (``per_class`` of each class, those with the smallest hash of their id) Spark counts in how
many documents of each class an n-gram occurs. All n-grams are kept whose log-likelihood gain is more
than chance gives among some 100,000 n-grams (``MIN_GAIN``); each is scaled by the log ratio of its smoothed counts, and a logistic
regression over the scaled features is trained by stochastic gradient descent in numpy. The bias is
moved from the balance of the sample to that of all labels.

N-grams are packed byte for byte, so two n-grams never share a weight.

Defined results: a null or empty text gets the score of the bias. Without labels of both classes the
score is the share of toxic labels (0 without any). Repeated rows are scored alike, once per row; a
row without doc_id is scored and never trained on. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import held_out, map_texts, text_column
from offerloom.llm.quality import bounded_labels
from offerloom.llm.texthash import grams, utf8

SIZES = (3, 4, 5)
PER_CLASS = 1500
MIN_GAIN = 12.0
TABLE_BITS = 22


def present(text: str) -> np.ndarray:
    """The distinct n-grams of a text, as packed numbers."""
    raw = utf8(text.lower())
    return np.unique(np.concatenate([grams(raw, n) for n in SIZES]))


def _place(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


@dataclass
class ToxicityModel:
    """Sorted n-grams, the weight of each (log-count ratio times learned weight), and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    _marks: np.ndarray | None = field(default=None, repr=False)

    def marks(self) -> np.ndarray:
        """Which places of a hash table are taken: most n-grams are dismissed by one look-up."""
        if self._marks is None:
            self._marks = np.zeros(1 << TABLE_BITS, bool)
            self._marks[_place(self.keys)] = True
        return self._marks

    def find(self, text: str) -> np.ndarray:
        """Positions of the model's n-grams that the text has, each once."""
        raw = utf8(text.lower())
        hits = []
        for n in SIZES:
            found = grams(raw, n)
            hits.append(found[self.marks()[_place(found)]])
        seen = np.unique(np.concatenate(hits))
        at = np.searchsorted(self.keys, seen)
        at[at == len(self.keys)] = 0
        return at[self.keys[at] == seen] if len(self.keys) else at[:0]

    def score(self, text: str) -> float:
        margin = self.bias + float(self.weights[self.find(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def train(
    rows: list[np.ndarray],
    labels: np.ndarray,
    ratios: np.ndarray,
    epochs: int = 20,
    rate: float = 0.5,
    decay: float = 1e-5,
    seed: int = 11,
) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times ratio, one document per step; returns weights and bias."""
    random = np.random.default_rng(seed)
    weights, bias, done, steps = np.ones(len(ratios)), 0.0, 0, epochs * len(rows)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            used = rows[i]
            values = ratios[used]
            length = max(1.0, float(np.sqrt(values @ values)))
            gap = 1 / (1 + np.exp(-np.clip(bias + weights[used] @ values, -30, 30))) - labels[i]
            step = rate * (1 - done / steps)
            done += 1
            weights[used] -= step * (gap * values / length**2 + decay * weights[used])
            bias -= step * 0.1 * gap
    return weights, bias


def fit(
    documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, alpha: float = 1.0
) -> ToxicityModel:
    chosen, counts = bounded_labels(labels, "toxic", per_class)
    total = sum(counts.values())
    # at most 2 * per_class ids, so the broadcast is bounded
    sample = documents.select("doc_id", text_column().alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.select("text", "label").persist()
    sizes = {int(r["label"]): r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = np.clip(counts.get(1, 0) / total if total else 0.0, 1e-6, 1 - 1e-6)
        sample.unpersist()
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))

    seen = map_texts(sample, lambda texts: {"grams": [present(t).view(np.int64) for t in texts]}, "grams array<bigint>")
    good, bad = float(sizes[0]), float(sizes[1])
    counted = (
        seen.select("label", F.explode("grams").alias("gram"))
        .groupBy("gram")
        .agg(F.sum(F.col("label")).alias("bad"), F.sum(1 - F.col("label")).alias("good"))
        .where(F.col("bad") + F.col("good") >= 3)
    )
    # what the split of the two classes says about the presence of the n-gram
    both = F.col("bad") + F.col("good")
    gain = F.lit(0.0)
    for part, size in (("bad", bad), ("good", good)):
        expected = both * (size / (good + bad))
        gain += F.when(F.col(part) > 0, F.col(part) * F.log(F.col(part) / expected)).otherwise(0.0)
        absent, left = size - F.col(part), (good + bad - both) * (size / (good + bad))
        gain += F.when(absent > 0, absent * F.log(absent / left)).otherwise(0.0)
    best = counted.withColumn("gain", gain).where(F.col("gain") >= MIN_GAIN).collect()
    if not best:
        sample.unpersist()
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(counts[1] / counts[0])))
    table = np.array(sorted((np.int64(r["gram"]).view(np.uint64), r["bad"], r["good"]) for r in best), dtype=object)
    keys = table[:, 0].astype(np.uint64)
    p, q = table[:, 1].astype(float) + alpha, table[:, 2].astype(float) + alpha
    ratios = np.log((p / (bad + 2 * alpha)) / (q / (good + 2 * alpha)))

    lookup = ToxicityModel(keys, ratios, 0.0)
    pairs = map_texts(
        sample, lambda texts: {"used": [lookup.find(t).astype(np.int32).tobytes() for t in texts]}, "used binary"
    ).collect()
    sample.unpersist()
    pairs = sorted((int(r["label"]), bytes(r["used"])) for r in pairs)  # the model hangs on no task order
    weights, bias = train([np.frombuffer(u, np.int32) for _, u in pairs], np.array([k for k, _ in pairs]), ratios)
    prior = np.log(counts[1] / counts[0]) - np.log(bad / good)
    return ToxicityModel(keys, weights * ratios, float(bias + prior))


def score(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """All columns of the rows but the text, with held_out, score and predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # the n-grams of a bounded sample
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_column().alias("text"))
    scored = map_texts(rows, lambda texts: {"score": [shared.value.score(t) for t in texts]}, "score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify_toxicity(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    return score(documents, fit(documents, labels, per_class))


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """The rows whose score stays under the threshold, unchanged."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, per_class))
    kept = documents.withColumn("__text", F.col("text")).withColumn("text", text_column())
    scored = map_texts(kept, lambda texts: {"__score": [shared.value.score(t) for t in texts]}, "__score double")
    return scored.where(F.col("__score") < threshold).withColumnRenamed("__text", "text").select(*documents.columns)
