"""Quality classification by Naive Bayes support vectors.

The n-gram indicators of a text are its byte n-grams (n = 1 to 3), hashed to
``DIM`` places.  Training scales each indicator by the log ratio of its smoothed shares in the two classes, brings each row to
length 1, and fits a linear hinge-loss model by dual coordinate descent.  A
score is the logistic function of the margin.

Training is on the driver, on a bounded sample of labelled rows (``per_class``
of each class at most), of which the places of the indicators come there, at most
``DIM`` numbers a text however long it is; scoring reads every whole text.  Null
and empty texts have no indicator and get the score of the intercept; without
labels of both classes every score is 0.5.  Of several labels of one key the
greatest class holds; rows with equal keys or texts are scored each on its own,
and each of them is a training row where its key is drawn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions
from .langid import sample_rows

DIM = 1 << 18
_PIECE = 1 << 22


def indicators(text: bytes | None, flags: np.ndarray) -> np.ndarray:
    """The places of the text's n-grams, ascending; ``flags`` is a row of DIM falses, and is so again afterwards."""
    if not text:
        return np.empty(0, np.int64)
    for lo in range(0, len(text), _PIECE):
        b = np.frombuffer(text, np.uint8, min(len(text) - lo, _PIECE + 2), lo).astype(np.uint32)
        two = b[:-1] * np.uint32(256) + b[1:]
        flags[b] = True
        flags[(two * np.uint32(0x9E3779B1)) >> np.uint32(14)] = True
        if len(b) > 2:
            flags[((two[:-1] * np.uint32(256) + b[2:]) * np.uint32(0x85EBCA6B)) >> np.uint32(14)] = True
    at = np.flatnonzero(flags)
    flags[at] = False
    return at


class NBSVM:
    """Weights over the indicators: the log-count ratios times the support vector weights."""

    def __init__(self, rows: list[np.ndarray], labels: list[int], c: float = 1.0, epochs: int = 20) -> None:
        self.weights, self.ratios, self.bias = np.zeros(DIM), np.zeros(DIM), 0.0
        y = np.where(np.array(labels) > 0, 1.0, -1.0)
        if len(set(y.tolist())) < 2:
            return
        counts = np.ones((2, DIM))
        for row, label in zip(rows, y, strict=True):
            counts[int(label > 0), row] += 1
        shares = counts / counts.sum(1, keepdims=True)
        self.ratios = np.log(shares[1] / shares[0])
        values = []
        for row in rows:
            v = self.ratios[row]
            values.append(v / max(np.sqrt((v * v).sum()), 1e-12))
        w, alpha, order = np.zeros(DIM), np.zeros(len(rows)), np.random.Generator(np.random.PCG64(1))
        bias = 0.0
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                gradient = y[i] * (values[i] @ w[rows[i]] + bias) - 1
                new = min(max(alpha[i] - gradient / 2.0, 0.0), c)  # every row has length 1, and 1 more for the intercept
                if new != alpha[i]:
                    step = (new - alpha[i]) * y[i]
                    w[rows[i]] += step * values[i]
                    bias += step
                    alpha[i] = new
        self.weights, self.bias = w * self.ratios, bias

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        flags, out = np.zeros(DIM, bool), np.zeros(len(texts))
        for i, text in enumerate(texts):
            at = indicators(text, flags)
            v = self.ratios[at]
            out[i] = self.weights[at].sum() / max(np.sqrt((v * v).sum()), 1e-12) + self.bias
        return 1 / (1 + np.exp(-2 * np.clip(out, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 2000) -> NBSVM:
    """Fit on at most about ``per_class`` labelled texts of each class; labels with a null key or class are not used."""
    rows = labels.select(F.col(key).alias("key"), (F.col(label) > 0).cast("int").alias("class")).dropna().groupBy("key").agg(F.max("class").alias("class"))
    picked = F.broadcast(sample_rows(rows, "class", "key", per_class))  # at most about 2 * per_class rows of two numbers

    def run(batches):
        flags = np.zeros(DIM, bool)
        for whole in batches:
            for part in portions(whole, 2, 128):
                places = [indicators(t, flags).astype("<i4").tobytes() for t in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(places, pa.binary())], names=["key", "class", "places"])

    chosen = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).where("text is not null").join(picked, "key")
    got = chosen.select(F.col("key").cast("string"), "class", "text").mapInArrow(run, "key string, class int, places binary").collect()
    got = sorted(got, key=lambda r: (r.key, r.places))
    return NBSVM([np.frombuffer(r.places, "<i4") for r in got], [r["class"] for r in got])


def score(docs: DataFrame, model: NBSVM, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, score (0 to 1, higher where class 1 is likelier)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for part in portions(whole, 1):
                yield pa.record_batch([part.column(0), pa.array(shared.value.scores(part.column(1).to_pylist()))], names=[key, "score"])

    return docs.select(F.col(key), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
