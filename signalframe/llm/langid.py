"""Language identification by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of
byte n-grams (n = 1 to 3, A-Z folded, hashed to ``DIM`` places) that both have,
over the geometric mean of the numbers that each has.  Training draws a bounded
sample per language, takes landmarks from it, maps every sample text to its
kernels with the landmarks (Nyström), and solves one-versus-rest kernel ridge
regression.  Scoring multiplies a batch of presence rows with the landmark rows
and the result with the regression's matrix.

Defined results: a null text or one without a letter gives ``und`` and score 0;
with no labelled text at all every text gives ``und``; with one language, that
language.  Of languages with equal values the first by name is predicted.  Rows
with equal keys or texts are predicted each on its own.  Very long texts are read
in pieces but whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions

DIM = 1 << 15
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint32)
_PIECE = 1 << 22


def mark_presence(row: np.ndarray, text: bytes) -> None:
    """Set ``row`` to 1 at the place of every byte n-gram of the text."""
    for lo in range(0, len(text), _PIECE):
        b = _FOLD[np.frombuffer(text, np.uint8, min(len(text) - lo, _PIECE + 2), lo)]
        two = b[:-1] * np.uint32(256) + b[1:]
        row[b] = 1
        row[(two * np.uint32(0x9E3779B1)) >> np.uint32(17)] = 1
        if len(b) > 2:
            row[((two[:-1] * np.uint32(256) + b[2:]) * np.uint32(0x85EBCA6B)) >> np.uint32(17)] = 1


def presence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.zeros((len(texts), DIM), np.float32)
    for row, text in zip(rows, texts, strict=True):
        mark_presence(row, text)
    return rows, np.sqrt(np.maximum(rows.sum(1), 1))


def _rows(bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Presence rows and their lengths from packed bits."""
    rows = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8)).reshape(len(bits), DIM).astype(np.float32)
    return rows, np.sqrt(np.maximum(rows.sum(1), 1))


class KernelModel:
    """Landmark rows and the matrix that turns kernels with them into one value per language.

    ``bits`` are packed presence rows (4 KB each).  There are ``landmarks``
    landmarks, or one of each language where the languages are more.
    """

    def __init__(self, bits: list[bytes], langs: list[str], landmarks: int = 128, ridge: float = 1e-2) -> None:
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        # every language in turn gives a landmark, in the sample's order
        turn = {lang: iter([i for i, own in enumerate(langs) if own == lang]) for lang in self.langs}
        picked: list[int] = []
        while turn and len(picked) < max(landmarks, len(self.langs)):
            for lang in list(turn):
                i = next(turn[lang], None)
                if i is None:
                    del turn[lang]
                elif len(picked) < max(landmarks, len(self.langs)):
                    picked.append(i)
        x, size = _rows([bits[i] for i in picked])
        self.landmarks = (x / size[:, None]).T.copy()
        parts = []
        for lo in range(0, len(bits), 256):
            x, size = _rows(bits[lo : lo + 256])
            parts.append((x @ self.landmarks) / size[:, None])
        k = np.concatenate(parts)
        among = k[picked].astype(np.float64)
        values, vectors = np.linalg.eigh((among + among.T) / 2)
        good = values > 1e-6 * max(values.max(), 1e-12)
        root = vectors[:, good] / np.sqrt(values[good])
        phi = k @ root
        target = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        weight = np.array([len(langs) / (len(self.langs) * langs.count(lang)) for lang in langs])
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        solved = np.linalg.solve(phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1]), phi.T @ (target * weight[:, None]))
        self.matrix, self.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its share of the softmax of all values."""
        x, size = presence(texts)
        f = ((x @ self.landmarks) / size[:, None]) @ self.matrix + self.bias
        e = np.exp(4 * (f - f.max(1, keepdims=True)))
        return f.argmax(1), (e.max(1) / e.sum(1)).astype(np.float64)


def sample_rows(rows: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label at most, drawn by a hash of the key (all rows of rarer labels); one count for each label comes to the driver."""
    shares = {row[0]: min(1.0, per_label / row["count"]) for row in rows.groupBy(label).count().collect()}
    if not shares:
        return rows
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    return rows.where(place < F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col(label)))


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 500, landmarks: int = 128) -> KernelModel:
    """Fit on a bounded sample: ``per_lang`` labelled texts of each language, about; 4 KB of each come to the driver, however long it is.

    Texts without a letter are passed over.  Of rows with one key, all count.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    picked = sample_rows(rows, "lang", "key", per_lang).select("lang", F.xxhash64(F.col("key").cast("string"), F.lit(8)).alias("at"), "text")

    def run(batches):
        for whole in batches:
            for part in portions(whole, 2, 128):
                keep = pa.array([_LETTER.search(t) is not None for t in part.column(2).to_pylist()], pa.bool_())
                part = part.filter(keep)
                bits = [np.packbits(presence([t.encode()])[0] > 0).tobytes() for t in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(bits, pa.binary())], names=["lang", "at", "bits"])

    kept: dict[str, list[bytes]] = {}
    for row in sorted(picked.mapInArrow(run, "lang string, at long, bits binary").collect(), key=lambda r: (r.at, r.lang, r.bits)):
        own = kept.setdefault(row.lang, [])
        if len(own) < per_lang:
            own.append(bytes(row.bits))
    pairs = [(t, lang) for lang in sorted(kept) for t in kept[lang]]
    return KernelModel([t for t, _ in pairs], [lang for _, lang in pairs], landmarks)


def predict(docs: DataFrame, model: KernelModel, *, key: str | list[str] = "doc_id", text: str = "text", batch: int = 256) -> DataFrame:
    """One row per document: the ``key`` columns, lang_pred, score."""
    spark = docs.sparkSession
    keys = [key] if isinstance(key, str) else key
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys) + ", lang_pred string, score double"

    def run(batches):
        m = shared.value
        for whole in batches:
            for part in portions(whole, len(keys), batch):
                texts = part.column(len(keys)).to_pylist()
                own = [i for i, t in enumerate(texts) if t and m.langs and _LETTER.search(t)]
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if own:
                    best, share = m.predict([texts[i].encode() for i in own])
                    for i, b, s in zip(own, best, share, strict=True):
                        lang[i], score[i] = m.langs[b], float(s)
                yield pa.record_batch([*part.columns[: len(keys)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keys, "lang_pred", "score"])

    return docs.select(*keys, F.col(text).alias("text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: KernelModel, *, text: str = "text", languages: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """``docs`` with its own columns, less the rows that are ``und``, whose score is under ``least`` or, where ``languages`` is given, of none of them."""
    spark = docs.sparkSession
    shared, place, schema = spark.sparkContext.broadcast(model), docs.columns.index(text), docs.schema

    def run(batches):
        m = shared.value
        for whole in batches:
            for part in portions(whole, place, 256):
                texts = part.column(place).to_pylist()
                own = [i for i, t in enumerate(texts) if t and m.langs and _LETTER.search(t)]
                keep = np.zeros(len(texts), bool)
                if own:
                    best, share = m.predict([texts[i].encode() for i in own])
                    keep[own] = [score >= least and (languages is None or m.langs[b] in languages) for b, score in zip(best, share, strict=True)]
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
