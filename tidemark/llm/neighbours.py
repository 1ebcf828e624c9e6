"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are the trigrams of its character classes (space, line end, small, capital, digit, kinds of punctuation,
other alphabets) and a few measures of repetition. Term weights are log counts times inverse document frequency, scaled
to unit length; the latent space is spanned by the leading singular vectors of the labelled sample. Every text is compared with
every labelled vector by blocked matrix products, and the most similar ``NEIGHBOURS`` vote with their similarity.

Defined results: NULL and empty texts have the zero vector, on which all labelled rows vote alike; with no labels to
learn from every score is 0. Repeated rows and NULL doc_ids are scored like any other, other columns are ignored, an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_of
from .samples import labelled_sample

PER_CLASS = 2000  # bound of the labelled sample, rows of each label
DIMENSIONS = 48
NEIGHBOURS = 25
BLOCK = 256  # texts in one matrix product
PIECE = 1 << 20

CLASSES = 12


def _classes() -> np.ndarray:
    of = np.full(256, 11, np.int16)  # bytes of characters outside ASCII
    of[:128] = 10
    for group, members in enumerate((b" \t\r\x0b\x0c", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!", b"?", b"#*$%&", b"|<>{}[]\\")):
        of[list(members)] = group
    return of


OF = _classes()
TRIGRAMS = CLASSES**3
MEASURES = 4
TERMS = TRIGRAMS + MEASURES
EMPHASIS = 40.0


def term_counts(text: bytes | None) -> np.ndarray:
    """Counts of class trigrams, then four shares of repetition (times EMPHASIS)."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    for start in range(0, len(raw), PIECE):
        c = OF[raw[start : start + PIECE + 2]]
        if len(c) > 2:
            out[:TRIGRAMS] += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=TRIGRAMS)
    words = text.split()
    n = len(words)
    if n > 1:
        out[TRIGRAMS] = sum(map(bytes.__eq__, words, words[1:])) / (n - 1)
        out[TRIGRAMS + 1] = 1 - len(set(words)) / n
    if n > 3:
        out[TRIGRAMS + 2] = 1 - len(set(zip(words, words[1:], words[2:]))) / (n - 2)
    lines = [x for x in text.split(b"\n") if x.strip()]
    if lines:
        out[TRIGRAMS + 3] = 1 - len(set(lines)) / len(lines)
    out[TRIGRAMS:] *= EMPHASIS
    return out


class Model:
    """idf: term weights; axes: terms x dimensions; points: labelled unit vectors; votes: their labels."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, points: np.ndarray, votes: np.ndarray):
        self.idf, self.axes, self.points, self.votes = idf, axes, points, votes

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.log1p(counts) * self.idf) @ self.axes)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        k = min(NEIGHBOURS, len(self.votes))
        if not k:
            return out
        for start in range(0, len(texts), BLOCK):
            x = self.project(np.stack([term_counts(t) for t in texts[start : start + BLOCK]]))
            cosine = x @ self.points.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** 4
            out[start : start + BLOCK] = (weight * self.votes[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"counts": [term_counts(t).tobytes() for t in batch["text"]], "y": batch["y"]})


def fit(docs: DataFrame, labels: DataFrame, cap: int = PER_CLASS) -> Model:
    """Learns from at most about ``cap`` rows of each label whose crc32(doc_id) mod 4 is not 2. The driver receives
    their term counts (7 KB a row) and finds the axes from the terms' product matrix."""
    sample, _ = labelled_sample(docs, labels, "quality", split_of(4) != 2, cap)
    rows = sample.select(F.col("text").cast("binary").alias("text"), "y").mapInPandas(_counts, "counts binary, y int").collect()
    if not rows:
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    # Sorted, so that the model doesn't depend on the order in which tasks end.
    rows = sorted((bytes(r.counts), r.y) for r in rows)
    counts = np.frombuffer(b"".join(r[0] for r in rows), np.float32).reshape(-1, TERMS)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 0.5
    x = _unit(np.log1p(counts) * idf)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    return Model(idf, axes, _unit(x @ axes), np.array([r[1] for r in rows], float))


def scores(docs: DataFrame, labels: DataFrame, cap: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, cap))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": model.value.score(list(batch["text"]))})

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(run, "doc_id long, score double")
    return found.select("doc_id", (split_of(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
