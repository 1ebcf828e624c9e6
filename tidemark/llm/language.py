"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of 1 to 3 lower-cased characters are hashed to ``BUCKETS`` features. The model is one matrix of log
probabilities (learned languages x features), broadcast to the tasks; a text's log-likelihood is the sum of the columns
its n-grams name. Long texts are scored in blocks, whole.

Defined results: a NULL text and a text without a letter are ``und`` with score 0, and so is every text if nothing could
be learned. Rows without a language teach nothing. Repeated rows and NULL doc_ids are scored like any other; other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_of
from .samples import sample_per_class

BITS = 15
BUCKETS = 1 << BITS
SIZES = (1, 2, 3)
BLOCK = 1 << 20
PER_LANGUAGE = 2000  # bound of the training sample, rows of each language


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams, in blocks of at most BLOCK characters and as many of each size."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(codes), BLOCK):
        for size in SIZES:
            part = codes[start : start + BLOCK + size - 1]
            if len(part) < size:
                continue
            h = np.full(len(part) - size + 1, size, np.uint32)
            for i in range(size):
                h = (h ^ part[i : len(part) - size + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            yield h >> np.uint32(32 - BITS)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            total = np.zeros(BUCKETS, np.int64)
            for text in texts:
                for part in features(text):
                    total += np.bincount(part, minlength=BUCKETS)
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "feature": used, "n": total[used]})


class Model:
    """``langs`` and their log probabilities (languages x features), with the class priors."""

    def __init__(self, langs: list[str], log_p: np.ndarray, prior: np.ndarray):
        self.langs, self.log_p, self.prior = langs, log_p, prior

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        total = self.prior.copy()
        for part in features(text):
            total += self.log_p[:, part].sum(axis=1, dtype=np.float64)
        best = int(total.argmax())
        return self.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, cap: int = PER_LANGUAGE) -> Model:
    """Learns from (text, lang) of a sample of at most about ``cap`` rows a language. The driver receives one count for
    each language and feature."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sample, _ = sample_per_class(rows, "lang", cap)
    counts = sample.select("lang", "text").mapInPandas(_count, "lang string, feature int, n long")
    got = counts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.full((len(langs), BUCKETS), 0.5)
    if langs:
        table[np.searchsorted(langs, got["lang"]), got["feature"].to_numpy(int)] += got["n"].to_numpy(float)
    log_p = np.log(table / table.sum(axis=1, keepdims=True)) if langs else table
    # Equal priors: the sample's shares say nothing about the texts to come.
    return Model(langs, log_p.astype(np.float32), np.zeros(len(langs)))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, lang_pred, score, and the columns ``keep``) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [shared.value.predict(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    return docs.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).mapInPandas(run, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame, cap: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learned from the rows whose crc32(doc_id) mod 4 is not 2."""
    model = fit(docs.where(split_of(4) != 2), cap)
    return predict(docs, model).select("doc_id", (split_of(4) == 2).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, cap: int = PER_LANGUAGE, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language can be told: not ``und`` and a posterior of ``least`` or more. All columns stay."""
    model = fit(docs.where(split_of(4) != 2), cap)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        got = [shared.value.predict(t) for t in texts]
        return pd.Series([g[0] != "und" and g[1] >= least for g in got], dtype=bool)

    return docs.where(known("text"))
