"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other alphabets and digits or signs used for letters to Latin letters,
and makes every other ASCII character a space. The lexicon holds words and word beginnings with the log-odds of
occurring in a toxic training document. A word counts with its best entry, unless the match lies in an exception phrase.
The total weight, and the total for every hundred words, go through a logistic fit on the training sample.

Defined results: NULL and empty texts have no matches and get the score of a clean text; with no labels to learn from
every score is 0. Repeated rows and NULL doc_ids are scored like any other, other columns are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, split_of
from .samples import labelled_sample

PER_CLASS = 3000  # bound of the training sample, rows of each label
STEMS = (4, 5, 6)  # lengths of the word beginnings that can enter the lexicon
SUPPORT = 8  # toxic documents an entry needs
LEAST = 2.0  # log-odds an entry needs, after adding one document to either side

# Characters read as Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ʟ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

# Phrases in which an entry is harmless.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash collection", "take out the trash", "clown fish", "clown shoes", "circus clown", "rodeo clown", "pond scum", "soap scum", "scum line",
    "pathetic fallacy", "sore loser rule", "idiot proof", "idiot light", "idiot board", "not stupid", "nothing stupid", "worthless check", "worthless stock", "moron corporation",
)


def _table() -> dict[int, str]:
    table = {c: " " for c in range(128) if not chr(c).isalpha()}
    table |= {ord(k): v for k, v in {**LOOKALIKES, **SUBSTITUTES}.items()}
    return table


TABLE = _table()


def fold(text: str | None) -> str:
    """Folded text with a space at either end."""
    return f" {text.lower().translate(TABLE)} " if text else "  "


class Lexicon:
    """Entries: pattern -> weight; a pattern starts with a space, and ends with one if it is a whole word."""

    def __init__(self, entries: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.entries, self.exceptions = entries, exceptions
        self._automaton = None

    def __getstate__(self):
        return {"entries": self.entries, "exceptions": self.exceptions, "_automaton": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for pattern, weight in self.entries.items():
                a.add_word(pattern, (len(pattern), weight))
            for phrase in self.exceptions:
                p = f" {phrase} "
                if p not in self.entries:
                    a.add_word(p, (len(p), None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def weigh(self, text: str | None) -> tuple[float, int, int]:
        """Total weight, number of words that matched, number of words."""
        folded = fold(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if self.entries:
            for end, (size, weight) in self.automaton().iter(folded):
                start = end - size + 1
                if weight is None:
                    spared.append((start, end))
                elif weight > best.get(start, 0.0):
                    best[start] = weight
        for low, high in spared:
            for start in [s for s in best if low <= s < high]:
                del best[start]
        return sum(best.values()), len(best), len(folded.split())


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, y in zip(batch["text"], batch["y"]):
            words = set(fold(text).split())
            found = {f" {w} " for w in words}
            for n in STEMS:
                found |= {f" {w[:n]}" for w in words if len(w) > n}
            out.append(pd.DataFrame({"term": list(found), "y": np.int32(y)}))
        yield pd.concat(out) if out else pd.DataFrame({"term": [], "y": []}).astype({"y": "int32"})


def _design(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / (words + 20))], axis=1)


class Model:
    def __init__(self, lexicon: Lexicon, beta: np.ndarray | None):
        self.lexicon, self.beta = lexicon, beta

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        got = np.array([self.lexicon.weigh(t) for t in texts], float).reshape(-1, 3)
        if self.beta is None:
            return np.zeros(len(got)), got[:, 1]
        return 1 / (1 + np.exp(-np.clip(_design(got[:, 0], got[:, 2]) @ self.beta, -30, 30))), got[:, 1]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    w = w / w.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, cap: int = PER_CLASS) -> Model:
    """Learns from at most about ``cap`` rows of each label whose crc32(doc_id) mod 5 is not 0. The driver receives the
    lexicon and three numbers for each sampled row."""
    sample, counts = labelled_sample(docs, labels, "toxic", split_of(5) != 0, cap)
    if set(counts) != {0, 1}:
        return Model(Lexicon({}), None)
    sample = cut(sample, "toxicity-sample")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Model(Lexicon({}), None)
    terms = sample.mapInPandas(_terms, "term string, y int").groupBy("term").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    odds = F.log(((F.col("bad") + 1) / (sizes[1] + 1)) / ((F.col("good") + 1) / (sizes[0] + 1)))
    entries = terms.where(F.col("bad") >= SUPPORT).withColumn("w", odds).where(F.col("w") >= LEAST).select("term", "w").collect()
    lexicon = Lexicon({r.term: r.w for r in entries})

    @F.pandas_udf("struct<total:double,words:double>")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        got = [lexicon.weigh(t) for t in texts]
        return pd.DataFrame({"total": [g[0] for g in got], "words": [float(g[2]) for g in got]})

    rows = sample.select(weigh("text").alias("x"), "y").select("x.*", "y").toPandas()
    y = rows["y"].to_numpy(float)
    weight = np.where(y == 1, counts[1] / sizes[1], counts[0] / sizes[0])
    return Model(lexicon, _logistic(_design(rows["total"].to_numpy(), rows["words"].to_numpy()), y, weight))


def scores(docs: DataFrame, labels: DataFrame, cap: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_matches) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, cap))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p, n = model.value.score(list(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": p, "n_matches": n.astype(np.int64)})

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, n_matches long")
    return found.select("doc_id", (split_of(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")
