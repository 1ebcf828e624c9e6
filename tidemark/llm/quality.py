"""Quality rules with adaptive thresholds.

Every document gets a few measures, each lowered by a count too small to tell anything (one repeated line, five symbols).
The distributions of the documents that pass the base rule go, per language and source, into mergeable quantile sketches:
counts of logarithmic buckets (GAMMA apart, so a quantile is right within 1 %), which add up over partitions, sources and
languages. The fence of a sketch lies ``fence`` times the way from the median to the ninth decile beyond that decile, plus
a small absolute tolerance.

* A language's fence is the median of its sources' fences, each source weighing n / (n + ``prior``): a source that holds
  a third of all rows is one voice among its fellows. The fence of all is the median of the languages' in the same way.
* A language's limit goes from the fence of all to its own fence by m / (m + ``prior``), a source's limit from its
  language's limit to its own fence by half of n / (n + ``prior``), both on the logarithmic scale. There is no size at which the
  rule changes, few rows say little, and a dirty source moves its limit half of the way at most: it does not excuse itself.
  A language most of whose sources are dirty does.

Documents are then joined with their group's limits and filtered.

Defined results: NULL and empty texts have no words, fail the base rule and are not kept. NULL language and NULL source
are groups of their own. Repeated rows and NULL doc_ids are judged like any other, other columns are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

GAMMA = 1.02
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Fixed values. measure: (SQL, side of the fence, absolute tolerance beyond it).
MEASURES = {
    "symbols": ("try_divide(greatest(n_symbols - 5, 0), n_words)", "above", 0.05),
    "dup_lines": ("try_divide(greatest(n_dup_lines - 1, 0), n_lines)", "above", 0.05),
    "repeats": ("try_divide(greatest(n_repeat_words - 50, 0), n_words)", "above", 0.05),
    "capitals": ("try_divide(greatest(n_capitals - 10, 0), word_chars)", "above", 0.05),
    "marks": ("try_divide(greatest(n_marks - 5, 0), n_words)", "above", 0.05),
    "long_words": ("try_divide(word_chars, n_words)", "above", 0.5),
    "short_words": ("try_divide(word_chars, n_words)", "below", 0.5),
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = at[:-1] * len(ids) + at[1:]
    # Pairs are numbered anew, so that the key of a window stays below n squared.
    _, pair = np.unique(pair, return_inverse=True)
    _, window, count = np.unique(pair[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    inside = np.zeros(n, bool)
    for i in range(3):
        inside[i : n - 2 + i] |= twice
    return int(inside.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks."""
    if not text:
        return (0,) * 8
    raw = np.frombuffer(text, np.uint8)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = int(((raw & 0xC0) != 0x80).sum()) - int(_SPACE[raw].sum())
    return len(words), chars, int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated_words(words), len(lines), int(_CAPITAL[raw].sum()), int(_MARK[raw].sum())


def _measures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [*COUNTS, "n_lines", "n_capitals", "n_marks"]
    for batch in batches:
        out = pd.DataFrame([measure(t) for t in batch["text"]], columns=names, dtype=np.int64)
        out.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
        out.insert(1, "lang", batch["lang"])
        out.insert(2, "source", batch["source"])
        yield out


def measures(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_lines", "n_capitals", "n_marks"))
    return rows.mapInPandas(_measures, schema)


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the documents that pass the base rule: bucket i holds values in (GAMMA^(i-1),
    GAMMA^i], bucket NULL zeros. Sketches merge by adding n."""
    values = F.array(*[F.struct(F.lit(k).alias("measure"), F.expr(sql).alias("v")) for k, (sql, _, _) in MEASURES.items()])
    some = measured.where(f"NOT ({BASE_FAILED})").select("lang", "source", F.explode(values).alias("x"))
    bucket = F.when(F.col("x.v") > 0, F.ceil(F.log(F.col("x.v")) / float(np.log(GAMMA)))).cast("int")
    return some.select("lang", "source", F.col("x.measure").alias("measure"), bucket.alias("bucket")).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """(keys, measure, n, one column for each quantile of ``at``). A group has at most a few thousand buckets."""
    w = Window.partitionBy(*keys, "measure")
    upto = w.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    x = sketches.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(w))
    value = F.coalesce(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA), F.lit(0.0))
    found = [F.min(F.when(F.col("upto") >= q * F.col("all"), value)).alias(name) for name, q in at.items()]
    return x.groupBy(*keys, "measure").agg(F.max("all").alias("n"), *found)


def fences(sketches: DataFrame, fence: float) -> DataFrame:
    """(lang, source, measure, n, reach): the logarithm of every group's own fence."""
    x = quantiles(sketches, ["lang", "source"], {"q1": 0.1, "q5": 0.5, "q9": 0.9})
    beyond = F.create_map(*[F.lit(v) for k, (_, side, tolerance) in MEASURES.items() for v in (k, tolerance if side == "above" else -tolerance)])[F.col("measure")]
    # GAMMA covers the sketch's own error, so a group of equal values is never outside its fence.
    above = GAMMA * F.col("q9") + fence * (F.col("q9") - F.col("q5")) + beyond
    below = F.greatest(F.col("q1") / GAMMA - fence * (F.col("q5") - F.col("q1")) + beyond, F.lit(1e-3))
    return x.select("lang", "source", "measure", "n", F.log(F.when(beyond > 0, above).otherwise(below)).alias("reach"))


def median_fence(groups: DataFrame, keys: list[str], prior: float) -> DataFrame:
    """(keys, measure, n, reach): the least reach at which half of the groups' weights is met. One row for each group."""
    w = Window.partitionBy(*keys, "measure")
    upto = w.orderBy("reach", "n").rowsBetween(Window.unboundedPreceding, 0)
    x = groups.withColumn("weight", F.col("n") / (F.col("n") + prior))
    # The sum's rounding must not decide where half of the weight is met.
    met = F.sum("weight").over(upto) * (1 + 1e-9) >= F.sum("weight").over(w) / 2
    return x.withColumn("met", met).groupBy(*keys, "measure").agg(F.sum("n").alias("n"), F.min(F.when(F.col("met"), F.col("reach"))).alias("reach"))


def thresholds(sketches: DataFrame, *, fence: float = 3.0, prior: float = 100.0) -> DataFrame:
    """(lang, source, one column for each measure): the limits of every group."""
    own = fences(sketches, fence)
    langs = median_fence(own, ["lang"], prior)
    every = median_fence(langs, [], prior).select(F.col("measure").alias("am"), F.col("reach").alias("all_reach"))
    by_lang = langs.select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.col("n").alias("ln"), F.col("reach").alias("lang_reach"))
    # One row for each group and measure.
    x = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))).join(every, F.col("measure") == F.col("am"))
    x = x.withColumn("lang_limit", F.col("all_reach") + (F.col("lang_reach") - F.col("all_reach")) * F.col("ln") / (F.col("ln") + prior))
    x = x.withColumn("limit", F.exp(F.col("lang_limit") + (F.col("reach") - F.col("lang_limit")) * F.col("n") / (F.col("n") + prior) / 2))
    return x.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == k, F.col("limit"))).alias(f"limit_{k}") for k in MEASURES])


def verdicts(docs: DataFrame, *, fence: float = 3.0, prior: float = 100.0) -> DataFrame:
    """(doc_id, the five counts, base_failed, kept, failed_rules) of every row."""
    measured = cut(measures(docs), "measures")
    limits = cut(thresholds(sketch(measured), fence=fence, prior=prior), "thresholds")
    limits = limits.withColumnRenamed("lang", "_l").withColumnRenamed("source", "_s")
    x = measured.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    broken = []
    for k, (sql, side, _) in MEASURES.items():
        beyond = F.expr(f"({sql}) {'>' if side == 'above' else '<'} limit_{k}")
        broken.append(F.when(F.coalesce(beyond, F.lit(False)), F.lit(k)))
    x = x.withColumn("failed_rules", F.array_join(F.array(*broken), ","))
    x = x.withColumn("base_failed", F.expr(BASE_FAILED))
    return x.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules")
