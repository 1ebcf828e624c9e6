"""Periodic runs of words: descending-LCP Kruskal over ordered position sets.

A run is a maximal stretch of words with smallest period q and at least ``TIMES`` q and ``LEAST`` words. Suffixes of a text
are united into classes by decreasing longest common prefix (LCP): each class is a sorted set of positions, the smaller
one moves into the larger (union-find), and every two positions that become neighbours in the united set have exactly the
LCP l of that step. Neighbours at a distance d with (TIMES - 1) d <= l repeat at once: they seed the run of d + l words from
the first of them, if the word before it does not continue it to the left.

Why this finds each run once: let a run of period q begin at s with L words. The suffixes s and s + q share L - q words.
A position between them sharing as many would give the run a second period less than q over 3 q words and more, so a
smaller smallest period (Fine and Wilf); hence the two are neighbours when they are united. For the same reason
neighbours are never a multiple of the smallest period apart: the suffix one period on shares more and is there before.

LCPs below ``LEAST - 1`` seed nothing, so only positions whose four words occur again in the text are sorted to the end.
Suffixes of all texts of a batch are sorted together by prefix doubling in numpy (texts keep apart by their number in
the first key), going on with unresolved ones only; kept levels give the LCPs of neighbours.

Words are ``[^\\x20\\x09-\\x0D]+`` in their own case. Bounds: a batch holds ``BATCH`` words or one text.

Defined results: NULL and empty texts and texts without words have no run and collapse to the empty text; repeated rows are each
returned; a NULL doc_id is returned as NULL; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

LEAST, TIMES = 6, 4
BATCH = 1 << 18
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_levels(symbols: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols until all differ; equal ranks mean equal prefixes. A rank
    is the group's first place in the order of all, so finished suffixes keep theirs. ``stop`` is each suffix's end."""
    n = len(symbols)
    order = np.argsort(symbols)
    ranks = np.empty(n, np.int64)
    ranks[order] = _groups(symbols[order])
    levels, width, open_ = [ranks], 1, order[_shared(ranks[order])]
    while len(open_):
        after = open_ + width
        second = np.where(after < stop[open_], ranks[np.minimum(after, n - 1)] + 1, 0)
        key = ranks[open_] * (n + 1) + second
        order = np.argsort(key)
        at, key = open_[order], key[order]
        group, part = _groups(key // (n + 1)), _groups(key)
        ranks = ranks.copy()
        ranks[at] += part - group
        levels.append(ranks)
        open_, width = at[_shared(key)], 2 * width
    return levels


def _groups(ordered: np.ndarray) -> np.ndarray:
    """Place of the first equal value, of sorted values."""
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(ordered)), 0))


def _shared(ordered: np.ndarray) -> np.ndarray:
    """Which of the sorted values have an equal one beside them."""
    same = ordered[1:] == ordered[:-1]
    return np.append(same, False) | np.concatenate([[False], same]) if len(ordered) else same


def neighbour_lcps(levels: list[np.ndarray], symbols: np.ndarray, stop: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, l): suffixes next to each other in a text's order and their LCP, where it reaches LEAST - 1."""
    four = levels[min(2, len(levels) - 1)]
    order = np.argsort(four)
    some = order[_shared(four[order])] if len(levels) > 3 else order[:0]
    some = some[np.argsort(levels[-1][some])]
    a, b = some[:-1], some[1:]
    here = text[a] == text[b]
    a, b = a[here], b[here]
    lcp = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) + lcp < stop[a]
        x, y = np.where(inside, a + lcp, 0), np.where(inside, b + lcp, 0)
        lcp += np.where(inside & (levels[level][x] == levels[level][y]), 1 << level, 0)
    far = lcp >= LEAST - 1
    return a[far], b[far], lcp[far]


def seeds(a: np.ndarray, b: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(p, q, l): positions that become neighbours at LCP l with (TIMES - 1) (q - p) <= l."""
    order = np.argsort(-lcp, kind="stable")
    head, sets, found = {}, {}, []

    def root(x: int) -> int:
        if x not in head:
            head[x], sets[x] = x, [x]
        while head[x] != x:
            head[x] = x = head[head[x]]
        return x

    for x, y, l in zip(a[order].tolist(), b[order].tolist(), lcp[order].tolist()):
        x, y = root(x), root(y)
        if x == y:
            continue
        if len(sets[x]) > len(sets[y]):
            x, y = y, x
        small, large = sets.pop(x), sets[y]
        head[x], reach = y, l // (TIMES - 1)
        last = len(small) - 1
        for i, p in enumerate(small):
            k = bisect_left(large, p)
            # Neighbours in the united set: nothing of the own class may stand between.
            if k and p - large[k - 1] <= reach and (i == 0 or small[i - 1] < large[k - 1]):
                found.append((large[k - 1], p, l))
            if k < len(large) and large[k] - p <= reach and (i == last or small[i + 1] > large[k]):
                found.append((p, large[k], l))
        if 8 * len(small) > len(large):
            large.extend(small)
            large.sort()
        else:
            for p in small:
                insort(large, p)
    return found


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text's words, by start, then period."""
    numbers, out = defaultdict(count().__next__), [[] for _ in texts]
    sizes = np.array([len(w) for w in texts], np.int64)
    total = int(sizes.sum())
    if total < LEAST:
        return out
    words = np.fromiter((numbers[w] for ws in texts for w in ws), np.int64, total)
    text = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    stop, symbols = ends[text], text * len(numbers) + words
    for p, q, l in seeds(*neighbour_lcps(suffix_levels(symbols, stop), symbols, stop, text)):
        t = int(text[p])
        first = int(ends[t] - sizes[t])
        if p == first or symbols[p - 1] != symbols[q - 1]:
            out[t].append((p - first, q - p + l, q - p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if runs:
        gone = np.zeros(len(words), bool)
        for start, length, period in runs:
            gone[start + period : start + length] = True
        words = [w for w, g in zip(words, gone) if not g]
    return b" ".join(words)


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def done(ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
        found = runs_of(texts)
        named = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "runs": named, "collapsed": [collapse(w, r).decode() for w, r in zip(texts, found)]})

    for batch in batches:
        ids, texts, held = [], [], 0
        for doc, data in zip(batch["doc_id"].astype("Int64"), batch["text"]):
            words = (data or b"").split()
            if texts and held + len(words) > BATCH:
                yield done(ids, texts)
                ids, texts, held = [], [], 0
            ids.append(doc)
            texts.append(words)
            held += len(words)
        yield done(ids, texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: its runs (start, length, period) by start, then period, and its text without
    the repetitions."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(_find, f"doc_id long, runs {RUNS}, collapsed string")


def with_repetitions(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of rows whose crc32 h of the id is divisible by 10, each word from place a on becomes word
    a + (i - a) % p, with a = g % n, p = 1 + (n - a) div (3 + g % 8), g = h div 10."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.select("doc_id", "text", "w", F.expr("h div 10").alias("g"), F.size("w").cast("long").alias("n"))
    rows = rows.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a)))")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def longest(runs: str) -> Column:
    """The run with the greatest length / period; of equals the first. NULL without runs."""
    better = "CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END"
    return F.expr(f"aggregate({runs}, CAST(NULL AS STRUCT<start:bigint,length:bigint,period:bigint>), (best, r) -> {better})")
