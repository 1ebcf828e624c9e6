"""Order statistics of windows that move or grow along a key, without a list of values per row.

``count_below`` counts by blocks of 1, 2, 4, ... rows whose values are sorted once; a window is at most two blocks of each
size. ``expanding_quantile`` splits a key into chunks of time. The quantile of all values before a row of a chunk lies
among few order statistics of the earlier chunks, as the chunk's own rows move a rank by at most their number. Counts per
(chunk, range of values) say which values of earlier chunks these can be; each chunk gets them and its own rows, and
inserts its values one by one.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import by_group, ints, spans
from .ordered import _named, _same
from .scan import CHUNK, chunk_of, row_halo

PARTS = 256


def count_below(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(below, known): of the up to ``window`` values before each one, how many are smaller and how many are no NaN."""
    n = len(values)
    known = ~np.isnan(values)
    seen = np.r_[0, np.cumsum(known)]
    at = np.arange(n)
    first = np.maximum(at - window, 0)
    rank = np.full(n, n, np.int64)  # an unknown value is above all
    rank[known] = np.unique(values[known], return_inverse=True)[1]
    below, lo, hi, size = np.zeros(n, np.int64), first.copy(), at.copy(), 1
    base = n + 1
    while size <= max(window, 1) and (lo < hi).any():
        ordered = np.sort(at // size * base + rank)

        def smaller(block: np.ndarray, row: np.ndarray) -> np.ndarray:
            return np.searchsorted(ordered, block * base + rank[row]) - np.searchsorted(ordered, block * base)

        # The ends that are not a pair of this size's blocks belong to blocks of this size.
        left = (lo < hi) & (lo // size % 2 == 1)
        below[left] += smaller(lo[left] // size, at[left])
        lo = np.where(left, lo + size, lo)
        right = (lo < hi) & (hi // size % 2 == 1)
        below[right] += smaller(hi[right] // size - 1, at[right])
        hi = np.where(right, hi - size, hi)
        size *= 2
    return np.where(known, below, 0), seen[at] - seen[first]


def ranked_rows(df: DataFrame, keys: Sequence[str], value: str, window: int, *, width: int | None, block: int = 100_000) -> DataFrame:
    """``df`` with _pos (row number in its key), _below and _known of the ``window`` rows before. A key goes through in blocks
    of rows with the rows before them."""
    h = row_halo(df, keys, ["ts"], window, width, block=block)
    h = h.select(*keys, CHUNK, "_pos", "_own", F.struct(*df.columns).alias("_row"), F.col(value).cast("double").alias("_v"))
    part = [*keys, CHUNK]

    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        values = table.column("_v").to_numpy().astype(float)
        below, known = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        for lo, hi in spans(starts, len(values)):
            below[lo:hi], known[lo:hi] = count_below(values[lo:hi], window)
        out = table.select(["_pos", "_row"]).append_column("_below", pa.array(below)).append_column("_known", pa.array(known))
        yield out.filter(table.column("_own"))

    long_ = [T.StructField(c, T.LongType()) for c in ("_below", "_known")]
    schema = T.StructType([h.schema["_pos"], h.schema["_row"], *long_])
    return by_group(h, part, ["_pos"], run, schema, True, rows=block + window).select("_row.*", "_pos", "_below", "_known")


def kth_rows(earlier: np.ndarray, below: int, before: int, values: np.ndarray, q: float, least: int) -> np.ndarray:
    """Quantiles of all values before each of a chunk's ``values``, linear between two; NaN before ``least`` values.

    ``earlier`` holds the order statistics below, below + 1, ... of the ``before`` values of earlier chunks."""
    merged, n, out = earlier.tolist(), before, np.full(len(values), np.nan)
    for i, v in enumerate(values.tolist()):
        if n >= least and n:
            p = q * (n - 1)
            k = int(p)
            low = merged[k - below]
            high = merged[k - below + 1] if p > k else low
            out[i] = low + (high - low) * (p - k)
        if v == v:
            insort(merged, v)
            n += 1
    return out


def expanding_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, *, min_history: int, width: int | None, out: str, ts: str = "ts") -> DataFrame:
    """Quantile of all strictly earlier known values of the key, NULL before ``min_history`` of them."""
    keys, part = list(keys), [*keys, CHUNK]
    rows = df.withColumn(CHUNK, F.lit(0).cast("bigint") if width is None else chunk_of(ts, width)).withColumn("_v", F.col(value).cast("double"))
    lean = rows.select(*part, "_v")
    known = lean.where("_v IS NOT NULL")
    bounds = known.groupBy(*keys).agg(F.percentile_approx("_v", [i / PARTS for i in range(1, PARTS)], 10_000).alias("_bounds"))
    placed = known.join(_named(bounds, keys), _same(keys)).select(*part, "_v", F.size(F.filter(F.array_distinct("_bounds"), lambda b: b < F.col("_v"))).alias("_part"))
    # Of each (chunk, range): how many values the chunks before hold. One row per chunk and range, present or not.
    own = lean.groupBy(*part).agg(F.count("_v").alias("_size"))
    past = lambda *by: Window.partitionBy(*keys, *by)
    own = own.withColumn("_all", F.coalesce(F.sum("_size").over(past().orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    held = placed.groupBy(*part, "_part").agg(F.count("*").alias("_n"))
    grid = own.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    cells = grid.join(_named(held, [*part, "_part"]), _same([*part, "_part"]), "left").select(*part, "_part", "_size", "_all", F.coalesce("_n", F.lit(0)).alias("_n"))
    cells = cells.withColumn("_e", F.coalesce(F.sum("_n").over(past("_part").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.withColumn("_below", F.coalesce(F.sum("_e").over(past(CHUNK).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    low = F.floor(q * (F.col("_all") - 1)) - F.col("_size")
    high = F.ceil(q * (F.col("_all") + F.col("_size") - 1))
    asked = cells.where((F.col("_e") > 0) & (F.col("_below") <= high) & (F.col("_below") + F.col("_e") > low))
    asked = asked.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k__part"), F.col(CHUNK).alias("_to"), "_below")
    earlier = placed.join(asked, _same([*keys, "_part"]) & (F.col(CHUNK) < F.col("_to")))
    earlier = earlier.select(*keys, F.col("_to").alias(CHUNK), F.lit(0).alias("_kind"), F.col("_v"), F.col("_below").alias("_at"))
    mine = rows.join(_named(own.select(*part, "_all"), part), _same(part)).select(*part, F.lit(1).alias("_kind"), "_v", F.col("_all").alias("_at"), F.col(ts).alias("_t"), F.struct(*df.columns).alias("_row"))
    both = earlier.unionByName(mine, allowMissingColumns=True)

    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        kind, at, v = ints(table.column("_kind")), ints(table.column("_at")), table.column("_v").to_numpy().astype(float)
        found = np.full(len(v), np.nan)
        for lo, hi in spans(starts, len(v)):
            first = lo + int((kind[lo:hi] == 0).sum())
            if first < hi:
                found[first:hi] = kth_rows(v[lo:first], int(at[lo:first].min()) if first > lo else 0, int(at[first]), v[first:hi], q, min_history)
        result = pa.table({"_row": table.column("_row"), "_q": pa.array(found, from_pandas=True)})
        yield result.filter(pa.array(kind == 1))

    schema = T.StructType([both.schema["_row"], T.StructField("_q", T.DoubleType())])
    # A chunk and its share of earlier values go through whole; the width bounds both.
    done = by_group(both, part, ["_kind", "_v_or_t"], run, schema, True, rows=1 << 62, extra={"_v_or_t": F.when(F.col("_kind") == 0, F.col("_v")).otherwise(F.col("_t").cast("double"))})
    return done.select("_row.*", F.col("_q").alias(out))
