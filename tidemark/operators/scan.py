"""Ordered scans per key that never put one key into one task.

A window with ``PARTITION BY key ORDER BY ts`` sorts the whole key in one task, so one symbol that
holds a third of the table decides the run time. Two constructions replace it:

* ``scan``: cut the key's time line into chunks, scan inside each (key, chunk), reduce every chunk
  to one row with a map-side combined aggregate, scan those few rows per key and add the carried value
  back. Exact for any chunk width. Covers running sum/max/min/count, last-non-null and lag in both directions, and
  the max or min of a running sum, all of a call in one pass. ``drawdowns`` and ``numbered_runs`` reduce chunks in the
  same way to what their question needs.
* ``range_halo`` / ``row_halo``: for bounded frames, copy the rows a later chunk needs into it, run an
  ordinary window per (key, chunk) and drop the copies.

The chunk is a plain function of the row (``ts div width``), so a retried task rebuilds the same chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import HOUR

CHUNK = "_chunk"


def chunk_of(ts: str | Column, width: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(ts / F.lit(width)).cast("bigint")


def chunk_width(df: DataFrame, keys: Sequence[str], ts: str = "ts", *, target_rows: int = 2_000_000,
                probe: int = HOUR) -> int:
    """A width that keeps the densest (key, chunk) near ``target_rows``.

    One aggregate over two columns (combined map-side) finds the densest probe interval, so a burst
    narrows the chunks just as a large table does.
    """
    dense = (df.groupBy(*keys, chunk_of(ts, probe).alias(CHUNK)).count()
             .agg(F.max("count")).first()[0])
    if not dense:
        return probe
    width = int(probe * target_rows / dense)
    return max(1, min(width, 24 * probe))


def _over(kind: str, col: Column, window) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[kind](col).over(window)


class Run(NamedTuple):
    """One running aggregate: ``kind`` is sum, max, min, count or last (NULLs skipped). ``inclusive=False`` leaves the
    current row out; ``reverse`` scans from the end of the time line (so ``last`` becomes "next"). ``of`` names a sum of the
    same call and direction: the running max or min of that running sum (``value`` is then unused)."""

    kind: str
    value: Column | None = None
    reverse: bool = False
    inclusive: bool = True
    of: str | None = None


def _frame(keys: Sequence[str], sort: Sequence[str], run: Run):
    order = [F.col(c).desc() if run.reverse else F.col(c).asc() for c in sort]
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if run.inclusive else -1)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int | None, runs: dict[str, Run], *, ts: str = "ts") -> DataFrame:
    """Add any number of running aggregates, of both directions and chained ones, reading ``df`` twice: once for one row of
    totals per (key, chunk), once for the rows. NULL is a key like any other, and a NULL time a chunk of its own.

    ``width=None`` is for series with one row per key and calendar step (daily closes): their keys are bounded by
    the calendar, so one window per key does, and ``df`` is read once.
    """
    keys, order, part = list(keys), list(order), [*keys, CHUNK]
    plain, chained = {n: r for n, r in runs.items() if r.of is None}, {n: r for n, r in runs.items() if r.of}
    kept = [c for c in df.columns if c not in runs]
    # A chain follows the sum with the row itself, whatever the sum's own frame.
    local = lambda d, n, frame: _over("sum", F.col(f"_v_{runs[n].of}"), _frame(frame, order, runs[n]._replace(inclusive=True)))
    if width is None:
        d = df.withColumns({f"_v_{n}": r.value for n, r in plain.items()}).withColumn(CHUNK, F.lit(0))
        d = d.withColumns({f"_l_{n}": local(d, n, keys) for n in chained})
        values = {n: _over(r.kind, F.col(f"_l_{n}" if r.of else f"_v_{n}"), _frame(keys, order, r)) for n, r in runs.items()}
        values = {n: F.coalesce(v, F.lit(0)) if runs[n].kind == "count" else v for n, v in values.items()}
        return d.select(*kept, *[v.alias(n) for n, v in values.items()])
    base = df.withColumns({CHUNK: chunk_of(ts, width), **{f"_v_{n}": r.value for n, r in plain.items()}})
    at = F.struct(*order)

    def total(n: str, r: Run) -> Column:
        if r.of:
            return {"max": F.max, "min": F.min}[r.kind](f"_l_{n}")
        v = F.col(f"_v_{n}")
        if r.kind == "last":
            return (F.min_by if r.reverse else F.max_by)(v, F.when(v.isNotNull(), at))
        return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[r.kind](v)

    lean = base.select(*part, *[c for c in order if c not in part], *[f"_v_{n}" for n in plain])
    lean = lean.withColumns({f"_l_{n}": local(lean, n, part) for n in chained})
    totals = lean.groupBy(*part).agg(*[total(n, r).alias(f"_t_{n}") for n, r in runs.items()])
    before = lambda r: _frame(keys, [CHUNK], r._replace(inclusive=False))
    carry = totals.withColumns({f"_c_{n}": _over("sum" if r.kind == "count" else r.kind, F.col(f"_t_{n}"), before(r)) for n, r in plain.items()})
    shifted = lambda c, n: F.col(c) + F.coalesce(F.col(f"_c_{runs[n].of}"), F.lit(0))
    carry = carry.withColumns({f"_c_{n}": _over(r.kind, shifted(f"_t_{n}", n), before(r)) for n, r in chained.items()})
    # One row per (key, chunk).
    named = carry.select(*[F.col(c).alias(f"_k_{c}") for c in part], *[f"_c_{n}" for n in runs])
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in part]
    out = base.join(named, reduce(and_, same), "left").drop(*[f"_k_{c}" for c in part])
    out = out.withColumns({f"_l_{n}": local(out, n, part) for n in chained})
    added = {}
    for n, r in runs.items():
        here, past = _over(r.kind, F.col(f"_l_{n}" if r.of else f"_v_{n}"), _frame(part, order, r)), F.col(f"_c_{n}")
        if r.of:
            here = here + F.coalesce(F.col(f"_c_{r.of}"), F.lit(0))
        if r.kind == "last":
            added[n] = F.coalesce(here, past)
        elif r.kind in ("max", "min"):
            added[n] = (F.greatest if r.kind == "max" else F.least)(here, past)
        elif r.kind == "count":
            added[n] = F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))
        else:
            added[n] = F.when(here.isNotNull() | past.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0)))
    return out.select(*kept, *[v.alias(n) for n, v in added.items()])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int | None,
            specs: dict[str, tuple[str, Column]], *, ts: str = "ts", inclusive: bool = True,
            reverse: bool = False) -> DataFrame:
    """``scan`` of (kind, expression) specs that share one direction and frame."""
    runs = {n: Run(kind, value, reverse, inclusive) for n, (kind, value) in specs.items()}
    return scan(df, keys, order, width, runs, ts=ts)


def drawdowns(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int | None, steps: dict[str, Column], *, ts: str = "ts") -> DataFrame:
    """(keys, names): the least difference, of each running sum of ``steps``, to its own peak so far (0 at the start).

    A chunk is reduced to its sum, its highest and lowest prefix and its inner drawdown; the chunks' rows then give the
    answer, so ``df`` is read once and no key is in one task."""
    keys = list(keys)
    part = [*keys, CHUNK]
    d = df.select(*keys, *[c for c in order if c not in keys], (F.lit(0) if width is None else chunk_of(ts, width)).alias(CHUNK), *[v.alias(f"_v_{n}") for n, v in steps.items()])
    frame = _frame(part, order, Run("sum"))
    d = d.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(frame) for n in steps})
    d = d.withColumns({f"_d_{n}": F.col(f"_l_{n}") - F.max(f"_l_{n}").over(frame) for n in steps})
    parts = [(F.sum, "_v_", "_s_"), (F.max, "_l_", "_p_"), (F.min, "_l_", "_m_"), (F.min, "_d_", "_d_")]
    chunks = d.groupBy(*part).agg(*[agg(f"{src}{n}").alias(f"{dst}{n}") for n in steps for agg, src, dst in parts])
    past = _frame(keys, [CHUNK], Run("sum", inclusive=False))
    chunks = chunks.withColumns({f"_c_{n}": F.coalesce(F.sum(f"_s_{n}").over(past), F.lit(0.0)) for n in steps})
    chunks = chunks.withColumns({f"_k_{n}": F.greatest(F.max(F.col(f"_c_{n}") + F.col(f"_p_{n}")).over(past), F.lit(0.0)) for n in steps})
    worst = {n: F.least(F.col(f"_d_{n}"), F.col(f"_c_{n}") + F.col(f"_m_{n}") - F.col(f"_k_{n}")) for n in steps}
    return chunks.groupBy(*keys).agg(*[F.min(w).alias(n) for n, w in worst.items()])


def numbered_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int | None, fresh: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
                  columns: Sequence[str], *, out: str, ts: str = "ts", peers: bool = False) -> DataFrame:
    """Number the runs of each key's rows: ``fresh(now, before)`` says of two rows in succession, by the columns of each, if
    a new run starts. A chunk is reduced to its first and last row and its number of inner starts: two reads of ``df``.
    ``peers``: rows of one ``ts`` share the number of the last of them (they are in one chunk)."""
    keys, order = list(keys), list(order)
    part = [*keys, CHUNK]
    base = df.withColumn(CHUNK, F.lit(0) if width is None else chunk_of(ts, width))
    row, step = F.struct(*columns), Window.partitionBy(*part).orderBy(*order)
    field = lambda s: lambda c: F.col(f"{s}.{c}")
    start = lambda now, was: F.when(F.col(was).isNull(), 1).when(fresh(field(now), field(was)), 1).otherwise(0).cast("bigint")

    def inner(d: DataFrame) -> DataFrame:
        """_s: starts a run, by the row before in the chunk; 0 for the chunk's first."""
        d = d.withColumn("_now", row).withColumn("_was", F.lag("_now").over(step))
        return d.withColumn("_s", F.when(F.col("_was").isNull(), 0).otherwise(start("_now", "_was")))

    lean = inner(base.select(*dict.fromkeys([*part, *order, *columns])))
    at = F.struct(*order)
    chunks = lean.groupBy(*part).agg(F.sum("_s").alias("_n"), F.min_by("_now", at).alias("_first"), F.max_by("_now", at).alias("_last"))
    chain = Window.partitionBy(*keys).orderBy(CHUNK)
    chunks = chunks.withColumn("_before", F.lag("_last").over(chain)).withColumn("_opens", start("_first", "_before"))
    carry = F.sum(F.col("_n") + F.col("_opens")).over(chain.rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select(*[F.col(c).alias(f"_k_{c}") for c in part], (F.coalesce(carry, F.lit(0)) + F.col("_opens")).alias("_carry"))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in part]
    rows = inner(base.join(chunks, reduce(and_, same), "left"))
    upto = Window.partitionBy(*part).orderBy(ts).rangeBetween(Window.unboundedPreceding, 0) if peers else step.rowsBetween(Window.unboundedPreceding, 0)
    number = F.col("_carry") + F.sum("_s").over(upto)
    return rows.select(*[c for c in df.columns if c != out], number.alias(out))


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int | None, columns: Sequence[str],
             *, ts: str = "ts", prefix: str = "prev_", reverse: bool = False) -> DataFrame:
    """The row before (``reverse``: after) each row of its key, NULL values kept."""
    row = F.struct(*columns)
    out = running(df, keys, order, width, {"_row": ("last", row)}, ts=ts, inclusive=False, reverse=reverse)
    return out.select(*df.columns, *[F.col(f"_row.{c}").alias(f"{prefix}{c}") for c in columns])


def range_halo(df: DataFrame, width: int | None, *, back: int = 0, ahead: int = 0, ts: str = "ts") -> DataFrame:
    """Copy rows into the neighbouring chunks whose RANGE frames reach them.

    A frame ``[ts - back, ts + ahead]`` evaluated inside (key, ``_chunk``) then sees every row it needs.
    Filter ``_own`` after the window. ``width=None``: one chunk per key (calendar-bounded series).
    """
    if width is None:
        return df.withColumn(CHUNK, F.lit(0)).withColumn("_own", F.lit(True))
    own = chunk_of(ts, width)
    first = chunk_of(F.col(ts) - F.lit(ahead), width)
    last = chunk_of(F.col(ts) + F.lit(back), width)
    return (df.withColumn("_home", own)
            .withColumn(CHUNK, F.explode(F.sequence(first, last)))
            .withColumn("_own", F.col(CHUNK) == F.col("_home")).drop("_home"))


def row_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, width: int | None, *,
             ts: str = "ts", block: int = 100_000) -> DataFrame:
    """Chunks by row position for ROWS frames of up to ``rows`` preceding rows.

    The position comes from ``running``; the last ``rows`` rows of a block are copied to the next one.
    """
    block = max(block, rows + 1)
    numbered = running(df, keys, order, width, {"_pos": ("count", F.lit(1))}, ts=ts)
    if width is None:
        return numbered.withColumn(CHUNK, F.lit(0)).withColumn("_own", F.lit(True))
    home = F.floor((F.col("_pos") - 1) / F.lit(block)).cast("bigint")
    reach = F.floor((F.col("_pos") - 1 + F.lit(rows)) / F.lit(block)).cast("bigint")
    return (numbered.withColumn("_home", home)
            .withColumn(CHUNK, F.explode(F.sequence(home, reach)))
            .withColumn("_own", F.col(CHUNK) == F.col("_home")).drop("_home"))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", CHUNK, "_pos")


def in_chunk(keys: Sequence[str], *order: str) -> "Window":
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)
