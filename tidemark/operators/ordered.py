"""Exact ranks and quantiles of groups too large for one task, for many columns in one pass.

1. Distinct values are counted per (group, column), combined map-side: a value that repeats a billion times is one row.
2. Sampled bounds cut each column's distinct values into at most ``PARTS`` ranges of about equal size.
3. The ranges' totals, one row each, place every range among its group's positions. They say which range holds a wanted
   position, and only that range's values are put in order, in a task of their own.

The bounds decide how evenly the work is spread, never a result. All steps read the counts of step 1 from one exchange, so
the input itself is evaluated once.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64
SORTED = 1 << 16


def _same(keys: Sequence[str], left: str = "", right: str = "_k_") -> Column:
    return reduce(and_, [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) for k in keys])


def _named(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in df.columns if c not in keys])


def value_counts(df: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """(keys, _m, _v, _n): how often each value of the column number i (_m: _ci) occurs in a group; NULLs are left out."""
    wide = df.select(*keys, *[v.cast("double").alias(f"_c{i}") for i, v in enumerate(columns.values())])
    long = wide.unpivot(list(keys), [f"_c{i}" for i in range(len(columns))], "_m", "_v").where("_v IS NOT NULL")
    # The count stays in use in all later branches, which therefore share one exchange.
    return long.groupBy(*keys, "_m", "_v").agg(F.count("*").alias("_n")).where("_n > 0")


def _ranges(counts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(counts with _part, ranges): ranges holds (keys, _m, _part, _before, _size, _total)."""
    group = [*keys, "_m"]
    cuts = [i / PARTS for i in range(1, PARTS)]
    # Values of one sort's size need no bounds: only the larger groups are sampled and joined.
    large = counts.groupBy(*group).count().where(F.col("count") > SORTED).select(*group)
    sampled = F.array_distinct(F.percentile_approx("_v", cuts, 2000))
    within = counts.join(_named(large, group), _same(group), "left_semi")
    bounds = within.groupBy(*group).agg(sampled.alias("_bounds"))
    placed = counts.join(_named(bounds, group), _same(group), "left").drop(*[f"_k_{k}" for k in group])
    placed = placed.withColumn("_part", F.when(F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", lambda b: b < F.col("_v"))))).drop("_bounds")
    w = Window.partitionBy(*group)  # at most PARTS rows
    ranges = placed.groupBy(*group, "_part").agg(F.sum("_n").alias("_size"))
    before = F.sum("_size").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return placed, ranges.withColumns({"_before": F.coalesce(before, F.lit(0)), "_total": F.sum("_size").over(w)})


def ranks(df: DataFrame, keys: Sequence[str], value: str, *, min_rank: str = "min_rank", avg_rank: str = "avg_rank") -> DataFrame:
    """Competition rank and average-tie rank (the Spearman rank) of each row in its group."""
    placed, ranges = _ranges(value_counts(df, keys, {"v": F.col(value)}), keys)
    part = [*keys, "_m", "_part"]
    inside = Window.partitionBy(*part).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.join(_named(ranges.select(*part, "_before"), part), _same(part))
    first = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    at = at.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_v").alias("_k_value"), (first + 1).alias(min_rank), (first + (F.col("_n") + 1) / 2).alias(avg_rank))
    match = F.col(value).cast("double") == F.col("_k_value")
    return df.join(at, _same(keys) & match if keys else match, "left").select(*df.columns, min_rank, avg_rank)


def quantiles(df: DataFrame, keys: Sequence[str], columns: dict[str, Column], wanted: dict[str, tuple[str, float]], *, higher: Collection[str] = (),
              stats: dict[str, tuple[str, Callable[[Column, Column], Column]]] | None = None) -> DataFrame:
    """(keys, names of ``wanted``, names of ``stats``): exact quantiles (name: column, share) of the groups' known values,
    linear between two values or, for the names in ``higher``, the next observed one. ``stats`` (name: column, aggregate of
    the values and their counts) come from the same counts. Groups without a known value have no row (with ``stats``: groups without any)."""
    keys = list(keys)
    if not keys:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], columns, wanted, higher=higher, stats=stats).drop("_all")
    counts = value_counts(df, keys, columns)
    number = {m: f"_c{i}" for i, m in enumerate(columns)}
    placed, ranges = _ranges(counts, keys)
    part = [*keys, "_m", "_part"]
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(number[m]).alias("m"), F.lit(float(q)).alias("q")) for name, (m, q) in wanted.items()]))
    holds = lambda i, first, n: (F.col(first) <= i) & (i < F.col(first) + F.col(n))
    hit = ranges.withColumn("_w", asked).where("_w.m = _m").withColumn("_at", F.col("_w.q") * (F.col("_total") - 1))
    lo, hi = F.floor("_at"), F.ceil("_at")
    hit = hit.where(holds(lo, "_before", "_size") | holds(hi, "_before", "_size")).select(*part, "_before", "_at", F.col("_w.name").alias("_name"))
    rows = placed.join(_named(hit, part), _same(part)).drop(*[f"_k_{c}" for c in part])
    inside = Window.partitionBy(*part, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    at = lambda i: F.max(F.when(holds(i, "_first", "_n"), F.col("_v")))
    each = rows.groupBy(*keys, "_name").agg(at(lo).alias("_lo"), at(hi).alias("_hi"), F.max(F.col("_at") - lo).alias("_w"))
    # Equal ends as they are: infinite values have no difference.
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w"))
    value = F.when(F.col("_name").isin(list(higher)), F.col("_hi")).otherwise(value) if higher else value
    each = each.select(*keys, "_name", value.alias("_value"))
    out = each.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in wanted])
    if stats:
        aggs = []
        for name, (m, fn) in stats.items():
            own = F.col("_m") == number[m]
            aggs.append(fn(F.when(own, F.col("_v")), F.when(own, F.col("_n"))).alias(name))
        out = counts.groupBy(*keys).agg(*aggs).join(_named(out, keys), _same(keys), "left").drop(*[f"_k_{k}" for k in keys])
    return out


def with_quantiles(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], columns: dict[str, Column], wanted: dict[str, tuple[str, float]], *,
                   higher: Collection[str] = ()) -> DataFrame:
    """``df.groupBy(keys).agg(aggs)`` with quantile columns, NULL where a group has no known value."""
    base, found = df.groupBy(*keys).agg(*aggs), quantiles(df, keys, columns, wanted, higher=higher)
    if not keys:
        return base.join(F.broadcast(found), F.lit(True), "left")  # one row each
    return base.join(_named(found, keys), _same(keys), "left").drop(*[f"_k_{k}" for k in keys])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], *, higher: bool = False) -> DataFrame:
    """``quantiles`` of one column."""
    return quantiles(df, keys, {"v": F.col(value)}, {n: ("v", q) for n, q in wanted.items()}, higher=list(wanted) if higher else ())
