"""As-of joins: both sides are stacked and one ordered scan carries the match across."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import DAY
from .scan import Run, scan


def _stack(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
           take: Sequence[str], right_tie: Sequence[str]) -> DataFrame:
    """Left rows keep all their columns in ``_left``; right rows carry ``_right``.

    ``_side`` is the tie-breaker between equal times; callers choose its value for inclusiveness.
    """
    tie = F.struct(*[F.col(c) for c in right_tie]) if right_tie else F.struct(F.lit(0).alias("t"))
    # _seq must share one type on both sides, so the right tie columns are typed into a NULL struct.
    l = left.select(*by, F.col(left_on).cast("bigint").alias("_ts"), F.lit(1).alias("_is_left"),
                    F.struct(*left.columns).alias("_left"))
    r = right.select(*by, F.col(right_on).cast("bigint").alias("_ts"), F.lit(0).alias("_is_left"),
                     F.struct(F.col(right_on).cast("bigint").alias("source_ts"), *take).alias("_right"), tie.alias("_tie"))
    return l.unionByName(r, allowMissingColumns=True)


def _join(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_on: str, right_on: str,
          take: Sequence[str], right_tie: Sequence[str], width: int, forward: bool, strict: bool,
          prefix: str) -> DataFrame:
    by = list(by)
    stacked = _stack(left, right, by, left_on, right_on, take, right_tie)
    # Backward, inclusive: right before left at equal times. Strict: left first. Forward scans from
    # the end, so the roles swap.
    right_first = (not strict) != forward
    stacked = stacked.withColumn("_side", F.col("_is_left") if right_first else 1 - F.col("_is_left"))
    found = scan(stacked, by, ["_ts", "_side", "_tie"], width, {"_hit": Run("last", F.col("_right"), reverse=forward)}, ts="_ts")
    out = found.where("_is_left = 1").select("_left.*", F.col("_hit.source_ts").alias(f"{prefix}source_ts"),
                                             *[F.col(f"_hit.{c}").alias(f"{prefix}{c}") for c in take])
    return out


def asof_backward(left: DataFrame, right: DataFrame, *, by: Sequence[str], take: Sequence[str], width: int,
                  left_on: str = "ts", right_on: str = "ts", right_tie: Sequence[str] = (), strict: bool = False,
                  max_age: int | None = None, prefix: str = "") -> DataFrame:
    """Latest right row at or before (``strict``: before) each left row, with its time and age.

    The value is kept when stale; ``state`` says missing, stale or available.
    """
    out = _join(left, right, by=by, left_on=left_on, right_on=right_on, take=take, right_tie=right_tie,
                width=width, forward=False, strict=strict, prefix=prefix)
    age = F.col(left_on) - F.col(f"{prefix}source_ts")
    state = F.when(F.col(f"{prefix}source_ts").isNull(), "missing")
    if max_age is not None:
        state = state.when(age > max_age, "stale")
    return out.withColumn(f"{prefix}age", age).withColumn(f"{prefix}state", state.otherwise("available"))


def asof_forward(left: DataFrame, right: DataFrame, *, by: Sequence[str], take: Sequence[str], width: int,
                 left_on: str = "ts", right_on: str = "ts", right_tie: Sequence[str] = (), strict: bool = False,
                 prefix: str = "") -> DataFrame:
    """First right row at or after (``strict``: after) each left row."""
    return _join(left, right, by=by, left_on=left_on, right_on=right_on, take=take, right_tie=right_tie,
                 width=width, forward=True, strict=strict, prefix=prefix)


def at_targets(left: DataFrame, right: DataFrame, *, by: Sequence[str], targets: dict[str, Column], found: dict[str, Run], width: int, right_on: str,
               right_tie: Sequence[str], take: Sequence[str], strict: bool = False) -> DataFrame:
    """``left`` with a struct column for each of ``targets`` (times): the running values ``found`` over the right rows up to
    then. All targets go through one scan; the rows of a left row meet again by its columns, equal rows by their number."""
    named = F.array(*[F.struct(F.lit(n).alias("n"), t.cast("bigint").alias("t")) for n, t in targets.items()])
    wide = left.withColumn("_at", F.explode(named))
    stacked = _stack(wide, right, by, "_at.t", right_on, take, right_tie).withColumn("_side", 1 - F.col("_is_left") if strict else F.col("_is_left"))
    out = scan(stacked, by, ["_ts", "_side", "_tie"], width, found, ts="_ts").where("_is_left = 1")
    out = out.select("_left.*", F.struct(*found).alias("_found"))
    g = out.groupBy(*left.columns).agg(*[F.max(F.when(F.col("_at.n") == n, F.col("_found"))).alias(n) for n in targets], F.count_if(F.col("_at.n") == next(iter(targets))).alias("_same"))
    return g.withColumn("_same", F.explode(F.array_repeat(F.lit(0), F.col("_same").cast("int")))).drop("_same")


def asof_change(left: DataFrame, right: DataFrame, *, by: Sequence[str], value: str, offset: int, width: int,
                left_on: str = "ts", right_on: str = "ts", right_tie: Sequence[str] = ()) -> DataFrame:
    """Value known now, value known ``offset`` earlier and their relative change."""
    both = at_targets(left, right, by=by, targets={"now": F.col(left_on), "then": F.col(left_on) - offset}, found={"hit": Run("last", F.col("_right"))},
                      width=width, right_on=right_on, right_tie=right_tie, take=[value])
    each = [c for n in ("now", "then") for at in [F.when(F.col(f"{n}.hit").isNotNull(), F.col(left_on) - (0 if n == "now" else offset))] for c in (
        F.col(f"{n}.hit.source_ts").alias(f"{n}_source_ts"), F.col(f"{n}.hit.{value}").alias(f"{n}_{value}"), (at - F.col(f"{n}.hit.source_ts")).alias(f"{n}_age"),
        F.when(F.col(f"{n}.hit").isNull(), "missing").otherwise("available").alias(f"{n}_state"))]
    return both.select(*left.columns, *each).withColumn("change", F.try_divide(F.col(f"now_{value}"), F.col(f"then_{value}")) - 1)


def asof_prior_day(left: DataFrame, right: DataFrame, *, by: Sequence[str], value: str, max_age_days: int,
                   left_on: str = "date", right_on: str = "date", width: int = 365 * DAY) -> DataFrame:
    """Value of the latest earlier date, unknown when that date is more than ``max_age_days`` old."""
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("bigint") * F.lit(DAY)
    l = left.withColumn("_t", day(left_on))
    r = right.withColumn("_t", day(right_on))
    out = asof_backward(l, r, by=by, take=[value], width=width, left_on="_t", right_on="_t", strict=True, prefix="asof_")
    fresh = F.col("asof_age") <= F.lit(max_age_days * DAY)
    return out.select(*left.columns, F.when(fresh, F.col(f"asof_{value}")).alias(f"prior_{value}"))


def asof_both(left: DataFrame, right: DataFrame, *, by: Sequence[str], take: Sequence[str], width: int, left_on: str = "ts", right_on: str = "ts",
              right_tie: Sequence[str] = ()) -> DataFrame:
    """First right row at or after (f_) and last one before (b_) each left row, by one scan in both directions."""
    stacked = _stack(left, right, by, left_on, right_on, take, right_tie).withColumn("_side", 1 - F.col("_is_left"))
    hit = F.col("_right")
    found = scan(stacked, by, ["_ts", "_side", "_tie"], width, {"_f": Run("last", hit, reverse=True), "_b": Run("last", hit)}, ts="_ts")
    return found.where("_is_left = 1").select("_left.*", *[F.col(f"_{s}.{c}").alias(f"{s}_{c}") for s in "fb" for c in ("source_ts", *take)])


def asof_nearest(left: DataFrame, right: DataFrame, *, by: Sequence[str], target: str, take: Sequence[str],
                 tolerance: Column, width: int, right_on: str = "ts", after: str | None = None) -> DataFrame:
    """Right row nearest to ``target`` within ``tolerance``; the later one wins an exact tie.

    With ``after``, only right rows strictly later than that left column count.
    """
    b = asof_both(left, right, by=by, take=take, width=width, left_on=target, right_on=right_on)
    limit = F.col(after) if after else F.lit(None)
    ok = lambda side: (F.abs(F.col(f"{side}_source_ts") - F.col(target)) <= tolerance) & (
        (F.col(f"{side}_source_ts") > limit) if after else F.lit(True))
    f_err = F.when(ok("f"), F.abs(F.col("f_source_ts") - F.col(target)))
    b_err = F.when(ok("b"), F.abs(F.col("b_source_ts") - F.col(target)))
    use_b = b_err.isNotNull() & (f_err.isNull() | (b_err < f_err))
    pick = lambda c: F.when(use_b, F.col(f"b_{c}")).when(f_err.isNotNull(), F.col(f"f_{c}"))
    return b.select(*left.columns, pick("source_ts").alias("match_ts"), *[pick(c).alias(f"match_{c}") for c in take])


def asof_bitemporal(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_on: str, available: str,
                    reference: str, value: str, max_age: int, width: int) -> DataFrame:
    """Among rows available strictly before ``left_on`` the one with the latest ``reference``.

    A later-available row wins equal references. The struct maximum (reference, available, value) is a
    running maximum of the stacked rows, read where a left row stands before the right rows of its time.
    """
    right = right.where(F.col(available).isNotNull() & F.col(reference).isNotNull())
    stacked = _stack(left, right, by, left_on, available, [reference, available, value], [reference, value]).withColumn("_side", 1 - F.col("_is_left"))
    best = F.when(F.col("_is_left") == 0, F.struct(*[F.col(f"_right.{c}").alias(c) for c in (reference, available, value)]))
    out = scan(stacked, by, ["_ts", "_side", "_tie"], width, {"m__best": Run("max", best)}, ts="_ts").where("_is_left = 1").select("_left.*", "m__best")
    age = F.col(left_on) - F.col(f"m__best.{reference}")
    return out.select(*left.columns, F.when(age <= max_age, F.col(f"m__best.{reference}")).alias("reference"),
                      F.when(age <= max_age, F.col(f"m__best.{value}")).alias(value))


def window_total(left: DataFrame, right: DataFrame, *, by: Sequence[str], start: str, stop: str, value: str,
                 width: int, right_on: str = "ts", right_tie: Sequence[str] = (), closed: str = "right") -> DataFrame:
    """Sum and count of right values with time in (start, stop] (or [start, stop) when ``closed='left'``).

    Both ends look up a running prefix sum in one scan, so overlapping intervals cost no row expansion.
    """
    v = F.col(f"_right.{value}")
    out = at_targets(left, right, by=by, targets={"_s": F.col(start), "_e": F.col(stop)}, found={"cum": Run("sum", v), "seen": Run("count", v)}, width=width,
                     right_on=right_on, right_tie=right_tie, take=[value], strict=closed == "left")
    gain = lambda c: F.coalesce(f"_e.{c}", F.lit(0)) - F.coalesce(f"_s.{c}", F.lit(0))
    return out.select(*left.columns, gain("cum").alias("total"), gain("seen").alias("n"))
