"""Order progress, minute flow, liquidation ladders and account-read audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import liq_bin, liq_bucket
from ..session import MINUTE
from .ordered import with_quantiles


def order_progress(heads: DataFrame, fills: DataFrame, *, now: int, gap: int, completed: float = 0.98) -> DataFrame:
    """Fold fills per order: cumulative size and notional, first and last fill, status.

    completed: at least ``completed`` of the declared size; ended_suspected: no fill for ``gap``.
    """
    g = fills.groupBy("order_id").agg(F.sum("sz").alias("cum_sz"), F.sum(F.col("sz") * F.col("px")).alias("cum_notional"), F.min("ts").alias("start_ts"),
                                      F.max("ts").alias("last_fill_ts"), F.max_by("px", F.struct("ts", "line", "part", "px")).alias("last_px"))
    j = heads.join(g, "order_id")
    status = (F.when((F.col("declared_sz") > 0) & (F.col("cum_sz") >= F.col("declared_sz") * completed), "completed")
              .when(F.lit(now) - F.col("last_fill_ts") > gap, "ended_suspected").otherwise("active"))
    return j.withColumn("status", status)


def _remaining(side: str) -> Column:
    left = F.greatest(F.col("declared_sz") - F.col("cum_sz"), F.lit(0.0)) * F.col("last_px")
    return F.sum(F.when((F.col("status") == "active") & (F.col("side") == side) & (F.col("declared_sz") > 0), left))


def flow_minute(orders: DataFrame, fills: DataFrame, *, now: int, window: int, mature_only: bool = False) -> DataFrame:
    """Per coin: active orders by side, fill rate of the last ``window`` per minute, remaining declared notional
    (NULL when nothing is declared). ``mature_only`` rates active orders older than the window."""
    active = F.col("status") == "active"
    old = F.col("start_ts") < now - window
    counted = (active & old) if mature_only else F.lit(True)
    recent = (fills.where(F.col("ts") >= now - window).groupBy("order_id").agg(F.sum(F.col("px") * F.col("sz")).alias("_usd")))
    j = orders.join(recent, "order_id", "left")
    minutes = window / MINUTE
    rate = lambda s: F.sum(F.when((F.col("side") == s) & counted, F.coalesce("_usd", F.lit(0.0))).otherwise(0.0)) / minutes
    return j.groupBy("coin").agg(
        F.count_if(active & (F.col("side") == "B")).alias("active_buy"), F.count_if(active & (F.col("side") == "A")).alias("active_sell"),
        F.count_if(active & ~old & (F.col("side") == "B")).alias("new_buy"), F.count_if(active & ~old & (F.col("side") == "A")).alias("new_sell"),
        rate("B").alias("buy_rate_usd_min"), rate("A").alias("sell_rate_usd_min"), _remaining("B").alias("buy_remaining_usd"), _remaining("A").alias("sell_remaining_usd"))


def order_rates(orders: DataFrame, fills: DataFrame, *, now: int, window: int) -> DataFrame:
    """Each order's fill rate over the last window."""
    recent = fills.where(F.col("ts") >= now - window).groupBy("order_id").agg((F.sum(F.col("px") * F.col("sz")) / (window / MINUTE)).alias("rate_usd_min"))
    return orders.join(recent, "order_id", "left")


def dominant_order(orders: DataFrame, fills: DataFrame, *, now: int, window: int, share: float = 0.5) -> DataFrame:
    """Mature active orders whose own rate exceeds ``share`` of their coin's total. Coins are few, so the totals
    are an aggregate joined back, not a window over a coin's orders."""
    r = order_rates(orders.where((F.col("status") == "active") & (F.col("start_ts") < now - window)), fills, now=now, window=window)
    total = r.groupBy("coin").agg(F.sum("rate_usd_min").alias("coin_rate"))
    j = r.join(total, "coin")
    return j.where(F.col("rate_usd_min") > share * F.col("coin_rate")).withColumn("share", F.col("rate_usd_min") / F.col("coin_rate"))


def near_liquidation(positions: DataFrame, marks: DataFrame, *, ratio: float = 0.25) -> DataFrame:
    """Positions whose liquidation price lies within ``ratio`` of the coin's mark."""
    j = positions.where(F.col("liq_px").isNotNull()).join(marks.select("coin", "mark"), "coin").where(F.col("mark") > 0)
    return j.withColumn("distance", F.abs(F.col("mark") - F.col("liq_px")) / F.col("mark")).where(F.col("distance") <= ratio)


def squeeze_signal(flow: DataFrame, near: DataFrame, marks: DataFrame, *, strong: float = 2.0, band: float = 0.15) -> DataFrame:
    """One side's rate at least ``strong`` times the other while positions of the other direction sit within ``band``."""
    short = (F.col("szi") < 0) & F.col("liq_px").between(F.col("mark"), F.col("mark") * (1 + band))
    long = (F.col("szi") > 0) & F.col("liq_px").between(F.col("mark") * (1 - band), F.col("mark"))
    v = F.coalesce("position_value", F.lit(0.0))
    near_usd = near.groupBy("coin").agg(F.sum(F.when(short, v)).alias("short_usd"), F.sum(F.when(long, v)).alias("long_usd"))
    j = flow.join(near_usd, "coin").join(marks.select("coin", "mark"), "coin")
    b, s = F.col("buy_rate_usd_min"), F.col("sell_rate_usd_min")
    kind = (F.when((s > 0) & (b >= s * strong) & (F.col("short_usd") > 0), "short_squeeze")
            .when((b > 0) & (s >= b * strong) & (F.col("long_usd") > 0), "long_squeeze"))
    return j.withColumn("signal", kind).where("signal IS NOT NULL").select("coin", "signal", F.greatest(F.try_divide(b, s), F.try_divide(s, b)).alias("ratio"),
                                                                           F.when(kind == "short_squeeze", F.col("short_usd")).otherwise(F.col("long_usd")).alias("near_usd"))


def exit_under_pressure(near: DataFrame, orders: DataFrame) -> DataFrame:
    """Near-liquidation positions whose user runs an opposite reduce-only order; remaining notional when declared."""
    o = orders.where((F.col("status") == "active") & F.col("reduce_only")).select(
        "order_id", "user", "coin", F.col("side").alias("order_side"), F.when(F.col("declared_sz") > 0, F.greatest(F.col("declared_sz") - F.col("cum_sz"), F.lit(0.0)) * F.col("last_px")).alias("remaining_usd"))
    want = F.when(F.col("szi") < 0, "B").when(F.col("szi") > 0, "A")
    return near.withColumn("order_side", want).join(o, ["user", "coin", "order_side"])


def top_orders(orders: DataFrame, n: int = 10) -> DataFrame:
    """Largest active orders by (declared, remaining, rate)."""
    d = orders.where("status = 'active'").withColumn("remaining_usd", F.when(F.col("declared_sz") > 0, F.greatest(F.col("declared_sz") - F.col("cum_sz"), F.lit(0.0)) * F.col("last_px")))
    return d.orderBy((F.coalesce(F.col("declared_sz") > 0, F.lit(False))).desc(), F.coalesce("remaining_usd", F.lit(0.0)).desc(),
                     F.coalesce("rate_usd_min", F.lit(0.0)).desc(), "order_id").limit(n)


def ladder(positions: DataFrame, marks: DataFrame, *, band_pct: float, range_pct: float, min_usd: float, fresh_after: int) -> DataFrame:
    """Notional, count and active-order notional per distance bucket and coin; every bucket is present, totals
    outside the range and without a liquidation price have their own rows; cumulative from the mark outward."""
    bands = max(int(round(range_pct / band_pct)), 1)
    p = positions.where(F.col("ts") >= fresh_after).join(marks.select("coin", "mark"), "coin")
    label = (F.when(F.col("liq_px").isNull(), "excluded_null_liquidation").when(F.col("position_value") < min_usd, None)
             .otherwise(liq_bin("szi", "liq_px", "mark", band_pct, range_pct)))
    g = p.withColumn("bucket", label).where("bucket IS NOT NULL").groupBy("coin", "bucket").agg(
        F.sum("position_value").alias("notional"), F.count("*").alias("count"), F.sum(F.when(F.col("has_active_order"), F.col("position_value")).otherwise(0.0)).alias("active_notional"))
    names = [f"{d}:{i}" for d in ("down", "up") for i in range(bands)] + ["outside", "excluded_null_liquidation"]
    spine = marks.select("coin", F.explode(F.array(*map(F.lit, names))).alias("bucket"))
    full = spine.join(g, ["coin", "bucket"], "left").fillna(0, subset=["notional", "count", "active_notional"])
    side = F.split_part("bucket", F.lit(":"), F.lit(1))
    i = F.try_to_number(F.nullif(F.split_part("bucket", F.lit(":"), F.lit(2)), F.lit("")), F.lit("999")).cast("int")
    w = Window.partitionBy("coin", "_side").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)  # one row per bucket
    return full.withColumn("_side", side).withColumn("_i", i).withColumn("cumulative", F.when(F.col("_i").isNotNull(), F.sum("notional").over(w))).drop("_side", "_i")


def bucket_totals(positions: DataFrame, mid: Column, keys: Sequence[str], *, min_usd: float, band_pct: float, range_pct: float) -> DataFrame:
    """Notional per bucket including the exclusion buckets, as rows; unknown valuations are left out."""
    b = liq_bucket("szi", "liq_px", mid, "position_value", min_usd=min_usd, band_pct=band_pct, range_pct=range_pct)
    return positions.withColumn("bucket", b).where("bucket IS NOT NULL").groupBy(*keys, "bucket").agg(F.sum("position_value").alias("notional"), F.count("*").alias("count"))


def change_decomposition(old: DataFrame, new: DataFrame, cohort: DataFrame, *, old_mid: Column, new_mid: Column, min_usd: float = 0.0,
                         band_pct: float = 1.0, range_pct: float = 30.0) -> DataFrame:
    """Per-bucket change between two observations split into joins, departures, staleness, position changes at the
    old mid and re-binning at the new mid; the residual is zero by construction and is reported.

    ``old``/``new``: one row per user with szi, position_value, liq_px. ``cohort``: user, common, stale flags.
    """
    label = lambda mid: liq_bucket("szi", "liq_px", mid, "position_value", min_usd=min_usd, band_pct=band_pct, range_pct=range_pct)
    flags = cohort.select("user", F.coalesce("stale", F.lit(False)).alias("stale"), (F.coalesce("common", F.lit(False)) & ~F.coalesce("stale", F.lit(False))).alias("common"))
    v = F.col("position_value")
    o = old.join(flags, "user", "left").select(label(old_mid).alias("bucket"), v.alias("v"), F.coalesce("common", F.lit(False)).alias("common"), F.coalesce("stale", F.lit(False)).alias("stale"), F.lit("old").alias("at"))
    n = new.join(flags, "user", "left")
    fixed = n.select(label(old_mid).alias("bucket"), v.alias("v"), F.coalesce("common", F.lit(False)).alias("common"), F.lit(False).alias("stale"), F.lit("fixed").alias("at"))
    moved = n.select(label(new_mid).alias("bucket"), v.alias("v"), F.coalesce("common", F.lit(False)).alias("common"), F.lit(False).alias("stale"), F.lit("new").alias("at"))
    total = lambda cond: F.sum(F.when(cond, F.col("v")).otherwise(0.0))
    at, c, st = F.col("at"), F.col("common"), F.col("stale")
    g = o.unionByName(fixed).unionByName(moved).where("bucket IS NOT NULL").groupBy("bucket").agg(
        total(at == "old").alias("old_notional"), total(at == "new").alias("new_notional"), total((at == "fixed") & ~c).alias("joins_or_refreshed"),
        (-total((at == "old") & ~c & ~st)).alias("departures"), (-total((at == "old") & st)).alias("staleness"),
        (total((at == "fixed") & c) - total((at == "old") & c)).alias("common_position_change_fixed_mid"), (total(at == "new") - total(at == "fixed")).alias("mid_or_bin_change"))
    parts = sum((F.col(p) for p in ("joins_or_refreshed", "departures", "staleness", "common_position_change_fixed_mid", "mid_or_bin_change")), F.lit(0.0))
    return g.withColumn("delta_notional", F.col("new_notional") - F.col("old_notional")).withColumn("residual_notional", F.col("delta_notional") - parts)


def cohort_changes(old: DataFrame, new: DataFrame, stale: DataFrame, key: str = "user") -> DataFrame:
    """joined, exited, stale or kept per user."""
    j = (old.select(key).distinct().withColumn("_o", F.lit(True)).join(new.select(key).distinct().withColumn("_n", F.lit(True)), key, "full")
         .join(stale.select(key).distinct().withColumn("_s", F.lit(True)), key, "left"))
    change = (F.when(F.col("_o").isNull(), "joined").when(F.col("_n").isNotNull(), "kept").when(F.col("_s").isNotNull(), "stale").otherwise("exited"))
    return j.select(key, change.alias("change"))


def freshness_report(attempts: DataFrame, candidates: DataFrame, *, now: int, fresh: int, group: Sequence[str] = ()) -> DataFrame:
    """Status of each candidate's latest read and ages of reads and of successes."""
    ok = F.col("status").isin("success", "empty")
    last = attempts.groupBy("user").agg(F.max_by("status", "attempt_id").alias("status"), F.max_by("observed_ts", "attempt_id").alias("observed_ts"),
                                        F.max_by(F.when(ok, F.col("observed_ts")), F.when(ok, F.col("attempt_id"))).alias("success_ts"))
    c = candidates.join(last, "user", "left").withColumn("status", F.coalesce("status", F.lit("unobserved"))) \
        .withColumn("age_ms", F.greatest(F.lit(now) - F.col("observed_ts"), F.lit(0))).withColumn("success_age_ms", F.greatest(F.lit(now) - F.col("success_ts"), F.lit(0)))
    is_fresh = F.col("success_ts") >= now - fresh
    aggs = [
        F.count("*").alias("candidates"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "empty", "failure", "unobserved")],
        F.min("age_ms").alias("age_ms_min"), F.max("age_ms").alias("age_ms_max"), F.count_if(is_fresh).alias("fresh_success_addresses"),
        (F.count_if(is_fresh) / F.count("*")).alias("fresh_success_rate"), F.count_if(~F.coalesce(is_fresh, F.lit(True))).alias("stale_candidates")]
    ages = {x: F.col(x) for x in ("age_ms", "success_age_ms")}
    return with_quantiles(c, group, aggs, ages, {f"{x}_p50": (x, 0.5) for x in ages})


def public_view(frame: DataFrame, identifiers: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """Drop identifiers and replace identifier lists by their sizes."""
    keep = [c for c in frame.columns if c not in (*identifiers, *lists)]
    return frame.select(*keep, *[F.size(c).alias(f"{c}_count") for c in lists])


def public_counts(rows: DataFrame, by: Sequence[str], aggs: Sequence[Column], identifiers: Sequence[str]) -> DataFrame:
    """``public_view`` of grouped rows without building the identifier lists: each identifier becomes the number of its
    distinct values. Values are made distinct before the group is brought together, so no group's list is in one task."""
    out = rows.groupBy(*by).agg(*aggs)
    for name in identifiers:
        n = rows.select(*by, name).where(F.col(name).isNotNull()).distinct().groupBy(*by).agg(F.count("*").alias(f"{name}_count"))
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]
        out = out.join(n.select(*[F.col(k).alias(f"_k_{k}") for k in by], f"{name}_count"), reduce(and_, same), "left").drop(*[f"_k_{k}" for k in by])
        out = out.withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
    return out


def candidate_set(sightings: DataFrame, *, now: int, ttl: int, limit: int) -> DataFrame:
    """Users seen within ``ttl``, the most recently seen ``limit`` of them, with first and last sighting and coins."""
    g = sightings.groupBy("user").agg(F.min("ts").alias("first_seen_ts"), F.max("ts").alias("last_seen_ts"), F.array_sort(F.collect_set("coin")).alias("coins"))
    return g.where(F.col("last_seen_ts") >= now - ttl).orderBy(F.col("last_seen_ts").desc(), "user").limit(limit)
