"""Carry ledgers: daily panels, forward ledgers, NAV, margin checks. One row per series and day throughout,
so plain windows per series are calendar-bounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import liquidation_room
from ..session import DAY, HOUR
from .asof import window_total
from .events import with_grid
from .joins import exact_lookup, interval_join
from .windows import hysteresis, transition_cost


def carry_daily(days: DataFrame, exact: DataFrame, hourly: DataFrame, funding: DataFrame, keys: Sequence[str], *, max_basis: float, width: int,
                quanto_fx: str | None = None) -> DataFrame:
    """Hold from close to close: minus the basis change plus funding over (previous close, close].

    ``days``: keys, ts (close time), fair. The price is the exact bar's open at the close, else the hourly close
    ending then. A day is valid only if both basis values are on scale and every funding hour was seen.
    """
    keys = list(keys)
    d = exact_lookup(days, exact, by=keys, at=F.col("ts"), take={"open": "_exact"})
    d = exact_lookup(d, hourly, by=keys, at=F.col("ts") - HOUR, take={"close": "_proxy"})
    w = Window.partitionBy(*keys).orderBy("ts")
    d = (d.withColumn("perp", F.coalesce("_exact", "_proxy"))
         .withColumn("perp_source", F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_proxy").isNotNull(), "hourly_close").otherwise("missing"))
         .withColumn("basis", F.ln(F.try_divide("perp", "fair"))).withColumn("scale_mismatch", F.abs("basis") > max_basis)
         .withColumn("prev_ts", F.coalesce(F.lag("ts").over(w), F.col("ts") - DAY)))
    d = window_total(d, funding, by=keys, start="prev_ts", stop="ts", value="rate", width=width).withColumnsRenamed({"total": "funding_short", "n": "funding_hours"})
    d = d.withColumn("expected_hours", ((F.col("ts") - F.col("prev_ts")) / HOUR).cast("bigint")).withColumn("basis_pnl", -(F.col("basis") - F.lag("basis").over(w)))
    bad = F.coalesce("scale_mismatch", F.lit(True))
    ok = ~bad & ~F.coalesce(F.lag(bad).over(w), F.lit(True)) & (F.col("funding_hours") == F.col("expected_hours")) & F.col("basis_pnl").isNotNull()
    dn = F.col("basis_pnl") + F.col("funding_short")
    if quanto_fx:
        dn = dn - F.ln(F.col(quanto_fx) / F.lag(quanto_fx).over(w))
    return d.withColumn("valid", ok).withColumn("dn", dn).drop("_exact", "_proxy")


def forward_ledger(panel: DataFrame, bars: DataFrame, keys: Sequence[str], *, leverage: float, max_leverage: float, round_trip: float, cost_days: Column) -> DataFrame:
    """Highest high between closes against the liquidation room; P&L, costs and return on capital. Costs stand
    even on a day whose P&L is unknown."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("ts")
    p = panel.withColumn("perp_prev", F.lag("perp").over(w)).withColumn("spot_ret", F.ln(F.col("fair") / F.lag("fair").over(w)))
    j = interval_join(p, bars.select(*keys, "ts", "high"), by=keys, start="prev_ts", stop="ts", how="outer")
    d = j.groupBy(*p.columns).agg((F.try_divide(F.max("bar_high"), F.col("perp_prev")) - 1).alias("rise"))
    room = liquidation_room(float(leverage), max_leverage)
    dead = F.coalesce(F.col("rise") >= room, F.lit(False))
    pnl = F.when(dead, F.col("spot_ret") - 1 / leverage).when(F.col("valid"), F.col("dn"))
    cost = round_trip * (dead.cast("int") + cost_days.cast("int"))
    capital = 1 + 1 / leverage
    return (d.withColumn("liquidated", dead).withColumn("pnl_notional", pnl).withColumn("cost_notional", cost)
            .withColumn("roc", pnl / capital).withColumn("roc_net", (pnl - cost) / capital).withColumn("measured", pnl.isNotNull()))


def carry_pnl(pair: DataFrame, keys: Sequence[str], *, notional: float, cost_bp: float, enter: float | None = None, leave: float | None = None) -> DataFrame:
    """Daily P&L of long spot, short perp: q (dS - dF) + funding - costs, and the running NAV.

    ``pair``: keys, ts, S, F, funding_per_q. Always on without thresholds; otherwise held by hysteresis on the
    trailing seven-day funding, annualised on capital 1.5 x notional.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("ts")
    capital = 1.5 * notional
    d = pair.withColumn("dS", F.col("S") - F.lag("S").over(w)).withColumn("dF", F.col("F") - F.lag("F").over(w)).where("dS IS NOT NULL")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("q", F.try_divide(F.lit(notional), F.first("S").over(whole)))
    d = d.withColumn("basis_pnl", F.col("q") * (F.col("dS") - F.col("dF"))).withColumn("funding_pnl", F.col("q") * F.coalesce(F.col("funding_per_q"), F.lit(0.0)))
    unit = notional * cost_bp / 10_000
    if enter is None:
        d = d.withColumn("held", F.lit(1))
    else:
        seven = w.rowsBetween(-6, 0)
        ann = F.when(F.count("*").over(seven) == 7, F.sum("funding_pnl").over(seven) / capital * 365 / 7)
        d = hysteresis(d.withColumn("_ann", ann), keys, "_ann", enter, leave, width=None).drop("_ann")
    d = transition_cost(d, keys, "held", unit, width=None)
    on = F.col("held") == 1
    d = d.withColumn("basis_pnl", F.when(on, F.col("basis_pnl")).otherwise(0.0)).withColumn("funding_pnl", F.when(on, F.col("funding_pnl")).otherwise(0.0))
    net = F.col("basis_pnl") + F.col("funding_pnl") - F.col("cost")
    return d.withColumn("ret", net / capital).withColumn("nav", capital + F.sum(net).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def perf_metrics(pnl: DataFrame, keys: Sequence[str], *, capital: float) -> DataFrame:
    """Annual return, volatility, Sharpe ratio, drawdown on capital, positive and negative-funding shares, trades."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("ts")
    d = pnl.withColumn("_dd", (F.col("nav") - F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))) / capital) \
        .withColumn("_flip", F.abs(F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0))))
    sd = F.stddev_samp("ret")
    f = F.col("funding_pnl")
    return d.groupBy(*keys).agg(
        F.count("*").alias("n_days"), (F.avg("ret") * 365).alias("ann_return"), (sd * F.sqrt(F.lit(365.0))).alias("ann_vol"),
        F.when(sd > 0, F.avg("ret") * 365 / (sd * F.sqrt(F.lit(365.0)))).alias("sharpe"), F.min("_dd").alias("max_dd"), (F.avg((F.col("ret") > 0).cast("int")) * 100).alias("pct_pos_days"),
        F.sum("_flip").alias("n_transitions"), (F.sum("cost") / capital * 10_000).alias("total_cost_bp"), F.sum(F.when(f > 0, f).otherwise(0.0)).alias("fund_received"),
        F.sum(F.when(f < 0, f).otherwise(0.0)).alias("fund_paid"), (F.avg((f < 0).cast("int")) * 100).alias("pct_neg_funding_days"))


def yearly_performance(pnl: DataFrame, keys: Sequence[str], year: Column) -> DataFrame:
    sd = F.stddev_samp("ret")
    return pnl.groupBy(*keys, year.alias("yr")).agg(F.count("*").alias("n_days"), (F.avg("ret") * 365).alias("ann_return"),
                                                    F.when(sd > 0, F.avg("ret") * 365 / (sd * F.sqrt(F.lit(365.0)))).alias("sharpe")).where("n_days >= 2")


def margin_breaches(pair: DataFrame, keys: Sequence[str], *, notional: float, initial: float = 0.5, floor: float = 0.25) -> DataFrame:
    """Short-perp margin marked daily: days below the floor, the largest top-up, the worst day."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("ts")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = pair.withColumn("dF", F.col("F") - F.lag("F").over(w)).where("dF IS NOT NULL").withColumn("q", F.try_divide(F.lit(notional), F.first("S").over(whole)))
    d = d.withColumn("margin", initial * notional - F.sum(F.col("q") * F.col("dF")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    below = F.col("margin") < floor * notional
    return d.groupBy(*keys).agg(F.count_if(below).alias("days_below"), F.coalesce(F.max(F.when(below, floor * notional - F.col("margin"))), F.lit(0.0)).alias("max_additional_margin"),
                                F.min("margin").alias("worst_margin"), F.min_by("ts", F.struct("margin", "ts")).alias("worst_ts"))


def threshold_hits(losses: DataFrame, keys: Sequence[str], *, loss: str, notional: str, margins: Sequence[float], thresholds: Sequence[float]) -> DataFrame:
    """How many intervals reach each share of each margin level."""
    g = with_grid(losses, m_over_n=list(margins), threshold=list(thresholds))
    hit = F.col(loss) >= F.col("threshold") * F.col("m_over_n") * F.col(notional)
    return g.groupBy(*keys, "m_over_n", "threshold").agg(F.count_if(hit).alias("hit_count"), F.count("*").alias("total_intervals"))


def proxy_calibration(exact: DataFrame, proxy: DataFrame, keys: Sequence[str], *, value: str = "roc", basis: str = "basis") -> DataFrame:
    """Error of a proxy ledger against the exact one, the basis' AR(1) coefficient over adjacent days and its half-life."""
    keys = list(keys)
    e = exact.where("valid").select(*keys, "ts", F.col(value).alias("_e"), F.col(basis).alias("_b"))
    p = proxy.where("valid").select(*keys, "ts", F.col(value).alias("_p"))
    w = Window.partitionBy(*keys).orderBy("ts")
    j = e.join(p, [*keys, "ts"]).withColumn("_lag", F.when(F.lag("ts").over(w) == F.col("ts") - DAY, F.lag("_b").over(w)))
    err = F.col("_e") - F.col("_p")
    rho = F.when(F.count("_lag") > 3, F.corr(F.when(F.col("_lag").isNotNull(), F.col("_b")), F.col("_lag")))
    g = j.groupBy(*keys).agg(F.count("*").alias("days"), F.stddev_samp(err).alias("error_sd"), F.sum(err).alias("cumulative_error"), F.avg("_b").alias("basis_mean"),
                             F.stddev_samp("_b").alias("basis_sd"), rho.alias("rho"))
    return g.withColumn("half_life_days", F.when((F.col("rho") > 0) & (F.col("rho") < 1), F.ln(F.lit(0.5)) / F.ln("rho")))
