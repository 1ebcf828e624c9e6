"""Bar building, coverage and series summaries. Every group-by combines map-side before it shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..session import DAY, HOUR
from .ordered import with_quantiles
from .scan import previous, running


def bucket(ts: str | Column, step: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (F.floor(ts / step) * step).cast("bigint")


def daily_last(bars: DataFrame, keys: Sequence[str], *, step: int, value: str = "close", complete_only: bool = True) -> DataFrame:
    """Last bar per UTC day; with ``complete_only`` a day counts only if it reaches its final bar."""
    out = bars.groupBy(*keys, F.floor(F.col("ts") / DAY).alias("day")).agg(
        F.max("ts").alias("last_ts"), F.max_by(value, "ts").alias(value))
    return out.where(F.col("last_ts") % DAY == DAY - step) if complete_only else out


def daily_first(bars: DataFrame, keys: Sequence[str], *, value: str = "open") -> DataFrame:
    return bars.groupBy(*keys, F.floor(F.col("ts") / DAY).alias("day")).agg(
        F.min("ts").alias("first_ts"), F.min_by(value, "ts").alias("price"))


def eod_snapshot(series: DataFrame, keys: Sequence[str], value: str, tie: str | None = None) -> DataFrame:
    """Last observation per day with its real timestamp."""
    order = F.struct("ts", tie) if tie else F.col("ts")
    return series.groupBy(*keys, F.floor(F.col("ts") / DAY).alias("day")).agg(
        F.max("ts").alias("ts"), F.max_by(value, order).alias(value))


def valid_flow() -> Column:
    q, b = F.col("quote_volume"), F.col("taker_buy_quote")
    return finite(q) & finite(b) & (q >= 0) & (b >= 0) & (b <= q)


def bucket_completeness(bars: DataFrame, keys: Sequence[str], *, step: int, n: int) -> DataFrame:
    """Counts that decide whether a bucket of ``n`` bars is whole, per (key, bucket)."""
    size, ok = step * n, valid_flow()
    start = F.col("bucket_ts")
    g = bars.groupBy(*keys, bucket("ts", size).alias("bucket_ts")).agg(
        F.count("*").alias("bar_count"), F.count_distinct("ts").alias("unique_count"),
        F.count_if(F.col("ts") % step == 0).alias("aligned_count"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
        F.count_if(ok).alias("valid_count"), F.sum(F.when(ok, F.col("quote_volume"))).alias("quote_volume"),
        F.sum(F.when(ok, F.col("taker_buy_quote"))).alias("taker_buy_quote"), F.max_by("close", "ts").alias("close"))
    whole = ((F.col("bar_count") == n) & (F.col("unique_count") == n) & (F.col("aligned_count") == n)
             & (F.col("min_ts") == start) & (F.col("max_ts") == start + (n - 1) * step))
    return g.withColumn("whole", whole)


def resample_complete(bars: DataFrame, keys: Sequence[str], *, step: int, n: int) -> DataFrame:
    """Larger bars only where exactly ``n`` unique aligned bars exist; volumes NULL unless every flow is
    valid. ``ts`` is the decision time, the end of the bucket."""
    g = bucket_completeness(bars, keys, step=step, n=n).where("whole")
    known = F.col("valid_count") == n
    return g.select(*keys, (F.col("bucket_ts") + step * n).alias("ts"), "bar_count", "close",
                    F.when(known, F.col("quote_volume")).alias("quote_volume"),
                    F.when(known, F.col("taker_buy_quote")).alias("taker_buy_quote"))


def resample_ohlc(bars: DataFrame, keys: Sequence[str], *, step: int, n: int) -> DataFrame:
    """Complete n-bar OHLC bars."""
    size = step * n
    g = bars.groupBy(*keys, bucket("ts", size).alias("bucket_ts")).agg(
        F.count("*").alias("_n"), F.min("ts").alias("_first"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "ts").alias("close"))
    return (g.where((F.col("_n") == n) & (F.col("_first") == F.col("bucket_ts")))
            .select(*keys, F.col("bucket_ts").alias("ts"), (F.col("bucket_ts") + size).alias("end_ts"), "open", "high", "low", "close"))


def funding_bucket(funding: DataFrame, keys: Sequence[str], *, width: int = 8 * HOUR, rate: str = "rate") -> DataFrame:
    return funding.groupBy(*keys, bucket("ts", width).alias("bucket")).agg(F.sum(rate).alias("rate"), F.count("*").alias("n_rows"))


def funding_cash_per_day(funding: DataFrame, daily_price: DataFrame, keys: Sequence[str], *, price: str = "price") -> DataFrame:
    """Price times rate summed per day and unit. A day without a price takes the previous funding day's
    price, the first days the next one. Rates are summed per day first: all of a day share its price."""
    keys = list(keys)
    per_day = funding.groupBy(*keys, F.floor(F.col("ts") / DAY).alias("day")).agg(F.sum("rate").alias("rate"))
    px = per_day.join(daily_price.select(*keys, "day", price), [*keys, "day"], "left")
    w = Window.partitionBy(*keys).orderBy("day")  # one row per calendar day
    back = F.last(price, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(price, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return px.select(*keys, "day", (F.coalesce(back, ahead) * F.col("rate")).alias("funding_per_unit"))


def coverage(series: DataFrame, keys: Sequence[str], *, interval: int, tolerance: int = 0, width: int) -> DataFrame:
    """Span, rows, unexpected gaps and the start of the last contiguous tail per series."""
    stamps = series.groupBy(*keys, "ts").agg(F.count("*").alias("_rows"))
    seq = previous(stamps, keys, ["ts"], width, ["ts"])
    gap = F.col("ts") - F.col("prev_ts") > interval + tolerance
    return seq.groupBy(*keys).agg(
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.sum("_rows").alias("count"),
        (F.max("ts") + interval).alias("coverage_end_exclusive_ts"), F.count_if(gap).alias("unexpected_gap_count"),
        F.coalesce(F.max(F.when(gap, F.col("ts"))), F.min("ts")).alias("tail_contiguous_start_ts"))


def common_end(series: DataFrame, required: DataFrame, *, name: str = "symbol") -> DataFrame:
    """Latest time every required series has reached; NULL, with the missing names, when one has no rows."""
    last = series.groupBy(name).agg(F.max("ts").alias("_last"))
    return (required.select(name).distinct().join(last, name, "left")
            .agg(F.min("_last").alias("_end"), F.array_sort(F.collect_list(F.when(F.col("_last").isNull(), F.col(name)))).alias("missing"))
            .select(F.when(F.size("missing") == 0, F.col("_end")).alias("common_end"), "missing"))


def candle_summary(bars: DataFrame, keys: Sequence[str], horizons: dict[str, int], *, width: int) -> DataFrame:
    """Return, high, low and volume over the last n bars for several n, one row per (series, horizon)."""
    numbered = running(bars, keys, ["ts"], width, {"_back": ("count", F.lit(1))}, reverse=True)
    aggs = [F.count("*").alias("bars"), F.max_by("close", "ts").alias("latest_close")]
    for label, n in horizons.items():
        on = F.col("_back") <= n
        pick = lambda c: F.when(on, c)  # noqa: E731,B023
        aggs += [F.min_by("open", pick(F.col("ts"))).alias(f"o_{label}"), F.max(pick(F.col("high"))).alias(f"h_{label}"),
                 F.min(pick(F.col("low"))).alias(f"l_{label}"), F.sum(pick(F.col("volume"))).alias(f"v_{label}"),
                 F.sum(pick(F.col("volume") * F.col("close"))).alias(f"u_{label}")]
    g = numbered.groupBy(*keys).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("horizon"), ((F.col("latest_close") / F.col(f"o_{x}") - 1) * 100).alias("return_pct"),
                                        F.col(f"h_{x}").alias("high"), F.col(f"l_{x}").alias("low"), F.col(f"v_{x}").alias("volume_base"),
                                        F.col(f"u_{x}").alias("volume_usd_approx")) for x in horizons]))
    return g.select(*keys, "bars", "latest_close", rows.alias("r")).select(*keys, "bars", "latest_close", "r.*")


def funding_summary(rates: DataFrame, keys: Sequence[str], horizons: dict[str, int], now: int | Column) -> DataFrame:
    """Mean, median, annualised mean and sign shares of the rates since now - horizon."""
    spans = F.array(*[F.struct(F.lit(x).alias("horizon"), F.lit(h).alias("span")) for x, h in horizons.items()])
    r = rates.withColumn("_h", F.explode(spans)).where(F.col("ts") >= F.lit(now) - F.col("_h.span"))
    aggs = [
        F.count("*").alias("observations"), F.avg("rate").alias("mean_hourly"),
        (F.avg("rate") * 24 * 365 * 100).alias("annualized_mean_pct"), F.avg((F.col("rate") > 0).cast("int")).alias("positive_share"),
        F.avg((F.col("rate") < 0).cast("int")).alias("negative_share"), F.min("rate").alias("min"), F.max("rate").alias("max")]
    return with_quantiles(r.withColumn("horizon", F.col("_h.horizon")), [*keys, "horizon"], aggs, {"rate": F.col("rate")}, {"median_hourly": ("rate", 0.5)})


def trade_summary(ticks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Buy, sell and net taker notional per series."""
    usd = F.col("px") * F.col("sz")
    buy, sell = F.sum(F.when(F.col("side") == "B", usd).otherwise(0.0)), F.sum(F.when(F.col("side") == "A", usd).otherwise(0.0))
    return ticks.groupBy(*keys).agg(F.count("*").alias("trades"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                                    buy.alias("buy_usd"), sell.alias("sell_usd"), (buy - sell).alias("net_taker_usd"),
                                    F.try_divide(buy, buy + sell).alias("buy_share"))


def largest_trades(ticks: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The n largest trades per series. The row_number limit is applied per task before the shuffle."""
    ranked = ticks.withColumn("usd", F.col("px") * F.col("sz"))
    w = Window.partitionBy(*keys).orderBy(F.col("usd").desc(), "ts", "event_id")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def funding_phases(rates: DataFrame, keys: Sequence[str], *, launch: int, boundary: int, baseline: float) -> DataFrame:
    """Funding statistics per phase: all, launch, post_launch, before_boundary, after_boundary."""
    keys = list(keys)
    first = rates.groupBy(*keys).agg(F.min("ts").alias("first_ts"))
    late, after = F.col("ts") >= F.col("first_ts") + launch, F.col("ts") >= boundary
    phase = F.explode(F.array(F.lit("all"), F.when(late, "post_launch").otherwise("launch"),
                              F.when(after, "after_boundary").otherwise("before_boundary")))
    r = rates.join(first, keys).withColumn("phase", phase)
    k = [*keys, "phase"]
    base = r.groupBy(*k).agg(
        F.count("*").alias("hours"), F.min("ts").alias("first"), (F.avg("rate") * 24 * 365).alias("annualised_mean"),
        F.avg((F.col("rate") > 0).cast("int")).alias("share_hours_positive"),
        F.when(F.sum("rate") > 0, F.sum(F.when(F.col("rate") > baseline, F.col("rate"))) / F.sum("rate")).alias("share_above_baseline"))

    daily = r.groupBy(*k, F.floor(F.col("ts") / DAY).alias("_p")).agg(F.sum("rate").alias("_s"))
    weekly = r.groupBy(*k, F.floor((F.col("ts") - F.col("first_ts")) / (7 * DAY)).alias("_p")).agg(F.sum("rate").alias("_s"))
    # One row per week: bounded by the calendar.
    spread = [*[F.percentile(F.col("_s") * 10_000, F.lit(q)).alias(f"weekly_sum_bp_p{int(q * 100)}") for q in (0.1, 0.5, 0.9)],
              F.avg((F.col("_s") < 0).cast("int")).alias("share_weeks_negative")]
    return (base.join(_autocorr(daily, k, "daily_autocorr_lag1"), k)
            .join(_autocorr(weekly, k, "weekly_autocorr_lag1", *spread), k))


def _autocorr(sums: DataFrame, k: list[str], name: str, *more: Column) -> DataFrame:
    """Lag-1 autocorrelation of period sums (one row per day or week)."""
    lagged = sums.withColumn("_l", F.lag("_s").over(Window.partitionBy(*k).orderBy("_p")))
    corr = F.corr(F.when(F.col("_l").isNotNull(), F.col("_s")), F.col("_l"))
    return lagged.groupBy(*k).agg(F.when(F.count("*") > 3, corr).alias(name), *more)


def spread_stats(a: DataFrame, b: DataFrame, on: Sequence[str], *, per_year: float) -> DataFrame:
    """Quantiles, sign agreement and annualised mean of a - b on equal buckets."""
    j = a.select(*on, F.col("rate").alias("_a")).join(b.select(*on, F.col("rate").alias("_b")), list(on)).withColumn("s", F.col("_a") - F.col("_b"))
    aggs = [F.count("*").alias("n_buckets"), F.avg("s").alias("mean"), F.avg((F.signum("_a") == F.signum("_b")).cast("int")).alias("sign_agreement_rate"),
            (F.avg("s") * per_year * 100).alias("annualized_mean_spread_pct")]
    return with_quantiles(j, [], aggs, {"s": F.col("s")}, {f"p{int(q * 100)}": ("s", q) for q in (0.25, 0.5, 0.75, 0.9)})


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric tables of two runs side by side with differences and percent changes."""
    l = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in metrics])
    r = b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics])
    cols = [c for m in metrics for c in (F.col(f"{m}_a"), F.col(f"{m}_b"), (F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_diff"),
                                         (F.try_divide(F.col(f"{m}_b"), F.col(f"{m}_a")) * 100 - 100).alias(f"{m}_pct"))]
    return l.join(r, list(keys), "full").select(*keys, *cols)


def rule_by_year(df: DataFrame, *, signal: str, date: str, pnl: str, hold: str) -> DataFrame:
    """Yearly sums of a rule and of holding throughout, over rows where both are known."""
    known = df.where(F.col(pnl).isNotNull() & F.col(hold).isNotNull())
    return known.groupBy(signal, F.year(date).alias("yr")).agg(F.count("*").alias("weeks"), F.sum(pnl).alias("rule_sum"),
                                                                F.sum(hold).alias("long_only_sum"))
