"""Daily-equity operators: options, master versions, cross-sectional features, earnings and risk cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import liquidation_room
from .ordered import quantiles
from .windows import adjusted_log_price, daily_moves


def margin_ratio(balances: DataFrame, closes: DataFrame, *, date: str = "date", code: str = "code") -> DataFrame:
    """ln(long value / short value) per date at that date's close, and how much of it could be priced."""
    j = balances.join(closes.select(code, date, "close"), [code, date], "left")
    ok = F.col("close") > 0
    value = lambda c: F.sum(F.when(ok, F.col(c) * F.col("close")))
    g = j.groupBy(date).agg(value("long_shares").alias("long_value"), value("short_shares").alias("short_value"), F.count("*").alias("codes"), F.count("close").alias("codes_priced"),
                            F.try_divide(F.sum(F.when(F.col("close").isNull(), F.col("long_shares"))), F.sum("long_shares")).alias("unpriced_share"))
    return g.withColumn("value", F.ln(F.try_divide("long_value", "short_value"))).withColumn("unpriced_share", F.coalesce("unpriced_share", F.lit(0.0)))


def ratio_of_sums(df: DataFrame, keys: Sequence[str], numerator: Column, denominator: Column, *, where: Column | None = None, parts: str | None = None) -> DataFrame:
    """sum / sum per key over the wanted rows (short ratio, flow balance)."""
    d = df.where(where) if where is not None else df
    aggs = [F.try_divide(F.sum(numerator), F.sum(denominator)).alias("ratio")]
    if parts:
        aggs.append(F.count_distinct(parts).alias("parts"))
    return d.groupBy(*keys).agg(*aggs)


def atm_by_expiry(options: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strike nearest the underlying whose put and call both have a positive settlement and volatility; the
    lower strike on ties. Groups whose rows disagree on the underlying are dropped."""
    keys = list(keys)
    leg = lambda pc, c: F.max(F.when(F.col("put_call") == pc, F.col(c)))
    s = options.where(F.col("strike").isNotNull() & F.col("put_call").isin("P", "C")).groupBy(*keys, "strike").agg(
        F.min("underlying").alias("_lo"), F.max("underlying").alias("_hi"), F.count("underlying").alias("_u"), F.count("*").alias("_n"),
        *[leg(p, c).alias(f"{n}_{c}") for p, n in (("P", "put"), ("C", "call")) for c in ("settle", "iv")])
    usable = F.coalesce(F.least("put_settle", "put_iv", "call_settle", "call_iv") > 0, F.lit(False)) & F.col("put_iv").isNotNull() & F.col("call_iv").isNotNull() \
        & F.col("put_settle").isNotNull() & F.col("call_settle").isNotNull()
    dist = F.struct(F.abs(F.col("strike") - F.col("_lo")).alias("d"), F.col("strike").alias("k"))
    best = F.min_by(F.struct("strike", "put_iv", "call_iv"), F.when(usable, dist))
    g = s.groupBy(*keys).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_u").alias("_u"), F.sum("_n").alias("_n"), best.alias("b"))
    fine = (F.col("_lo") == F.col("_hi")) & (F.col("_u") == F.col("_n")) & (F.col("_lo") > 0) & F.col("b").isNotNull()
    return g.where(fine).select(*keys, F.col("_lo").alias("underlying"), F.col("b.strike").alias("strike"), ((F.col("b.put_iv") + F.col("b.call_iv")) / 2).alias("atm_iv"))


def constant_maturity(atm: DataFrame, keys: Sequence[str], *, days: str, iv: str, target: float, min_days: float) -> DataFrame:
    """Volatility at a fixed maturity: total variance linear between the two nearest expiries with enough days."""
    w = Window.partitionBy(*keys).orderBy(days)  # a handful of expiries per day
    d = atm.where((F.col(days) >= min_days) & (F.col(iv) > 0)).withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    at = lambda c, r: F.max(F.when(F.col("_r") == r, F.col(c)))
    g = d.groupBy(*keys).agg(at(days, 1).alias("near_days"), at(days, 2).alias("far_days"), at(iv, 1).alias("_i1"), at(iv, 2).alias("_i2"))
    t1, t2 = F.col("near_days"), F.col("far_days")
    wgt = (target - t1) / (t2 - t1)
    total = (1 - wgt) * F.col("_i1") * F.col("_i1") * t1 + wgt * F.col("_i2") * F.col("_i2") * t2
    method = F.when(t2.isNull(), "single").when((t1 <= target) & (target <= t2), "interpolated").otherwise("extrapolated")
    return g.select(*keys, F.when(t2.isNull(), F.col("_i1")).when(total > 0, F.sqrt(total / target)).alias("iv"), method.alias("method"), "near_days", F.coalesce(t2, t1).alias("far_days"))


def scd2_compress(snapshots: DataFrame, key: str, attrs: Sequence[str], *, date: str = "date") -> DataFrame:
    """Daily snapshots to validity intervals: a new interval on any change or absence.

    Islands by difference of row numbers over the distinct snapshot dates; a key has one row per date.
    """
    days = snapshots.select(date).distinct().withColumn("_d", F.row_number().over(Window.orderBy(date)))  # calendar
    s = snapshots.join(days, date)
    g = F.col("_d") - F.row_number().over(Window.partitionBy(key, *attrs).orderBy("_d"))
    return s.withColumn("_g", g).groupBy(key, *attrs, "_g").agg(F.min(date).alias("valid_from"), F.max(date).alias("valid_to"), F.count("*").alias("snapshots")).drop("_g")


def scd2_expand(history: DataFrame, dates: DataFrame, key: str, attrs: Sequence[str], *, date: str = "date") -> DataFrame:
    """Inverse of ``scd2_compress``: intervals are cut into indexes of the snapshot calendar, an equi join."""
    days = dates.select(date).distinct().withColumn("_d", F.row_number().over(Window.orderBy(date)))
    lo = days.select(F.col(date).alias("valid_from"), F.col("_d").alias("_a"))
    hi = days.select(F.col(date).alias("valid_to"), F.col("_d").alias("_z"))
    h = history.join(lo, "valid_from").join(hi, "valid_to").withColumn("_d", F.explode(F.sequence("_a", "_z")))
    return h.join(days, "_d").select(date, key, *attrs)


def cross_section_features(bars: DataFrame, keys: Sequence[str], *, reversal: int, momentum: int, window: int) -> DataFrame:
    """Size, liquidity, reversal, momentum and volatility as known at each close. Rows are trading days."""
    keys = list(keys)
    p = adjusted_log_price(bars, keys, width=None)
    w = Window.partitionBy(*keys).orderBy("ts")
    last = w.rowsBetween(-(window - 1), 0)
    d = p.withColumn("_r", F.col("log_price") - F.lag("log_price").over(w))
    return d.withColumns({
        "turnover_med": F.percentile("turnover", F.lit(0.5)).over(last), "reversal": F.col("log_price") - F.lag("log_price", reversal).over(w),
        "momentum": F.lag("log_price", reversal).over(w) - F.lag("log_price", momentum).over(w), "vol": F.stddev_pop("_r").over(last)}).drop("_r")


def choose_leverage(worst: Column, leverages: Sequence[int], *, buffer: float, max_leverage: float) -> Column:
    """Largest leverage whose liquidation room covers ``buffer`` times the worst move, NULL when none does."""
    fits = [F.when(liquidation_room(float(x), max_leverage) >= buffer * worst, F.lit(x)) for x in leverages]
    return F.greatest(*fits)


def reaction_moves(moves: DataFrame, reactions: DataFrame, code: str, *, leverages: Sequence[int], buffer: float, max_leverage: float) -> DataFrame:
    """Event-day against other-day moves per code, and the leverage its worst rise allows."""
    r = reactions.select(code, F.col("reaction").alias("date")).distinct().withColumn("_e", F.lit(True))
    j = moves.where("ret_close IS NOT NULL").join(r, [code, "date"], "left").withColumn("_e", F.coalesce("_e", F.lit(False)))
    on, size = F.col("_e"), F.abs("ret_close")
    aggs = [
        F.count("*").alias("days"), F.count_if(on).alias("event_days"), F.avg(F.when(on, size)).alias("event_mean_abs"), F.avg(F.when(~on, size)).alias("other_mean_abs"),
        F.max(F.when(on, F.col("rise_high"))).alias("event_max_rise"),
        F.min(F.when(on, F.col("fall_low"))).alias("event_min_fall"), F.max_by("date", F.when(on, F.struct(F.col("rise_high"), -F.unix_date("date")))).alias("event_worst_date"),
        F.max("rise_high").alias("max_rise"), F.percentile(F.when(on, F.col("rise_high")), F.lit(0.99)).alias("event_p99_rise")]
    g = j.groupBy(code).agg(*aggs)  # one row per code and trading day: a group is bounded by the calendar
    return g.withColumn("leverage", choose_leverage(F.col("max_rise"), leverages, buffer=buffer, max_leverage=max_leverage))


def risk_card(bars: DataFrame, market: DataFrame, reactions: DataFrame, code: str, *, last: int, min_days: int, per_year: float = 245.0) -> DataFrame:
    """One row per code: worst moves, tails, overnight and intraday legs, event days, beta over the last n days."""
    m = daily_moves(bars, [code], width=None).where("ret_close IS NOT NULL")
    r = reactions.select(code, F.col("reaction").alias("date")).distinct().withColumn("_e", F.lit(True))
    back = Window.partitionBy(code).orderBy(F.col("ts").desc())
    j = (m.join(r, [code, "date"], "left").join(market.select("date", F.col("ret").alias("_m")), "date", "left")
         .withColumn("_k", F.when(F.col("_m").isNotNull(), F.sum(F.when(F.col("_m").isNotNull(), 1)).over(back.rowsBetween(Window.unboundedPreceding, 0))))
         .withColumn("_t", F.row_number().over(back)))
    on, size, recent = F.coalesce("_e", F.lit(False)), F.abs("ret_close"), F.col("_k") <= last
    x, y = F.when(recent, F.col("_m")), F.when(recent, F.log1p("ret_close"))
    ann = lambda c: (F.avg(c) * per_year, F.stddev_samp(c) * F.sqrt(F.lit(per_year)))
    (om, ov), (im, iv) = ann("overnight"), ann("intraday")
    aggs = [
        F.count("*").alias("days"), F.max("rise_high").alias("worst_rise"),
        (-F.min("fall_low")).alias("worst_fall"), F.avg(size).alias("mean_abs_change"), om.alias("overnight_mean"), im.alias("intraday_mean"),
        ov.alias("overnight_vol"), iv.alias("intraday_vol"), F.count_if(on).alias("event_days"), F.avg(F.when(on, size)).alias("event_mean_abs"), F.avg(F.when(~on, size)).alias("other_mean_abs"),
        F.avg((F.col("close") == F.col("high")).cast("int")).alias("limit_up_share"), F.avg((F.col("close") == F.col("low")).cast("int")).alias("limit_down_share"),
        F.when(F.count(x) >= min_days, F.try_divide(F.covar_samp(y, x), F.var_samp(x))).alias("beta")]
    tails = {"median_turnover": (F.when(F.col("_t") <= last, F.col("turnover")), 0.5), "p99_abs_change": (size, 0.99)}
    g = j.groupBy(code).agg(*aggs, *[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in tails.items()])  # bounded by the calendar
    return g.where(F.col("days") >= min_days)


def top_universe(bars: DataFrame, code: str, *, days: int, n: int, value: str = "turnover") -> DataFrame:
    """The n codes with the largest median turnover over the last ``days`` trading days of the market."""
    recent = bars.select("date").distinct().orderBy(F.col("date").desc()).limit(days)
    m = quantiles(bars.join(recent, "date", "left_semi"), [code], {"v": F.col(value)}, {"median_turnover": ("v", 0.5)})
    return m.orderBy(F.col("median_turnover").desc(), code).limit(n)


def event_study(panel: DataFrame, keys: Sequence[str], *, ret: str, event: str, low: str | None = None, cost: float = 0.0) -> DataFrame:
    """Declustered event days against all days: means, difference, hit rate, low excursion."""
    on = F.col(event)
    aggs = [F.count_if(on).alias("events"), F.count("*").alias("days"), F.avg(F.when(on, F.col(ret))).alias("mean_event"), F.avg(ret).alias("mean_all"),
            (F.avg(F.when(on, F.col(ret))) - F.avg(ret)).alias("diff"), F.avg(F.when(on, (F.col(ret) > 0).cast("int"))).alias("hit_rate"),
            (F.avg(F.when(on, F.col(ret))) - 2 * cost).alias("mean_event_after_cost")]
    if low:
        aggs += [F.avg(F.when(on, F.col(low))).alias("mean_event_low"), F.avg(low).alias("mean_all_low")]
    return panel.where(F.col(ret).isNotNull()).groupBy(*keys).agg(*aggs)
