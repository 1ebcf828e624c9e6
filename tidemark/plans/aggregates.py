"""Aggregation queries over bars, rates and ledgers' inputs."""

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators.scan import previous
from ..session import DAY, HOUR
from .registry import query

NOW = 1_706_659_200_000  # 2024-01-31T00:00Z, the end of the event stream
BOUNDARY = 1_705_276_800_000  # 2024-01-15


@query("A1_daily_last", use="bars", dbl="close", sql=f"""SELECT symbol, ts // {DAY} AS day, max(ts) AS last_ts, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2 HAVING max(ts) % {DAY} = {DAY - HOUR}""")
def _(t):
    return B.daily_last(t.bars, ["symbol"], step=HOUR)


@query("A2_daily_first", use="bars", dbl="price", sql=f"SELECT symbol, ts // {DAY} AS day, min(ts) AS first_ts, arg_min(open, ts) AS price FROM bars GROUP BY 1, 2")
def _(t):
    return B.daily_first(t.bars, ["symbol"])


@query("A3_resample_complete", use="bars", dbl="close quote_volume taker_buy_quote", digits=4, sql=f"""
SELECT symbol, (ts // {6 * HOUR}) * {6 * HOUR} + {6 * HOUR} AS ts, count(*) AS bar_count, arg_max(close, ts) AS close, sum(quote_volume) AS quote_volume, sum(taker_buy_quote) AS taker_buy_quote
FROM bars GROUP BY symbol, (ts // {6 * HOUR}) HAVING count(*) = 6 AND count(DISTINCT ts) = 6""")
def _(t):
    return B.resample_complete(t.bars, ["symbol"], step=HOUR, n=6)


@query("A4_resample_ohlc", use="bars", dbl="open high low close", sql=f"""
SELECT symbol, (ts // {4 * HOUR}) * {4 * HOUR} AS ts, (ts // {4 * HOUR}) * {4 * HOUR} + {4 * HOUR} AS end_ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close
FROM bars GROUP BY symbol, ts // {4 * HOUR} HAVING count(*) = 4""")
def _(t):
    return B.resample_ohlc(t.bars, ["symbol"], step=HOUR, n=4)


@query("A5_funding_bucket", use="funding", dbl="rate", sql=f"SELECT user_id, (ts // {8 * HOUR}) * {8 * HOUR} AS bucket, sum(rate) AS rate, count(*) AS n_rows FROM funding GROUP BY 1, 2")
def _(t):
    return B.funding_bucket(t.funding, ["user_id"])


@query("A6_funding_cash_per_day", use="ticks bars", dbl="funding_per_unit", sql=f"""
WITH f AS (SELECT symbol, ts // {DAY} AS day, sum((px - 20) / 10000) AS rate FROM ticks GROUP BY 1, 2),
p AS (SELECT symbol, ts // {DAY} AS day, arg_min(open, ts) AS price FROM bars WHERE (ts // {DAY}) % 5 <> 0 GROUP BY 1, 2),
j AS (SELECT f.*, price FROM f LEFT JOIN p USING (symbol, day))
SELECT symbol, day, rate * coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING),
  first_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS funding_per_unit FROM j""")
def _(t):
    rates = t.ticks.select("symbol", "ts", ((F.col("px") - 20) / 10_000).alias("rate"))
    px = B.daily_first(t.bars, ["symbol"]).where(F.col("day") % 5 != 0)
    return B.funding_cash_per_day(rates, px, ["symbol"])


@query("A7_eod_snapshot", use="ticks", dbl="px", sql=f"SELECT symbol, ts // {DAY} AS day, max(ts) AS ts, arg_max(px, (ts, event_id)) AS px FROM ticks t GROUP BY symbol, ts // {DAY}")
def _(t):
    return B.eod_snapshot(t.ticks, ["symbol"], "px", tie="event_id")


@query("A32_candle_summary", use="bars", dbl="latest_close return_pct high low volume_base volume_usd_approx", digits=4, sql="""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY symbol) AS bars,
  first_value(close) OVER (PARTITION BY symbol ORDER BY ts DESC) AS latest_close FROM bars), h(horizon, k) AS (VALUES ('4h', 4), ('24h', 24), ('7d', 168), ('30d', 720))
SELECT symbol, bars, latest_close, horizon, (latest_close / arg_min(open, ts) - 1) * 100 AS return_pct, max(high) AS high, min(low) AS low, sum(volume) AS volume_base,
  sum(volume * close) AS volume_usd_approx FROM n JOIN h ON back <= k GROUP BY 1, 2, 3, 4""")
def _(t):
    return B.candle_summary(t.bars, ["symbol"], {"4h": 4, "24h": 24, "7d": 168, "30d": 720}, width=7 * DAY)


@query("A32_funding_summary", use="bars", dbl="mean_hourly median_hourly annualized_mean_pct positive_share negative_share min max", sql=f"""
WITH h(horizon, span) AS (VALUES ('24h', {DAY}), ('7d', {7 * DAY}), ('30d', {30 * DAY})), r AS (SELECT symbol, ts, (close - 30) / 10000 AS rate FROM bars)
SELECT symbol, horizon, count(*) AS observations, avg(rate) AS mean_hourly, median(rate) AS median_hourly, avg(rate) * 24 * 365 * 100 AS annualized_mean_pct,
 avg((rate > 0)::INT) AS positive_share, avg((rate < 0)::INT) AS negative_share, min(rate) AS "min", max(rate) AS "max" FROM r JOIN h ON ts >= {NOW} - span GROUP BY 1, 2""")
def _(t):
    r = t.bars.select("symbol", "ts", ((F.col("close") - 30) / 10_000).alias("rate"))
    return B.funding_summary(r, ["symbol"], {"24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}, NOW)


@query("A32_trade_summary", use="ticks", dbl="buy_usd sell_usd net_taker_usd buy_share", digits=3, sql="""
SELECT symbol, count(*) AS trades, min(ts) AS first_ts, max(ts) AS last_ts, sum(px * sz) FILTER (side = 'B') AS buy_usd, sum(px * sz) FILTER (side = 'A') AS sell_usd,
 sum(px * sz) FILTER (side = 'B') - sum(px * sz) FILTER (side = 'A') AS net_taker_usd, sum(px * sz) FILTER (side = 'B') / sum(px * sz) AS buy_share FROM ticks GROUP BY 1""")
def _(t):
    return B.trade_summary(t.ticks, ["symbol"])


@query("A32_largest_trades", use="ticks", dbl="usd", sql="""
SELECT symbol, rank, event_id, usd FROM (SELECT *, px * sz AS usd, row_number() OVER (PARTITION BY symbol ORDER BY px * sz DESC, ts, event_id) AS rank FROM ticks) WHERE rank <= 10""")
def _(t):
    return B.largest_trades(t.ticks, ["symbol"]).select("symbol", "rank", "event_id", "usd")


@query("A35_funding_phases", use="bars", dbl="annualised_mean share_hours_positive share_above_baseline daily_autocorr_lag1 weekly_autocorr_lag1 weekly_sum_bp_p10 weekly_sum_bp_p50 weekly_sum_bp_p90 share_weeks_negative", sql=f"""
WITH r AS (SELECT symbol, ts, (close - 30) / 10000 AS rate, min(ts) OVER (PARTITION BY symbol) AS first_ts FROM bars),
p AS (SELECT *, unnest(['all', CASE WHEN ts >= first_ts + {7 * DAY} THEN 'post_launch' ELSE 'launch' END, CASE WHEN ts >= {BOUNDARY} THEN 'after_boundary' ELSE 'before_boundary' END]) AS phase FROM r),
d AS (SELECT symbol, phase, ts // {DAY} AS k, sum(rate) AS s FROM p GROUP BY 1, 2, 3), dl AS (SELECT *, lag(s) OVER (PARTITION BY symbol, phase ORDER BY k) AS l FROM d),
w AS (SELECT symbol, phase, (ts - first_ts) // {7 * DAY} AS k, sum(rate) AS s FROM p GROUP BY 1, 2, 3), wl AS (SELECT *, lag(s) OVER (PARTITION BY symbol, phase ORDER BY k) AS l FROM w)
SELECT * FROM (SELECT symbol, phase, count(*) AS hours, min(ts) AS first, avg(rate) * 24 * 365 AS annualised_mean, avg((rate > 0)::INT) AS share_hours_positive,
  CASE WHEN sum(rate) > 0 THEN sum(rate) FILTER (rate > 0.002) / sum(rate) END AS share_above_baseline FROM p GROUP BY 1, 2)
JOIN (SELECT symbol, phase, CASE WHEN count(*) > 3 THEN corr(s, l) END AS daily_autocorr_lag1 FROM dl GROUP BY 1, 2) USING (symbol, phase)
JOIN (SELECT symbol, phase, CASE WHEN count(*) > 3 THEN corr(s, l) END AS weekly_autocorr_lag1, quantile_cont(s * 10000, 0.1) AS weekly_sum_bp_p10, quantile_cont(s * 10000, 0.5) AS weekly_sum_bp_p50,
  quantile_cont(s * 10000, 0.9) AS weekly_sum_bp_p90, avg((s < 0)::INT) AS share_weeks_negative FROM wl GROUP BY 1, 2) USING (symbol, phase)""")
def _(t):
    r = t.bars.select("symbol", "ts", ((F.col("close") - 30) / 10_000).alias("rate"))
    return B.funding_phases(r, ["symbol"], launch=7 * DAY, boundary=BOUNDARY, baseline=0.002)


@query("A36_spread_stats", use="ticks", dbl="mean p25 p50 p75 p90 sign_agreement_rate annualized_mean_spread_pct", sql=f"""
WITH b AS (SELECT symbol, (ts // {8 * HOUR}) AS k, sum((px - 20) / 10000) AS rate FROM ticks GROUP BY 1, 2),
s AS (SELECT a.rate - c.rate AS s, sign(a.rate) = sign(c.rate) AS same FROM b a JOIN b c ON a.k = c.k AND a.symbol = 'click' AND c.symbol = 'view')
SELECT count(*) AS n_buckets, avg(s) AS mean, quantile_cont(s, 0.25) AS p25, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.75) AS p75, quantile_cont(s, 0.9) AS p90,
 avg(same::INT) AS sign_agreement_rate, avg(s) * 1095 * 100 AS annualized_mean_spread_pct FROM s""")
def _(t):
    r = t.ticks.select("symbol", "ts", ((F.col("px") - 20) / 10_000).alias("rate"))
    b = B.funding_bucket(r, ["symbol"])
    one = lambda s: b.where(F.col("symbol") == s)
    return B.spread_stats(one("click"), one("view"), ["bucket"], per_year=3 * 365)


@query("A38_coverage", use="ticks", sql=f"""
WITH g AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM ticks)
SELECT symbol, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS count, max(ts) + {HOUR} AS coverage_end_exclusive_ts, count(*) FILTER (ts - p > {HOUR + HOUR // 2}) AS unexpected_gap_count,
 coalesce(max(CASE WHEN ts - p > {HOUR + HOUR // 2} THEN ts END), min(ts)) AS tail_contiguous_start_ts FROM g GROUP BY 1""")
def _(t):
    return B.coverage(t.ticks, ["symbol"], interval=HOUR, tolerance=HOUR // 2, width=t.tick_width)


@query("A39_common_end", use="bars", sql="""SELECT min(m) AS common_end, []::VARCHAR[] AS missing FROM (SELECT symbol, max(ts) AS m FROM bars GROUP BY 1)""")
def _(t):
    return B.common_end(t.bars, t.table("events").select(F.col("event_type").alias("symbol")))


@query("A40_compare_runs", use="bars", dbl="mean_close_a mean_close_b mean_close_diff mean_close_pct volume_a volume_b volume_diff volume_pct", digits=4, sql=f"""
WITH a AS (SELECT symbol, avg(close) AS m, sum(volume) AS v FROM bars WHERE ts < {BOUNDARY} GROUP BY 1), b AS (SELECT symbol, avg(close) AS m, sum(volume) AS v FROM bars WHERE ts >= {BOUNDARY} GROUP BY 1)
SELECT symbol, a.m AS mean_close_a, b.m AS mean_close_b, b.m - a.m AS mean_close_diff, b.m / a.m * 100 - 100 AS mean_close_pct, a.v AS volume_a, b.v AS volume_b, b.v - a.v AS volume_diff, b.v / a.v * 100 - 100 AS volume_pct
FROM a FULL JOIN b USING (symbol)""")
def _(t):
    m = lambda cond: t.bars.where(cond).groupBy("symbol").agg(F.avg("close").alias("mean_close"), F.sum("volume").alias("volume"))
    return B.compare_runs(m(F.col("ts") < BOUNDARY), m(F.col("ts") >= BOUNDARY), ["symbol"], ["mean_close", "volume"])


@query("A41_rule_by_year", use="daily", dbl="rule_sum long_only_sum", sql="""
WITH r AS (SELECT symbol AS signal, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret, n FROM daily)
SELECT signal, year(date) AS yr, count(*) AS weeks, sum(CASE WHEN n % 2 = 0 THEN ret ELSE -ret END) AS rule_sum, sum(ret) AS long_only_sum FROM r WHERE ret IS NOT NULL GROUP BY 1, 2""")
def _(t):
    d = t.daily.withColumn("ts", F.unix_millis(F.col("date").cast("timestamp")))
    d = previous(d, ["symbol"], ["ts"], None, ["close"]).withColumn("ret", F.col("close") / F.col("prev_close") - 1)
    d = d.withColumn("pnl", F.when(F.col("n") % 2 == 0, F.col("ret")).otherwise(-F.col("ret"))).withColumnRenamed("symbol", "signal")
    return B.rule_by_year(d, signal="signal", date="date", pnl="pnl", hold="ret")
