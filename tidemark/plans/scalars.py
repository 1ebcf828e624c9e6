"""Scalar expression queries."""

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.scan import previous
from ..session import DAY, HOUR
from .registry import query

EDGES = (-1.0, -0.6, -0.2, 0.2, 0.6, 1.0)
T0, T1 = 1_704_585_600_000, 1_705_881_600_000  # 2024-01-07 .. 2024-01-22


@query("P1_scan_series", use="ticks", dbl="px sz", sql=f"SELECT symbol, ts, event_id, px, sz FROM ticks WHERE symbol = 'click' AND ts >= {T0} AND ts < {T1}")
def _(t):
    return S.scan_series(t.ticks, T0, T1, symbol="click").select("symbol", "ts", "event_id", "px", "sz")


@query("P2_valid_bars", use="bars", sql=f"""SELECT symbol, ts, CASE WHEN ts % {HOUR} <> 0 THEN 'unaligned' WHEN least(open, high, low, close) <= 1 THEN 'invalid_ohlc'
  WHEN low - 1 > least(open, close) - 1 OR greatest(open, close) > high THEN 'invalid_ohlc_order' END AS problem FROM bars""")
def _(t):
    shifted = t.bars.select("symbol", "ts", *[(F.col(c) - 1).alias(c) for c in ("open", "high", "low", "close")])
    return shifted.select("symbol", "ts", S.bar_problem(HOUR).alias("problem"))


@query("P3_normalise_epoch", sql="""SELECT event_id, epoch_us(ts) // 1000 AS a, epoch_us(ts) // 1000 AS b FROM events""")
def _(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.table("events").select("event_id", S.normalise_epoch(us).alias("a"), S.normalise_epoch(F.floor(us / 1000)).alias("b"))


@query("P4_returns", use="bars", dbl="simple log bp", sql="""SELECT symbol, ts, close / lag(close) OVER w - 1 AS simple, ln(close / lag(close) OVER w) AS log,
  (close / lag(close) OVER w - 1) * 10000 AS bp FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(t):
    b = previous(t.bars, ["symbol"], ["ts"], 7 * DAY, ["close"])
    r = S.simple_return("close", "prev_close")
    return b.select("symbol", "ts", r.alias("simple"), S.log_return("close", "prev_close").alias("log"), S.bp(r).alias("bp"))


@query("P5_net_return_bp", use="bars", dbl="net_bp", sql="""SELECT symbol, ts, (CASE WHEN trades % 2 = 0 THEN close / open - 1 ELSE -(close / open - 1) END) * 10000 - 14 AS net_bp FROM bars""")
def _(t):
    d = F.when(F.col("trades") % 2 == 0, "long").otherwise("short")
    return t.bars.select("symbol", "ts", S.net_return_bp("open", "close", d).alias("net_bp"))


@query("P6_decile_of", use="ticks", sql="SELECT event_id, greatest(ceil(sz / 10) - 1, 0)::BIGINT AS decile FROM ticks")
def _(t):
    return t.ticks.select("event_id", S.decile_of("sz").alias("decile"))


@query("P7_fixed_bins", use="bars", sql="""WITH i AS (SELECT symbol, ts, (2 * taker_buy_quote - quote_volume) / quote_volume AS x FROM bars)
SELECT symbol, ts, CASE WHEN x >= -1 AND x < -0.6 THEN '[-1,-0.6)' WHEN x >= -0.6 AND x < -0.2 THEN '[-0.6,-0.2)' WHEN x >= -0.2 AND x < 0.2 THEN '[-0.2,0.2)'
 WHEN x >= 0.2 AND x < 0.6 THEN '[0.2,0.6)' WHEN x >= 0.6 AND x <= 1 THEN '[0.6,1]' END AS bin FROM i""")
def _(t):
    return t.bars.select("symbol", "ts", S.fixed_bins(S.taker_imbalance("taker_buy_quote", "quote_volume"), EDGES).alias("bin"))


@query("P8_four_state", use="bars", sql="""SELECT symbol, ts, CASE WHEN close >= open THEN 'up' ELSE 'down' END || 'trend_' || CASE WHEN high - low >= close THEN 'high' ELSE 'low' END || '_vol' AS state FROM bars""")
def _(t):
    return t.bars.select("symbol", "ts", S.four_state(F.col("close") - F.col("open"), F.col("high") - F.col("low"), "close").alias("state"))


@query("P9_state_labels", use="bars", sql="""SELECT symbol, ts, CASE WHEN trades = 1 THEN 'missing' WHEN trades = 2 THEN 'stale' WHEN trades = 3 THEN 'missing_value'
  WHEN trades = 4 THEN 'unclassified_zero' WHEN trades = 5 THEN 'unclassified_invalid' ELSE 'available' END AS value_state,
  CASE WHEN trades = 3 THEN 'unclassified_missing' WHEN trades = 4 THEN 'unclassified_zero_volume' ELSE 'classified' END AS flow_state FROM bars""")
def _(t):
    n = F.col("trades")
    state = F.when(n == 1, "missing").when(n == 2, "stale").otherwise("available")
    value = F.when(n == 3, None).when(n == 4, 0.0).when(n == 5, -1.0).otherwise(F.col("close"))
    return t.bars.select("symbol", "ts", S.value_state(state, value).alias("value_state"), S.flow_state(value).alias("flow_state"))


@query("P10_taker_imbalance", use="bars", dbl="imbalance", sql="""SELECT symbol, ts, CASE WHEN quote_volume > 0 THEN (2 * taker_buy_quote - quote_volume) / quote_volume END AS imbalance FROM bars""")
def _(t):
    return t.bars.select("symbol", "ts", S.taker_imbalance("taker_buy_quote", "quote_volume").alias("imbalance"))


@query("P11_asset_and_stream", sql="""SELECT doc_id, upper(lang) AS asset, source || ':' || lang || CASE WHEN n_chars % 2 = 0 THEN ':agg' ELSE '' END AS stream FROM documents""")
def _(t):
    d = t.table("documents")
    suffix = F.element_at(F.array(F.lit("usdt"), F.lit("USDC"), F.lit("usd"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", S.asset_of(F.concat("lang", suffix)).alias("asset"),
                    S.stream_key("source", "lang", F.when(F.col("n_chars") % 2 == 0, "agg").otherwise("")).alias("stream"))


@query("P12_strategy_key", use="ticks", sql="""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'btc_long_' || symbol || '_24h' WHEN 1 THEN 'A2_contrarian_BTC_' || symbol || '_24h' WHEN 2 THEN 'B2_deleverage_ETH_' || symbol || '_24h' ELSE 'x_exit24h_' || symbol END AS strategy,
 CASE event_id % 4 WHEN 0 THEN 'long' WHEN 1 THEN CASE WHEN side = 'B' THEN 'short' ELSE 'long' END WHEN 2 THEN 'long' ELSE '' END AS direction FROM ticks""")
def _(t):
    m = F.col("event_id") % 4
    name = (F.when(m == 0, F.concat(F.lit("events_btc_long_"), "symbol")).when(m == 1, F.concat(F.lit("A2_contrarian_events_BTC_"), "symbol"))
            .when(m == 2, F.concat(F.lit("B2_deleverage_events_ETH_"), "symbol")).otherwise(F.concat(F.lit("events_x_exit24h_"), "symbol")))
    leg = F.when(F.col("side") == "B", "top").otherwise("bottom")
    path = F.concat(F.lit("/data/"), name, F.lit(".csv"))
    return t.ticks.select("event_id", S.strategy_key(path, F.lit("24h")).alias("strategy"), S.strategy_direction(path, leg).alias("direction"))


@query("P13_liquidation_prices", use="fills", dbl="liq_px room", sql="""SELECT order_id, line, part, (sz * 500 + sz * px) / (sz * 1.01) AS liq_px, 1 / (line + 1.0) - 0.5 / 40 AS room FROM fills""")
def _(t):
    return t.fills.select("order_id", "line", "part", S.liq_price_short(F.col("sz") * 500, "sz", "px", 0.01).alias("liq_px"),
                          S.liquidation_room(F.col("line") + 1.0, 40).alias("room"))


@query("P14_liq_bin", use="positions", sql="""WITH p AS (SELECT *, (liq_px - 100) / 100 * 100 AS pct FROM positions)
SELECT "user", ts, coin, CASE WHEN szi = 0 OR liq_px IS NULL OR (szi > 0 AND pct >= 0) OR (szi < 0 AND pct <= 0) THEN NULL WHEN abs(pct) > 30 THEN 'outside'
 ELSE CASE WHEN szi > 0 THEN 'down:' ELSE 'up:' END || least(floor(abs(pct) / 2)::BIGINT, 14) END AS bin FROM p""")
def _(t):
    return t.positions.select("user", "ts", "coin", S.liq_bin("szi", "liq_px", F.lit(100.0), 2.0, 30.0).alias("bin"))


@query("P15_bias_label", use="bars", sql="""WITH f AS (SELECT symbol, ts, taker_buy_quote AS a, quote_volume - taker_buy_quote AS b FROM bars),
r AS (SELECT *, CASE WHEN least(a, b) > 0 THEN greatest(a, b) / least(a, b) END AS r FROM f)
SELECT symbol, ts, CASE WHEN a <= 0 AND b <= 0 THEN '拮抗(データなし)' WHEN b <= 0 THEN 'BUY優勢(∞倍)' WHEN a <= 0 THEN 'SELL優勢(∞倍)'
 WHEN r < 1.5 THEN '拮抗' WHEN r >= 2 THEN CASE WHEN a >= b THEN 'BUY' ELSE 'SELL' END || '優勢' ELSE CASE WHEN a >= b THEN 'BUY' ELSE 'SELL' END || '優位気味' END AS label FROM r""")
def _(t):
    b = t.bars.select("symbol", "ts", S.bias_label("taker_buy_quote", F.col("quote_volume") - F.col("taker_buy_quote"), "BUY", "SELL").alias("label"))
    return b.withColumn("label", F.regexp_replace("label", r"\([0-9.]+倍\)$", ""))


@query("P16_position_context", use="positions", sql="""SELECT "user", ts, coin, CASE WHEN szi < 0 AND ts % 2 = 0 THEN 'ショート買い戻し(closing)' WHEN szi > 0 AND ts % 2 <> 0 THEN 'ロング利確/縮小(closing)'
 WHEN szi > 0 AND ts % 2 = 0 THEN 'ロング積み増し(building)' WHEN szi < 0 THEN 'ショート積み増し(building)' ELSE '新規/flip?' END AS context FROM positions""")
def _(t):
    return t.positions.select("user", "ts", "coin", S.position_context("szi", F.when(F.col("ts") % 2 == 0, "B").otherwise("A")).alias("context"))


@query("P17_session_clock", use="equities", sql=f"""WITH s AS (SELECT code, date, epoch_ms(date::TIMESTAMP) AS open_ms, epoch_ms(date::TIMESTAMP) + CASE WHEN date >= DATE '1998-01-01' THEN {6 * HOUR + HOUR // 2} ELSE {6 * HOUR} END AS close_ms FROM equities)
SELECT code, date, open_ms, close_ms, lag(close_ms) OVER w AS prev_close_ms, lead(close_ms) OVER w AS next_close_ms, lead(open_ms) OVER w AS next_open_ms FROM s WINDOW w AS (PARTITION BY code ORDER BY date)""")
def _(t):
    s = t.equities.select("code", "date", S.session_open_ms("date").alias("open_ms"), S.session_close_ms("date", "1998-01-01").alias("close_ms"))
    s = previous(s, ["code"], ["open_ms"], None, ["close_ms"], ts="open_ms")
    return previous(s, ["code"], ["open_ms"], None, ["close_ms", "open_ms"], ts="open_ms", prefix="next_", reverse=True)


@query("P18_parse_reason_map", use="ticks", sql="""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE side END AS restricted, CASE WHEN event_id % 3 = 1 THEN symbol END AS daily,
 CASE WHEN event_id % 3 = 0 THEN 'free text ' || symbol WHEN event_id % 3 = 2 THEN '{"Extra":"' || symbol || '"}' END AS other FROM ticks""")
def _(t):
    m = F.col("event_id") % 3
    text = (F.when(m == 0, F.concat(F.lit("free text "), "symbol"))
            .when(m == 1, F.format_string("{'Restricted': '%s', 'Daily': '%s'}", "side", "symbol"))
            .otherwise(F.format_string("{'Extra': '%s', 'Restricted': '%s'}", "symbol", "side")))
    cols = S.parse_reason_map(text, {"Restricted": "restricted", "Daily": "daily"})
    return t.ticks.select("event_id", *[c.alias(n) for n, c in cols.items()])


@query("P19_strict_values", use="ticks", dbl="value", sql="""SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag, CASE WHEN side = 'B' THEN px END AS value FROM ticks""")
def _(t):
    text = F.element_at(F.array(*map(F.lit, ("True", "0", " 1", "yes"))), (F.col("event_id") % 4 + 1).cast("int"))
    raw = F.when(F.col("side") == "B", F.col("px")).otherwise(F.lit(float("nan")))
    return t.ticks.select("event_id", S.strict_bool(text).alias("flag"), S.finite_or_null(raw).alias("value"))


@query("P20_calendar_fields", use="fills", sql="""SELECT order_id, line, part, year(d) AS year, strftime(d, '%Y-%m') AS month, hour(d) AS hour, weekofyear(d) AS iso_week, isoyear(d) AS iso_year,
 CAST(date_trunc('month', d) AS DATE) AS month_start FROM (SELECT *, make_timestamp(ts * 1000) AS d FROM fills)""")
def _(t):
    return t.fills.select("order_id", "line", "part", *[c.alias(n) for n, c in S.calendar_fields("ts").items()])


@query("P21_adverse_favorable", use="bars", dbl="adverse favorable", sql="""SELECT symbol, ts, CASE WHEN trades % 2 = 0 THEN low / open - 1 ELSE -(high / open - 1) END AS adverse,
 CASE WHEN trades % 2 = 0 THEN high / open - 1 ELSE -(low / open - 1) END AS favorable FROM bars""")
def _(t):
    a, f = S.adverse_favorable(F.when(F.col("trades") % 2 == 0, "long").otherwise("short"), "open", "high", "low")
    return t.bars.select("symbol", "ts", a.alias("adverse"), f.alias("favorable"))
