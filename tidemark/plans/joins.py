"""Join queries."""

from pyspark.sql import functions as F

from ..operators import asof, joins
from ..operators.scan import previous
from ..session import DAY, HOUR
from .registry import query

WIDTH = 7 * DAY  # bars, decisions per user and daily series: calendar-sized groups


@query("J1_asof_backward", use="decisions funding", dbl="rate", sql=f"""
SELECT d.event_id, d.user_id, d.ts, f.ts AS source_ts, f.rate, d.ts - f.ts AS age,
  CASE WHEN f.ts IS NULL THEN 'missing' WHEN d.ts - f.ts > {DAY} THEN 'stale' ELSE 'available' END AS state
FROM decisions d ASOF LEFT JOIN funding f ON d.user_id = f.user_id AND d.ts >= f.ts""")
def _(t):
    return asof.asof_backward(t.decisions.select("event_id", "user_id", "ts"), t.funding, by=["user_id"], take=["rate"],
                              width=t.tick_width, right_tie=["event_id"], max_age=DAY)


@query("J2_asof_backward_lagged", use="decisions funding", dbl="now_rate then_rate change", sql=f"""
SELECT d.event_id, n.rate AS now_rate, h.rate AS then_rate,
  CASE WHEN h.rate <> 0 THEN n.rate / h.rate END - 1 AS change
FROM (SELECT *, ts - {2 * DAY} AS then_ts FROM decisions) d
ASOF LEFT JOIN funding n ON d.user_id = n.user_id AND d.ts >= n.ts
ASOF LEFT JOIN funding h ON d.user_id = h.user_id AND d.then_ts >= h.ts""")
def _(t):
    out = asof.asof_change(t.decisions.select("event_id", "user_id", "ts"), t.funding, by=["user_id"], value="rate",
                           offset=2 * DAY, width=t.tick_width, right_tie=["event_id"])
    return out.select("event_id", "now_rate", "then_rate", "change")


@query("J3_asof_forward", use="bars", dbl="open", sql="""
SELECT k.event_id, k.ts, b.ts AS source_ts, b.open FROM ticks k ASOF LEFT JOIN bars b ON k.symbol = b.symbol AND k.ts < b.ts""")
def _(t):
    out = asof.asof_forward(t.ticks.select("event_id", "symbol", "ts"), t.bars, by=["symbol"], take=["open"],
                            width=t.tick_width, strict=True)
    return out.select("event_id", "ts", "source_ts", "open")


@query("J4_asof_prior_day", use="daily", dbl="prior_close", sql="""
SELECT d.symbol, d.date, CASE WHEN d.date - r.date <= 2 THEN r.close END AS prior_close
FROM daily d ASOF LEFT JOIN (SELECT * FROM daily WHERE symbol = '1-URGENT') r ON d.date > r.date""")
def _(t):
    d = t.daily.select("symbol", "date", F.lit(0).alias("k"))
    r = t.daily.where("symbol = '1-URGENT'").select(F.lit(0).alias("k"), "date", "close")
    return asof.asof_prior_day(d, r, by=["k"], value="close", max_age_days=2).drop("k")


@query("J5_asof_nearest", use="bars", dbl="match_close", sql=f"""
WITH target AS (SELECT symbol, ts, ts + {5 * HOUR} + {HOUR // 4} AS t FROM bars),
f AS (SELECT a.*, b.ts AS f_ts, b.close AS f_close FROM target a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.t <= b.ts),
g AS (SELECT f.*, b.ts AS b_ts, b.close AS b_close FROM f ASOF LEFT JOIN bars b ON f.symbol = b.symbol AND f.t > b.ts),
h AS (SELECT *, CASE WHEN f_ts - t <= {HOUR // 2} AND f_ts > ts THEN f_ts - t END AS fe,
        CASE WHEN t - b_ts <= {HOUR // 2} AND b_ts > ts THEN t - b_ts END AS be FROM g)
SELECT symbol, ts, CASE WHEN be IS NOT NULL AND (fe IS NULL OR be < fe) THEN b_ts WHEN fe IS NOT NULL THEN f_ts END AS match_ts,
  CASE WHEN be IS NOT NULL AND (fe IS NULL OR be < fe) THEN b_close WHEN fe IS NOT NULL THEN f_close END AS match_close FROM h""")
def _(t):
    left = t.bars.select("symbol", "ts", (F.col("ts") + 5 * HOUR + HOUR // 4).alias("t"))
    out = asof.asof_nearest(left, t.bars, by=["symbol"], target="t", take=["close"], tolerance=F.lit(HOUR // 2),
                            width=WIDTH, after="ts")
    return out.drop("t")


@query("J6_asof_bitemporal", use="order_heads fills", dbl="value", sql=f"""
WITH known AS (SELECT o."user", o.placed_ts AS reference, f.ts AS available, max(f.px * f.sz) AS value
  FROM fills f JOIN order_heads o USING (order_id) GROUP BY 1, 2, 3),
k AS (SELECT *, max((reference, available, value)) OVER (PARTITION BY "user" ORDER BY available, reference, value
    ROWS UNBOUNDED PRECEDING) AS best FROM known),
last AS (SELECT "user", available, arg_max(best, (reference, value)) AS best FROM
    (SELECT "user", available, reference, value, max(best) OVER (PARTITION BY "user", available) AS best FROM k) GROUP BY 1, 2)
SELECT o.order_id, CASE WHEN o.placed_ts - best[1] <= {400 * DAY} THEN best[1] END AS reference,
  CASE WHEN o.placed_ts - best[1] <= {400 * DAY} THEN best[3] END AS value
FROM order_heads o ASOF LEFT JOIN last ON o."user" = last."user" AND o.placed_ts > last.available""")
def _(t):
    known = (t.fills.join(t.order_heads, "order_id")
             .groupBy("user", F.col("placed_ts").alias("reference"), F.col("ts").alias("available"))
             .agg(F.max(F.col("px") * F.col("sz")).alias("value")))
    left = t.order_heads.select("order_id", "user", "placed_ts")
    out = asof.asof_bitemporal(left, known, by=["user"], left_on="placed_ts", available="available", reference="reference",
                               value="value", max_age=400 * DAY, width=365 * DAY)
    return out.select("order_id", "reference", "value")


@query("J7_exact_time_lookup", use="bars", dbl="entry_px exit_px", sql=f"""
SELECT a.symbol, a.ts, b.open AS entry_px, c.open AS exit_px FROM bars a
LEFT JOIN bars b ON b.symbol = a.symbol AND b.ts = a.ts + {HOUR} LEFT JOIN bars c ON c.symbol = a.symbol AND c.ts = a.ts + {4 * HOUR}""")
def _(t):
    left = t.bars.select("symbol", "ts")
    one = joins.exact_lookup(left, t.bars, by=["symbol"], at=F.col("ts") + HOUR, take={"open": "entry_px"})
    return joins.exact_lookup(one, t.bars, by=["symbol"], at=F.col("ts") + 4 * HOUR, take={"open": "exit_px"})


@query("J8_first_common_bar", use="bars decisions", dbl="a_px b_px", sql=f"""
WITH common AS (SELECT a.ts, a.open AS a_px, b.open AS b_px FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol = 'click' AND b.symbol = 'view')
SELECT s.event_id, CASE WHEN c.ts - s.ts <= {HOUR // 2} THEN c.ts END AS entry_ts, CASE WHEN c.ts - s.ts <= {HOUR // 2} THEN a_px END AS a_px,
  CASE WHEN c.ts - s.ts <= {HOUR // 2} THEN b_px END AS b_px,
  CASE WHEN c.ts - s.ts <= {HOUR // 2} THEN 'entered' ELSE 'entry_missing_or_wait_exceeded' END AS status
FROM decisions s ASOF LEFT JOIN common c ON s.ts < c.ts""")
def _(t):
    sig = t.decisions.select("event_id", F.col("ts").alias("signal_ts"))
    bars = t.bars
    out = joins.first_common_bar(sig, bars.where("symbol = 'click'"), bars.where("symbol = 'view'"), signal_ts="signal_ts",
                                 price="open", max_wait=HOUR // 2, width=t.tick_width)
    return out.drop("signal_ts")


@query("J9_prior_day_regime", use="fills order_heads daily", sql="""
WITH st AS (SELECT symbol AS coin, date, CASE WHEN close >= lag(close) OVER (PARTITION BY symbol ORDER BY date) THEN 'uptrend'
   WHEN lag(close) OVER (PARTITION BY symbol ORDER BY date) IS NOT NULL THEN 'downtrend' END AS regime FROM daily)
SELECT o.order_id, f.line, f.part, o.coin, s.regime FROM fills f JOIN order_heads o USING (order_id)
LEFT JOIN st s ON s.coin = o.coin AND s.date + 1 = CAST(make_timestamp(f.ts * 1000) AS DATE)""")
def _(t):
    d = t.daily.withColumnRenamed("symbol", "coin").withColumn("t", F.unix_millis(F.col("date").cast("timestamp")))
    d = previous(d, ["coin"], ["t"], None, ["close"], ts="t")
    states = d.select("coin", "date", F.when(F.col("close") >= F.col("prev_close"), "uptrend")
                      .when(F.col("prev_close").isNotNull(), "downtrend").alias("regime"))
    ev = t.fills.join(t.order_heads, "order_id").withColumn("day", F.timestamp_millis("ts").cast("date"))
    return joins.prior_day_state(ev, states, by=["coin"], date="day", state="regime").select("order_id", "line", "part", "coin", "regime")


@query("J10_outer_panel", use="bars", dbl="click view", sql="""
SELECT coalesce(a.ts, b.ts) AS ts, a.close AS click, b.close AS view FROM (SELECT * FROM bars WHERE symbol = 'click') a
FULL JOIN (SELECT * FROM bars WHERE symbol = 'view') b ON a.ts = b.ts""")
def _(t):
    bars = t.bars
    return joins.outer_panel({s: bars.where(F.col("symbol") == s) for s in ("click", "view")}, ["ts"], "close")


@query("J11_outer_merge_zero", use="ticks", dbl="click view signup error", sql=f"""
WITH b AS (SELECT symbol, (ts // {8 * HOUR}) * {8 * HOUR} AS bucket, sum((px - 20) / 10000) AS rate FROM ticks GROUP BY 1, 2)
SELECT bucket, coalesce(sum(rate) FILTER (symbol = 'click'), 0) AS click, coalesce(sum(rate) FILTER (symbol = 'view'), 0) AS view,
 coalesce(sum(rate) FILTER (symbol = 'signup'), 0) AS signup, coalesce(sum(rate) FILTER (symbol = 'error'), 0) AS error
FROM b WHERE symbol <> 'purchase' GROUP BY 1""")
def _(t):
    b = (t.ticks.groupBy("symbol", (F.floor(F.col("ts") / (8 * HOUR)) * 8 * HOUR).alias("bucket"))
         .agg(F.sum((F.col("px") - 20) / 10_000).alias("rate")))
    names = ("click", "view", "signup", "error")
    return joins.outer_panel({n: b.where(F.col("symbol") == n) for n in names}, ["bucket"], "rate", fill=0.0)


@query("J11_inner_on_date", use="daily equities", dbl="S F", sql="""
SELECT d.date, d.close AS S, e.close AS F FROM daily d JOIN equities e ON d.date = e.date AND d.symbol = '1-URGENT' AND e.code = 1""")
def _(t):
    s = t.daily.where("symbol = '1-URGENT'").select("date", F.col("close").alias("S"))
    return s.join(t.equities.where("code = 1").select("date", F.col("close").alias("F")), "date")


@query("J12_interval_path_join", use="decisions bars", dbl="low high", sql=f"""
SELECT d.event_id, count(*) AS bars, min(b.low) AS low, max(b.high) AS high, min(b.ts) AS first_ts, max(b.ts) AS last_ts
FROM decisions d JOIN bars b ON b.symbol = 'purchase' AND b.ts >= d.ts AND b.ts < d.ts + {6 * HOUR} GROUP BY 1""")
def _(t):
    ev = t.decisions.select("event_id", F.lit("purchase").alias("symbol"), F.col("ts").alias("entry"), (F.col("ts") + 6 * HOUR).alias("exit"))
    p = joins.interval_join(ev, t.bars.select("symbol", "ts", "low", "high"), by=["symbol"], start="entry", stop="exit")
    return p.groupBy("event_id").agg(F.count("*").alias("bars"), F.min("bar_low").alias("low"), F.max("bar_high").alias("high"),
                                     F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"))


@query("J13_interval_scan_max", use="bars", dbl="max_high worst_approach", sql=f"""
WITH iv AS (SELECT symbol, ts // {DAY} AS day, min(ts) AS a, (ts // {DAY}) * {DAY} + {DAY} AS z, max(open) * 4 AS lvl FROM bars GROUP BY 1, 2, 4),
p AS (SELECT iv.*, b.ts AS bts, b.high, (lvl - b.high) / lvl AS ap FROM iv JOIN bars b ON b.symbol = iv.symbol AND b.ts >= a AND b.ts < z)
SELECT symbol, day, max(high) AS max_high, min(ap) AS worst_approach, arg_min(bts, (ap, bts)) AS worst_ts,
 count(*) FILTER (ap <= 0.1) AS within_10pct, count(*) FILTER (ap <= 0.2) AS within_20pct, count(*) AS bars FROM p GROUP BY 1, 2""")
def _(t):
    day = F.floor(F.col("ts") / DAY)
    iv = (t.bars.groupBy("symbol", day.alias("day")).agg(F.min("ts").alias("a"), (F.max("open") * 4).alias("lvl"))
          .withColumn("z", (F.col("day") + 1) * DAY))
    return joins.interval_scan(iv, t.bars.select("symbol", "ts", "high"), by=["symbol"], key=["symbol", "day"], start="a",
                               stop="z", level="lvl")


@query("J14_offset_profile", use="bars", dbl="mean_value", sql="""
WITH n AS (SELECT symbol, ts, close / open - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos,
   count(*) OVER (PARTITION BY symbol) AS n FROM bars),
e AS (SELECT k.symbol, k.side, n.pos, n.n FROM ticks k ASOF JOIN n ON k.symbol = n.symbol AND k.ts <= n.ts),
w AS (SELECT symbol, side, pos, unnest(generate_series(-6, 6)) AS "offset" FROM e WHERE pos - 6 >= 1 AND pos + 6 <= n AND pos > 1)
SELECT w.symbol, w.side, w."offset", avg(n.r) AS mean_value, count(*) AS n FROM w JOIN n ON n.symbol = w.symbol AND n.pos = w.pos + w."offset" GROUP BY 1, 2, 3""")
def _(t):
    series = t.bars.select("symbol", "ts", (F.col("close") / F.col("open") - 1).alias("r"))
    ev = t.ticks.select("symbol", "side", F.col("ts").alias("event_ts"))
    return joins.offset_profile(ev, series, by=["symbol"], event_ts="event_ts", value="r", reach=6, width=t.tick_width, group=["side"])


@query("J15_semi_join_wanted", use="fills order_heads", dbl="px", digits=8, sql="""
SELECT f.order_id, f.line, f.part, f.ts, f.px FROM fills f WHERE EXISTS (SELECT 1 FROM order_heads o WHERE o.placed_ts = f.ts AND o.coin = '1-URGENT')""")
def _(t):
    want = t.order_heads.where("coin = '1-URGENT'").select(F.col("placed_ts").alias("ts"))
    return joins.wanted_keys(t.fills.select("order_id", "line", "part", "ts", "px"), want, ["ts"])


@query("J17_latest_positions", use="positions", dbl="szi position_value liq_px", digits=4, sql="""
WITH la AS (SELECT "user", max(observed_ts) AS t FROM attempts WHERE status IN ('success', 'empty') GROUP BY 1)
SELECT p."user", p.ts, p.coin, p.szi, p.position_value, p.liq_px FROM positions p JOIN la ON la."user" = p."user" AND la.t = p.ts
UNION ALL
SELECT p."user", p.ts, p.coin, p.szi, p.position_value, p.liq_px FROM positions p JOIN (SELECT "user", coin, max(ts) AS ts FROM positions GROUP BY 1, 2) o
  ON o."user" = p."user" AND o.coin = p.coin AND o.ts = p.ts WHERE p."user" NOT IN (SELECT "user" FROM la)""")
def _(t):
    return joins.latest_positions(t.attempts, t.positions)


@query("J19_nearest_declaration", use="order_heads", dbl="declared", sql="""
WITH d AS (SELECT "user", coin, placed_ts + 3600000 * 30 AS ts, max(declared_sz) AS declared FROM order_heads WHERE declared_sz IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT o.*, d.ts AS b_ts, d.declared AS b_v FROM order_heads o ASOF LEFT JOIN d ON o."user" = d."user" AND o.coin = d.coin AND o.placed_ts >= d.ts),
f AS (SELECT b.*, d.ts AS f_ts, d.declared AS f_v FROM b ASOF LEFT JOIN d ON b."user" = d."user" AND b.coin = d.coin AND b.placed_ts <= d.ts)
SELECT order_id, CASE WHEN f_ts IS NOT NULL AND (b_ts IS NULL OR f_ts - placed_ts < placed_ts - b_ts) THEN f_ts ELSE b_ts END AS matched_ts,
 CASE WHEN f_ts IS NOT NULL AND (b_ts IS NULL OR f_ts - placed_ts < placed_ts - b_ts) THEN f_v ELSE b_v END AS declared FROM f""")
def _(t):
    o = t.order_heads.select("order_id", "user", "coin", "placed_ts", "declared_sz")
    d = (o.where("declared_sz IS NOT NULL").groupBy("user", "coin", (F.col("placed_ts") + 30 * HOUR).alias("declared_ts"))
         .agg(F.max("declared_sz").alias("declared")))
    out = joins.nearest_declaration(o, d, by=["user", "coin"], ts="placed_ts", declared_ts="declared_ts", take=["declared"], width=365 * DAY)
    return out.select("order_id", "matched_ts", "declared")


@query("J20_pairs_self_join", use="bars", dbl="mean_ratio corr", sql="""
SELECT a.symbol AS a, b.symbol AS b, count(*) AS common, avg(a.close / b.close) AS mean_ratio, corr(ln(a.close), ln(b.close)) AS corr
FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2""")
def _(t):
    p = joins.pairs(t.bars, on=["ts"], name="symbol", values=["close"])
    return p.groupBy("a", "b").agg(F.count("*").alias("common"), F.avg(F.col("a_close") / F.col("b_close")).alias("mean_ratio"),
                                   F.corr(F.ln("a_close"), F.ln("b_close")).alias("corr"))


CAL = "cal AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) WHERE dayofweek(date) BETWEEN 1 AND 5)"


def _calendar(t):
    days = t.table("lineitem").select(F.col("l_shipdate").cast("date").alias("date")).where(F.dayofweek("date").between(2, 6))
    return joins.indexed_calendar(days)


@query("J21_business_calendar", use="order_heads", sql=f"""
WITH {CAL}, o AS (SELECT order_id, CAST(make_timestamp(placed_ts * 1000) AS DATE) AS d,
   printf('%02d:%02d:00', 9 + order_id % 9, order_id % 60) AS tm FROM order_heads),
x AS (SELECT o.*, c.date AS on_or_before, coalesce(c.idx, 0) AS i FROM o ASOF LEFT JOIN cal c ON o.d >= c.date)
SELECT x.order_id, x.on_or_before, n3.date AS third_after,
 CASE WHEN x.on_or_before = x.d AND tm < CASE WHEN x.d >= DATE '1998-01-01' THEN '15:30:00' ELSE '15:00:00' END THEN x.d ELSE n1.date END AS reaction
FROM x LEFT JOIN cal n3 ON n3.idx = x.i + 3 LEFT JOIN cal n1 ON n1.idx = x.i + 1""")
def _(t):
    cal = _calendar(t)
    tm = F.format_string("%02d:%02d:00", 9 + F.col("order_id") % 9, F.col("order_id") % 60)
    o = t.order_heads.select("order_id", F.timestamp_millis("placed_ts").cast("date").alias("d"), tm.alias("tm"))
    x = joins.last_business_day(o, cal, "d", out="on_or_before")
    x = joins.nth_business_day_after(x, cal, "d", 3, out="third_after")
    x = joins.reaction_session(x, cal, date="d", time="tm", rule_change="1998-01-01")
    return x.select("order_id", "on_or_before", "third_after", "reaction")


@query("J22_schedule_join", use="daily", sql=f"""
WITH {CAL}, we AS (SELECT max(date) AS date FROM cal GROUP BY isoyear(date), weekofyear(date)),
r AS (SELECT d.date AS reference, max(CASE WHEN n % 2 = 0 THEN d.date + (n * 3)::INTEGER END) AS pub FROM daily d WHERE d.date IN (SELECT date FROM we) GROUP BY 1),
a AS (SELECT r.*, c.idx AS ri FROM r ASOF LEFT JOIN cal c ON r.reference >= c.date),
b AS (SELECT a.*, c.idx AS pi FROM a ASOF LEFT JOIN cal c ON a.pub >= c.date),
s AS (SELECT b.reference, b.pub AS pub_date, c.date AS decision FROM b JOIN cal c ON c.idx = greatest(ri + 2, CASE WHEN pub IS NOT NULL THEN coalesce(pi, 0) + 1 ELSE 0 END))
SELECT *, lead(decision) OVER (ORDER BY reference) AS next_decision FROM s""")
def _(t):
    refs = t.daily.select(F.col("date").alias("reference"),
                          F.when(F.col("n") % 2 == 0, F.date_add("date", (F.col("n") * 3).cast("int"))).alias("pub_date"))
    return joins.schedule(refs, _calendar(t), lag=2)


@query("J23_match_error", use="bars", dbl="mae max_abs_err mean_rel_bp", sql="""
WITH ref AS (SELECT ts, close FROM bars WHERE symbol = 'click'), s AS (SELECT b.symbol, count(*) AS matched, avg(abs(r.close - b.close)) AS mae,
  max(abs(r.close - b.close)) AS max_abs_err, avg(CASE WHEN b.close <> 0 THEN abs(r.close - b.close) / b.close * 10000 END) AS mean_rel_bp
  FROM bars b JOIN ref r USING (ts) WHERE b.symbol <> 'click' GROUP BY 1)
SELECT *, CASE WHEN matched >= 0.5 * (SELECT count(*) FROM ref) THEN row_number() OVER (PARTITION BY matched >= 0.5 * (SELECT count(*) FROM ref) ORDER BY mae, symbol) END AS rank FROM s""")
def _(t):
    b = t.bars.select("symbol", "ts", "close")
    return joins.match_error(b.where("symbol = 'click'"), b.where("symbol <> 'click'"), key=["ts"], value="close", name="symbol")
