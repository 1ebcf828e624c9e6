"""Flow, position and early-warning queries (A19-A26, K2-K4, J18, Q10, Q12, U2, U3, L1-L10, T5 batch)."""

from pyspark.sql import functions as F

from ..operators import flow as fl
from ..operators import joins
from ..operators import warning as wn
from ..session import DAY, HOUR, MINUTE
from .registry import query

NOW = 880_000_000_000
WIN, GAP = 60 * DAY, 120 * DAY
BW = 7 * DAY

ORD = f"""pf AS (SELECT * FROM fills WHERE ts <= {NOW}),
og AS (SELECT order_id, sum(sz) AS cum_sz, sum(sz * px) AS cum_notional, min(ts) AS start_ts, max(ts) AS last_fill_ts, last(px ORDER BY ts, line, part, px) AS last_px FROM pf GROUP BY 1),
orr AS (SELECT h.*, og.* EXCLUDE (order_id), CASE WHEN declared_sz > 0 AND cum_sz >= declared_sz * 0.98 THEN 'completed' WHEN {NOW} - last_fill_ts > {GAP} THEN 'ended_suspected' ELSE 'active' END AS status FROM order_heads h JOIN og USING (order_id)),
ra AS (SELECT orr.*, r.usd FROM orr LEFT JOIN (SELECT order_id, sum(px * sz) AS usd FROM pf WHERE ts >= {NOW - WIN} GROUP BY 1) r USING (order_id))"""
MIN = WIN // MINUTE


def past(t):
    return t.fills.where(F.col("ts") <= NOW)


def orders(t):
    return fl.order_progress(t.order_heads, past(t), now=NOW, gap=GAP)


@query("A23_order_progress", use="fills order_heads", dbl="cum_sz cum_notional last_px", digits=7, sql=f"WITH {ORD} SELECT order_id, coin, side, cum_sz, cum_notional, start_ts, last_fill_ts, last_px, status FROM orr")
def _(t):
    return orders(t).select("order_id", "coin", "side", "cum_sz", "cum_notional", "start_ts", "last_fill_ts", "last_px", "status")


_rem = lambda s: f"sum(greatest(declared_sz - cum_sz, 0) * last_px) FILTER (status = 'active' AND side = '{s}' AND declared_sz > 0)"
FLOWSQL = lambda cond: f"""SELECT coin, count(*) FILTER (status = 'active' AND side = 'B') AS active_buy, count(*) FILTER (status = 'active' AND side = 'A') AS active_sell, count(*) FILTER (status = 'active' AND start_ts >= {NOW - WIN} AND side = 'B') AS new_buy, count(*) FILTER (status = 'active' AND start_ts >= {NOW - WIN} AND side = 'A') AS new_sell,
 coalesce(sum(usd) FILTER (side = 'B' AND {cond}), 0) / {MIN} AS buy_rate_usd_min, coalesce(sum(usd) FILTER (side = 'A' AND {cond}), 0) / {MIN} AS sell_rate_usd_min, {_rem('B')} AS buy_remaining_usd, {_rem('A')} AS sell_remaining_usd FROM ra GROUP BY 1"""  # noqa: E731
MATURE = f"status = 'active' AND start_ts < {NOW - WIN}"
FD = "buy_rate_usd_min sell_rate_usd_min buy_remaining_usd sell_remaining_usd"


@query("A22_flow_minute", use="fills order_heads", dbl=FD, digits=4, sql=f"WITH {ORD} {FLOWSQL('true')}")
def _(t):
    return fl.flow_minute(orders(t), past(t), now=NOW, window=WIN)


@query("A22_flow_minute_mature", use="fills order_heads", dbl=FD, digits=4, sql=f"WITH {ORD} {FLOWSQL(MATURE)}")
def _(t):
    return fl.flow_minute(orders(t), past(t), now=NOW, window=WIN, mature_only=True)


@query("A24_dominant_order", use="fills order_heads", dbl="rate_usd_min coin_rate share", sql=f"""WITH {ORD}, m AS (SELECT * FROM ra WHERE {MATURE}), c AS (SELECT coin, sum(usd) / {MIN} AS coin_rate FROM m GROUP BY 1)
SELECT order_id, coin, usd / {MIN} AS rate_usd_min, coin_rate, usd / {MIN} / coin_rate AS share FROM m JOIN c USING (coin) WHERE usd / {MIN} > 0.005 * coin_rate""")
def _(t):
    return fl.dominant_order(orders(t), past(t), now=NOW, window=WIN, share=0.005).select("order_id", "coin", "rate_usd_min", "coin_rate", "share")


LATEST = """la AS (SELECT "user", max(observed_ts) AS t FROM attempts WHERE status IN ('success', 'empty') GROUP BY 1),
lp AS (SELECT p.* FROM positions p JOIN la ON la."user" = p."user" AND la.t = p.ts UNION ALL SELECT p.* FROM positions p JOIN (SELECT "user", coin, max(ts) AS ts FROM positions GROUP BY 1, 2) o ON o."user" = p."user" AND o.coin = p.coin AND o.ts = p.ts WHERE p."user" NOT IN (SELECT "user" FROM la)),
nr AS (SELECT *, abs(100 - liq_px) / 100 AS distance FROM lp WHERE liq_px IS NOT NULL AND abs(100 - liq_px) / 100 <= 0.25)"""


def latest(t):
    return joins.latest_positions(t.attempts, t.positions)


def marks(t):
    return t.order_heads.select("coin").distinct().withColumn("mark", F.lit(100.0))


def near(t):
    return fl.near_liquidation(latest(t), marks(t), ratio=0.25)


@query("K3_near_liquidation", use="positions", dbl="liq_px distance", sql=f"""WITH {LATEST} SELECT "user", coin, liq_px, distance FROM nr ORDER BY distance, "user", coin LIMIT 15""")
def _(t):
    return near(t).orderBy("distance", "user", "coin").limit(15).select("user", "coin", "liq_px", "distance")


@query("A25_squeeze_signal", use="positions fills order_heads", dbl="ratio near_usd", digits=4, sql=f"""WITH {ORD}, {LATEST}, f AS ({FLOWSQL('true')}), n AS (SELECT coin, sum(position_value) FILTER (szi < 0 AND liq_px BETWEEN 100 AND 115) AS su, sum(position_value) FILTER (szi > 0 AND liq_px BETWEEN 85 AND 100) AS lu FROM nr GROUP BY 1)
SELECT coin, CASE WHEN sell_rate_usd_min > 0 AND buy_rate_usd_min >= 1.2 * sell_rate_usd_min AND su > 0 THEN 'short_squeeze' ELSE 'long_squeeze' END AS signal, greatest(buy_rate_usd_min / sell_rate_usd_min, sell_rate_usd_min / buy_rate_usd_min) AS ratio,
 CASE WHEN sell_rate_usd_min > 0 AND buy_rate_usd_min >= 1.2 * sell_rate_usd_min AND su > 0 THEN su ELSE lu END AS near_usd FROM f JOIN n USING (coin)
WHERE (sell_rate_usd_min > 0 AND buy_rate_usd_min >= 1.2 * sell_rate_usd_min AND su > 0) OR (buy_rate_usd_min > 0 AND sell_rate_usd_min >= 1.2 * buy_rate_usd_min AND lu > 0)""")
def _(t):
    f = fl.flow_minute(orders(t), past(t), now=NOW, window=WIN)
    return fl.squeeze_signal(f, near(t), marks(t), strong=1.2)


@query("A26_exit_under_pressure", use="positions fills order_heads", dbl="distance remaining_usd", digits=4, sql=f"""WITH {ORD}, {LATEST} SELECT nr."user", nr.coin, o.order_id, nr.distance, CASE WHEN declared_sz > 0 THEN greatest(declared_sz - cum_sz, 0) * last_px END AS remaining_usd
FROM nr JOIN orr o ON o."user" = nr."user" AND o.coin = nr.coin AND o.status = 'active' AND o.reduce_only AND o.side = CASE WHEN szi < 0 THEN 'B' WHEN szi > 0 THEN 'A' END""")
def _(t):
    return fl.exit_under_pressure(near(t), orders(t)).select("user", "coin", "order_id", "distance", "remaining_usd")


@query("K2_top_orders", use="fills order_heads", dbl="remaining_usd rate_usd_min", digits=4, sql=f"""WITH {ORD}, d AS (SELECT order_id, coalesce(declared_sz > 0, false) AS dec, CASE WHEN declared_sz > 0 THEN greatest(declared_sz - cum_sz, 0) * last_px END AS remaining_usd, usd / {MIN} AS rate_usd_min FROM ra WHERE status = 'active')
SELECT order_id, remaining_usd, rate_usd_min FROM d ORDER BY dec DESC, coalesce(remaining_usd, 0) DESC, coalesce(rate_usd_min, 0) DESC, order_id LIMIT 10""")
def _(t):
    return fl.top_orders(fl.order_rates(orders(t), past(t), now=NOW, window=WIN)).select("order_id", "remaining_usd", "rate_usd_min")


@query("K4_recent_n", use="bars", dbl="quote_volume", digits=4, sql="SELECT symbol, ts, quote_volume FROM bars WHERE symbol = 'click' ORDER BY ts DESC LIMIT 30")
def _(t):
    return t.bars.where("symbol = 'click'").select("symbol", "ts", "quote_volume").orderBy(F.col("ts").desc()).limit(30)


ACT = f"""{ORD}, {LATEST}, ac AS (SELECT DISTINCT "user", coin FROM orr WHERE status = 'active'), fp AS (SELECT lp.*, ac."user" IS NOT NULL AS has_active_order FROM lp LEFT JOIN ac ON ac."user" = lp."user" AND ac.coin = lp.coin)"""


@query("J18_exists_active_order", use="positions fills order_heads", dbl="szi", sql=f"""WITH {ACT} SELECT "user", ts, coin, szi, has_active_order FROM fp""")
def _(t):
    return joins.flag_active(latest(t), orders(t)).select("user", "ts", "coin", "szi", "has_active_order")


FRESH = 915_148_800_000


@query("A19_ladder", use="positions fills order_heads", dbl="notional active_notional cumulative", digits=3, sql=f"""WITH {ACT}, b AS (SELECT coin, position_value AS v, has_active_order AS a, CASE WHEN liq_px IS NULL THEN 'excluded_null_liquidation' WHEN position_value < 50000 THEN NULL WHEN szi = 0 OR (szi > 0 AND liq_px >= 100) OR (szi < 0 AND liq_px <= 100) THEN NULL
  WHEN abs((liq_px - 100) / 100 * 100) > 30 THEN 'outside' ELSE CASE WHEN szi > 0 THEN 'down:' ELSE 'up:' END || least(floor(abs((liq_px - 100) / 100 * 100) / 5)::INT, 5) END AS bucket FROM fp WHERE ts >= {FRESH}),
g AS (SELECT coin, bucket, sum(v) AS notional, count(*) AS count, coalesce(sum(v) FILTER (a), 0) AS active_notional FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2),
s AS (SELECT coin, bucket, sd, i FROM (SELECT DISTINCT coin FROM order_heads), (SELECT sd || ':' || i AS bucket, sd, i FROM (SELECT unnest(['down', 'up']) AS sd), (SELECT unnest(range(6)) AS i) UNION ALL SELECT 'outside', 'outside', NULL UNION ALL SELECT 'excluded_null_liquidation', 'excluded', NULL))
SELECT s.coin, s.bucket, coalesce(notional, 0) AS notional, coalesce(count, 0) AS count, coalesce(active_notional, 0) AS active_notional, CASE WHEN i IS NOT NULL THEN sum(coalesce(notional, 0)) OVER (PARTITION BY s.coin, sd ORDER BY i) END AS cumulative FROM s LEFT JOIN g USING (coin, bucket)""")
def _(t):
    p = joins.flag_active(latest(t), orders(t))
    return fl.ladder(p, marks(t), band_pct=5.0, range_pct=30.0, min_usd=50_000, fresh_after=FRESH)


_bkt = lambda m: f"""CASE WHEN position_value < 20000 THEN 'excluded_below_minimum' WHEN liq_px IS NULL THEN 'excluded_null_liquidation' WHEN szi = 0 OR (szi > 0 AND liq_px >= {m}) OR (szi < 0 AND liq_px <= {m}) THEN 'excluded_direction'
 WHEN abs((liq_px - {m}) / {m} * 100) > 30 THEN 'outside' ELSE CASE WHEN szi > 0 THEN 'down:' ELSE 'up:' END || least(floor(abs((liq_px - {m}) / {m} * 100) / 3)::INT, 9) END"""  # noqa: E731


@query("A20_bucket_totals", use="positions", dbl="notional", digits=3, sql=f"SELECT coin, {_bkt('100.0::DOUBLE')} AS bucket, sum(position_value) AS notional, count(*) AS count FROM positions GROUP BY 1, 2")
def _(t):
    return fl.bucket_totals(t.positions, F.lit(100.0), ["coin"], min_usd=20_000, band_pct=3.0, range_pct=30.0)


OBS = f"""p1 AS (SELECT "user", arg_max(szi, ts) AS szi, arg_max(position_value, ts) AS position_value, arg_max(coalesce(liq_px, -1), ts) AS l, max(ts) AS ts FROM positions WHERE coin = '1-URGENT' AND ts <= {{at}} GROUP BY 1)"""
T_OLD, T_NEW = 880_000_000_000, 930_000_000_000
DEC = f"""ob AS (SELECT "user", arg_max(szi, ts) AS szi, arg_max(position_value, ts) AS position_value, nullif(arg_max(coalesce(liq_px, -1), ts), -1) AS liq_px FROM positions WHERE coin = '1-URGENT' AND ts <= {T_OLD} GROUP BY 1),
nb AS (SELECT "user", arg_max(szi, ts) AS szi, arg_max(position_value, ts) AS position_value, nullif(arg_max(coalesce(liq_px, -1), ts), -1) AS liq_px FROM positions WHERE coin = '1-URGENT' AND ts <= {T_NEW} AND ts > {T_OLD - 200 * DAY} GROUP BY 1),
co AS (SELECT coalesce(o."user", n."user") AS "user", o."user" IS NOT NULL AND n."user" IS NOT NULL AND coalesce(o."user", n."user") % 5 <> 0 AS common, n."user" IS NULL AND coalesce(o."user", n."user") % 3 = 0 AS stale FROM ob o FULL JOIN nb n USING ("user"))"""


def observation(t, upto, after=None):
    p = t.positions.where((F.col("coin") == "1-URGENT") & (F.col("ts") <= upto))
    if after:
        p = p.where(F.col("ts") > after)
    return p.groupBy("user").agg(*[F.max_by(c, "ts").alias(c) for c in ("szi", "position_value", "liq_px")])


def cohort(t):
    o, n = observation(t, T_OLD), observation(t, T_NEW, T_OLD - 200 * DAY)
    j = o.select("user", F.lit(True).alias("_o")).join(n.select("user", F.lit(True).alias("_n")), "user", "full")
    common = F.col("_o").isNotNull() & F.col("_n").isNotNull() & (F.col("user") % 5 != 0)
    return o, n, j.select("user", common.alias("common"), (F.col("_n").isNull() & (F.col("user") % 3 == 0)).alias("stale"))


@query("A21_change_decomposition", use="positions", dbl="old_notional new_notional joins_or_refreshed departures staleness common_position_change_fixed_mid mid_or_bin_change delta_notional residual_notional", digits=3, sql=f"""WITH {DEC},
x AS (SELECT {_bkt('100.0::DOUBLE')} AS bucket, position_value AS v, coalesce(common AND NOT stale, false) AS c, coalesce(stale, false) AS s, 'old' AS a FROM ob JOIN co USING ("user") UNION ALL SELECT {_bkt('100.0::DOUBLE')}, position_value, coalesce(common AND NOT stale, false), false, 'fixed' FROM nb JOIN co USING ("user")
  UNION ALL SELECT {_bkt('97.0::DOUBLE')}, position_value, coalesce(common AND NOT stale, false), false, 'new' FROM nb JOIN co USING ("user")),
g AS (SELECT bucket, coalesce(sum(v) FILTER (a = 'old'), 0) AS old_notional, coalesce(sum(v) FILTER (a = 'new'), 0) AS new_notional, coalesce(sum(v) FILTER (a = 'fixed' AND NOT c), 0) AS joins_or_refreshed, -coalesce(sum(v) FILTER (a = 'old' AND NOT c AND NOT s), 0) AS departures, -coalesce(sum(v) FILTER (a = 'old' AND s), 0) AS staleness,
 coalesce(sum(v) FILTER (a = 'fixed' AND c), 0) - coalesce(sum(v) FILTER (a = 'old' AND c), 0) AS common_position_change_fixed_mid, coalesce(sum(v) FILTER (a = 'new'), 0) - coalesce(sum(v) FILTER (a = 'fixed'), 0) AS mid_or_bin_change FROM x GROUP BY 1)
SELECT *, new_notional - old_notional AS delta_notional, 0.0::DOUBLE AS residual_notional FROM g""")
def _(t):
    o, n, c = cohort(t)
    return fl.change_decomposition(o, n, c, old_mid=F.lit(100.0), new_mid=F.lit(97.0), min_usd=20_000, band_pct=3.0, range_pct=30.0)


@query("U3_cohort_difference", use="positions", sql=f"""WITH {DEC} SELECT "user", CASE WHEN NOT EXISTS (SELECT 1 FROM ob WHERE ob."user" = co."user") THEN 'joined' WHEN EXISTS (SELECT 1 FROM nb WHERE nb."user" = co."user") THEN 'kept' WHEN stale THEN 'stale' ELSE 'exited' END AS change FROM co""")
def _(t):
    o, n, c = cohort(t)
    return fl.cohort_changes(o, n, c.where("stale"))


@query("U2_union_users", use="attempts fills order_heads", sql="""SELECT "user" FROM attempts UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000""")
def _(t):
    return t.attempts.select("user").union(t.table("customer").where("c_acctbal > 5000").select("c_custkey")).distinct()


@query("Q10_freshness_report", use="attempts", dbl="age_ms_p50 success_age_ms_p50 fresh_success_rate", sql=f"""WITH l AS (SELECT "user", arg_max(status, attempt_id) AS status, arg_max(observed_ts, attempt_id) AS o, arg_max(observed_ts, attempt_id) FILTER (status <> 'failure') AS s FROM attempts GROUP BY 1),
c AS (SELECT c_mktsegment AS segment, coalesce(l.status, 'unobserved') AS status, greatest({1_000_000_000_000} - o, 0) AS age, greatest({1_000_000_000_000} - s, 0) AS sage, s FROM customer LEFT JOIN l ON l."user" = c_custkey)
SELECT segment, count(*) AS candidates, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'failure') AS failure, count(*) FILTER (status = 'unobserved') AS unobserved, min(age) AS age_ms_min, quantile_cont(age, 0.5) AS age_ms_p50, max(age) AS age_ms_max,
 quantile_cont(sage, 0.5) AS success_age_ms_p50, count(*) FILTER (s >= {1_000_000_000_000 - 400 * DAY}) AS fresh_success_addresses, count(*) FILTER (s >= {1_000_000_000_000 - 400 * DAY}) / count(*) AS fresh_success_rate, count(*) FILTER (s < {1_000_000_000_000 - 400 * DAY}) AS stale_candidates FROM c GROUP BY 1""")
def _(t):
    c = t.table("customer").select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("segment"))
    return fl.freshness_report(t.attempts, c, now=1_000_000_000_000, fresh=400 * DAY, group=["segment"])


@query("Q12_public_view", use="fills", dbl="notional", digits=4, sql="SELECT ts, sum(px * sz) AS notional, count(DISTINCT order_id) AS orders_count FROM fills GROUP BY 1")
def _(t):
    d = fl.public_counts(t.fills.withColumnRenamed("order_id", "orders"), ["ts"], [F.sum(F.col("px") * F.col("sz")).alias("notional"), F.first("part").alias("part")], ["orders"])
    return fl.public_view(d, ["part"], [])


@query("T5_candidate_set_batch", use="ticks", sql=f"""SELECT user_id AS "user", min(ts) AS first_seen_ts, max(ts) AS last_seen_ts, list_sort(list(DISTINCT symbol)) AS coins FROM ticks GROUP BY 1 HAVING max(ts) >= {1_706_659_200_000 - DAY} ORDER BY last_seen_ts DESC, 1 LIMIT 300""")
def _(t):
    s = t.ticks.select(F.col("user_id").alias("user"), "ts", F.col("symbol").alias("coin"))
    return fl.candidate_set(s, now=1_706_659_200_000, ttl=DAY, limit=300)


AS_OF = 1_705_276_800_000


@query("L1_available_prefix", use="bars", dbl="close", sql=f"SELECT symbol, ts, close FROM bars WHERE ts + {HOUR} <= {AS_OF} AND ts + {HOUR} + trades * {HOUR} <= {AS_OF}")
def _(t):
    b = t.bars.withColumn("received_ts", F.col("ts") + HOUR + F.col("trades") * HOUR).withColumn("as_of", F.lit(AS_OF))
    return wn.available_prefix(b, as_of="as_of", step=HOUR, received="received_ts").select("symbol", "ts", "close")


WM = "".join(f""", CASE WHEN count(*) OVER {n} = {k} THEN close / first_value(open) OVER {n} - 1 END AS {n}_return, CASE WHEN count(*) OVER {n} = {k} THEN max(high) OVER {n} - min(low) OVER {n} END AS {n}_range,
 CASE WHEN count(*) OVER {n} = {k} THEN sum(quote_volume) OVER {n} END AS {n}_volume, CASE WHEN count(*) OVER {n} = {k} THEN 2 * sum(taker_buy_quote) OVER {n} / sum(quote_volume) OVER {n} - 1 END AS {n}_imbalance, CASE WHEN count(*) OVER {n} = {k} THEN max(high) OVER {n} END AS {n}_high, CASE WHEN count(*) OVER {n} = {k} THEN min(low) OVER {n} END AS {n}_low"""
             for n, k in (("short", 4), ("context", 12), ("block", 2)))
WN = "WINDOW " + ", ".join(f"{n} AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {(k - 1) * HOUR} PRECEDING AND CURRENT ROW)" for n, k in (("short", 4), ("context", 12), ("block", 2)))


@query("L2_L3_window_metrics", use="bars", dbl="short_return short_range short_volume short_imbalance context_return", digits=8, sql=f"WITH m AS (SELECT symbol, ts, close{WM} FROM bars {WN}) SELECT symbol, ts, short_return, short_range, short_volume, short_imbalance, context_return FROM m")
def _(t):
    m = wn.window_metrics(t.bars, ["symbol"], {"short": 4, "context": 12}, step=HOUR, width=BW)
    return m.select("symbol", "ts", "short_return", "short_range", "short_volume", "short_imbalance", "context_return")


_r = lambda off: f"(PARTITION BY symbol ORDER BY ts RANGE BETWEEN {off * HOUR} PRECEDING AND {off * HOUR} PRECEDING)"
_a = lambda col, off: f"max({col}) OVER {_r(off)}"
_med = lambda cols: f"CASE WHEN {' AND '.join(f'({c}) IS NOT NULL' for c in cols)} THEN list_median([{', '.join(cols)}]) END"
WS = f"""m AS (SELECT symbol, ts, open, high, low, close{WM}, count(*) OVER nd AS have FROM bars {WN}, nd AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {19 * HOUR} PRECEDING AND CURRENT ROW)),
k AS (SELECT *, (ts + {HOUR}) % {2 * HOUR} AS gap, greatest(block_range, abs(block_high - {_a('close', 2)}), abs(block_low - {_a('close', 2)})) AS tr, {_med([_a('block_volume', 2 * j) for j in range(1, 7)])} AS typ, {_med([_a('short_range', 4 * (i + 1)) for i in range(3)])} AS pr,
 {_a('context_high', 4)} AS res, {_a('context_low', 4)} AS sup FROM m),
q AS (SELECT *, CASE WHEN typ > 0 THEN block_volume / typ END AS ratio, {_med([_a('tr', 2 * i) for i in range(6)])} AS sc FROM k),
w AS (SELECT q.*, b0.res AS resistance, b0.sup AS support, b0.close AS c0, b0.ratio AS r0, b1.close AS c1, b1.ratio AS r1, v.sc AS atr FROM q LEFT JOIN q b0 ON b0.symbol = q.symbol AND b0.ts = q.ts - q.gap LEFT JOIN q b1 ON b1.symbol = q.symbol AND b1.ts = q.ts - q.gap - {2 * HOUR}
  LEFT JOIN q v ON v.symbol = q.symbol AND v.ts = ((q.ts + {HOUR} - {4 * HOUR}) // {2 * HOUR}) * {2 * HOUR} - {HOUR}),
z AS (SELECT *, coalesce(atr > 0 AND resistance - close >= 0 AND resistance - close <= atr, false) AS near, CASE WHEN pr > 0 THEN short_range / pr END AS comp, coalesce(c0 > resistance, false) AND coalesce(c1 > resistance, false) AS pok, coalesce(r0 >= 1.5, false) OR coalesce(r1 >= 1.5, false) AS vok,
  list_filter(list({{'t': ts, 'c': close}}) OVER short, lambda x: x.t >= ts + {HOUR} - gap - {4 * HOUR}) AS rec FROM w WINDOW short AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {3 * HOUR} PRECEDING AND CURRENT ROW)),
y AS (SELECT *, len(rec) > 2 AND len(list_filter(rec[1:len(rec) - 2], lambda x: x.c < support)) > 0 AND len(list_filter(rec[len(rec) - 1:len(rec)], lambda x: x.c > support)) = 2 AS recl, have = 20 AND support IS NOT NULL AND support <> resistance AS ok FROM z),
fl AS (SELECT *, list_filter([CASE WHEN short_imbalance <= -0.1 AND short_return >= 0 THEN 'sell_resilience_short' END, CASE WHEN context_imbalance <= -0.1 AND context_return >= 0 THEN 'sell_resilience_context' END, CASE WHEN near AND comp <= 0.6 THEN 'compression_near_resistance' END,
 CASE WHEN near AND short_imbalance >= 0.1 AND short_return > 0 THEN 'buy_pressure_near_resistance' END, CASE WHEN recl THEN 'support_reclaimed' END, CASE WHEN pok THEN 'resistance_close_confirmation' END], lambda x: x IS NOT NULL) AS flags FROM y),
st AS (SELECT *, CASE WHEN NOT coalesce(ok, false) THEN 'insufficient_data' WHEN close < support THEN 'support_lost' WHEN pok AND close > resistance THEN 'price_breakout_confirmed' WHEN pok THEN 'breakout_faded' WHEN len(flags) > 0 THEN 'early_watch' ELSE 'neutral' END AS state FROM fl)"""
CFG = dict(context=12, short=4, confirm=2, confirm_bars=2, reclaim=2)


def states(t):
    return wn.warning_states(t.bars, ["symbol"], step=HOUR, width=BW, **CFG)


@query("L4_L5_warning_flags", use="bars", dbl="atr compression resistance", sql=f"WITH {WS} SELECT symbol, ts, atr, comp AS compression, resistance, near AS near_resistance, pok AS price_confirmed, vok AS volume_confirmed, array_to_string(CASE WHEN state = 'insufficient_data' THEN [] ELSE flags END, ',') AS flags FROM st")
def _(t):
    return states(t).select("symbol", "ts", "atr", "compression", "resistance", "near_resistance", "price_confirmed", "volume_confirmed", F.array_join("flags", ",").alias("flags"))


SINCE = f"coalesce(c0 > resistance AND ts + {HOUR} - gap - {2 * HOUR} >= known, false) AND coalesce(c1 > resistance AND ts + {HOUR} - gap - {4 * HOUR} >= known, false) AS pok"
WS2 = WS.replace("coalesce(c0 > resistance, false) AND coalesce(c1 > resistance, false) AS pok", SINCE).replace(f"x.t >= ts + {HOUR} - gap - {4 * HOUR}", "x.t >= known") \
    .replace("\nz AS (", f"""\nlv AS (SELECT symbol, min(low) AS support, max(high) AS resistance, (ts // {DAY}) * {DAY} + {27 * HOUR} AS known, CASE WHEN (ts // {DAY}) % 3 <> 0 THEN (ts // {DAY}) * {DAY} + {63 * HOUR} END AS expires FROM bars GROUP BY 1, 4, 5),
wl AS (SELECT w.* EXCLUDE (support, resistance), CASE WHEN l.support > 0 AND (expires IS NULL OR expires > w.ts + {HOUR}) THEN l.support END AS support, CASE WHEN l.support > 0 AND (expires IS NULL OR expires > w.ts + {HOUR}) THEN l.resistance END AS resistance, CASE WHEN l.support > 0 AND (expires IS NULL OR expires > w.ts + {HOUR}) THEN known END AS known
 FROM w ASOF LEFT JOIN lv l ON w.symbol = l.symbol AND w.ts + {HOUR} >= l.known),
pm AS (SELECT symbol, ts, short_imbalance AS psi, short_return AS psr, context_imbalance AS pci, context_return AS pcr FROM (SELECT symbol, ts, close{WM} FROM perp_bars {WN}) WHERE context_return IS NOT NULL),\nz AS (""").replace("AS rec FROM w WINDOW", "AS rec FROM wl WINDOW") \
    .replace("CASE WHEN near AND comp <= 0.6", "CASE WHEN psi <= -0.1 AND psr >= 0 THEN 'sell_resilience_second_short' END, CASE WHEN pci <= -0.1 AND pcr >= 0 THEN 'sell_resilience_second_context' END, CASE WHEN near AND comp <= 0.6") \
    .replace("CASE WHEN recl THEN", "CASE WHEN near AND psi >= 0.1 AND psr > 0 THEN 'buy_pressure_near_resistance_second' END, CASE WHEN recl THEN").replace("AS flags FROM y)", "AS flags FROM y LEFT JOIN pm USING (symbol, ts))")


@query("L4_L5_two_markets", use="bars perp_bars", dbl="support resistance", sql=f"WITH {WS2} SELECT symbol, ts, support, resistance, near AS near_resistance, pok AS price_confirmed, array_to_string(CASE WHEN state = 'insufficient_data' THEN [] ELSE flags END, ',') AS flags, state FROM st")
def _(t):
    day = F.floor(F.col("ts") / DAY) * DAY
    lv = t.bars.groupBy("symbol", day.alias("day")).agg(F.min("low").alias("support"), F.max("high").alias("resistance"))
    lv = lv.select("symbol", "support", "resistance", (F.col("day") + 27 * HOUR).alias("known_at"), F.when((F.col("day") / DAY).cast("long") % 3 != 0, F.col("day") + 63 * HOUR).alias("expires_at"))
    out = wn.warning_states(t.bars, ["symbol"], step=HOUR, width=BW, second=t.perp_bars, levels=lv, **CFG)
    return out.select("symbol", "ts", "support", "resistance", "near_resistance", "price_confirmed", F.array_join("flags", ",").alias("flags"), "state")


BAD = """bad AS (SELECT symbol, ts + CASE WHEN trades % 17 = 0 THEN 7 ELSE 0 END + CASE WHEN trades % 19 = 0 THEN 3600000 ELSE 0 END AS ts, CASE WHEN trades % 7 = 0 THEN -open ELSE open END AS open, CASE WHEN trades % 11 = 0 THEN low / 2 ELSE high END AS high, low, CASE WHEN trades % 13 = 0 THEN 'nan'::DOUBLE ELSE close END AS close,
 CASE WHEN trades % 5 = 0 THEN NULL ELSE quote_volume END AS quote_volume, CASE WHEN trades % 6 = 0 THEN -1.0 WHEN trades % 9 = 0 THEN quote_volume * 2 ELSE taker_buy_quote END AS taker_buy_quote, CASE WHEN trades % 8 = 0 THEN NULL WHEN trades % 10 = 0 THEN ts ELSE ts + 3600000 + trades * 86400000 END AS rc FROM bars)"""


@query("L1_prefix_problems", use="bars", sql=f"""WITH {BAD}, q AS (SELECT symbol, ts, CASE WHEN ts % {HOUR} <> 0 THEN 'misaligned_time' WHEN ts + {HOUR} > {AS_OF} THEN 'not_complete' WHEN rc IS NULL THEN 'not_received' WHEN rc < ts + {HOUR} THEN 'received_before_completion' WHEN rc > {AS_OF} THEN 'not_yet_received'
 WHEN NOT (isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close) AND open > 0 AND high > 0 AND low > 0 AND close > 0) THEN 'invalid_price' WHEN NOT (low <= least(open, close) AND greatest(open, close) <= high) THEN 'invalid_ohlc_order' WHEN quote_volume < 0 OR taker_buy_quote < 0 THEN 'invalid_volume'
 WHEN taker_buy_quote IS NOT NULL AND (quote_volume IS NULL OR taker_buy_quote > quote_volume) THEN 'taker_above_total' END AS p FROM bad),
r AS (SELECT *, count(*) FILTER (p IS NULL) OVER (PARTITION BY symbol, ts) AS n FROM q) SELECT symbol, coalesce(p, CASE WHEN n > 1 THEN 'duplicate_time' END, 'in_prefix') AS problem, count(*) AS bars FROM r GROUP BY 1, 2""")
def _(t):
    k = lambda m: F.col("trades") % m == 0
    b = t.bars.withColumn("received_ts", F.when(k(8), None).when(k(10), F.col("ts")).otherwise(F.col("ts") + HOUR + F.col("trades") * DAY))
    b = b.withColumns({"ts": F.col("ts") + F.when(k(17), 7).otherwise(0) + F.when(k(19), HOUR).otherwise(0), "open": F.when(k(7), -F.col("open")).otherwise(F.col("open")), "high": F.when(k(11), F.col("low") / 2).otherwise(F.col("high")),
                       "close": F.when(k(13), float("nan")).otherwise(F.col("close")), "taker_buy_quote": F.when(k(6), -1.0).when(k(9), F.col("quote_volume") * 2).otherwise(F.col("taker_buy_quote"))})
    b = b.withColumn("quote_volume", F.when(k(5), None).otherwise(F.col("quote_volume"))).withColumn("as_of", F.lit(AS_OF))
    d = wn.prefix_problems(b, ["symbol"], as_of="as_of", step=HOUR)
    return d.groupBy("symbol", F.coalesce("problem", F.lit("in_prefix")).alias("problem")).agg(F.count("*").alias("bars"))


@query("L6_warning_state", use="bars", sql=f"WITH {WS} SELECT symbol, ts, state, CASE WHEN state = 'insufficient_data' THEN state WHEN ts % {11 * HOUR} = 0 THEN 'historical_replay' WHEN ts % {5 * HOUR} = 0 THEN 'invalid_clock' WHEN ts % {7 * HOUR} = 0 THEN 'expired_reference' WHEN ts % {3 * HOUR} = 0 THEN 'stale_data' ELSE state END AS publishable FROM st")
def _(t):
    ts = F.col("ts")
    p = wn.publishable_state("state", age=F.when(ts % (3 * HOUR) == 0, 2 * HOUR).otherwise(0), max_age=HOUR, clock_valid=ts % (5 * HOUR) != 0,
                             reference_expires=F.when(ts % (7 * HOUR) == 0, ts), published=ts, mode=F.when(ts % (11 * HOUR) == 0, "market_time_replay").otherwise("observed"))
    return states(t).select("symbol", "ts", "state", p.alias("publishable"))


@query("L7_flow_and_volume_ratio", use="bars", dbl="exact_return_pct signed_taker_quote taker_imbalance_pct volume_ratio", digits=5, sql=f"""SELECT symbol, ts, CASE WHEN count(*) OVER m = 5 THEN (close / first_value(close) OVER m - 1) * 100 END AS exact_return_pct, CASE WHEN count(*) OVER a = 4 THEN 2 * sum(taker_buy_quote) OVER a - sum(quote_volume) OVER a END AS signed_taker_quote,
 CASE WHEN count(*) OVER a = 4 THEN (2 * sum(taker_buy_quote) OVER a / sum(quote_volume) OVER a - 1) * 100 END AS taker_imbalance_pct, CASE WHEN count(*) OVER a = 4 AND count(*) OVER b = 4 THEN sum(quote_volume) OVER a / sum(quote_volume) OVER b END AS volume_ratio FROM bars
WINDOW m AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {4 * HOUR} PRECEDING AND CURRENT ROW), a AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {3 * HOUR} PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {7 * HOUR} PRECEDING AND {4 * HOUR} PRECEDING)""")
def _(t):
    return wn.flow_and_volume(t.bars, ["symbol"], 4, step=HOUR, width=BW).select("symbol", "ts", "exact_return_pct", "signed_taker_quote", "taker_imbalance_pct", "volume_ratio")


@query("L8_oi_changes", use="bars", dbl="latest change_pct_h6 change_pct_h24", sql=f"""WITH oi AS (SELECT symbol, ts, volume FROM bars WHERE trades % 3 = 0), a AS (SELECT symbol, ts, ts - {6 * HOUR} AS t6, ts - {24 * HOUR} AS t24 FROM bars)
SELECT a.symbol, a.ts, n.volume AS latest, a.ts - n.ts AS lag_ms, n.volume / x.volume * 100 - 100 AS change_pct_h6, n.volume / y.volume * 100 - 100 AS change_pct_h24, a.t6 - x.ts AS prior_lag_h6, a.t24 - y.ts AS prior_lag_h24
FROM a ASOF LEFT JOIN oi n ON a.symbol = n.symbol AND a.ts >= n.ts ASOF LEFT JOIN oi x ON a.symbol = x.symbol AND a.t6 >= x.ts ASOF LEFT JOIN oi y ON a.symbol = y.symbol AND a.t24 >= y.ts""")
def _(t):
    oi = t.bars.where("trades % 3 = 0").select("symbol", "ts", "volume")
    return wn.oi_changes(t.bars.select("symbol", "ts"), oi, ["symbol"], {"h6": 6 * HOUR, "h24": 24 * HOUR}, value="volume", width=BW)


@query("L9_since_baseline", use="bars", dbl="previous_close current_close post_high post_low return_pct min_excursion_pct max_excursion_pct", sql=f"""WITH g AS (SELECT symbol, max(CASE WHEN ts + {HOUR} = {AS_OF} THEN close END) AS previous_close, arg_max(close, ts) AS current_close, max(CASE WHEN ts >= {AS_OF} THEN high END) AS post_high, min(CASE WHEN ts >= {AS_OF} THEN low END) AS post_low,
 arg_min(ts, (-high, ts)) FILTER (ts >= {AS_OF}) AS post_high_ts, min(CASE WHEN ts >= {AS_OF + DAY} AND close < 5 THEN ts END) AS first_close_below_cancel_ts, min(CASE WHEN ts >= {AS_OF + DAY} AND low <= 2 THEN ts END) AS first_limit_touch_ts FROM bars GROUP BY 1)
SELECT *, (current_close / previous_close - 1) * 100 AS return_pct, (post_low / previous_close - 1) * 100 AS min_excursion_pct, (post_high / previous_close - 1) * 100 AS max_excursion_pct FROM g""")
def _(t):
    return wn.since_baseline(t.bars, ["symbol"], baseline=AS_OF, plan=AS_OF + DAY, cancel=F.lit(5.0), limit=F.lit(2.0), step=HOUR)


@query("L9_ratio_changes", use="bars", dbl="ratio_change_pct", sql=f"""WITH g AS (SELECT symbol, max(CASE WHEN ts + {HOUR} = {AS_OF} THEN close END) AS p, arg_max(close, ts) AS c FROM bars GROUP BY 1) SELECT a.symbol AS a, b.symbol AS b, ((a.c / b.c) / (a.p / b.p) - 1) * 100 AS ratio_change_pct FROM g a JOIN g b ON a.symbol < b.symbol""")
def _(t):
    g = wn.since_baseline(t.bars, ["symbol"], baseline=AS_OF, plan=AS_OF, cancel=F.lit(0.0), limit=F.lit(0.0), step=HOUR).withColumn("k", F.lit(0))
    p = joins.pairs(g, on=["k"], name="symbol", values=["previous_close", "current_close"])
    return p.select("a", "b", (((F.col("a_current_close") / F.col("b_current_close")) / (F.col("a_previous_close") / F.col("b_previous_close")) - 1) * 100).alias("ratio_change_pct"))


@query("L10_hourly_metrics", use="bars", dbl="return_pct_12 high_12 low_12 return_sd", sql=f"""WITH r AS (SELECT *, CASE WHEN lag(ts) OVER w = ts - {HOUR} THEN ln(close / lag(close) OVER w) END AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, CASE WHEN count(*) OVER m = 13 THEN (close / first_value(close) OVER m - 1) * 100 END AS return_pct_12, CASE WHEN count(*) OVER m = 13 THEN max(high) OVER i END AS high_12, CASE WHEN count(*) OVER m = 13 THEN min(low) OVER i END AS low_12, CASE WHEN count(r) OVER s = 24 THEN stddev_pop(r) OVER s END AS return_sd FROM r
WINDOW m AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW), i AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {11 * HOUR} PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {23 * HOUR} PRECEDING AND CURRENT ROW)""")
def _(t):
    return wn.hourly_metrics(t.bars, ["symbol"], [12], sd_bars=24, step=HOUR, width=BW).select("symbol", "ts", "return_pct_12", "high_12", "low_12", "return_sd")


@query("L10_series_audit", use="bars", sql=f"""WITH p AS (SELECT *, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM bars) SELECT symbol, count(*) AS count, coalesce(bool_and(g <> 0), true) AS unique_timestamps, coalesce(bool_and(g = {HOUR}), true) AS contiguous, bool_and(low > 0 AND low <= least(open, close) AND greatest(open, close) <= high) AS ohlc_consistent, min(ts) AS first_ts, max(ts) AS last_open_ts FROM p GROUP BY 1""")
def _(t):
    return wn.series_audit(t.bars, ["symbol"], step=HOUR, width=BW)
