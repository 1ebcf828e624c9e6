"""Equity-style and carry queries."""

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import carry as C
from ..operators import equities as Q
from ..operators import events as E
from ..operators import joins
from ..operators import windows as W
from ..operators.infer import cluster_bootstrap_diff
from ..session import DAY, HOUR
from .book import boot_sql
from .joins import CAL, _calendar
from .registry import query
from .windows import day_ts

BW = 7 * DAY


@query("A27_margin_ratio_weekly", use="equities", dbl="log_long log_short unpriced_share value", digits=7, sql="""WITH b AS (SELECT code, date, shares AS l, shares * (1 + code % 3) AS s FROM equities), c AS (SELECT code, date, close FROM equities WHERE code % 10 <> 0)
SELECT date, ln(sum(l * close)) AS log_long, ln(sum(s * close)) AS log_short, count(*) AS codes, count(close) AS codes_priced, coalesce(sum(l) FILTER (close IS NULL) / sum(l), 0) AS unpriced_share, ln(sum(l * close) / sum(s * close)) AS value FROM b LEFT JOIN c USING (code, date) GROUP BY 1""")
def _(t):
    b = t.equities.select("code", "date", F.col("shares").alias("long_shares"), (F.col("shares") * (1 + F.col("code") % 3)).alias("short_shares"))
    m = Q.margin_ratio(b, t.equities.where("code % 10 <> 0"))
    return m.select("date", F.ln("long_value").alias("log_long"), F.ln("short_value").alias("log_short"), "codes", "codes_priced", "unpriced_share", "value")


@query("A28_ratio_of_sums", dbl="ratio", sql="""SELECT CAST(o_orderdate AS DATE) AS date, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice) AS ratio, count(DISTINCT o_orderpriority) AS parts FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def _(t):
    o = t.table("orders").withColumn("date", F.col("o_orderdate").cast("date"))
    return Q.ratio_of_sums(o, ["date"], F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0), F.col("o_totalprice"),
                           where=F.col("o_orderpriority") != "5-LOW", parts="o_orderpriority")


OPT = """op AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_shipdate AS DATE) + (l_linenumber * 12)::INTEGER AS expiry, 1000.0::DOUBLE + floor(l_extendedprice / l_quantity / 50) * 50 AS strike, CASE WHEN l_linestatus = 'O' THEN 'P' ELSE 'C' END AS pc,
  max(l_extendedprice) - 2000 AS settle, max(l_discount) AS iv, 1500.0::DOUBLE + (epoch_ms(any_value(l_shipdate)) // 86400000) % 900 + CASE WHEN day(any_value(l_shipdate)) = 13 THEN count(*) ELSE 0 END AS underlying FROM lineitem GROUP BY 1, 2, 3, 4),
st AS (SELECT date, expiry, strike, max(settle) FILTER (pc = 'P') AS ps, max(iv) FILTER (pc = 'P') AS pi, max(settle) FILTER (pc = 'C') AS cs, max(iv) FILTER (pc = 'C') AS ci, min(underlying) AS lo, max(underlying) AS hi FROM op GROUP BY 1, 2, 3),
un AS (SELECT date, expiry, min(lo) AS lo, max(hi) AS hi FROM st GROUP BY 1, 2), ca AS (SELECT st.*, un.lo AS u FROM st JOIN un USING (date, expiry) WHERE un.lo = un.hi AND ps > 0 AND pi > 0 AND cs > 0 AND ci > 0),
atm AS (SELECT date, expiry, any_value(u) AS underlying, arg_min(strike, (abs(strike - u), strike)) AS strike, arg_min((pi + ci) / 2, (abs(strike - u), strike)) AS atm_iv FROM ca GROUP BY 1, 2)"""


def options(t):
    d = F.col("l_shipdate").cast("date")
    strike = 1000.0 + F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 50) * 50
    g = t.table("lineitem").groupBy(d.alias("date"), F.date_add(d, F.col("l_linenumber") * 12).alias("expiry"), strike.alias("strike"), F.when(F.col("l_linestatus") == "O", "P").otherwise("C").alias("put_call")) \
        .agg((F.max("l_extendedprice") - 2000).alias("settle"), F.max("l_discount").alias("iv"), F.count("*").alias("_n"))
    day = F.unix_date("date")
    return g.withColumn("underlying", 1500.0 + day % 900 + F.when(F.dayofmonth("date") == 13, F.col("_n")).otherwise(0))


@query("A30_atm_by_expiry", dbl="underlying strike atm_iv", sql=f"WITH {OPT} SELECT * FROM atm")
def _(t):
    return Q.atm_by_expiry(options(t), ["date", "expiry"])


@query("A31_constant_maturity", dbl="iv", sql=f"""WITH {OPT}, r AS (SELECT date, expiry - date AS d, atm_iv, row_number() OVER (PARTITION BY date ORDER BY expiry) AS r FROM atm WHERE expiry - date >= 10), p AS (SELECT date, max(d) FILTER (r = 1) AS t1, max(d) FILTER (r = 2) AS t2, max(atm_iv) FILTER (r = 1) AS i1, max(atm_iv) FILTER (r = 2) AS i2 FROM r WHERE r <= 2 GROUP BY 1),
v AS (SELECT *, (1 - (30 - t1) / (t2 - t1)) * i1 * i1 * t1 + (30 - t1) / (t2 - t1) * i2 * i2 * t2 AS tv FROM p)
SELECT date, CASE WHEN t2 IS NULL THEN i1 WHEN tv > 0 THEN sqrt(tv / 30) END AS iv, CASE WHEN t2 IS NULL THEN 'single' WHEN t1 <= 30 AND 30 <= t2 THEN 'interpolated' ELSE 'extrapolated' END AS method, t1 AS near_days, coalesce(t2, t1) AS far_days FROM v""")
def _(t):
    a = Q.atm_by_expiry(options(t), ["date", "expiry"]).withColumn("days", F.datediff("expiry", "date"))
    return Q.constant_maturity(a, ["date"], days="days", iv="atm_iv", target=30, min_days=10)


SNAP = "sn AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS code, max(o_orderstatus) AS status, count(*) % 2 AS grp FROM orders GROUP BY 1, 2)"
HIST = f"""{SNAP}, dy AS (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM sn)), g AS (SELECT sn.*, d - row_number() OVER (PARTITION BY code, status, grp ORDER BY d) AS g FROM sn JOIN dy USING (date)),
hi AS (SELECT code, status, grp, min(date) AS valid_from, max(date) AS valid_to, count(*) AS snapshots FROM g GROUP BY code, status, grp, g)"""


def snapshots(t):
    return t.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("code")).agg(
        F.max("o_orderstatus").alias("status"), (F.count("*") % 2).alias("grp"))


@query("Q5_scd2_compress", sql=f"WITH {HIST} SELECT * FROM hi")
def _(t):
    return Q.scd2_compress(snapshots(t), "code", ["status", "grp"])


@query("Q5_scd2_expand", sql=f"WITH {SNAP} SELECT * FROM sn")
def _(t):
    s = snapshots(t)
    return Q.scd2_expand(Q.scd2_compress(s, "code", ["status", "grp"]), s, "code", ["status", "grp"])


@query("J16_scd2_as_of", sql=f"""WITH {HIST} SELECT o_orderkey AS order_id, h.status AS master_status, h.grp FROM orders o ASOF LEFT JOIN hi h ON o_orderpriority = h.code AND CAST(o_orderdate AS DATE) + 1 >= h.valid_from WHERE h.valid_to >= CAST(o_orderdate AS DATE) + 1
UNION ALL SELECT o_orderkey, NULL, NULL FROM orders o ASOF LEFT JOIN hi h ON o_orderpriority = h.code AND CAST(o_orderdate AS DATE) + 1 >= h.valid_from WHERE h.valid_to IS NULL OR h.valid_to < CAST(o_orderdate AS DATE) + 1""")
def _(t):
    h = Q.scd2_compress(snapshots(t), "code", ["status", "grp"]).withColumnRenamed("status", "master_status")
    o = t.table("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("code"), F.date_add(F.col("o_orderdate").cast("date"), 1).alias("day"))
    return joins.scd2_as_of(o, h, by=["code"], on="day", take=["master_status", "grp"], width=30 * DAY).select("order_id", "master_status", "grp")


@query("R13_cross_section_features", use="equities", dbl="log_price turnover_med reversal momentum vol", digits=5, sql="""WITH p AS (SELECT *, ln(close) - sum(ln(adj_factor)) OVER (PARTITION BY code ORDER BY date) AS log_price FROM equities), r AS (SELECT *, log_price - lag(log_price) OVER (PARTITION BY code ORDER BY date) AS r FROM p)
SELECT code, date, log_price, quantile_cont(turnover, 0.5) OVER l AS turnover_med, log_price - lag(log_price, 5) OVER w AS reversal, lag(log_price, 5) OVER w - lag(log_price, 60) OVER w AS momentum, stddev_pop(r) OVER l AS vol FROM r
WINDOW w AS (PARTITION BY code ORDER BY date), l AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)""")
def _(t):
    f = Q.cross_section_features(day_ts(t.equities), ["code"], reversal=5, momentum=60, window=20)
    return f.select("code", "date", "log_price", "turnover_med", "reversal", "momentum", "vol")


REACT = f"""{CAL}, ds AS (SELECT c_nationkey AS code, CAST(o_orderdate AS DATE) AS d, printf('%02d:%02d:00', 9 + o_orderkey % 9, o_orderkey % 60) AS tm FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'),
dx AS (SELECT ds.*, c.date AS ob, coalesce(c.idx, 0) AS i FROM ds ASOF LEFT JOIN cal c ON ds.d >= c.date),
re AS (SELECT DISTINCT code, CASE WHEN ob = d AND tm < CASE WHEN d >= DATE '1998-01-01' THEN '15:30:00' ELSE '15:00:00' END THEN d ELSE n.date END AS date FROM dx LEFT JOIN cal n ON n.idx = i + 1),
mo AS (SELECT * FROM (SELECT *, close / b - 1 AS rc, high / b - 1 AS rh, low / b - 1 AS fl, ln(open / b) AS ov, ln(close / open) AS it FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) * adj_factor AS b FROM equities)) WHERE rc IS NOT NULL),
me AS (SELECT mo.*, re.date IS NOT NULL AS e FROM mo LEFT JOIN re USING (code, date))"""


def reactions(t):
    o = t.table("orders").where("o_orderstatus = 'F'").join(t.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    tm = F.format_string("%02d:%02d:00", 9 + F.col("o_orderkey") % 9, F.col("o_orderkey") % 60)
    d = o.select(F.col("c_nationkey").alias("code"), F.col("o_orderdate").cast("date").alias("d"), tm.alias("tm"))
    return joins.reaction_session(d, _calendar(t), date="d", time="tm", rule_change="1998-01-01").where("reaction IS NOT NULL")


@query("E21_earnings_reaction", use="equities", dbl="event_mean_abs other_mean_abs event_max_rise event_p99_rise event_min_fall max_rise", digits=5, sql=f"""WITH {REACT} SELECT code, count(*) AS days, count(*) FILTER (e) AS event_days, avg(abs(rc)) FILTER (e) AS event_mean_abs, avg(abs(rc)) FILTER (NOT e) AS other_mean_abs, max(rh) FILTER (e) AS event_max_rise, quantile_cont(rh, 0.99) FILTER (e) AS event_p99_rise,
 min(fl) FILTER (e) AS event_min_fall, arg_min(date, (-rh, date)) FILTER (e) AS event_worst_date, max(rh) AS max_rise, CASE WHEN 1 - 0.05 >= 0.5 * max(rh) THEN CASE WHEN 1 / 3.0::DOUBLE - 0.05 >= 0.5 * max(rh) THEN 3 WHEN 1 / 2.0::DOUBLE - 0.05 >= 0.5 * max(rh) THEN 2 ELSE 1 END END AS leverage FROM me GROUP BY 1""")
def _(t):
    m = W.daily_moves(day_ts(t.equities), ["code"], width=None)
    return Q.reaction_moves(m, reactions(t), "code", leverages=[1, 2, 3], buffer=0.5, max_leverage=10.0)


@query("A33_risk_card", use="equities", dbl="median_turnover worst_rise worst_fall p99_abs_change mean_abs_change overnight_mean intraday_mean overnight_vol intraday_vol event_mean_abs other_mean_abs limit_up_share limit_down_share beta", digits=4, sql=f"""WITH {REACT}, mk AS (SELECT date, avg(rc) AS m FROM mo GROUP BY 1),
j AS (SELECT me.*, mk.m, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS k FROM me JOIN mk USING (date))
SELECT code, count(*) AS days, quantile_cont(turnover, 0.5) FILTER (k <= 250) AS median_turnover, max(rh) AS worst_rise, -min(fl) AS worst_fall, quantile_cont(abs(rc), 0.99) AS p99_abs_change, avg(abs(rc)) AS mean_abs_change, avg(ov) * 245 AS overnight_mean, avg(it) * 245 AS intraday_mean, stddev_samp(ov) * sqrt(245) AS overnight_vol, stddev_samp(it) * sqrt(245) AS intraday_vol,
 count(*) FILTER (e) AS event_days, avg(abs(rc)) FILTER (e) AS event_mean_abs, avg(abs(rc)) FILTER (NOT e) AS other_mean_abs, avg((close = high)::INT) AS limit_up_share, avg((close = low)::INT) AS limit_down_share, covar_samp(CASE WHEN k <= 250 THEN ln(1 + rc) END, CASE WHEN k <= 250 THEN m END) / var_samp(CASE WHEN k <= 250 THEN m END) AS beta FROM j GROUP BY 1 HAVING count(*) >= 100""")
def _(t):
    b = day_ts(t.equities)
    market = W.daily_moves(b, ["code"], width=None).groupBy("date").agg(F.avg("ret_close").alias("ret"))
    return Q.risk_card(b, market.where("ret IS NOT NULL"), reactions(t), "code", last=250, min_days=100)


@query("A34_top_universe", use="equities", dbl="median_turnover", sql="""WITH d AS (SELECT DISTINCT date FROM equities ORDER BY date DESC LIMIT 250) SELECT code, median(turnover) AS median_turnover FROM equities WHERE date IN (SELECT date FROM d) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    return Q.top_universe(t.equities, "code", days=250, n=10)


# -- carry: purchase hours are the venue, click/view hours the references ---------------------------

CARRY = f"""dy AS (SELECT symbol, (ts // {DAY}) * {DAY} + {6 * HOUR} AS ts, avg(close) AS fair FROM bars WHERE symbol <> 'error' GROUP BY 1, 2),
ex AS (SELECT d.*, x.open AS e, h.close AS p FROM dy d LEFT JOIN (SELECT * FROM bars WHERE trades % 2 = 1) x ON x.symbol = d.symbol AND x.ts = d.ts LEFT JOIN bars h ON h.symbol = d.symbol AND h.ts = d.ts - {HOUR}),
cb AS (SELECT symbol, ts, fair, coalesce(e, p) AS perp, CASE WHEN e IS NOT NULL THEN 'exact' WHEN p IS NOT NULL THEN 'hourly_close' ELSE 'missing' END AS perp_source, ln(coalesce(e, p) / fair) AS basis, coalesce(lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts - {DAY}) AS prev_ts FROM ex),
cf AS (SELECT c.*, coalesce(sum(b.close - 30) / 10000, 0) AS funding_short, count(b.ts) AS funding_hours FROM cb c LEFT JOIN bars b ON b.symbol = c.symbol AND b.ts > c.prev_ts AND b.ts <= c.ts GROUP BY ALL),
cv AS (SELECT *, (ts - prev_ts) // {HOUR} AS expected_hours, -(basis - lag(basis) OVER w) AS basis_pnl, coalesce(abs(basis) <= 1.5 AND abs(lag(basis) OVER w) <= 1.5 AND funding_hours = (ts - prev_ts) // {HOUR}, false) AS valid FROM cf WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
cd AS (SELECT *, basis_pnl + funding_short AS dn FROM cv)"""


def carry_panel(t):
    b = t.bars.where("symbol <> 'error'")
    days = b.groupBy("symbol", (F.floor(F.col("ts") / DAY) * DAY + 6 * HOUR).alias("ts")).agg(F.avg("close").alias("fair"))
    rates = b.select("symbol", "ts", ((F.col("close") - 30) / 10_000).alias("rate"))
    return C.carry_daily(days, b.where("trades % 2 = 1"), b, rates, ["symbol"], max_basis=1.5, width=BW)


@query("E19_carry_daily", use="bars", dbl="perp basis funding_short basis_pnl dn", sql=f"WITH {CARRY} SELECT symbol, ts, perp, perp_source, basis, funding_short, funding_hours, expected_hours, basis_pnl, valid, dn FROM cd")
def _(t):
    return carry_panel(t).select("symbol", "ts", "perp", "perp_source", "basis", "funding_short", "funding_hours", "expected_hours", "basis_pnl", "valid", "dn")


FLED = f"""{CARRY}, fp AS (SELECT *, lag(perp) OVER w AS pp, ln(fair / lag(fair) OVER w) AS sr FROM cd WINDOW w AS (PARTITION BY symbol ORDER BY ts)), fr AS (SELECT p.symbol, p.ts, max(b.high) / any_value(pp) - 1 AS rise FROM fp p JOIN bars b ON b.symbol = p.symbol AND b.ts >= p.prev_ts AND b.ts < p.ts GROUP BY 1, 2),
fq AS (SELECT fp.*, rise, coalesce(rise >= 1 / 0.1::DOUBLE - 0.05, false) AS dead FROM fp LEFT JOIN fr USING (symbol, ts)), fl AS (SELECT *, CASE WHEN dead THEN sr - 1 / 0.1::DOUBLE WHEN valid THEN dn END AS pnl, 0.0028::DOUBLE * (dead::INT + ((ts // {DAY}) % 7 = 0)::INT) AS cost FROM fq)"""


def fledger(t, panel=None):
    p = panel if panel is not None else carry_panel(t)
    return C.forward_ledger(p, t.bars, ["symbol"], leverage=0.1, max_leverage=10.0, round_trip=0.0028, cost_days=F.floor(F.col("ts") / DAY) % 7 == 0)


@query("E20_forward_ledger", use="bars", dbl="rise pnl_notional cost_notional roc roc_net", sql=f"WITH {FLED} SELECT symbol, ts, rise, dead AS liquidated, pnl AS pnl_notional, cost AS cost_notional, pnl / 11 AS roc, (pnl - cost) / 11 AS roc_net, pnl IS NOT NULL AS measured FROM fl")
def _(t):
    return fledger(t).select("symbol", "ts", "rise", "liquidated", "pnl_notional", "cost_notional", "roc", "roc_net", "measured")


@query("R23_proxy_calibration", use="bars", dbl="error_sd cumulative_error basis_mean basis_sd rho half_life_days", sql=f"""WITH {CARRY}, g AS (SELECT symbol, ts, basis, dn AS e, basis_pnl AS p, CASE WHEN lag(ts) OVER w = ts - {DAY} THEN lag(basis) OVER w END AS lb FROM cd WHERE valid WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
r AS (SELECT symbol, count(*) AS days, stddev_samp(e - p) AS error_sd, sum(e - p) AS cumulative_error, avg(basis) AS basis_mean, stddev_samp(basis) AS basis_sd, CASE WHEN count(lb) > 3 THEN corr(CASE WHEN lb IS NOT NULL THEN basis END, lb) END AS rho FROM g GROUP BY 1)
SELECT *, CASE WHEN rho > 0 AND rho < 1 THEN ln(0.5) / ln(rho) END AS half_life_days FROM r""")
def _(t):
    p = carry_panel(t)
    return C.proxy_calibration(p.withColumn("roc", F.col("dn")), p.withColumn("roc", F.col("basis_pnl")), ["symbol"])


PAIR = f"""fd AS (SELECT symbol, ts // {DAY} AS day, arg_min(open, ts) AS price FROM bars GROUP BY 1, 2), fr AS (SELECT symbol, ts // {DAY} AS day, sum((close - 27) / 10000) AS r FROM bars GROUP BY 1, 2),
pr AS (SELECT s.symbol || '/' || f.symbol AS pair, s.day, s.day * {DAY} AS ts, s.price AS S, f.price AS F, f.price * fr.r AS fq FROM fd s JOIN fd f ON s.day = f.day AND s.symbol = 'click' AND f.symbol IN ('view', 'signup', 'purchase') JOIN fr ON fr.symbol = f.symbol AND fr.day = f.day),
pd AS (SELECT * FROM (SELECT *, S - lag(S) OVER w AS dS, F - lag(F) OVER w AS dF FROM pr WINDOW w AS (PARTITION BY pair ORDER BY ts)) WHERE dS IS NOT NULL),
pq AS (SELECT *, 1000000 / first_value(S) OVER (PARTITION BY pair ORDER BY ts) AS q FROM pd), pf AS (SELECT *, q * (dS - dF) AS b0, q * fq AS f0 FROM pq),
ph AS (SELECT *, coalesce(last_value(CASE WHEN ann > 0.5 THEN 1 WHEN ann < 0.1 THEN 0 END IGNORE NULLS) OVER (PARTITION BY pair ORDER BY ts), 0) AS held FROM (SELECT *, CASE WHEN count(*) OVER w7 = 7 THEN sum(f0) OVER w7 / 1500000 * 365 / 7 END AS ann FROM pf WINDOW w7 AS (PARTITION BY pair ORDER BY ts ROWS 6 PRECEDING))),
pc AS (SELECT pair, ts, q, dF, held, CASE WHEN held = 1 THEN b0 ELSE 0 END AS basis_pnl, CASE WHEN held = 1 THEN f0 ELSE 0 END AS funding_pnl, (abs(held - lag(held, 1, 0) OVER w) + CASE WHEN lead(ts) OVER w IS NULL AND held = 1 THEN 1 ELSE 0 END) * 2400.0::DOUBLE AS cost, abs(held - lag(held, 1, 0) OVER w) AS flip FROM ph WINDOW w AS (PARTITION BY pair ORDER BY ts)),
pn AS (SELECT *, (basis_pnl + funding_pnl - cost) / 1500000 AS ret, 1500000 + sum(basis_pnl + funding_pnl - cost) OVER (PARTITION BY pair ORDER BY ts) AS nav FROM pc)"""


def pair_series(t):
    first = B.daily_first(t.bars, ["symbol"])
    rates = t.bars.groupBy("symbol", F.floor(F.col("ts") / DAY).alias("day")).agg(F.sum((F.col("close") - 27) / 10_000).alias("r"))
    s = first.where("symbol = 'click'").select("day", F.col("price").alias("S"))
    f = first.where("symbol IN ('view', 'signup', 'purchase')").join(rates, ["symbol", "day"]).select("symbol", "day", F.col("price").alias("F"), (F.col("price") * F.col("r")).alias("funding_per_q"))
    return s.join(f, "day").select(F.concat(F.lit("click/"), "symbol").alias("pair"), (F.col("day") * DAY).alias("ts"), "S", "F", "funding_per_q")


def pnl(t):
    return C.carry_pnl(pair_series(t), ["pair"], notional=1_000_000.0, cost_bp=24.0, enter=0.5, leave=0.1)


@query("E22_carry_pnl_daily", use="bars", dbl="basis_pnl funding_pnl cost ret nav", digits=4, sql=f"WITH {PAIR} SELECT pair, ts, held, basis_pnl, funding_pnl, cost, ret, nav FROM pn")
def _(t):
    return pnl(t).select("pair", "ts", "held", "basis_pnl", "funding_pnl", "cost", "ret", "nav")


@query("R22_perf_metrics", use="bars", dbl="ann_return ann_vol sharpe max_dd pct_pos_days total_cost_bp fund_received fund_paid pct_neg_funding_days", digits=4, sql=f"""WITH {PAIR}, d AS (SELECT *, (nav - max(nav) OVER (PARTITION BY pair ORDER BY ts)) / 1500000 AS dd FROM pn)
SELECT pair, count(*) AS n_days, avg(ret) * 365 AS ann_return, stddev_samp(ret) * sqrt(365) AS ann_vol, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) * 365 / (stddev_samp(ret) * sqrt(365)) END AS sharpe, min(dd) AS max_dd, avg((ret > 0)::INT) * 100 AS pct_pos_days, sum(flip)::BIGINT AS n_transitions, sum(cost) / 1500000 * 10000 AS total_cost_bp,
 sum(greatest(funding_pnl, 0)) AS fund_received, sum(least(funding_pnl, 0)) AS fund_paid, avg((funding_pnl < 0)::INT) * 100 AS pct_neg_funding_days FROM d GROUP BY 1""")
def _(t):
    return C.perf_metrics(pnl(t), ["pair"], capital=1_500_000.0)


@query("R22_yearly_performance", use="bars", dbl="ann_return sharpe", digits=4, sql=f"WITH {PAIR} SELECT pair, year(make_timestamp(ts * 1000)) AS yr, count(*) AS n_days, avg(ret) * 365 AS ann_return, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) * 365 / (stddev_samp(ret) * sqrt(365)) END AS sharpe FROM pn GROUP BY 1, 2 HAVING count(*) >= 2")
def _(t):
    return C.yearly_performance(pnl(t), ["pair"], F.year(F.timestamp_millis("ts")))


@query("E23_margin_breach_days", use="bars", dbl="max_additional_margin worst_margin", digits=3, sql=f"""WITH {PAIR}, m AS (SELECT pair, ts, 500000 - sum(q * dF) OVER (PARTITION BY pair ORDER BY ts) AS margin FROM pq)
SELECT pair, count(*) FILTER (margin < 250000) AS days_below, coalesce(max(CASE WHEN margin < 250000 THEN 250000 - margin END), 0) AS max_additional_margin, min(margin) AS worst_margin, arg_min(ts, (margin, ts)) AS worst_ts FROM m GROUP BY 1""")
def _(t):
    return C.margin_breaches(pair_series(t), ["pair"], notional=1_000_000.0)


@query("E24_threshold_hit_matrix", use="bars", dbl="m_over_n threshold", sql=f"""WITH d AS (SELECT symbol, ts // {DAY} AS day, greatest(max(high) / arg_min(open, ts) - 1, 0) AS loss FROM bars GROUP BY 1, 2)
SELECT symbol, m AS m_over_n, th AS threshold, count(*) FILTER (loss >= th * m * 1.0::DOUBLE) AS hit_count, count(*) AS total_intervals FROM d, (SELECT unnest([0.3, 3.0, 30.0]::DOUBLE[]) AS m), (SELECT unnest([0.5, 0.8, 1.0]::DOUBLE[]) AS th) GROUP BY 1, 2, 3""")
def _(t):
    d = t.bars.groupBy("symbol", F.floor(F.col("ts") / DAY).alias("day")).agg(F.greatest(F.max("high") / F.min_by("open", "ts") - 1, F.lit(0.0)).alias("loss")).withColumn("n", F.lit(1.0))
    return C.threshold_hits(d, ["symbol"], loss="loss", notional="n", margins=[0.3, 3.0, 30.0], thresholds=[0.5, 0.8, 1.0])


CLOCK = f"""dc AS (SELECT 'purchase' AS symbol, ts // {DAY} AS day, (ts // {DAY}) * {DAY} AS ts, arg_max(close, ts) AS close FROM bars b WHERE symbol = 'purchase' GROUP BY b.ts // {DAY}),
de AS (SELECT *, coalesce(close <= CASE WHEN count(close) OVER w >= 5 THEN quantile_cont(close, 0.4) OVER w END, false) AS event FROM dc WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wr AS (SELECT s.symbol, de.day, event, ln(x.open / s.open) AS ret FROM de JOIN bars s ON s.ts = de.ts + {5 * HOUR} JOIN bars x ON x.symbol = s.symbol AND x.ts = de.ts + {9 * HOUR})"""


@query("E25_window_return_by_clock", use="bars", dbl="mean_event mean_all diff hit_rate mean_event_after_cost", sql=f"""WITH {CLOCK} SELECT symbol, count(*) FILTER (event) AS events, count(*) AS days, avg(ret) FILTER (event) AS mean_event, avg(ret) AS mean_all, avg(ret) FILTER (event) - avg(ret) AS diff, avg((ret > 0)::INT) FILTER (event) AS hit_rate, avg(ret) FILTER (event) - 0.0028 AS mean_event_after_cost FROM wr GROUP BY 1""")
def _(t):
    d = B.daily_last(t.bars.where("symbol = 'purchase'"), ["symbol"], step=HOUR, complete_only=False).withColumn("ts", F.col("day") * DAY)
    ev = W.expanding_tail(d, ["symbol"], "close", 0.4, lower=True, min_history=5, width=365 * DAY).select("ts", "event")
    b = t.bars
    p = ev.join(b.select("symbol", (F.col("ts") - 5 * HOUR).alias("ts"), F.col("open").alias("a")), "ts").join(b.select("symbol", (F.col("ts") - 9 * HOUR).alias("ts"), F.col("open").alias("z")), ["symbol", "ts"])
    return Q.event_study(p.withColumn("ret", F.ln(F.col("z") / F.col("a"))), ["symbol"], ret="ret", event="event", cost=0.0014)


ES = f"""dd AS (SELECT symbol, date, epoch_ms(date::TIMESTAMP) AS ts, close FROM daily),
ev AS (SELECT *, coalesce(close <= CASE WHEN count(close) OVER w >= 50 THEN quantile_cont(close, 0.2) OVER w END, false) AS flag FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ep AS (SELECT ev.*, ln(f.close / ev.close) AS ret FROM ev JOIN dd f ON f.symbol = ev.symbol AND f.ts = ev.ts + {5 * DAY}), cn AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ep WHERE flag),
cg AS (SELECT symbol, ts, rn, true AS acc, ts + {5 * DAY} AS lim FROM cn WHERE rn = 1 UNION ALL SELECT cn.symbol, cn.ts, cn.rn, cn.ts >= cg.lim, CASE WHEN cn.ts >= cg.lim THEN cn.ts + {5 * DAY} ELSE cg.lim END FROM cg JOIN cn ON cn.symbol = cg.symbol AND cn.rn = cg.rn + 1),
es AS (SELECT ep.symbol, ep.date, ep.ts, ep.ret, coalesce(cg.acc, false) AS event FROM ep LEFT JOIN cg USING (symbol, ts))"""


def study_panel(t):
    d = day_ts(t.daily).select("symbol", "date", "ts", "close")
    f = W.expanding_tail(d, ["symbol"], "close", 0.2, lower=True, min_history=50, width=365 * DAY, out="flag")
    p = f.join(d.select("symbol", (F.col("ts") - 5 * DAY).alias("ts"), F.col("close").alias("_f")), ["symbol", "ts"]).withColumn("ret", F.ln(F.col("_f") / F.col("close"))).select("symbol", "date", "ts", "ret", "flag")
    from ..session import materialize
    p = materialize(p, "study")
    kept = E.cooldown_select(p.where("flag").select("symbol", "ts"), ["symbol"], 5 * DAY, width=365 * DAY).withColumn("event", F.lit(True))
    return p.join(kept, ["symbol", "ts"], "left").withColumn("event", F.coalesce("event", F.lit(False)))


@query("E26_event_study", use="daily", dbl="mean_event mean_all diff hit_rate mean_event_after_cost", sql=f"WITH RECURSIVE {ES} SELECT symbol, count(*) FILTER (event) AS events, count(*) AS days, avg(ret) FILTER (event) AS mean_event, avg(ret) AS mean_all, avg(ret) FILTER (event) - avg(ret) AS diff, avg((ret > 0)::INT) FILTER (event) AS hit_rate, avg(ret) FILTER (event) - 0.0014 AS mean_event_after_cost FROM es GROUP BY 1")
def _(t):
    return Q.event_study(study_panel(t), ["symbol"], ret="ret", event="event", cost=0.0007)


@query("E26_event_study_interval", use="daily", dbl="diff ci_low ci_high p_two_sided p_greater", sql=f"""WITH RECURSIVE {ES}, ci AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mo) - 1 AS _i, count(*) OVER (PARTITION BY symbol) AS _k FROM (SELECT symbol, strftime(date, '%Y-%m') AS mo, coalesce(sum(ret) FILTER (event), 0) AS ms, count(*) FILTER (event) AS mn, sum(ret) AS os, count(*) AS onn FROM es GROUP BY 1, 2)),
d AS (SELECT *, CASE WHEN mn > 0 THEN ms / mn END - os / onn AS x FROM {boot_sql('ci', 'symbol', 'es', 100, 'ms mn os onn')}),
b AS (SELECT symbol, quantile_cont(x, 0.025) AS ci_low, quantile_cont(x, 0.975) AS ci_high, least(2 * least((1 + count(*) FILTER (x <= 0)) / (count(x) + 1), (1 + count(*) FILTER (x >= 0)) / (count(x) + 1)), 1) AS p_two_sided, (1 + count(*) FILTER (x <= 0)) / (count(x) + 1) AS p_greater FROM d GROUP BY 1)
SELECT symbol, count(*) AS clusters, sum(mn)::BIGINT AS events, sum(ms) / sum(mn) - sum(os) / sum(onn) AS diff, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high, any_value(p_two_sided) AS p_two_sided, any_value(p_greater) AS p_greater FROM ci JOIN b USING (symbol) GROUP BY 1""")
def _(t):
    p = study_panel(t).withColumn("mo", F.date_format("date", "yyyy-MM"))
    return cluster_bootstrap_diff(p, ["symbol"], value="ret", member="event", cluster="mo", draws=100, seed="es")
