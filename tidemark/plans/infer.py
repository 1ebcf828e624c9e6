"""Inference and modelling queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import events as E
from ..operators import infer as R
from ..operators.asof import window_total
from ..operators.joins import interval_join
from ..operators.scan import previous
from ..session import DAY, HOUR
from .book import U, boot_sql
from .events import BW, COOL, EMB, HOLD, TRAIN0, ledger, outcome_sql
from .registry import query
from .windows import REG, day_ts, regimes

MONTH = "strftime(make_timestamp(detect_ts * 1000), '%Y-%m')"


def beta_sql(t: str, df: str) -> str:
    """Two-sided Student p by the power series of the regularised incomplete beta function, on the side where it converges
    fast."""
    y = f"({t} * {t} / ({df} + {t} * {t}))"

    def series(a: str, b: str, x: str) -> str:
        lx = f"ln(greatest({x}, 1e-300::DOUBLE))"
        front = f"exp({a} * {lx} + {b} * ln(greatest(1 - {x}, 1e-300::DOUBLE)) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})) / {a}"
        return f"({front} * list_sum([exp(lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * {lx}) FOR i IN range(0, 600)]))"

    half = f"(({df}) / 2.0::DOUBLE)"
    return f"CASE WHEN {t} IS NULL OR isnan({t}) OR NOT {df} > 0 THEN NULL WHEN {t} * {t} < {df} THEN 1 - {series('0.5::DOUBLE', half, y)} ELSE {series(half, '0.5::DOUBLE', f'(1 - {y})')} END"


def month(c: str = "detect_ts"):
    return F.date_format(F.timestamp_millis(c), "yyyy-MM")


@query("R1_fdr", use="order_events", dbl="p bh_q by_q", digits=9, sql="""
WITH t AS (SELECT strategy, family, year(make_timestamp(detect_ts * 1000)) AS yr, CASE WHEN count(*) % 5 <> 0 THEN avg((net_bp > 0)::INT) * 0.05 END AS p FROM order_events GROUP BY 1, 2, 3),
m AS (SELECT *, count(p) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p, strategy, yr) AS r FROM t),
q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(min(p * m / r) OVER (PARTITION BY family, p IS NULL ORDER BY r DESC), 1) END AS bh_q, sum(1 / r) OVER (PARTITION BY family, p IS NULL) AS h FROM m)
SELECT strategy, family, yr, p, bh_q, least(bh_q * h, 1) AS by_q FROM q""")
def _(t):
    p = t.order_events.groupBy("strategy", "family", F.year(F.timestamp_millis("detect_ts")).alias("yr")).agg(
        F.when(F.count("*") % 5 != 0, F.avg((F.col("net_bp") > 0).cast("int")) * 0.05).alias("p"))
    return R.fdr(p, ["family"], "p", by="by_q", tie=["strategy", "yr"])


CLUST = f"""c AS (SELECT strategy, {MONTH} AS mo, sum(net_bp) AS s, count(*) AS n FROM order_events GROUP BY 1, 2), m AS (SELECT strategy, sum(s) / sum(n) AS mean FROM c GROUP BY 1),
ci AS (SELECT c.*, mean, s - mean * n AS z, row_number() OVER (PARTITION BY strategy ORDER BY mo) - 1 AS _i, count(*) OVER (PARTITION BY strategy) AS _k FROM c JOIN m USING (strategy)),
d AS {boot_sql('ci', 'strategy', 'cb', 200, 's n')}, nd AS {boot_sql('ci', 'strategy', 'cb', 200, 'z n', 'null')}"""


@query("R2_cluster_bootstrap", use="order_events", dbl="mean ci_low ci_high p_mean_not_positive p_positive p_two_sided", sql=f"""WITH {CLUST},
b AS (SELECT strategy, quantile_cont(s / n, 0.025) AS ci_low, quantile_cont(s / n, 0.975) AS ci_high, (1 + count(*) FILTER (s / n <= 0)) / 201 AS p_mean_not_positive FROM d GROUP BY 1),
p AS (SELECT strategy, (1 + count(*) FILTER (z / n >= mean)) / 201 AS p_positive, (1 + count(*) FILTER (abs(z / n) >= abs(mean))) / 201 AS p_two_sided FROM nd JOIN m USING (strategy) GROUP BY 1)
SELECT strategy, mean, (SELECT sum(n)::BIGINT FROM c WHERE c.strategy = m.strategy) AS n, (SELECT count(*) FROM c WHERE c.strategy = m.strategy) AS clusters, ci_low, ci_high, p_mean_not_positive, p_positive, p_two_sided FROM m JOIN b USING (strategy) JOIN p USING (strategy)""")
def _(t):
    return R.cluster_bootstrap(t.order_events.withColumn("mo", month()), ["strategy"], value="net_bp", cluster="mo", draws=200, seed="cb")


@query("R3_cluster_bootstrap_diff", use="order_events", dbl="diff ci_low ci_high p_two_sided p_greater", sql=f"""
WITH ci AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mo) - 1 AS _i, count(*) OVER (PARTITION BY symbol) AS _k FROM (SELECT symbol, {MONTH} AS mo, coalesce(sum(net_bp) FILTER (family = 'A'), 0) AS ms, count(*) FILTER (family = 'A') AS mn, sum(net_bp) AS os, count(*) AS onn FROM order_events GROUP BY 1, 2)),
d AS (SELECT *, CASE WHEN mn > 0 THEN ms / mn END - os / onn AS x FROM {boot_sql('ci', 'symbol', 'cd', 200, 'ms mn os onn')}),
b AS (SELECT symbol, quantile_cont(x, 0.025) AS ci_low, quantile_cont(x, 0.975) AS ci_high, least(2 * least((1 + count(*) FILTER (x <= 0)) / (count(x) + 1), (1 + count(*) FILTER (x >= 0)) / (count(x) + 1)), 1) AS p_two_sided, (1 + count(*) FILTER (x <= 0)) / (count(x) + 1) AS p_greater FROM d GROUP BY 1)
SELECT symbol, count(*) AS clusters, sum(mn)::BIGINT AS events, sum(ms) / sum(mn) - sum(os) / sum(onn) AS diff, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high, any_value(p_two_sided) AS p_two_sided, any_value(p_greater) AS p_greater FROM ci JOIN b USING (symbol) GROUP BY 1""")
def _(t):
    d = t.order_events.withColumn("mo", month()).withColumn("m", F.col("family") == "A")
    return R.cluster_bootstrap_diff(d, ["symbol"], value="net_bp", member="m", cluster="mo", draws=200, seed="cd")


def block_sql(src: str, draws: int, block: int, seed: str) -> str:
    """Twin of the block bootstrap; ``src`` has symbol, ts, state, v."""
    return f"""b0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) = {DAY} THEN 0 ELSE 1 END AS gp FROM {src}),
b1 AS (SELECT *, sum(gp) OVER (PARTITION BY symbol ORDER BY ts) AS seg, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS _i, count(*) OVER (PARTITION BY symbol) AS n FROM b0),
b2 AS (SELECT *, count(*) OVER (PARTITION BY symbol, seg) AS len, min(_i) OVER (PARTITION BY symbol, seg) AS first, avg(v) OVER (PARTITION BY symbol, state) AS mean FROM b1),
b3 AS (SELECT symbol, n, draw, unnest(range(n)) AS b FROM (SELECT symbol, n, unnest(range({draws})) AS draw FROM b2 WHERE _i = 0)),
b4 AS (SELECT symbol, n, draw, b, {U.format(seed=f"'{seed}'", parts="symbol || ':' || draw || ':' || b || ':seg'", n='n')} AS _i FROM b3),
b5 AS (SELECT b4.*, b2.len, b2.first, least({block}, b2.len) AS w, {U.format(seed=f"'{seed}'", parts="b4.symbol || ':' || draw || ':' || b || ':start'", n='b2.len')} AS st FROM b4 JOIN b2 USING (symbol, _i)),
b6 AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY symbol, draw ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM b5),
b7 AS (SELECT symbol, draw, first, st, len, unnest(range(least(w, n - done)::BIGINT)) AS o FROM b6 WHERE done < n),
b8 AS (SELECT b7.symbol, draw, b2.state, avg(b2.v) AS bm, avg(b2.v - b2.mean) AS nm FROM b7 JOIN b2 ON b2.symbol = b7.symbol AND b2._i = b7.first + (b7.st + b7.o) % b7.len GROUP BY 1, 2, 3),
b9 AS (SELECT symbol, state, avg(v) AS mean, count(*) AS n FROM b2 GROUP BY 1, 2),
bx AS (SELECT symbol, state, any_value(b9.n) AS n, any_value(b9.mean) AS mean, quantile_cont(bm, 0.025) AS ci_low, quantile_cont(bm, 0.975) AS ci_high, stddev_samp(bm) AS draw_sd,
 least((1 + count(*) FILTER (abs(nm) >= abs(b9.mean))) / (count(*) + 1), 1) AS p_value, count(*) / {draws} AS valid_draw_share FROM b8 JOIN b9 USING (symbol, state) GROUP BY 1, 2)"""


@query("R4_block_bootstrap", use="daily", dbl="mean ci_low ci_high draw_sd p_value valid_draw_share", sql=f"WITH {REG}, s0 AS (SELECT symbol, ts, regime AS state, next_return AS v FROM reg WHERE regime IS NOT NULL AND next_return IS NOT NULL), {block_sql('s0', 2000, 5, 'bb')} SELECT * FROM bx")
def _(t):
    return R.block_bootstrap(regimes(t), ["symbol"], order="ts", value="next_return", state="regime", block=5, draws=2000, seed="bb")


T0, T1 = 1_704_067_200_000, 1_706_400_000_000


@query("R5_random_entry_null", use="bars", dbl="mean_bp null_percentile edge_bp", digits=4, sql=f"""WITH RECURSIVE {COOL}, {outcome_sql('ev', f'ts + {HOUR}', str(HOLD))}, real AS (SELECT symbol, count(*) AS n_events, avg(fwd * 10000 - 14) AS mean_bp FROM ox WHERE exit_ts IS NOT NULL GROUP BY 1),
u AS (SELECT symbol, draw, slot, {T0} + ('0x' || substr(md5('re:' || symbol || ':' || draw || ':' || slot), 1, 12))::BIGINT % {T1 - T0} AS t FROM (SELECT symbol, draw, unnest(range(n_events)) AS slot FROM (SELECT symbol, n_events, unnest(range(30)) AS draw FROM real))),
rb AS (SELECT u.symbol, draw, coalesce(b.ts, f.first) + {HOUR} AS dts FROM u ASOF LEFT JOIN bars b ON u.symbol = b.symbol AND u.t >= b.ts JOIN (SELECT symbol, min(ts) AS first FROM bars GROUP BY 1) f ON f.symbol = u.symbol),
ne AS (SELECT rb.*, b.ts AS ets, b.open AS epx FROM rb ASOF LEFT JOIN bars b ON rb.symbol = b.symbol AND rb.dts <= b.ts), nx AS (SELECT ne.*, b.open / epx - 1 AS f FROM (SELECT *, ets + {HOLD} AS xt FROM ne) ne ASOF JOIN bars b ON ne.symbol = b.symbol AND ne.xt <= b.ts),
nm AS (SELECT symbol, draw, avg(f * 10000 - 14) AS m FROM nx GROUP BY 1, 2)
SELECT symbol, n_events, mean_bp, count(*) FILTER (m < mean_bp) / count(*) * 100 AS null_percentile, mean_bp - avg(m) AS edge_bp FROM nm JOIN real USING (symbol) GROUP BY 1, 2, 3""")
def _(t):
    net = lambda d: d.where("status = 'complete'").withColumn("net_bp", S.net_return_bp("entry_px", "exit_px", F.lit("long")))
    real = net(ledger(t))
    counts = real.groupBy("symbol").agg(F.count("*").alias("n"))
    rnd = R.random_decisions(counts, t.bars, ["symbol"], n="n", draws=30, start=T0, end=T1, seed="re", width=BW).withColumn("decision_ts", F.col("ts") + HOUR)
    null = net(E.forward_outcome(rnd, t.bars, by=["symbol"], decision="decision_ts", delay=0, hold=HOLD, width=BW))
    return R.null_percentile(real, null, ["symbol"], value="net_bp")


PERM = 2000


@query("R6_permutation", use="daily", dbl="t_hac p_greater", sql=f"""WITH {REG}, p0 AS (SELECT symbol, ts, trend_return AS z, next_return AS y, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS p, count(*) OVER (PARTITION BY symbol) AS n FROM reg WHERE trend_return IS NOT NULL AND next_return IS NOT NULL),
p2 AS (SELECT symbol, z, p, unnest(range(-1, {PERM})) AS draw FROM p0), p3 AS (SELECT symbol, draw, z, row_number() OVER (PARTITION BY symbol, draw ORDER BY CASE WHEN draw >= 0 THEN md5('pm:' || symbol || ':' || draw || ':' || p) END, p) AS p FROM p2),
p4 AS (SELECT a.symbol, b.draw, a.p, a.n, b.z - avg(b.z) OVER w AS c, a.y - avg(a.y) OVER w AS y FROM p0 a JOIN p3 b ON a.symbol = b.symbol AND a.p = b.p WINDOW w AS (PARTITION BY a.symbol, b.draw)),
p5 AS (SELECT symbol, draw, sum(c * y) / sum(c * c) AS b, sum(c * c) AS s FROM p4 GROUP BY 1, 2), p6 AS (SELECT p4.symbol, p4.draw, p, n, b, c * (y - b * c) / s AS u FROM p4 JOIN p5 USING (symbol, draw)),
p7 AS (SELECT symbol, draw, any_value(n) AS n, any_value(b) AS b, sum(q) AS v FROM (SELECT *, u * u + {' + '.join(f"coalesce(2 * (1 - {l} / 6.0::DOUBLE) * u * lag(u, {l}) OVER (PARTITION BY symbol, draw ORDER BY p), 0)" for l in range(1, 6))} AS q FROM p6) GROUP BY 1, 2),
p8 AS (SELECT symbol, draw, n, CASE WHEN v > 0 THEN b / sqrt(v) END AS t FROM p7)
SELECT symbol, any_value(n) FILTER (draw = -1) AS n, any_value(t) FILTER (draw = -1) AS t_hac, count(*) FILTER (draw >= 0 AND t >= (SELECT r.t FROM p8 r WHERE r.symbol = p8.symbol AND r.draw = -1)) / {PERM} AS p_greater FROM p8 GROUP BY 1""")
def _(t):
    d = regimes(t).select("symbol", "ts", F.col("trend_return").alias("z"), F.col("next_return").alias("y"))
    return R.permuted_hac_t(d, ["symbol"], y="y", x="z", order="ts", lags=5, draws=PERM, seed="pm")


@query("R6_within_group_shuffle", use="equities", dbl="slope", sql="""WITH p0 AS (SELECT year(date) AS yr, code // 5 AS sector, code, date, ln(turnover) AS z, close AS y FROM equities),
p1 AS (SELECT *, row_number() OVER (PARTITION BY yr, sector ORDER BY date, code) AS p FROM p0), p2 AS (SELECT *, unnest(range(3)) AS draw FROM p1),
p3 AS (SELECT yr, sector, draw, z, row_number() OVER (PARTITION BY yr, sector, draw ORDER BY md5('ws:' || yr || ':' || sector || ':' || draw || ':' || p)) AS p FROM p2)
SELECT a.yr, a.draw, regr_slope(a.y, b.z) AS slope FROM p2 a JOIN p3 b ON a.yr = b.yr AND a.sector = b.sector AND a.draw = b.draw AND a.p = b.p GROUP BY 1, 2""")
def _(t):
    d = t.equities.select(F.year("date").alias("yr"), F.floor(F.col("code") / 5).alias("sector"), "code", "date", F.ln("turnover").alias("z"), F.col("close").alias("y"))
    m = R.permute(d, ["yr"], "z", order=["date", "code"], draws=3, seed="ws", within=["sector"])
    return m.groupBy("yr", "draw").agg(F.regr_slope("y", "z").alias("slope"))


@query("R7_welch_t", use="cross_section", dbl="mean_diff t_stat dof p_value", sql=f"""
WITH g AS (SELECT yr, count(y) FILTER (signal >= 3) AS n_top, count(y) FILTER (signal <= 1) AS n_bottom, avg(y) FILTER (signal >= 3) AS ma, avg(y) FILTER (signal <= 1) AS mb, var_samp(y) FILTER (signal >= 3) / count(y) FILTER (signal >= 3) AS va, var_samp(y) FILTER (signal <= 1) / count(y) FILTER (signal <= 1) AS vb FROM cross_section WHERE y IS NOT NULL GROUP BY 1)
SELECT yr, n_top, n_bottom, ma - mb AS mean_diff, (ma - mb) / sqrt(va + vb) AS t_stat, (va + vb) * (va + vb) / (va * va / (n_top - 1) + vb * vb / (n_bottom - 1)) AS dof,
 {beta_sql('((ma - mb) / sqrt(va + vb))', '((va + vb) * (va + vb) / (va * va / (n_top - 1) + vb * vb / (n_bottom - 1)))')} AS p_value FROM g""")
def _(t):
    return R.welch_t(t.cross.where("y IS NOT NULL"), ["yr"], "y", F.col("signal") >= 3, F.col("signal") <= 1)


def hac_sql(src: str, keys: str, y: str, x: str, order: str, lags: int, small: bool) -> str:
    """Twin of the one-regressor HAC slope with closed-form moments."""
    cap = f"least({lags}, n - {2 if small else 1})"
    terms = " + ".join(f"CASE WHEN {l} <= {cap} THEN coalesce(2 * (1 - {l} / ({cap} + 1)) * z * lag(z, {l}) OVER (PARTITION BY {keys} ORDER BY {order}), 0) ELSE 0 END" for l in range(1, lags + 1))
    return f"""hm AS (SELECT {keys}, count(*) AS n, sum({x}) AS sx, sum({x} * {x}) AS sxx, regr_slope({y}, {x}) AS hb_, regr_intercept({y}, {x}) AS ha_ FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {keys} HAVING count(*) >= {3 if small else 2}),
hz AS (SELECT s.*, hm.n, hm.hb_, ((n * {x} - sx) / (n * sxx - sx * sx)) * ({y} - ha_ - hb_ * {x}) AS z FROM {src} s JOIN hm USING ({keys}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
hq AS (SELECT *, z * z + {terms} AS q FROM hz),
hs AS (SELECT {keys}, any_value(n) AS n, any_value(hb_) AS estimate, sqrt(greatest(sum(q){' * any_value(n) / (any_value(n) - 2)' if small else ''}, 0)) AS se FROM hq GROUP BY {keys})"""


@query("R8_newey_west_slope", use="daily", dbl="estimate se t_hac p_value", sql=f"WITH {REG}, s0 AS (SELECT symbol, ts, trend_return AS x, next_return AS y FROM reg), {hac_sql('s0', 'symbol', 'y', 'x', 'ts', 5, True)} SELECT symbol, n, estimate, se, estimate / se AS t_hac, {beta_sql('(estimate / se)', '(n - 2)')} AS p_value FROM hs")
def _(t):
    d = regimes(t).select("symbol", "ts", F.col("trend_return").alias("x"), F.col("next_return").alias("y"))
    return R.ols_hac(d, ["symbol"], y="y", x=["x"], order="ts", lags=5, small_sample=True).where("term = 'x'").drop("term")


@query("R8_hac_mean", use="daily", dbl="mean se t_hac p_value", sql=f"""WITH {REG}, u AS (SELECT symbol, ts, next_return AS v, next_return - avg(next_return) OVER (PARTITION BY symbol) AS u FROM reg WHERE next_return IS NOT NULL),
q AS (SELECT symbol, v, u * u + {' + '.join(f'coalesce(2 * (1 - {l} / 5.0::DOUBLE) * u * lag(u, {l}) OVER (PARTITION BY symbol ORDER BY ts), 0)' for l in range(1, 5))} AS q FROM u),
g AS (SELECT symbol, count(*) AS n, avg(v) AS mean, sqrt(greatest(sum(q), 0)) / count(*) AS se, avg(v) / (sqrt(greatest(sum(q), 0)) / count(*)) AS t_hac FROM q GROUP BY 1) SELECT *, {beta_sql('t_hac', '(n - 1)')} AS p_value FROM g""")
def _(t):
    return R.hac_mean(regimes(t), ["symbol"], "next_return", order="ts", lags=4)


DEP = f"""{REG}, pr AS (SELECT a.symbol AS a, b.symbol AS b, a.ts, lead(a.close) OVER w / a.close - 1 AS x, lead(b.close) OVER w / b.close - 1 AS y, (lead(a.ts) OVER w - a.ts) / {DAY} AS days FROM dd a JOIN dd b ON a.ts = b.ts AND a.symbol < b.symbol WINDOW w AS (PARTITION BY a.symbol, b.symbol ORDER BY a.ts)),
la AS (SELECT pr.*, unnest(CASE WHEN r.regime IS NULL THEN ['all'] ELSE ['all', r.regime] END) AS label FROM pr LEFT JOIN (SELECT * FROM reg WHERE symbol = '1-URGENT') r ON r.ts = pr.ts - {DAY} WHERE x IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY a, b, label ORDER BY x) + (count(*) OVER (PARTITION BY a, b, label, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b, label ORDER BY y) + (count(*) OVER (PARTITION BY a, b, label, y) - 1) / 2 AS ry,
 x <= quantile_cont(x, 0.2) OVER g AS down, x <= quantile_cont(x, 0.1) OVER g AS xt, y <= quantile_cont(y, 0.1) OVER g AS yt FROM la WINDOW g AS (PARTITION BY a, b, label)), {hac_sql('rk', 'a, b, label', 'y', 'x', 'ts', 3, True)}"""


@query("R9_pairwise_dependence", use="daily", dbl="median_days max_days pearson spearman downside_corr lower_tail_probability joint_lower_tail_share lower_tail_lift hac_beta hac_se", sql=f"""WITH {DEP},
g AS (SELECT a, b, label, count(*) AS n_intervals, median(days) AS median_days, max(days) AS max_days, corr(x, y) AS pearson, corr(rx, ry) AS spearman, CASE WHEN count(*) FILTER (down) >= 10 THEN corr(CASE WHEN down THEN x END, CASE WHEN down THEN y END) END AS downside_corr,
 avg(yt::INT) FILTER (xt) AS lower_tail_probability, avg((xt AND yt)::INT) AS joint_lower_tail_share FROM rk GROUP BY 1, 2, 3)
SELECT a, b, label, n_intervals, median_days, max_days, CASE WHEN n_intervals >= 60 THEN pearson END AS pearson, CASE WHEN n_intervals >= 60 THEN spearman END AS spearman, CASE WHEN n_intervals >= 60 THEN downside_corr END AS downside_corr,
 CASE WHEN n_intervals >= 60 THEN lower_tail_probability END AS lower_tail_probability, CASE WHEN n_intervals >= 60 THEN joint_lower_tail_share END AS joint_lower_tail_share, CASE WHEN n_intervals >= 60 THEN estimate END AS hac_beta, CASE WHEN n_intervals >= 60 THEN se END AS hac_se,
 CASE WHEN n_intervals >= 60 THEN lower_tail_probability END / 0.1 AS lower_tail_lift FROM g LEFT JOIN hs USING (a, b, label)""")
def _(t):
    d = day_ts(t.daily).select(F.col("symbol").alias("name"), "ts", "close")
    return R.pairwise_dependence(d, regimes(t), anchor="1-URGENT", hac_lags=3, min_rows=60)


FM = """f0 AS (SELECT * FROM cross_section WHERE y IS NOT NULL),
f1 AS (SELECT yr, """ + ", ".join(f"quantile_cont({c}, {q}) AS {c}_lo, quantile_cont({c}, {1 - q}) AS {c}_hi" for c, q in (("signal", 0.01), ("c1", 0.01), ("c2", 0.01), ("y", 0.005))) + """ FROM f0 GROUP BY 1),
f2 AS (SELECT yr, sector, """ + ", ".join(f"greatest(least({c}, {c}_hi), {c}_lo) AS {c}" for c in ("signal", "c1", "c2", "y")) + """ FROM f0 JOIN f1 USING (yr)),
f3 AS (SELECT yr, sector, y, """ + ", ".join(f"({c} - avg({c}) OVER (PARTITION BY yr)) / stddev_pop({c}) OVER (PARTITION BY yr) AS {c}" for c in ("signal", "c1", "c2")) + """ FROM f2),
f4 AS (SELECT yr, """ + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY yr, sector) AS {v}" for c, v in (("signal", "s"), ("c1", "p"), ("c2", "q"), ("y", "y"))) + """ FROM f3),
f5 AS (SELECT yr, count(*) AS n, sum(s*s) AS ss, sum(s*p) AS sp, sum(s*q) AS sq, sum(p*p) AS pp, sum(p*q) AS pq, sum(q*q) AS qq, sum(s*y) AS sy, sum(p*y) AS py, sum(q*y) AS qy FROM f4 GROUP BY 1),
fm AS (SELECT yr, n, (sy*(pp*qq-pq*pq) - sp*(py*qq-pq*qy) + sq*(py*pq-pp*qy)) / (ss*(pp*qq-pq*pq) - sp*(sp*qq-pq*sq) + sq*(sp*pq-pp*sq)) AS slope FROM f5)"""


def slopes(t):
    return R.fama_macbeth_slopes(t.cross, week="yr", sector="sector", y="y", signal="signal", controls=["c1", "c2"], tail=0.01, tail_return=0.005, min_rows=30)


@query("R10_fama_macbeth", use="cross_section", dbl="slope", sql=f"WITH {FM} SELECT * FROM fm")
def _(t):
    return slopes(t)


@query("R10_fama_macbeth_mean", use="cross_section", dbl="mean se t_hac p_value", sql=f"""WITH {FM}, u AS (SELECT *, slope - avg(slope) OVER () AS u FROM fm), q AS (SELECT slope, u * u + coalesce(2 * 0.5::DOUBLE * u * lag(u) OVER (ORDER BY yr), 0) AS q FROM u),
g AS (SELECT 'signal' AS test, count(*) AS n, avg(slope) AS mean, sqrt(greatest(sum(q), 0)) / count(*) AS se, avg(slope) / (sqrt(greatest(sum(q), 0)) / count(*)) AS t_hac FROM q) SELECT *, {beta_sql('t_hac', '(n - 1)')} AS p_value FROM g""")
def _(t):
    return R.hac_mean(slopes(t).withColumn("test", F.lit("signal")), ["test"], "slope", order="yr", lags=1)


@query("R11_decile_spread", use="cross_section", dbl="decile_spread decile_top", sql="""
WITH r AS (SELECT yr, y, row_number() OVER (PARTITION BY yr ORDER BY c1, code) / count(*) OVER (PARTITION BY yr) AS k FROM cross_section WHERE y IS NOT NULL)
SELECT yr, count(*) AS n, avg(y) FILTER (k > 0.9) - avg(y) FILTER (k <= 0.1) AS decile_spread, avg(y) FILTER (k > 0.9) - avg(y) AS decile_top FROM r GROUP BY 1""")
def _(t):
    return R.decile_spread(t.cross, week="yr", signal="c1", y="y", tie="code")


@query("A29_book_return", use="cross_section", dbl="book_return", sql="SELECT yr, sum(y * weight) / sum(weight) AS book_return FROM cross_section WHERE y IS NOT NULL GROUP BY 1")
def _(t):
    return t.cross.where("y IS NOT NULL").groupBy("yr").agg(R.book_return("y", "weight").alias("book_return"))


@query("R12_book_alpha", use="equities", dbl="estimate se t_hac p_value", sql=f"""WITH e AS (SELECT code, epoch_ms(date::TIMESTAMP) AS ts, shares, turnover, ln(close / lag(close) OVER (PARTITION BY code ORDER BY date)) AS r FROM equities),
d AS (SELECT ts, sum(r * shares) / sum(shares) AS y, sum(r * turnover) / sum(turnover) AS m, avg(r) - sum(r * turnover) / sum(turnover) AS s FROM e WHERE r IS NOT NULL GROUP BY 1), a AS (SELECT count(*) AS n, avg(m) AS mm, avg(s) AS ms, avg(y) AS my FROM d),
c AS (SELECT sum((m - mm) * (m - mm)) AS mm2, sum((s - ms) * (s - ms)) AS ss2, sum((m - mm) * (s - ms)) AS msx, sum((m - mm) * (y - my)) AS mxy, sum((s - ms) * (y - my)) AS sxy FROM d, a),
b AS (SELECT *, mm2 * ss2 - msx * msx AS det, (mxy * ss2 - sxy * msx) / (mm2 * ss2 - msx * msx) AS bm, (sxy * mm2 - mxy * msx) / (mm2 * ss2 - msx * msx) AS bs FROM c),
z AS (SELECT d.*, n, mm, ms, bm, bs, my - bm * mm - bs * ms AS b0, (ss2 * (m - mm) - msx * (s - ms)) / det AS wm, (mm2 * (s - ms) - msx * (m - mm)) / det AS ws FROM d, a, b),
u AS (SELECT ts, n, unnest(['const', 'market', 'size']) AS term, unnest([b0, bm, bs]) AS estimate, unnest([1 / n - mm * wm - ms * ws, wm, ws]) * (y - b0 - bm * m - bs * s) AS u FROM z),
q AS (SELECT *, u * u + {' + '.join(f"coalesce(2 * (1 - {l} / 6.0::DOUBLE) * u * lag(u, {l}) OVER (PARTITION BY term ORDER BY ts), 0)" for l in range(1, 6))} AS q FROM u),
g AS (SELECT term, any_value(n) AS n, any_value(estimate) AS estimate, sqrt(greatest(sum(q), 0)) AS se, any_value(estimate) / sqrt(greatest(sum(q), 0)) AS t_hac FROM q GROUP BY 1)
SELECT 'long_book' AS k, *, {beta_sql('t_hac', '(n - 3)')} AS p_value FROM g""")
def _(t):
    e = day_ts(t.equities)
    p = previous(e, ["code"], ["ts"], None, ["close"]).withColumn("r", F.ln(F.col("close") / F.col("prev_close"))).where("r IS NOT NULL")
    d = p.groupBy("ts").agg(R.book_return("r", "shares").alias("book"), R.book_return("r", "turnover").alias("market"), F.avg("r").alias("equal"))
    d = d.withColumn("size", F.col("equal") - F.col("market")).withColumn("k", F.lit("long_book"))
    return R.ols_hac(d, ["k"], y="book", x=["market", "size"], order="ts", lags=5)


RES = """r0 AS (SELECT code, date, epoch_ms(date::TIMESTAMP) AS ts, ln(close / lag(close) OVER (PARTITION BY code ORDER BY date)) AS y, ln(turnover / lag(turnover) OVER (PARTITION BY code ORDER BY date)) AS x FROM equities)"""


def returns(t):
    e = previous(day_ts(t.equities), ["code"], ["ts"], None, ["close", "turnover"])
    return e.select("code", "date", "ts", F.ln(F.col("close") / F.col("prev_close")).alias("y"), F.ln(F.col("turnover") / F.col("prev_turnover")).alias("x"))


@query("R14_rolling_residual_z", use="equities", dbl="z", digits=5, sql=f"""WITH {RES}, k AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS xk, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y END AS yk FROM r0),
w AS (SELECT *, count(xk) OVER w AS n, regr_slope(yk, xk) OVER w AS b, regr_intercept(yk, xk) OVER w AS a, regr_syy(yk, xk) OVER w AS syy, regr_sxy(yk, xk) OVER w AS sxy FROM k WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT code, date, CASE WHEN n >= 30 AND x IS NOT NULL AND y IS NOT NULL AND syy - b * sxy > 0 THEN (y - a - b * x) / sqrt((syy - b * sxy) / (n - 2)) END AS z FROM w""")
def _(t):
    return R.rolling_residual_z(returns(t), ["code"], y="y", x=["x"], order="ts", window=60, min_obs=30, width=365 * DAY).select("code", "date", "z")


@query("R14_basket_signal", use="equities", dbl="signal", digits=5, sql=f"""WITH {RES}, k AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS xk, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y END AS yk FROM r0),
w AS (SELECT *, count(xk) OVER w AS n, regr_slope(yk, xk) OVER w AS b, regr_intercept(yk, xk) OVER w AS a, regr_syy(yk, xk) OVER w AS syy, regr_sxy(yk, xk) OVER w AS sxy FROM k WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT date, count(*) AS members, avg((y - a - b * x) / sqrt((syy - b * sxy) / (n - 2))) AS signal FROM w WHERE n >= 30 AND x IS NOT NULL AND y IS NOT NULL AND syy - b * sxy > 0 GROUP BY 1""")
def _(t):
    z = R.rolling_residual_z(returns(t), ["code"], y="y", x=["x"], order="ts", window=60, min_obs=30, width=365 * DAY).where("z IS NOT NULL")
    return z.groupBy("date").agg(F.count("*").alias("members"), F.avg("z").alias("signal"))


FC = f"""{REG}, f0 AS (SELECT symbol, ts, date, log_return AS x, ln(realized_vol) AS lv, lead(ln(realized_vol)) OVER (PARTITION BY symbol ORDER BY ts) AS yy FROM reg),
fk AS (SELECT *, x IS NOT NULL AND lv IS NOT NULL AND yy IS NOT NULL AS ok, CASE WHEN ok THEN lv END AS xk, CASE WHEN ok THEN x END AS zk, CASE WHEN ok THEN yy END AS yk FROM f0),
fw AS (SELECT *, count(xk) OVER w AS n, regr_slope(yk, xk) OVER w AS b, regr_intercept(yk, xk) OVER w AS a, regr_syy(yk, xk) OVER w AS syy, regr_sxy(yk, xk) OVER w AS sxy, avg(yk) OVER w AS my, var_samp(yk) OVER w AS vy,
 avg(xk) OVER w AS mx, avg(zk) OVER w AS mz, regr_sxx(yk, xk) OVER w AS sxx, regr_sxx(yk, zk) OVER w AS szz, regr_sxy(zk, xk) OVER w AS sxz, regr_sxy(yk, zk) OVER w AS szy FROM fk WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND {3 * DAY} PRECEDING)),
fb AS (SELECT *, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS b1, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS b2 FROM fw),
fo AS (SELECT symbol, ts, date, yy AS target, my AS pred_mean, vy AS s2_mean, a + b * lv AS pred_big, (syy - b * sxy) / (n - 2) AS s2_big, my + b1 * (lv - mx) + b2 * (x - mz) AS pred_two, (syy - b1 * sxy - b2 * szy) / (n - 3) AS s2_two FROM fb WHERE n >= 20 AND ok)"""


def forecasts(t):
    w = Window.partitionBy("symbol").orderBy("ts")  # daily series
    d = regimes(t).select("symbol", "ts", "date", F.col("log_return").alias("x"), F.ln("realized_vol").alias("lv")).withColumn("target", F.lead("lv").over(w))
    d = R.expanding_forecasts(d, ["symbol"], y="target", models={"big": ["lv"], "two": ["lv", "x"]}, ts="ts", horizon=3 * DAY, width=365 * DAY)
    return d.where("n_train >= 20 AND lv IS NOT NULL AND x IS NOT NULL AND target IS NOT NULL")


@query("R15_expanding_ols_forecast", use="daily", dbl="target pred_mean s2_mean pred_big s2_big pred_two s2_two", sql=f"WITH {FC} SELECT * FROM fo")
def _(t):
    return forecasts(t).select("symbol", "ts", "date", "target", "pred_mean", "s2_mean", "pred_big", "s2_big", "pred_two", "s2_two")


@query("R16_har_features", use="bars", dbl="rv_1d rv_7d fwd_vol low high", sql=f"""
WITH r AS (SELECT symbol, ts, CASE WHEN lag(ts) OVER w = ts - {HOUR} THEN pow(ln(close / lag(close) OVER w), 2) END AS r2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
d AS (SELECT DISTINCT symbol, (ts // {DAY}) * {DAY} AS t FROM bars),
v AS (SELECT d.symbol, d.t, count(r2) FILTER (r.ts > t - {DAY} AND r.ts <= t) AS n1, sum(r2) FILTER (r.ts > t - {DAY} AND r.ts <= t) AS s1, count(r2) FILTER (r.ts > t - {7 * DAY} AND r.ts <= t) AS n7, sum(r2) FILTER (r.ts > t - {7 * DAY} AND r.ts <= t) AS s7,
  count(r2) FILTER (r.ts > t AND r.ts <= t + {DAY}) AS nf, sum(r2) FILTER (r.ts > t AND r.ts <= t + {DAY}) AS sf FROM d JOIN r USING (symbol) GROUP BY 1, 2),
p AS (SELECT d.symbol, d.t, min(b.low) AS low, max(b.high) AS high FROM d JOIN bars b ON b.symbol = d.symbol AND b.ts >= t AND b.ts < t + {DAY} GROUP BY 1, 2)
SELECT symbol, t, CASE WHEN n1 >= 20 THEN sqrt(s1 * 365) END AS rv_1d, CASE WHEN n7 >= 140 THEN sqrt(s7 * 365 / 7) END AS rv_7d, CASE WHEN nf >= 20 THEN sqrt(sf * 365) END AS fwd_vol, low, high FROM v LEFT JOIN p USING (symbol, t)""")
def _(t):
    b = t.bars
    p = previous(b, ["symbol"], ["ts"], BW, ["ts", "close"])
    r = p.withColumn("r2", F.when(F.col("prev_ts") == F.col("ts") - HOUR, F.pow(F.ln(F.col("close") / F.col("prev_close")), F.lit(2)))).select("symbol", "ts", "r2")
    d = b.select("symbol", (F.floor(F.col("ts") / DAY) * DAY).alias("t")).distinct()
    spans = {"rv_1d": (-DAY, 0, 20, 1), "rv_7d": (-7 * DAY, 0, 140, 7), "fwd_vol": (0, DAY, 20, 1)}
    s = d.withColumn("k", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("a"), F.lit(z).alias("z"), F.lit(m).alias("need"), F.lit(y).alias("days")) for n, (a, z, m, y) in spans.items()])))
    s = s.select("symbol", "t", "k.name", "k.need", "k.days", (F.col("t") + F.col("k.a")).alias("start"), (F.col("t") + F.col("k.z")).alias("stop"))
    tot = window_total(s, r, by=["symbol"], start="start", stop="stop", value="r2", width=BW)
    vol = F.when(F.col("n") >= F.col("need"), F.sqrt(F.col("total") * 365 / F.col("days")))
    wide = tot.groupBy("symbol", "t").agg(*[F.max(F.when(F.col("name") == n, vol)).alias(n) for n in spans])
    path = interval_join(d.withColumn("e", F.col("t") + DAY), b.select("symbol", "ts", "low", "high"), by=["symbol"], start="t", stop="e").groupBy("symbol", "t").agg(
        F.min("bar_low").alias("low"), F.max("bar_high").alias("high"))
    return wide.join(path, ["symbol", "t"], "left")


@query("R17_clark_west", use="daily", dbl="cw_mean cw_t cw_p", sql=f"""WITH {FC}, c AS (SELECT symbol, ts, pow(target - pred_mean, 2) - (pow(target - pred_big, 2) - pow(pred_mean - pred_big, 2)) AS v FROM fo), u AS (SELECT *, v - avg(v) OVER (PARTITION BY symbol) AS u FROM c),
q AS (SELECT symbol, v, u * u + {' + '.join(f'coalesce(2 * (1 - {l} / 4.0::DOUBLE) * u * lag(u, {l}) OVER (PARTITION BY symbol ORDER BY ts), 0)' for l in range(1, 4))} AS q FROM u),
g AS (SELECT symbol, count(*) AS n, avg(v) AS cw_mean, avg(v) / (sqrt(greatest(sum(q), 0)) / count(*)) AS cw_t FROM q GROUP BY 1) SELECT *, 0.5 - sign(cw_t) * exp(-cw_t * cw_t / 2) / sqrt(2 * pi()) * list_sum([exp((2 * i + 1) * ln(greatest(abs(cw_t), 1e-300::DOUBLE)) - (i + 1) * ln(2) - lgamma(i + 1.5::DOUBLE) + 0.5::DOUBLE * ln(pi())) FOR i IN range(0, 200)]) AS cw_p FROM g""")
def _(t):
    return R.clark_west(forecasts(t), ["symbol"], y="target", small="pred_mean", big="pred_big", order="ts", lags=3)


@query("R17_oos_r2_qlike", use="daily", dbl="oos_r2 min_leave_one_r2 qlike_mean qlike_big", sql=f"""WITH {FC}, m AS (SELECT symbol, strftime(date, '%Y-%m') AS mo, sum(pow(target - pred_mean, 2)) AS a, sum(pow(target - pred_big, 2)) AS b FROM fo GROUP BY 1, 2), t AS (SELECT symbol, sum(a) AS ta, sum(b) AS tb FROM m GROUP BY 1),
l AS (SELECT symbol, mo, a, b, 1 - (tb - b) / (ta - a) AS r FROM m JOIN t USING (symbol)), g AS (SELECT symbol, min(r) AS min_leave_one_r2, arg_min(mo, (r, mo)) AS most_influential, count(*) FILTER (1 - b / a > 0) AS positive_periods, count(*) AS periods FROM l GROUP BY 1)
SELECT symbol, count(*) AS n, 1 - sum(pow(target - pred_big, 2)) / sum(pow(target - pred_mean, 2)) AS oos_r2, any_value(min_leave_one_r2) AS min_leave_one_r2, any_value(most_influential) AS most_influential, any_value(positive_periods) AS positive_periods, any_value(periods) AS periods,
 avg(exp(2 * target - 2 * pred_mean - 2 * s2_mean) - (2 * target - 2 * pred_mean - 2 * s2_mean) - 1) AS qlike_mean, avg(exp(2 * target - 2 * pred_big - 2 * s2_big) - (2 * target - 2 * pred_big - 2 * s2_big) - 1) AS qlike_big FROM fo JOIN g USING (symbol) GROUP BY 1""")
def _(t):
    f = forecasts(t).withColumn("mo", F.date_format("date", "yyyy-MM"))
    kw = dict(y="target", small="pred_mean", big="pred_big")
    q = f.groupBy("symbol").agg(R.qlike("target", "pred_mean", "s2_mean").alias("qlike_mean"), R.qlike("target", "pred_big", "s2_big").alias("qlike_big"))
    return R.oos_r2(f, ["symbol"], **kw).drop("sse_small", "sse_big").join(R.leave_one_out_r2(f, ["symbol"], "mo", **kw), "symbol").join(q, "symbol")


@query("R18_vol_target_overlay", use="daily", dbl="ann_return ann_vol sharpe mean_leverage max_leverage mean_turnover max_drawdown", digits=5, sql=f"""WITH {FC}, v AS (SELECT f.symbol, f.ts, greatest(least(2 / exp(pred_big + s2_big / 2), 4), 0) AS lev, r.next_return / 20 AS r FROM fo f JOIN reg r USING (symbol, ts)),
n AS (SELECT *, abs(lev - coalesce(lag(lev) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS tn, lev * r - 0.0007::DOUBLE * abs(lev - coalesce(lag(lev) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS net FROM v),
c AS (SELECT *, sum(ln(1 + net)) OVER (PARTITION BY symbol ORDER BY ts) AS lw FROM n WHERE net IS NOT NULL), d AS (SELECT *, exp(lw - greatest(max(lw) OVER (PARTITION BY symbol ORDER BY ts), 0)) - 1 AS dd FROM c)
SELECT symbol, count(*) AS periods, avg(net) * 365 AS ann_return, stddev_samp(net) * sqrt(365) AS ann_vol, avg(net) * sqrt(365) / stddev_samp(net) AS sharpe, avg(lev) AS mean_leverage, max(lev) AS max_leverage, avg(tn) AS mean_turnover, min(dd) AS max_drawdown FROM d GROUP BY 1""")
def _(t):
    f = forecasts(t).join(regimes(t).select("symbol", "ts", (F.col("next_return") / 20).alias("r")), ["symbol", "ts"])
    o = R.vol_target(f, ["symbol"], forecast=F.exp(F.col("pred_big") + F.col("s2_big") / 2), ret="r", order="ts", target=2.0, cap=4.0, cost=0.0007)
    return R.policy_summary(o, ["symbol"], order="ts", per_year=365.0)


def _side(part: str) -> str:
    p = part
    return f"""{p}c AS (SELECT strategy, fold_year, {MONTH} AS mo, sum(net_bp) AS s, count(*) AS n FROM sp WHERE part = '{p}' GROUP BY 1, 2, 3), {p}m AS (SELECT strategy, fold_year, sum(s) / sum(n) AS mean, sum(n)::BIGINT AS ev, count(*) AS mo FROM {p}c GROUP BY 1, 2),
{p}i AS (SELECT c.*, mean, s - mean * c.n AS z, row_number() OVER (PARTITION BY strategy, fold_year ORDER BY c.mo) - 1 AS _i, count(*) OVER (PARTITION BY strategy, fold_year) AS _k FROM {p}c c JOIN {p}m USING (strategy, fold_year)),
{p}d AS {boot_sql(f'{p}i', 'strategy, fold_year', f'wf-{p}', 100, 'z n', 'null')}, {p}p AS (SELECT strategy, fold_year, (1 + count(*) FILTER (z / n >= mean)) / 101 AS p FROM {p}d JOIN {p}m USING (strategy, fold_year) GROUP BY 1, 2),
{p}e AS (SELECT *, ev >= 50 AND mo >= 6 AS el, CASE WHEN ev >= 50 AND mo >= 6 THEN p END AS pe FROM {p}m JOIN {p}p USING (strategy, fold_year)),
{p}r AS (SELECT *, count(pe) OVER (PARTITION BY fold_year) AS m, row_number() OVER (PARTITION BY fold_year, pe IS NULL ORDER BY pe, strategy) AS r FROM {p}e),
{p}q AS (SELECT *, CASE WHEN pe IS NOT NULL THEN least(min(pe * m / r) OVER (PARTITION BY fold_year, pe IS NULL ORDER BY r DESC), 1) END AS bh, sum(1 / r) OVER (PARTITION BY fold_year, pe IS NULL) AS h FROM {p}r)"""


WF = f"""{EMB}, {_side('train')}, {_side('test')}, wf AS (SELECT strategy, fold_year, a.ev AS train_events, a.mo AS train_months, a.mean AS train_mean_bp, a.p AS train_p, a.el AS train_eligible, a.bh AS train_bh_q, least(a.bh * a.h, 1) AS train_by_q, b.ev AS test_events, b.mo AS test_months, b.mean AS test_mean_bp, b.p AS test_p,
 b.el AS test_eligible, b.bh AS test_bh_q, least(b.bh * b.h, 1) AS test_by_q, coalesce(a.el AND a.mean > 0 AND least(a.bh * a.h, 1) <= 0.9, false) AS primary_selection, coalesce(b.el AND b.mean > 0, false) AS oos_positive,
 coalesce(a.el AND a.mean > 0 AND least(a.bh * a.h, 1) <= 0.9 AND b.el AND b.mean > 0, false) AS oos_survives_selection, coalesce(b.el AND b.mean > 0 AND least(b.bh * b.h, 1) <= 0.9, false) AS oos_fdr_significant FROM trainq a LEFT JOIN testq b USING (strategy, fold_year))"""


def folds(t):
    s = E.embargo_split(t.order_events, ["strategy"], [1999, 2000], train_start=TRAIN0).withColumn("month", month())
    return R.walk_forward(s, keys=["strategy"], draws=100, seed="wf", min_train=(50, 6), min_test=(50, 6), alpha=0.9)


@query("R19_walk_forward_selection", use="order_events", dbl="train_mean_bp train_p train_bh_q train_by_q test_mean_bp test_p test_bh_q test_by_q", sql=f"WITH {WF} SELECT * FROM wf")
def _(t):
    return folds(t)


@query("A12_family_rollup", use="order_events", dbl="median_train_mean_bp median_test_mean_bp", sql=f"""WITH {WF} SELECT fold_year, split_part(strategy, '-', -1) AS family, count(*) AS variants, count(*) FILTER (train_eligible) AS eligible_train_variants, count(*) FILTER (test_eligible) AS eligible_test_variants, count(*) FILTER (primary_selection) AS selected_variants,
 count(*) FILTER (oos_survives_selection) AS selected_with_positive_test, count(*) FILTER (primary_selection AND oos_fdr_significant) AS selected_with_fdr_test, median(train_mean_bp) AS median_train_mean_bp, median(test_mean_bp) AS median_test_mean_bp FROM wf GROUP BY 1, 2""")
def _(t):
    return R.family_rollup(folds(t).withColumn("family", F.element_at(F.split("strategy", "-"), -1)), "family")


@query("R20_sign_stability", use="daily", dbl="slope slope_early slope_late slope_calm", sql=f"""WITH {REG}, d AS (SELECT symbol, trend_return AS x, next_return AS y, date < DATE '1998-06-01' AS e, month(date) <> 8 AS c FROM reg WHERE trend_return IS NOT NULL AND next_return IS NOT NULL),
g AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS slope, regr_slope(CASE WHEN e THEN y END, CASE WHEN e THEN x END) AS slope_early, regr_slope(CASE WHEN NOT e THEN y END, CASE WHEN NOT e THEN x END) AS slope_late, regr_slope(CASE WHEN c THEN y END, CASE WHEN c THEN x END) AS slope_calm FROM d GROUP BY 1)
SELECT *, sign(slope_early) = -1 AND sign(slope_late) = -1 AND sign(slope_calm) = -1 AS sign_stable FROM g""")
def _(t):
    early = F.col("date") < F.lit("1998-06-01").cast("date")
    return R.sign_stability(regimes(t), ["symbol"], y="next_return", x="trend_return", parts={"early": early, "late": ~early, "calm": F.month("date") != 8}, expected=-1)


@query("R21_serial_checks", use="daily", dbl="autocorr_1 autocorr_2 autocorr_3 autocorr_4", sql=f"""WITH {REG}, c AS (SELECT symbol, ts, next_return - avg(next_return) OVER (PARTITION BY symbol) AS c FROM reg WHERE next_return IS NOT NULL), l AS (SELECT symbol, c, {', '.join(f'lag(c, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS l{k}' for k in (1, 2, 3, 4))} FROM c)
SELECT symbol, count(*) AS n, {', '.join(f'sum(c * l{k}) / sum(c * c) AS autocorr_{k}' for k in (1, 2, 3, 4))} FROM l GROUP BY 1""")
def _(t):
    return R.autocorrelation(regimes(t), ["symbol"], "next_return", order="ts", lags=[1, 2, 3, 4])


@query("R21_block_intervals", use="daily", dbl="mean ci_low ci_high t_equivalent", sql=f"WITH {REG}, s0 AS (SELECT symbol, ts, 'all' AS state, next_return AS v FROM reg WHERE next_return IS NOT NULL), {block_sql('s0', 2000, 8, 'sc').replace('CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) = %d THEN 0 ELSE 1 END' % DAY, 'CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) = 1 THEN 1 ELSE 0 END')} SELECT symbol, n, mean, ci_low, ci_high, mean / draw_sd AS t_equivalent FROM bx")
def _(t):
    b = R.block_bootstrap(regimes(t), ["symbol"], order="ts", value="next_return", block=8, draws=2000, seed="sc", segments=False)
    return b.select("symbol", "n", "mean", "ci_low", "ci_high", (F.col("mean") / F.col("draw_sd")).alias("t_equivalent"))
