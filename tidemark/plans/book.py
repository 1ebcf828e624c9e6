"""Order-book queries."""

from pyspark.sql import functions as F

from ..functions import book as bk
from ..operators import book as ob
from ..operators.ordered import exact_quantiles
from ..session import DAY
from .registry import query

BANDS, NOTIONALS = (100, 180), (2000, 6000)
EDGES = (-1.0, -0.6, -0.2, 0.2, 0.6, 1.0)
TICK = 30 * DAY
BOOK_WIDTH = 365 * DAY
RULE = dict(band_bp=150.0, multiple=1.5, min_usd=1_000.0, min_share=0.0)

_bidcov = "CASE WHEN stream % 2 = 0 THEN 150.0::DOUBLE ELSE 'inf'::DOUBLE END"


def _depth(side: str, band: int) -> str:
    cov = _bidcov if side == "bid" else "'inf'::DOUBLE"
    return f"CASE WHEN {cov} >= {band} THEN coalesce(sum(px * sz) FILTER (side = '{side}' AND dist <= {band}), 0) END"


def _impact(side: str, q: int) -> str:
    sign = "(q.v / mid - 1)" if side == "ask" else "(1 - q.v / mid)"
    base = f"sum(greatest(least({q} - (cum - usd), usd), 0) / px) FILTER (side = '{side}')"
    vwap = f"{q} / ({base})"
    cost = f"({vwap} / any_value(mid) - 1)" if side == "ask" else f"(1 - {vwap} / any_value(mid))"
    return f"CASE WHEN coalesce(max(cum) FILTER (side = '{side}'), 0) >= {q} * (1 - 1e-9) THEN {cost} * 10000 END"


MET = f"""il AS (SELECT *, px * sz AS usd, sum(px * sz) OVER (PARTITION BY stream, tick_ms, side ORDER BY CASE WHEN side = 'bid' THEN -px ELSE px END) AS cum FROM levels WHERE dist <= cov),
im AS (SELECT stream, tick_ms, {', '.join(f"{_impact(s, q)} AS {d}_impact_bp_{q}" for q in NOTIONALS for d, s in (('buy', 'ask'), ('sell', 'bid')))} FROM il GROUP BY 1, 2),
de AS (SELECT stream, tick_ms, any_value(received_ms) AS received_ms, any_value(requested_ms) AS requested_ms, any_value(mid) AS mid, any_value((best_ask - best_bid) / mid * 10000) AS spread_bp,
 {', '.join(f"{_depth(s, b)} AS {s}_usd_{b}bp" for b in BANDS for s in ('bid', 'ask'))} FROM levels GROUP BY 1, 2),
mt AS (SELECT de.*, {', '.join(f"CASE WHEN bid_usd_{b}bp + ask_usd_{b}bp > 0 THEN (bid_usd_{b}bp - ask_usd_{b}bp) / (bid_usd_{b}bp + ask_usd_{b}bp) END AS imbalance_{b}bp" for b in BANDS)},
 im.* EXCLUDE (stream, tick_ms), received_ms - requested_ms AS latency_ms FROM de LEFT JOIN im USING (stream, tick_ms))"""
METRIC_COLS = ["mid", "spread_bp", *[f"{x}_{b}bp" for b in BANDS for x in ("bid_usd", "ask_usd", "imbalance")], *[f"{d}_impact_bp_{q}" for q in NOTIONALS for d in ("buy", "sell")]]


def metrics(t):
    return t.books.select("stream", "tick_ms", "received_ms", "requested_ms", (F.col("received_ms") - F.col("requested_ms")).alias("latency_ms"),
                          *bk.snapshot_metrics(BANDS, NOTIONALS))


@query("B1_levels_valid", use="book_levels", sql="""SELECT stream, tick_ms, count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (side = 'ask') AS asks, CASE WHEN count(DISTINCT side) < 2 THEN 'empty_side' WHEN max(px) FILTER (side = 'bid') >= min(px) FILTER (side = 'ask') THEN 'crossed_or_locked' END AS problem FROM book_levels GROUP BY 1, 2""")
def _(t):
    return t.all_books.select("stream", "tick_ms", F.size("bids").alias("bids"), F.size("asks").alias("asks"), bk.book_problem().alias("problem"))


@query("B2_B4_B5_B6_B8_snapshot_metrics", use="levels", dbl=" ".join(METRIC_COLS), digits=7, sql=f"WITH {MET} SELECT stream, tick_ms, {', '.join(METRIC_COLS)} FROM mt")
def _(t):
    return metrics(t).select("stream", "tick_ms", *METRIC_COLS)


@query("B3_truncate", use="levels", dbl="bid_coverage full_coverage", sql=f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY stream, tick_ms ORDER BY -px) AS k, count(*) OVER (PARTITION BY stream, tick_ms) AS cnt FROM levels WHERE side = 'bid' AND dist <= 120),
f AS (SELECT stream, tick_ms, arg_max(dist, dist) AS full_coverage FROM levels WHERE side = 'bid' GROUP BY 1, 2), c AS (SELECT stream, tick_ms, count(*) FILTER (k <= 3) AS kept, max(CASE WHEN k = 3 AND cnt > 3 THEN dist END) AS third FROM r GROUP BY 1, 2)
SELECT f.stream, f.tick_ms, coalesce(kept, 0) AS kept, least(120::DOUBLE, coalesce(third, 120)) AS bid_coverage, full_coverage FROM f LEFT JOIN c USING (stream, tick_ms)""")
def _(t):
    kept, cov = bk.truncate("bid", band_bp=120, max_levels=3)
    return t.books.select("stream", "tick_ms", F.size(kept).alias("kept"), cov.alias("bid_coverage"), bk.side_coverage_bp("bid", F.lit(False)).alias("full_coverage"))


WALL = """wi AS (SELECT *, px * sz AS usd FROM levels WHERE dist <= least(150::DOUBLE, cov)), ws AS (SELECT stream, tick_ms, side, count(*) AS n, median(usd) AS med, sum(usd) AS tot FROM wi GROUP BY 1, 2, 3),
wl AS (SELECT w.*, med, tot FROM wi w JOIN ws USING (stream, tick_ms, side) WHERE ws.n >= 3 AND usd >= greatest(1000, 1.5 * med))"""


@query("B7_walls", use="levels", dbl="px usd distance_bp share median_level_usd", digits=8, sql=f"WITH {WALL} SELECT stream, tick_ms, side, px, usd, dist AS distance_bp, usd / tot AS share, n AS orders, med AS median_level_usd FROM wl")
def _(t):
    return ob.wall_rows(t.books, ["stream", "tick_ms"], **RULE)


EPI = f"""{WALL}, sn AS (SELECT stream, tick_ms, received_ms AS ts, mid, best_bid, best_ask, lead(received_ms) OVER w AS nts, lead(mid) OVER w AS nmid, lead(best_bid) OVER w AS nbb, lead(best_ask) OVER w AS nba FROM (SELECT DISTINCT stream, tick_ms, received_ms, mid, best_bid, best_ask FROM levels) WINDOW w AS (PARTITION BY stream ORDER BY received_ms)),
lv AS (SELECT l.stream, l.side, l.px, s.ts, l.px * l.sz AS usd, l.dist, wl.px IS NOT NULL AS wall, nts, abs(l.px / nmid - 1) * 10000 AS nd, CASE WHEN l.side = 'bid' AND l.stream % 2 = 0 THEN 150.0::DOUBLE ELSE 'inf'::DOUBLE END AS nc,
  CASE WHEN l.side = 'bid' THEN nba <= l.px ELSE nbb >= l.px END AS ncr, row_number() OVER (PARTITION BY l.stream, l.side, l.px ORDER BY s.ts) AS rn FROM levels l JOIN sn s USING (stream, tick_ms) LEFT JOIN wl ON wl.stream = l.stream AND wl.tick_ms = l.tick_ms AND wl.side = l.side AND wl.px = l.px),
fo AS (SELECT *, wall AS act, wall::INT AS ep, CASE WHEN wall THEN usd END AS mx, false AS cont FROM lv WHERE rn = 1
 UNION ALL SELECT l.*, CASE WHEN f.act AND f.nts = l.ts AND l.ts - f.ts <= {2 * TICK} AND (l.wall OR l.usd >= 0.5 * f.mx) THEN true ELSE l.wall END, CASE WHEN f.act AND f.nts = l.ts AND l.ts - f.ts <= {2 * TICK} AND (l.wall OR l.usd >= 0.5 * f.mx) THEN f.ep ELSE f.ep + l.wall::INT END,
  CASE WHEN f.act AND f.nts = l.ts AND l.ts - f.ts <= {2 * TICK} AND (l.wall OR l.usd >= 0.5 * f.mx) THEN greatest(f.mx, l.usd) WHEN l.wall THEN l.usd END, f.act AND f.nts = l.ts AND l.ts - f.ts <= {2 * TICK} AND (l.wall OR l.usd >= 0.5 * f.mx)
  FROM fo f JOIN lv l ON l.stream = f.stream AND l.side = f.side AND l.px = f.px AND l.rn = f.rn + 1),
ea AS (SELECT stream, side, px, ep, min(ts) AS start_ms, max(ts) AS last_seen_ms, count(*) AS snapshots, arg_min(usd, ts) AS first_usd, arg_max(usd, ts) AS last_usd, max(usd) AS max_usd, arg_min(dist, ts) AS first_distance_bp, min(dist) AS min_distance_bp, arg_max(nts, ts) AS nts0, arg_max(nd, ts) AS nd, arg_max(nc, ts) AS nc, arg_max(ncr, ts) AS ncr, max(ts) AS lts,
  max(CASE WHEN nts IS NOT NULL THEN ts END) AS tn FROM fo WHERE act GROUP BY 1, 2, 3, 4),
ep AS (SELECT *, CASE WHEN tn IS NULL OR tn < lts THEN NULL ELSE nts0 END AS nts FROM ea),
es AS (SELECT stream, side, px, start_ms, last_seen_ms, CASE WHEN nts IS NULL OR nts - lts > {2 * TICK} THEN lts ELSE nts END AS end_ms, CASE WHEN nts IS NULL THEN 'censored_at_end' WHEN nts - lts > {2 * TICK} THEN 'observation_gap' WHEN ncr THEN 'price_crossed' WHEN nd > nc THEN 'out_of_view'
  WHEN least(min_distance_bp, nd) <= 20 THEN 'removed_after_approach' ELSE 'removed_while_mid_away' END AS end_reason, snapshots, first_usd, last_usd, max_usd, first_distance_bp, min_distance_bp, (last_seen_ms - start_ms) / 1000 AS duration_sec FROM ep)"""
EPD = "px first_usd last_usd max_usd first_distance_bp min_distance_bp duration_sec"


def episodes(t):
    return ob.wall_episodes(t.books, max_gap=2 * TICK, width=BOOK_WIDTH, **RULE)


@query("B9_wall_episodes", use="levels", dbl=EPD, digits=8, sql=f"WITH RECURSIVE {EPI} SELECT * FROM es")
def _(t):
    return episodes(t)


@query("A18_wall_summary", use="levels", dbl="duration_sec_p50 max_usd_p50 min_distance_bp_p50", digits=8, sql=f"WITH RECURSIVE {EPI} SELECT stream, side, end_reason, count(*) AS episodes, count(*) FILTER (snapshots >= 2) AS multi_snapshot_episodes, median(duration_sec) AS duration_sec_p50, median(max_usd) AS max_usd_p50, median(min_distance_bp) AS min_distance_bp_p50 FROM es GROUP BY 1, 2, 3")
def _(t):
    return ob.wall_summary(episodes(t))


FWD = f"""{MET}, mm AS (SELECT stream, tick_ms AS ts, mid, imbalance_100bp AS imb FROM mt), tol AS (SELECT stream, median(g) / 2 AS tol FROM (SELECT stream, ts - lag(ts) OVER (PARTITION BY stream ORDER BY ts) AS g FROM mm) GROUP BY 1),
q AS (SELECT mm.*, tol, horizon, ts + horizon AS target FROM mm JOIN tol USING (stream), (SELECT unnest([{TICK}, {3 * TICK}]) AS horizon)),
f1 AS (SELECT q.*, b.ts AS fts, b.mid AS fmid FROM q ASOF LEFT JOIN mm b ON q.stream = b.stream AND q.target <= b.ts), f2 AS (SELECT f1.*, b.ts AS bts, b.mid AS bmid FROM f1 ASOF LEFT JOIN mm b ON f1.stream = b.stream AND f1.target > b.ts),
f3 AS (SELECT *, CASE WHEN fts - target <= tol AND fts > ts THEN fts - target END AS fe, CASE WHEN target - bts <= tol AND bts > ts THEN target - bts END AS be FROM f2),
fw AS (SELECT stream, horizon, ts, imb, (CASE WHEN be IS NOT NULL AND (fe IS NULL OR be < fe) THEN bmid WHEN fe IS NOT NULL THEN fmid END / mid - 1) * 10000 AS fwd FROM f3),
fb AS (SELECT *, CASE WHEN imb < -0.6 THEN '[-1,-0.6)' WHEN imb < -0.2 THEN '[-0.6,-0.2)' WHEN imb < 0.2 THEN '[-0.2,0.2)' WHEN imb < 0.6 THEN '[0.2,0.6)' ELSE '[0.6,1]' END AS bin FROM fw WHERE fwd IS NOT NULL AND imb IS NOT NULL)"""


def fwd(t):
    return ob.forward_mid(metrics(t), imbalance="imbalance_100bp", horizons=[TICK, 3 * TICK], edges=EDGES, width=3650 * DAY)


@query("B10_imbalance_bins", use="levels", dbl="mean_fwd_bp median_fwd_bp share_up", sql=f"WITH {FWD} SELECT stream, horizon, bin, count(*) AS obs, count(DISTINCT ts // {DAY}) AS days, avg(fwd) AS mean_fwd_bp, median(fwd) AS median_fwd_bp, avg((fwd > 0)::INT) AS share_up FROM fb GROUP BY 1, 2, 3")
def _(t):
    return ob.imbalance_bins(fwd(t), ["stream", "horizon"])


@query("B10_rank_correlation", use="levels", dbl="rank_corr", sql=f"WITH {FWD}, r AS (SELECT stream, horizon, rank() OVER (PARTITION BY stream, horizon ORDER BY imb) + (count(*) OVER (PARTITION BY stream, horizon, imb) - 1) / 2 AS a, rank() OVER (PARTITION BY stream, horizon ORDER BY fwd) + (count(*) OVER (PARTITION BY stream, horizon, fwd) - 1) / 2 AS b FROM fb) SELECT stream, horizon, CASE WHEN count(*) > 2 THEN corr(a, b) END AS rank_corr FROM r GROUP BY 1, 2")
def _(t):
    from pyspark.sql import Window
    rank = lambda c: F.rank().over(Window.partitionBy("stream", "horizon").orderBy(c)) + (F.count("*").over(Window.partitionBy("stream", "horizon", c)) - 1) / 2
    r = fwd(t).select("stream", "horizon", rank("imbalance").alias("a"), rank("fwd_bp").alias("b"))  # one row per tick of a stream
    return r.groupBy("stream", "horizon").agg(F.when(F.count("*") > 2, F.corr("a", "b")).alias("rank_corr"))


U = "(('0x' || substr(md5({seed} || ':' || {parts}), 1, 8))::BIGINT % {n})"


def boot_sql(src: str, keys: str, seed: str, draws: int, sums: str, tag: str = "") -> str:
    """Twin of the cluster draws: ``src`` has keys, _i, _k and the sums."""
    parts = " || ':' || ".join(f"{k}::VARCHAR" for k in [*keys.split(", "), "draw", "slot"])
    pick = U.format(seed=f"'{seed}{tag}'", parts=parts, n="_k")
    total = ", ".join(f"sum({s}) AS {s}" for s in sums.split())
    return f"(SELECT {keys}, draw, {total} FROM (SELECT {keys}, draw, {pick} AS _i FROM (SELECT {keys}, _k, draw, unnest(range(_k)) AS slot FROM (SELECT {keys}, _k, unnest(range({draws})) AS draw FROM {src} WHERE _i = 0))) JOIN {src} USING ({keys}, _i) GROUP BY {keys}, draw)"


@query("B10_top_minus_bottom", use="levels", dbl="mean_fwd_bp ci_low ci_high", sql=f"""WITH {FWD}, cl AS (SELECT horizon, ts // {DAY} AS c, coalesce(sum(fwd) FILTER (bin = '[0.6,1]'), 0) AS ms, count(*) FILTER (bin = '[0.6,1]') AS mn, coalesce(sum(fwd) FILTER (bin = '[-1,-0.6)'), 0) AS os, count(*) FILTER (bin = '[-1,-0.6)') AS onn FROM fb WHERE bin IN ('[0.6,1]', '[-1,-0.6)') GROUP BY 1, 2),
ci AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY c) - 1 AS _i, count(*) OVER (PARTITION BY horizon) AS _k FROM cl), dr AS {boot_sql('ci', 'horizon', 'imb', 100, 'ms mn os onn')},
cb AS (SELECT horizon, quantile_cont(ms / mn - os / onn, 0.025) AS ci_low, quantile_cont(ms / mn - os / onn, 0.975) AS ci_high FROM dr WHERE mn > 0 AND onn > 0 GROUP BY 1)
SELECT horizon, count(*) AS obs, count(DISTINCT ts // {DAY}) AS days, avg(fwd) FILTER (bin = '[0.6,1]') - avg(fwd) FILTER (bin = '[-1,-0.6)') AS mean_fwd_bp, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high,
 CASE WHEN any_value(ci_low) > 0 THEN 'ci_above_zero' WHEN any_value(ci_high) < 0 THEN 'ci_below_zero' ELSE 'ci_includes_zero' END AS status FROM fb JOIN cb USING (horizon) GROUP BY 1""")
def _(t):
    return ob.top_minus_bottom(fwd(t), ["horizon"], top="[0.6,1]", bottom="[-1,-0.6)", draws=100, seed="imb", min_days=5, min_obs=20)


@query("B11_cross_venue", use="levels", dbl="a_p50 b_p50 diff_p50 a_better_share", sql=f"""WITH {MET}, v AS (SELECT s_nationkey AS asset, tick_ms, stream % 3 AS venue, arg_min(buy_impact_bp_2000, (received_ms, stream)) FILTER (buy_impact_bp_2000 IS NOT NULL) AS v1, first(buy_impact_bp_2000 ORDER BY received_ms, stream) AS v FROM mt JOIN supplier ON s_suppkey = stream GROUP BY 1, 2, 3)
SELECT a.asset, a.venue AS a, b.venue AS b, count(*) AS common_ticks, median(a.v) AS a_p50, median(b.v) AS b_p50, median(a.v - b.v) AS diff_p50, avg((a.v - b.v < 0)::INT) AS a_better_share FROM v a JOIN v b ON a.asset = b.asset AND a.tick_ms = b.tick_ms AND a.venue < b.venue WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    m = metrics(t).join(t.table("supplier").select(F.col("s_suppkey").alias("stream"), F.col("s_nationkey").alias("asset")), "stream")
    return ob.cross_venue(m.withColumn("venue", F.col("stream") % 3), asset="asset", venue="venue", tick="tick_ms", value="buy_impact_bp_2000", relative=False)


@query("B11_mid_premium", use="levels", dbl="a_p50 b_p50 diff_p50 a_better_share", sql="""WITH m AS (SELECT DISTINCT stream, tick_ms, received_ms, mid FROM levels), v AS (SELECT s_nationkey AS asset, tick_ms, stream % 3 AS venue, first(mid ORDER BY received_ms, stream) AS v FROM m JOIN supplier ON s_suppkey = stream GROUP BY 1, 2, 3)
SELECT a.asset, a.venue AS a, b.venue AS b, count(*) AS common_ticks, median(a.v) AS a_p50, median(b.v) AS b_p50, median((a.v / b.v - 1) * 10000) AS diff_p50, avg(((a.v / b.v - 1) * 10000 < 0)::INT) AS a_better_share FROM v a JOIN v b ON a.asset = b.asset AND a.tick_ms = b.tick_ms AND a.venue < b.venue GROUP BY 1, 2, 3""")
def _(t):
    m = t.books.select("stream", "tick_ms", "received_ms", bk.mid().alias("mid")).join(t.table("supplier").select(F.col("s_suppkey").alias("stream"), F.col("s_nationkey").alias("asset")), "stream")
    return ob.cross_venue(m.withColumn("venue", F.col("stream") % 3), asset="asset", venue="venue", tick="tick_ms", value="mid", relative=True)


@query("B12_largest_levels", use="levels", dbl="px usd bid_range_bp", sql="""WITH r AS (SELECT stream, tick_ms, px, px * sz AS usd, row_number() OVER (PARTITION BY stream, tick_ms ORDER BY px * sz DESC, px) AS rank, max(dist) OVER (PARTITION BY stream, tick_ms) AS bid_range_bp FROM levels WHERE side = 'bid') SELECT * FROM r WHERE rank <= 3""")
def _(t):
    return t.books.select("stream", "tick_ms", bk.visible_range_bp("bid").alias("bid_range_bp"), F.posexplode(bk.largest_levels("bid")).alias("rank", "l")) \
        .select("stream", "tick_ms", "l.px", "l.usd", (F.col("rank") + 1).alias("rank"), "bid_range_bp")


_hi = lambda c, q: f"CASE WHEN ceil({q} * (count(*) - 1)) < count({c}) THEN list_sort(list({c}) FILTER ({c} IS NOT NULL))[ceil({q} * (count(*) - 1))::INT + 1] END"
_cq = lambda c, q: f"CASE WHEN count({c}) = count(*) THEN quantile_cont({c}, {q}) END"
SUM_D = ["spread_bp_p50", "spread_bp_p90", "latency_ms_p50", *[f"{s}_usd_{b}bp_p{q}" for b in BANDS for s in ("bid", "ask") for q in (50, 10)], *[f"depth_known_share_{b}bp" for b in BANDS],
         *[f"{d}_impact_bp_{n}_p{q}" for n in NOTIONALS for d in ("buy", "sell") for q in (50, 90)], *[f"{d}_known_share_{n}" for n in NOTIONALS for d in ("buy", "sell")]]
SUMSQL = ", ".join([f"{_cq('spread_bp', 0.5)} AS spread_bp_p50", f"{_cq('spread_bp', 0.9)} AS spread_bp_p90", f"{_cq('latency_ms', 0.5)} AS latency_ms_p50",
                    *[f"{_cq(f'{s}_usd_{b}bp', q / 100)} AS {s}_usd_{b}bp_p{q}" for b in BANDS for s in ("bid", "ask") for q in (50, 10)],
                    *[f"avg((bid_usd_{b}bp IS NOT NULL AND ask_usd_{b}bp IS NOT NULL)::INT) AS depth_known_share_{b}bp" for b in BANDS],
                    *[f"{_hi(f'{d}_impact_bp_{n}', q / 100)} AS {d}_impact_bp_{n}_p{q}" for n in NOTIONALS for d in ("buy", "sell") for q in (50, 90)],
                    *[f"avg(({d}_impact_bp_{n} IS NOT NULL)::INT) AS {d}_known_share_{n}" for n in NOTIONALS for d in ("buy", "sell")]])


@query("A16_A17_stream_summary", use="levels", dbl=" ".join(SUM_D), digits=8, sql=f"WITH {MET} SELECT stream, count(*) AS snapshots, min(received_ms) AS first_ms, max(received_ms) AS last_ms, {SUMSQL} FROM mt GROUP BY 1")
def _(t):
    return ob.stream_summary(metrics(t), ["stream"], bands=BANDS, notionals=NOTIONALS)


@query("A17_by_hour", use="levels", dbl="spread_bp bid_usd_100bp ask_usd_100bp buy_impact_bp_2000", digits=8, sql=f"WITH {MET} SELECT stream % 8 AS grp, hour(make_timestamp(received_ms * 1000)) AS hour_utc, count(*) AS snapshots, {_cq('spread_bp', 0.5)} AS spread_bp, {_cq('bid_usd_100bp', 0.5)} AS bid_usd_100bp, {_cq('ask_usd_100bp', 0.5)} AS ask_usd_100bp, {_hi('buy_impact_bp_2000', 0.5)} AS buy_impact_bp_2000 FROM mt GROUP BY 1, 2")
def _(t):
    return ob.by_hour(metrics(t).withColumn("grp", F.col("stream") % 8), ["grp"], depth=["bid_usd_100bp", "ask_usd_100bp"], impact=["buy_impact_bp_2000"])


@query("A37_latency_quantiles", use="levels", dbl="p10 p50 p90 p99", sql="""WITH m AS (SELECT DISTINCT stream, tick_ms, received_ms - requested_ms AS l FROM levels) SELECT stream % 3 AS venue, quantile_cont(l, 0.1) AS p10, quantile_cont(l, 0.5) AS p50, quantile_cont(l, 0.9) AS p90, quantile_cont(l, 0.99) AS p99 FROM m GROUP BY 1""")
def _(t):
    m = t.books.select((F.col("stream") % 3).alias("venue"), (F.col("received_ms") - F.col("requested_ms")).cast("double").alias("latency"))
    return exact_quantiles(m, ["venue"], "latency", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})
