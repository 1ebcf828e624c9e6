"""Event ledgers, paths, scenarios, funding legs and book arithmetic: hand-checked numbers."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.functions import book as bk
from tidemark.operators import book as ob
from tidemark.operators import events as E
from tidemark.operators import flow as fl
from tidemark.operators import joins as J
from tidemark.operators import windows as W
from tidemark.session import HOUR, MINUTE


def bars(spark, data, cols="ts long, open double"):
    return spark.createDataFrame(data, cols).withColumn("k", F.lit(0))


@pytest.mark.parametrize("width", [700, 10**6])
def test_forward_outcome(spark, width):
    kw = dict(by=["k"], decision="d", delay=0, width=width)
    out = E.forward_outcome(bars(spark, [(2000,)], "d long"), bars(spark, [(1000, 10.0), (2000, 20.0), (3000, 30.0), (4000, 40.0)]), hold=1000, strict=True, **kw).first()
    assert (out.entry_ts, out.entry_px, out.exit_ts, out.exit_px, out.ret) == (3000, 30.0, 4000, 40.0, pytest.approx(1 / 3))
    gap = bars(spark, [(1000, 10.0), (2000, 20.0), (5000, 50.0), (9000, 90.0)])
    out = E.forward_outcome(bars(spark, [(1500,), (9500,), (6000,)], "d long"), gap, hold=3000, **kw)
    assert rows(out, "d", "entry_ts", "exit_ts", "ret", "status") == [(1500, 2000, 5000, 1.5, "complete"), (6000, 9000, None, None, "no_exit_bar"), (9500, None, None, None, "no_entry_bar")]


def test_leader_detection(spark):
    up = [100.0, 100.0, 101.0, 101.5] + [101.5] * 4
    d = bars(spark, [(i * MINUTE, c) for i, c in enumerate(up)], "ts long, close double")
    mv = W.complete_move(d, ["k"], 2, step=MINUTE, width=5 * MINUTE).where("abs(move_bp) >= 99.999")
    ev = E.refractory_select(mv, ["k"], step=MINUTE, refractory=3 * MINUTE, start=0, end=2**50, width=5 * MINUTE)
    assert [(r.ts // MINUTE, r.decision_ts // MINUTE, round(r.move_bp)) for r in ev.collect()] == [(2, 3, 100)]


def test_outcome_grid(spark):
    leader = bars(spark, [(m * MINUTE, 100.0, 100.0) for m in range(8)], "ts long, open double, close double").drop("k")
    follower = bars(spark, [(m * MINUTE, 50.0 + 0.5 * (m == 4), 50.0) for m in range(6)], "ts long, open double, close double").drop("k")
    ev = spark.createDataFrame([(2 * MINUTE, 3 * MINUTE, 1, 100.0)], "ts long, decision_ts long, direction int, window_bp double")
    g = E.outcome_grid(ev, leader, follower, window=2 * MINUTE, step=MINUTE, delays=[0], horizons=[1, 4, 90], cost_bp=14.0, end=60 * MINUTE)
    got = {r.horizon: (r.complete, r.reason, r.gross_bp and round(r.gross_bp), r.net_bp and round(r.net_bp)) for r in g.collect()}
    assert got == {1: (True, "", 100, 86), 4: (False, "missing_follower_bar", None, None), 90: (False, "exit_at_or_after_boundary", None, None)}


PATH = "ts long, open double, high double, low double, close double"


def path(spark, direction, bar, exit_open, stop=1000, take=1000):
    b = bars(spark, [(0, *bar), (MINUTE, exit_open, exit_open, exit_open, exit_open)], PATH)
    e = spark.createDataFrame([(1, direction, 0, MINUTE)], "id int, direction string, entry_ts long, exit_ts long").withColumn("k", F.lit(0))
    return E.path_metrics(e, b, by=["k"], step=MINUTE, stop_bp=stop, take_bp=take).first()


def test_paths(spark):
    s = path(spark, "short", (100.0, 110.0, 94.0, 105.0), 100.0, stop=5000, take=5000)
    assert (round(s.mae_bp), round(s.mfe_bp), s.underwater_bars, s.first_barrier) == (-1000, 600, 1, "none")
    assert path(spark, "long", (100.0, 111.0, 89.0, 100.0), 100.0).first_barrier == "ambiguous"
    g = path(spark, "long", (100.0, 101.0, 99.0, 100.0), 85.0)
    assert (g.first_barrier, g.barrier_ts, round(g.mae_bp), g.mae_ts) == ("stop_open", MINUTE, -1500, MINUTE)
    assert path(spark, "long", (100.0, 99.0, 98.0, 100.0), 85.0).reason == "invalid_ohlc_order"


def test_scenarios(spark):
    vols = bars(spark, [(m * MINUTE, 100_000.0) for m in range(200)], "ts long, quote_volume double")
    sc = [dict(scenario="base", notional=10_000.0, fee_bp=5.0, slippage_bp=2.0, impact_bp=0.0, max_participation=1.0)]
    ev = spark.createDataFrame([("a", 70 * MINUTE, 90 * MINUTE, 86.0), ("b", 30 * MINUTE, 90 * MINUTE, 86.0)], "event_id string, entry_ts long, exit_ts long, source_net_bp double").withColumn("k", F.lit(0))
    v = W.prior_volume_median(vols, ["k"], n=60, step=MINUTE, width=50 * MINUTE)
    led = E.reprice_scenarios(ev, v, sc, by=["k"])
    assert rows(led, "event_id", "scenario_net_bp", "source_implied_gross_bp", "execution_status") == [("a", 86.0, 100.0, "complete"), ("b", None, 100.0, "skipped_entry")]
    s = E.scenario_summary(led, event="event_id", reference="base").first()
    assert (s.events_input, s.events_complete, s.entry_unknown, s.net_result_label, s.common_set_delta_bp) == (2, 1, 1, "incomplete_overall_net", 0.0)


@pytest.mark.parametrize("entry,drop,want", [(8 * HOUR, None, (-0.2, 1)), (7 * HOUR, None, (0.0, 0)), (8 * HOUR, 8, (None, 0))])
def test_funding_leg(spark, entry, drop, want):
    exit_ = 9 * HOUR if entry == 8 * HOUR else 8 * HOUR
    f = spark.createDataFrame([(h * HOUR, 0.001, 8.0) for h in (0, 8, 16) if h != drop], "ts long, rate double, interval_hours double")
    p = spark.createDataFrame([(h * HOUR, 100.0) for h in range(20)], "ts long, open double")
    tr = spark.createDataFrame([(entry, exit_, 1)], "entry_ts long, exit_ts long, direction int")
    out = E.funding_leg(tr, f, p, interval=8 * HOUR, step=HOUR, quantity=2.0).first()
    assert out.funding_count == want[1]
    assert out.funding_pnl == (pytest.approx(want[0]) if want[0] is not None else None)


def test_basis_trade(spark):
    n = 200
    a = spark.createDataFrame([(m * MINUTE, 100.0, 100.0) for m in range(n)], "ts long, open double, close double")
    b = spark.createDataFrame([(m * MINUTE, 102.0 if m < 62 else 100.0, 102.0) for m in range(n)], "ts long, open double, close double")
    p = E.basis_panel(a, b, threshold_bp=50, step=MINUTE, width=30 * MINUTE)
    start = p.where("episode_start")
    assert [r.signal_ts for r in start.collect()] == [MINUTE]
    common = a.select("ts", F.col("open").alias("a_open")).join(b.select("ts", F.col("open").alias("b_open")), "ts")
    t = E.two_leg_entries(start.select("signal_ts", "basis_bp"), common, horizons=[HOUR], max_wait=5 * MINUTE, width=30 * MINUTE)
    led = E.two_leg_pnl(t.withColumn("a_funding_pnl", F.lit(0.0)).withColumn("b_funding_pnl", F.lit(0.0)), quantity=1.0, fee_bp=0.0, slippage_bp=0.0).first()
    assert (led.entry_ts, led.exit_ts, led.price_pnl, led.net_bp, led.status) == (2 * MINUTE, 62 * MINUTE, 2.0, pytest.approx(20000 / 202), "complete")


def book(spark, bids, asks, bid_cov=50.0, ask_cov=float("inf")):
    s = "struct<px:double,sz:double,n:int>"
    return spark.createDataFrame([(1, 0, [(*l, 1) for l in bids], [(*l, 1) for l in asks], bid_cov, ask_cov)], f"stream long, received_ms long, bids array<{s}>, asks array<{s}>, bid_cov double, ask_cov double")


def test_depth_and_impact(spark):
    b = book(spark, [(99.9, 10.0), (99.0, 10.0)], [(100.1, 10.0), (101.0, 10.0)])
    r = b.select(bk.depth_usd("ask", 50), bk.depth_usd("bid", 100), bk.impact_bp("ask", 1501), bk.impact_bp("bid", 1500), bk.book_problem()).first()
    assert r[0] == pytest.approx(1001) and r[1] is None and r[3] is None and r[4] is None
    assert r[2] == pytest.approx((1501 / (10 + 500 / 101) / 100 - 1) * 1e4)


def test_truncate(spark):
    b = book(spark, [(99.9, 1.0), (99.5, 1.0), (98.0, 1.0)], [(100.1, 1.0)], bid_cov=500.0)
    kept, cov = bk.truncate("bid", band_bp=100)
    two, cov2 = bk.truncate("bid", band_bp=100, max_levels=2)
    one, cov1 = bk.truncate("bid", max_levels=2)
    r = b.select(F.size(kept), cov, F.size(two), cov2, F.size(one), cov1).first()
    assert (r[0], r[1], r[2], r[3], r[4]) == (2, 100.0, 2, 100.0, 2) and r[5] == pytest.approx(50)


def test_walls(spark):
    bids = [(100 - 0.1 * i, 1.0) for i in range(1, 60) if i != 59] + [(94.1, 30.0)]
    b = book(spark, bids, [(100.1, 1.0)], bid_cov=float("inf"))
    rule = dict(band_bp=1000.0, multiple=10.0, min_usd=100.0)
    assert [r.px for r in ob.wall_rows(b, ["stream"], **rule).collect()] == [94.1]
    assert ob.wall_rows(b, ["stream"], min_share=0.9, **rule).count() == 0


def fold(rows_, **kw):
    base = dict(stream=1, side="bid", px=1.0, usd=100.0, is_wall=True, distance=50.0, next_distance=60.0, next_cov=1e9, next_crossed=False, **dict.fromkeys(ob._EPISODE))
    table = pa.Table.from_pylist([{**base, **r} for r in rows_])
    return [e for t in ob._fold(0.5, 150_000, 20.0, False)(table, np.array([0])) for e in t.to_pylist()]


def test_wall_episode_endings():
    two = [dict(ts=0, next_ts=60_000), dict(ts=60_000, next_ts=120_000)]
    e = fold(two)[0]
    assert (e["end_reason"], e["snapshots"], e["duration_sec"]) == ("removed_while_mid_away", 2, 60.0)
    assert fold([two[0], {**two[1], "next_crossed": True}])[0]["end_reason"] == "price_crossed"
    assert fold([two[0], {**two[1], "next_distance": 5.0}])[0]["end_reason"] == "removed_after_approach"
    assert fold([two[0], {**two[1], "next_cov": 10.0}])[0]["end_reason"] == "out_of_view"
    assert fold([dict(ts=0, next_ts=600_000), dict(ts=600_000, next_ts=None)])[0]["end_reason"] == "observation_gap"
    assert fold([dict(ts=0, next_ts=None)])[0]["end_reason"] == "censored_at_end"
    shrunk = fold([two[0], {**two[1], "is_wall": False, "usd": 40.0}])
    assert (shrunk[0]["snapshots"], shrunk[0]["end_ms"]) == (1, 60_000)


def test_latest_positions(spark):
    att = lambda *r: spark.createDataFrame(list(r), "user string, observed_ts long, status string")
    pos = spark.createDataFrame([("u", 1, "BTC", 5.0), ("legacy", 1, "BTC", 1.0), ("legacy", 2, "BTC", 2.0)], "user string, ts long, coin string, szi double")
    got = lambda a: rows(J.latest_positions(a, pos), "user", "szi")
    assert got(att(("u", 1, "success"), ("u", 2, "empty"))) == [("legacy", 2.0)]
    assert got(att(("u", 1, "success"), ("u", 2, "failure"))) == [("legacy", 2.0), ("u", 5.0)]


def test_decomposition_closes(spark):
    s = "user string, szi double, position_value double, liq_px double"
    old = spark.createDataFrame([("a", 1.0, 100.0, 98.5), ("gone", 1.0, 100.0, 98.5)], s)
    new = spark.createDataFrame([("a", 1.0, 100.0, 94.5)], s)
    new_same = spark.createDataFrame([("a", 1.0, 100.0, 98.5)], s)
    cohort = spark.createDataFrame([("a", True, False), ("gone", True, False)], "user string, common boolean, stale boolean")
    d = {r.bucket: r for r in fl.change_decomposition(old.where("user = 'a'"), spark.createDataFrame([("a", 1.0, 100.0, 94.9)], s).withColumn("liq_px", F.lit(98.5)), cohort, old_mid=F.lit(100.0), new_mid=F.lit(98.9)).collect()}
    assert (d["down:1"].mid_or_bin_change, d["down:0"].mid_or_bin_change) == (-100.0, 100.0)
    assert all(r.residual_notional == 0 and r.common_position_change_fixed_mid == 0 for r in d.values())
    g = fl.change_decomposition(old, new_same, cohort, old_mid=F.lit(100.0), new_mid=F.lit(100.0)).first()
    assert (g.common_position_change_fixed_mid, g.departures, g.residual_notional) == (-100.0, 0.0, 0.0)
    assert new.count() == 1


def test_paths_with_a_price_of_zero(spark):
    """Invalid by default; with ``positive=False`` a price like any other, and a move from it infinite."""
    b = bars(spark, [(MINUTE, 100.0, 110.0, 0.0, 105.0), (2 * MINUTE, 0.0, 1.0, 0.0, 1.0), (3 * MINUTE, 50.0, 50.0, 50.0, 50.0)], "ts long, open double, high double, low double, close double")
    e = bars(spark, [("a", MINUTE, 3 * MINUTE, "long"), ("b", 2 * MINUTE, 3 * MINUTE, "long")], "event_id string, entry_ts long, exit_ts long, direction string")
    kw = dict(by=["k"], step=MINUTE, stop_bp=5_000, take_bp=15_000)
    assert {r.reason for r in E.path_metrics(e, b, **kw).collect()} == {"invalid_ohlc"}
    got = {r.event_id: r for r in E.path_metrics(e, b, **kw, positive=False).collect()}
    assert (got["a"].reason, got["a"].mae_bp, got["a"].mae_ts, got["a"].first_barrier) == ("", -10_000.0, MINUTE, "stop_intrabar")
    assert (got["b"].reason, got["b"].mfe_bp) == ("", float("inf"))
    src = e.withColumn("source_entry_px", F.lit(None).cast("double")).withColumn("source_exit_px", F.lit(None).cast("double")).withColumn("source_net_bp", F.when(F.col("event_id") == "a", -5_014.0).otherwise(float("inf")))
    audit = dict(**kw, cutoff=10**9)
    assert {r.reason for r in E.path_audit(src, b, **audit, positive=False).collect()} == {""}
    assert {r.event_id: r.reason for r in E.path_audit(src, b, **audit).collect()}["a"] == "invalid_ohlc"


def test_book_steps_are_evaluated_once(spark):
    """A side's view and median are bound once for its levels; what several branches read comes from the shared folder."""
    assert spark.range(3).select(bk.let(F.rand(), lambda v: v - v).alias("x")).distinct().collect()[0].x == 0.0
    level = "array<struct<px double, sz double, n long>>".replace(" double", ":double").replace(" long", ":long")
    books = spark.createDataFrame([(1, t, 9e9, 9e9, [(99.0, 10.0, 1), (98.0, 50.0, 1), (97.0, 11.0, 1)], [(101.0, 10.0, 1)]) for t in (1_000, 2_000, 3_000)],
                                  f"stream long, received_ms long, bid_cov double, ask_cov double, bids {level}, asks {level}")
    rule = dict(band_bp=500.0, multiple=1.5, min_usd=1_000.0)
    assert rows(ob.wall_rows(books, ["received_ms"], **rule), "received_ms", "px", "median_level_usd") == [(t, 98.0, 97.0 * 11) for t in (1_000, 2_000, 3_000)]
    episodes = ob.wall_episodes(books, max_gap=5_000, width=10**6, **rule)
    assert episodes.inputFiles() and all("wall-books" in f for f in episodes.inputFiles())
    metrics = books.select("stream", F.col("received_ms").alias("tick_ms"), "received_ms", bk.mid().alias("mid"), F.lit(0.5).alias("imb"))
    fwd = ob.forward_mid(metrics, imbalance="imb", horizons=[1_000], edges=(-1.0, 0.0, 1.0), width=10**6)
    assert fwd.inputFiles() and all("forward-mid" in f for f in fwd.inputFiles())
    assert fwd.count() == 2
