"""Bars, causal windows and their future-mutation checks."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import assert_causal, rows
from tidemark.functions import scalar as S
from tidemark.operators import bars as B
from tidemark.operators import windows as W
from tidemark.session import DAY, HOUR, MINUTE


@pytest.fixture(scope="module")
def minutes(spark):
    data = [("s", i * MINUTE, 100.0 + (i * 37 % 23), 130.0, 90.0, 100.0 + (i * 53 % 29), 10.0, 7.0) for i in range(400) if i not in (77, 201, 202)]
    return spark.createDataFrame(data, "symbol string, ts long, open double, high double, low double, close double, quote_volume double, taker_buy_quote double").cache()


def test_daily_last_drops_partial_days(spark):
    data = [(1_000, 100.0), (DAY - MINUTE, 101.0), (2 * DAY - MINUTE, 102.0), (2 * DAY + 10_000, 103.0)]
    d = spark.createDataFrame(data, "ts long, close double").withColumn("k", F.lit(0))
    assert rows(B.daily_last(d, ["k"], step=MINUTE), "day", "close") == [(0, 101.0), (1, 102.0)]


def test_complete_hours_only(spark):
    data = [("full", h * MINUTE, 10.0, 7.0) for h in range(60)] + [("zero", h * MINUTE, 0.0, 0.0) for h in range(60)] + [("part", h * MINUTE, 10.0, 7.0) for h in range(59)]
    d = spark.createDataFrame(data, "market string, ts long, quote_volume double, taker_buy_quote double").withColumn("close", F.lit(1.0))
    r = B.resample_complete(d, ["market"], step=MINUTE, n=60).withColumn("i", S.taker_imbalance("taker_buy_quote", "quote_volume"))
    assert rows(r, "market", "ts", "i") == [("full", HOUR, 0.4), ("zero", HOUR, None)]
    assert rows(r.select("market", S.flow_state("quote_volume"))) == [("full", "classified"), ("zero", "unclassified_zero_volume")]


def test_bad_flow_nulls_volume(spark):
    data = [(h * MINUTE, 10.0, 11.0 if h == 3 else 7.0) for h in range(60)]
    d = spark.createDataFrame(data, "ts long, quote_volume double, taker_buy_quote double").withColumn("close", F.lit(1.0)).withColumn("k", F.lit(0))
    assert rows(B.resample_complete(d, ["k"], step=MINUTE, n=60), "bar_count", "quote_volume") == [(60, None)]


def test_zscore_excludes_current_row_and_restarts(spark):
    d = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0), (10, 9.0), (11, 9.5)], "ts long, x double").withColumn("k", F.lit(0))
    z = dict(rows(W.causal_zscore(d, ["k"], "x", 3, 2, step=1, width=2), "ts", "z"))
    assert z[2] == 3.0 and z[0] is None and z[10] is None and z[11] is None


@pytest.mark.parametrize("width", [20 * MINUTE, 10**9])
def test_causality(minutes, width):
    cut = 200 * MINUTE
    k = ["symbol"]
    assert_causal(lambda d: W.causal_zscore(d, k, "close", 30, 5, step=MINUTE, width=width), minutes, cut)
    assert_causal(lambda d: W.percentile_rank(d, k, "close", 40, width=width), minutes, cut)
    assert_causal(lambda d: W.trailing_zscore(d, k, "close", 40, 10, width=width), minutes, cut)
    assert_causal(lambda d: W.prior_volume_median(d, k, n=10, step=MINUTE, width=width), minutes, cut)
    assert_causal(lambda d: W.complete_move(d, k, 5, step=MINUTE, width=width), minutes, cut)
    assert_causal(lambda d: W.hysteresis(d, k, "close", 120, 105, width=width), minutes, cut)


def test_regime_is_causal(spark):
    d = spark.createDataFrame([("s", i * DAY, 100 + 9 * math.sin(i * 1.7) + i * 0.1) for i in range(60)], "symbol string, ts long, close double")
    op = lambda x: W.regime(x, ["symbol"], vol_days=3, trend_days=5, lookback=30, min_history=8, quantile=0.7, width=None).drop("next_return")
    assert_causal(op, d, 40 * DAY)
    assert op(d).where("regime IS NOT NULL").count() > 20


def test_missing_close_gives_no_move(minutes):
    m = {r.ts // MINUTE: r.move_bp for r in W.complete_move(minutes, ["symbol"], 3, step=MINUTE, width=50 * MINUTE).collect()}
    assert m[76] is not None and all(m[i] is None for i in (78, 79, 80)) and m[81] is not None


def test_hysteresis_matches_the_loop(minutes):
    held, state = {}, 0
    for r in sorted(minutes.collect(), key=lambda r: r.ts):
        state = 1 if state == 0 and r.close > 120 else 0 if state == 1 and r.close < 105 else state
        held[r.ts] = state
    assert dict(rows(W.hysteresis(minutes, ["symbol"], "close", 120, 105, width=30 * MINUTE), "ts", "held")) == held


def test_transitions_skip_missing_days(spark):
    d = spark.createDataFrame([(1, "A"), (2, "B"), (4, "C"), (5, "C")], "d long, s string").selectExpr("'x' AS symbol", f"d * {DAY} AS ts", "s")
    assert rows(W.transitions(d, ["symbol"], "s", step=DAY, width=None), "from_state", "to_state", "count") == [("A", "B", 1), ("C", "C", 1)]


def test_drawdown_peak_starts_at_one(spark):
    d = spark.createDataFrame([(0, -0.1), (1, 0.5), (2, -0.2)], "ts long, r double").withColumn("k", F.lit(0))
    assert W.max_drawdown(d, ["k"], "r", width=1).first().max_drawdown == pytest.approx(-0.2)


def test_densify_spans_parts(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("a", 23, 2.0)], "k string, ts long, v double")
    out = W.densify(d, ["k"], step=1, chunk=5)
    assert out.count() == 24 and out.where("v IS NOT NULL").count() == 2


@pytest.mark.parametrize("ms", [1_700_000_000_000, 1_700_000_000_000_000])
def test_epoch(spark, ms):
    assert spark.range(1).select(S.normalise_epoch(F.lit(ms))).first()[0] == 1_700_000_000_000


def test_labels(spark):
    one = spark.range(1)
    pick = lambda *c: tuple(one.select(*c).first())
    assert pick(S.decile_of(F.lit(0.0)), S.decile_of(F.lit(10.0)), S.decile_of(F.lit(10.1)), S.decile_of(F.lit(100.0))) == (0, 0, 1, 9)
    assert pick(S.asset_of(F.lit("btcusdt")), S.asset_of(F.lit("USDT"))) == ("BTC", "USDT")
    assert pick(S.liq_bin(F.lit(1.0), F.lit(99.0), F.lit(100.0)), S.liq_bin(F.lit(1.0), F.lit(101.0), F.lit(100.0)), S.liq_bin(F.lit(-1.0), F.lit(150.0), F.lit(100.0))) == ("down:1", None, "outside")
    assert pick(S.bias_label(F.lit(3.0), F.lit(1.0), "a", "b"), S.bias_label(F.lit(0.0), F.lit(0.0), "a", "b")) == ("a優勢(3.0倍)", "拮抗(データなし)")


@pytest.mark.parametrize("width", [100, 10**9])
def test_islands_number_rows_of_one_time_alike(spark, width):
    """Two rows of one time with unlike states: the order is that of ``tie``, the number that of the later one."""
    d = spark.createDataFrame([("k", 10, 3, "A"), ("k", 20, 2, "B"), ("k", 20, 1, "A"), ("k", 20, 4, "A"), ("k", 130, 5, "A"), ("k", 140, 6, "B")], "symbol string, ts long, event_id long, side string")
    out = W.islands(d, ["symbol"], width=width, gap=1_000, state="side", tie=["event_id"], peers=True)
    assert rows(out, "event_id", "island") == [(1, 3), (2, 3), (3, 1), (4, 3), (5, 3), (6, 4)]
    runs = W.run_lengths(d, ["symbol"], "side", gap=1_000, width=width, tie=["event_id"], peers=True)
    assert rows(runs, "side", "count", "runs", "max_contiguous") == [("A", 4, 2, 3), ("B", 2, 2, 1)]


def test_clip_position_at_zero_prices(spark):
    """A registered query's ratios to a zero open or low are infinite, as its SQL has them."""
    s = "a double, b double"
    d = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 0.0), (1.0, None)], s)
    got = [r[0] for r in d.select(S.ieee_divide(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [1.5, None, None]
    b = spark.createDataFrame([("s", 0, 1.0), ("s", 1, math.inf)], "symbol string, ts long, r double").withColumn("z", F.when(F.col("ts") == 1, math.inf).otherwise(0.0))
    assert rows(W.rule_pnl(b, ["symbol"], "z", "r", sign=-1, cost_bp=7, width=None), "ts", "position", "pnl")[1] == (1, -1.0, -math.inf)
