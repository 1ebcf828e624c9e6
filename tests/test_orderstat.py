"""Order statistics of moving and growing windows against sorted lists; scans counted on the plan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, orderstat
from tidemark.operators import windows as W


def test_count_below():
    rnd = random.Random(2)
    for window in (1, 2, 3, 7, 16, 50, 500):
        values = np.array([rnd.choice([np.nan, rnd.randint(0, 9), rnd.random()]) for _ in range(120)])
        below, known = orderstat.count_below(values, window)
        for i, v in enumerate(values):
            past = values[max(0, i - window) : i]
            past = past[~np.isnan(past)]
            assert known[i] == len(past)
            assert below[i] == (0 if np.isnan(v) else (past < v).sum())


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(6)
    data = [(k, t, rnd.choice([None, rnd.randint(0, 5) / 1.0, rnd.gauss(0, 100)]), "x", t) for k in ("a", None) for t in sorted(rnd.sample(range(900), 200))]
    return spark.createDataFrame(data, "k string, ts long, v double, _row string, _n long").cache()


def want_quantiles(rows, q, least):
    seen, out = {}, {}
    for r in sorted(rows, key=lambda r: r.ts):
        past = sorted(seen.setdefault(r.k, []))
        out[r.k, r.ts] = float(np.quantile(past, q)) if len(past) >= least else None
        if r.v is not None:
            seen[r.k].append(r.v)
    return out


@pytest.mark.parametrize("width", [7, 60, 400, None])
@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.93, 1.0])
def test_expanding_quantile(series, width, q):
    plain = series.drop("_row", "_n")
    got = {(r.k, r.ts): r.t for r in orderstat.expanding_quantile(plain, ["k"], "v", q, min_history=4, width=width, out="t").collect()}
    want = want_quantiles(plain.collect(), q, 4)
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert got[key] == (None if w is None else pytest.approx(w, rel=1e-12, abs=1e-12)), key


@pytest.mark.parametrize("block", [10, 1000])
def test_ranked_rows_in_blocks(series, block):
    plain = series.drop("_row", "_n")
    got = {(r.k, r.ts): (r._below, r._known) for r in orderstat.ranked_rows(plain, ["k"], "v", 9, width=50, block=block).collect()}
    past = {}
    for r in sorted(plain.collect(), key=lambda r: r.ts):
        own = [x for x in past.setdefault(r.k, [])[-9:] if x is not None]
        assert got[r.k, r.ts] == (0 if r.v is None else sum(x < r.v for x in own), len(own))
        past[r.k].append(r.v)


def scans(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan")


def test_fused_scans_read_their_source_twice_at_most(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.range(100).select((F.col("id") % 3).alias("k"), (F.col("id") * 10).alias("ts"), F.sin("id").alias("v"), F.col("id").alias("i")).write.parquet(path)
    s = spark.read.parquet(path)
    assert scans(W.max_drawdown(s, ["k"], "v", width=100)) == 1
    assert scans(W.both_drawdowns(s, ["k"], "v", width=100)) == 1
    assert scans(W.islands(s, ["k"], width=100, gap=30)) == 2
    assert scans(W.local_drawdown(s, ["k"], "v", width=100)) == 2
    assert scans(W.transition_cost(s.withColumn("held", (F.col("i") % 2).cast("int")), ["k"], "held", 1.0, width=100)) == 2
    left = spark.range(5).select(F.col("id").alias("k"), F.col("id").alias("a"), (F.col("id") + 90).alias("z"))
    assert scans(asof.window_total(left, s, by=["k"], start="a", stop="z", value="v", width=100)) == 2
    assert scans(asof.asof_nearest(left, s, by=["k"], target="z", take=["v"], tolerance=F.lit(50), width=100)) == 2
    assert scans(asof.asof_change(left, s, by=["k"], value="v", offset=50, width=100, left_on="z")) == 2


def test_negative_episodes_across_chunks(spark):
    rnd = random.Random(3)
    data = [(k, t, rnd.choice((-1.0, -0.5, 1.0, 0.75))) for k in ("a", "b", None) for t in sorted(rnd.sample(range(2000), 300))]
    frame = spark.createDataFrame(data, "k string, ts long, v double")
    want = set()
    for k in ("a", "b", None):
        total, open_, last = 0.0, None, max(t for kk, t, _ in data if kk == k)
        for _, t, v in [d for d in data if d[0] == k]:
            total += v
            if total < 0:
                open_ = (open_[0], t, min(open_[2], total)) if open_ else (t, t, total)
            elif open_:
                want.add((k, *open_, True))
                open_ = None
        if open_:
            want.add((k, *open_, open_[1] != last))
    for width in (5, 40, 700, None):
        got = {(r.k, r.start_ts, r.end_ts, r.depth_bp / 10_000, r.recovered) for r in W.negative_episodes(frame, ["k"], "v", width=width).collect()}
        assert got == want


def test_quantiles_of_small_and_large_groups(spark, monkeypatch):
    """Only groups beyond one sort's size are sampled and cut; both kinds are exact."""
    import numpy as np

    from tidemark.operators import ordered
    monkeypatch.setattr(ordered, "SORTED", 20)
    d = spark.sql("SELECT IF(id < 7, 's', IF(id < 400, 'm', NULL)) AS k, CAST(pmod(id * 7919, 1009) AS DOUBLE) AS v FROM range(900)")
    got = {r.k: (r.q1, r.q9) for r in ordered.quantiles(d, ["k"], {"v": F.col("v")}, {"q1": ("v", 0.1), "q9": ("v", 0.9)}).collect()}
    values = {}
    for r in d.collect():
        values.setdefault(r.k, []).append(r.v)
    assert {k: tuple(round(x, 9) for x in v) for k, v in got.items()} == {k: tuple(round(float(x), 9) for x in np.quantile(v, [0.1, 0.9])) for k, v in values.items()}
