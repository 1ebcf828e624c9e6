"""Chunked scans must equal plain windows for every chunk width; as-of semantics."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import asof, ordered
from tidemark.operators.scan import chunk_width, in_chunk, own_rows, previous, range_halo, row_halo, running


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(1)
    data = [(k, t, rnd.choice([None, rnd.uniform(-5, 5)])) for k in ("a", "b") for t in sorted(rnd.sample(range(400), 60))]
    return spark.createDataFrame(data, "k string, ts long, v double").cache()


@pytest.mark.parametrize("width", [1, 7, 50, 10_000, None])
def test_running_equals_window(series, width):
    w = Window.partitionBy("k").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    want = series.select("k", "ts", F.round(F.sum("v").over(w), 9), F.max("v").over(w), F.min("v").over(w), F.count("v").over(w), F.last("v", True).over(w))
    got = running(series, ["k"], ["ts"], width, {"s": ("sum", F.col("v")), "mx": ("max", F.col("v")), "mn": ("min", F.col("v")), "n": ("count", F.col("v")), "l": ("last", F.col("v"))})
    assert rows(got.select("k", "ts", F.round("s", 9), "mx", "mn", "n", "l")) == rows(want)


@pytest.mark.parametrize("width", [1, 13, 10_000])
def test_previous_and_next(series, width):
    w = Window.partitionBy("k").orderBy("ts")
    want = series.select("k", "ts", F.lag("ts").over(w), F.lead("v").over(w))
    p = previous(series, ["k"], ["ts"], width, ["ts"])
    got = previous(p, ["k"], ["ts"], width, ["v"], prefix="next_", reverse=True)
    assert rows(got, "k", "ts", "prev_ts", "next_v") == rows(want)


@pytest.mark.parametrize("width", [3, 40, 10_000])
def test_halos(series, width):
    by_time = Window.partitionBy("k").orderBy("ts").rangeBetween(-25, -1)
    by_row = Window.partitionBy("k").orderBy("ts").rowsBetween(-5, -1)
    h = range_halo(series, width, back=25)
    got = own_rows(h.withColumn("m", F.max("v").over(in_chunk(["k"], "ts").rangeBetween(-25, -1))))
    assert rows(got, "k", "ts", "m") == rows(series.select("k", "ts", F.max("v").over(by_time)))
    r = row_halo(series, ["k"], ["ts"], 5, width, block=8)
    got = own_rows(r.withColumn("m", F.max("v").over(in_chunk(["k"], "ts").rowsBetween(-5, -1))))
    assert rows(got, "k", "ts", "m") == rows(series.select("k", "ts", F.max("v").over(by_row)))


def test_chunk_width_follows_the_densest_interval(spark):
    burst = spark.createDataFrame([("a", i) for i in range(1000)] + [("b", 3_600_000 * 5)], "k string, ts long")
    assert chunk_width(burst, ["k"], target_rows=100) == 360_000
    assert chunk_width(burst.limit(0), ["k"]) == 3_600_000


@pytest.mark.parametrize("width", [500, 1_000_000])
def test_asof_backward_inclusive(spark, width):
    left = spark.createDataFrame([(t,) for t in (500, 1000, 3999, 4000, 7999, 8001)], "ts long").withColumn("k", F.lit(0))
    right = spark.createDataFrame([(1000, 1.0), (4000, 2.0), (8000, 3.0)], "ts long, v double").withColumn("k", F.lit(0))
    got = asof.asof_backward(left, right, by=["k"], take=["v"], width=width, max_age=2500)
    assert rows(got, "ts", "source_ts", "state") == rows(spark.createDataFrame(
        [(500, None, "missing"), (1000, 1000, "available"), (3999, 1000, "stale"), (4000, 4000, "available"), (7999, 4000, "stale"), (8001, 8000, "available")],
        "ts long, s long, st string"))
    strict = asof.asof_backward(left, right, by=["k"], take=["v"], width=width, strict=True)
    assert dict(rows(strict, "ts", "source_ts"))[4000] == 1000


def test_asof_forward_strictness_and_ties(spark):
    left = spark.createDataFrame([(2000,), (2500,), (9000,)], "ts long").withColumn("k", F.lit(0))
    right = spark.createDataFrame([(2000, 1, "x"), (2000, 2, "y"), (3000, 3, "z")], "ts long, seq int, v string").withColumn("k", F.lit(0))
    kw = dict(by=["k"], take=["v"], width=700, right_tie=["seq"])
    assert rows(asof.asof_forward(left, right, **kw), "ts", "v") == [(2000, "x"), (2500, "z"), (9000, None)]
    assert rows(asof.asof_forward(left, right, strict=True, **kw), "ts", "v") == [(2000, "z"), (2500, "z"), (9000, None)]
    assert rows(asof.asof_backward(left, right, **kw), "ts", "v") == [(2000, "y"), (2500, "y"), (9000, "z")]


def test_window_total_closures(spark):
    right = spark.createDataFrame([(10, 1.0), (20, 2.0), (30, 4.0)], "ts long, v double").withColumn("k", F.lit(0))
    left = spark.createDataFrame([(10, 30)], "a long, z long").withColumn("k", F.lit(0))
    total = lambda closed: rows(asof.window_total(left, right, by=["k"], start="a", stop="z", value="v", width=15, closed=closed), "total", "n")
    assert total("right") == [(6.0, 2)]
    assert total("left") == [(3.0, 2)]


def test_exact_quantiles_and_ranks(spark):
    rnd = random.Random(3)
    values = [rnd.choice([rnd.gauss(0, 1e-3), rnd.gauss(0, 1e5), 7.0]) for _ in range(501)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    q = {"a": 0.0, "b": 0.13, "c": 0.5, "d": 0.975, "e": 1.0}
    got = ordered.exact_quantiles(df, ["g"], "v", q).first()
    want = df.agg(F.percentile("v", F.array(*map(F.lit, q.values())))).first()[0]
    assert [got[k] for k in q] == pytest.approx(want, rel=1e-12)
    w = Window.partitionBy("g").orderBy("v")
    assert rows(ordered.ranks(df, ["g"], "v"), "v", "min_rank") == rows(df.select("v", F.rank().over(w).cast("long")))
