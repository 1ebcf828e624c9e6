"""Distributed first-fit selection against the sequential rule."""

import random

import numpy as np
import pytest

from tidemark.operators import batches, greedy
from tidemark.operators.events import cooldown_select, greedy_nonoverlap, purge_audit, refractory_select


def brute(items, seed=None):
    """items sorted by (start, limit, id)."""
    last, keep = seed, []
    for start, limit, i in items:
        if last is None or start >= last:
            keep.append(i)
            last = limit
    return keep


def test_step_functions_compose():
    rnd = random.Random(5)
    for _ in range(300):
        s = np.array(sorted(rnd.choices(range(60), k=rnd.randint(1, 30))))
        l = s + np.array([rnd.randint(1, 25) for _ in s])
        upper, out = greedy.steps(s, l)
        for entering in range(-2, 90):
            last = entering
            for a, b in zip(s, l):
                if a >= last:
                    last = b
            i = np.searchsorted(upper, entering, side="left")
            assert (out[i] if i < len(upper) else entering) == last


@pytest.mark.parametrize("width", [5, 37, 10_000])
def test_greedy_matches_sequential(spark, width):
    rnd = random.Random(width)
    data = []
    for k in ("a", "b", "c"):
        for i in range(120):
            e = rnd.randint(0, 900)
            data.append((k, i, e, e + rnd.randint(1, 60)))
    df = spark.createDataFrame(data, "k string, id long, entry_ts long, exit_ts long")
    got = greedy_nonoverlap(df, ["k"], width=width, ties=("exit_ts", "id"))
    kept = {(r.k, r.id) for r in got.where("accepted").collect()}
    want = {(k, i) for k in "abc" for i in brute(sorted((e, x, i) for kk, i, e, x in data if kk == k))}
    assert kept == want
    audit = {r.k: (r.events_raw, r.events_kept) for r in purge_audit(got, ["k"]).collect()}
    assert audit["a"] == (120, sum(k == "a" for k, _ in want))


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_one_key_with_long_holds(spark, levels, monkeypatch):
    """Holds longer than a chunk and than a node of the tree, chunks longer than a batch, NULLs, equal starts."""
    monkeypatch.setattr(greedy, "FAN", 3)
    monkeypatch.setattr(batches, "ROWS", 16)
    rnd = random.Random(levels)
    data = [(i, rnd.randint(0, 2000), rnd.choice((1, 30, 400, 900))) for i in range(400)]
    df = spark.createDataFrame([(None, i, e, e + h) for i, e, h in data] + [(None, 1000, None, 5), (None, 1001, 7, None)], "k string, id long, s long, l long")
    for width in (20, 700):
        got = greedy.greedy_select(df, ["k"], "s", "l", ("l", "id"), width=width, levels=levels)
        assert got.count() == 402
        assert {r.id for r in got.where("accepted").collect()} == set(brute(sorted((e, e + h, i) for i, e, h in data)))


def test_composition_is_the_sequence():
    rnd = random.Random(8)
    for _ in range(300):
        parts, whole = [], None
        at = 0
        for _ in range(rnd.randint(1, 5)):
            s = np.array(sorted(rnd.choices(range(at, at + 20), k=rnd.randint(1, 9))))
            parts.append((s, s + np.array([rnd.randint(1, 60) for _ in s])))
            at += 20
        for s, l in parts:
            own = greedy.steps(s, l)
            whole = own if whole is None else greedy.compose(whole, own)
        for entering in range(-2, 130):
            last = entering
            for s, l in parts:
                for a, b in zip(s, l):
                    if a >= last:
                        last = b
            assert greedy.apply(*whole, np.array([entering]))[0] == last


def test_hand_checked_overlap_and_seed(spark):
    df = spark.createDataFrame([(1, 4), (2, 6), (5, 7)], "entry_ts long, exit_ts long").selectExpr("0 AS k", "*")
    kept = lambda d: sorted(r.entry_ts for r in d.where("accepted").collect())
    assert kept(greedy_nonoverlap(df, ["k"], width=2)) == [1, 5]
    assert kept(greedy_nonoverlap(df.selectExpr("*", "CAST(2 AS LONG) AS open_until"), ["k"], width=2, last_exit="open_until")) == [2]


def test_cooldown_and_refractory(spark):
    df = spark.createDataFrame([("x", t) for t in (0, 5, 9, 10, 12, 19, 20, 40)], "k string, ts long")
    assert sorted(r.ts for r in cooldown_select(df, ["k"], 10, width=7).collect()) == [0, 10, 20, 40]
    # the clock runs from events before the period
    late = refractory_select(df, ["k"], step=1, refractory=10, start=12, end=100, width=7)
    assert sorted(r.ts for r in late.collect()) == [20, 40]
