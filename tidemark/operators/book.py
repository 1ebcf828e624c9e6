"""Tables over book snapshots: summaries, wall episodes, imbalance outcomes, venue comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import book as bk
from ..functions.scalar import fixed_bins
from ..session import materialize
from .asof import asof_nearest
from .batches import by_group, spans
from .infer import cluster_bootstrap_diff
from .joins import pairs
from .ordered import quantiles, with_quantiles
from .scan import Run, scan


_ROWS = {"snapshots": ("_all", lambda v, n: F.sum(n))}


def _known_share(column: str) -> tuple[str, Callable[[Column, Column], Column]]:
    """Share of the values below infinity, which stands for an unknown one."""
    return column, lambda v, n: F.coalesce(F.sum(F.when(v < float("inf"), n)), F.lit(0)) / F.sum(n)


def _snapshot_quantiles(metrics: DataFrame, keys: Sequence[str], stats: dict, columns: dict[str, Column], complete: dict[str, tuple[str, float]], impact: dict[str, tuple[str, float]]) -> DataFrame:
    """``stats`` and two kinds of quantiles (name: column, share) per group, all from one evaluation of the metrics.
    ``complete``: only when every value is known. ``impact``: the next observed value, an unknown counting as dearer than any
    known one; NULL among the unknown."""
    dear = float("inf")
    columns = {**columns, "_all": F.lit(1.0), **{c: F.col(c) for c, _ in complete.values()}, **{f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(dear)) for c, _ in impact.values()}}
    wanted = {**complete, **{n: (f"_{c}", q) for n, (c, q) in impact.items()}}
    counts = {f"_n_{c}": (c, lambda v, n: F.sum(n)) for c, _ in complete.values()}
    g = quantiles(metrics, keys, columns, wanted, higher=impact, stats={**_ROWS, **stats, **counts})
    whole = lambda c: F.col(f"_n_{c}") == F.col("snapshots")
    g = g.withColumns({**{n: F.when(whole(c), F.col(n)) for n, (c, _) in complete.items()}, **{n: F.when(F.col(n) < dear, F.col(n)) for n in impact}})
    return g.drop(*counts)


def stream_summary(metrics: DataFrame, keys: Sequence[str], *, bands: Sequence[int], notionals: Sequence[int]) -> DataFrame:
    complete = {"spread_bp_p50": ("spread_bp", 0.5), "spread_bp_p90": ("spread_bp", 0.9), "latency_ms_p50": ("latency_ms", 0.5)}
    columns, impact = {"_received": F.col("received_ms")}, {}
    stats = {"first_ms": ("_received", lambda v, n: F.min(v).cast("bigint")), "last_ms": ("_received", lambda v, n: F.max(v).cast("bigint"))}
    for b in bands:
        bid, ask = f"bid_usd_{b}bp", f"ask_usd_{b}bp"
        complete |= {f"{c}_p{int(q * 100)}": (c, q) for c in (bid, ask) for q in (0.5, 0.1)}
        columns[f"_known_{b}bp"] = F.when(F.col(bid).isNotNull() & F.col(ask).isNotNull(), 1.0).otherwise(float("inf"))
        stats[f"depth_known_share_{b}bp"] = _known_share(f"_known_{b}bp")
    for n in notionals:
        for side in ("buy", "sell"):
            c = f"{side}_impact_bp_{n}"
            impact |= {f"{c}_p{int(q * 100)}": (c, q) for q in (0.5, 0.9)}
            stats[f"{side}_known_share_{n}"] = _known_share(f"_{c}")
    return _snapshot_quantiles(metrics, keys, stats, columns, complete, impact)


def by_hour(metrics: DataFrame, keys: Sequence[str], *, depth: Sequence[str], impact: Sequence[str]) -> DataFrame:
    """Snapshots and medians per UTC hour; the columns keep their names."""
    m = metrics.withColumn("hour_utc", F.hour(F.timestamp_millis("received_ms")))
    return _snapshot_quantiles(m, [*keys, "hour_utc"], {}, {}, {c: (c, 0.5) for c in ("spread_bp", *depth)}, {c: (c, 0.5) for c in impact})


def wall_rows(books: DataFrame, keys: Sequence[str], **rule) -> DataFrame:
    """One row per wall."""
    both = F.concat(bk.walls("bid", **rule), bk.walls("ask", **rule))
    return books.select(*keys, F.explode(both).alias("w")).select(*keys, "w.*")


EPISODE = T.StructType([T.StructField(n, t) for n, t in (
    ("stream", T.LongType()), ("side", T.StringType()), ("px", T.DoubleType()), ("start_ms", T.LongType()), ("last_seen_ms", T.LongType()),
    ("end_ms", T.LongType()), ("end_reason", T.StringType()), ("snapshots", T.LongType()), ("first_usd", T.DoubleType()), ("last_usd", T.DoubleType()),
    ("max_usd", T.DoubleType()), ("first_distance_bp", T.DoubleType()), ("min_distance_bp", T.DoubleType()), ("duration_sec", T.DoubleType()))])
# What an open episode's level looked like in the snapshot after its last one: enough to go on or to end it.
AHEAD = T.StructType([T.StructField(n, t) for n, t in (("next_ts", T.LongType()), ("next_distance", T.DoubleType()), ("next_cov", T.DoubleType()), ("next_crossed", T.BooleanType()))])
OPEN_EPISODE = T.StructType([*EPISODE.fields, *AHEAD.fields])
_LEVEL = ("stream", "side", "px")
_VIEW = ("ts", "usd", "is_wall", "distance", *AHEAD.names)
_EPISODE = ("start_ms", "last_seen_ms", "snapshots", "first_usd", "last_usd", "max_usd", "first_distance_bp", "min_distance_bp")


def _close_reason(last: dict, near: float, max_gap: int, approach: float) -> tuple[str, int]:
    """(reason, time) of an episode's end by the snapshot after its last one."""
    if last["next_ts"] is None:
        return "censored_at_end", last["ts"]
    if last["next_ts"] - last["ts"] > max_gap:
        return "observation_gap", last["ts"]
    if last["next_crossed"]:
        return "price_crossed", last["next_ts"]
    if last["next_distance"] > last["next_cov"]:
        return "out_of_view", last["next_ts"]
    return ("removed_after_approach" if min(near, last["next_distance"]) <= approach else "removed_while_mid_away"), last["next_ts"]


def _fold(persist: float, max_gap: int, approach: float, keep_open: bool) -> Callable[[pa.Table, np.ndarray], Iterator[pa.Table]]:
    """Views of levels, each after the level's open episode if it has one, to episodes. ``keep_open``: an episode that the
    stream's last snapshot still shows has a NULL end_reason."""
    def fn(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        cols = {c: table.column(c).to_pylist() for c in table.column_names}
        out: dict[str, list] = {c: [] for c in OPEN_EPISODE.names}

        def emit(at: int, ep: dict, last: dict, reason: str | None, end: int | None) -> None:
            whole = {**{c: cols[c][at] for c in _LEVEL}, **ep, "end_reason": reason, "end_ms": end, "duration_sec": (ep["last_seen_ms"] - ep["start_ms"]) / 1000, **{c: last[c] for c in AHEAD.names}}
            for c in OPEN_EPISODE.names:
                out[c].append(whole[c])

        for lo, hi in spans(starts, table.num_rows):
            ep = last = None
            for i in range(lo, hi):
                r = {c: cols[c][i] for c in _VIEW}
                if cols["start_ms"][i] is not None:  # the episode so far
                    ep, last = {c: cols[c][i] for c in _EPISODE}, r
                    continue
                if ep is not None:
                    if r["ts"] == last["ts"]:  # its last snapshot again, now that the next one is known
                        last = r
                        continue
                    if last["next_ts"] == r["ts"] and r["ts"] - last["ts"] <= max_gap and (r["is_wall"] or r["usd"] >= persist * ep["max_usd"]):
                        ep.update(last_seen_ms=r["ts"], snapshots=ep["snapshots"] + 1, last_usd=r["usd"], max_usd=max(ep["max_usd"], r["usd"]), min_distance_bp=min(ep["min_distance_bp"], r["distance"]))
                        last = r
                        continue
                    emit(lo, ep, last, *_close_reason(last, ep["min_distance_bp"], max_gap, approach))
                    ep = None
                if r["is_wall"]:
                    ep = {"start_ms": r["ts"], "last_seen_ms": r["ts"], "snapshots": 1, "first_usd": r["usd"], "last_usd": r["usd"], "max_usd": r["usd"], "first_distance_bp": r["distance"], "min_distance_bp": r["distance"]}
                    last = r
            if ep is not None:
                emit(lo, ep, last, *((None, None) if keep_open and last["next_ts"] is None else _close_reason(last, ep["min_distance_bp"], max_gap, approach)))
        yield pa.table({c: pa.array(out[c], to_arrow_type(OPEN_EPISODE[c].dataType)) for c in OPEN_EPISODE.names})

    return fn


def _priced(side: str) -> Column:
    return F.transform(bk.levels(side), lambda l: F.struct(F.lit(side).alias("side"), l.px.alias("px"), (l.px * l.sz).alias("usd")))


def level_views(books: DataFrame, *, width: int, ts: str = "received_ms", **rule) -> DataFrame:
    """One row per (stream, snapshot, level) with its wall flag and the next snapshot's view of the price."""
    s = books.select("stream", F.col(ts).alias("ts"), bk.mid().alias("mid"), bk.best("bid").alias("bb"), bk.best("ask").alias("ba"), "bid_cov", "ask_cov",
                     *[_priced(x).alias(f"{x}_l") for x in ("bid", "ask")],
                     *[F.transform(bk.walls(x, **rule), lambda l: l.px).alias(f"{x}_w") for x in ("bid", "ask")])
    nxt = scan(s, ["stream"], ["ts"], width, {"_n": Run("last", F.struct("ts", "mid", "bb", "ba", "bid_cov", "ask_cov"), reverse=True, inclusive=False)})
    l = nxt.withColumn("l", F.explode(F.concat("bid_l", "ask_l")))
    bid = F.col("l.side") == "bid"
    return l.select("stream", "ts", F.col("l.side").alias("side"), F.col("l.px").alias("px"), F.col("l.usd").alias("usd"),
                    F.when(bid, F.array_contains("bid_w", F.col("l.px"))).otherwise(F.array_contains("ask_w", F.col("l.px"))).alias("is_wall"),
                    bk.distance_bp(F.col("l.px"), F.col("mid")).alias("distance"), F.col("_n.ts").alias("next_ts"), bk.distance_bp(F.col("l.px"), F.col("_n.mid")).alias("next_distance"),
                    F.when(bid, F.col("_n.bid_cov")).otherwise(F.col("_n.ask_cov")).alias("next_cov"),
                    F.when(bid, F.col("_n.ba") <= F.col("l.px")).otherwise(F.col("_n.bb") >= F.col("l.px")).alias("next_crossed"))


def fold_walls(views: DataFrame, *, max_gap: int, persist: float = 0.5, approach: float = 20.0, opened: DataFrame | None = None) -> DataFrame:
    """Episodes (OPEN_EPISODE) of the levels' ``views``. With ``opened`` it goes on from those episodes, whose last snapshot is
    looked at again, and what the last snapshot of a stream still shows stays open. Levels without a wall or an open episode are left out first;
    a level's rows of one call go through one task in batches of many levels."""
    level = list(_LEVEL)
    v = views.withColumns({c: F.lit(None).cast("double" if c.endswith(("usd", "bp")) else "bigint") for c in _EPISODE})
    if opened is not None:
        before = opened.withColumns({"ts": F.col("last_seen_ms"), "usd": F.col("last_usd"), "is_wall": F.lit(True), "distance": F.col("min_distance_bp")})
        v = v.unionByName(before.select(*v.columns))
    v = v.withColumn("_ever", F.max("is_wall").over(Window.partitionBy(*level))).where("_ever").drop("_ever")  # at most one row per tick
    return by_group(v, level, ["_kind", "ts"], _fold(persist, max_gap, approach, opened is not None), OPEN_EPISODE, True, rows=1 << 62, extra={"_kind": F.col("start_ms").isNull().cast("int")})


def wall_episodes(books: DataFrame, *, max_gap: int, width: int, persist: float = 0.5, approach: float = 20.0, **rule) -> DataFrame:
    """Follow each price level that becomes a wall until it ends, with the reason."""
    books = materialize(books, "wall-books")  # the scan reads them twice
    return fold_walls(level_views(books, width=width, **rule), max_gap=max_gap, persist=persist, approach=approach).select(*EPISODE.names)


def wall_summary(episodes: DataFrame, keys: Sequence[str] = ("stream", "side", "end_reason")) -> DataFrame:
    episodes = materialize(episodes, "wall-episodes")  # read twice
    aggs = [F.count("*").alias("episodes"), F.count_if(F.col("snapshots") >= 2).alias("multi_snapshot_episodes")]
    columns = {c: F.col(c) for c in ("duration_sec", "max_usd", "min_distance_bp")}
    return with_quantiles(episodes, keys, aggs, columns, {f"{c}_p50": (c, 0.5) for c in columns})


def forward_mid(metrics: DataFrame, *, imbalance: str, horizons: Sequence[int], edges: Sequence[float], width: int, ts: str = "tick_ms") -> DataFrame:
    """Mid change to the nearest later snapshot around ts + horizon, within half the stream's median gap."""
    first = Window.partitionBy("stream", ts).orderBy("received_ms")
    d = metrics.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("stream", F.col(ts).alias("ts"), "mid", F.col(imbalance).alias("imbalance"))
    d = materialize(d, "forward-mid")  # four columns of the metrics, read four times
    w = Window.partitionBy("stream").orderBy("ts")  # one row per tick
    gaps = d.withColumn("_g", F.col("ts") - F.lag("ts").over(w))
    gaps = quantiles(gaps, ["stream"], {"g": F.col("_g")}, {"tolerance": ("g", 0.5)}).withColumn("tolerance", F.col("tolerance") / 2)
    h = d.join(gaps, "stream", "left").withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("target", F.col("ts") + F.col("horizon"))
    m = asof_nearest(h, d, by=["stream"], target="target", take=["mid"], tolerance=F.col("tolerance"), width=width, after="ts")
    f = m.withColumn("fwd_bp", (F.col("match_mid") / F.col("mid") - 1) * 10_000).where("fwd_bp IS NOT NULL AND imbalance IS NOT NULL")
    return f.select("stream", "horizon", "ts", "imbalance", "fwd_bp", fixed_bins("imbalance", edges).alias("bin"))


def imbalance_bins(fwd: DataFrame, keys: Sequence[str]) -> DataFrame:
    fwd = materialize(fwd, "imbalance-bins")  # read twice
    day = F.floor(F.col("ts") / 86_400_000)
    aggs = [F.count("*").alias("obs"), F.count_distinct(day).alias("days"), F.avg("fwd_bp").alias("mean_fwd_bp"), F.avg((F.col("fwd_bp") > 0).cast("int")).alias("share_up")]
    return with_quantiles(fwd, [*keys, "bin"], aggs, {"fwd": F.col("fwd_bp")}, {"median_fwd_bp": ("fwd", 0.5)})


def top_minus_bottom(fwd: DataFrame, keys: Sequence[str], *, top: str, bottom: str, draws: int, seed: str, min_days: int, min_obs: int) -> DataFrame:
    """Difference of the extreme bins with a day-cluster interval, and the verdict."""
    fwd = materialize(fwd, "top-minus-bottom")  # read twice and more
    d = fwd.where(F.col("bin").isin(top, bottom)).withColumn("cluster", F.floor(F.col("ts") / 86_400_000)).withColumn("is_a", F.col("bin") == top)
    ci = cluster_bootstrap_diff(d, keys, value="fwd_bp", member="is_a", cluster="cluster", draws=draws, seed=seed, other_only=True)
    base = fwd.groupBy(*keys).agg(F.count("*").alias("obs"), F.count_distinct(F.floor(F.col("ts") / 86_400_000)).alias("days"),
                                  F.count_if(F.col("bin") == top).alias("_nt"), F.count_if(F.col("bin") == bottom).alias("_nb"),
                                  (F.avg(F.when(F.col("bin") == top, F.col("fwd_bp"))) - F.avg(F.when(F.col("bin") == bottom, F.col("fwd_bp")))).alias("mean_fwd_bp"))
    j = base.join(ci.select(*keys, "ci_low", "ci_high"), list(keys), "left")
    enough = (F.col("days") >= min_days) & (F.col("_nt") >= min_obs) & (F.col("_nb") >= min_obs) & F.col("ci_low").isNotNull()
    return j.withColumn("status", F.when(~enough, "insufficient_sample").when(F.col("ci_low") > 0, "ci_above_zero")
                        .when(F.col("ci_high") < 0, "ci_below_zero").otherwise("ci_includes_zero")).drop("_nt", "_nb")


def cross_venue(metrics: DataFrame, *, asset: str, venue: str, tick: str, value: str, relative: bool) -> DataFrame:
    """Pairwise comparison of the venues of an asset on ticks where both are known (venues per asset are few)."""
    first = metrics.groupBy(asset, tick, venue).agg(F.min_by(value, F.struct("received_ms", "stream")).alias("v"))
    p = pairs(first.where("v IS NOT NULL"), on=[asset, tick], name=venue, values=["v"])
    diff = (F.col("a_v") / F.col("b_v") - 1) * 10_000 if relative else F.col("a_v") - F.col("b_v")
    aggs = [F.count("*").alias("common_ticks"), F.avg((F.col("_d") < 0).cast("int")).alias("a_better_share")]
    columns = {"a": F.col("a_v"), "b": F.col("b_v"), "diff": F.col("_d")}
    return with_quantiles(p.withColumn("_d", diff), [asset, "a", "b"], aggs, columns, {f"{c}_p50": (c, 0.5) for c in columns})
