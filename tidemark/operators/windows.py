"""Causal windows: rolling statistics end at the row before, gaps restart them, frames never span one task.

Frames over time use ``range_halo`` (bounded by milliseconds), frames over rows use ``row_halo``. Only the
unbounded statistics of daily series (one row per calendar day) run on a plain per-key window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import DAY, materialize
from .orderstat import expanding_quantile, ranked_rows
from .scan import CHUNK, Run, chunk_of, drawdowns, in_chunk, numbered_runs, own_rows, previous, range_halo, row_halo, running, scan


def _range(keys: Sequence[str], lo: int, hi: int, ts: str = "ts"):
    return Window.partitionBy(*keys, CHUNK).orderBy(F.col(ts)).rangeBetween(lo, hi)


def _rows(keys: Sequence[str], lo: int, hi: int, ts: str = "ts"):
    return Window.partitionBy(*keys, CHUNK).orderBy(F.col(ts)).rowsBetween(lo, hi)


def lag_return(df: DataFrame, keys: Sequence[str], k: int, *, width: int | None, value: str = "close", out: str = "ret") -> DataFrame:
    """value / value k rows earlier - 1."""
    h = row_halo(df, keys, ["ts"], k, width)
    return own_rows(h.withColumn(out, F.try_divide(F.col(value), F.lag(value, k).over(in_chunk(keys, "ts"))) - 1))


def densify(df: DataFrame, keys: Sequence[str], *, step: int, ts: str = "ts", chunk: int = 4096) -> DataFrame:
    """A row for every step between a key's first and last time; added rows hold NULLs.

    The spine is exploded in two stages so no single array holds a key's whole calendar.
    """
    span = step * chunk
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    parts = ends.withColumn("_p", F.explode(F.sequence("_a", "_z", F.lit(span))))
    spine = parts.select(*keys, F.explode(F.sequence(F.col("_p"), F.least(F.col("_p") + span - step, F.col("_z")), F.lit(step))).alias(ts))
    return spine.join(df, [*keys, ts], "left")


def realized_vol(df: DataFrame, keys: Sequence[str], *, days: int, width: int | None, per_year: float = 365.0, value: str = "close",
                 step: int = DAY, out: str = "realized_vol") -> DataFrame:
    """Sample deviation of log returns between adjacent calendar steps, annualised, full windows only."""
    p = previous(df, keys, ["ts"], width, ["ts", value], prefix="_p_")
    r = p.withColumn("log_return", F.when(F.col("_p_ts") == F.col("ts") - step, F.ln(F.try_divide(F.col(value), F.col(f"_p_{value}"))))).drop("_p_ts", f"_p_{value}")
    w = _range(keys, -(days - 1) * step, 0)
    full = F.count("log_return").over(w) == days
    h = range_halo(r, width, back=(days - 1) * step)
    return own_rows(h.withColumn(out, F.when(full, F.stddev_samp("log_return").over(w) * F.lit(per_year) ** 0.5)))


def causal_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, *, lookback: int, min_history: int, width: int | None,
                    step: int = DAY, out: str = "threshold") -> DataFrame:
    """Quantile of the values of the previous ``lookback`` steps, current row excluded."""
    w = _range(keys, -lookback * step, -step)
    h = range_halo(df, width, back=lookback * step)
    return own_rows(h.withColumn(out, F.when(F.count(value).over(w) >= min_history, F.percentile(value, F.lit(q)).over(w))))


def regime(df: DataFrame, keys: Sequence[str], *, vol_days: int, trend_days: int, lookback: int, min_history: int, quantile: float,
           width: int | None) -> DataFrame:
    """Daily trend/volatility state. The volatility threshold at t uses estimates ending at t-1; every shift
    is a calendar shift, so a missing day leaves the state unknown."""
    from ..functions.scalar import four_state
    vol = realized_vol(df, keys, days=vol_days, width=width)
    thr = causal_quantile(vol, keys, "realized_vol", quantile, lookback=lookback, min_history=min_history, width=width)
    past = df.select(*keys, (F.col("ts") + trend_days * DAY).alias("ts"), F.col("close").alias("_then"))
    nxt = df.select(*keys, (F.col("ts") - DAY).alias("ts"), F.col("close").alias("_next"))
    j = thr.join(past, [*keys, "ts"], "left").join(nxt, [*keys, "ts"], "left")
    trend = F.try_divide("close", "_then") - 1
    return (j.withColumn("trend_return", trend).withColumn("next_return", F.try_divide("_next", "close") - 1)
            .withColumn("regime", four_state("trend_return", "realized_vol", "threshold")).drop("_then", "_next"))


def percentile_rank(df: DataFrame, keys: Sequence[str], value: str, window: int, *, width: int | None, out: str = "pctile",
                    min_known: int | None = None) -> DataFrame:
    """Share (0-100) of the previous ``window`` rows' known values strictly below the current one; NULL until
    ``window`` rows exist and max(10, window // 4) of them are known."""
    need = max(10, window // 4) if min_known is None else min_known
    r = ranked_rows(df, keys, value, window, width=width)
    ready = (F.col("_pos") > window) & (F.col("_known") >= need) & F.col(value).isNotNull()
    return r.withColumn(out, F.when(ready, F.col("_below") / F.col("_known") * 100)).drop("_pos", "_below", "_known")


def causal_zscore(df: DataFrame, keys: Sequence[str], value: str, window: int, min_history: int, *, step: int, width: int | None,
                  out: str = "z") -> DataFrame:
    """(x - mean) / population sd of up to ``window`` previous rows, restarting after every time gap.

    Inside a gap-free run rows are ``step`` apart, so the row frame equals a time frame cut at the run start.
    """
    r = islands(df, keys, gap=step, width=width)
    run = [*keys, "island"]
    w = _range(run, -window * step, -step)
    h = range_halo(r, width, back=window * step)
    sd = F.stddev_pop(value).over(w)
    ready = (F.count(value).over(w) >= min_history) & (sd > 0)
    return own_rows(h.withColumn(out, F.when(ready, (F.col(value) - F.avg(value).over(w)) / sd))).drop("island")


def trailing_zscore(df: DataFrame, keys: Sequence[str], value: str, window: int, min_known: int, *, width: int | None, out: str = "z") -> DataFrame:
    """Sample-sd variant over previous rows without gap restart."""
    h = row_halo(df, keys, ["ts"], window, width)
    w = _rows(keys, -window, -1)
    sd = F.stddev_samp(value).over(w)
    return own_rows(h.withColumn(out, F.when((F.count(value).over(w) >= min_known) & (sd > 0), (F.col(value) - F.avg(value).over(w)) / sd)))


def expanding_tail(df: DataFrame, keys: Sequence[str], value: str, q: float, *, lower: bool, min_history: int,
                   width: int | None, out: str = "event") -> DataFrame:
    """Flag values at or beyond the quantile of all strictly earlier known values."""
    limit = f"{out}_threshold"
    d = expanding_quantile(df, keys, value, q, min_history=min_history, width=width, out=limit)
    d = d.withColumn(limit, F.when(F.col(value).isNotNull(), F.col(limit)))
    hit = F.col(value) <= F.col(limit) if lower else F.col(value) >= F.col(limit)
    return d.withColumn(out, F.coalesce(hit, F.lit(False)))


def complete_move(df: DataFrame, keys: Sequence[str], k: int, *, step: int, width: int | None, value: str = "close", out: str = "move_bp") -> DataFrame:
    """k-step move in bp, only where all k+1 values exist at consecutive steps."""
    w = _range(keys, -k * step, 0)
    h = range_halo(df, width, back=k * step)
    move = (F.try_divide(F.col(value), F.first(value).over(w)) - 1) * 10_000
    return own_rows(h.withColumn(out, F.when(F.count(value).over(w) == k + 1, move)))


def rolling(df: DataFrame, keys: Sequence[str], value: str, rows: int, *, width: int | None, kind: str = "sum", out: str | None = None) -> DataFrame:
    """Sum or mean of the last ``rows`` rows including the current, full windows only."""
    w = _rows(keys, -(rows - 1), 0)
    h = row_halo(df, keys, ["ts"], rows, width)
    agg = (F.sum if kind == "sum" else F.avg)(value).over(w)
    return own_rows(h.withColumn(out or f"{kind}_{rows}", F.when(F.count(value).over(w) == rows, agg)))


def islands(df: DataFrame, keys: Sequence[str], *, width: int | None, gap: int | None = None, state: str | None = None,
            out: str = "island", ts: str = "ts", tie: Sequence[str] = (), peers: bool = False) -> DataFrame:
    """Run number: a new run starts where the time step exceeds ``gap`` or ``state`` changes. Rows of one time follow in
    the order of ``tie``; with ``peers`` all of them have the number that the last one reaches."""
    def fresh(now, before):
        far = now(ts) - before(ts) > gap if gap is not None else F.lit(False)
        return far | ~now(state).eqNullSafe(before(state)) if state else far

    return numbered_runs(df, keys, [ts, *tie], width, fresh, [ts, *([state] if state else [])], out=out, ts=ts, peers=peers)


def run_lengths(df: DataFrame, keys: Sequence[str], state: str, *, gap: int, width: int | None, tie: Sequence[str] = (), peers: bool = False) -> DataFrame:
    """Per state: rows, runs and the longest contiguous run; ``tie`` and ``peers`` as in ``islands``."""
    runs = islands(df, keys, width=width, gap=gap, state=state, tie=tie, peers=peers).groupBy(*keys, state, "island").agg(F.count("*").alias("_n"))
    return runs.groupBy(*keys, state).agg(F.sum("_n").alias("count"), F.count("*").alias("runs"), F.max("_n").alias("max_contiguous"))


def episodes(df: DataFrame, keys: Sequence[str], state: str, value: str, *, gap: int, width: int | None) -> DataFrame:
    """Contiguous same-state runs with span, compounded ``value`` and drawdown inside the run."""
    r = islands(df.where(F.col(state).isNotNull()), keys, width=width, gap=gap, state=state)
    dd = max_drawdown(r, [*keys, state, "island"], value, width=None)
    g = r.groupBy(*keys, state, "island").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("observations"),
        (F.exp(F.sum(F.log1p(value))) - 1).alias("cumulative"))
    return g.join(dd, [*keys, state, "island"], "left").drop("island")


def transitions(df: DataFrame, keys: Sequence[str], state: str, *, step: int, width: int | None) -> DataFrame:
    """Counts and row probabilities of moves to the state exactly one calendar step later."""
    known = df.where(F.col(state).isNotNull()).select(*keys, "ts", state)
    nxt = known.select(*keys, (F.col("ts") - step).alias("ts"), F.col(state).alias("to_state"))
    c = known.join(nxt, [*keys, "ts"]).groupBy(*keys, F.col(state).alias("from_state"), "to_state").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*keys, "from_state"))  # a handful of states
    return c.withColumn("probability", F.col("count") / total)


def max_drawdown(df: DataFrame, keys: Sequence[str], ret: str, *, width: int | None, additive: bool = False, out: str = "max_drawdown") -> DataFrame:
    """Worst fall from the running peak; the peak starts at the initial wealth. ``additive`` sums returns."""
    step = F.col(ret) if additive else F.log1p(ret)
    d = drawdowns(df.where(F.col(ret).isNotNull()), keys, ["ts"], width, {out: step})
    return d if additive else d.withColumn(out, F.exp(out) - 1)


def both_drawdowns(df: DataFrame, keys: Sequence[str], ret: str, *, width: int | None) -> DataFrame:
    """(keys, max_drawdown, additive): compounded and additive in one pass."""
    d = drawdowns(df.where(F.col(ret).isNotNull()), keys, ["ts"], width, {"max_drawdown": F.log1p(ret), "additive": F.col(ret).cast("double")})
    return d.withColumn("max_drawdown", F.exp("max_drawdown") - 1)


def negative_episodes(df: DataFrame, keys: Sequence[str], value: str, *, width: int | None, tie: Sequence[str] = ()) -> DataFrame:
    """Stretches where the running sum is below zero: start, end, depth, duration, rank by depth.

    The rows are read twice, for the chunks' sums and for the chunks' own stretches. What goes on from there has one row per
    stretch and chunk and is written: stretches at a chunk's ends are joined to those of its neighbours.
    """
    keys, order = list(keys), ["ts", *tie]
    part = [*keys, CHUNK]
    cum = running(df, keys, order, width, {"cum": ("sum", F.col(value))}).withColumn(CHUNK, F.lit(0) if width is None else chunk_of("ts", width))
    inside = Window.partitionBy(*part).orderBy(*order)
    cum = cum.withColumn("_neg", F.coalesce(F.col("cum") < 0, F.lit(False)))
    turn = cum.withColumn("_run", F.sum((F.col("_neg") != F.coalesce(F.lag("_neg").over(inside), ~F.col("_neg"))).cast("bigint")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*order)
    runs = turn.groupBy(*part, "_run", "_neg").agg(F.min("ts").alias("start_ts"), F.max(at).alias("_end"), F.min("cum").alias("_low"))
    runs = materialize(runs, "sign-runs")
    # Runs alternate inside a chunk, so only a chunk's first run can go on from the chunk before.
    ends = runs.groupBy(*part).agg(F.max_by("_neg", "_run").alias("_leaves"), F.max("_run").alias("_runs"))
    chain = Window.partitionBy(*keys).orderBy(CHUNK)
    ends = ends.withColumn("_enters", F.lag("_leaves").over(chain))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in part]
    joined = runs.join(ends.select(*[F.col(c).alias(f"_k_{c}") for c in part], "_enters", "_runs"), reduce(and_, same)).drop(*[f"_k_{c}" for c in part])
    goes_on = F.coalesce((F.col("_run") == 1) & (F.col("_enters") == F.col("_neg")), F.lit(False))
    # One row per chunk decides where a stretch that spans chunks began: the last chunk that opened a run of its own.
    heads = joined.groupBy(*part).agg(F.max(F.when(F.col("_run") == 1, goes_on)).alias("_on"), F.max("_runs").alias("_runs"))
    opened = F.when(~F.col("_on") | (F.col("_runs") > 1), F.struct(F.col(CHUNK).alias("c"), F.col("_runs").alias("r")))
    heads = heads.withColumn("_head", F.last(opened, True).over(chain.rowsBetween(Window.unboundedPreceding, -1)))
    named = joined.join(heads.select(*[F.col(c).alias(f"_k_{c}") for c in part], "_head"), reduce(and_, same))
    own = F.struct(F.col(CHUNK).alias("c"), F.col("_run").alias("r"))
    named = named.where("_neg").withColumn("_id", F.when(goes_on & F.col("_head").isNotNull(), F.col("_head")).otherwise(own))
    e = named.groupBy(*keys, "_id").agg(F.min("start_ts").alias("start_ts"), F.max("_end").alias("_end"), (F.min("_low") * 10_000).alias("depth_bp"))
    last = runs.groupBy(*keys).agg(F.max("_end").alias("_last"))
    e = e.join(last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_last"), reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("depth_bp", "start_ts"))
    return e.select(*keys, "start_ts", F.col("_end.ts").alias("end_ts"), (F.col("_end") != F.col("_last")).alias("recovered"), "depth_bp",
                    ((F.col("_end.ts") - F.col("start_ts")) / DAY).alias("duration_days"), rank.alias("rank"))


def local_drawdown(df: DataFrame, keys: Sequence[str], value: str, *, width: int | None, tie: Sequence[str] = ()) -> DataFrame:
    """Worst distance of the running sum from its all-time high, per year."""
    peak = scan(df, keys, ["ts", *tie], width, {"_cum": Run("sum", F.col(value)), "_peak": Run("max", of="_cum")})
    return peak.groupBy(*keys, F.year(F.timestamp_millis("ts")).alias("yr")).agg((F.min(F.col("_cum") - F.col("_peak")) * 10_000).alias("drawdown_bp"))


def forward_max_rise(df: DataFrame, keys: Sequence[str], *, span: int, width: int | None, every: int = 1, high: str = "high") -> DataFrame:
    """Highest high in [t, t + span) over the high at t, for every n-th row with at least two bars ahead."""
    numbered = running(df, keys, ["ts"], width, {"_i": ("count", F.lit(1))})
    w = _range(keys, 0, span - 1)
    h = range_halo(numbered, width, ahead=span)
    rise = own_rows(h.withColumn("rise", F.try_divide(F.max(high).over(w), F.col(high)) - 1).withColumn("_m", F.count("*").over(w)))
    return rise.where(((F.col("_i") - 1) % every == 0) & (F.col("_m") > 1)).drop("_i", "_m")


def hysteresis(df: DataFrame, keys: Sequence[str], x: str, enter: float, leave: float, *, width: int | None, out: str = "held") -> DataFrame:
    """1 after x > enter, 0 after x < leave, otherwise unchanged (flat at first). Needs enter > leave: then
    the last decisive value alone gives the state."""
    if enter <= leave:
        raise ValueError("enter must exceed leave")
    signal = F.when(F.col(x) > enter, 1).when(F.col(x) < leave, 0)
    return running(df, keys, ["ts"], width, {"_l": ("last", signal)}).withColumn(out, F.coalesce("_l", F.lit(0))).drop("_l")


def transition_cost(df: DataFrame, keys: Sequence[str], held: str, cost: float, *, width: int | None, out: str = "cost") -> DataFrame:
    """``cost`` at every change of the holding and once more at the end when still holding."""
    n = scan(df, keys, ["ts"], width, {"_was": Run("last", F.struct(held), inclusive=False), "_next": Run("last", F.struct("ts"), reverse=True, inclusive=False)})
    change = F.abs(F.col(held) - F.coalesce(F.col(f"_was.{held}"), F.lit(0)))
    close = F.when(F.col("_next").isNull() & (F.col(held) == 1), 1).otherwise(0)
    return n.withColumn(out, (change + close) * F.lit(cost)).drop("_was", "_next")


def rule_pnl(df: DataFrame, keys: Sequence[str], z: str, ret: str, *, sign: int, cost_bp: float, width: int | None) -> DataFrame:
    """P&L of position sign * clip(z, -1, 1); a missing z is flat; turnover pays ``cost_bp``."""
    d = df.withColumn("position", F.coalesce(sign * F.greatest(F.least(F.col(z), F.lit(1.0)), F.lit(-1.0)), F.lit(0.0)))
    p = previous(d, keys, ["ts"], width, ["position"])
    turn = F.abs(F.col("position") - F.coalesce(F.col("prev_position"), F.lit(0.0)))
    return p.withColumn("pnl", F.col("position") * F.coalesce(F.col(ret), F.lit(0.0)) - turn * cost_bp / 10_000).drop("prev_position")


def adjusted_log_price(df: DataFrame, keys: Sequence[str], *, width: int | None, out: str = "log_price") -> DataFrame:
    """ln close minus the running log of the split factors, carried over rows without a price."""
    r = running(df, keys, ["ts"], width, {"_adj": ("sum", F.ln(F.coalesce(F.col("adj_factor"), F.lit(1.0))))})
    level = F.when(F.col("close") > 0, F.ln("close")) - F.col("_adj")
    return running(r, keys, ["ts"], width, {out: ("last", level)}).drop("_adj")


def prior_volume_median(df: DataFrame, keys: Sequence[str], *, n: int, step: int, width: int | None, volume: str = "quote_volume") -> DataFrame:
    """Median volume of exactly the n previous steps, unknown when one is missing or not positive; the same
    bar's own volume is kept apart for audit."""
    w = _range(keys, -n * step, -step)
    h = range_halo(df, width, back=n * step)
    known = (F.count(volume).over(w) == n) & (F.min(volume).over(w) > 0)
    own = F.col(volume) > 0
    d = h.withColumn("historical_volume", F.when(known, F.percentile(volume, F.lit(0.5)).over(w)))
    return own_rows(d.withColumn("historical_status", F.when(F.col("historical_volume").isNotNull(), "known").otherwise("unknown_zero_or_missing"))
                    .withColumn("actual_volume", F.when(own, F.col(volume)))
                    .withColumn("actual_status", F.when(own, "known").otherwise("unknown_zero_or_missing")))


def true_range(df: DataFrame, keys: Sequence[str], *, width: int | None, step: int) -> DataFrame:
    """max(high - low, |high - previous close|, |low - previous close|) where the previous bar is adjacent."""
    p = previous(df, keys, ["ts"], width, ["ts", "close"])
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close")))
    return p.withColumn("tr", F.when(F.col("prev_ts") == F.col("ts") - step, tr)).drop("prev_ts", "prev_close")


def atr(df: DataFrame, keys: Sequence[str], n: int, *, width: int | None, step: int, kind: str = "mean") -> DataFrame:
    """Mean or median true range of the last n bars, all present."""
    w = _range(keys, -(n - 1) * step, 0)
    h = range_halo(true_range(df, keys, width=width, step=step), width, back=(n - 1) * step)
    value = F.avg("tr").over(w) if kind == "mean" else F.percentile("tr", F.lit(0.5)).over(w)
    return own_rows(h.withColumn("atr", F.when(F.count("tr").over(w) == n, value)))


def range_levels(df: DataFrame, keys: Sequence[str], *, context: int, skip: int, block: int, step: int, width: int | None) -> DataFrame:
    """Support and resistance of the ``context`` bars that end ``skip`` bars before the current one, distance of
    the close to resistance, and the current block's range over the median range of earlier blocks.

    Complete windows only; ``block`` bars per block, context is a multiple of it.
    """
    ctx = _range(keys, -(context + skip - 1) * step, -skip * step)
    cur = _range(keys, -(block - 1) * step, 0)
    back = (context + max(skip, block)) * step
    h = range_halo(df, width, back=back)
    h = (h.withColumn("resistance", F.when(F.count("*").over(ctx) == context, F.max("high").over(ctx)))
         .withColumn("support", F.when(F.count("*").over(ctx) == context, F.min("low").over(ctx)))
         .withColumn("block_range", F.when(F.count("*").over(cur) == block, F.max("high").over(cur) - F.min("low").over(cur))))
    lagged = [F.max("block_range").over(_range(keys, -i * block * step, -i * block * step))
              for i in range(1, context // block + 1)]
    arr = F.array_compact(F.array(*lagged))
    known = F.size(arr) == context // block
    med = F.get(F.array_sort(arr), F.lit((context // block - 1) // 2)) + F.get(F.array_sort(arr), F.lit((context // block) // 2))
    return own_rows(h.withColumn("_med", F.when(known, med / 2))
                    .withColumn("distance", F.col("resistance") - F.col("close"))
                    .withColumn("compression", F.when(F.col("_med") > 0, F.col("block_range") / F.col("_med"))).drop("_med"))


def regime_only(df: DataFrame, keys: Sequence[str], state: str, ret: str, *, width: int | None) -> DataFrame:
    """Per state: compounded return and drawdown of holding only in that state, cash otherwise. Unknown when
    an exposed return is unknown."""
    labels = df.where(F.col(state).isNotNull()).groupBy(*keys, F.col(state).alias("label")).agg(F.min("ts").alias("_x")).drop("_x")
    bounds = df.groupBy(*keys).agg(F.min(F.when(F.col(state).isNotNull(), F.col("ts"))).alias("_a"),
                                   F.max(F.when(F.col(ret).isNotNull(), F.col("ts"))).alias("_z"))
    d = df.join(bounds, keys).where((F.col("ts") >= F.col("_a")) & (F.col("ts") <= F.col("_z")))
    each = d.join(labels, keys)
    exposed = F.coalesce(F.col(state) == F.col("label"), F.lit(False))
    each = each.withColumn("_r", F.when(exposed, F.coalesce(F.col(ret), F.lit(0.0))).otherwise(0.0)) \
        .withColumn("_u", exposed & F.col(ret).isNull())
    k = [*keys, "label"]
    dd = max_drawdown(each, k, "_r", width=width)
    g = each.groupBy(*k).agg((F.exp(F.sum(F.log1p("_r"))) - 1).alias("total_return"), F.max("_u").alias("_u"),
                             ((F.max("ts") - F.min("ts")) / DAY + 1).alias("days"))
    j = g.join(dd, k)
    known = ~F.col("_u")
    return j.select(*k, F.when(known, F.col("total_return")).alias("total_return"),
                    F.when(known, F.pow(1 + F.col("total_return"), 365.2425 / F.col("days")) - 1).alias("cagr"),
                    F.when(known, F.col("max_drawdown")).alias("max_drawdown"))


def daily_moves(df: DataFrame, keys: Sequence[str], *, width: int | None) -> DataFrame:
    """Close, high and low against the split-adjusted previous close; overnight and intraday log legs."""
    p = previous(df, keys, ["ts"], width, ["close"])
    base = F.col("prev_close") * F.coalesce(F.col("adj_factor"), F.lit(1.0))
    return (p.withColumn("ret_close", F.try_divide(F.col("close"), base) - 1).withColumn("rise_high", F.try_divide(F.col("high"), base) - 1)
            .withColumn("fall_low", F.try_divide(F.col("low"), base) - 1).withColumn("overnight", F.ln(F.try_divide(F.col("open"), base)))
            .withColumn("intraday", F.ln(F.try_divide("close", "open"))).drop("prev_close"))
