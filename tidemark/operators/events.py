"""Event detection, selection, outcomes and ledgers. Incomplete rows stay in the ledger with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite, ieee_divide
from ..session import DAY, HOUR, materialize
from .asof import asof_forward
from .greedy import greedy_select
from .joins import exact_lookup, interval_join
from .ordered import quantiles, with_quantiles
from .scan import previous


# -- selection ------------------------------------------------------------------------------------

def cooldown_select(candidates: DataFrame, keys: Sequence[str], gap: int, *, width: int, ts: str = "ts") -> DataFrame:
    """Candidates at least ``gap`` after the last accepted one."""
    d = greedy_select(candidates.withColumn("_limit", F.col(ts) + gap), keys, ts, "_limit", width=width)
    return d.where("accepted").drop("_limit", "accepted")


def refractory_select(candidates: DataFrame, keys: Sequence[str], *, step: int, refractory: int, start: int, end: int,
                      width: int) -> DataFrame:
    """Cooldown measured between decision times over the whole history; only then is the period cut, so the
    list does not depend on where the period begins."""
    d = candidates.withColumn("decision_ts", F.col("ts") + step)
    d = cooldown_select(d, keys, refractory, width=width, ts="decision_ts")
    return d.where((F.col("decision_ts") >= start) & (F.col("decision_ts") < end))


def greedy_nonoverlap(events: DataFrame, keys: Sequence[str], *, width: int, entry: str = "entry_ts", exit_: str = "exit_ts",
                      ties: Sequence[str] = ("exit_ts", "detect_ts"), last_exit: str | None = None) -> DataFrame:
    """First-come non-overlapping trades in (entry, exit, detect) order; ``last_exit`` names a column with the
    exit still open when the replay starts. Adds ``accepted``."""
    return greedy_select(events, keys, entry, exit_, [c for c in ties if c in events.columns], width=width, seed=last_exit)


def purge_audit(replayed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return replayed.groupBy(*keys).agg(F.count("*").alias("events_raw"), F.count_if("accepted").alias("events_kept"),
                                       F.count_if(~F.col("accepted")).alias("events_purged"),
                                       F.max(F.when(F.col("accepted"), F.col("exit_ts"))).alias("last_exit_ts"))


def threshold_events(bars: DataFrame, *, move: str, threshold: Column | float, direction: str | Column, oi_change: str | None = None,
                     oi_threshold: Column | float | None = None) -> DataFrame:
    """Bars whose move passes the side's threshold and, when asked, whose open-interest change is low enough."""
    side = F.lit(direction) if isinstance(direction, str) else direction
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    hit = F.when(side == "long", F.col(move) <= limit).otherwise(F.col(move) >= limit)
    if oi_change is not None:
        floor = F.lit(oi_threshold) if not isinstance(oi_threshold, Column) else oi_threshold
        hit = hit & (floor.isNull() | F.coalesce(F.col(oi_change) <= floor, F.lit(False)))
    return bars.where(F.coalesce(hit, F.lit(False)))


def _type(values: Sequence) -> str:
    v = next(x for x in values if x is not None)
    return "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"


def with_grid(df: DataFrame, **axes: Sequence) -> DataFrame:
    """Every row times every combination of literal parameter values, as one explode (no join, no shuffle)."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v).cast(_type(values)) for v in values])))
    return df


# -- outcomes -------------------------------------------------------------------------------------

def forward_outcome(decisions: DataFrame, bars: DataFrame, *, by: Sequence[str], decision: str, delay: Column | int, hold: Column | int,
                    width: int, strict: bool = False, price: str = "open") -> DataFrame:
    """Entry at the first bar open at/after (``strict``: after) decision + delay, exit at the first open
    at/after the actual entry + hold. Rows without an entry or exit keep NULL and say so."""
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    # Each as-of reads its left side twice, so the two of them would run the detection four times.
    d = materialize(decisions, "decisions").withColumn("_target", F.col(decision) + lit(delay))
    e = asof_forward(d, bars, by=by, take=[price], width=width, left_on="_target", strict=strict, prefix="en_")
    e = materialize(e, "entries").withColumn("_exit", F.col("en_source_ts") + lit(hold)).withColumn("_xt", F.coalesce("_exit", F.lit(2 ** 53)))
    x = asof_forward(e, bars, by=by, take=[price], width=width, left_on="_xt", prefix="ex_")
    return x.select(*decisions.columns, F.col("en_source_ts").alias("entry_ts"), F.col(f"en_{price}").alias("entry_px"),
                    F.col("ex_source_ts").alias("exit_ts"), F.col(f"ex_{price}").alias("exit_px"),
                    (F.try_divide(F.col(f"ex_{price}"), F.col(f"en_{price}")) - 1).alias("ret"),
                    F.when(F.col("en_source_ts").isNull(), "no_entry_bar").when(F.col("ex_source_ts").isNull(), "no_exit_bar")
                    .otherwise("complete").alias("status"))


def outcome_grid(events: DataFrame, leader: DataFrame, follower: DataFrame, *, window: int, step: int, delays: Sequence[int],
                 horizons: Sequence[int], cost_bp: float, end: int) -> DataFrame:
    """Event x delay x horizon with exact-time prices only; every incomplete row names its reason.

    ``events`` holds ts (bar open), decision_ts, direction (+1/-1), window_bp.
    """
    look = lambda d, src, at, take: exact_lookup(d, src, by=[], at=at, take=take)
    base = look(events, follower, F.col("ts") - window, {"close": "_f0"})
    base = look(base, follower, F.col("ts"), {"close": "_f1"})
    g = with_grid(base, delay=list(delays), horizon=list(horizons))
    g = (g.withColumn("entry_ts", F.col("decision_ts") + F.col("delay") * step)
         .withColumn("exit_ts", F.col("entry_ts") + F.col("horizon") * step))
    for name, src in (("f", follower), ("l", leader)):
        g = look(g, src, F.col("entry_ts"), {"open": f"_{name}e"})
        g = look(g, src, F.col("exit_ts"), {"open": f"_{name}x"})
    late = F.col("exit_ts") >= end
    have = F.col("_fe").isNotNull() & F.col("_fx").isNotNull()
    done = ~late & have
    move = lambda a, b: F.col("direction") * (F.try_divide(F.col(b), F.col(a)) - 1) * 10_000
    gross = F.when(done, move("_fe", "_fx"))
    return g.select("ts", "decision_ts", "direction", (F.col("direction") * F.col("window_bp")).alias("leader_window_bp"),
                    move("_f0", "_f1").alias("follower_window_bp"), "delay", "horizon", "entry_ts", "exit_ts", gross.alias("gross_bp"),
                    (gross - cost_bp).alias("net_bp"), F.when(done, move("_le", "_lx")).alias("leader_same_interval_bp"),
                    done.alias("complete"), F.when(late, "exit_at_or_after_boundary").when(~have, "missing_follower_bar").otherwise("").alias("reason"))


def composite_group(a: str, b: str, high: float = 75.0) -> Column:
    x, y = F.col(a) >= high, F.col(b) >= high
    return (F.when(x & y, "double_overheat").when(x & ~y, "first_only_top_quartile").when(~x & y, "second_only_top_quartile")
            .when(~x & ~y, "neither"))


# -- two-leg basis trades ---------------------------------------------------------------------------

def basis_panel(a: DataFrame, b: DataFrame, *, threshold_bp: float, step: int, width: int, spot: DataFrame | None = None) -> DataFrame:
    """Synchronised closes of two legs, their basis, and the starts of extreme same-side episodes."""
    j = a.select("ts", F.col("close").alias("a_close")).join(b.select("ts", F.col("close").alias("b_close")), "ts")
    p = (j.withColumn("k", F.lit(0)).withColumn("signal_ts", F.col("ts") + step)
         .withColumn("basis_bp", 10_000 * (F.try_divide("b_close", "a_close") - 1))
         .withColumn("extreme", F.abs("basis_bp") >= threshold_bp))
    q = previous(p, ["k"], ["ts"], width, ["ts", "basis_bp", "extreme"])
    goes_on = (F.coalesce(F.col("prev_extreme"), F.lit(False)) & (F.col("prev_ts") == F.col("ts") - step)
               & (F.signum("basis_bp") == F.signum("prev_basis_bp")))
    return q.withColumn("episode_start", F.col("extreme") & ~F.coalesce(goes_on, F.lit(False))).drop("k", "prev_ts", "prev_basis_bp", "prev_extreme")


def funding_leg(trades: DataFrame, funding: DataFrame, prices: DataFrame, *, interval: int, step: int, quantity: float,
                tolerance: int = 1_000, direction: str = "direction", entry: str = "entry_ts", exit_: str = "exit_ts") -> DataFrame:
    """Cash of the settlements in [entry, exit): unknown unless every scheduled settlement covering the hold was
    observed on time with the declared interval, and every held one has a price."""
    slot = F.floor((F.col("ts") + interval // 2) / interval) * interval
    f = funding.withColumn("slot", slot).withColumn("on_time", F.abs(F.col("ts") - slot) <= tolerance)
    good = f.where(F.col("on_time") & finite("rate") & (F.col("interval_hours") == interval / HOUR)).groupBy("slot").agg(F.count("*").alias("_n"))
    first = F.floor(F.col(entry) / interval) * interval
    last = F.ceil(F.col(exit_) / interval) * interval
    cols = trades.columns  # grouping by the whole row keeps one chain instead of joining the trades back
    found = F.coalesce("_n", F.lit(0))
    cover = (trades.withColumn("slot", F.explode_outer(F.sequence(first, last, F.lit(interval)))).join(good, "slot", "left")
             .groupBy(*cols).agg(F.count_if(found == 1).alias("_ok"), F.count_if(found > 1).alias("_dup"), F.count("slot").alias("_need")))
    px = prices.select(F.col("ts").alias("_pt"), F.col("open").alias("_px"))
    bucket = max(DAY, interval)
    settle = (f.withColumn("_pt", F.floor(F.col("ts") / step) * step).join(px, "_pt", "left")
              .select(F.col("ts").alias("_fts"), "rate", "_px", "on_time", F.floor(F.col("ts") / bucket).alias("_b")))
    held = cover.withColumn("_b", F.explode_outer(F.sequence(F.floor(F.col(entry) / bucket), F.floor((F.col(exit_) - 1) / bucket)))).alias("e")
    on = (F.col("e._b") == F.col("s._b")) & (F.col("_fts") >= F.col(entry)) & (F.col("_fts") < F.col(exit_))
    j = (held.join(settle.alias("s"), on, "left").groupBy(*cols, "_ok", "_dup", "_need")
         .agg(F.count("_fts").alias("_held"), F.count_if(~F.col("on_time")).alias("_off"),
              F.count_if(F.col("_fts").isNotNull() & (F.col("_px").isNull() | (F.col("_px") <= 0))).alias("_nopx"),
              F.sum(-F.col(direction) * quantity * F.col("_px") * F.col("rate")).alias("_cash")))
    status = (F.when(F.col(exit_).isNull(), None).when(F.col("_dup") > 0, "duplicate_funding_schedule")
              .when(F.col("_ok") < F.col("_need"), "funding_schedule_missing_or_changed")
              .when(F.col("_off") > 0, "off_schedule_funding").when(F.col("_held") == 0, "complete_no_settlement_due")
              .when(F.col("_nopx") > 0, "settlement_price_missing").otherwise("complete_open_price_proxy"))
    known = F.when(status == "complete_no_settlement_due", F.lit(0.0)).when(status == "complete_open_price_proxy", F.col("_cash"))
    return j.select(*cols, known.alias("funding_pnl"), status.alias("funding_status"), F.col("_held").alias("funding_count"))


def two_leg_entries(signals: DataFrame, common: DataFrame, *, horizons: Sequence[int], max_wait: int, width: int) -> DataFrame:
    """Entry strictly after the signal and exit at/after entry + horizon on bars both legs have, each within
    ``max_wait``. ``common`` holds ts, a_open, b_open."""
    c = common.withColumn("k", F.lit(0))
    s = with_grid(materialize(signals, "signals").withColumn("k", F.lit(0)), horizon=list(horizons))
    e = asof_forward(s, c, by=["k"], take=["a_open", "b_open"], width=width, left_on="signal_ts", strict=True, prefix="en_")
    ok_e = F.col("en_source_ts") - F.col("signal_ts") <= max_wait
    e = materialize(e, "entries").withColumn("target_exit_ts", F.when(ok_e, F.col("en_source_ts") + F.col("horizon"))) \
        .withColumn("_t", F.coalesce("target_exit_ts", F.lit(2 ** 53)))
    x = asof_forward(e, c, by=["k"], take=["a_open", "b_open"], width=width, left_on="_t", prefix="ex_")
    ok_x = F.coalesce(F.col("ex_source_ts") - F.col("target_exit_ts") <= max_wait, F.lit(False))
    ok_e = F.coalesce(ok_e, F.lit(False))
    out = x.select(*signals.columns, "horizon", F.when(ok_e, F.col("en_source_ts")).alias("entry_ts"), "target_exit_ts",
                    F.when(ok_x, F.col("ex_source_ts")).alias("exit_ts"),
                    *[F.when(ok_e, F.col(f"en_{s_}_open")).alias(f"{s_}_entry_px") for s_ in "ab"],
                    *[F.when(ok_x, F.col(f"ex_{s_}_open")).alias(f"{s_}_exit_px") for s_ in "ab"],
                    F.when(~ok_e, "entry_missing_or_wait_exceeded").when(~ok_x, "exit_missing_or_wait_exceeded").otherwise("pending").alias("status"))
    return materialize(out, "trades")


def two_leg_pnl(ledger: DataFrame, *, quantity: float, fee_bp: float, slippage_bp: float) -> DataFrame:
    """Price P&L, costs, funding and net bp on the gross entry notional; ``a`` is long when the basis is
    positive. Funding columns a_funding_pnl and b_funding_pnl must be present."""
    side = F.when(F.col("basis_bp") > 0, 1).otherwise(-1)
    price = side * quantity * ((F.col("a_exit_px") - F.col("a_entry_px")) - (F.col("b_exit_px") - F.col("b_entry_px")))
    traded = quantity * (F.col("a_entry_px") + F.col("a_exit_px") + F.col("b_entry_px") + F.col("b_exit_px"))
    d = (ledger.withColumn("price_pnl", price).withColumn("cost", traded * (fee_bp + slippage_bp) / 10_000)
         .withColumn("funding_pnl", F.col("a_funding_pnl") + F.col("b_funding_pnl"))
         .withColumn("net_pnl", F.col("price_pnl") - F.col("cost") + F.col("funding_pnl")))
    notional = quantity * (F.col("a_entry_px") + F.col("b_entry_px"))
    status = (F.when(F.col("status") != "pending", F.col("status")).when(F.col("funding_pnl").isNotNull(), "complete").otherwise("funding_unknown"))
    return d.withColumn("net_bp", 10_000 * F.try_divide(F.col("net_pnl"), notional)).withColumn("status", status)


# -- paths ------------------------------------------------------------------------------------------

def path_metrics(events: DataFrame, bars: DataFrame, *, by: Sequence[str], step: int, stop_bp: float, take_bp: float,
                 positive: bool = True) -> DataFrame:
    """Excursions, underwater bars and the first barrier on [entry, exit) plus the exit open.

    A bar whose range covers both barriers is ambiguous; a gap through a barrier at an open is not. ``positive``: a path
    with a price of zero or less is invalid. Without it zero is a price like any other and a move from it infinite.
    """
    b = bars.select(*by, "ts", "open", "high", "low", "close")
    e = exact_lookup(events, b, by=by, at=F.col("entry_ts"), take={"open": "entry_px"})
    e = exact_lookup(e, b, by=by, at=F.col("exit_ts"), take={"open": "exit_open_px"})
    p = interval_join(e, b, by=by, start="entry_ts", stop="exit_ts", how="outer")
    long = F.col("direction") == "long"
    sign = F.when(long, 1.0).otherwise(-1.0)
    ratio = F.try_divide if positive else ieee_divide
    move = lambda c: sign * (ratio(F.col(c), F.col("entry_px")) - 1)
    worst, best = F.when(long, move("bar_low")).otherwise(move("bar_high")), F.when(long, move("bar_high")).otherwise(move("bar_low"))
    stop, take = F.lit(-stop_bp / 10_000), F.lit(take_bp / 10_000)
    stop_px = F.col("entry_px") * (1 + sign * stop)
    take_px = F.col("entry_px") * (1 + sign * take)
    past_stop = lambda c: F.when(long, F.col(c) <= stop_px).otherwise(F.col(c) >= stop_px)
    past_take = lambda c: F.when(long, F.col(c) >= take_px).otherwise(F.col(c) <= take_px)
    low_side, high_side = ("bar_low", "bar_high")
    touch_stop = F.when(long, past_stop(low_side)).otherwise(past_stop(high_side))
    touch_take = F.when(long, past_take(high_side)).otherwise(past_take(low_side))
    label = (F.when(past_stop("bar_open"), "stop_open").when(past_take("bar_open"), "take_open")
             .when(touch_stop & touch_take, "ambiguous").when(touch_stop, "stop_intrabar").when(touch_take, "take_intrabar"))
    o, h, l, c = (F.col(f"bar_{x}") for x in ("open", "high", "low", "close"))
    bad = (F.least(o, h, l, c) <= 0) & F.lit(positive)
    unordered = (l > F.least(o, c)) | (F.greatest(o, c) > h)
    under = F.when(long, c < F.col("entry_px")).otherwise(c > F.col("entry_px"))
    g = (p.withColumn("_w", worst).withColumn("_b", best).withColumn("_label", label)
         .groupBy(*e.columns).agg(F.count("bar_ts").alias("_n"), F.min("bar_ts").alias("_first"), F.count_if(bad).alias("_bad"), F.count_if(unordered).alias("_unord"),
                             F.min("_w").alias("_mae"), F.min_by("bar_ts", F.struct("_w", "bar_ts")).alias("_mae_ts"), F.max("_b").alias("_mfe"),
                             F.min_by("bar_ts", F.struct(-F.col("_b"), F.col("bar_ts"))).alias("_mfe_ts"), F.count_if(under).alias("underwater"),
                             F.min_by("_label", F.when(F.col("_label").isNotNull(), F.col("bar_ts"))).alias("_hit"),
                             F.min(F.when(F.col("_label").isNotNull(), F.col("bar_ts"))).alias("_hit_ts")))
    need = (F.col("exit_ts") - F.col("entry_ts")) / step
    reason = (F.when(F.col("_first").isNull() | (F.col("_first") != F.col("entry_ts")), "missing_entry_bar")
              .when((F.col("_n") != need) | (F.col("entry_ts") % step != 0), "missing_path_bar").when(F.col("_bad") > 0, "invalid_ohlc")
              .when(F.col("_unord") > 0, "invalid_ohlc_order")
              .when(F.col("exit_open_px").isNull() | ((F.col("exit_open_px") <= 0) & F.lit(positive)), "missing_or_invalid_exit_open").otherwise(""))
    end = move("exit_open_px")
    last = F.when(past_stop("exit_open_px"), "stop_open").when(past_take("exit_open_px"), "take_open")
    ok = F.col("reason") == ""
    out = g.withColumn("reason", reason)
    cols = {"mae_bp": 10_000 * F.least(F.col("_mae"), end, F.lit(0.0)), "mfe_bp": 10_000 * F.greatest(F.col("_mfe"), end, F.lit(0.0)),
            "mae_ts": F.when(F.least(F.col("_mae"), end) > 0, F.col("entry_ts")).when(end < F.col("_mae"), F.col("exit_ts")).otherwise(F.col("_mae_ts")),
            "mfe_ts": F.when(F.greatest(F.col("_mfe"), end) < 0, F.col("entry_ts")).when(end > F.col("_mfe"), F.col("exit_ts")).otherwise(F.col("_mfe_ts")),
            "underwater_bars": F.col("underwater"), "first_barrier": F.coalesce("_hit", last, F.lit("none")),
            "barrier_ts": F.coalesce("_hit_ts", F.when(last.isNotNull(), F.col("exit_ts")))}
    return out.select(*events.columns, "entry_px", "exit_open_px", "reason", *[F.when(ok, c).alias(n) for n, c in cols.items()])


def path_audit(events: DataFrame, bars: DataFrame, *, by: Sequence[str], step: int, cutoff: int, stop_bp: float,
               take_bp: float, cost_bp: float = 14.0, positive: bool = True) -> DataFrame:
    """First failing check per row, otherwise the path metrics; the source net return must be reproduced.

    ``events`` carries entry_ts, exit_ts, direction, source_net_bp, source_entry_px, source_exit_px. ``positive`` as in
    ``path_metrics``; without it the net return of an entry at zero may be infinite too.
    """
    m = path_metrics(events, bars, by=by, step=step, stop_bp=stop_bp, take_bp=take_bp, positive=positive)
    en, ex, d = F.col("entry_ts"), F.col("exit_ts"), F.col("direction")
    sign = F.when(d == "long", 1.0).otherwise(-1.0)
    ratio = F.try_divide if positive else ieee_divide
    gross = sign * (ratio(F.col("exit_open_px"), F.col("entry_px")) - 1) * 10_000
    bad_px = lambda c: F.col(c).isNull() | ((F.col(c) <= 0) & F.lit(positive))
    net = F.col("source_net_bp")
    bad_net = ~finite("source_net_bp") & (F.lit(positive) | net.isNull() | finite(gross))
    off = lambda s, a: F.col(s).isNotNull() & (F.abs(F.col(s) - F.col(a)) > 1e-9)
    reason = (F.when(en.isNull() | ex.isNull(), "invalid_timestamp").when((en < 0) | (ex <= en), "invalid_interval")
              .when(ex >= cutoff, "exit_after_cutoff").when((en % step != 0) | (ex % step != 0), "unaligned_timestamp")
              .when(d.isNull() | ~d.isin("long", "short"), "unknown_direction").when(bad_net, "invalid_source_net")
              .when(bad_px("entry_px") | bad_px("exit_open_px"), "missing_or_invalid_endpoint_open")
              .when(off("source_entry_px", "entry_px"), "source_entry_price_mismatch").when(off("source_exit_px", "exit_open_px"), "source_exit_price_mismatch")
              .when((F.abs(gross - (net + cost_bp)) > 1e-6) & (gross != net + cost_bp), "source_net_mismatch").otherwise(F.col("reason")))
    out = m.withColumn("reason", reason).withColumn("path_complete", F.col("reason") == "")
    keep = ["mae_bp", "mae_ts", "mfe_bp", "mfe_ts", "underwater_bars", "first_barrier", "barrier_ts"]
    return out.select(*events.columns, "entry_px", "exit_open_px", "reason", "path_complete",
                      F.when(F.col("path_complete"), gross).alias("reconstructed_gross_bp"),
                      *[F.when(F.col("path_complete"), F.col(c)).alias(c) for c in keep])


def excursion_summary(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Excursion quantiles and barrier rates; a group of rejects only still has its row."""
    ok = F.col("path_complete")
    share = lambda cond: F.avg(F.when(ok, cond.cast("int")))
    aggs = [
        F.count("*").alias("events"), F.count_if(ok).alias("valid_path_count"), F.count_if(~ok).alias("missing_path_count"), share(F.col("first_barrier") != "none").alias("any_barrier_rate"),
        share(F.startswith("first_barrier", F.lit("stop"))).alias("stop_rate"), share(F.startswith("first_barrier", F.lit("take"))).alias("take_rate"),
        share(F.col("first_barrier") == "ambiguous").alias("ambiguous_rate")]
    columns = {c: F.when(ok, F.col(c)) for c in ("mae_bp", "mfe_bp", "underwater_bars")}
    wanted = {f"{m}_p{int(p * 100):02d}_bp": (f"{m}_bp", p) for m in ("mae", "mfe") for p in (0.05, 0.5, 0.95)}
    return with_quantiles(paths, keys, aggs, columns, {**wanted, "underwater_p50": ("underwater_bars", 0.5)})


# -- execution scenarios ----------------------------------------------------------------------------

def reprice_scenarios(events: DataFrame, volumes: DataFrame, scenarios: Sequence[dict], *, by: Sequence[str], source_cost_bp: float = 14.0) -> DataFrame:
    """Every event under every scenario: participation, square-root impact, capacity status and net return.

    ``volumes`` is the output of ``prior_volume_median``; an unknown volume is never treated as zero cost.
    """
    take = lambda leg: {"historical_volume": f"{leg}_volume", "actual_volume": f"{leg}_actual"}
    j = exact_lookup(events, volumes, by=by, at=F.col("entry_ts"), take=take("entry"))
    j = exact_lookup(j, volumes, by=by, at=F.col("exit_ts"), take=take("exit"))
    rows = F.array(*[F.struct(*[F.lit(s[k]).alias(k) for k in ("scenario", "notional", "fee_bp", "slippage_bp", "impact_bp", "max_participation")])
                     for s in scenarios])
    d = j.withColumn("_s", F.explode(rows)).select(*j.columns, "_s.*")
    for leg in ("entry", "exit"):
        part = F.col("notional") / F.col(f"{leg}_volume")
        d = (d.withColumn(f"{leg}_participation", part)
             .withColumn(f"{leg}_cost_bp", F.col("fee_bp") + F.col("slippage_bp") + F.col("impact_bp") * F.sqrt(part))
             .withColumn(f"{leg}_capacity", F.when(part.isNull(), "unknown_zero_or_missing").when(part <= F.col("max_participation"), "within_cap")
                         .otherwise("cap_breach"))
             .withColumn(f"{leg}_actual_participation", F.col("notional") / F.col(f"{leg}_actual")))
    priced = F.col("entry_volume").isNotNull() & F.col("exit_volume").isNotNull()
    status = (F.when(F.col("entry_capacity") != "within_cap", "skipped_entry").when(F.col("exit_capacity") == "within_cap", "complete")
              .when(F.col("exit_capacity") == "cap_breach", "exit_capacity_breach").otherwise("incomplete_exit"))
    gross = F.col("source_net_bp") + source_cost_bp
    return (d.withColumn("source_implied_gross_bp", gross).withColumn("priced", priced)
            .withColumn("scenario_net_bp", F.when(priced, gross - F.col("entry_cost_bp") - F.col("exit_cost_bp")))
            .withColumn("execution_status", status))


def common_set(ledger: DataFrame, event: str, *, status: str = "execution_status", want: str = "complete") -> DataFrame:
    """Events complete in every scenario."""
    return ledger.groupBy(event).agg(F.bool_and(F.col(status) == want).alias("_all")).where("_all").select(event)


def scenario_summary(ledger: DataFrame, *, event: str, reference: str) -> DataFrame:
    """Counts, known-only sums and the difference to the reference scenario on the common set."""
    s, cap = F.col("execution_status"), lambda leg, v: F.count_if(F.col(f"{leg}_capacity") == v)
    w = Window.partitionBy(event)  # an event has one row per scenario
    j = (ledger.withColumn("_ref", F.max(F.when(F.col("scenario") == reference, F.col("scenario_net_bp"))).over(w))
         .withColumn("_common", F.bool_and(s == "complete").over(w)))
    on = F.col("_common")
    n, known = F.count("*"), F.count_if("priced")
    net = F.avg(F.when(F.col("priced"), F.col("scenario_net_bp")))
    return j.groupBy("scenario").agg(
        n.alias("events_input"), F.count_if(s == "complete").alias("events_complete"), F.count_if(s == "skipped_entry").alias("entry_skipped"),
        F.count_if(s.isin("exit_capacity_breach", "incomplete_exit")).alias("exit_incomplete"),
        (F.count_if(s == "skipped_entry") / n).alias("entry_skip_rate"), (cap("exit", "cap_breach") / n).alias("exit_breach_rate"),
        cap("entry", "unknown_zero_or_missing").alias("entry_unknown"), cap("entry", "cap_breach").alias("entry_cap_breach"),
        cap("exit", "unknown_zero_or_missing").alias("exit_unknown"), cap("exit", "cap_breach").alias("exit_cap_breach"),
        known.alias("known_events"), F.sum("scenario_net_bp").alias("known_net_sum_bp"), net.alias("known_net_mean_bp"),
        F.when(known == n, net).alias("full_net_mean_bp"),
        F.when(known == n, "full_hypothetical_all_targets").otherwise("incomplete_overall_net").alias("net_result_label"),
        F.count_if(on).alias("common_complete_events"), F.avg(F.when(on, F.col("scenario_net_bp"))).alias("common_set_net_mean_bp"),
        F.avg(F.when(on, F.col("scenario_net_bp") - F.col("_ref"))).alias("common_set_delta_bp"))


# -- splits and labels ------------------------------------------------------------------------------

def year_start_ms(year: Column) -> Column:
    return F.unix_millis(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def embargo_split(events: DataFrame, keys: Sequence[str], years: Sequence[int], *, train_start: int) -> DataFrame:
    """Fold label per event and year: train exits end a horizon before the year, test entries begin a horizon
    into it and exit inside it. The horizon is each strategy's longest hold."""
    h = events.groupBy(*keys).agg(F.greatest(F.max(F.col("exit_ts") - F.col("entry_ts")), F.lit(0)).alias("horizon_ms"))
    e = with_grid(events.join(h, list(keys)), fold_year=list(years))
    a, z = year_start_ms(F.col("fold_year").cast("int")), year_start_ms((F.col("fold_year") + 1).cast("int"))
    part = (F.when((F.col("detect_ts") >= train_start) & (F.col("exit_ts") < a - F.col("horizon_ms")), "train")
            .when((F.col("entry_ts") >= a + F.col("horizon_ms")) & (F.col("exit_ts") < z), "test"))
    return e.withColumn("part", part).where("part IS NOT NULL")


def zone_label(ts: str, cutoff: int, start: int, end: int) -> Column:
    t = F.col(ts)
    return F.when(t < cutoff, "baseline").when(t < start, "quarantine").when(t < end, "score").otherwise("after_window")


# -- summaries --------------------------------------------------------------------------------------

def year_breakdown(ledger: DataFrame, keys: Sequence[str], *, ts: str, value: str) -> DataFrame:
    return ledger.groupBy(*keys, F.year(F.timestamp_millis(ts)).alias("yr")).agg(F.count("*").alias("n"), F.avg(value).alias("mean_bp"))


def variant_summary(ledger: DataFrame, keys: Sequence[str], value: str = "net_bp") -> DataFrame:
    """Count, mean, median, win rate, deviation and t of each variant, all from one pass of value counts. A variant
    without a known value has a row with 0 events."""
    known = F.when(F.col(value).isNotNull(), F.col(value))
    stats = {"n_events": ("v", lambda v, n: F.sum(n)), "mean_bp": ("v", lambda v, n: F.sum(v * n) / F.sum(n)), "_pos": ("v", lambda v, n: F.sum(F.when(v > 0, n).otherwise(0))),
             "_sq": ("v", lambda v, n: F.sum(v * v * n)), "_u": ("u", lambda v, n: F.sum(n))}
    q = quantiles(ledger, keys, {"v": known, "u": F.when(F.col(value).isNull(), 0)}, {"median_bp": ("v", 0.5)}, stats=stats)
    n, mean = F.coalesce("n_events", F.lit(0)), F.col("mean_bp")
    sd = F.when(n > 1, F.sqrt(F.greatest(F.col("_sq") - n * mean * mean, F.lit(0.0)) / (n - 1)))
    return q.select(*keys, n.alias("n_events"), "mean_bp", "median_bp", F.when(n > 0, F.col("_pos") / n).alias("win_rate"), sd.alias("std_bp"), F.when(sd > 0, mean / (sd / F.sqrt(n))).alias("t_stat"))


def group_forward_table(df: DataFrame, group: Sequence[str], horizons: Sequence[str]) -> DataFrame:
    """Count, mean and median per group for several outcome columns."""
    aggs = [F.count("*").alias("n"), *[F.avg(h).alias(f"mean_{h}") for h in horizons]]
    return with_quantiles(df, group, aggs, {h: F.col(h) for h in horizons}, {f"median_{h}": (h, 0.5) for h in horizons})


def cell_summary(ledger: DataFrame, keys: Sequence[str], *, month: Column) -> DataFrame:
    """Per cell and direction with the two directions pooled as 'both'."""
    side = F.when(F.col("direction") > 0, "up").otherwise("down")
    d = ledger.withColumn("_m", F.when(F.col("complete"), month)).withColumn("direction", F.explode(F.array(side, F.lit("both"))))
    done = F.col("complete")
    aggs = [
        F.count("*").alias("events"), F.count_if(done).alias("complete_events"),
        F.count_if(~done).alias("incomplete_events"), F.count_distinct("_m").alias("active_months"),
        F.avg("gross_bp").alias("mean_gross_bp"),
        F.avg("net_bp").alias("mean_net_bp"), F.avg((F.col("net_bp") > 0).cast("int")).alias("share_net_positive"),
        F.avg("leader_same_interval_bp").alias("mean_leader_same_interval_bp"),
        F.avg(F.when(done, F.col("leader_window_bp"))).alias("mean_leader_window_bp")]
    return with_quantiles(d, [*keys, "direction"], aggs, {"gross": F.col("gross_bp")}, {"median_gross_bp": ("gross", 0.5)})


def status_counts(ledger: DataFrame, keys: Sequence[str], *, status: str = "status", done: str = "complete",
                  parts: Sequence[str] = ("price_pnl", "cost", "funding_pnl"), net: str = "net_bp") -> DataFrame:
    """Status histogram, known and complete subtotals and net quantiles per horizon."""
    hist = (ledger.groupBy(*keys, status).agg(F.count("*").alias("_n")).groupBy(*keys)
            .agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", status, F.col("_n").cast("string")))), ";").alias("status_counts")))
    ok = F.col(status) == done
    aggs = [F.count("*").alias("events"), F.count_if(ok).alias("complete_events")]
    for p in parts:
        aggs += [F.sum(p).alias(f"known_{p}"), F.count(p).alias(f"known_{p}_events"), F.sum(F.when(ok, F.col(p))).alias(f"complete_{p}")]
    g = with_quantiles(ledger, keys, aggs, {"net": F.when(ok, F.col(net))}, {f"net_p{int(q * 100):02d}": ("net", q) for q in (0.05, 0.5, 0.95)})
    return g.join(hist, list(keys))
