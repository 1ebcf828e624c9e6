"""Early-warning states for a whole bar history. Windows are complete or unknown; nothing is filled."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_backward, asof_forward
from .scan import CHUNK, own_rows, previous, range_halo


def available_prefix(bars: DataFrame, *, as_of: str, step: int, received: str | None = None) -> DataFrame:
    """Bars complete at ``as_of``; with ``received`` also those that had arrived by then."""
    ok = F.col("ts") + step <= F.col(as_of)
    if received:
        ok = ok & (F.col(received) <= F.col(as_of))
    return bars.where(ok)


def prefix_problems(bars: DataFrame, keys: Sequence[str], *, as_of: str, step: int, mode: str = "observed", received: str = "received_ts") -> DataFrame:
    """``bars`` with ``problem``: NULL for a bar of the causal prefix, else why it is no part of it. not_complete, not_received
    and not_yet_received only mean that the bar is not there yet; all other reasons are faults, looked at in the prefix
    alone, so that a later payload can't change a past result."""
    end, cutoff = F.col("ts") + step, F.col(as_of)
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    priced, amounts = F.lit(True), F.lit(True)
    for c in prices:
        priced = priced & finite(c.cast("double")) & (c > 0)
    o, h, l, c = prices
    quote, buy = F.col("quote_volume").cast("double"), F.col("taker_buy_quote").cast("double")
    for v in (quote, buy):
        amounts = amounts & (v.isNull() | (finite(v) & (v >= 0)))
    problem = F.when(F.col("ts") % step != 0, "misaligned_time").when(end > cutoff, "not_complete")
    if mode == "observed":
        at = F.col(received)
        problem = problem.when(at.isNull(), "not_received").when(at < end, "received_before_completion").when(at > cutoff, "not_yet_received")
    problem = (problem.when(~F.coalesce(priced, F.lit(False)), "invalid_price").when(~((l <= F.least(o, c)) & (F.greatest(o, c) <= h)), "invalid_ohlc_order")
               .when(~F.coalesce(amounts, F.lit(False)), "invalid_volume").when(buy.isNotNull() & (quote.isNull() | (buy > quote)), "taker_above_total"))
    d = bars.withColumn("_p", problem)
    # A time that two bars of the prefix share is a fault of both; only times are counted, so no key is in one task.
    twice = d.where("_p IS NULL").groupBy(*keys, "ts").agg(F.count("*").alias("_n")).where("_n > 1")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "ts")]
    j = d.join(twice.select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, "ts")], "_n"), reduce(and_, same), "left")
    return j.select(*bars.columns, F.when(F.col("_p").isNotNull(), F.col("_p")).when(F.col("_n").isNotNull(), "duplicate_time").alias("problem"))


def receipt_report(log: DataFrame, clocks: DataFrame, keys: Sequence[str], *, step: int, width: int, received: str = "received_ts") -> DataFrame:
    """Per key and batch of a two-clock replay: rows received, on time, late, dropped by the watermark, and ``waiting``, the
    rows complete by event time at the batch's cutoff that came later.

    A row waits from the first cutoff after its completion to its own batch. Its beginning is looked up once and
    counted there, its end in its batch; running sums over the batches give the waiting rows of each.
    """
    at = log.withColumn("_one", F.lit(0)).withColumn("_done", F.col("ts") + step)
    due = asof_forward(at, clocks.select(F.lit(0).alias("_one"), "cutoff", F.col("batch").alias("due")), by=["_one"], take=["due"], width=width, left_on="_done", right_on="cutoff")
    moves = due.withColumn("_waits", F.coalesce(F.col("due") < F.col("batch"), F.lit(False)))
    is_ = lambda s: F.when(F.col("status") == s, 1).otherwise(0)
    own = [F.lit(1).alias("received"), *[is_(s).alias(s) for s in ("on_time", "late", "dropped")], F.when(F.col("_waits"), -1).otherwise(0).alias("_w")]
    began = moves.where("_waits").select(*keys, F.col("due").alias("batch"), *[F.lit(0).alias(c) for c in ("received", "on_time", "late", "dropped")], F.lit(1).alias("_w"))
    every = log.select(*keys).distinct().join(F.broadcast(clocks.select("batch")))  # one row per batch
    zero = every.select(*keys, "batch", *[F.lit(0).alias(c) for c in ("received", "on_time", "late", "dropped", "_w")])
    g = moves.select(*keys, "batch", *own).unionByName(began).unionByName(zero).groupBy(*keys, "batch").agg(*[F.sum(c).alias(c) for c in ("received", "on_time", "late", "dropped", "_w")])
    w = Window.partitionBy(*keys).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # one row per batch
    return g.withColumn("waiting", F.sum("_w").over(w)).drop("_w")


def _win(keys: Sequence[str], lo: int, hi: int):
    return Window.partitionBy(*keys, CHUNK).orderBy("ts").rangeBetween(lo, hi)


def window_metrics(bars: DataFrame, keys: Sequence[str], spans: dict[str, int], *, step: int, width: int) -> DataFrame:
    """Return, range, volume and taker imbalance over the last n bars for several n; NULL unless all n exist."""
    back = (max(spans.values()) - 1) * step
    h = range_halo(bars, width, back=back)
    cols: dict[str, Column] = {}
    for name, n in spans.items():
        w = _win(keys, -(n - 1) * step, 0)
        full = F.count("*").over(w) == n
        vol, buy = F.sum("quote_volume").over(w), F.sum("taker_buy_quote").over(w)
        known = full & (F.count("quote_volume").over(w) == n) & (F.count("taker_buy_quote").over(w) == n)
        cols[f"{name}_return"] = F.when(full, F.try_divide(F.col("close"), F.first("open").over(w)) - 1)
        cols[f"{name}_range"] = F.when(full, F.max("high").over(w) - F.min("low").over(w))
        cols[f"{name}_volume"] = F.when(known, vol)
        cols[f"{name}_imbalance"] = F.when(known & (vol > 0), 2 * buy / vol - 1)
        cols[f"{name}_low"] = F.when(full, F.min("low").over(w))
        cols[f"{name}_high"] = F.when(full, F.max("high").over(w))
    return own_rows(h.withColumns(cols))


def _at(keys: Sequence[str], col: str, offset: int) -> Column:
    return F.max(col).over(_win(keys, -offset, -offset))


def _median(values: list[Column]) -> Column:
    """Median of a fixed list, NULL when any value is unknown."""
    known = F.lit(True)
    for v in values:
        known = known & v.isNotNull()
    s = F.array_sort(F.array(*values))
    n = len(values)
    return F.when(known, (F.get(s, F.lit((n - 1) // 2)) + F.get(s, F.lit(n // 2))) / 2)


def warning_states(bars: DataFrame, keys: Sequence[str], *, step: int, width: int, context: int = 60, short: int = 15, confirm: int = 5, confirm_bars: int = 2,
                   reclaim: int = 3, pressure: float = 0.1, compression: float = 0.6, near_atr: float = 1.0, breakout_volume: float = 1.5,
                   second: DataFrame | None = None, levels: DataFrame | None = None) -> DataFrame:
    """Metrics, flags, confirmation and state at the close of every bar.

    Levels come from the ``context`` bars before the confirmation blocks, blocks are aligned to ``confirm`` bars. With
    ``levels`` (keys, support, resistance, known_at, expires_at) the latest one known at the bar's close counts while it has not
    expired, and only bars that begin at or after its ``known_at`` can confirm or reclaim it; without a valid one the state is
    insufficient_data. ``second`` are the bars of another market of the same keys: where its context window is complete at
    the same close, its flow adds flags of its own (..._second); otherwise it says nothing.
    States: support_lost > price_breakout_confirmed > breakout_faded > early_watch > neutral, insufficient_data
    when the needed history has a gap.
    """
    keys = list(keys)
    m = window_metrics(bars, keys, {"short": short, "context": context, "block": confirm}, step=step, width=width)
    size = confirm * step
    need = context + max(short, confirm * confirm_bars) + 2 * confirm
    h = range_halo(m, width, back=(need + context + 2 * confirm) * step)
    # Offset from this bar to the last bar of the latest finished block.
    end_gap = ((F.col("ts") + step) % size).cast("bigint")
    # true range of the block ending at this bar: needs the close before it
    prior_close = _at(keys, "close", size)
    tr = F.greatest(F.col("block_range"), F.abs(F.col("block_high") - prior_close), F.abs(F.col("block_low") - prior_close))
    h = h.withColumn("_have", F.count("*").over(_win(keys, -(need - 1) * step, 0))).withColumn("_tr", tr).withColumn("_end_gap", end_gap)
    # Block-level quantities live on the bar that ends an aligned block; read them at fixed offsets from it.
    blocks = context // confirm
    h = h.withColumn("_typical", _median([_at(keys, "block_volume", (j) * size) for j in range(1, blocks + 1)])) \
         .withColumn("_ratio", F.when(F.col("_typical") > 0, F.col("block_volume") / F.col("_typical")))
    h = h.withColumn("_scale", _median([_at(keys, "_tr", i * size) for i in range(blocks)]))
    h = h.withColumn("_prior_ranges", _median([_at(keys, "short_range", (i + 1) * short * step) for i in range(context // short)]))
    ref_off = confirm_bars * size
    h = h.withColumn("_res", _at(keys, "context_high", ref_off)).withColumn("_sup", _at(keys, "context_low", ref_off))
    aligned = own_rows(h).select(*keys, F.col("ts").alias("_bts"), "close", "_ratio", "_scale", "_res", "_sup")
    base = own_rows(h).select(*bars.columns, "short_return", "short_range", "short_volume", "short_imbalance", "context_return", "context_range", "context_volume",
                              "context_imbalance", "_have", "_end_gap", "_prior_ranges")

    def look(d: DataFrame, at: Column, names: dict[str, str]) -> DataFrame:
        src = aligned.select(*keys, F.col("_bts").alias("_j"), *[F.col(a).alias(n) for a, n in names.items()])
        return d.withColumn("_j", at).join(src, [*keys, "_j"], "left").drop("_j")

    last_block = F.col("ts") - F.col("_end_gap")
    d = look(base, last_block, {"_res": "resistance", "_sup": "support", "close": "_c0", "_ratio": "_r0"})
    for i in range(1, confirm_bars):
        d = look(d, last_block - i * size, {"close": f"_c{i}", "_ratio": f"_r{i}"})
    vol_end = F.col("ts") + step - short * step
    d = look(d, (F.floor(vol_end / size) * size - step).cast("bigint"), {"_scale": "atr"})
    # closes inside the short window relative to support, only bars starting at or after the levels became known
    ref_end = F.col("ts") + step - F.col("_end_gap") - confirm_bars * size
    if levels is None:
        d = d.withColumn("_known", ref_end)
    else:
        at = d.drop("resistance", "support").withColumn("_close_ts", F.col("ts") + step)
        found = asof_backward(at, levels, by=keys, take=["support", "resistance", "expires_at"], width=width, left_on="_close_ts", right_on="known_at", prefix="_l_")
        valid = (F.col("_l_support") > 0) & (F.col("_l_support") <= F.col("_l_resistance")) & (F.col("_l_expires_at").isNull() | (F.col("_l_expires_at") > F.col("_close_ts")))
        d = found.withColumns({"support": F.when(valid, F.col("_l_support")), "resistance": F.when(valid, F.col("_l_resistance")), "_known": F.when(valid, F.col("_l_source_ts"))})
        d = d.drop("_close_ts", *[c for c in d.columns if c.startswith("_l_")])
    if second is not None:
        other = window_metrics(second, keys, {"short": short, "context": context}, step=step, width=width)
        names = {f"second_{w}_{m}": F.when(F.col("context_return").isNotNull(), F.col(f"{w}_{m}")) for w in ("short", "context") for m in ("return", "imbalance")}
        d = d.join(other.select(*keys, "ts", *[c.alias(n) for n, c in names.items()]), [*keys, "ts"], "left")
    hh = range_halo(d, width, back=(short - 1) * step)
    recent = F.collect_list(F.struct("ts", "close")).over(_win(keys, -(short - 1) * step, 0))
    d = own_rows(hh.withColumn("_recent", F.filter(F.array_sort(recent), lambda b: b.ts >= F.col("_known"))))
    tail = F.slice("_recent", -reclaim, reclaim)
    head = F.slice(F.col("_recent"), F.lit(1), F.greatest(F.size("_recent") - reclaim, F.lit(0)))
    reclaimed = (F.size("_recent") > reclaim) & F.exists(head, lambda b: b.close < F.col("support")) & F.forall(tail, lambda b: b.close > F.col("support"))
    dist = F.col("resistance") - F.col("close")
    near = F.coalesce((F.col("atr") > 0) & (dist >= 0) & (dist <= near_atr * F.col("atr")), F.lit(False))
    ratio = F.when(F.col("_prior_ranges") > 0, F.col("short_range") / F.col("_prior_ranges"))
    price_ok, volume_ok = F.lit(True), F.lit(False)
    for i in range(confirm_bars):
        begins = F.col("ts") + step - F.col("_end_gap") - (i + 1) * size
        price_ok = price_ok & F.coalesce((F.col(f"_c{i}") > F.col("resistance")) & (begins >= F.col("_known")), F.lit(False))
        volume_ok = volume_ok | F.coalesce(F.col(f"_r{i}") >= breakout_volume, F.lit(False))
    resil = lambda p: F.when((F.col(f"{p}_imbalance") <= -pressure) & (F.col(f"{p}_return") >= 0), f"sell_resilience_{p}")
    buys = lambda p: near & (F.col(f"{p}short_imbalance") >= pressure) & (F.col(f"{p}short_return") > 0)
    more = second is not None
    flags = F.array_compact(F.array(
        resil("short"), resil("context"), *[F.when((F.col(f"second_{w}_imbalance") <= -pressure) & (F.col(f"second_{w}_return") >= 0), f"sell_resilience_second_{w}") for w in ("short", "context") if more],
        F.when(near & (ratio <= compression), "compression_near_resistance"), F.when(buys(""), "buy_pressure_near_resistance"),
        *[F.when(buys("second_"), "buy_pressure_near_resistance_second") for _ in range(more)],
        F.when(reclaimed, "support_reclaimed"), F.when(price_ok, "resistance_close_confirmation")))
    ready = (F.col("_have") == need) & F.col("support").isNotNull() & (F.col("support") != F.col("resistance"))
    above = F.col("close") > F.col("resistance")
    state = (F.when(~F.coalesce(ready, F.lit(False)), "insufficient_data").when(F.col("close") < F.col("support"), "support_lost")
             .when(price_ok & above, "price_breakout_confirmed").when(price_ok, "breakout_faded").when(F.size("flags") > 0, "early_watch").otherwise("neutral"))
    out = d.withColumn("compression", ratio).withColumn("near_resistance", near).withColumn("price_confirmed", price_ok).withColumn("volume_confirmed", volume_ok) \
        .withColumn("flags", flags).withColumn("state", state)
    return out.select(*bars.columns, "short_return", "short_imbalance", "context_imbalance", "support", "resistance", "atr", "compression", "near_resistance",
                      "price_confirmed", "volume_confirmed", F.when(F.col("state") == "insufficient_data", F.array().cast("array<string>")).otherwise(F.col("flags")).alias("flags"), "state")


def publishable_state(state: str, *, age: Column, max_age: int, clock_valid: Column, reference_expires: Column, published: Column, mode: Column | str = "observed") -> Column:
    """What may be shown live: nothing without data, a market-time replay only as such, then an invalid clock, an expired
    reference and staleness."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return (F.when(F.col(state) == "insufficient_data", "insufficient_data").when(mode == "market_time_replay", "historical_replay").when(~clock_valid, "invalid_clock")
            .when(reference_expires.isNotNull() & (reference_expires <= published), "expired_reference").when(age > max_age, "stale_data").otherwise(F.col(state)))


def flow_and_volume(bars: DataFrame, keys: Sequence[str], n: int, *, step: int, width: int) -> DataFrame:
    """Exact n-step return, signed taker flow of the last n bars, their volume over the n bars before."""
    w1, w0 = _win(keys, -(n - 1) * step, 0), _win(keys, -(2 * n - 1) * step, -n * step)
    move = _win(keys, -n * step, 0)
    h = range_halo(bars, width, back=2 * n * step)
    full, prior = F.count("*").over(w1) == n, F.count("*").over(w0) == n
    q, b = F.sum("quote_volume").over(w1), F.sum("taker_buy_quote").over(w1)
    return own_rows(h.withColumns({
        "exact_return_pct": F.when(F.count("*").over(move) == n + 1, (F.try_divide(F.col("close"), F.first("close").over(move)) - 1) * 100),
        "signed_taker_quote": F.when(full, 2 * b - q), "taker_imbalance_pct": F.when(full & (q != 0), (2 * b / q - 1) * 100),
        "volume_ratio": F.when(full & prior, F.try_divide(q, F.sum("quote_volume").over(w0)))}))


def oi_changes(anchors: DataFrame, oi: DataFrame, keys: Sequence[str], horizons: dict[str, int], *, value: str, width: int) -> DataFrame:
    """Latest value at the anchor and its change against the latest one at or before anchor - horizon, with lags.
    Targets of all horizons are looked up in one as-of."""
    targets = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(h).alias("span")) for n, h in {"now": 0, **horizons}.items()])
    a = anchors.withColumn("_t", F.explode(targets)).select(*anchors.columns, "_t.horizon", (F.col("ts") - F.col("_t.span")).alias("target"))
    j = asof_backward(a, oi, by=keys, take=[value], width=width, left_on="target", prefix="o_")
    g = j.groupBy(*anchors.columns).agg(
        F.max(F.when(F.col("horizon") == "now", F.col(f"o_{value}"))).alias("latest"), F.max(F.when(F.col("horizon") == "now", F.col("o_age"))).alias("lag_ms"),
        *[F.max(F.when(F.col("horizon") == n, F.col(f"o_{value}"))).alias(f"_{n}") for n in horizons],
        *[F.max(F.when(F.col("horizon") == n, F.col("o_age"))).alias(f"prior_lag_{n}") for n in horizons])
    return g.select(*anchors.columns, "latest", "lag_ms", *[(F.try_divide("latest", f"_{n}") * 100 - 100).alias(f"change_pct_{n}") for n in horizons], *[f"prior_lag_{n}" for n in horizons])


def since_baseline(bars: DataFrame, keys: Sequence[str], *, baseline: int, plan: int, cancel: Column, limit: Column, step: int) -> DataFrame:
    """Excursions after a baseline close, the first close below a cancel level and the first touch of a limit."""
    post = F.col("ts") >= baseline
    later = F.col("ts") >= plan
    g = bars.groupBy(*keys).agg(
        F.max(F.when(F.col("ts") + step == baseline, F.col("close"))).alias("previous_close"), F.max_by("close", "ts").alias("current_close"),
        F.max(F.when(post, F.col("high"))).alias("post_high"), F.min(F.when(post, F.col("low"))).alias("post_low"),
        F.min_by("ts", F.when(post, F.struct(-F.col("high"), F.col("ts")))).alias("post_high_ts"),
        F.min(F.when(later & (F.col("close") < cancel), F.col("ts"))).alias("first_close_below_cancel_ts"),
        F.min(F.when(later & (F.col("low") <= limit), F.col("ts"))).alias("first_limit_touch_ts"))
    return g.withColumns({"return_pct": (F.col("current_close") / F.col("previous_close") - 1) * 100, "min_excursion_pct": (F.col("post_low") / F.col("previous_close") - 1) * 100,
                          "max_excursion_pct": (F.col("post_high") / F.col("previous_close") - 1) * 100})


def hourly_metrics(bars: DataFrame, keys: Sequence[str], spans: Sequence[int], *, sd_bars: int, step: int, width: int) -> DataFrame:
    """Return, high and low over n contiguous bars, and the bar-return deviation over ``sd_bars``."""
    p = previous(bars, keys, ["ts"], width, ["ts", "close"])
    r = p.withColumn("_r", F.when(F.col("prev_ts") == F.col("ts") - step, F.ln(F.col("close") / F.col("prev_close")))).drop("prev_ts", "prev_close")
    h = range_halo(r, width, back=max(*spans, sd_bars) * step)
    cols = {}
    for n in spans:
        move, inside = _win(keys, -n * step, 0), _win(keys, -(n - 1) * step, 0)
        full = F.count("*").over(move) == n + 1
        cols[f"return_pct_{n}"] = F.when(full, (F.try_divide(F.col("close"), F.first("close").over(move)) - 1) * 100)
        cols[f"high_{n}"], cols[f"low_{n}"] = F.when(full, F.max("high").over(inside)), F.when(full, F.min("low").over(inside))
    w = _win(keys, -(sd_bars - 1) * step, 0)
    cols["return_sd"] = F.when(F.count("_r").over(w) == sd_bars, F.stddev_pop("_r").over(w))
    return own_rows(h.withColumns(cols)).drop("_r")


def series_audit(bars: DataFrame, keys: Sequence[str], *, step: int, width: int | None) -> DataFrame:
    """Counts and flags: unique times, contiguous, prices consistent."""
    p = previous(bars, keys, ["ts"], width, ["ts"])
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    fine = (F.least(o, h, l, c) > 0) & (l <= F.least(o, c)) & (F.greatest(o, c) <= h)
    return p.groupBy(*keys).agg(F.count("*").alias("count"), F.coalesce(F.bool_and(F.col("prev_ts") != F.col("ts")), F.lit(True)).alias("unique_timestamps"),
                                F.coalesce(F.bool_and(F.col("ts") - F.col("prev_ts") == step), F.lit(True)).alias("contiguous"), F.bool_and(fine).alias("ohlc_consistent"),
                                F.min("ts").alias("first_ts"), F.max("ts").alias("last_open_ts"))
