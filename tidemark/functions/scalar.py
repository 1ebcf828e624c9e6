"""Column expressions: prices, labels, clocks. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import DAY, HOUR, MINUTE


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scan_series(df: DataFrame, t0: int | None = None, t1: int | None = None, *, closed: bool = False,
                ts: str = "ts", **equal) -> DataFrame:
    """Rows with the given key values and t0 <= ts < t1 (<= t1 when ``closed``); every predicate reaches the scan."""
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    if t0 is not None:
        df = df.where(F.col(ts) >= t0)
    if t1 is not None:
        df = df.where(F.col(ts) <= t1 if closed else F.col(ts) < t1)
    return df


def finite(x: str | Column) -> Column:
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_or_null(x: str | Column) -> Column:
    return F.when(finite(x), _c(x))


def ieee_divide(a: Column, b: Column) -> Column:
    """Ratio of doubles that a zero divisor makes infinite, or NaN for zero by zero, instead of NULL."""
    at_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def bar_problem(step: int = MINUTE, ts: str = "ts") -> Column:
    """First reason a bar is unusable, NULL when it is fine."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    ok = finite("open") & finite("high") & finite("low") & finite("close")
    return (F.when(F.col(ts) % step != 0, "unaligned")
            .when(~ok | (F.least(o, h, l, c) <= 0), "invalid_ohlc")
            .when((l > F.least(o, c)) | (F.greatest(o, c) > h), "invalid_ohlc_order"))


def normalise_epoch(v: str | Column) -> Column:
    """Microseconds become milliseconds; milliseconds stay."""
    v = _c(v)
    return F.when(v > F.lit(100_000_000_000_000), F.floor(v / 1000)).otherwise(v).cast("bigint")


def simple_return(now: str | Column, then: str | Column) -> Column:
    return F.try_divide(_c(now), _c(then)) - 1


def log_return(now: str | Column, then: str | Column) -> Column:
    return F.ln(F.try_divide(_c(now), _c(then)))


def bp(x: Column) -> Column:
    return x * 10_000


def net_return_bp(entry: str | Column, exit_: str | Column, direction: str | Column, one_way_bp: float = 7.0) -> Column:
    """Net of the one-way cost at entry and at exit; a short is linear in its entry notional."""
    move = F.try_divide(_c(exit_), _c(entry)) - 1
    gross = F.when(_c(direction) == "long", move).when(_c(direction) == "short", -move)
    return bp(gross) - 2 * one_way_bp


def decile_of(pct: str | Column) -> Column:
    """Right-closed deciles of [0, 100]; 0 belongs to the first."""
    return F.greatest(F.ceil(_c(pct) / 10) - 1, F.lit(0)).cast("bigint")


def fixed_bins(x: str | Column, edges: Sequence[float]) -> Column:
    """Label of the left-closed bin; the last bin also holds its upper edge; NULL outside."""
    x, out = _c(x), None
    pairs = list(zip(edges[:-1], edges[1:]))
    for a, b in pairs:
        last = b == edges[-1]
        cond = (x >= a) & ((x <= b) if last else (x < b))
        label = f"[{a:g},{b:g}]" if last else f"[{a:g},{b:g})"
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def four_state(trend: str | Column, vol: str | Column, threshold: str | Column) -> Column:
    up, high = _c(trend) >= 0, _c(vol) >= _c(threshold)
    ready = _c(trend).isNotNull() & _c(vol).isNotNull() & _c(threshold).isNotNull()
    return (F.when(ready & up & ~high, "uptrend_low_vol").when(ready & up & high, "uptrend_high_vol")
            .when(ready & ~up & ~high, "downtrend_low_vol").when(ready & ~up & high, "downtrend_high_vol"))


def value_state(asof_state: str | Column, value: str | Column) -> Column:
    """missing > stale > missing_value > unclassified_zero > unclassified_invalid > available."""
    s, v = _c(asof_state), _c(value)
    return (F.when(s == "missing", "missing").when(s == "stale", "stale").when(v.isNull() | F.isnan(v), "missing_value")
            .when(v == 0, "unclassified_zero").when((F.abs(v) == float("inf")) | (v < 0), "unclassified_invalid")
            .otherwise("available"))


def flow_state(volume: str | Column) -> Column:
    return (F.when(_c(volume).isNull(), "unclassified_missing").when(_c(volume) == 0, "unclassified_zero_volume")
            .otherwise("classified"))


def taker_imbalance(buy: str | Column, volume: str | Column) -> Column:
    """(2 buy - volume) / volume, NULL on zero volume: no volume carries no direction."""
    return F.when(_c(volume) > 0, (2 * _c(buy) - _c(volume)) / _c(volume))


def asset_of(symbol: str | Column) -> Column:
    """Upper-case symbol without one quote suffix; the suffix alone stays."""
    return F.regexp_replace(F.upper(_c(symbol)), r"^(.+?)(USDT|USDC|USD)$", "$1")


def stream_key(*parts: str | Column) -> Column:
    """Non-empty parts joined with ':'."""
    return F.concat_ws(":", *[F.nullif(_c(p), F.lit("")) for p in parts])


def strategy_key(file_name: str | Column, horizon: str | Column | None = None) -> Column:
    """Strategy from an event file name; a row-level horizon is appended unless the name holds it."""
    stem = F.regexp_replace(_c(file_name), r"^.*/|\.csv$", "")
    key = F.replace(F.regexp_replace(stem, "^events_", ""), F.lit("_events_"), F.lit("_"))
    if horizon is None:
        return key
    h = F.trim(_c(horizon))
    return F.when(h.isNotNull() & (h != "") & ~F.contains(F.lower(key), F.lower(h)), F.concat_ws("_", key, h)).otherwise(key)


def strategy_direction(file_name: str | Column, leg: str | Column) -> Column:
    """Direction of an event row; '' when the file layout does not tell."""
    n, g = F.lower(F.regexp_replace(_c(file_name), r"^.*/", "")), F.lower(_c(leg))
    side = lambda top, bottom: F.when(g == "top", top).when(g == "bottom", bottom).otherwise("")
    return (F.when(F.contains(n, F.lit("_long_")), "long").when(F.contains(n, F.lit("_short_")), "short")
            .when(F.contains(n, F.lit("a2_contrarian")), side("short", "long"))
            .when(F.contains(n, F.lit("a3_momentum")), side("long", "short"))
            .when(F.contains(n, F.lit("b2_deleverage")), "long").when(F.contains(n, F.lit("b3_double_overheat")), "short")
            .otherwise(""))


def liq_price_short(margin: str | Column, qty: str | Column, entry: str | Column, maintenance: float) -> Column:
    return F.try_divide(_c(margin) + _c(qty) * _c(entry), _c(qty) * (1 + maintenance))


def liquidation_room(leverage: str | Column | float, max_leverage: float) -> Column:
    lev = F.lit(leverage) if isinstance(leverage, (int, float)) else _c(leverage)
    return 1 / lev - 0.5 / max_leverage


def liq_bin(szi: str | Column, liq_px: str | Column, mid: str | Column, band_pct: float = 1.0, range_pct: float = 30.0) -> Column:
    """'down:i' for longs, 'up:i' for shorts, 'outside' past the range, NULL on the wrong side or without input."""
    s, l, m = _c(szi), _c(liq_px), _c(mid)
    pct = F.try_divide(l - m, m) * 100
    bands = max(int(round(range_pct / band_pct)), 1)
    idx = F.least(F.floor(F.abs(pct) / band_pct), F.lit(bands - 1)).cast("string")
    valid = finite(s) & finite(l) & finite(m) & (m > 0) & (s != 0)
    return (F.when(~valid | ((s > 0) & (pct >= 0)) | ((s < 0) & (pct <= 0)), None)
            .when(F.abs(pct) > range_pct, "outside")
            .otherwise(F.concat(F.when(s > 0, "down:").otherwise("up:"), idx)))


def liq_bucket(szi, liq_px, mid, value, *, min_usd: float = 0.0, band_pct: float = 1.0, range_pct: float = 30.0) -> Column:
    """``liq_bin`` with explicit exclusion buckets; NULL only for an unknown valuation."""
    v, m = _c(value), _c(mid)
    return (F.when(~finite(v) | (v < 0), None).when(v < min_usd, "excluded_below_minimum")
            .when(_c(liq_px).isNull(), "excluded_null_liquidation").when(~finite(m) | (m <= 0), "unknown_mid")
            .otherwise(F.coalesce(liq_bin(szi, liq_px, mid, band_pct, range_pct), F.lit("excluded_direction"))))


def bias_label(a: str | Column, b: str | Column, name_a: str, name_b: str, *, mild: float = 1.5, strong: float = 2.0) -> Column:
    """Which side leads and by how much. The texts are fixed values shown to users."""
    a, b = _c(a), _c(b)
    ratio = F.try_divide(F.greatest(a, b), F.least(a, b))
    times = F.format_string("(%.1f倍)", ratio)
    winner = F.when(a >= b, name_a).otherwise(name_b)
    return (F.when((a <= 0) & (b <= 0), "拮抗(データなし)").when(b <= 0, f"{name_a}優勢(∞倍)").when(a <= 0, f"{name_b}優勢(∞倍)")
            .when(ratio < mild, F.concat(F.lit("拮抗"), times)).when(ratio >= strong, F.concat(winner, F.lit("優勢"), times))
            .otherwise(F.concat(winner, F.lit("優位気味"), times)))


def position_context(szi: str | Column, side: str | Column) -> Column:
    """What an order does to the user's position. The texts are fixed values shown to users."""
    s, buy = _c(szi), _c(side) == "B"
    return (F.when(s.isNull(), "新規/flip?").when((s < 0) & buy, "ショート買い戻し(closing)")
            .when((s > 0) & ~buy, "ロング利確/縮小(closing)").when((s > 0) & buy, "ロング積み増し(building)")
            .when((s < 0) & ~buy, "ショート積み増し(building)").otherwise("新規/flip?"))


def session_open_ms(date: str | Column) -> Column:
    return F.datediff(_c(date), F.lit("1970-01-01").cast("date")).cast("bigint") * F.lit(DAY)


def session_close_ms(date: str | Column, rule_change: str) -> Column:
    """Close in epoch ms: six hours after the open, half an hour later from ``rule_change`` on."""
    late = F.when(_c(date) >= F.lit(rule_change).cast("date"), HOUR // 2).otherwise(0)
    return session_open_ms(date) + 6 * HOUR + late


def parse_reason_map(text: str | Column, known: dict[str, str]) -> dict[str, Column]:
    """A text like ``{'KeyA': '0', 'KeyB': '1'}`` -> one column per known key plus ``other``: the unknown keys
    as JSON, or the text itself when it is not such a literal."""
    pattern = r"'(\w+)': '([^']*)'"
    t = F.nullif(_c(text), F.lit(""))
    keys = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    found = F.map_from_arrays(keys, F.regexp_extract_all(t, F.lit(pattern), F.lit(2)))
    rest = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(found, lambda k, _v: ~k.isin(*known)))))
    out = {target: F.try_element_at(found, F.lit(source)) for source, target in known.items()}
    out["other"] = F.when(F.size(keys) == 0, t).when(F.size(rest) > 0, F.to_json(rest))
    return out


def strict_bool(x: str | Column) -> Column:
    """true/1 and false/0 in any case; anything else is NULL (count those as rejects)."""
    v = F.lower(F.trim(_c(x).cast("string")))
    return F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)


def calendar_fields(ts: str | Column) -> dict[str, Column]:
    t = F.timestamp_millis(_c(ts))
    return {"year": F.year(t), "month": F.date_format(t, "yyyy-MM"), "hour": F.hour(t), "iso_week": F.weekofyear(t),
            "iso_year": F.extract(F.lit("YEAROFWEEK"), t), "month_start": F.trunc(t.cast("date"), "month")}


def adverse_favorable(direction: str | Column, entry: str | Column, high: str | Column, low: str | Column) -> tuple[Column, Column]:
    """Per-bar worst and best move against the entry price, linear for shorts."""
    up, down = F.try_divide(_c(high), _c(entry)) - 1, F.try_divide(_c(low), _c(entry)) - 1
    long = _c(direction) == "long"
    return F.when(long, down).otherwise(-up), F.when(long, up).otherwise(-down)
