"""Order-book arithmetic on ``bids``/``asks`` arrays of struct(px, sz, n), best level first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where the body reads it for every level."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def best(side: str) -> Column:
    return F.get(F.col("bids" if side == "bid" else "asks"), F.lit(0)).getField("px")


def mid() -> Column:
    return (best("bid") + best("ask")) / 2


def spread_bp() -> Column:
    return (best("ask") - best("bid")) / mid() * 10_000


def levels(side: str) -> Column:
    return F.col("bids" if side == "bid" else "asks")


def coverage(side: str) -> Column:
    return F.col("bid_cov" if side == "bid" else "ask_cov")


def distance_bp(px: Column, m: Column) -> Column:
    return F.abs(F.try_divide(px, m) - 1) * 10_000


def levels_valid(side: str) -> Column:
    """Finite positive prices and sizes in strict price order."""
    a = levels(side)
    ok = F.forall(a, lambda l: (l.px > 0) & (l.sz > 0) & (l.px < INF) & (l.sz < INF) & ~F.isnan(l.px) & ~F.isnan(l.sz))
    nxt = F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    head = F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    ordered = F.forall(F.zip_with(head, nxt, lambda x, y: (y.px < x.px) if side == "bid" else (y.px > x.px)), lambda b: b)
    return ok & ordered


def book_problem() -> Column:
    return (F.when((F.size("bids") == 0) | (F.size("asks") == 0), "empty_side").when(~levels_valid("bid") | ~levels_valid("ask"), "bad_levels")
            .when(best("bid") >= best("ask"), "crossed_or_locked"))


def side_coverage_bp(side: str, exhausted: Column) -> Column:
    """Completeness of a fetched side: whole when the venue returned fewer levels than asked for."""
    a = levels(side)
    return F.when(exhausted | (F.size(a) == 0), F.lit(INF)).otherwise(distance_bp(F.element_at(a, -1).getField("px"), mid()))


def truncate(side: str, *, band_bp: float = 0.0, max_levels: int = 0) -> tuple[Column, Column]:
    """Levels within the band and count limit, and the coverage that remains."""
    m, kept, cov = mid(), levels(side), coverage(side)
    if band_bp > 0:
        kept = F.filter(kept, lambda l: distance_bp(l.px, m) <= band_bp)
        cov = F.least(cov, F.lit(float(band_bp)))
    if max_levels > 0:
        cut = F.slice(kept, 1, max_levels)
        cov = F.when(F.size(kept) > max_levels, F.least(cov, distance_bp(F.element_at(cut, -1).getField("px"), m))).otherwise(cov)
        kept = cut
    return kept, cov


def depth_usd(side: str, band_bp: float) -> Column:
    """Resting notional within the band, NULL when the band exceeds what is visible."""
    m = mid()
    total = F.aggregate(F.filter(levels(side), lambda l: distance_bp(l.px, m) <= band_bp), F.lit(0.0), lambda acc, l: acc + l.px * l.sz)
    return F.when(coverage(side) >= band_bp, total)


def imbalance(bid: Column, ask: Column) -> Column:
    return F.when(bid + ask > 0, (bid - ask) / (bid + ask))


def impact_bp(side: str, notional: float) -> Column:
    """Average cost against mid of a market order eating ``side``; NULL when the visible depth is short."""
    m, cov, q = mid(), coverage(side), float(notional)
    usable = F.filter(levels(side), lambda l: distance_bp(l.px, m) <= cov)
    start = F.struct(F.lit(q).alias("left"), F.lit(0.0).alias("base"))

    def eat(acc: Column, l: Column) -> Column:
        take = F.least(acc["left"], l.px * l.sz)
        return F.struct((acc["left"] - take).alias("left"), (acc["base"] + take / l.px).alias("base"))

    end = F.aggregate(usable, start, eat)
    vwap = F.try_divide(F.lit(q), end["base"])
    cost = (vwap / m - 1) if side == "ask" else (1 - vwap / m)
    return F.when(end["left"] <= 1e-9 * q, cost * 10_000)


def walls(side: str, *, band_bp: float, multiple: float, min_usd: float, min_share: float = 0.0) -> Column:
    """Levels in view of at least min_usd, ``multiple`` times the side's median level and ``min_share`` of it."""
    bounds = F.struct(mid().alias("m"), F.least(F.lit(float(band_bp)), coverage(side)).alias("limit"))

    def side_stats(inside: Column, m: Column) -> Column:
        return let(F.array_sort(F.transform(inside, lambda l: l.px * l.sz)), lambda usd: F.struct(
            inside.alias("inside"), m.alias("m"), F.size(usd).alias("n"), F.aggregate(usd, F.lit(0.0), lambda a, x: a + x).alias("total"),
            ((F.get(usd, ((F.size(usd) - 1) / 2).cast("int")) + F.get(usd, (F.size(usd) / 2).cast("int"))) / 2).alias("median")))

    def in_view(v: Column) -> Column:
        return let(F.filter(levels(side), lambda l: distance_bp(l.px, v["m"]) <= v["limit"]), lambda inside: side_stats(inside, v["m"]))

    def found(s: Column) -> Column:
        return let(F.greatest(F.lit(float(min_usd)), multiple * s["median"], min_share * s["total"]), lambda t: F.filter(s["inside"], lambda l: (s["n"] >= 3) & (l.px * l.sz >= t)))

    def described(s: Column) -> Column:
        return F.transform(found(s), lambda l: F.struct(F.lit(side).alias("side"), l.px.alias("px"), (l.px * l.sz).alias("usd"),
                                                        distance_bp(l.px, s["m"]).alias("distance_bp"), (l.px * l.sz / s["total"]).alias("share"),
                                                        l.n.alias("orders"), s["median"].alias("median_level_usd")))

    return let(let(bounds, in_view), described)


def largest_levels(side: str, n: int = 3) -> Column:
    usd = F.transform(levels(side), lambda l: F.struct((-l.px * l.sz).alias("k"), l.px.alias("px"), (l.px * l.sz).alias("usd")))
    return F.transform(F.slice(F.array_sort(usd), 1, n), lambda s: F.struct(s.px.alias("px"), s.usd.alias("usd")))


def visible_range_bp(side: str) -> Column:
    return distance_bp(F.element_at(levels(side), -1).getField("px"), mid())


def snapshot_metrics(bands: tuple, notionals: tuple) -> list[Column]:
    """Mid, spread, depth and imbalance per band, impact per notional and direction."""
    out = [mid().alias("mid"), spread_bp().alias("spread_bp")]
    for b in bands:
        bid, ask = depth_usd("bid", b), depth_usd("ask", b)
        out += [bid.alias(f"bid_usd_{b}bp"), ask.alias(f"ask_usd_{b}bp"), imbalance(bid, ask).alias(f"imbalance_{b}bp")]
    for q in notionals:
        out += [impact_bp("ask", q).alias(f"buy_impact_bp_{q}"), impact_bp("bid", q).alias(f"sell_impact_bp_{q}")]
    return out
