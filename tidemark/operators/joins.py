"""Equi, interval, calendar and record-version joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import DAY
from .asof import asof_backward, asof_both, asof_forward
from .scan import running


def exact_lookup(left: DataFrame, right: DataFrame, *, by: Sequence[str], at: Column, take: dict[str, str],
                 on: str = "ts") -> DataFrame:
    """Values of the right row at exactly ``at``; NULL when there is none."""
    r = right.select(*by, F.col(on).alias("_at"), *[F.col(c).alias(n) for c, n in take.items()])
    return left.withColumn("_at", at).join(r, [*by, "_at"], "left").select(*left.columns, *take.values())


def first_common_bar(signals: DataFrame, a: DataFrame, b: DataFrame, *, signal_ts: str, price: str, max_wait: int,
                     width: int, by: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """First time both series have a bar after the signal; NULL when the wait exceeds ``max_wait``."""
    by = list(by) or ["_k"]
    const = (lambda d: d.withColumn("_k", F.lit(0))) if by == ["_k"] else (lambda d: d)
    common = (const(a).select(*by, "ts", F.col(price).alias("a_px"))
              .join(const(b).select(*by, "ts", F.col(price).alias("b_px")), [*by, "ts"]))
    out = asof_forward(const(signals), common, by=by, take=["a_px", "b_px"], width=width, left_on=signal_ts, strict=strict)
    ok = F.col("source_ts") - F.col(signal_ts) <= max_wait
    return out.select(*signals.columns, *[F.when(ok, F.col(c)).alias(n) for c, n in
                                          (("source_ts", "entry_ts"), ("a_px", "a_px"), ("b_px", "b_px"))],
                      F.when(ok, "entered").otherwise("entry_missing_or_wait_exceeded").alias("status"))


def prior_day_state(events: DataFrame, states: DataFrame, *, by: Sequence[str], date: str, state: str) -> DataFrame:
    """State of the calendar day before each event."""
    s = states.select(*by, F.date_add(F.col("date"), 1).alias(date), F.col(state))
    return events.join(s, [*by, date], "left")


def outer_panel(frames: dict[str, DataFrame], keys: Sequence[str], value: str, *, fill: float | None = None) -> DataFrame:
    """One column per named frame on the union of their keys, by one union and one aggregate (a k-way
    full outer join would shuffle k-1 times)."""
    parts = [df.select(*keys, F.lit(name).alias("_who"), F.col(value).alias("_v")) for name, df in frames.items()]
    stacked = reduce(DataFrame.unionByName, parts)
    cols = [F.max(F.when(F.col("_who") == name, F.col("_v"))).alias(name) for name in frames]
    out = stacked.groupBy(*keys).agg(*cols)
    return out.fillna(fill, subset=list(frames)) if fill is not None else out


def interval_join(events: DataFrame, bars: DataFrame, *, by: Sequence[str], start: str, stop: str,
                  bucket: int = DAY, on: str = "ts", how: str = "inner") -> DataFrame:
    """Pair every event with the bars in [start, stop): an equi join on (key, bucket) with the range as a
    residual, so no nested-loop join appears. A bar falls in one bucket, hence no duplicate pairs.
    ``how='outer'`` also keeps event rows without bars (NULL bar columns, one per bucket): aggregate over them."""
    reach = F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(stop) - 1) / bucket))
    outer = how == "outer"
    e = events.withColumn("_b", (F.explode_outer if outer else F.explode)(reach)).alias("e")
    b = bars.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.floor(F.col(on) / bucket).alias("_bb"),
                    *[F.col(c).alias(f"bar_{c}") for c in bars.columns if c not in by])
    cond = [F.col(f"e.{k}") == F.col(f"_k_{k}") for k in by] + [
        F.col("_b") == F.col("_bb"), F.col(f"bar_{on}") >= F.col(start), F.col(f"bar_{on}") < F.col(stop)]
    out = e.join(b, reduce(lambda x, y: x & y, cond), "left" if outer else "inner")
    return out.select(*[F.col(f"e.{c}") for c in events.columns], *[c for c in b.columns if c.startswith("bar_")])


def interval_scan(intervals: DataFrame, bars: DataFrame, *, by: Sequence[str], key: Sequence[str], start: str, stop: str,
                  level: str, high: str = "high", bands: Sequence[float] = (0.10, 0.20), bucket: int = DAY) -> DataFrame:
    """Closest approach of ``high`` to ``level`` per interval and the bars within each relative band of it."""
    pairs = interval_join(intervals, bars, by=by, start=start, stop=stop, bucket=bucket)
    approach = (F.col(level) - F.col(f"bar_{high}")) / F.col(level)
    return (pairs.withColumn("_a", approach)
            .groupBy(*key).agg(F.max(f"bar_{high}").alias("max_high"), F.min("_a").alias("worst_approach"),
                               F.min_by("bar_ts", F.struct("_a", "bar_ts")).alias("worst_ts"),
                               *[F.count_if(F.col("_a") <= b).alias(f"within_{int(b * 100)}pct") for b in bands],
                               F.count("*").alias("bars")))


def offset_profile(events: DataFrame, series: DataFrame, *, by: Sequence[str], event_ts: str, value: str, reach: int,
                   width: int, group: Sequence[str] = ()) -> DataFrame:
    """Mean of ``value`` at row offsets -reach..reach around the first bar at or after each event.

    Events whose window leaves the series are left out. Events on the same bar are counted first, so the
    explode is bars x offsets rather than events x offsets.
    """
    by, group = list(by), list(group)
    numbered = running(series, by, ["ts"], width, {"pos": ("count", F.lit(1))})
    size = series.groupBy(*by).agg(F.count("*").alias("_n"))
    anchored = asof_forward(events, numbered, by=by, take=["pos"], width=width, left_on=event_ts)
    counts = (anchored.where("pos IS NOT NULL").groupBy(*by, *group, "pos").agg(F.count("*").alias("_events"))
              .join(size, by).where((F.col("pos") - reach >= 1) & (F.col("pos") + reach <= F.col("_n")) & (F.col("pos") > 1)))
    wide = counts.withColumn("offset", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))) \
        .withColumn("pos", F.col("pos") + F.col("offset"))
    hit = wide.join(numbered.select(*by, "pos", F.col(value).alias("_v")), [*by, "pos"]).where("_v IS NOT NULL")
    return hit.groupBy(*by, *group, "offset").agg((F.sum(F.col("_v") * F.col("_events")) / F.sum("_events")).alias("mean_value"),
                                                  F.sum("_events").alias("n"))


def wanted_keys(facts: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Facts on the wanted keys only."""
    return facts.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def scd2_as_of(left: DataFrame, history: DataFrame, *, by: Sequence[str], on: str, take: Sequence[str],
               width: int = 365 * DAY) -> DataFrame:
    """Record version in force on a day: the last ``valid_from`` at or before it, dropped once ``valid_to``
    has passed. Intervals of one key do not overlap, so a backward as-of finds it without a range join."""
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("bigint") * F.lit(DAY)
    out = asof_backward(left.withColumn("_t", day(on)), history.withColumn("_t", day("valid_from")), by=by,
                        take=["valid_to", *take], width=width, left_on="_t", right_on="_t", prefix="h_")
    live = F.col("h_valid_to").isNull() | (F.col("h_valid_to") >= F.col(on))
    return out.select(*left.columns, *[F.when(live, F.col(f"h_{c}")).alias(c) for c in take])


def latest_positions(attempts: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows of each user's latest successful read. An empty success erases, a failure does not; users never
    read successfully fall back to the latest row per coin."""
    latest = (attempts.where(F.col("status").isin("success", "empty")).groupBy("user")
              .agg(F.max("observed_ts").alias("_latest")))
    tried = positions.join(latest, "user", "left")
    current = tried.where(F.col("ts") == F.col("_latest")).drop("_latest")
    untried = tried.where(F.col("_latest").isNull()).drop("_latest")
    newest = untried.groupBy("user", "coin").agg(F.max("ts").alias("ts"))
    return current.unionByName(untried.join(newest, ["user", "coin", "ts"], "left_semi").select(*current.columns))


def flag_active(positions: DataFrame, orders: DataFrame, keys: Sequence[str] = ("user", "coin")) -> DataFrame:
    """``has_active_order``: the key has an order with status active."""
    active = orders.where("status = 'active'").select(*keys).distinct().withColumn("_a", F.lit(True))
    return positions.join(active, list(keys), "left").withColumn("has_active_order", F.coalesce("_a", F.lit(False))).drop("_a")


def nearest_declaration(orders: DataFrame, declarations: DataFrame, *, by: Sequence[str], ts: str, declared_ts: str,
                        take: Sequence[str], width: int) -> DataFrame:
    """Declaration of the same key nearest in time, the earlier one on a tie. A scan in both directions instead of a
    many-to-many join, which a heavy user would square."""
    f = asof_both(orders, declarations, by=by, take=take, width=width, left_on=ts, right_on=declared_ts)
    back, fwd = F.col(ts) - F.col("b_source_ts"), F.col("f_source_ts") - F.col(ts)
    use_f = fwd.isNotNull() & (back.isNull() | (fwd < back))
    pick = lambda c: F.when(use_f, F.col(f"f_{c}")).otherwise(F.col(f"b_{c}"))
    return f.select(*orders.columns, pick("source_ts").alias("matched_ts"), *[pick(c).alias(c) for c in take])


def pairs(df: DataFrame, *, on: Sequence[str], name: str, values: Sequence[str]) -> DataFrame:
    """Unordered pairs of named series on equal keys. The input holds one row per (key, name), so a key has
    as many pairs as series, not as rows."""
    a = df.select(*on, F.col(name).alias("a"), *[F.col(v).alias(f"a_{v}") for v in values])
    b = df.select(*on, F.col(name).alias("b"), *[F.col(v).alias(f"b_{v}") for v in values])
    return a.join(b, list(on)).where(F.col("a") < F.col("b"))


# -- calendars ------------------------------------------------------------------------------------

def indexed_calendar(days: DataFrame, date: str = "date") -> DataFrame:
    """Distinct days numbered in order. A calendar has some hundred rows per year, so one window is small."""
    w = Window.orderBy(date)
    return days.select(date).distinct().withColumn("idx", F.row_number().over(w).cast("bigint"))


def _bounds(calendar: DataFrame, date: str) -> DataFrame:
    nxt = F.lead(date).over(Window.orderBy(date))
    return calendar.select(F.col(date).alias("_from"), nxt.alias("_to"), "idx")


def business_index(df: DataFrame, calendar: DataFrame, on: str, *, out: str = "idx") -> DataFrame:
    """Index of the last business day at or before ``on`` (0 before the first).

    The calendar is expanded to one row per civil day between its first and last day, so this is an equi join; later
    dates are looked up as the last day. The calendar's rows a year are fixed, and the size of the join sides decides
    whether they are broadcast.
    """
    b = _bounds(calendar, "date")
    spine = b.select(F.explode(F.sequence("_from", F.coalesce(F.date_sub("_to", 1), F.col("_from")))).alias("_day"), F.col("idx").alias(out))
    end = F.broadcast(calendar.agg(F.max("date").alias("_end")))  # one row
    day = df.join(end, F.lit(True), "left").withColumn("_day", F.least(F.col(on), F.col("_end")))
    found = day.join(spine, "_day", "left").withColumn(out, F.when(F.col(on).isNotNull(), F.coalesce(F.col(out), F.lit(0))))
    return found.drop("_end", "_day")


def nth_business_day_after(df: DataFrame, calendar: DataFrame, on: str, n: int, *, out: str) -> DataFrame:
    """The n-th business day strictly after each date, NULL past the calendar."""
    at = business_index(df, calendar, on, out="_i").withColumn("_j", F.col("_i") + n)
    c = calendar.select(F.col("idx").alias("_j"), F.col("date").alias(out))
    return at.join(c, "_j", "left").drop("_i", "_j")


def last_business_day(df: DataFrame, calendar: DataFrame, on: str, *, out: str) -> DataFrame:
    """The last business day at or before each date."""
    return nth_business_day_after(df, calendar, on, 0, out=out)


def reaction_session(df: DataFrame, calendar: DataFrame, *, date: str, time: str, rule_change: str,
                     out: str = "reaction") -> DataFrame:
    """First session whose close follows the disclosure; the close moved later on ``rule_change``."""
    close = F.when(F.col(date) >= F.lit(rule_change).cast("date"), "15:30:00").otherwise("15:00:00")
    same = nth_business_day_after(df, calendar, date, 0, out="_same")
    both = nth_business_day_after(same, calendar, date, 1, out="_next")
    intraday = (F.col("_same") == F.col(date)) & F.col(time).isNotNull() & (F.col(time) < close)
    return both.withColumn(out, F.when(intraday, F.col(date)).otherwise(F.col("_next"))).drop("_same", "_next")


def week_ends(days: DataFrame) -> DataFrame:
    """Last business day of each ISO week with the next such day."""
    last = days.groupBy(F.extract(F.lit("YEAROFWEEK"), F.col("date")).alias("iso_year"), F.weekofyear("date").alias("iso_week")) \
        .agg(F.max("date").alias("date"))
    return last.withColumn("next_date", F.lead("date").over(Window.orderBy("date"))).select("date", "next_date")


def schedule(references: DataFrame, calendar: DataFrame, *, lag: int, reference: str = "reference",
             published: str = "pub_date") -> DataFrame:
    """Reference day -> decision day: ``lag`` business days later, never before the business day after
    publication; with the following decision."""
    ends = week_ends(calendar).select(F.col("date").alias(reference))
    r = references.groupBy(reference).agg(F.max(published).alias(published)).join(ends, reference, "left_semi")
    ref = business_index(r, calendar, reference, out="_ri")
    pub = business_index(ref, calendar, published, out="_pi")
    target = F.greatest(F.col("_ri") + lag, F.when(F.col(published).isNotNull(), F.col("_pi") + 1).otherwise(0))
    c = calendar.select(F.col("idx").alias("_t"), F.col("date").alias("decision"))
    out = pub.withColumn("_t", target).join(c, "_t").select(reference, published, "decision")
    return out.withColumn("next_decision", F.lead("decision").over(Window.orderBy(reference)))


def match_error(reference: DataFrame, candidates: DataFrame, *, key: Sequence[str], value: str, name: str,
                min_share: float = 0.5) -> DataFrame:
    """Match count and errors of each candidate series against the reference on equal keys; candidates
    matching at least ``min_share`` of the reference are ranked by mean absolute error."""
    ref = reference.select(*key, F.col(value).alias("_ref"))
    err = F.abs(F.col("_ref") - F.col("_cand"))
    stats = (candidates.select(*key, name, F.col(value).alias("_cand")).join(ref, list(key)).groupBy(name)
             .agg(F.count("*").alias("matched"), F.avg(err).alias("mae"), F.max(err).alias("max_abs_err"),
                  F.avg(F.when(F.col("_cand") != 0, err / F.col("_cand") * 10_000)).alias("mean_rel_bp")))
    total = reference.groupBy(F.lit(0).alias("_one")).agg(F.count("*").alias("_rows"))
    ok = F.col("matched") >= min_share * F.col("_rows")
    w = Window.partitionBy(ok).orderBy("mae", name)
    return stats.withColumn("_one", F.lit(0)).join(total, "_one").select(name, "matched", "mae", "max_abs_err", "mean_rel_bp",
                                         F.when(ok, F.row_number().over(w)).cast("bigint").alias("rank"))
