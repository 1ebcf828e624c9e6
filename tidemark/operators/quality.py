"""Gap reports, coverage audits, token quality, fingerprints, disclosure checks and set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bars import bucket_completeness, coverage
from .scan import previous
from .windows import densify


def gap_report(series: DataFrame, keys: Sequence[str], *, step: int, width: int, tolerance: int = 0) -> DataFrame:
    """Every gap wider than a step: from, to, missing steps."""
    stamps = series.select(*keys, "ts").distinct()
    p = previous(stamps, keys, ["ts"], width, ["ts"])
    gap = F.col("ts") - F.col("prev_ts")
    return p.where(gap > step + tolerance).select(*keys, F.col("prev_ts").alias("from_ts"), F.col("ts").alias("to_ts"), (F.floor(gap / step) - 1).alias("missing_bars"))


def dataset_meta(series: DataFrame, keys: Sequence[str], *, step: int, width: int) -> DataFrame:
    """Period, rows, expected and missing bars and gap count per dataset."""
    c = coverage(series, keys, interval=step, width=width)
    expected = F.floor((F.col("max_ts") - F.col("min_ts")) / step) + 1
    return c.select(*keys, F.col("min_ts").alias("period_start"), F.col("max_ts").alias("period_end"), F.col("count").alias("rows"), expected.alias("expected_bars"),
                    (expected - F.col("count")).alias("missing_bars_total"), F.col("unexpected_gap_count").alias("gaps_count"))


def missing_days(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Calendar days without rows between each key's first and last day."""
    ends = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_z"))
    spine = ends.select(*keys, F.explode(F.sequence("_a", "_z")).alias(date))
    return spine.join(df.select(*keys, date).distinct(), [*keys, date], "left_anti")


def missing_from_calendar(calendar: DataFrame, df: DataFrame, date: str = "date") -> DataFrame:
    """Business days of the calendar that the data lacks."""
    return calendar.select(date).exceptAll(df.select(date).distinct())


def raw_hour_coverage(bars: DataFrame, market: str, a: str, b: str, *, step: int, n: int) -> DataFrame:
    """Buckets whole in both markets, in one, in none, and absent altogether."""
    whole = bucket_completeness(bars.where(F.col(market).isin(a, b)), [market], step=step, n=n)
    ok = F.col("whole") & (F.col("valid_count") == n)
    per = whole.groupBy("bucket_ts").agg(F.max((ok & (F.col(market) == a)).cast("int")).alias("a"), F.max((ok & (F.col(market) == b)).cast("int")).alias("b"))
    span = F.floor((F.max("bucket_ts") - F.min("bucket_ts")) / (step * n)) + 1
    both = (F.col("a") == 1) & (F.col("b") == 1)
    return per.agg(F.count_if(both).alias("common_valid"), F.count_if(F.col("a") != F.col("b")).alias("one_sided"), F.count_if((F.col("a") == 0) & (F.col("b") == 0)).alias("both_incomplete"),
                   (span - F.count("*")).alias("all_missing"), F.min(F.when(both, F.col("bucket_ts") + step * n)).alias("first_common"), F.max(F.when(both, F.col("bucket_ts") + step * n)).alias("last_common"))


def quality_tokens(df: DataFrame, columns: dict[str, str], *, top: int = 20) -> DataFrame:
    """Cells that do not parse as their declared type, counted per column and token: the most frequent ``top``
    tokens and the rest as '<other>'."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("token"), F.col(c).try_cast(t).isNull().alias("bad")) for c, t in columns.items()]))
    bad = df.select(cells.alias("c")).select("c.*").where(F.col("bad") & F.col("token").isNotNull() & (F.col("token") != ""))
    counts = bad.groupBy("column", "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), "token")
    # The limit is applied per task first; what is beyond it is the column total minus the listed tokens.
    listed = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")
    total = bad.groupBy("column").agg(F.count("*").alias("_t"))
    rest = total.join(listed.groupBy("column").agg(F.sum("n").alias("_l")), "column").select("column", F.lit("<other>").alias("token"), (F.col("_t") - F.col("_l")).alias("n"))
    return listed.unionByName(rest.where("n > 0"))


def fingerprint(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-insensitive digest per key: row count, xor and sum of 64-bit row hashes. Combined map-side, so a
    key of any size works; equal multisets give equal digests."""
    h = F.xxhash64(*columns)
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("digest_xor"), F.sum(F.shiftright(h, 16)).alias("digest_sum"))


def row_digests(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """sha2 per row of the joined text, reduced to one checkable number per key (sum of the first 12 hex digits)."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    v = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(v).cast("string").alias("digest"))


def mutated(baseline: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose digest differs from the baseline or that exist on one side only."""
    cols = [c for c in baseline.columns if c not in keys]
    a = baseline.select(*keys, F.struct(*cols).alias("_a"))
    b = current.select(*keys, F.struct(*cols).alias("_b"))
    return a.join(b, list(keys), "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").otherwise("changed").alias("change"))


def reconcile(used: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, *, tolerance: float = 1e-9) -> DataFrame:
    """Sum used against sum stored per key."""
    a = used.groupBy(*keys).agg(F.sum(value).alias("used_sum"), F.count("*").alias("used_rows"))
    b = stored.groupBy(*keys).agg(F.sum(value).alias("stored_sum"), F.count("*").alias("stored_rows"))
    gap = F.abs(F.coalesce("used_sum", F.lit(0.0)) - F.coalesce("stored_sum", F.lit(0.0)))
    return a.join(b, list(keys), "full").withColumn("match", gap <= tolerance * F.greatest(F.abs("used_sum"), F.abs("stored_sum"), F.lit(1e-3)))


def coverage_status(requirements: DataFrame, cover: DataFrame, *, source: str, baseline: int) -> DataFrame:
    """Whether each candidate's required inputs reach their end and are contiguous since the baseline, with the
    reasons when not. ``requirements``: candidate, source key, required_end."""
    j = requirements.join(cover, source, "left")
    note = F.array_compact(F.array(
        F.when(F.coalesce("coverage_end_exclusive_ts", F.lit(-1)) < F.col("required_end"), F.concat(F.col(source), F.lit("_coverage_incomplete"))),
        F.when(F.col("tail_contiguous_start_ts").isNull(), F.concat(F.col(source), F.lit("_continuity_missing")))
        .when(F.col("tail_contiguous_start_ts") > baseline, F.concat(F.col(source), F.lit("_gap_after_baseline")))))
    g = j.withColumn("_n", note).groupBy("candidate").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("_n"))), ";").alias("notes"))
    return g.withColumn("status", F.when(F.col("notes") == "", "ready").otherwise("awaiting_source_refresh"))


DATE_TEXT = r"(19|20)\d\d[-/.]?[01]\d[-/.]?[0-3]\d"


def disclosure_check(df: DataFrame, key: str, observations: str, *, min_observations: int, max_rows: int, max_columns: int, max_text: int = 40) -> DataFrame:
    """Violations that would make a retained table more than an aggregate: duplicate or missing keys, thin rows,
    date columns, dates in text or numbers, long text, too many rows or columns. Empty when it may be kept."""
    checks: dict[str, Column] = {
        "too_long": F.count("*") > max_rows, "too_wide": F.lit(len(df.columns) > max_columns), "empty": F.count("*") == 0,
        "missing_key": F.count(key) < F.count("*"), "duplicate_key": F.count_distinct(key) < F.count(key),
        "thin_rows": F.coalesce(F.min(observations) < min_observations, F.lit(True)) | (F.count(observations) < F.count("*"))}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            checks[f"{f.name}_is_date"] = F.lit(True)
        elif isinstance(f.dataType, T.NumericType):
            dated = F.count_if((c == F.floor(c)) & (c.between(19_000_101, 21_001_231) | c.between(1_900, 2_100)))
            checks[f"{f.name}_dates_as_numbers"] = (F.count(c) > 0) & (dated * 2 >= F.count(c))
        elif isinstance(f.dataType, T.StringType):
            checks[f"{f.name}_holds_dates"] = F.coalesce(F.bool_or(F.rlike(c, F.lit(DATE_TEXT))), F.lit(False))
            checks[f"{f.name}_long_text"] = F.coalesce(F.max(F.length(c)) > max_text, F.lit(False))
    row = df.agg(*[v.alias(k) for k, v in checks.items()])
    return row.select(F.explode(F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in checks]))).alias("violation"))


def premise_checks(panel: DataFrame, pairs: Sequence[tuple[str, str]], label: str) -> DataFrame:
    """Day counts, missing values and correlations between alternative sources, shares of a method label."""
    aggs = [F.count("*").alias("days"), *[F.corr(a, b).alias(f"corr_{a}_{b}") for a, b in pairs], *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in dict.fromkeys(x for p in pairs for x in p)]]
    share = panel.groupBy(label).agg(F.count("*").alias("n")).withColumn("_one", F.lit(0))
    return share.join(panel.groupBy(F.lit(0).alias("_one")).agg(*aggs), "_one").drop("_one").withColumn("share", F.col("n") / F.col("days"))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key in the given order (task-side limit before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, last: bool = False) -> DataFrame:
    """The first (or last) row per key as one map-side combined aggregate, not an order-free drop of duplicates."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def argmax_rows(df: DataFrame, keys: Sequence[str], score: str, tie: str, *, lowest: bool = False) -> DataFrame:
    """Row with the highest (lowest) score per key, ties by ``tie`` ascending; NULL scores are ignored."""
    order = F.when(F.col(score).isNotNull(), F.struct(F.col(score) if lowest else -F.col(score), F.col(tie)))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).where("_r IS NOT NULL").select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def tick_alignment(snapshots: DataFrame, keys: Sequence[str], *, interval: int, received: str = "received_ms") -> DataFrame:
    """Label snapshots with their aligned tick; the ticks missed in between are reported, not filled."""
    return snapshots.withColumn("tick", (F.floor(F.col(received) / interval) * interval).cast("bigint"))


def expected_steps(df: DataFrame, keys: Sequence[str], *, step: int) -> DataFrame:
    """Steps between a key's first and last row that hold no row."""
    return densify(df.select(*keys, "ts", F.lit(1).alias("_x")), keys, step=step).where("_x IS NULL").drop("_x")
