"""Readers: declared schemas, permissive parsing, bad cells become NULL or drop the row as the format asks.

Every reader takes Spark paths or globs and returns a lazy DataFrame; no schema inference, no driver reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import normalise_epoch
from ..session import HOUR


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _num(c: str, kind: str = "double") -> Column:
    return F.col(c).try_cast(kind)


def _epoch(c: str) -> Column:
    return normalise_epoch(_num(c).cast("bigint"))


# Column order of the headerless kline layout (fixed).
KLINE_COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore")
BAR_COLUMNS = ("ts", "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote")


def _tag(df: DataFrame, **constants: str) -> DataFrame:
    return df.select(*[F.lit(v).alias(k) for k, v in constants.items()], *df.columns)


def read_klines_headerless(spark: SparkSession, path: str, *, venue: str, market: str, symbol: str) -> DataFrame:
    """Twelve-column kline CSVs without header (microsecond stamps accepted); rows that do not parse, including
    stray headers, are dropped."""
    raw = spark.read.schema(_text_schema(KLINE_COLUMNS)).csv(path)
    bars = raw.select(_epoch("open_time").alias("ts"), *[_num(c).alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume")],
                      _num("trades", "bigint").alias("trades"), _num("taker_buy_base").alias("taker_buy_base"), _num("taker_buy_quote").alias("taker_buy_quote"))
    return _tag(bars.dropna(), venue=venue, market=market, symbol=symbol)


def read_klines_header(spark: SparkSession, path: str, *, venue: str, market: str, symbol: str) -> DataFrame:
    """Kline CSVs with header open_time..turnover; the taker columns do not exist there and stay NULL."""
    names = ("open_time", "open", "high", "low", "close", "volume", "turnover")
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(_text_schema(names)).csv(path)
    bars = raw.select(_epoch("open_time").alias("ts"), *[_num(c).alias(c) for c in ("open", "high", "low", "close", "volume")], _num("turnover").alias("quote_volume")).dropna()
    none = [F.lit(None).cast(t).alias(n) for n, t in (("trades", "bigint"), ("taker_buy_base", "double"), ("taker_buy_quote", "double"))]
    return _tag(bars.select(*bars.columns, *none), venue=venue, market=market, symbol=symbol)


def read_funding_csv(spark: SparkSession, path: str, *, venue: str, symbol: str) -> DataFrame:
    names = ("calc_time", "funding_interval_hours", "last_funding_rate")
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(_text_schema(names)).csv(path)
    f = raw.select(_epoch("calc_time").alias("ts"), _num("last_funding_rate").alias("rate"), _num("funding_interval_hours").alias("interval_hours")).dropna()
    return _tag(f, venue=venue, symbol=symbol)


def read_funding_json(spark: SparkSession, path: str, *, venue: str, symbol: str, time: str, interval_hours: float, multi_line: bool = True) -> DataFrame:
    """JSON records with a time field and ``fundingRate``; the venue's interval is fixed."""
    raw = spark.read.schema(_text_schema((time, "fundingRate"))).option("multiLine", multi_line).json(path)
    f = raw.select(_epoch(time).alias("ts"), _num("fundingRate").alias("rate"), F.lit(interval_hours).alias("interval_hours")).dropna()
    return _tag(f, venue=venue, symbol=symbol)


def read_oi_metrics(spark: SparkSession, path: str, *, venue: str, symbol: str) -> DataFrame:
    """Five-minute metrics CSV: text timestamps to epoch ms, empty cells to NULL, unreadable rows dropped."""
    names = {"sum_open_interest": "open_interest", "sum_open_interest_value": "oi_value", "sum_taker_long_short_vol_ratio": "long_short_ratio", "sum_toptrader_long_short_ratio": "top_trader_ls_ratio"}
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(_text_schema(("create_time", *names))).csv(path)
    ts = F.unix_millis(F.try_to_timestamp(F.col("create_time"), F.lit("yyyy-MM-dd HH:mm:ss")))
    broken = F.lit(False)
    for c in names:
        broken = broken | (F.col(c).isNotNull() & (F.col(c) != "") & _num(c).isNull())
    m = raw.where(~broken).select(ts.alias("ts"), *[_num(c).alias(n) for c, n in names.items()]).where("ts IS NOT NULL")
    return _tag(m, venue=venue, symbol=symbol)


def read_candles_json(spark: SparkSession, path: str, *, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Candles (t, o, h, l, c, v) and the open times that occur twice (an error when not empty)."""
    raw = spark.read.schema(_text_schema(("t", "o", "h", "l", "c", "v"))).option("multiLine", multi_line).json(path)
    c = raw.select(_num("t", "bigint").alias("t"), *[_num(x).alias(x) for x in "ohlcv"])
    return c, c.groupBy("t").count().where("count > 1")


def read_funding_premium(spark: SparkSession, path: str, *, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Hourly funding floored to the hour, and the offending rows: more than a minute late, or two in one hour."""
    raw = spark.read.schema(_text_schema(("time", "fundingRate", "premium"))).option("multiLine", multi_line).json(path)
    t = _num("time", "bigint")
    f = raw.select((F.floor(t / HOUR) * HOUR).cast("bigint").alias("time"), _num("fundingRate").alias("rate"), _num("premium").alias("premium"), (t % HOUR).alias("_late"))
    late = f.where(F.col("_late") >= 60_000).select("time", F.lit("late").alias("problem"))
    twice = f.groupBy("time").count().where("count > 1").select("time", F.lit("duplicate").alias("problem"))
    return f.drop("_late"), late.unionByName(twice)


def read_index_csv(spark: SparkSession, path: str, series: str) -> tuple[DataFrame, DataFrame]:
    """(date, value) with '.' and blanks as NULL, and the problems: unreadable cells, dates that repeat, dates
    not above the line before (``descending``).

    A line's position in its file is the increasing id of its partition; the check compares neighbours there.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(_text_schema(("observation_date", series))).csv(path)
    blank = F.col(series).isNull() | F.trim(series).isin("", ".")
    raw = raw.withColumn("_i", F.monotonically_increasing_id()).withColumn("_p", F.spark_partition_id())
    d = raw.select("_i", "_p", F.col("observation_date").try_cast("date").alias("date"), F.when(~blank, _num(series)).alias("value"), (~blank & _num(series).isNull()).alias("_bad"))
    bad = d.where(F.col("_bad") | F.col("date").isNull()).select("date", F.lit("unreadable").alias("problem"))
    twice = d.groupBy("date").count().where("count > 1").select("date", F.lit("duplicate_date").alias("problem"))
    before = F.lag("date").over(Window.partitionBy("_p").orderBy("_i"))  # lines of one file split
    falls = d.withColumn("_b", before).where(F.col("date") < F.col("_b")).select("date", F.lit("descending").alias("problem"))
    return d.select("date", "value"), bad.unionByName(twice).unionByName(falls)


# Kinds of the declarative column table (fixed): T text, R real, I integer, D date, B boolean, H time of day.
def _kind(c: Column, kind: str) -> Column:
    text = F.nullif(F.trim(c), F.lit(""))
    if kind == "R":
        return text.try_cast("double")
    if kind == "I":
        return text.try_cast("bigint")
    if kind == "D":
        return text.try_cast("date")
    if kind == "B":
        return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
    if kind == "H":
        full = F.when(F.rlike(text, F.lit("^[0-2][0-9]:[0-5][0-9]$")), F.concat(text, F.lit(":00"))).otherwise(text)
        return F.when(F.rlike(full, F.lit("^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$")), full)
    return text


def read_columns_spec(spark: SparkSession, path: str, spec: Sequence[tuple[str, str, str]]) -> tuple[DataFrame, list[str], DataFrame]:
    """CSV (gzip too) with header -> typed table after a (source, target, kind) list.

    A missing source column is an error; unlisted ones are returned by name. The third result counts, per
    target, the non-empty cells that did not fit their kind.
    """
    raw = spark.read.option("header", True).csv(path)
    missing = [s for s, _, _ in spec if s not in raw.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    extra = sorted(set(raw.columns) - {s for s, _, _ in spec})
    typed = raw.select(*[_kind(F.col(f"`{s}`"), k).alias(t) for s, t, k in spec])
    lost = lambda s, k: F.count_if(F.nullif(F.trim(F.col(f"`{s}`")), F.lit("")).isNotNull() & _kind(F.col(f"`{s}`"), k).isNull())
    counts = raw.agg(*[lost(s, k).alias(t) for s, t, k in spec])
    rejects = counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("column"), F.col(t).alias("rejected")) for _, t, _ in spec])).alias("r")).select("r.*")
    return typed, extra, rejects


def read_events_any(spark: SparkSession, path: str) -> DataFrame:
    """Event CSVs of two layouts -> detect_ts, entry_ts, exit_ts, net_bp, symbol, source_file, event_id.

    The symbol comes from the name of the file (or of the ``X.csv`` folder a Spark job wrote). The id is the
    hash of that path, the hash of the row and its occurrence number among equal rows, so re-reads agree.
    """
    raw = spark.read.option("header", True).csv(path).withColumn("_file", F.input_file_name())
    for c in ("detect_ts", "ts", "net_ret_bp", "net_bp", "leg", "horizon"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    whole = F.regexp_extract("_file", r"^(.*?\.csv)(/part-[^/]*)?$", 1)
    name = F.regexp_replace(whole, r"^.*/", "")
    upper = F.upper(name)
    symbol = F.when(F.contains(upper, F.lit("BTC")), "BTCUSDT").when(F.contains(upper, F.lit("ETH")), "ETHUSDT")
    body = F.sha2(F.concat_ws("|", "detect_ts", "ts", "entry_ts", "exit_ts", "net_ret_bp", "net_bp", "leg", "horizon"), 256)
    d = raw.select(F.coalesce(_num("detect_ts", "bigint"), _num("ts", "bigint")).alias("detect_ts"), _num("entry_ts", "bigint").alias("entry_ts"), _num("exit_ts", "bigint").alias("exit_ts"),
                   F.coalesce(_num("net_ret_bp"), _num("net_bp")).alias("net_bp"), symbol.alias("symbol"), name.alias("source_file"), "leg", "horizon", F.substring(F.sha2(whole, 256), 1, 16).alias("_f"), body.alias("_h"))
    nth = F.row_number().over(Window.partitionBy("_f", "_h").orderBy("entry_ts"))  # equal rows only
    return d.withColumn("event_id", F.concat_ws(":", "_f", "_h", nth.cast("string"))).drop("_f", "_h")


def read_event_families(spark: SparkSession, globs: dict[str, str]) -> DataFrame:
    """One glob per family; the strategy key comes from the file name and, where rows carry one, the horizon."""
    from ..functions.scalar import strategy_direction, strategy_key
    out = None
    for family, path in globs.items():
        d = read_events_any(spark, path).withColumn("family", F.lit(family))
        out = d if out is None else out.unionByName(d)
    return out.withColumn("strategy", strategy_key("source_file", "horizon")).withColumn("direction", strategy_direction("source_file", "leg"))


def read_books(spark: SparkSession, path: str, *, streams: Sequence | None = None, t0: int | None = None, t1: int | None = None) -> DataFrame:
    """Snapshots with nested levels; stream and time filters reach the Parquet scan."""
    d = spark.read.parquet(path)
    if streams is not None:
        d = d.where(F.col("stream").isin(list(streams)))
    if t0 is not None:
        d = d.where(F.col("received_ms") >= t0)
    if t1 is not None:
        d = d.where(F.col("received_ms") < t1)
    return d


def normalise_kline_arrays(df: DataFrame, payload: str, *, quote_index: int, buy_index: int | None = None, path: str | None = None) -> DataFrame:
    """Nested-array JSON payloads -> bars. ``quote_index`` and ``buy_index`` are the 0-based positions of the
    quote volume and taker-buy volume; ``path`` reaches the array inside an object."""
    text = F.get_json_object(payload, path) if path else F.col(payload)
    rows = F.from_json(text, "array<array<string>>")
    keep = [c for c in df.columns if c != payload]
    e = df.select(*keep, F.explode(rows).alias("_r"))
    at = lambda i, t="double": F.get("_r", F.lit(i)).try_cast(t)
    return e.select(*keep, at(0, "bigint").alias("ts"), *[at(i + 1).alias(n) for i, n in enumerate(("open", "high", "low", "close"))], at(quote_index).alias("quote_volume"),
                    (at(buy_index) if buy_index is not None else F.lit(None).cast("double")).alias("taker_buy_quote"))
