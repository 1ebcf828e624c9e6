"""Source, loading-rule and sink queries (S1-S17). Files are written by Spark from the driver tables into the
shared scratch folder and read back through the readers."""

from pyspark.sql import functions as F

from ..functions import book as bk
from ..session import DAY, HOUR, scratch_path
from ..sources import readers, tables
from .registry import query

BARS = ["open", "high", "low", "close"]


def _csv(t, df, name, header=False, **options):
    path = scratch_path(t.spark, name)
    df.write.option("header", header).options(**options).csv(path)
    return path


def _json(t, df, name):
    path = scratch_path(t.spark, name)
    df.write.json(path)
    return path


@query("S1_read_klines_headerless", use="bars", dbl="open high low close volume quote_volume taker_buy_quote", sql="SELECT 'x' AS venue, 'perp' AS market, 'click' AS symbol, ts, open, high, low, close, volume, quote_volume, trades, volume AS taker_buy_base, taker_buy_quote FROM bars WHERE symbol = 'click' AND trades <> 2")
def _(t):
    b = t.bars.where("symbol = 'click'")
    us = F.when(F.col("trades") % 3 == 0, F.col("ts") * 1000).otherwise(F.col("ts")).cast("string")  # some files use microseconds
    stamp = F.when(F.col("trades") == 2, F.lit("open_time")).otherwise(us)                          # malformed lines
    rows = b.select(stamp.alias("a"), *BARS, "volume", (F.col("ts") + HOUR).alias("z"), "quote_volume", "trades", F.col("volume").alias("tb"), "taker_buy_quote", F.lit(0).alias("ignore"))
    return readers.read_klines_headerless(t.spark, _csv(t, rows, "klines"), venue="x", market="perp", symbol="click")


@query("S2_read_klines_header", use="bars", dbl="open high low close volume quote_volume", sql="SELECT 'y' AS venue, 'perp' AS market, 'view' AS symbol, ts, open, high, low, close, volume, quote_volume, NULL::BIGINT AS trades, NULL::DOUBLE AS taker_buy_base, NULL::DOUBLE AS taker_buy_quote FROM bars WHERE symbol = 'view'")
def _(t):
    rows = t.bars.where("symbol = 'view'").select(F.col("ts").alias("open_time"), *BARS, "volume", F.col("quote_volume").alias("turnover"))
    return readers.read_klines_header(t.spark, _csv(t, rows, "klines", header=True), venue="y", market="perp", symbol="view")


@query("S3_read_funding_csv", use="funding", dbl="rate interval_hours", sql="SELECT 'x' AS venue, 'F' AS symbol, ts, rate, 8.0::DOUBLE AS interval_hours FROM funding")
def _(t):
    rows = t.funding.select(F.col("ts").alias("calc_time"), F.lit(8).alias("funding_interval_hours"), F.col("rate").alias("last_funding_rate"))
    return readers.read_funding_csv(t.spark, _csv(t, rows, "funding", header=True), venue="x", symbol="F")


@query("S4_read_funding_json", use="funding", dbl="rate interval_hours", sql="SELECT 'h' AS venue, 'F' AS symbol, ts, rate, 1.0::DOUBLE AS interval_hours FROM funding")
def _(t):
    rows = t.funding.select(F.col("ts").cast("string").alias("time"), F.col("rate").cast("string").alias("fundingRate"))
    return readers.read_funding_json(t.spark, _json(t, rows, "funding"), venue="h", symbol="F", time="time", interval_hours=1.0, multi_line=False)


@query("S5_read_oi_metrics", use="bars", dbl="open_interest oi_value", sql="SELECT symbol, ts, CASE WHEN trades % 4 <> 0 THEN volume END AS open_interest, quote_volume AS oi_value FROM bars WHERE symbol = 'click'")
def _(t):
    rows = t.bars.where("symbol = 'click'").select(
        F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd HH:mm:ss").alias("create_time"), F.when(F.col("trades") % 4 != 0, F.col("volume")).alias("sum_open_interest"),
        F.col("quote_volume").alias("sum_open_interest_value"), F.lit(1.0).alias("sum_taker_long_short_vol_ratio"), F.lit(1.0).alias("sum_toptrader_long_short_ratio"))
    m = readers.read_oi_metrics(t.spark, _csv(t, rows, "metrics", header=True), venue="x", symbol="click")
    return m.select("symbol", "ts", "open_interest", "oi_value")


@query("S6_read_candles_json", use="bars", dbl="o h l c v", sql="SELECT ts AS t, open AS o, high AS h, low AS l, close AS c, volume AS v FROM bars WHERE symbol = 'signup'")
def _(t):
    rows = t.bars.where("symbol = 'signup'").select(F.col("ts").alias("t"), *[F.col(c).cast("string").alias(n) for c, n in zip([*BARS, "volume"], "ohlcv")])
    return readers.read_candles_json(t.spark, _json(t, rows, "candles"), multi_line=False)[0]


@query("S6_read_funding_premium", use="bars", sql=f"SELECT ts AS time, 'late' AS problem FROM bars WHERE symbol = 'signup' AND trades > 5")
def _(t):
    late = F.when(F.col("trades") > 5, 61_000).otherwise(25)
    rows = t.bars.where("symbol = 'signup'").select((F.col("ts") + late).alias("time"), F.col("close").cast("string").alias("fundingRate"), F.lit("0.1").alias("premium"))
    return readers.read_funding_premium(t.spark, _json(t, rows, "funding"), multi_line=False)[1]


@query("S7_read_index_csv", use="daily", dbl="value", sql="SELECT date, CASE WHEN n % 3 <> 0 THEN close END AS value FROM daily WHERE symbol = '5-LOW'")
def _(t):
    rows = t.daily.where("symbol = '5-LOW'").select(F.col("date").alias("observation_date"), F.when(F.col("n") % 3 == 0, ".").otherwise(F.col("close").cast("string")).alias("IDX"))
    return readers.read_index_csv(t.spark, _csv(t, rows, "index", header=True), "IDX")[0]


SPEC = [("Date", "date", "D"), ("Code", "code", "T"), ("Px", "px", "R"), ("Qty", "qty", "I"), ("Flag", "flag", "B"), ("Time", "tm", "H")]


def _spec_file(t):
    o = t.table("orders")
    k = F.col("o_orderkey")
    rows = o.select(F.col("o_orderdate").cast("date").cast("string").alias("Date"), k.cast("string").alias("Code"), F.when(k % 50 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("Px"),
                    F.when(k % 40 == 0, "1.5").otherwise((k % 9).cast("string")).alias("Qty"), F.when(k % 2 == 0, "true").otherwise("false").alias("Flag"),
                    F.when(k % 30 == 0, "99:00").otherwise(F.format_string("%02d:%02d", k % 24, k % 60)).alias("Time"), F.lit("x").alias("Unlisted"))
    return _csv(t, rows, "columns", header=True, compression="gzip")


@query("S8_read_columns_spec", dbl="px", sql="SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey::VARCHAR AS code, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS px, CASE WHEN o_orderkey % 40 <> 0 THEN o_orderkey % 9 END AS qty, o_orderkey % 2 = 0 AS flag, CASE WHEN o_orderkey % 30 <> 0 THEN printf('%02d:%02d:00', o_orderkey % 24, o_orderkey % 60) END AS tm FROM orders")
def _(t):
    return readers.read_columns_spec(t.spark, _spec_file(t), SPEC)[0]


@query("S8_reject_counts", sql="""SELECT unnest(['date', 'code', 'px', 'qty', 'flag', 'tm']) AS "column", unnest([0, 0, (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0), (SELECT count(*) FROM orders WHERE o_orderkey % 40 = 0), 0, (SELECT count(*) FROM orders WHERE o_orderkey % 30 = 0)]) AS rejected""")
def _(t):
    return readers.read_columns_spec(t.spark, _spec_file(t), SPEC)[2]


@query("S9_merge_latest_by_key", use="bars", dbl="close", sql="SELECT symbol, ts, CASE WHEN trades % 2 = 0 THEN close + 1 ELSE close END AS close FROM bars")
def _(t):
    b = t.bars.select("symbol", "ts", "close", "trades")
    return tables.merge_latest_by_key([b.drop("trades"), b.where("trades % 2 = 0").select("symbol", "ts", (F.col("close") + 1).alias("close"))], ["symbol", "ts"])


@query("S10_insert_ignore_by_key", use="fills", dbl="px", digits=8, sql="""WITH o AS (SELECT order_id, px, 0 AS seq FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts, line, part, px) AS r FROM fills) WHERE r = 1 AND order_id % 2 = 0), n AS (SELECT order_id, px, 1 AS seq FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY line DESC, part DESC, ts DESC, px DESC) AS r FROM fills) WHERE r = 1 AND order_id % 2 <> 0)
SELECT order_id, px FROM o UNION ALL SELECT order_id, px FROM n""")
def _(t):
    f = t.fills.select("order_id", "px", F.struct("ts", "line", "part", "px").alias("a"), F.struct(-F.col("line"), -F.col("part"), -F.col("ts"), -F.col("px")).alias("b"))
    old = f.where("order_id % 2 = 0").groupBy("order_id").agg(F.min_by("px", "a").alias("px"))
    new = f.select("order_id", "px", F.col("b").alias("seq"))
    return tables.insert_ignore_by_key(old.withColumn("seq", F.lit(None).cast(new.schema["seq"].dataType)), new.select("order_id", "px", "seq"), ["order_id"], seq="seq").select("order_id", "px")


@query("S11_replace_dates", dbl="o_totalprice", sql="""WITH f AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS file, CASE o_orderpriority WHEN '3-MEDIUM' THEN 9 ELSE length(o_orderpriority) END AS modified, o_orderkey, o_totalprice FROM orders), w AS (SELECT date, arg_max(file, (modified, file)) AS file FROM f GROUP BY 1) SELECT date, o_orderkey, o_totalprice FROM f JOIN w USING (date, file)""")
def _(t):
    f = t.table("orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("file"), F.when(F.col("o_orderpriority") == "3-MEDIUM", 9).otherwise(F.length("o_orderpriority")).alias("modified"), "o_orderkey", "o_totalprice")
    return tables.replace_dates(f, date="date", source="file", modified="modified").select("date", "o_orderkey", "o_totalprice")


@query("S12_append_only_check", use="daily", dbl="close", sql="SELECT symbol, date, close FROM daily WHERE n = 4")
def _(t):
    d = t.daily
    new = d.select("symbol", "date", F.when(F.col("n") == 4, F.col("close") + 1).otherwise(F.col("close")).alias("close"))
    return tables.append_only_violations(d.select("symbol", "date", "close"), new)


def _event_files(t):
    root = scratch_path(t.spark, "events")
    e = t.order_events.select("detect_ts", "entry_ts", "exit_ts", "net_bp", "symbol", F.when(F.col("order_id") % 2 == 0, "top").otherwise("bottom").alias("leg"), "order_id")
    a = e.where("symbol = '1-URGENT'").select("detect_ts", "entry_ts", "exit_ts", F.col("net_bp").alias("net_ret_bp"))
    b = e.where("symbol = '2-HIGH'").select(F.col("detect_ts").alias("ts"), "entry_ts", "exit_ts", "net_bp", "leg", F.lit("72h").alias("horizon"))
    a.write.option("header", True).csv(f"{root}/liq/events_btc_long_ret-2.csv")
    b.write.option("header", True).csv(f"{root}/crowd/A2_contrarian_events_ETHUSDT.csv")
    return root


@query("S13_read_events_any", use="order_events", dbl="net_bp", sql="SELECT detect_ts, entry_ts, exit_ts, net_bp, CASE symbol WHEN '1-URGENT' THEN 'BTCUSDT' ELSE 'ETHUSDT' END AS symbol FROM order_events WHERE symbol IN ('1-URGENT', '2-HIGH')")
def _(t):
    root = _event_files(t)
    both = readers.read_events_any(t.spark, f"{root}/liq/*.csv").unionByName(readers.read_events_any(t.spark, f"{root}/crowd/*.csv"))
    return both.select("detect_ts", "entry_ts", "exit_ts", "net_bp", "symbol")


@query("S14_read_event_families", use="order_events", dbl="mean_bp", sql="""SELECT CASE symbol WHEN '1-URGENT' THEN 'liq' ELSE 'crowd' END AS family, CASE symbol WHEN '1-URGENT' THEN 'btc_long_ret-2' ELSE 'A2_contrarian_ETHUSDT_72h' END AS strategy, CASE WHEN symbol = '1-URGENT' THEN 'long' WHEN order_id % 2 = 0 THEN 'short' ELSE 'long' END AS direction, count(*) AS n, avg(net_bp) AS mean_bp FROM order_events WHERE symbol IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2, 3""")
def _(t):
    root = _event_files(t)
    d = readers.read_event_families(t.spark, {"liq": f"{root}/liq/*.csv", "crowd": f"{root}/crowd/*.csv"})
    return d.groupBy("family", "strategy", "direction").agg(F.count_distinct("event_id").alias("n"), F.avg("net_bp").alias("mean_bp"))


@query("S15_read_books", use="levels", dbl="mid", sql=f"SELECT DISTINCT stream, tick_ms, mid FROM levels WHERE stream IN (1, 2, 3) AND received_ms >= 900000000000")
def _(t):
    path = scratch_path(t.spark, "books")
    t.books.write.parquet(path)
    return readers.read_books(t.spark, path, streams=[1, 2, 3], t0=900_000_000_000).select("stream", "tick_ms", bk.mid().alias("mid"))


@query("S16_sink_roundtrip", use="daily", dbl="close", sql="SELECT symbol, date, CASE WHEN date >= DATE '2001-01-01' THEN close * 2 ELSE close END AS close FROM daily")
def _(t):
    path = scratch_path(t.spark, "daily")
    d = t.daily.select("symbol", "date", "close").withColumn("yr", F.year("date"))
    tables.write_new(d.where("yr < 0"), f"{path}-refused")
    tables.write_dates(d, path, "yr")
    tables.write_dates(d.where("yr >= 2001").withColumn("close", F.col("close") * 2), path, "yr")
    return t.spark.read.parquet(path).select("symbol", "date", "close")


@query("S17_normalise_kline_arrays", use="bars", dbl="open high low close quote_volume", sql="SELECT symbol, ts, open, high, low, close, quote_volume FROM bars")
def _(t):
    row = F.array(*[F.col(c).cast("string") for c in ("ts", *BARS, "volume", "quote_volume")])
    day = t.bars.groupBy("symbol", F.floor(F.col("ts") / DAY).alias("day")).agg(F.reverse(F.array_sort(F.collect_list(row))).alias("list"))  # at most 24 bars
    payload = day.select("symbol", F.to_json(F.struct(F.struct("list").alias("result"))).alias("payload"))
    return readers.normalise_kline_arrays(payload, "payload", quote_index=6, path="$.result.list").drop("taker_buy_quote")

