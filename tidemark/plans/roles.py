"""Market-data roles derived from the driver tables, as DataFrames and as the same CTEs in SQL.

ticks      every row of ``events``: symbol = event type, price = value, size and side from ``props``
bars       hourly bars of the ticks
daily      last order price per priority and day (a daily close series with natural gaps)
equities   daily bars per supplier nation from ``lineitem``
books      order-book snapshots per supplier and 30-day tick, price levels from ``lineitem``
fills      lineitems as fills of their order; flow_orders the orders they belong to
attempts / positions   account reads per customer and the positions they returned
cross      customer x year cross-section with segment as sector
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import chunk_width
from ..session import DAY, HOUR

_CACHE: dict[tuple[str, str], "Tables"] = {}


def millis(c: str):
    """Epoch milliseconds of a timestamp column, independent of NTZ or session-zone typing."""
    return F.unix_millis(F.col(c).cast("timestamp"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.ansi.enabled", "false")  # an undefined ratio is unknown, not a failed job
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _CACHE:
            _CACHE[key] = cls(spark, sf_dir)
        return _CACHE[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- ticks and bars ------------------------------------------------------------------------
    @property
    def ticks(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").select(
            F.col("event_type").alias("symbol"), millis("ts").alias("ts"), "event_id", "user_id",
            F.col("value").alias("px"), (k + 1).cast("double").alias("sz"),
            F.when(k % 2 == 0, "B").otherwise("A").alias("side"))

    @cached_property
    def tick_width(self) -> int:
        """Chunk width for scans over raw ticks, from their densest hour."""
        return chunk_width(self.ticks, ["symbol"])

    @property
    def bars(self) -> DataFrame:
        return self.bars_of(self.ticks)

    @property
    def perp_bars(self) -> DataFrame:
        """A second market of the same symbols: every other tick, so with gaps of its own."""
        return self.bars_of(self.ticks.where("event_id % 2 = 0"))

    @staticmethod
    def bars_of(ticks: DataFrame) -> DataFrame:
        usd = F.col("px") * F.col("sz")
        order = F.struct("ts", "event_id")
        return (ticks.groupBy("symbol", (F.floor(F.col("ts") / HOUR) * HOUR).alias("bar_ts"))
                .agg(F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
                     F.max_by("px", order).alias("close"), F.sum("sz").alias("volume"), F.sum(usd).alias("quote_volume"),
                     F.count("*").alias("trades"), F.sum(F.when(F.col("side") == "B", usd).otherwise(0.0)).alias("taker_buy_quote"))
                .withColumnRenamed("bar_ts", "ts"))

    @property
    def funding(self) -> DataFrame:
        """An irregular rate series per user."""
        return (self.ticks.where("symbol = 'signup'")
                .select("user_id", "ts", "event_id", ((F.col("px") - 20) / 10_000).alias("rate")))

    @property
    def decisions(self) -> DataFrame:
        return self.ticks.where("symbol = 'purchase'").select("user_id", "ts", "event_id", "px", "side")

    # -- daily series --------------------------------------------------------------------------
    @property
    def daily(self) -> DataFrame:
        return (self.table("orders")
                .groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"))
                .agg(F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").alias("n")))

    @property
    def equities(self) -> DataFrame:
        px = F.col("l_extendedprice") / F.col("l_quantity")
        order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
        sup = self.table("supplier").select("s_suppkey", "s_nationkey")
        li = self.table("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                           "l_extendedprice", F.col("l_shipdate").cast("date").alias("date"))
        day = (li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
               .groupBy(F.col("s_nationkey").alias("code"), "date")
               .agg(F.min_by(px, order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"),
                    F.max_by(px, order).alias("close"), F.sum("l_extendedprice").alias("turnover"),
                    F.sum("l_quantity").alias("shares")))
        return day.withColumn("adj_factor", F.when((F.month("date") == 6) & (F.dayofmonth("date") == 15), 0.5).otherwise(1.0))

    # -- books ---------------------------------------------------------------------------------
    @property
    def book_levels(self) -> DataFrame:
        """One row per (stream, tick, side, price); at most 200 price offsets per side."""
        tick = F.floor(millis("l_shipdate") / (30 * DAY)) * (30 * DAY)
        offset = (F.floor(F.col("l_extendedprice")).cast("bigint") % 200) + 1
        li = self.table("lineitem").select(
            F.col("l_suppkey").alias("stream"), tick.alias("tick_ms"), offset.alias("offset_bp"),
            F.when(F.col("l_linestatus") == "O", "ask").otherwise("bid").alias("side"), F.col("l_quantity").alias("sz"))
        grouped = li.groupBy("stream", "tick_ms", "side", "offset_bp").agg(F.sum("sz").alias("sz"), F.count("*").alias("n"))
        centre = 100.0 + ((F.col("tick_ms") / (30 * DAY)).cast("bigint") % 7) * 0.25
        sign = F.when(F.col("side") == "ask", 1.0).otherwise(-1.0)
        return grouped.select("stream", "tick_ms", "side", "offset_bp", "n", "sz",
                              F.round(centre * (1 + sign * F.col("offset_bp") / 10_000.0), 6).alias("px"))

    @property
    def books(self) -> DataFrame:
        return self.all_books.where((F.size("bids") > 0) & (F.size("asks") > 0))

    @property
    def all_books(self) -> DataFrame:
        """Snapshots with one side empty too."""
        level = F.struct(F.col("px"), F.col("sz"), F.col("n"))
        sides = (self.book_levels.groupBy("stream", "tick_ms")
                 .agg(F.collect_list(F.when(F.col("side") == "bid", level)).alias("b"),
                      F.collect_list(F.when(F.col("side") == "ask", level)).alias("a")))
        return (sides.select("stream", "tick_ms", F.reverse(F.array_sort("b")).alias("bids"), F.array_sort("a").alias("asks"))
                .withColumn("bid_cov", F.when(F.col("stream") % 2 == 0, 150.0).otherwise(float("inf")))
                .withColumn("ask_cov", F.lit(float("inf")))
                .withColumn("requested_ms", F.col("tick_ms") + (F.col("stream") % 24) * HOUR)
                .withColumn("received_ms", F.col("requested_ms") + (F.col("stream") * 7919 + F.floor(F.col("tick_ms") / DAY)) % 997))

    # -- flow ----------------------------------------------------------------------------------
    @property
    def fills(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
            millis("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
            F.col("l_quantity").alias("sz"))

    @property
    def order_heads(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("coin"),
            F.when(F.col("o_orderstatus") == "F", "A").otherwise("B").alias("side"), millis("o_orderdate").alias("placed_ts"),
            F.when(F.col("o_orderkey") % 3 != 0, F.round(F.col("o_totalprice") / 1000, 0)).alias("declared_sz"),
            (F.col("o_orderkey") % 2 == 0).alias("reduce_only"))

    @property
    def order_events(self) -> DataFrame:
        """Orders as trades: entry a day after placement, exit by the last shipment within 60 days."""
        ship = self.fills.groupBy("order_id").agg(F.max("ts").alias("last_ship"))
        o = self.table("orders").select(F.col("o_orderkey").alias("order_id"), ((F.col("o_totalprice") % 1000) - 480).alias("net_bp"))
        h = self.order_heads.join(ship, "order_id").join(o, "order_id")
        entry = F.col("placed_ts") + DAY
        exit_ = F.greatest(entry + DAY, F.least(F.col("last_ship"), entry + 60 * DAY))
        return h.select("order_id", F.concat_ws("-", "coin", "side").alias("strategy"), F.col("side").alias("family"), F.col("coin").alias("symbol"),
                        F.col("placed_ts").alias("detect_ts"), entry.alias("entry_ts"), exit_.alias("exit_ts"), "net_bp")

    @property
    def attempts(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("user"), millis("o_orderdate").alias("observed_ts"),
            F.when(F.col("o_orderstatus") == "F", "failure").when(F.col("o_orderstatus") == "P", "empty")
            .otherwise("success").alias("status"))

    @property
    def positions(self) -> DataFrame:
        """Rows returned by successful reads: per user, time and coin the net size over the read's lines."""
        li = self.table("lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus")
        at = self.attempts.where("status = 'success'")
        signed = F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
        j = li.join(at, F.col("l_orderkey") == F.col("attempt_id"))
        g = (j.groupBy("user", F.col("observed_ts").alias("ts"), 
                       F.when(F.col("l_returnflag") == "A", "1-URGENT").when(F.col("l_returnflag") == "N", "2-HIGH").otherwise("3-MEDIUM").alias("coin"))
             .agg(F.sum(signed).alias("szi"), F.sum("l_extendedprice").alias("position_value"),
                  F.max("l_discount").alias("d")))
        swing = F.when(F.col("szi") > 0, -1.0).otherwise(1.0) * (F.col("d") * 4)
        return g.select("user", "ts", "coin", "szi", F.round("position_value", 2).alias("position_value"),
                        F.when(F.col("d") > 0, F.round(100 * (1 + swing), 6)).alias("liq_px"))

    # -- cross-section -------------------------------------------------------------------------
    @property
    def cross(self) -> DataFrame:
        """Per customer and year: next-year growth as target, activity as signal, two controls."""
        spend = (self.table("orders").groupBy(F.col("o_custkey").alias("code"), F.year("o_orderdate").alias("yr"))
                 .agg(F.sum("o_totalprice").alias("spend"), F.count("*").alias("n")))
        w = Window.partitionBy("code").orderBy("yr")
        nxt = F.when(F.lead("yr").over(w) == F.col("yr") + 1, F.lead("spend").over(w))
        c = self.table("customer").select(F.col("c_custkey").alias("code"), "c_acctbal", F.col("c_mktsegment").alias("sector"))
        return (spend.withColumn("next_spend", nxt).join(c, "code")
                .select("code", "yr", "sector", F.ln(F.col("next_spend") / F.col("spend")).alias("y"),
                        F.col("n").cast("double").alias("signal"), F.ln("spend").alias("c1"), F.col("c_acctbal").alias("c2"),
                        F.col("spend").alias("weight")))


_SQL = {
    "ticks": ("", f"""SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ts, event_id, user_id, value AS px,
        CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS DOUBLE) AS sz,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'B' ELSE 'A' END AS side FROM events"""),
    "bars": ("ticks", f"""SELECT symbol, (ts // {HOUR}) * {HOUR} AS ts, first(px ORDER BY t.ts, event_id) AS open, max(px) AS high,
        min(px) AS low, last(px ORDER BY t.ts, event_id) AS close, sum(sz) AS volume, sum(px * sz) AS quote_volume, count(*) AS trades,
        sum(CASE WHEN side = 'B' THEN px * sz ELSE 0 END) AS taker_buy_quote FROM ticks t GROUP BY symbol, (t.ts // {HOUR}) * {HOUR}"""),
    "perp_bars": ("ticks", f"""SELECT symbol, (ts // {HOUR}) * {HOUR} AS ts, first(px ORDER BY t.ts, event_id) AS open, max(px) AS high,
        min(px) AS low, last(px ORDER BY t.ts, event_id) AS close, sum(sz) AS volume, sum(px * sz) AS quote_volume, count(*) AS trades,
        sum(CASE WHEN side = 'B' THEN px * sz ELSE 0 END) AS taker_buy_quote FROM ticks t WHERE event_id % 2 = 0 GROUP BY symbol, (t.ts // {HOUR}) * {HOUR}"""),
    "funding": ("ticks", "SELECT user_id, ts, event_id, (px - 20) / 10000 AS rate FROM ticks WHERE symbol = 'signup'"),
    "decisions": ("ticks", "SELECT user_id, ts, event_id, px, side FROM ticks WHERE symbol = 'purchase'"),
    "daily": ("", """SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS close,
        count(*) AS n FROM orders GROUP BY 1, 2"""),
    "equities": ("", """SELECT s_nationkey AS code, CAST(l_shipdate AS DATE) AS date,
        first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
        max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
        last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
        sum(l_extendedprice) AS turnover, sum(l_quantity) AS shares,
        CASE WHEN month(CAST(l_shipdate AS DATE)) = 6 AND day(CAST(l_shipdate AS DATE)) = 15 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS adj_factor
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 9"""),
    "book_levels": ("", f"""SELECT l_suppkey AS stream, (epoch_ms(l_shipdate) // {30 * DAY}) * {30 * DAY} AS tick_ms,
        CASE WHEN l_linestatus = 'O' THEN 'ask' ELSE 'bid' END AS side, (floor(l_extendedprice)::BIGINT % 200) + 1 AS offset_bp,
        sum(l_quantity) AS sz, count(*) AS n,
        round((100.0::DOUBLE + ((any_value(epoch_ms(l_shipdate)) // {30 * DAY}) % 7) * 0.25::DOUBLE) *
              (1 + CASE WHEN any_value(l_linestatus) = 'O' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * any_value((floor(l_extendedprice)::BIGINT % 200) + 1) / 10000.0::DOUBLE), 6) AS px
        FROM lineitem GROUP BY 1, 2, 3, 4"""),
    "levels": ("book_levels", """SELECT l.*, m.best_bid, m.best_ask, (m.best_bid + m.best_ask) / 2 AS mid,
        abs(l.px / ((m.best_bid + m.best_ask) / 2) - 1) * 10000 AS dist,
        CASE WHEN side = 'bid' AND stream % 2 = 0 THEN 150.0::DOUBLE ELSE 'inf'::DOUBLE END AS cov, l.tick_ms + (stream % 24) * 3600000 AS requested_ms, l.tick_ms + (stream % 24) * 3600000 + (stream * 7919 + l.tick_ms // 86400000) % 997 AS received_ms
        FROM book_levels l JOIN (SELECT stream, tick_ms, max(px) FILTER (side = 'bid') AS best_bid, min(px) FILTER (side = 'ask') AS best_ask
        FROM book_levels GROUP BY 1, 2) m USING (stream, tick_ms) WHERE best_bid IS NOT NULL AND best_ask IS NOT NULL"""),
    "fills": ("", """SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, epoch_ms(l_shipdate) AS ts,
        l_extendedprice / l_quantity AS px, l_quantity AS sz FROM lineitem"""),
    "order_heads": ("", """SELECT o_orderkey AS order_id, o_custkey AS "user", o_orderpriority AS coin,
        CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'B' END AS side, epoch_ms(o_orderdate) AS placed_ts,
        CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice / 1000, 0) END AS declared_sz, o_orderkey % 2 = 0 AS reduce_only FROM orders"""),
    "order_events": ("fills order_heads", f"""SELECT h.order_id, h.coin || '-' || h.side AS strategy, h.side AS family, h.coin AS symbol, h.placed_ts AS detect_ts,
        h.placed_ts + {DAY} AS entry_ts, greatest(h.placed_ts + {2 * DAY}, least(s.last_ship, h.placed_ts + {61 * DAY})) AS exit_ts, (o_totalprice % 1000) - 480 AS net_bp
        FROM order_heads h JOIN (SELECT order_id, max(ts) AS last_ship FROM fills GROUP BY 1) s USING (order_id) JOIN orders ON o_orderkey = h.order_id"""),
    "attempts": ("", """SELECT o_orderkey AS attempt_id, o_custkey AS "user", epoch_ms(o_orderdate) AS observed_ts,
        CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'P' THEN 'empty' ELSE 'success' END AS status FROM orders"""),
    "positions": ("attempts", """SELECT "user", ts, coin, szi, round(pv, 2) AS position_value,
        CASE WHEN d > 0 THEN round(100 * (1 + (CASE WHEN szi > 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * (d * 4)), 6) END AS liq_px
        FROM (SELECT "user", observed_ts AS ts, CASE l_returnflag WHEN 'A' THEN '1-URGENT' WHEN 'N' THEN '2-HIGH' ELSE '3-MEDIUM' END AS coin,
              sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END) AS szi, sum(l_extendedprice) AS pv, max(l_discount) AS d
              FROM lineitem JOIN attempts ON l_orderkey = attempt_id WHERE status = 'success' GROUP BY 1, 2, 3)"""),
    "cross_section": ("", """SELECT s.code, s.yr, c_mktsegment AS sector,
        ln(CASE WHEN lead(s.yr) OVER w = s.yr + 1 THEN lead(spend) OVER w END / spend) AS y, CAST(n AS DOUBLE) AS signal, ln(spend) AS c1,
        c_acctbal AS c2, spend AS weight
        FROM (SELECT o_custkey AS code, year(o_orderdate) AS yr, sum(o_totalprice) AS spend, count(*) AS n FROM orders GROUP BY 1, 2) s
        JOIN customer ON s.code = c_custkey WINDOW w AS (PARTITION BY s.code ORDER BY s.yr)"""),
}


def ctes(*names: str) -> str:
    """``WITH`` clause holding the named role CTEs and what they depend on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in _SQL[name][0].split():
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({_SQL[n][1]})" for n in ordered) if ordered else ""
