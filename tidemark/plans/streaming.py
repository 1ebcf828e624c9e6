"""Streaming queries (T1-T9, T11): each runs a stream over the driver tables to its end and returns the sink."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import book as ob
from ..operators import warning as wn
from ..session import DAY, HOUR, materialize, scratch_path
from ..streaming import jobs
from .book import BOOK_WIDTH, EPI, RULE, TICK
from .flow import CFG, WS
from .registry import query
from .roles import millis

# Append mode emits a window once the watermark (latest event minus the delay) has passed its end.
LAST = "(SELECT max(epoch_us(ts)) // 1000 FROM events)"


def stream_ticks(t):
    schema = t.table("events").schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select(F.col("event_type").alias("symbol"), millis("ts").alias("ts"), "event_id", "user_id", F.col("value").alias("px"), (k + 1).cast("double").alias("sz"),
                      F.when(k % 2 == 0, "B").otherwise("A").alias("side"))


def staged(t, df, name):
    """A derived table as a folder a stream can read."""
    path = scratch_path(t.spark, name)
    df.write.parquet(path)
    return t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(path)


def drain(t, stream, name):
    out = scratch_path(t.spark, name)
    jobs.run_available(stream, checkpoint=scratch_path(t.spark, f"{name}-ckpt"), path=out)
    return t.spark.read.schema(stream.schema).parquet(out)


def stretches(df, ts, parts):
    """``df`` in ``parts`` equal stretches of time."""
    low, high = df.agg(F.min(ts), F.max(ts)).first()
    for i in range(parts):
        upto = F.lit(low + (high - low) * (i + 1) // parts)
        yield df.where((F.col(ts) <= upto) & (F.col(ts) > F.lit(low + (high - low) * i // parts) if i else F.col(ts) <= upto))


def in_parts(t, df, ts, sink, name, parts=3):
    """Feed a table to a micro-batch sink in ``parts`` equal stretches of time, one batch each, and return the last batch's
    number. Each stretch is as many files as Spark writes; the table itself is evaluated once."""
    df = materialize(df, f"{name}-whole")
    path, ckpt = scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-ckpt")
    for part in stretches(df, ts, parts):
        part.write.mode("append").parquet(path)
        stream = t.spark.readStream.schema(df.schema).parquet(path)
        jobs.run_available(stream, checkpoint=ckpt, sink=sink)
    return parts - 1


@query("T1_stream_dedupe", use="ticks", dbl="px", sql="SELECT event_id, symbol, ts, px FROM ticks")
def _(t):
    twice = stream_ticks(t).withColumn("_c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_c")
    return drain(t, jobs.dedupe_fills(twice, ["event_id"], delay="1 hour").select("event_id", "symbol", "ts", "px"), "dedupe")


@query("T2_stream_flow_rate", use="ticks", dbl="buy_usd sell_usd", digits=4, sql=f"""WITH w AS (SELECT symbol, side, px * sz AS usd, unnest(generate_series((ts // {HOUR}) * {HOUR} - {3 * HOUR}, (ts // {HOUR}) * {HOUR}, {HOUR})) AS s FROM ticks)
SELECT s AS start_ts, s + {4 * HOUR} AS end_ts, symbol, count(*) AS fills, coalesce(sum(usd) FILTER (side = 'B'), 0) AS buy_usd, coalesce(sum(usd) FILTER (side = 'A'), 0) AS sell_usd FROM w WHERE s + {4 * HOUR} <= {LAST} - {HOUR} GROUP BY 1, 2, 3""")
def _(t):
    return drain(t, jobs.flow_rate(stream_ticks(t), ["symbol"], window="4 hours", slide="1 hour", delay="1 hour"), "flow")


@query("T3_stream_tumbling_bars", use="bars", dbl="open high low close volume quote_volume taker_buy_quote", digits=4, sql=f"SELECT * FROM bars WHERE ts + {HOUR} <= {LAST} - {HOUR}")
def _(t):
    return drain(t, jobs.tumbling_bars(stream_ticks(t), ["symbol"], step="1 hour", delay="1 hour"), "bars")


@query("T4_stream_order_lifecycle", use="fills order_heads", dbl="cum_sz", sql=f"""WITH o AS (SELECT order_id, any_value(declared_sz) AS d, sum(sz) AS c, max(ts) AS l FROM fills JOIN order_heads USING (order_id) GROUP BY 1), m AS (SELECT max(ts) - {DAY} AS wm FROM fills)
SELECT order_id, CASE WHEN d > 0 AND c >= 0.98 * d THEN 'completed' ELSE 'ended_suspected' END AS status, c AS cum_sz, l AS last_fill_ts FROM o, m WHERE (d > 0 AND c >= 0.98 * d) OR l + {30 * DAY} < wm""")
def _(t):
    f = t.fills.join(t.order_heads.select("order_id", "declared_sz"), "order_id").select("order_id", "ts", "sz", "declared_sz")
    return drain(t, jobs.order_lifecycle(staged(t, f, "fills"), gap_ms=30 * DAY, delay="1 day"), "lifecycle")


@query("T5_stream_candidate_sessions", use="ticks", sql=f"""WITH s AS (SELECT user_id, ts, symbol, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < {6 * HOUR} THEN 0 ELSE 1 END AS n FROM ticks))
SELECT user_id, min(ts) AS first_seen_ts, max(ts) AS last_seen_ts, list_sort(list(DISTINCT symbol)) AS coins, count(*) AS sightings FROM s GROUP BY user_id, k HAVING max(ts) + {6 * HOUR} <= {LAST} - {HOUR}""")
def _(t):
    return drain(t, jobs.activity_sessions(stream_ticks(t), ["user_id"], gap="6 hours", delay="1 hour", coin="symbol"), "sessions")


LIMIT, TTL = 25, 36 * HOUR
# A user's life ends when 25 others were seen since, or after 36 silent hours before the next sighting of anyone.
LIVES = f"""o AS (SELECT symbol, user_id, ts, event_id, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS i, lag(ts) OVER (PARTITION BY symbol, user_id ORDER BY ts, event_id) AS pts FROM ticks),
p AS (SELECT *, lag(i) OVER (PARTITION BY symbol, user_id ORDER BY i) AS pi, lead(i, 1, 1000000000) OVER (PARTITION BY symbol, user_id ORDER BY i) AS ni FROM o),
c AS (SELECT p.symbol, p.user_id, p.i, any_value(p.ts) AS ts, any_value(p.event_id) AS event_id, any_value(p.ni) AS ni, any_value(p.pi IS NULL OR p.ts - p.pts > {TTL}) OR count(DISTINCT x.user_id) >= {LIMIT} AS fresh FROM p LEFT JOIN o x ON x.symbol = p.symbol AND x.i > p.pi AND x.i < p.i GROUP BY 1, 2, 3),
l AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY symbol, user_id ORDER BY i) AS life FROM c),
z AS (SELECT symbol, user_id, life, min(ts) AS first_seen_ts, max(ts) AS last_seen_ts, max(i) AS i, max(ni) AS ni, list_sort(list(DISTINCT 'c' || event_id % 3)) AS coins FROM l GROUP BY 1, 2, 3),
e AS (SELECT symbol, max(ts) AS end_ts FROM o GROUP BY 1)
SELECT z.symbol AS stream, z.user_id AS "user", first_seen_ts, last_seen_ts, coins FROM z JOIN e USING (symbol) WHERE ni = 1000000000 AND end_ts - last_seen_ts <= {TTL} AND (SELECT count(DISTINCT x.user_id) FROM o x WHERE x.symbol = z.symbol AND x.i > z.i) < {LIMIT}"""


@query("T5_stream_candidate_set", use="ticks", sql=f"WITH {LIVES}")
def _(t):
    s = t.ticks.select(F.col("symbol").alias("stream"), F.col("user_id").alias("user"), "ts", F.col("event_id").alias("seq"), F.concat(F.lit("c"), F.col("event_id") % 3).alias("coin"))
    out, path, ckpt = (scratch_path(t.spark, n) for n in ("candidates", "sightings", "candidates-ckpt"))
    for part in stretches(s, "ts", 3):
        part.write.mode("append").parquet(path)
        stream = t.spark.readStream.schema(s.schema).parquet(path)
        jobs.run_available(jobs.candidate_stream(stream, limit=LIMIT, ttl=TTL), checkpoint=ckpt, path=out)
    return jobs.latest_candidates(t.spark.read.parquet(out))


@query("T6_stream_latest_account", use="attempts", sql="""SELECT "user", max(observed_ts) AS observed_ts, arg_max(attempt_id, (observed_ts, attempt_id)) AS attempt_id, arg_max(status, (observed_ts, attempt_id)) AS status FROM attempts WHERE status <> 'failure' GROUP BY 1""")
def _(t):
    a = t.attempts
    schema = T.StructType([a.schema[c] for c in ("user", "observed_ts", "attempt_id", "status")])
    table = jobs.VersionedTable(t.spark, scratch_path(t.spark, "accounts"), schema)
    return table.read(in_parts(t, a, "observed_ts", jobs.latest_attempts_sink(table), "attempts"))


FRAME = """bo AS (SELECT min(observed_ts) AS lo, max(observed_ts) AS hi FROM attempts), fr AS (SELECT 1 AS k, max(observed_ts) AS cutoff FROM attempts, bo WHERE observed_ts <= lo + (hi - lo) * 2 // 3 UNION ALL SELECT 2, max(observed_ts) FROM attempts),
la AS (SELECT k, "user", max(observed_ts) AS t FROM attempts, fr WHERE status IN ('success', 'empty') AND observed_ts <= cutoff GROUP BY 1, 2), ps AS (SELECT k, p.* FROM positions p, fr WHERE p.ts <= cutoff),
lp AS (SELECT p.* FROM ps p JOIN la ON la.k = p.k AND la."user" = p."user" AND la.t = p.ts UNION ALL SELECT p.* FROM ps p JOIN (SELECT k, "user", coin, max(ts) AS ts FROM ps GROUP BY 1, 2, 3) o ON o.k = p.k AND o."user" = p."user" AND o.coin = p.coin AND o.ts = p.ts WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.k = p.k AND la."user" = p."user")),
b AS (SELECT k, coin, position_value AS v, CASE WHEN position_value < 20000 THEN 'excluded_below_minimum' WHEN liq_px IS NULL THEN 'excluded_null_liquidation' WHEN szi = 0 OR (szi > 0 AND liq_px >= 100) OR (szi < 0 AND liq_px <= 100) THEN 'excluded_direction' WHEN abs((liq_px - 100) / 100 * 100) > 30 THEN 'outside'
 ELSE CASE WHEN szi > 0 THEN 'down:' ELSE 'up:' END || least(floor(abs((liq_px - 100) / 100 * 100) / 3)::INT, 9) END AS bucket FROM lp),
g AS (SELECT k, coin, bucket, sum(v) AS n, count(*) AS c FROM b GROUP BY 1, 2, 3)"""


@query("T7_stream_observation_frame", use="positions", dbl="notional change", digits=3, sql=f"""WITH {FRAME} SELECT coalesce(x.coin, y.coin) AS coin, coalesce(x.bucket, y.bucket) AS bucket, coalesce(x.n, 0) AS notional, coalesce(x.c, 0) AS count, coalesce(x.n, 0) - coalesce(y.n, 0) AS change
FROM (SELECT * FROM g WHERE k = 2) x FULL JOIN (SELECT * FROM g WHERE k = 1) y ON x.coin = y.coin AND x.bucket = y.bucket""")
def _(t):
    a = t.attempts
    accounts = jobs.VersionedTable(t.spark, scratch_path(t.spark, "accounts"), T.StructType([a.schema[c] for c in ("user", "observed_ts", "attempt_id", "status")]))
    schema = T.StructType([T.StructField("coin", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("notional", T.DoubleType()), T.StructField("count", T.LongType()), T.StructField("change", T.DoubleType())])
    frames = jobs.VersionedTable(t.spark, scratch_path(t.spark, "frames"), schema)
    positions = materialize(t.positions, "positions")  # each frame reads them
    sink = jobs.observation_frames_sink(positions, accounts, frames, F.lit(100.0), min_usd=20_000, band_pct=3.0, range_pct=30.0)
    return frames.read(in_parts(t, a, "observed_ts", sink, "attempts"))


@query("T8_stream_wall_tracker", use="levels", sql=f"WITH RECURSIVE {EPI} SELECT side, end_reason, count(*) AS episodes, sum(snapshots)::BIGINT AS snapshots FROM es WHERE end_reason <> 'censored_at_end' GROUP BY 1, 2")
def _(t):
    last = jobs.VersionedTable(t.spark, scratch_path(t.spark, "last-books"), t.books.schema)
    episodes = jobs.VersionedTable(t.spark, scratch_path(t.spark, "walls"), ob.OPEN_EPISODE)
    in_parts(t, t.books, "received_ms", jobs.wall_sink(last, episodes, max_gap=2 * TICK, width=BOOK_WIDTH, **RULE), "books")
    ended = t.spark.read.parquet(episodes.root).where("end_reason IS NOT NULL")
    return ended.groupBy("side", "end_reason").agg(F.count("*").alias("episodes"), F.sum("snapshots").alias("snapshots"))


BATCHES, DELAY = 5, 2 * DAY
RECEIVED = f"ts + {HOUR} + CASE WHEN trades % 5 = 0 THEN trades % 11 * {DAY} ELSE 0 END"


@query("T9_stream_two_clocks", use="bars", sql=f"""WITH r AS (SELECT symbol, ts, {RECEIVED} AS rc FROM bars), b AS (SELECT min(rc) AS lo, max(rc) AS hi FROM r),
k AS (SELECT r.*, CASE {' '.join(f'WHEN rc <= lo + (hi - lo) * {i + 1} // {BATCHES} THEN {i}' for i in range(BATCHES))} END AS batch FROM r, b), h AS (SELECT batch, max(ts) AS m, max(rc) AS cutoff FROM k GROUP BY 1),
w AS (SELECT batch, cutoff, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM h), s AS (SELECT DISTINCT symbol FROM r),
c AS (SELECT batch, symbol, count(*) AS received, count(*) FILTER (high IS NULL OR ts >= high) AS on_time, count(*) FILTER (ts < high AND ts >= high - {DELAY}) AS late, count(*) FILTER (ts < high - {DELAY}) AS dropped FROM k JOIN w USING (batch) GROUP BY 1, 2)
SELECT symbol, batch::BIGINT AS batch, coalesce(received, 0) AS received, coalesce(on_time, 0) AS on_time, coalesce(late, 0) AS late, coalesce(dropped, 0) AS dropped, (SELECT count(*) FROM r WHERE r.symbol = s.symbol AND ts + {HOUR} <= cutoff AND rc > cutoff) AS waiting FROM w CROSS JOIN s LEFT JOIN c USING (batch, symbol)""")
def _(t):
    b = t.bars.select("symbol", "ts", F.expr(RECEIVED).alias("received_ts"))
    clocks, out = jobs.VersionedTable(t.spark, scratch_path(t.spark, "clocks"), jobs.CLOCKS), scratch_path(t.spark, "receipts")
    last = in_parts(t, b, "received_ts", jobs.two_clock_sink(clocks, out, delay=DELAY), "arrivals", parts=BATCHES)
    return wn.receipt_report(t.spark.read.parquet(out).drop("part"), clocks.read(last), ["symbol"], step=HOUR, width=7 * DAY)


@query("T11_stream_early_warning", use="bars", sql=f"WITH {WS} SELECT symbol, ts, state FROM st")
def _(t):
    b = t.bars
    out = scratch_path(t.spark, "states")
    sink = jobs.warning_sink(jobs.VersionedTable(t.spark, scratch_path(t.spark, "history"), b.schema), out, ["symbol"], step=HOUR, width=7 * DAY, need=40, **CFG)
    in_parts(t, b, "ts", sink, "bars")
    return t.spark.read.parquet(out).select("symbol", "ts", "state")
