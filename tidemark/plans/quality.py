"""Quality, set-operation and top-k queries."""

from pyspark.sql import functions as F

from ..operators import quality as q
from ..operators.bars import coverage
from ..session import DAY, HOUR
from .joins import CAL, _calendar
from .registry import query

BW = 7 * DAY
CUT = 883_612_800_000  # 1998-01-01


@query("Q1_gap_report", use="bars", sql=f"WITH p AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars) SELECT symbol, p AS from_ts, ts AS to_ts, (ts - p) // {HOUR} - 1 AS missing_bars FROM p WHERE ts - p > {HOUR}")
def _(t):
    return q.gap_report(t.bars, ["symbol"], step=HOUR, width=BW)


@query("Q2_missing_days", use="daily", sql="""WITH e AS (SELECT symbol, min(date) AS a, max(date) AS z FROM daily GROUP BY 1), s AS (SELECT symbol, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS date FROM e) SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.symbol = s.symbol AND d.date = s.date)""")
def _(t):
    return q.missing_days(t.daily, ["symbol"])


@query("Q3_dataset_meta", use="bars", sql=f"""WITH p AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars) SELECT symbol, min(ts) AS period_start, max(ts) AS period_end, count(*) AS rows, (max(ts) - min(ts)) // {HOUR} + 1 AS expected_bars, (max(ts) - min(ts)) // {HOUR} + 1 - count(*) AS missing_bars_total, count(*) FILTER (ts - p > {HOUR}) AS gaps_count FROM p GROUP BY 1""")
def _(t):
    return q.dataset_meta(t.bars, ["symbol"], step=HOUR, width=BW)


@query("Q4_quality_tokens", sql="""WITH c AS (SELECT 'brand_size' AS "column", CASE WHEN p_size % 10 = 0 THEN p_brand ELSE p_size::VARCHAR END AS token FROM part UNION ALL SELECT 'price', CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE p_retailprice::VARCHAR END FROM part UNION ALL SELECT 'name_flag', p_name FROM part),
n AS (SELECT "column", token, count(*) AS n FROM c WHERE TRY_CAST(token AS DOUBLE) IS NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, token) AS r FROM n)
SELECT "column", token, n FROM r WHERE r <= 20 UNION ALL SELECT "column", '<other>', sum(n)::BIGINT FROM r WHERE r > 20 GROUP BY 1""")
def _(t):
    p = t.table("part").select(F.when(F.col("p_size") % 10 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("brand_size"),
                               F.when(F.col("p_partkey") % 7 == 0, F.col("p_type")).otherwise(F.col("p_retailprice").cast("string")).alias("price"), F.col("p_name").alias("name_flag"))
    return q.quality_tokens(p, {"brand_size": "double", "price": "double", "name_flag": "double"})


@query("Q6_raw_hour_coverage", use="bars", sql=f"""WITH g AS (SELECT symbol, (ts // {6 * HOUR}) * {6 * HOUR} AS b, count(*) = 6 AS w FROM bars WHERE symbol IN ('click', 'view') GROUP BY 1, 2), p AS (SELECT b, bool_or(w AND symbol = 'click') AS x, bool_or(w AND symbol = 'view') AS y FROM g GROUP BY 1)
SELECT count(*) FILTER (x AND y) AS common_valid, count(*) FILTER (x <> y) AS one_sided, count(*) FILTER (NOT x AND NOT y) AS both_incomplete, (max(b) - min(b)) // {6 * HOUR} + 1 - count(*) AS all_missing, min(CASE WHEN x AND y THEN b + {6 * HOUR} END) AS first_common, max(CASE WHEN x AND y THEN b + {6 * HOUR} END) AS last_common FROM p""")
def _(t):
    return q.raw_hour_coverage(t.bars, "symbol", "click", "view", step=HOUR, n=6)


@query("Q7_semantic_fingerprint", use="order_events", sql=f"""SELECT strategy, count(*) AS rows, sum(('0x' || substr(sha256(detect_ts || '|' || entry_ts || '|' || exit_ts), 1, 12))::BIGINT)::VARCHAR AS digest FROM order_events WHERE detect_ts < {CUT} GROUP BY 1""")
def _(t):
    return q.row_digests(t.order_events.where(F.col("detect_ts") < CUT), ["strategy"], ["detect_ts", "entry_ts", "exit_ts"])


@query("Q7_mutation_detection", use="order_events", sql=f"""SELECT DISTINCT strategy, 'changed' AS change FROM order_events WHERE detect_ts < {CUT} AND order_id % 1000 = 7""")
def _(t):
    cols = ["detect_ts", "entry_ts", "exit_ts"]
    e = t.order_events.where(F.col("detect_ts") < CUT)
    later = e.withColumn("exit_ts", F.when(F.col("order_id") % 1000 == 7, F.col("exit_ts") + 1).otherwise(F.col("exit_ts")))
    return q.mutated(q.fingerprint(e, ["strategy"], cols), q.fingerprint(later, ["strategy"], cols), ["strategy"])


@query("Q8_funding_reconciliation", use="funding", dbl="used_sum stored_sum", sql=f"""WITH a AS (SELECT user_id % 10 AS grp, sum(rate) AS used_sum, count(*) AS used_rows FROM funding WHERE user_id % 10 <> 3 OR ts < 1704585600000 GROUP BY 1), b AS (SELECT user_id % 10 AS grp, sum(rate) AS stored_sum, count(*) AS stored_rows FROM funding GROUP BY 1)
SELECT grp, used_sum, used_rows, stored_sum, stored_rows, abs(used_sum - stored_sum) <= 1e-9 * greatest(abs(used_sum), abs(stored_sum), 1e-3) AS match FROM a FULL JOIN b USING (grp)""")
def _(t):
    f = t.funding.withColumn("grp", F.col("user_id") % 10)
    return q.reconcile(f.where((F.col("grp") != 3) | (F.col("ts") < 1_704_585_600_000)), f, ["grp"], "rate")


@query("Q9_coverage_status", use="ticks", sql=f"""WITH g AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM ticks), c AS (SELECT symbol, max(ts) + {HOUR} AS e, coalesce(max(CASE WHEN ts - p > {4 * HOUR} THEN ts END), min(ts)) AS t FROM g GROUP BY 1),
r AS (SELECT 'cand-' || symbol AS candidate, symbol AS source, 1706572800000 AS req FROM c UNION ALL SELECT 'cand-' || symbol, 'signup', 1706500000000 FROM c), n AS (SELECT candidate, unnest(list_filter([CASE WHEN e < req THEN source || '_coverage_incomplete' END, CASE WHEN t > 1705276800000 THEN source || '_gap_after_baseline' END, ''], lambda x: x IS NOT NULL)) AS note FROM r JOIN c ON c.symbol = r.source),
s AS (SELECT candidate, coalesce(string_agg(note, ';' ORDER BY note) FILTER (note <> ''), '') AS notes FROM n GROUP BY 1) SELECT candidate, notes, CASE WHEN notes = '' THEN 'ready' ELSE 'awaiting_source_refresh' END AS status FROM s""")
def _(t):
    c = coverage(t.ticks, ["symbol"], interval=HOUR, tolerance=3 * HOUR, width=t.tick_width).withColumnRenamed("symbol", "source")
    s = t.ticks.select("symbol").distinct()
    cand = F.concat(F.lit("cand-"), "symbol").alias("candidate")
    r = s.select(cand, F.col("symbol").alias("source"), F.lit(1_706_572_800_000).alias("required_end")).unionByName(
        s.select(cand, F.lit("signup").alias("source"), F.lit(1_706_500_000_000).alias("required_end")))
    return q.coverage_status(r, c, source="source", baseline=1_705_276_800_000)


@query("Q11_disclosure_check", use="equities", sql="SELECT unnest(['thin_rows', 'last_is_date', 'first_day_dates_as_numbers', 'note_holds_dates']) AS violation")
def _(t):
    f = t.equities.groupBy("code").agg(F.count("*").alias("n"), F.max("date").alias("last"), F.date_format(F.min("date"), "yyyyMMdd").cast("int").alias("first_day"),
                                       F.concat(F.lit("seen "), F.min("date").cast("string")).alias("note"), (F.avg("close") / 7).alias("mean_close"))
    return q.disclosure_check(f, "code", "n", min_observations=100_000_000, max_rows=1000, max_columns=30)


@query("Q13_premise_checks", use="daily equities", dbl="corr_a_b corr_a_c share", sql="""WITH p AS (SELECT d.date, d.close AS a, e.close AS b, f.close AS c, CASE WHEN e.close IS NULL THEN 'single' ELSE 'both' END AS method FROM (SELECT * FROM daily WHERE symbol = '1-URGENT') d LEFT JOIN (SELECT * FROM equities WHERE code = 1) e USING (date) LEFT JOIN (SELECT * FROM equities WHERE code = 2) f USING (date))
SELECT method, count(*) AS n, (SELECT count(*) FROM p) AS days, (SELECT corr(a, b) FROM p) AS corr_a_b, (SELECT corr(a, c) FROM p) AS corr_a_c, (SELECT count(*) FROM p WHERE a IS NULL) AS missing_a, (SELECT count(*) FROM p WHERE b IS NULL) AS missing_b, (SELECT count(*) FROM p WHERE c IS NULL) AS missing_c, count(*) / (SELECT count(*) FROM p) AS share FROM p GROUP BY 1""")
def _(t):
    d = t.daily.where("symbol = '1-URGENT'").select("date", F.col("close").alias("a"))
    e = lambda code, n: t.equities.where(F.col("code") == code).select("date", F.col("close").alias(n))
    p = d.join(e(1, "b"), "date", "left").join(e(2, "c"), "date", "left").withColumn("method", F.when(F.col("b").isNull(), "single").otherwise("both"))
    return q.premise_checks(p, [("a", "b"), ("a", "c")], "method")


@query("U1_concat_panels", use="bars daily", dbl="close", sql="SELECT symbol, ts, NULL::DATE AS date, close FROM bars UNION ALL SELECT symbol, NULL, date, close FROM daily")
def _(t):
    return t.bars.select("symbol", "ts", "close").unionByName(t.daily.select("symbol", "date", "close"), allowMissingColumns=True).select("symbol", "ts", "date", "close")


@query("U4_calendar_difference", use="daily", sql=f"WITH {CAL} SELECT date FROM cal WHERE date NOT IN (SELECT date FROM daily WHERE symbol = '1-URGENT')")
def _(t):
    return q.missing_from_calendar(_calendar(t), t.daily.where("symbol = '1-URGENT'"))


@query("U4_expected_not_observed", use="bars", sql=f"WITH e AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM bars GROUP BY 1), s AS (SELECT symbol, unnest(generate_series(a, z, {HOUR})) AS ts FROM e) SELECT s.symbol, s.ts FROM s LEFT JOIN bars b USING (symbol, ts) WHERE b.close IS NULL")
def _(t):
    return q.expected_steps(t.bars, ["symbol"], step=HOUR)


@query("K1_top_n", use="order_events", dbl="net_bp", sql="SELECT strategy, order_id, net_bp, rank FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY net_bp, order_id) AS rank FROM order_events) WHERE rank <= 10")
def _(t):
    return q.top_n(t.order_events, ["strategy"], [F.col("net_bp").asc(), F.col("order_id").asc()], 10).select("strategy", "order_id", "net_bp", "rank")


@query("K5_dedupe_first", use="fills", dbl="px", digits=8, sql="SELECT order_id, line, part, ts, px FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts, line, part, px) AS r FROM fills) WHERE r = 1")
def _(t):
    return q.dedupe_first(t.fills.select("order_id", "line", "part", "ts", "px"), ["order_id"], ["ts", "line", "part", "px"])


@query("K6_argmax_findings", use="bars", dbl="high", sql=f"SELECT symbol, ts // {DAY} AS day, arg_min(ts, (-high, ts)) AS ts, max(high) AS high FROM bars b GROUP BY symbol, b.ts // {DAY}")
def _(t):
    d = t.bars.select("symbol", F.floor(F.col("ts") / DAY).alias("day"), "ts", "high")
    return q.argmax_rows(d, ["symbol", "day"], "high", "ts")


@query("T10_tick_alignment", use="levels", sql=f"SELECT DISTINCT stream, tick_ms, received_ms, (received_ms // {HOUR}) * {HOUR} AS tick FROM levels")
def _(t):
    return q.tick_alignment(t.books.select("stream", "tick_ms", "received_ms"), ["stream"], interval=HOUR)
